"""Scores. The live scorer (weakest link) and the view scorer (product) differ
on purpose and are separate functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, rounded

# Weights of the financial components.
FINANCIAL = {"gross_margin": 0.35, "runway": 0.25, "burn": 0.25, "stage": 0.15}


def weighted_average(score: Column, weight: Column) -> Column:
    """Aggregate over the scored rows only; null if there are none."""
    scored = F.when(score.isNotNull(), weight)
    return F.sum(score * scored) / F.nullif(F.sum(scored), F.lit(0.0))


def type_scores(values: DataFrame) -> DataFrame:
    """(company_id, mtype, score) from values (company_id, mtype, score, weight)."""
    return values.groupBy("company_id", "mtype").agg(rounded(weighted_average(F.col("score"), F.col("weight")), 2).alias("score"))


def weights(house: DataFrame, personal: DataFrame) -> DataFrame:
    """(mtype, weight): personal weights over house weights."""
    p = personal.select("mtype", F.col("weight").alias("_p"))
    return house.join(p, "mtype", "full_outer").select("mtype", F.coalesce("_p", "weight").alias("weight"))


def scorecard(scores: DataFrame, companies: DataFrame, types: DataFrame) -> DataFrame:
    """Weakest-link scorecard. types (mtype, must_have, weight); every company is
    held against every type, so a must-have without rows counts as missing. Products
    are added as decimals, so that the order of the rows decides no tie."""
    grid = companies.select("company_id").crossJoin(F.broadcast(types))  # types are a dimension of a few rows
    full = grid.join(scores, ["company_id", "mtype"], "left")
    must = F.when(F.col("must_have"), F.col("score"))
    missing = F.array_sort(F.collect_list(F.when(F.col("must_have") & F.col("score").isNull(), F.col("mtype"))))
    total = lambda x: F.sum(F.when(F.col("score").isNotNull(), x).cast("decimal(38,12)")).cast("double")
    out = full.groupBy("company_id").agg(
        (total(F.col("score") * F.col("weight")) / F.nullif(total(F.col("weight")), F.lit(0.0))).alias("base"),
        F.min(must).alias("weakest"),
        missing.alias("missing"),
    )
    complete = F.size("missing") == 0
    return out.select("company_id", rounded(F.col("base"), 4).alias("base"), F.when(complete, rounded(F.col("weakest") / 5, 4)).alias("multiplier"), F.when(complete, rounded(F.col("base") * F.col("weakest") / 5, 4)).alias("overall"), F.array_join("missing", ",").alias("missing"))


def score_view(values: DataFrame, companies: DataFrame, types: DataFrame) -> DataFrame:
    """Literal view semantics: present types only, null values act as 0, product penalty."""
    v = values.join(F.broadcast(types.withColumnRenamed("weight", "type_weight")), "mtype")
    per = v.groupBy("company_id", "mtype", "must_have", "type_weight").agg((F.sum(F.col("score") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("ts"), F.bool_and(F.coalesce(F.col("score").isNotNull(), F.lit(False))).alias("ok"))
    penalty = F.exp(F.sum(F.when(F.col("must_have"), F.ln(F.greatest(F.coalesce("ts", F.lit(0.01)), F.lit(0.01)) / 5))))
    out = per.groupBy("company_id").agg(
        (F.sum(F.col("ts") * F.col("type_weight")) / F.nullif(F.sum("type_weight"), F.lit(0.0))).alias("base"),
        F.bool_and(F.when(F.col("must_have"), F.col("ok"))).alias("complete"),
        penalty.alias("penalty"),
    )
    score = F.when(F.coalesce(F.col("complete"), F.lit(True)), F.round(F.col("base") * F.coalesce("penalty", F.lit(1.0)), 2))
    return companies.select("company_id").join(out.select("company_id", score.alias("score")), "company_id", "left")


def financials(inputs: DataFrame, digits: int = 2) -> DataFrame:
    """(company_id, financials, n_inputs) from (company_id, code, x, granularity):
    each component clamped to 1..5, averaged over those there are."""
    at = lambda c: F.max(F.when(F.col("code") == c, F.col("x")))
    monthly = F.max(F.when(F.col("code") == "burn_rate", F.col("granularity") == "month"))
    wide = inputs.groupBy("company_id").agg(at("gross_margin").alias("gm"), at("runway_months").alias("rw"), at("revenue").alias("rev"), at("burn_rate").alias("burn"), monthly.alias("monthly"), at("funding_stage").alias("st"))
    annual = F.when(F.col("monthly"), F.col("burn") * 12).otherwise(F.col("burn"))
    parts = {
        "gross_margin": clamp(F.col("gm") / 20),
        "runway": clamp(F.col("rw") / 6),
        "burn": F.when(F.col("burn") > 0, clamp(1 + 2 * (F.col("rev") / annual))),
        "stage": clamp(F.col("st")),
    }
    got = wide.select("company_id", *[p.alias(k) for k, p in parts.items()])
    total = sum((F.coalesce(F.col(k) * w, F.lit(0.0)) for k, w in FINANCIAL.items()), F.lit(0.0))
    weight = sum((F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in FINANCIAL.items()), F.lit(0.0))
    count = sum((F.col(k).isNotNull().cast("int") for k in FINANCIAL), F.lit(0))
    return got.select("company_id", F.round(total / F.nullif(weight, F.lit(0.0)), digits).alias("financials"), count.alias("n_inputs"))


def rank(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.col("overall").desc_nulls_last(), "name")
