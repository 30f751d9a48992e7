"""The resolver: one winning observation for each (company, metric)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import first_by

# Scenario ranks; unknown scenarios rank like null.
SCENARIOS = {"actual": 0, "estimate": 2, "projection": 3, "forecast": 4}


def scenario_rank(scenario: Column) -> Column:
    out = F.lit(1)
    for name, rank in SCENARIOS.items():
        out = F.when(scenario == name, rank).otherwise(out)
    return out


def pick(observations: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Winner by scenario, date, source priority, capture time, confidence, id."""
    order = [scenario_rank(F.col("scenario")).asc(), F.col("as_of_date").desc_nulls_last(), F.col("source_priority").asc(), F.col("captured_at").desc_nulls_last(), F.col("confidence").desc_nulls_last(), *[F.col(t).asc() for t in tie]]
    return first_by(observations, keys, order)


def projection_vs_actual(observations: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Latest projected against latest actual value of each target date. One
    window over both kinds, then one groupBy instead of a self-join."""
    kind = F.when(F.col("scenario") == "actual", "actual").when(F.col("scenario").isin("estimate", "projection", "forecast"), "projected")
    rows = observations.withColumn("_kind", kind).where("_kind is not null and as_of_date is not null")
    w = Window.partitionBy(*keys, "as_of_date", "_kind").orderBy(F.col("captured_at").desc(), *[F.col(t).desc() for t in tie])
    latest = rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    value = lambda k: F.max(F.when(F.col("_kind") == k, F.col("value")))
    both = latest.groupBy(*keys, "as_of_date").agg(value("projected").alias("projected"), value("actual").alias("actual")).where("projected is not null and actual is not null")
    delta = F.col("actual") - F.col("projected")
    share = F.when(F.col("projected") != 0, F.round(delta * 100.0 / F.abs("projected"), 4))
    return both.select(*keys, "as_of_date", "projected", "actual", delta.alias("delta"), share.alias("delta_pct"))
