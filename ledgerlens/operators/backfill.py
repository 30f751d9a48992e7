"""Backfill: stored values become observations of synthetic runs, with links from the
current values to the observations that now back them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .state import broadcast_if_small, first_by, insert_ignore

#: Runs up to so many are broadcast.
ROWS = 200_000


def numbered(df: DataFrame, order: list[Column], out: str, after: int = 0, partitions: int | None = None) -> DataFrame:
    """df with `out`, numbers from after + 1 in the order given (total).

    Two levels: rows are numbered as they are sorted inside range partitions, and only the
    partitions' counts, a row each, are summed in order, so no task holds all rows and
    rows move once.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Partition in the upper bits, place in the partition in the lower 33.
    at = F.monotonically_increasing_id()
    ranged = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at), "ranged")
    ranged = ranged.withColumn("_pid", F.shiftright("_at", 33))
    counts = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(offsets), "_pid").withColumn(out, F.col("_before") + place + 1 + after).drop("_at", "_pid", "_before")


@dataclass
class Backfill:
    """runs (run_id, extractor, company_id, status, observations), observations
    (observation_id, run_id, company_id, metric_id, value, evidence, url, confidence,
    captured_at, fingerprint) and links (value_id, observation_id), all new."""

    runs: DataFrame
    observations: DataFrame
    links: DataFrame


def extractor(captured_by: Column, override: Column) -> Column:
    """Who is taken for the source of a stored value."""
    return F.when(override, "analyst_override").when(F.contains(F.lower(captured_by), F.lit("alpha_scout")), "alpha_scout_v1").otherwise("seed_data_v1")


def fingerprint(company: str, metric: str, value: str, evidence: str, at: str) -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat_ws("||", *[text(c) for c in (company, metric, value, evidence, at)]).cast("binary"))


def _key(fingerprint: Column) -> Column:
    """A fingerprint in half the bytes; null for what is none."""
    return F.when(fingerprint.rlike("^[0-9a-f]{32}\\z"), F.unhex(fingerprint))


def backfill(values: DataFrame, runs: DataFrame | None = None, observations: DataFrame | None = None) -> Backfill:
    """values: (value_id, company_id, metric_id, value, evidence, url, captured_by,
    captured_at, confidence, override, is_latest, winning_observation_id).

    One run for each extractor and company. Of values with equal fingerprints the first
    by company, metric, time and id makes the observation; those that are there already
    make none, so a second backfill adds nothing. Numbers go on after the greatest.
    Latest values that are no override and have no winner yet are linked to the
    observation that they made. A null confidence counts as 1.
    """
    order = [F.asc_nulls_first(c) for c in ("company_id", "metric_id", "captured_at", "value_id")]
    linked = F.expr("is_latest and not coalesce(override, false) and winning_observation_id is null")
    kept = ["value_id", "company_id", "metric_id", "value", "evidence", "url", "confidence", "captured_at"]
    rows = saved(values.select(*kept, extractor(F.col("captured_by"), F.col("override")).alias("extractor"), linked.alias("_linked")), "values")
    # Fingerprints, which don't compress, follow from the other columns: they are made where they are used.
    print_ = fingerprint("company_id", "metric_id", "value", "evidence", "captured_at")
    none = rows.limit(0)
    known_runs = runs if runs is not None else none.selectExpr("0L as run_id", "extractor", "company_id")
    known = observations if observations is not None else none.selectExpr("0L as observation_id", "string(null) as fingerprint")
    greatest = lambda df, c: df.agg(F.max(c)).first()[0] or 0
    keys = ["extractor", "company_id"]
    added = insert_ignore(known_runs.select(*keys), rows.select(*keys).distinct(), keys, [F.asc("extractor")])
    added = saved(numbered(added, [F.asc_nulls_first("company_id"), F.asc("extractor")], "run_id", greatest(known_runs, "run_id")), "runs")
    of = added.select("run_id", *keys).unionByName(known_runs.select("run_id", *keys))
    of = broadcast_if_small(of.select("run_id", F.col("extractor").alias("_e"), F.col("company_id").alias("_c")), ROWS)
    # No key is null, so plain equality holds, for which both sides lie by key already.
    there = known.select(_key(F.col("fingerprint")).alias("_key")).where("_key is not null").distinct()
    fresh = first_by(rows.withColumn("_key", F.unhex(print_)), ["_key"], order).join(there, "_key", "left_anti")
    fresh = numbered(fresh.drop("_key"), order, "observation_id", greatest(known, "observation_id"))
    made = saved(fresh.join(of, (F.col("extractor") == F.col("_e")) & F.col("company_id").eqNullSafe(F.col("_c"))), "observations")
    counts = broadcast_if_small(made.groupBy("run_id").agg(F.count("*").alias("observations")), ROWS)
    new_runs = added.join(counts, "run_id", "left").select("run_id", *keys, F.lit("success").alias("status"), F.coalesce("observations", F.lit(0)).alias("observations"))
    new = made.select("observation_id", "run_id", "company_id", "metric_id", "value", "evidence", "url", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "captured_at", print_.alias("fingerprint"))
    links = made.where("_linked").select("value_id", "observation_id")
    return Backfill(new_runs, new, links)
