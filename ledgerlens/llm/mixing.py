"""Mixing sources to target weights by systematic sampling.

Each document has an expected number of copies (its source's target words over
its source's words). Within a source the expected copies are prefix-summed in a
fixed order, one keyed offset in [0, 1) is added, and a document is emitted once
for each integer that its stretch of the running sum crosses. Sums are exact:
copies are fixed-point longs in units of 2^-32.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, maybe_broadcast, prefix_sums, saved, table

UNIT = 1 << 32
#: Weights of the sources in their order, repeating; a target is at most MOST times the source.
WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The excess of capped sources is reshared by weight until none is above its
    cap. That has a closed form: with sources in ascending order of cap / weight,
    the first k are capped and the rest get weight * level, where level is what
    is left over their weights; k is the first place where level fits.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_k"), F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("_k", F.row_number().over(by_name) - 1).withColumn("_w", pick.cast("long"))
    per = per.withColumn("_cap", F.col("source_size") * most)
    by_cap = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_k"))
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    per = per.withColumn("_level", left / F.sum("_w").over(after))
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    per = per.withColumn("_final", F.first(fits, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """A keyed offset in [0, UNIT) for each source, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: int = MOST, seed: str = SEED, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, and the columns
    in carry), one row per row of docs.

    Null texts and texts without words have size 0. A null source is a source of
    its own, last. Within a source documents are stretched out by (size, key), so
    that every size is sampled at the source's rate, ties by the columns in carry;
    rows equal in all get copies in some order, which gives the same rows. A source without words has
    target 0 and no copies. An empty table gives no rows. Other columns are ignored.
    """
    sizes = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), *(carry or []))
    sizes = saved(sizes, "sizes")  # words are counted once
    targets = source_targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most * UNIT), F.round(F.col("target") / F.col("source_size") * UNIT).cast("long"))).otherwise(F.lit(0))
    rated = targets.select(F.col("source").alias("_s"), "source_size", "target", rate.cast("long").alias("_expected"))
    joined = sizes.join(maybe_broadcast(rated, 10_000), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    # A crossing depends on the fraction of the copies before it only, so sums can't overflow.
    run = prefix_sums(joined, ["source"], ["size", "doc_id", *(carry or [])], "_expected", "_before", bits=32)
    u = offset(F.col("source"), seed)
    crossed = F.shiftright(F.col("_before") + F.col("_expected") + u, 32) - F.shiftright(F.col("_before") + u, 32)
    return run.withColumn("copies", crossed).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(carry or []))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM per),
weighted AS (SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM weighted),
final AS (SELECT arg_min(level, cap / w) AS level FROM levels WHERE level * w <= cap),
targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM final) * w, cap::DOUBLE)) AS target FROM levels),
rated AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(12884901888, CAST(round(t.target / t.source_size * 4294967296) AS BIGINT)) ELSE 0 END AS expected,
    CAST(('0x' || substr(md5('mix-1:' || coalesce(d.source, chr(0))), 1, 8)) AS BIGINT) AS u
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
run AS (
  SELECT *, CAST(coalesce(sum(expected) OVER (PARTITION BY source ORDER BY size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM rated)
SELECT doc_id, size, source_size, target,
  CAST((((before + expected + u) >> 32) - ((before + u) >> 32)) * size AS BIGINT) AS taken
FROM run
"""
