"""A training corpus from `documents`, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next one's docs. All but the last return the columns of
`documents`, and whatever other columns there are, unchanged; the last returns the
token store's row for each document kept. An empty table gives no rows at any stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, mixing, neardup, quality, token_store
from ledgerlens.llm.common import maybe_broadcast, saved, scratch_path, table

#: Rows of (key) tables up to which they are broadcast (at most 64 MB); beyond, the join shuffles.
ROWS = 1_000_000
#: Columns that stages read; others are carried under names that can't clash with a stage's own.
READ = ("doc_id", "text", "lang", "source", "n_chars")


def _carrying(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"other{k}" for k, c in enumerate(docs.columns) if c not in READ}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return out.withColumnsRenamed({v: k for k, v in aside.items() if v in out.columns})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with `_k`, a key of 128 bits of the whole row: rows without an id have
    one too, and equal rows the same."""
    parts = [x for c in docs.columns for x in (F.col(c), F.isnull(c))]
    return docs.withColumn("_k", F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (1, 2)]))


def _once(keyed: DataFrame) -> DataFrame:
    """Equal rows once. Only rows that repeat are shuffled."""
    repeated = saved(keyed.groupBy("_k").count().where("count > 1").select("_k"), "repeated")
    if not repeated.take(1):
        return keyed
    repeated = maybe_broadcast(repeated, ROWS)
    return keyed.join(repeated, "_k", "left_anti").unionByName(keyed.join(repeated, "_k", "left_semi").dropDuplicates(["_k"]))


@_carrying
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of these
    documents, doesn't reject; whole texts are scored.

    Null and empty texts have the score of a text without evidence, so they stay or
    go together; rows that repeat stay or go together; null ids are scored alike.
    Without labels of both classes all have one score, the share of good labels (0.5
    without any). With ties at the threshold documents stay.
    """
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=docs.columns)


@_carrying
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id.

    Texts without words (null, empty, white space) are in no group and stay. Of
    equal rows one stays, as of rows that differ in other columns only by id or text.
    A row without an id goes if its group has one with an id; of a group without ids
    every different row stays. Texts of any length are compared whole.
    """
    found = saved(neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw")).distinct(), "removed")
    keyed = _once(_keyed(docs))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_raw"))
    return keyed.join(maybe_broadcast(found, ROWS), same, "left_anti").select(*docs.columns)


@_carrying
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none and stay; with an empty benchmark all stay. Rows
    that repeat stay or go together, as do those without an id. Texts are searched
    whole, however long.
    """
    keyed = _keyed(docs)
    pairs = decontaminate.contaminated(keyed.select(F.col("_k").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), key="string")
    leaks = saved(pairs.select(F.col("doc_id").alias("_k")).distinct(), "leaks")
    return keyed.join(maybe_broadcast(leaks, ROWS), "_k", "left_anti").select(*docs.columns)


@_carrying
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times), whole.

    Texts without words (null, empty) have size 0 and are taken at their source's
    rate, which changes no source's words. Null is a source of its own. Rows that
    repeat are sampled each; ties of size go by id, then by the row's key, so reruns
    agree.
    """
    keyed = _keyed(docs)
    taken = mixing.mix(keyed, carry=["_k"]).groupBy("_k").agg(F.sum("copies").alias("_n")).where("_n > 0")
    taken = maybe_broadcast(saved(taken, "taken"), ROWS)
    times = F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))
    return _once(keyed).join(taken, "_k").withColumn("_copy", times).select(*docs.columns)


@_carrying
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in a content-addressed store, as read back from it:
    doc_id, start, n_tokens, ids_crc32, a row for each row of docs.

    Null and empty texts are the end id alone. Rows are stored in ascending order of
    the id, null ids last; copies share their chunks. Other columns aren't stored.
    """
    path = scratch_path(spark, "corpus")
    token_store.write(docs, path)
    return token_store.read(spark, path)


STAGES = [("quality", good), ("near-duplicates", distinct), ("decontamination", clean), ("mixing", mixed), ("token store", tokens)]

#: SQL can't express the stages; tests/llm/test_pipeline.py has each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
