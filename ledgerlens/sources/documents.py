"""Document sources and blob sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.state import top_k

#: Chunks of fewer characters carry nothing.
LEAST = 20


def browse(df: DataFrame, name: str, order: list[str], n: int, allowed: set[str]) -> DataFrame:
    """The first n rows of a table that may be browsed."""
    if name not in allowed:
        raise ValueError(f"{name} may not be browsed")
    return df.orderBy(*order).limit(n)


def files(spark: SparkSession, path: str, most: int = 10 * 1024 * 1024) -> DataFrame:
    """(content_hash, path, size_bytes, content, accepted) of uploads: at most
    `most` bytes and a PDF's head."""
    raw = spark.read.format("binaryFile").load(path)
    pdf = F.substring("content", 1, 4) == F.lit(b"%PDF")
    return raw.select(F.sha2("content", 256).alias("content_hash"), "path", F.col("length").alias("size_bytes"), "content", ((F.col("length") <= most) & pdf).alias("accepted"))


#: Rows that one task takes of a table whose rows are costly.
SHARE = 50_000


def spread(df: DataFrame, rows: int = SHARE) -> DataFrame:
    """df dealt over all cores, in tasks of so many rows at most, whatever its files and
    row groups are; so that the longest task doesn't grow with the table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)))


def chunks(docs: DataFrame, keys: list[str], separator: str = "\f") -> DataFrame:
    """(keys, ordinal, locator, text): pages with white space collapsed; short ones are skipped, ordinals keep their gaps."""
    parts = docs.select(*keys, F.posexplode(F.split("text", separator)).alias("ordinal", "text"))
    return parts.select(*keys, "ordinal", F.concat(F.lit("slide_"), (F.col("ordinal") + 1).cast("string")).alias("locator"), X.collapse(F.col("text")).alias("text")).where(F.length("text") >= LEAST)


def head_text(chunks_: DataFrame, keys: list[str], order: list[str], text: str, n: int = 3) -> DataFrame:
    """(keys, head): the first n chunks' texts by order, joined by newlines."""
    first = top_k(chunks_, keys, [F.asc(c) for c in order], n)
    got = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))).alias("x"))
    return got.select(*keys, F.array_join("x._t", "\n").alias("head"))


def blob_path(digest: Column, ending: str) -> Column:
    """hh/hash.ending: files spread over 256 folders."""
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(f".{ending}"))
