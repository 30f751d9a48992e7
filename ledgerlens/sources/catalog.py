"""Catalogue of tables as checks over their data: statistics and constraints.

Statistics come from the Parquet footers: Spark's aggregate pushdown answers counts,
minima and maxima of plain columns from them on the executors, so no data is read.
Constraints are partial aggregations and anti joins over the key columns only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import broadcast_if_small

#: Keys up to so many are broadcast in a check of references.
ROWS = 200_000


def footers(spark: SparkSession) -> SparkSession:
    """A session that reads Parquet with aggregates pushed into its footers."""
    s = spark.newSession()
    s.conf.set("spark.sql.sources.useV1SourceList", "csv,json,orc,text,avro,kafka")
    s.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    s.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return s


def table_statistics(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(table, column, type, rows, nulls, least, greatest), a row for each column:
    bounds of whole numbers as longs, of other columns null, since footers don't hold
    them exactly. An empty table has 0 rows and null bounds."""
    df = footers(spark).read.parquet(path)
    whole = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    asked = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        asked.append(F.count(f"`{c}`").alias(f"c{i}"))
        if c in whole:
            asked += [F.min(f"`{c}`").alias(f"a{i}"), F.max(f"`{c}`").alias(f"z{i}")]
    one = df.agg(*asked)
    bound = lambda k, i, c: F.col(f"{k}{i}").cast("long") if c in whole else F.lit(None).cast("long")
    rows = [F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.col("n").alias("rows"), (F.col("n") - F.col(f"c{i}")).alias("nulls"), bound("a", i, c).alias("least"), bound("z", i, c).alias("greatest")) for i, c in enumerate(df.columns)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def statistics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_statistics(spark, p, name) for name, p in paths.items()])


def _found(rows: DataFrame, table: str, check: str, columns: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("violations")).select(F.lit(table).alias("table"), F.lit(check).alias("check"), F.lit(",".join(columns)).alias("columns"), "violations")


def unique(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """How many keys occur more than once; keys with a null in them don't count."""
    filled = df.select(*columns).dropna()
    return _found(filled.groupBy(*columns).count().where("count > 1"), table, "unique", columns)


def not_null(df: DataFrame, table: str, column: str) -> DataFrame:
    return _found(df.where(F.col(column).isNull()), table, "not null", [column])


def references(df: DataFrame, table: str, column: str, other: DataFrame, key: str) -> DataFrame:
    """How many rows have a value that is no key of the other table. Values are
    counted before the join, so a value of a third of the rows is one row in it."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).count()
    lost = values.join(broadcast_if_small(other.select(F.col(key).alias("_v")).distinct(), ROWS), "_v", "left_anti")
    return lost.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("violations")).select(F.lit(table).alias("table"), F.lit("references").alias("check"), F.lit(column).alias("columns"), "violations")


def among(df: DataFrame, table: str, column: str, allowed: list) -> DataFrame:
    return _found(df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed)), table, "among", [column])
