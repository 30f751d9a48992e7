"""Queries over the driver's tables, each with its SQL where SQL can express it.

`base` SQL (read alike by Spark and DuckDB) turns the driver's tables into the
shape of an operator's input; the operator is applied with the DataFrame API.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import documents as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, sql: str, spread: bool = False) -> DataFrame:
    """spread: the tables' rows are dealt over tasks first, before texts are made of them."""
    deal = D.spread if spread else lambda df: df
    tables = {t: deal(scan(spark, sf_dir, t)) for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **tables)


def query(sql: str | None = None, over: str | None = None, name: str | None = None, spread: bool = False):
    """Register f(df) or f(df, sf_dir) over the rows of the base SQL `over`, or
    f(spark, sf_dir); sql: the same in DuckDB, where `b` is the base."""

    def add(f):
        key = name or f.__name__
        more = len(inspect.signature(f).parameters) > 1
        QUERIES[key] = (lambda spark, sf_dir: f(base(spark, sf_dir, over, spread), *([sf_dir] if more else []))) if over else f
        if sql:
            plain = re.sub(r"\{(\w+)\}", r"\1", over) if over else ""
            if over and re.match(r"\s*WITH\b", sql):
                SQL[key] = re.sub(r"^\s*WITH\b", lambda _: f"WITH b AS ({plain}),", sql, count=1)
            else:
                SQL[key] = f"WITH b AS ({plain}) {sql}" if over else sql
        return f

    return add
