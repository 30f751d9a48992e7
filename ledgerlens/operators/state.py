"""State as functions: old rows and a delta give new rows. No operator writes in
place; the caller appends or rewrites. All windows have a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows (it is counted up
    to there only); else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in order (which must be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of new to append: the first of each key that old doesn't have."""
    fresh = first_by(new, keys, order)
    known = old.select(*keys).distinct()
    return fresh.join(known, _same(fresh, known, keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: dict[str, str], order: list[Column]) -> DataFrame:
    """old with new's rows applied by key; values: column to rule. Rules: last
    (new wins), coalesce (new unless null), keep (old unless null), or (either)."""
    new = first_by(new, keys, order)
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in [*keys, *values]], F.lit(True).alias("_new"))
    on = reduce(lambda a, b: a & b, [old[k].eqNullSafe(n[f"_n_{k}"]) for k in keys])
    o = old.withColumn("_old", F.lit(True))
    on = reduce(lambda a, b: a & b, [o[k].eqNullSafe(n[f"_n_{k}"]) for k in keys])
    j = o.join(n, on, "full_outer")

    def rule(c: str, kind: str) -> Column:
        x, y = F.col(c), F.col(f"_n_{c}")
        if kind == "last":
            return F.when(F.col("_new"), y).otherwise(x)
        if kind == "coalesce":
            return F.coalesce(y, x)
        if kind == "keep":
            return F.coalesce(x, y)
        return F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False))

    return j.select(*[F.coalesce(F.col(k), F.col(f"_n_{k}")).alias(k) for k in keys], *[rule(c, r).alias(c) for c, r in values.items()])


def scd_latest(old: DataFrame, new: DataFrame, keys: list[str], at: str, tie: list[str]) -> DataFrame:
    """History of both with is_latest on the newest row of each key. Keys whose
    current row is an override take no new rows."""
    locked = old.where("is_latest and override").select(*keys).distinct()
    added = new.join(locked, _same(new, locked, keys), "left_anti")
    both = old.drop("is_latest").unionByName(added.drop("is_latest"))
    w = Window.partitionBy(*keys).orderBy(F.col("override").desc(), F.col(at).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tie])
    return both.withColumn("is_latest", F.row_number().over(w) == 1)


def unlocked(df: DataFrame, locked: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(locked.select(*keys).distinct(), keys, "left_anti")


def set_codes(rows: DataFrame, codes: DataFrame, id: str, code: str) -> DataFrame:
    """rows with the code that `codes` (id, code) has for their id, and `changed`: whether
    it is another one. Of several codes of an id the least counts; a null code sets null."""
    new = codes.groupBy(F.col(id).alias("_id")).agg(F.min(code).alias("_code"))
    j = rows.join(broadcast_if_small(new), rows[id] == F.col("_id"), "left")
    changed = F.col("_id").isNotNull() & ~F.col(code).eqNullSafe(F.col("_code"))
    return j.withColumn("changed", changed).withColumn(code, F.when(F.col("changed"), F.col("_code")).otherwise(F.col(code))).drop("_id", "_code")


def get_or_create(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(stored, answers): old with those of new whose key it doesn't have, the first of
    each in order, and for each key of new the row that is stored for it now, with
    `created`, whether it is new. Old rows are one a key and stay as they are."""
    added = insert_ignore(old, new, keys, order)
    both = old.withColumn("created", F.lit(False)).unionByName(added.withColumn("created", F.lit(True)))
    asked = new.select(*keys).distinct()
    return both.drop("created"), both.join(asked, _same(both, asked, keys), "left_semi")
