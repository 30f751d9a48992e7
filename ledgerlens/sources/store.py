"""A keyed table in hash buckets with versions: an upsert rewrites the buckets that it
touches and then a manifest, which says where each bucket's rows are.

<path>/data/version=v/bucket=b   rows of a bucket as version v left them
<path>/manifests/version=v       (bucket, data_version), a row for each bucket

A version is there once its manifest is, which is written last, so a write that fails
leaves the version before it as it was. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.state import upsert


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def create(self) -> None:
        """Version 0, without rows; fails if the store is there."""
        self._commit({b: None for b in range(self.buckets)}, 0)

    def _commit(self, places: dict[int, int | None], version: int) -> None:
        rows = self.spark.createDataFrame(list(places.items()), "bucket int, data_version long")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifests/version={version}")

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema("bucket int, data_version long, version long").parquet(f"{self.path}/manifests")

    def version(self) -> int:
        return self._manifests().agg(F.max("version")).first()[0]

    def places(self, version: int | None = None) -> dict[int, int | None]:
        """Where each bucket's rows are: a row for each bucket comes to the driver."""
        version = self.version() if version is None else version
        found = {r.bucket: r.data_version for r in self._manifests().where(F.col("version") == version).collect()}
        if not found:
            raise ValueError(f"no version {version} at {self.path}")
        return found

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, places: dict[int, int | None]) -> DataFrame:
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, v in places.items() if v is not None]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.places(version))

    def upsert(self, delta: DataFrame, rules: dict[str, str], order: list[Column]) -> int:
        """Apply delta by key (rules and order as in state.upsert); the new version.
        Buckets without a row of delta are neither read nor written."""
        old, version = self.places(), self.version() + 1
        placed = delta.withColumn("_b", self._bucket())
        touched = [r[0] for r in placed.select("_b").distinct().collect()]  # buckets at most
        if not touched:
            return version - 1
        merged = upsert(self._rows({b: old[b] for b in touched}), placed.drop("_b"), self.keys, rules, order)
        rows = merged.select(*self.schema.fieldNames()).withColumn("bucket", self._bucket())
        # What a failed write of this version left is overwritten: no manifest points there.
        rows.repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        self._commit(old | dict.fromkeys(touched, version), version)
        return version
