"""Shared helpers: shared scratch folder, table reads, distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the word pattern of the contracts (anything but ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch sent to Python, so that long texts make short batches.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set(BATCH, "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir
    of the session. Only where it is unset (tests, one machine) a temporary
    folder is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def trim() -> None:
    """Give memory that a worker no longer uses back to the system, since workers
    outlive their tasks and share an executor's memory with the next stage's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a
    lost executor only costs a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows (reads at most limit + 1 of them)."""
    return df.limit(limit + 1).count() <= limit


def maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast df if it has at most limit rows, else leave the join to a shuffle."""
    return F.broadcast(df) if small(df, limit) else df


#: Rows of a key from which its join is split; most keys that are.
HOT, MOST_HOT = 2000, 50_000


def spread_join(many: DataFrame, one: DataFrame, on: str, how: str = "inner", counts: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """many.join(one, on, how) where one value of `on` may hold a great part of the
    rows of `many`. Such values are dealt out over as many tasks as they need, with
    a copy of their rows of `one` for each; rows are counted by partial aggregation
    first. counts: (on, _m), if known. `one` has few rows of each value."""
    if counts is None:
        counts = many.groupBy(on).agg(F.count("*").alias("_m"))
    heavy = saved(counts.where((F.col("_m") > hot) & F.col(on).isNotNull()).select(F.col(on), "_m"), "heavy")
    total = heavy.agg(F.sum("_m")).first()[0]
    if total is None:
        return many.join(one, on, how)
    limit = max(hot, total // MOST_HOT)
    copies = F.broadcast(heavy.where(F.col("_m") > limit).select(on, F.ceil(F.col("_m") / limit).cast("int").alias("_r")))  # at most MOST_HOT rows
    times = F.coalesce("_r", F.lit(1))
    # By content, so that a task that runs again deals its rows out alike.
    salt = F.when(F.col("_r").isNull(), 0).otherwise(F.pmod(F.xxhash64(*many.columns), F.col("_r")).cast("int"))
    left = many.join(copies, on, "left").withColumn("_salt", salt).drop("_r")
    right = one.join(copies, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), times - 1))).drop("_r")
    return left.join(right, [on, "_salt"], how).drop("_salt")


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, out: str, bits: int | None = None) -> DataFrame:
    """Add `out`, the exact sum of the long column `value` over the rows of the
    same group that come before this one in `order`; with bits (32 at most), that
    sum modulo 2^bits, which holds however large the sum is.

    Two levels, so that a group with a third of all rows is no single task: rows
    are range-partitioned by (group, order) and summed inside each partition;
    then only one total for each (partition, group) is prefix-summed.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in [*group, *order]]
    ranged = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*_nullable(df.schema), T.StructField("_pid", T.IntegerType()), T.StructField(out, T.LongType()), T.StructField("_total", T.LongType())])

    names = df.columns
    mask = -1 if bits is None else (1 << bits) - 1

    def local(batches):
        from pyspark import TaskContext

        pid, last, seen = TaskContext.get().partitionId(), (), 0
        for b in batches:
            n = b.num_rows
            v = b.column(names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            # Where a new group begins; sums start anew there.
            marks = list(zip(*[b.column(names.index(g)).to_pylist() for g in group], strict=True)) if group else [()] * n
            begins = [k for k in range(n) if marks[k] != (marks[k - 1] if k else last)] if group else []
            before = np.cumsum(v) - v
            base = np.zeros(n, dtype=np.int64)
            base[: begins[0] if begins else n] = seen
            for x, y in zip(begins, [*begins[1:], n], strict=False):
                base[x:y] = -before[x]
            before = (before + base) & mask  # sums wrap at 2^64, which leaves the low bits as they are
            if n:
                last, seen = marks[-1], int(before[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, pid, dtype=np.int32)), pa.array(before), pa.array(before + v)], names=[*names, "_pid", out, "_total"])

    level = saved(ranged.mapInArrow(local, schema), "prefix")
    whole = F.max("_total") if bits is None else F.sum(F.col(value).bitwiseAND(F.lit(mask)))
    sums = level.groupBy(*group, "_pid").agg(whole.alias("_sum"))
    w = Window.partitionBy(*[F.col(g) for g in group]).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_pid").alias("_p"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_offset"))
    on = F.col("_pid") == F.col("_p")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    total = F.col(out) + (F.col("_offset") if bits is None else F.col("_offset").bitwiseAND(F.lit(mask)))
    total = total if bits is None else total.bitwiseAND(F.lit(mask))
    return level.join(maybe_broadcast(offsets, 100_000), on, "left").withColumn(out, total).drop("_pid", "_total", "_p", "_offset", *[f"_g_{g}" for g in group])
