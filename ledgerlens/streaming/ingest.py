"""Incremental ingest: a stream of document files to observations (silver) and from
those to the current winner of each company and metric (gold).

Both steps keep their state in a state store, by key, so the cost of a batch depends
on the batch alone: fingerprints of the observations that silver has, and the current
winner of each (company, metric). Silver and gold are never read again for a batch.

Winners are a streaming aggregation (the least row in the resolver's order), not a
custom stateful operator: rows are combined before the shuffle, so that one company
with a third of all rows is no hot task, and everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import extract
from ..operators.resolve import scenario_rank
from ..sources.documents import chunks
from ..sources.rules import Rule

OBSERVATION = "company_id long, doc_id long, ordinal int, metric_code string, value string, evidence string, period_label string, scenario string, as_of_date date, confidence double, source_priority int, captured_at timestamp, fingerprint string"
KEYS, TIE = ["company_id", "metric_code"], ["doc_id", "ordinal", "fingerprint"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def observe(docs: DataFrame, rules: list[Rule], as_of: Column) -> DataFrame:
    """Observations of documents (company_id, doc_id, text, source_priority, captured_at)."""
    keys = ["company_id", "doc_id", "ordinal", "source_priority", "captured_at"]
    parts = chunks(docs, ["company_id", "doc_id", "source_priority", "captured_at"], "\n")
    rows = extract(parts, rules, as_of, keys)
    fields = ["company_id", "doc_id", "ordinal", "metric_code", "value", "scenario", "as_of_date"]
    return rows.withColumn("fingerprint", F.md5(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]))).select(*[c.split()[0] for c in OBSERVATION.split(", ")])


def order_of(tie: list[str]) -> Column:
    """The resolver's order as one comparable value; the least wins. Nulls come first
    in a struct, so where they rank last a flag stands before the value."""
    last = lambda c, value: [F.col(c).isNull(), -value]
    parts = [scenario_rank(F.col("scenario")), *last("as_of_date", F.unix_date(F.col("as_of_date").cast("date"))), F.col("source_priority"), *last("captured_at", F.unix_micros(F.col("captured_at").cast("timestamp"))), *last("confidence", F.col("confidence").cast("double")), *[F.col(c) for c in tie]]
    return F.struct(*[p.alias(f"o{k}") for k, p in enumerate(parts)])


def current(observations: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Winner of each key, for batches and streams: the same rows as resolve.pick."""
    fields = [c for c in observations.columns if c not in keys]
    best = F.min_by(F.struct(*fields), order_of(tie)).alias("best")
    return observations.groupBy(*keys).agg(best).select(*keys, *[f"best.{c}" for c in fields])


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries that start inside keep state in RocksDB (its size isn't bound by memory)."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def to_silver(source: DataFrame, silver: str, checkpoint: str, rules: list[Rule], as_of: Column, trigger: dict) -> StreamingQuery:
    """Append observations whose fingerprint silver hasn't got: replayed documents
    add nothing, and a batch that runs again after a failure is written once."""
    fresh = observe(source, rules, as_of).dropDuplicates(["fingerprint"])
    with state_on_disk(source.sparkSession):
        return fresh.writeStream.format("parquet").option("path", silver).option("checkpointLocation", f"{checkpoint}/silver").trigger(**trigger).start()


def to_gold(observations: DataFrame, gold: str, checkpoint: str, keys: list[str], tie: list[str], trigger: dict) -> StreamingQuery:
    """Write the winners of the keys that a batch touches, one folder for each batch;
    one that runs again overwrites its own."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{gold}/batch={number}")

    best = current(observations, keys, tie)
    with state_on_disk(observations.sparkSession):
        return best.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/gold").trigger(**trigger).start()


class Run:
    """Both steps one after the other, for all input that is there."""

    def __init__(self, silver: StreamingQuery, then: Callable[[], StreamingQuery]):
        self.silver, self.then, self.gold = silver, then, None

    def awaitTermination(self) -> None:  # noqa: N802, as of a StreamingQuery
        self.silver.awaitTermination()
        self.gold = self.then()
        self.gold.awaitTermination()


def start(source: DataFrame, silver: str, gold: str, checkpoint: str, rules: list[Rule], as_of: Callable[[], Column]) -> Run:
    """Run until all available input is read. silver: folder of observations;
    gold: folder with one subfolder of winners for each batch."""
    spark, now = source.sparkSession, {"availableNow": True}
    first = to_silver(source, silver, checkpoint, rules, as_of(), now)
    return Run(first, lambda: to_gold(spark.readStream.schema(OBSERVATION).parquet(silver), gold, checkpoint, KEYS, TIE, now))


def winners(spark: SparkSession, gold: str, keys: list[str] = KEYS) -> DataFrame:
    """Current winner of each key: that of its newest batch."""
    rows = spark.read.parquet(gold)
    fields = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("newest"))
    return newest.select(*keys, *[f"newest.{c}" for c in fields])


def latest_events(source: DataFrame, key: str, at: str, event_id: str, delay: str) -> DataFrame:
    """A stream without repeated event ids, late ones within `delay` included."""
    return source.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key, event_id])
