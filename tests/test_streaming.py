"""Keyed state: several batches equal one, replays change nothing, nothing is read twice."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import resolve
from ledgerlens.sources import rules as R
from ledgerlens.streaming import ingest

KEYS, TIE = ["company_id", "metric_code"], ["doc_id", "ordinal", "fingerprint"]
DOCS = "company_id long, doc_id long, text string, source_priority int, captured_at timestamp"


def observations(spark, n=3000, seed=1):
    r = random.Random(seed)
    day = lambda: r.choice([None, dt.date(2024, r.randint(1, 12), 1)])
    rows = [(1 if r.random() < 0.3 else r.randint(1, 40), r.randint(1, 9), r.choice([None, 1]), r.choice(["arr", "burn", None]), str(k), None, None, r.choice(["actual", "estimate", "other", None, "forecast"]), day(), r.choice([None, 0.5, 0.9]), r.randint(1, 3), r.choice([None, dt.datetime(2025, 1, r.randint(1, 28))]), f"f{k}") for k in range(n)]
    return spark.createDataFrame(rows, ingest.OBSERVATION)


def plain(df):
    return sorted(str(tuple(r)) for r in df.select(*[c.split()[0] for c in ingest.OBSERVATION.split(", ")]).collect())


def test_current_equals_pick(spark):
    rows = observations(spark)
    assert plain(ingest.current(rows, KEYS, TIE)) == plain(resolve.pick(rows, KEYS, TIE))


@pytest.fixture
def streamed(spark, tmp_path):
    """Batches one by one into the same folders; the progress of each run."""
    paths = {k: str(tmp_path / k) for k in ("in", "gold", "ck")}

    def add(df):
        df.coalesce(1).write.mode("append").parquet(paths["in"])
        source = spark.readStream.schema(df.schema).parquet(paths["in"])
        q = ingest.to_gold(source, paths["gold"], paths["ck"], KEYS, TIE, {"availableNow": True})
        q.awaitTermination()
        return sum(p.numInputRows for p in q.recentProgress)

    return add, lambda: ingest.winners(spark, paths["gold"])


def test_batches_equal_one(spark, streamed):
    add, winners = streamed
    rows = observations(spark)
    parts = [rows.where(F.abs(F.hash("fingerprint")) % 4 == k) for k in range(4)]
    read = [add(p) for p in parts]
    assert read == [p.count() for p in parts]  # a batch reads what is new, however much came before
    assert plain(winners()) == plain(resolve.pick(rows, KEYS, TIE))
    assert add(parts[0]) == read[0]  # a replay
    assert plain(winners()) == plain(resolve.pick(rows, KEYS, TIE))


def test_documents_to_winners(spark, tmp_path):
    """Repeated documents add nothing to silver, and gold reads each row of silver once."""
    t = dt.datetime(2026, 1, 1)
    as_of = lambda: F.lit("2026-04-23").cast("date")
    docs = [(c, 10 * c + k, f"ARR: ${c + k}.5M in {2022 + k} for us all\nTeam of {30 + k} people in 2024", 3, t) for c in range(5) for k in range(3)]
    docs += [(9, 99, None, 3, t), (9, 98, "", 3, None), (None, 97, "ARR: $9.5M in 2024 for us all", None, None)]
    silver, gold, gold_rows = str(tmp_path / "silver"), str(tmp_path / "gold"), 0
    for part in (docs[:7], docs[7:], docs[3:11]):
        spark.createDataFrame(part, DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(DOCS).parquet(str(tmp_path / "in"))
        run = ingest.start(source, silver, gold, str(tmp_path / "ck"), R.DEFAULT, as_of)
        run.awaitTermination()
        gold_rows += sum(p.numInputRows for p in run.gold.recentProgress)
    want = ingest.observe(spark.createDataFrame(docs, DOCS), R.DEFAULT, as_of())
    assert plain(spark.read.parquet(silver)) == plain(want) and gold_rows == want.count()
    assert plain(ingest.winners(spark, gold)) == plain(resolve.pick(want, KEYS, TIE))


def test_state_setting_is_put_back(spark):
    with ingest.state_on_disk(spark):
        assert spark.conf.get(ingest.PROVIDER) == ingest.ROCKS
    assert spark.conf.get(ingest.PROVIDER) != ingest.ROCKS
