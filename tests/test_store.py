"""Versions of a bucketed store, and numbering and backfill in two steps."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import backfill as B
from ledgerlens.sources.store import Store

ROWS = "k long, a string, b int"
RULES = {"a": "last", "b": "coalesce"}


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), ROWS, ["k"], buckets=8)
    s.create()
    assert s.read().collect() == [] and s.version() == 0
    frame = lambda x: spark.createDataFrame(x, ROWS)
    one = s.upsert(frame([(k, "old", k) for k in range(100)] + [(None, "null key", 0), (3, "first of two", 9)]), RULES, [F.asc("a")])
    two = s.upsert(frame([(5, "new", None), (1000, "added", 1)]), RULES, [F.asc("a")])
    assert (one, two) == (1, 2)
    assert s.read(1).count() == 101 and s.read(1).where("k = 3").first().a == "first of two" and s.read(1).where("k = 5").first().a == "old"
    assert s.read().count() == 102 and tuple(s.read().where("k = 5").first()) == (5, "new", 5)
    # Only touched buckets are written, and the others' files are those of before.
    assert len([d for d in os.listdir(tmp_path / "s/data/version=2") if d.startswith("bucket=")]) <= 2
    assert sum(v == 1 for v in s.places().values()) >= 6
    assert s.upsert(frame([]), RULES, [F.asc("a")]) == 2
    with pytest.raises(ValueError):
        s.read(7)


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), ROWS, ["k"], buckets=4)
    s.create()
    s.upsert(spark.createDataFrame([(k, "old", k) for k in range(20)], ROWS), RULES, [F.asc("a")])
    before = rows(s.read())
    bad = spark.createDataFrame([(k, "new", k) for k in range(20)], ROWS).withColumn("a", F.when(F.col("k") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("a")))
    with pytest.raises(Exception, match="lost"):
        s.upsert(bad, RULES, [F.asc("b")])
    assert s.version() == 1 and rows(s.read()) == before
    s.upsert(spark.createDataFrame([(1, "new", 1)], ROWS), RULES, [F.asc("a")])
    assert s.version() == 2 and s.read().where("a = 'new'").count() == 1 and s.read().count() == 20


def test_numbers(spark):
    df = spark.range(500).selectExpr("id % 50 as a", "id as b")
    got = B.numbered(df, [F.desc("a"), F.asc("b")], "n", after=10, partitions=6).collect()
    want = sorted(((r.a, r.b) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(11, 511))
    assert B.numbered(df.limit(0), [F.asc("a")], "n").collect() == []


VALUES = "value_id long, company_id long, metric_id long, value string, evidence string, url string, captured_by string, captured_at date, confidence double, override boolean, is_latest boolean, winning_observation_id long"


def test_backfill_goes_on(spark):
    """After a part, all values: numbers go on, known observations and runs stay single."""
    data = [(k, k % 3 or None, k % 2, str(k % 5), None, None, ["Alpha_Scout", "x", None][k % 3], None, None, k % 7 == 0, k % 2 == 0, None) for k in range(40)]
    part, every = (spark.createDataFrame(d, VALUES) for d in (data[:15], data))
    a = B.backfill(part)
    b = B.backfill(every, a.runs, a.observations)
    prints = {r.fingerprint for r in a.observations.collect()} | {r.fingerprint for r in b.observations.collect()}
    assert a.observations.count() + b.observations.count() == len(prints) == B.backfill(every).observations.count()
    runs = [(r.extractor, r.company_id) for r in a.runs.unionByName(b.runs).collect()]
    assert len(runs) == len(set(runs)) and sorted(r.run_id for r in a.runs.unionByName(b.runs).collect()) == list(range(1, len(runs) + 1))
    assert sorted(r.observation_id for r in a.observations.unionByName(b.observations).collect()) == list(range(1, len(prints) + 1))
    known = {r.observation_id for r in b.observations.collect()}
    assert {r.observation_id for r in b.links.collect()} <= known
    again = B.backfill(every, a.runs.unionByName(b.runs), a.observations.unionByName(b.observations))
    assert again.runs.count() == again.observations.count() == again.links.count() == 0
    assert {r.confidence for r in a.observations.collect()} == {1.0}
