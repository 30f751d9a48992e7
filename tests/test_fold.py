"""Folds against a plain loop: one entity over many partitions, illegal events, snapshots."""

import random

import pytest

from ledgerlens.operators import fold

LOG = "who long, at int, id int, event string, score double, legal string"


def plain(rows, machine):
    out, state, seen = [], {}, {}
    for who, at, i, event, score, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2])):
        before = state.get(who, machine.start)
        to = machine.rules.get((before, event))
        seen[who] = score if score is not None else seen.get(who)
        state[who] = to or before
        out.append((who, at, i, before, to or before, to is not None, seen[who]))
    return sorted(map(str, out))


@pytest.mark.parametrize("machine", [fold.RUNS, fold.GAPS, fold.moves(["a", "b", "c"], "a"), fold.moves(["a", "b"], "a", {"a": ["b"]})])
def test_equals_a_loop(spark, machine):
    r = random.Random(2)
    events = [*{e for _, e in machine.rules}, None, "nonsense"]
    who = lambda: 1 if r.random() < 0.5 else r.choice([None, *range(2, 30)])
    rows = [(who(), r.choice([None, *range(50)]), i, r.choice(sorted(events, key=str)), r.choice([None, None, 1.5, 2.0]), "clash") for i in range(3000)]
    got = fold.fold(spark.createDataFrame(rows, LOG), machine, "who", ["at", "id"], "event", "score", partitions=7)
    assert sorted(str((x.who, x.at, x.id, x.from_state, x.to_state, x.legal, x.noted)) for x in got.collect()) == plain(rows, machine)


def test_one_entity_only(spark):
    rows = [(5, k, k, "ab"[k % 2], float(k) if k == 3 else None, "") for k in range(500)]
    got = fold.fold(spark.createDataFrame(rows, LOG), fold.moves(["a", "b"], "a"), "who", ["at", "id"], "event", "score", partitions=9)
    assert sorted(str((x.who, x.at, x.id, x.from_state, x.to_state, x.legal, x.noted)) for x in got.collect()) == plain(rows, fold.moves(["a", "b"], "a"))
    end = fold.current(got, "who", ["at", "id"]).collect()
    assert [tuple(x) for x in end] == [(5, "b", 499, 1)]


def test_no_events(spark):
    assert fold.fold(spark.createDataFrame([], LOG), fold.RUNS, "who", ["at", "id"], "event").collect() == []


def test_a_task_has_its_share(spark):
    """The hot entity's events are in many partitions."""
    rows = spark.range(4000).selectExpr("1L as who", "cast(id as int) as at", "cast(id as int) as id", "'a' as event", "cast(null as double) as score", "'' as legal")
    out = fold.fold(rows, fold.moves(["a", "b"], "b"), "who", ["at", "id"], "event", partitions=8)
    from pyspark.sql import functions as F

    assert out.groupBy(F.spark_partition_id()).count().count() >= 3
