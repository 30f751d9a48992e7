"""The conversation trie against a brute-force version and SQL, with heavy levels and without."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from ledgerlens.llm import trie

ROWS = "conv_id long, turn long, role string, text string, depth string, n1 int"


def conversations(seed=1):
    r = random.Random(seed)
    rows = []
    for c in [*range(-5, 330, 2), 400, 777, 1001, 10**12]:
        if c == 100:  # a group without its first conversation
            continue
        for k in range(r.choice([1, 1, 2, 3, 5, 9, 30]) if c != 300 else 12):
            rows.append((c, None if k == 1 and r.random() < 0.3 else k, r.choice(["user", "assistant", None]), r.choice(["", None, "é😀", "hello", "x" * 50])))
    for c in range(500, 560):  # copies
        rows += [(c, k, "user", "same") for k in range(10)]
    rows += [(300, 3, "user", "tie"), (300, 3, "user", "tie"), (300, 3, None, "a tie"), (None, 1, "user", "nobody's")]
    r.shuffle(rows)
    return rows


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(np.fix(c / 100)) * 100  # c % 100 has the sign of c, as in SQL
        whole[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    children, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        str((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(node)).encode()).hexdigest()))
        for node, cs in members.items()
    )


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 3) for r in rows], ROWS).repartition(3)


@pytest.mark.parametrize("heavy", [5, 500, 20_000])
def test_equals_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(trie, "HEAVY", heavy)
    monkeypatch.setattr(trie, "AT_ONCE", 40)
    monkeypatch.setattr(trie, "PIECE", 30)
    rows = conversations(heavy)
    assert sorted(str(tuple(r)) for r in trie.prefix_trie(frame(spark, rows)).collect()) == brute(rows)


def test_sql(spark, tmp_path):
    import duckdb

    frame(spark, conversations()).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(trie.OP13_SQL)
    got = trie.op13_prefix_trie(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_nothing(spark):
    nothing = spark.createDataFrame([], ROWS)
    assert trie.prefix_trie(nothing).collect() == []
    assert trie.prefix_trie(frame(spark, [(None, 1, "a", "b")])).collect() == []


def test_a_turnless_conversation(spark):
    """A conversation that loses its own turns and has no first conversation to take from."""
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 3)
    got = trie.prefix_trie(frame(spark, [(c, 0, "user", "a")])).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_louds():
    """Two shards: a-b, a-c and x."""
    t = trie.Louds(np.array([0, 0, 1]), np.array([0, 2, 4, 5]), np.array([1, 2, 1, 3, 9]), np.zeros(5, int), np.ones(5, int))
    assert t.bits.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 0, 0, 0]
    assert t.parents.tolist() == [-1, 0, 0, 1, 1] and t.children.tolist() == [2, 2, 0, 0, 0]
    assert t.end.tolist() == [3, 4, 2] and t.rolled(np.array([0, 0, 5, 1, 1])).tolist() == [0, 2, 5, 1, 1]
