"""Sums beyond 2^63, vectors whose squares under- or overflow, texts of very many chunks."""

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import embed_dedup, mixing
from ledgerlens.llm.common import prefix_sums


def test_prefix_sums_modulo(spark):
    r = random.Random(1)
    rows = [(r.choice("aab") if k % 9 else None, k, r.choice([3 << 32, (1 << 62) + 5, (1 << 63) - 1, r.randrange(1 << 40)])) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(5)
    got = {x.k: x.s for x in prefix_sums(df, ["g"], ["k"], "v", "s", bits=32).collect()}
    sums, want = {}, {}
    for g, k, v in rows:
        want[k] = sums.get(g, 0) % (1 << 32)
        sums[g] = sums.get(g, 0) + v
    assert max(sums.values()) > 1 << 64 and got == want


def test_mix_takes_copies_beyond_2_31(spark, monkeypatch):
    """The sums of a source's expected copies pass 2^63 units; every document still gets its own."""
    most, n = 1 << 20, 3000  # copies of a document at most, documents
    docs = spark.createDataFrame([*[(k, 10, "small") for k in range(n)], (-1, 15 * n * most + 7, "large")], "doc_id long, text long, source string")
    monkeypatch.setattr(mixing, "word_count", lambda c: c)  # sizes are given in place of texts
    rows = mixing.mix(docs, weights=(1, 1), most=most).collect()
    small = [x for x in rows if x.doc_id >= 0]
    copies = [x.copies for x in small]
    assert len(small) == n and sum(copies) > 1 << 31 and max(copies) - min(copies) <= 1
    assert abs(sum(x.taken for x in small) - small[0].target) <= 20


def test_vectors_of_extreme_length_link(spark):
    rows = [[1e-170, 0.0, 2e-170], [1e-170, 0.0, 2e-170], [1e160, -3e160, 0.0], [1.1e160, -3e160, 0.0], [5e-324, 0.0, 0.0], [1.0, 0.0, 0.0], [1.7e308, 1.7e308, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {g.vec_id: (g.n_links, g.component_id) for g in embed_dedup.near_vectors(df).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 2), 3: (1, 2), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (0, 9), 10: (0, 10)}


def test_names_of_many_chunks_joined_in_one_pass(spark):
    names = [np.random.default_rng(k).bytes(16) for k in range(5000)]
    df = spark.createDataFrame([(1, names), (2, names[:1])], "k int, names array<binary>")
    got = {r.k: bytes(r.j) for r in df.select("k", F.unhex(F.array_join(F.transform("names", lambda x: F.hex(x)), "")).alias("j")).collect()}
    assert got == {1: b"".join(names), 2: names[0]}
