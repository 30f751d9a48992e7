"""The pipeline's stages on small tables, and each one's decisions."""

import os
import random

import corpus_pipeline as P
import pytest

from tests.llm.test_operators import WORDS, prose

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    r = random.Random(7)
    good = [(k, prose(k, 150), "en", f"s{k % 4}", 0) for k in range(160)]
    bad = [(200 + k, prose(k + 500, 150).upper().replace(" ", "!! "), "en", "s1", 0) for k in range(80)]
    copies = [(300 + k, good[k][1] + " " + r.choice(WORDS), "en", "s2", 0) for k in range(20)]
    items = [(k, prose(9000 + k, 40)) for k in range(6)]
    leaks = [(400 + k, prose(700 + k, 80) + " " + items[k][1] + " " + prose(800 + k, 80), "en", "s3", 0) for k in range(6)]
    docs = spark.createDataFrame(good + bad + copies + leaks, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, int(k < 200 or k >= 300)) for k, *_ in good + bad], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out, ids = docs, None
    for k, (_name, stage) in enumerate(P.STAGES):
        out = stage(spark, out, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"stage{k}"))
            out = spark.read.parquet(str(tmp_path / f"stage{k}"))
            ids = [x.doc_id for x in out.select("doc_id").collect()]
            if k == 0:
                assert not {i for i in ids if 200 <= i < 300} and len(ids) >= 180
            if k == 1:
                assert not {i for i in ids if 300 <= i < 320} and set(range(20)) <= set(ids) | set()
            if k == 2:
                assert not {i for i in ids if 400 <= i < 406} and len([i for i in ids if i < 160]) >= 155
    rows = out.collect()
    assert sorted(x.doc_id for x in rows) == sorted(ids)
    starts = sorted((x.start, x.n_tokens) for x in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_run(spark):
    assert P.run(spark, DIR).count() > 0


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (1, None), (2, ""), (None, "w1a w2a w3a w4a w5a w6a"), (None, "w1a w2a w3a w4a w5a w6a"), (3, prose(1, 50)), (3, prose(1, 50)), (4, prose(1, 50))]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.good(spark, docs, str(tmp_path)).count() == 8
    kept = P.distinct(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == [(0, 23), (1, 0), (2, 0), (3, len(prose(1, 50)))]
    assert P.clean(spark, kept, str(tmp_path)).count() == 4
    assert P.mixed(spark, kept, str(tmp_path)).count() == 4
    for stage in (P.distinct, P.clean, P.mixed, P.tokens):
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on rows with columns that clash with names the stages use."""
    import zlib
    from collections import Counter

    import numpy as np
    from ledgerlens.llm import mixing, quality, token_store
    from pyspark.sql import functions as F

    from tests.llm.test_operators import brute_groups

    r = random.Random(11)
    items = [(k, prose(9500 + k, 30)) for k in range(4)]
    texts = [prose(k, r.choice([3, 40, 90])) for k in range(60)] + ["", None, " "]
    texts += [texts[k] + " " + r.choice(WORDS) for k in range(12)] + [prose(600 + k, 50).upper().replace(" ", "!! ") for k in range(24)]
    texts += [prose(800 + k, 40) + " " + items[k][1] + " " + prose(820 + k, 40) for k in range(4)]
    rows = [(k, t, "en", None if k % 9 == 0 else f"s{k % 3}", 0, f"x{k}", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _k string, _n long")
    names = ["doc_id", "text", "lang", "source", "n_chars", "_k", "_n"]
    spark.createDataFrame([(k, int(not (t or "").isupper() and "!!" not in (t or ""))) for k, t in enumerate(texts)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = lambda f, d: f(spark, d, str(tmp_path))
    ids = lambda d: Counter(x.doc_id for x in d.collect())

    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    g, b, curve = quality.fit(docs, labels)
    out = stage(P.good, docs)
    assert out.columns == names
    assert ids(out) == Counter(k for k, t in enumerate(texts) if quality.probability(curve, quality.difference(t, g, b)) >= quality.THRESHOLD)

    out = stage(P.distinct, docs)
    assert out.columns == names and ids(out) == Counter(k for k, (_, c) in brute_groups([(k, t) for k, t, *_ in rows]).items() if k == c)
    assert all(x._k == f"x{x.doc_id}" and x._n == x.doc_id for x in out.collect())

    out = stage(P.clean, docs)
    held = lambda t: any(i in f" {t or ''} " for _, i in items)
    assert out.columns == names and ids(out) == Counter(k for k, t in enumerate(texts) if not held(t))

    out = stage(P.mixed, docs)
    size = {k: len((t or "").split()) for k, t in enumerate(texts)}
    target = {x.source: (x.source_size, x.target) for x in mixing.source_targets(spark.createDataFrame([(x[3], size[x[0]]) for x in rows], "source string, size long")).collect()}
    start = {x.source: x.u for x in spark.createDataFrame([(s,) for s in target], "source string").select("source", mixing.offset(F.col("source")).alias("u")).collect()}
    want = Counter()
    for s, (total, goal) in target.items():
        at = start[s]
        for k in sorted((x[0] for x in rows if x[3] == s), key=lambda k: (size[k], k)):
            step = min(3 << 32, round(goal / total * (1 << 32)))
            want[k] += (at + step >> 32) - (at >> 32)
            at += step
    assert out.columns == names and ids(out) == +want

    from ledgerlens.llm.bpe import tokenizer

    t, at = tokenizer(token_store.VOCABULARY), 0
    got = sorted(stage(P.tokens, docs).collect(), key=lambda x: x.start)
    for (k, text, *_), x in zip(rows, got, strict=True):
        own = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (k, at, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
        at += len(own)
