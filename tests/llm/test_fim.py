"""Fill-in-middle: equal to a brute-force version, exact round trip, odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import fim

DOCS = "doc_id long, text string, output string, form string, n string"
TEXTS = [None, "", " ", "a", "ab\r\n\n\tc", "é é 😀\x00 ＡＢ", "has <P> inside", "ends with <", "<S", "P><S><M", "x" * 10_000 + "ü" * 10_000, "<<<>>>" * 40]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_version(key, text):
    """The contract over Python's own code points."""
    h = sha(f"1:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    text = text or ""
    n = len(text)
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return key, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return key, n, form, a, b - a, sha(out), sha(text)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1000 * j + k, t) for j in range(30) for k, t in enumerate(TEXTS)] + [(None, "no id"), (7, "again"), (7, "again")]
    return spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], DOCS), rows


def test_equals_brute_force(spark, docs, tmp_path):
    df, rows = docs
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = fim.op11_fill_in_middle(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_version(k, t)) for k, t in rows)


def test_sql(spark, docs, tmp_path):
    import duckdb

    df, _ = docs
    df.where("doc_id is not null").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(fim.OP11_SQL)
    got = fim.op11_fill_in_middle(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_output_and_round_trip(spark, docs):
    df, rows = docs
    got = fim.fill_in_middle(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(k), t or "") for k, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("length", [0, 1, 6, 7, 8, 20, 21, 22, 200])
def test_runs(monkeypatch, length):
    text = ("añ😀\n\r" * 50)[:length]
    monkeypatch.setattr(fim, "RUN", 7)
    monkeypatch.setattr(fim, "STRETCH", 21)
    units = fim.Units(text)
    assert units.n == length and [units.offset(k) for k in range(length + 1)] == list(range(length + 1))


def test_nothing(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
