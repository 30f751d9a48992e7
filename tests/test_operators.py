import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import numbers as N
from ledgerlens.functions import temporal as M
from ledgerlens.functions import text as X
from ledgerlens.operators import entity, extract, ground, resolve, score, state
from ledgerlens.sources import rules as R
from ledgerlens.streaming import ingest

def as_of():
    return F.lit("2026-04-23").cast("date")


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("label", "scenario", "end"),
    [
        ("2024", "actual", "2024-12-31"),
        ("2026E", "estimate", "2026-12-31"),
        ("2028P", "projection", "2028-12-31"),
        ("2028", "projection", "2028-12-31"),
        ("2027F", "forecast", "2027-12-31"),
        ("Q4 2024", "actual", "2024-12-31"),
        ("Q2'24", "actual", "2024-06-30"),
        ("Q3 2027", "projection", "2027-09-30"),
        ("Dec 2024", "actual", "2024-12-31"),
        ("Feb 2024", "actual", "2024-02-29"),
        ("FY2024", "actual", "2024-12-31"),
        ("recent", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_labels(spark, label, scenario, end):
    p = one(spark, M.parse_label(F.col("l"), as_of()), l=label)
    assert p["scenario"] == scenario
    assert p["as_of_date"] == (end and dt.date.fromisoformat(end))


def test_granularity(spark):
    for label, want in [("2025", "year"), ("FY2024", "year"), ("Q3 2025", "month"), (None, "month")]:
        assert one(spark, M.granularity(F.col("l"), F.lit("month")), l=label) == want


def test_cells(spark):
    cases = [("-12%", "gross_margin", -12.0), ("(12%)", "gross_margin", -12.0), ("64%", "gross_margin", 64.0), ("2.4", "arr", 2.4e6), ("1.2.3", "arr", None), ("-", "arr", None), ("9", "customer_count", 9.0)]
    for cell, metric, want in cases:
        assert one(spark, N.table_cell(F.col("c"), F.col("m"), F.lit("mixed")), c=cell, m=metric) == want


def test_text(spark):
    assert one(spark, X.strip_suffixes(F.col("n")), n="Acme Labs, Inc.") in ("Acme", "Acme Labs,")
    assert one(spark, X.strip_suffixes(F.col("n")), n="Holdings Ltd") == ""
    assert one(spark, X.whole_word(F.lit("ai"), F.col("t")), t="We maintain it") is False
    assert one(spark, X.domains(F.col("t")), t="see www.acme.io and deck.pdf") == ["acme.io"]
    assert one(spark, X.normal_quote(F.col("t")), t="A  b , c") == "a b, c"


def financial(spark, rows):
    df = spark.createDataFrame([(1, c, float(x), g) for c, x, g in rows], "company_id long, code string, x double, granularity string")
    return score.financials(df).first()


def test_financials(spark):
    got = financial(spark, [("gross_margin", 71, None), ("runway_months", 24, None), ("revenue", 1.8e6, None), ("burn_rate", 4.2e6, None), ("funding_stage", 3, None)])
    assert got["financials"] == 3.16
    got = financial(spark, [("gross_margin", 64, None), ("funding_stage", 2, None)])
    assert (got["financials"], got["n_inputs"]) == (2.84, 2)
    for g, want in [("month", 3.0), ("year", 5.0), (None, 5.0)]:
        assert financial(spark, [("revenue", 1.8e6, None), ("burn_rate", 1.5e5, g)])["financials"] == want


def test_rules(spark):
    assert {r.code for r in R.DEFAULT} >= {"arr", "mrr", "employee_count"}
    for bad in [{"code": "X", "kind": "number", "patterns": ["(a)"]}, {"code": "x", "kind": "number", "patterns": ["("]}, {"code": "x", "kind": "money", "patterns": ["(a)"]}, {"code": "x", "kind": "enum"}, {"code": "x", "kind": "other"}]:
        with pytest.raises(ValueError):
            R.load([bad])


def found(spark, text, codes=None):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return {r.metric_code: r for r in extract.extract(df, R.DEFAULT, as_of(), ["id"], codes).collect()}


def test_extract(spark):
    got = found(spark, "We hit $1.2M MRR in 2024.")["mrr"]
    assert (got.value, got.scenario, str(got.as_of_date), got.period_label) == ("1200000", "actual", "2024-12-31", "2024")
    assert got.evidence in "We hit $1.2M MRR in 2024."
    assert found(spark, "MRR: $185k as of Q3 2024")["mrr"].value == "185000"
    assert "mrr" not in found(spark, "MRR: $185k")  # no period near
    assert "mrr" not in found(spark, "MRR: $999999999999 in 2024")  # out of range
    assert found(spark, "founded in 2019")["founding_year"].value == "2019"
    assert found(spark, "a pre-seed, later a seed round")["funding_stage"].value == "1"
    assert found(spark, "The founder had an exit")["prior_successful_exit"].value == "true"
    assert "prior_successful_exit" not in found(spark, "emergency exit")
    assert found(spark, "") == {} and found(spark, None) == {}
    assert set(found(spark, "Team of 35 in 2024, founded in 2019", ["founding_year"])) == {"founding_year"}


def test_table(spark):
    grid = [["Metric", "2024", "2025", "2026E"], ["ARR ($M)", "0.5", "2.4", "7.8"], ["Gross Margin", "64%", "71%"]]
    df = spark.createDataFrame([(1, grid), (2, [["Name", "Role"], ["A", "B"]])], "id long, grid array<array<string>>")
    got = {(r.metric_code, r.period_label): (r.value, r.scenario) for r in extract.table_observations(df, ["id"], as_of()).collect()}
    assert got["gross_margin", "2025"] == (71.0, "actual")
    assert len(got) == 5 and got["arr", "2026E"][1] == "estimate"


OBS = "id long, company_id long, metric_id long, scenario string, as_of_date date, source_priority int, captured_at timestamp, confidence double, value int"


def test_resolver(spark):
    d, t = dt.date, dt.datetime(2026, 5, 1)
    rows = [(1, 1, 1, "projection", d(2027, 12, 31), 1, t, 0.9, 1), (2, 1, 1, "actual", d(2025, 12, 31), 3, t, 0.9, 2), (3, 1, 1, "actual", d(2026, 4, 30), 3, t, 0.9, 3), (4, 1, 1, "actual", None, 1, t, 0.9, 4), (5, 1, 1, "actual", d(2026, 4, 30), 4, t, 0.95, 5)]
    assert resolve.pick(spark.createDataFrame(rows, OBS), ["company_id", "metric_id"], ["id"]).first()["value"] == 3


def test_state(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (None, "e")], "k int, v string")
    add = state.insert_ignore(old, new, ["k"], [F.asc("v")])
    assert {(r.k, r.v) for r in add.collect()} == {(2, "c"), (None, "e")}
    assert state.insert_ignore(old.unionByName(add), new, ["k"], [F.asc("v")]).count() == 0
    got = {r.k: r.v for r in state.upsert(old, new, ["k"], {"v": "last"}, [F.asc("v")]).collect()}
    assert got == {1: "b", 2: "c", None: "e"}
    h = "k int, v int, at int, override boolean, is_latest boolean"
    hist = spark.createDataFrame([(1, 1, 1, True, True), (2, 1, 1, False, True)], h)
    more = spark.createDataFrame([(1, 2, 2, False, True), (2, 2, 2, False, True)], h)
    now = state.scd_latest(hist, more, ["k"], "at", ["v"]).where("is_latest")
    assert {(r.k, r.v) for r in now.collect()} == {(1, 1), (2, 2)}


def test_ground_and_entities(spark):
    assert one(spark, ground.name_confidence(F.col("n"), F.col("t")), n="Acme AI", t="about acme") == 0.7
    assert one(spark, ground.name_confidence(F.col("n"), F.col("t")), n="Acme AI", t="ACME ai") == 1.0
    assert one(spark, ground.quote_check(F.col("q"), F.col("t")), q="a quote of some length ,", t="x a  quote of some length, y") == "verified"
    assert one(spark, ground.quote_check(F.col("q"), F.col("t")), q="short", t="short") == "too_short"
    assert entity.token_set_ratio("acme robotics", "robotics acme inc") == 100.0
    assert entity.token_set_ratio("", "x") == 0.0
    assert 0 < entity.token_set_ratio("acme", "acne") < 100
    docs = spark.createDataFrame([(1, "acme_deck.pdf", "Acme at acme.io"), (2, "x.pdf", "nothing")], "doc_id long, file string, head string")
    firms = spark.createDataFrame([(7, "Acme Inc", "https://acme.io"), (8, "Other", None)], "company_id long, name string, website string")
    got = entity.resolve(docs, firms).collect()
    assert [(r.doc_id, r.company_id) for r in got] == [(1, 7)] and got[0].score >= 0.85


def test_streaming_equals_batch(spark, tmp_path):
    schema = "company_id long, doc_id long, text string, source_priority int, captured_at timestamp"
    t = dt.datetime(2026, 1, 1)
    rows = [(1, 1, "ARR: $2.4M in 2024 for us\nTeam of 35 people in 2024", 3, t), (2, 2, "ARR: $1M in 2023 for us all", 3, t), (1, 3, "ARR: $3M in 2025 for us all", 3, t)]
    for k, part in enumerate([rows[:2], rows[2:], rows[:1]]):  # the last replays a document
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest.start(source, str(tmp_path / "silver"), str(tmp_path / "gold"), str(tmp_path / "ck"), R.DEFAULT, as_of).awaitTermination()
    got = {(r.company_id, r.metric_code): r.value for r in ingest.winners(spark, str(tmp_path / "gold")).collect()}
    batch = resolve.pick(ingest.observe(spark.createDataFrame(rows, schema), R.DEFAULT, as_of()), ["company_id", "metric_code"], ["doc_id", "ordinal"])
    assert got == {(r.company_id, r.metric_code): r.value for r in batch.collect()} == {(1, "arr"): "3000000", (2, "arr"): "1000000", (1, "employee_count"): "35"}
    assert spark.read.parquet(str(tmp_path / "silver")).count() == 4


def test_sinks(spark, tmp_path):
    from ledgerlens.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    p = str(tmp_path / "t")
    sinks.append(df, p)
    sinks.append(df, p)
    assert spark.read.parquet(p).count() == 4
    sinks.rewrite(df, p)
    assert spark.read.parquet(p).count() == 2
    sinks.reset(df, p)
    assert spark.read.parquet(p).columns == ["k", "v"] and spark.read.parquet(p).count() == 0


def test_providers():
    from ledgerlens.sources import providers

    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise TimeoutError("slow")
        return "ok"

    assert providers.call(flaky, "p") == ("ok", None) and len(calls) == 3
    assert providers.call(lambda p: 1 / 0, "p")[1].startswith("ZeroDivisionError")
    b = providers.Budget(5)
    assert (b.take("d1", 3), b.take("d1", 3), b.take("d2", 9)) == (3, 2, 5)
