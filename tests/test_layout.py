"""Layout extraction: the facts of whole slides, and odd ones."""

from datetime import date

from pyspark.sql import functions as F

from ledgerlens.operators import layout
from ledgerlens.sources.rules import ALL

SCHEMA = "doc long, seq int, text string, value string"
FRONT = "SERIES A April 2026 Raising $14M"


def facts(spark, *texts, rules=ALL):
    df = spark.createDataFrame([(1, k, t, "clash") for k, t in enumerate(texts)], SCHEMA)
    return layout.layout_observations(df, rules, F.lit(date(2026, 6, 1)), "doc", "seq", ["doc", "seq"]).collect()


def test_deck_date_is_of_the_first_three_chunks(spark):
    df = spark.createDataFrame([(1, 0, "no date"), (1, 1, "Feb 2024"), (1, 2, "May 2020"), (2, 0, "a"), (2, 1, "b"), (2, 2, "c"), (2, 3, "May 2020"), (3, 0, None)], "doc long, seq int, text string")
    assert [tuple(r) for r in layout.deck_dates(df, "doc", "seq").collect()] == [(1, date(2024, 2, 29))]


def test_cards(spark):
    got = {r.metric_code: r for r in facts(spark, FRONT, "TRACTION From 0 to $4.2M ARR in 19 months. $4.2M 62 138% $380K ARR Paying customers Net revenue retention 71% gross margin")}
    assert (got["arr"].value, got["arr"].as_of_date, got["arr"].scenario, got["arr"].method) == ("4200000", date(2026, 4, 30), "actual", "layout_pattern")
    assert (got["customer_count"].value, got["gross_margin"].value, got["arr"].period_label, got["arr"].currency) == ("62", "71", "deck_date", "USD")
    # Without the four cards the number before the label counts, with its evidence.
    got = {r.metric_code: r for r in facts(spark, FRONT, "KPI 12 offices, 410 paying customers")}
    assert (got["customer_count"].value, got["customer_count"].evidence) == ("410", "KPI 12 offices, 410 paying customers")
    assert facts(spark, FRONT, "TRACTION reach $5M ARR, 40 customers") == [] == facts(spark, "no date", "TRACTION $5M ARR, 40 customers")
    # The nearer amount wins, beyond ninety characters there is none.
    assert [r.value for r in facts(spark, FRONT, "Metrics $9M raised, now $2.5k ARR")] == ["2500"]
    assert facts(spark, FRONT, "Metrics $9M " + "x" * 90 + " ARR") == []
    assert [r.value for r in facts(spark, FRONT, "Metrics \U0001f680\U0001f680 $9M" + " " * 87 + "ARR")] == ["9000000"]


def test_goals_and_runway(spark):
    got = {(r.metric_code, r.value): r for r in facts(spark, FRONT, "Reach $22M ARR by end of 2027, path to $52m ARR by 2028. Grow team from 28 to 95. 24-month runway")}
    assert {k: (r.as_of_date.year, r.scenario, r.period_label, r.period_granularity) for k, r in got.items()} == {
        ("arr", "22000000"): (2027, "projection", "2027", "year"),
        ("arr", "52000000"): (2028, "projection", "2028", "year"),
        ("employee_count", "95"): (2027, "projection", "2027", "year"),
        ("runway_months", "24"): (2026, "actual", "deck_date", "point_in_time"),
    }
    assert [r.value for r in facts(spark, FRONT, "Runway: 18 months")] == ["18"]
    assert facts(spark, FRONT, "Grow team from 2 to 9") == []  # no year in reach
    assert facts(spark, FRONT, "400 months runway") == []  # out of range


def test_matrix(spark):
    text = "FINANCIALS Path to $52M ARR by 2028. 2024 2025 2026E 2027P 2028P ARR ($M) 0.5 2.4 7.8 22.0 52.0 Revenue ($M) 0.3 1.8 6.2 18.5 44.0 Gross margin 64% 71% 76% 79% 81% Burn ($M) (1.8) (4.2) (6.5) (3.1) 8.5 Customers 9 38 95 210 410 Headcount 12 28 52 95 155"
    got = {(r.metric_code, r.period_label): r for r in facts(spark, "x", text)}
    assert len(got) == 30 and {k[0]: r.value for k, r in got.items() if k[1] == "2025"} == {"arr": "2400000", "revenue": "1800000", "gross_margin": "71", "burn_rate": "4200000", "customer_count": "38", "employee_count": "28"}
    assert [got["arr", p].scenario for p in ("2025", "2026E", "2027P")] == ["actual", "estimate", "projection"]
    assert got["arr", "2026E"].evidence == "arr | 2026E | 7.8"
    assert facts(spark, "x", "FINANCIALS 2024 2025 ARR ($M) 1 2") == []  # two periods


def test_odd_chunks(spark):
    assert facts(spark, None, "", "Traction", "$$$ ARR KPI") == []
    assert facts(spark, FRONT, "24-month runway", rules=[r for r in ALL if r.code == "arr"]) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert layout.layout_observations(empty, ALL, F.lit(date(2026, 1, 1)), "doc", "seq", ["doc"]).count() == 0
    assert len(facts(spark, FRONT, "24-month runway, 24 months runway")) == 1


def test_rules_cover_the_twelve_metrics():
    assert len({r.code for r in ALL}) == 12
