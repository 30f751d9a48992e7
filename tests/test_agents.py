"""Gap filling, market refresh, URL checks and grounding of whole records, case by case."""

import datetime
import json

from pyspark.sql import functions as F

from ledgerlens.operators import agents as A
from ledgerlens.operators import ground as G

GAP = "company_id long, metric_id long, company string, industry string, website string, metric string, description string, value_type string, obtain_method string, answer string, status string"
RESULT = "query string, rank int, title string, url string, content string, block string"
LONG = "Acme now serves 1,200 customers, it says."


def gap(k, method, company="Acme", value_type="number"):
    return (k, 1, company, None, None, "customers", None, value_type, method, "clash", "clash")


def model(answers):
    def call(prompt):
        for key, answer in answers.items():
            if key in prompt:
                if answer is None:
                    raise RuntimeError("down")
                return answer
        return "Hi there, how many? " if "founder" in prompt else "nothing to read"

    return call


def said(**kw):
    return json.dumps({"value": "1200", "source_url": "http://a", "evidence_quote": LONG, "confidence": 0.9} | kw)


def test_gaps_by_method_and_answer(spark):
    names = ["good", "unsure", "novalue", "zero", "false", "noquote", "broken", "down", "list", "short", "gone", "edge", "nan"]
    gaps = [gap(k, "Tavily", n) for k, n in enumerate(names)] + [gap(50, "Ask Founders"), gap(51, "manual"), gap(52, None), gap(53, "LinkedIn", "unseen"), gap(54, "LinkedIn", None)]
    results = [(f"{n} customers ", k, n, "http://a", LONG, "clash") for n in names for k in range(8)] + [(None, 1, "t", "u", "c", "x")]
    answers = {
        "good": "```json\n" + said(value=1200) + "\n```", "unsure": said(confidence=0.39), "novalue": said(value=None), "zero": said(value=0), "false": said(value=False), "noquote": said(evidence_quote=""),
        "broken": "{{{", "down": None, "list": f"[{said()}]", "short": said(evidence_quote="1,200 customers"), "gone": said(source_url="http://gone"), "edge": said(confidence=0.4, value="0"), "nan": said(confidence="high"),
    }
    answers = {f"Company: {k}\n": v for k, v in answers.items()}
    pages = spark.createDataFrame([("http://a", "other"), ("http://a", "ACME  now serves\n1,200 customers , it says."), ("http://b", None), (None, "x")], "url string, text string")
    got = A.fill_gaps(spark.createDataFrame(gaps, GAP), spark.createDataFrame(results, RESULT), pages, model(answers))
    rows = {r.company_id: r for r in got.collect()}
    assert len(rows) == len(gaps) == got.count()
    status = [rows[k].status for k in range(len(names))]
    assert status == ["filled", "no_data", "no_data", "no_data", "no_data", "no_data", "no_data", "error", "filled", "filled", "filled", "filled", "no_data"]
    assert rows[0].value == "1200" and rows[0].url_verified and rows[0].verify_reason == "verified"
    assert (rows[9].verify_reason, rows[10].verify_reason, rows[11].value) == ("quote_too_short", "fetch_error", "0")
    assert "RuntimeError" in rows[7].error and rows[1].value is None
    assert (rows[50].status, rows[50].draft) == ("drafted", "Hi there, how many?")
    assert [rows[k].status for k in (51, 52, 53, 54)] == ["skipped", "skipped", "no_data", "no_data"]
    log = {r.company_id: r for r in A.gap_actions(got).collect()}
    assert set(log) == set(rows) - {7, 51, 52}
    assert log[50].status == "pending" and log[1].status == "failed" and log[0].output_draft.endswith("Verified: true (verified)")
    new = A.new_values(got, "filled", "gap_agent", F.lit("2024-01-01").cast("date"))
    assert sorted(r.company_id for r in new.collect()) == [0, 8, 9, 10, 11]


def test_prompts_hold_five_results_of_800_characters(spark):
    rows = [("q", k, f"t{k}", f"u{k}", "é" * 900, "") for k in (5, 3, 3, 1, 2, 4, 6)]
    block = A.result_blocks(spark.createDataFrame(rows, RESULT)).first()["block"]
    assert block.split("\n\n")[0] == "[1] t1\nURL: u1\nCONTENT: " + "é" * 800
    assert [x.split("\n")[0] for x in block.split("\n\n")] == ["[1] t1", "[2] t2", "[3] t3", "[4] t3", "[5] t4"]
    assert A.result_blocks(spark.createDataFrame([], RESULT)).count() == 0


HISTORY = "company_id long, metric_id long, metric string, value_type string, value string, raw_evidence string, evidence_url string, url_verified boolean, confidence double, captured_by string, captured_at date, override boolean, is_latest boolean"


def test_market_asks_once_a_topic_and_keeps_locked_rows(spark, tmp_path):
    old, new, at = datetime.date(2023, 1, 1), datetime.date(2024, 5, 1), datetime.date(2024, 6, 1)
    row = lambda c, when, locked, latest=True: (c, 1, "CAGR", "number", "5", "e", "u", True, 0.5, "seed", when, locked, latest)
    history = spark.createDataFrame([*[row(c, old, False) for c in range(20)], row(30, old, True), row(31, new, False), row(32, None, False), row(33, old, False, False), row(34, old, None), row(35, datetime.date(2023, 12, 4), False), row(36, datetime.date(2023, 12, 3), False)], HISTORY)
    companies = spark.createDataFrame([*[(c, "energy") for c in (*range(18), 30, 31, 32, 33, 34, 35, 36)], (18, None)], "company_id long, industry string")
    results = spark.createDataFrame([("energy industry market size growth CAGR 2025 2026", 1, "t", "http://a", LONG, "")], RESULT)
    pages = spark.createDataFrame([], "url string, text string")
    calls = str(tmp_path / "calls")

    def provider(prompt):
        with open(calls, "a") as f:
            f.write("x")
        return said(value=7.5)

    got = A.refresh_market(history, companies, results, pages, provider, F.lit(at))
    assert open(calls).read() == "x"
    status = {r.company_id: r.status for r in got.collect()}
    assert open(calls).read() == "x"
    assert status == {**dict.fromkeys([*range(18), 34, 36], "updated"), 18: "no_data", 19: "no_data"}
    added = A.new_values(got, "updated", "market_agent", F.lit(at))
    after = A.with_values(history, added)
    latest = {r.company_id: r for r in after.where("is_latest").collect()}
    assert after.count() == history.count() + 20 and latest[0].value == "7.5" and not latest[0].url_verified
    assert latest[30].captured_by == latest[31].captured_by == "seed"
    assert A.refresh_market(history.where("false"), companies, results, pages, provider, F.lit(at)).count() == 0


def test_urls_and_marks(spark):
    pages = spark.createDataFrame([("u", "A long enough quote , here"), ("v", None)], "url string, text string")
    rows = spark.createDataFrame([(1, "u", "a long  enough QUOTE, here"), (2, "u", "not a quote of that page"), (3, "v", "a long enough quote, here"), (4, None, "a long enough quote, here"), (5, "u", ""), (6, "u", "quote"), (1, "u", None)], "id int, source_url string, evidence_quote string")
    checked = A.verify_urls(rows, pages)
    assert sorted((r.id, r.verify_reason) for r in checked.collect()) == [(1, "missing_input"), (1, "verified"), (2, "quote_not_in_page"), (3, "fetch_error"), (4, "missing_input"), (5, "missing_input"), (6, "quote_too_short")]
    kept = spark.createDataFrame([(1, False, None), (2, True, None), (9, True, None)], "id int, url_verified boolean, url_verified_at date")
    day = datetime.date(2024, 1, 1)
    assert sorted(tuple(r) for r in A.mark_urls(kept, checked, ["id"], F.lit(day)).collect()) == [(1, True, day), (2, False, day), (9, True, None)]


RECORD = "id int, name string, website string, description string, founders array<string>, sector string, text string, field string"


def test_ground_record(spark):
    text = "Acme (acme.io) sells industrial marble fountains. Bo Berg founded it."
    rows = [
        (1, "Acme", "https://acme.io", "industrial marble fountains", ["Ann Absent", None, "Bo Berg"], None, text, "x"),
        (2, "Zeta", "linkedin.com/zeta", "", ["Ann Absent", "Cy Cole"], "tea", text, "x"),
        (3, "Acme", None, None, [], None, None, "x"),
        (4, None, None, None, None, None, text, "x"),
        (5, "", "", None, ["  "], None, text, "x"),
    ]
    df = spark.createDataFrame(rows, RECORD)
    got = G.ground_fields(df, ["id"])
    found = {(r.id, r.field): (r.confidence, r.grounded, r.best) for r in got.collect()}
    assert found == {
        (1, "name"): (1.0, True, None), (1, "website"): (0.9, True, None), (1, "description"): (1.0, True, None), (1, "founders"): (1.0, True, "Bo Berg"),
        (2, "name"): (0.0, False, None), (2, "website"): (0.0, False, None), (2, "description"): (0.0, False, None), (2, "founders"): (0.0, False, "Ann Absent"), (2, "sector"): (0.0, False, None),
        (3, "name"): (0.0, False, None), (5, "name"): (0.0, False, None), (5, "website"): (0.0, False, None),
    }
    scores = {r.id: r.score for r in G.record_score(got, ["id"]).collect()}
    assert abs(scores[1] - 6.8 / 7) < 1e-12 and scores[2] == 0.0 and 4 not in scores
    assert G.ground_fields(df.where("false"), ["id"]).count() == 0
