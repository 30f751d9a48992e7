"""Observations from the layout of slides: flattened matrices, KPI cards,
milestones, runway. Everything found on a chunk stays in arrays on its row, so
there is no shuffle but for the date of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import temporal as M
from ..sources.rules import Rule
from .state import broadcast_if_small, top_k

# Confidence, label of values dated by their deck, distances in characters, chunks with the date.
CONFIDENCE, DECK, NEAR, BEFORE, AROUND, HEADER, FRONT = 0.86, "deck_date", 90, 50, 40, 120, 3
# Patterns of the layouts.
PERIODS = r"\b(20[0-9]{2}[EPF]?)\b"
ANCHOR = r"(?i)\bARR\s*\(\$M\)|\bRevenue\s*\(\$M\)"
MATRIX_GATE = r"(?i)\bfinancials?\b|\bARR\b.*\bRevenue\b"
MATRIX_ROWS = {
    "arr": r"(?i)ARR\s*\(\$M\)\s+([0-9.\s]+)",
    "revenue": r"(?i)Revenue\s*\(\$M\)\s+([0-9.\s]+)",
    "gross_margin": r"(?i)Gross\s+margin\s+((?:-?[0-9]{1,3}%\s*)+)",
    "burn_rate": r"(?i)Burn\s*\(\$M\)\s+((?:\(?-?[0-9.]+\)?\s*)+)",
    "customer_count": r"(?i)Customers\s+((?:[0-9]+\s*)+)",
    "employee_count": r"(?i)Headcount\s+((?:[0-9]+\s*)+)",
}
MATRIX_CELL = r"(\(?-?[0-9]+(?:\.[0-9]+)?%?\)?)"
CARD_GATE, CARD_STOP = r"(?i)\b(?:traction|kpi|metrics?)\b", r"(?i)\b(?:reach|hit|get\s+to|grow\s+team)\b"
ARR = r"(?i)\bARR\b"
MONEY = r"\$\s*([0-9.]+)\s*(k|m|b|million|billion)?"
KPI_PAIR = r"(?i)\$\s*[0-9.]+\s*(?:k|m|b|million|billion)?\s+([0-9]{1,6})\s+[0-9]{1,3}(?:\.[0-9]+)?%\s+\$\s*[0-9.]+\s*(?:k|m|b|million|billion)?\s+ARR\s+Paying\s+customers\b"
CUSTOMERS = r"(?i)paying\s+customers|customers"
PERCENT = r"(?i)\b(-?[0-9]{1,3}(?:\.[0-9]+)?)\s*%\s+(?:gross\s+margin|gm)\b"
MILESTONE = r"(?i)\b(?:reach|hit|get\s+to|path\s+to)\s+\$\s*([0-9.]+)\s*(k|m|b|million|billion)?\s+ARR\s+by\s+(?:end\s+of\s+)?(20[0-9]{2})\b"
TEAM = r"(?i)\bgrow\s+team\s+from\s+[0-9]{1,6}\s+to\s+([0-9]{1,6})\b"
RUNWAY = r"(?i)\b([0-9]{1,3})[-\s]?months?\s+runway\b|\brunway[:\s]+([0-9]{1,3})\s+months?\b"
LAST_MONEY = rf"(?is)^(.*){MONEY}"
LAST_COUNT = r"(?s)^(.*)\b([0-9]{1,6})\b"

_FACT = "array<struct<code: string, x: double, evidence: string, label: string, scenario: string, date: date>>"


def _fact(code: str | Column, x: Column, evidence: Column, label: Column, scenario: Column, date: Column) -> Column:
    parts = {"code": F.lit(code), "x": x, "evidence": evidence, "label": label, "scenario": scenario, "date": date}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def _one(when: Column, fact: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.array(fact)).otherwise(F.array().cast(_FACT))


def start(text: Column, pattern: str) -> Column:
    """0-based place of the first match, in characters; null if there is none."""
    return F.when(text.rlike(pattern), F.length(F.get(F.split(text, pattern, 2), F.lit(0))))


def between(text: Column, a: Column, b: Column) -> Column:
    """text from a to b (0-based) and AROUND characters on either side."""
    low = F.greatest(F.lit(0), a - AROUND)
    return F.substring(text, low + 1, F.greatest(F.lit(0), F.least(F.length(text), b + AROUND) - low))


def _matches(text: Column, pattern: str) -> Column:
    """Array of (gap, m): each match with the text since the match before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))


def deck_dates(chunks: DataFrame, doc: str, order: str) -> DataFrame:
    """(doc, deck_date): month end of the first 'Month YYYY' in the first three chunks."""
    front = top_k(chunks.select(doc, order, M.month_end(F.col("text")).alias("_d")), [doc], [F.asc(order), F.asc_nulls_last("_d")], FRONT)
    return front.where("_d is not null").groupBy(doc).agg(F.min_by("_d", F.struct(order, "_d")).alias("deck_date"))


def _window(text: Column, at: Column, size: int) -> Column:
    """The size characters before at."""
    return F.when(at.isNotNull(), F.substring(text, F.greatest(F.lit(0), at - size) + 1, F.least(at, F.lit(size))))


def with_places(df: DataFrame, as_of: Column) -> DataFrame:
    """df with what several facts of a chunk need, each a column of its own, so
    that it is looked for once: gates, labels' places, the matrix's periods."""
    text, date = F.col("text"), F.col("deck_date")
    df = df.withColumns({"_grid": text.rlike(MATRIX_GATE), "_cards": text.rlike(CARD_GATE) & ~text.rlike(CARD_STOP) & date.isNotNull()})
    on = lambda gate, x: F.when(F.col(gate), x)
    df = df.withColumns({"_anchor": on("_grid", start(text, ANCHOR)), "_arr": on("_cards", start(text, ARR)), "_cust": on("_cards", start(text, CUSTOMERS)), "_pct": on("_cards", start(text, PERCENT))})
    df = df.withColumns({
        "_head": F.regexp_extract_all(_window(text, F.col("_anchor"), HEADER), F.lit(PERIODS), F.lit(1)),
        # The amounts that begin next before and after the label.
        "_left": _window(text, F.col("_arr"), NEAR),
        "_right": F.substring(text, F.col("_arr") + 1, F.length(text)),
        "_before": _window(text, F.col("_cust"), BEFORE),
    })
    back = F.when(F.col("_left").rlike(LAST_MONEY), F.length("_left") - F.length(F.regexp_extract("_left", LAST_MONEY, 1)))
    df = df.withColumns({"_periods": on("_grid", F.when(F.size("_head") >= 3, F.col("_head")).otherwise(F.regexp_extract_all(text, F.lit(PERIODS), F.lit(1)))), "_back": back, "_ahead": start(F.col("_right"), "(?i)" + MONEY)})
    last = F.slice("_periods", F.greatest(F.size("_periods") - 4, F.lit(1)), F.lit(5))
    dated = F.transform(last, lambda x: F.struct(x.alias("label"), M.parse_label(x, as_of).alias("period")))
    is_left = F.col("_back").isNotNull() & (F.col("_ahead").isNull() | (F.col("_back") <= F.col("_ahead")))
    return df.withColumns({"_p": F.when(F.size("_periods") >= 3, dated), "_is_left": is_left})


def matrix(code: str) -> Column:
    """Facts of a metric's row of a flattened table: the last five periods zipped with its cells."""
    cells = F.regexp_extract_all(F.regexp_extract("text", MATRIX_ROWS[code], 1), F.lit(MATRIX_CELL), F.lit(1))
    pairs = F.filter(F.arrays_zip(F.col("_p").alias("p"), cells.alias("cell")), lambda z: z["p"].isNotNull() & z["cell"].isNotNull())
    fact = lambda z: _fact(code, N.matrix_value(F.lit(code), z["cell"]), F.concat_ws(" | ", F.lit(code), z["p"]["label"], z["cell"]), z["p"]["label"], z["p"]["period"]["scenario"], z["p"]["period"]["as_of_date"])
    return F.when(F.col("_p").isNotNull(), F.transform(pairs, fact))


def _deck_fact(code: str, x: Column, evidence: Column) -> Column:
    return _fact(code, x, evidence, F.lit(DECK), F.lit("actual"), F.col("deck_date"))


def _end(at: str, pattern: str) -> Column:
    return F.col(at) + F.length(F.regexp_extract("text", pattern, 0))


def money_card() -> Column:
    """The amount that begins nearest to "ARR", within NEAR; ties to the first."""
    left, right = ((F.col("_left"), LAST_MONEY, 2), (F.col("_right"), "(?i)" + MONEY, 1))
    pick = lambda n: F.when(F.col("_is_left"), F.regexp_extract(left[0], left[1], left[2] + n)).otherwise(F.regexp_extract(right[0], right[1], right[2] + n))
    at = F.when(F.col("_is_left"), F.col("_arr") - F.col("_back")).otherwise(F.col("_arr") + F.col("_ahead"))
    near = F.col("_is_left") | (F.col("_ahead") <= NEAR)
    return _one(near, _deck_fact("arr", N.money(pick(0), pick(1)), between(F.col("text"), at, _end("_arr", ARR))))


def kpi_pair() -> Column:
    """The customer count of four cards read in one line."""
    return _one(F.col("_cards") & F.col("text").rlike(KPI_PAIR), _deck_fact("customer_count", F.regexp_extract("text", KPI_PAIR, 1).try_cast("double"), F.regexp_extract("text", KPI_PAIR, 0)))


def count_card() -> Column:
    """The last whole number within BEFORE characters before the customers' label."""
    at = F.col("_cust") - F.length("_before") + F.length(F.regexp_extract("_before", LAST_COUNT, 1))
    return _one(F.col("_before").rlike(LAST_COUNT), _deck_fact("customer_count", F.regexp_extract("_before", LAST_COUNT, 2).try_cast("double"), between(F.col("text"), at, _end("_cust", CUSTOMERS))))


def percent_card() -> Column:
    return _one(F.col("_pct").isNotNull(), _deck_fact("gross_margin", F.regexp_extract("text", PERCENT, 1).try_cast("double"), between(F.col("text"), F.col("_pct"), _end("_pct", PERCENT))))


def milestones(text: Column) -> Column:
    """All goals for ARR with their year."""
    goals = F.regexp_extract_all(text, F.lit(MILESTONE), F.lit(0))
    year = lambda m: F.regexp_extract(m, MILESTONE, 3)
    value = lambda m: N.money(F.regexp_extract(m, MILESTONE, 1), F.regexp_extract(m, MILESTONE, 2))
    return F.transform(goals, lambda m: _fact("arr", value(m), m, year(m), F.lit("projection"), F.make_date(year(m).try_cast("int"), F.lit(12), F.lit(31))))


def team_goals(text: Column) -> Column:
    """All goals for the team; the first year within reach dates them, goals without one are none."""
    state = "struct<pos: int, out: array<struct<at: int, m: string>>>"
    none = F.struct(F.lit(0).alias("pos"), F.array().alias("out")).cast(state)

    def step(a: Column, x: Column) -> Column:
        here = a["pos"] + F.length(x["gap"])
        return F.struct((here + F.length(x["m"])).alias("pos"), F.concat(a["out"], F.array(F.struct(here.alias("at"), x["m"].alias("m")))).alias("out")).cast(state)

    found = F.aggregate(_matches(text, TEAM), none, step)["out"]
    dated = F.transform(found, lambda g: F.struct(g["m"].alias("m"), M.year_near(text, g["at"] + 1, F.length(g["m"])).alias("y")))
    kept = F.filter(dated, lambda g: g["y"].isNotNull())
    return F.transform(kept, lambda g: _fact("employee_count", F.regexp_extract(g["m"], TEAM, 1).try_cast("double"), g["m"], g["y"], F.lit("projection"), F.make_date(g["y"].try_cast("int"), F.lit(12), F.lit(31))))


def runway() -> Column:
    x = F.concat(F.regexp_extract("text", RUNWAY, 1), F.regexp_extract("text", RUNWAY, 2)).try_cast("double")
    return _one(F.col("text").rlike(RUNWAY), _deck_fact("runway_months", x, F.regexp_extract("text", RUNWAY, 0)))


def layout_observations(chunks: DataFrame, rules: list[Rule], as_of: Column, doc: str, order: str, keys: list[str]) -> DataFrame:
    """(keys, metric_code, value, evidence, period_label, scenario, as_of_date,
    period_granularity, currency, method, confidence) of chunks (doc, order, keys,
    text). Facts of metrics without a rule, out of a rule's range or without a date
    are none. A fact counts once a chunk, whatever its label, the first one stays.
    A chunk without text gives none."""
    by = {r.code: r for r in rules}
    text = F.col("text")
    dates = broadcast_if_small(deck_dates(chunks, doc, order))
    df = with_places(chunks.select(*dict.fromkeys([doc, *keys]), "text").join(dates, doc, "left"), as_of)
    bounds = lambda which, none: F.create_map(*[F.lit(x) for r in rules for x in (r.code, float(none if getattr(r, which) is None else getattr(r, which)))])
    fits = lambda f: F.coalesce(N.within(f["x"], F.element_at(bounds("low", "-inf"), f["code"]), F.element_at(bounds("high", "inf"), f["code"])), F.lit(False))
    good = lambda facts: F.filter(facts, lambda f: f["date"].isNotNull() & f["scenario"].isNotNull() & f["code"].isin(list(by)) & fits(f))
    none = F.array().cast(_FACT)
    slots = [*[matrix(c) for c in MATRIX_ROWS], money_card(), kpi_pair(), percent_card(), milestones(text), team_goals(text), runway()]
    df = df.withColumn("_f", good(F.concat(*[F.coalesce(s.cast(_FACT), none) for s in slots])))
    # A customer count of the four cards goes before one beside its label.
    paired = F.exists("_f", lambda f: (f["code"] == "customer_count") & (f["label"] == DECK))
    df = df.withColumn("_f", F.when(paired, F.col("_f")).otherwise(F.concat("_f", good(count_card()))))
    same = lambda a, b: (a["code"] == b["code"]) & (a["x"] == b["x"]) & (a["date"] == b["date"]) & (a["scenario"] == b["scenario"])
    df = df.withColumn("_f", F.filter("_f", lambda f, i: ~F.exists(F.slice("_f", F.lit(1), i), lambda g: same(f, g))))
    # Outer, since the filter inferred from an inner one would copy all of the above below it.
    out = df.select(*keys, F.explode_outer("_f").alias("f")).where("f is not null").select(*keys, "f.*")
    default, currency = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in rules:
        default = F.when(F.col("code") == r.code, F.lit(r.granularity)).otherwise(default)
        currency = F.when(F.col("code") == r.code, F.lit(r.currency).cast("string")).otherwise(currency)
    return out.select(*keys, F.col("code").alias("metric_code"), N.value_text(F.col("x")).alias("value"), "evidence", F.col("label").alias("period_label"), "scenario", F.col("date").alias("as_of_date"), M.granularity(F.col("label"), default).alias("period_granularity"), currency.alias("currency"), F.lit("layout_pattern").alias("method"), F.lit(CONFIDENCE).alias("confidence"))
