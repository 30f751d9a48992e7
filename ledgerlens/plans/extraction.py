"""Sources, extraction, grounding, entity resolution and workflow over the driver's tables."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import temporal as M
from ..functions import text as X
from ..operators import agents as AG
from ..operators import backfill as BF
from ..operators import entity as E
from ..operators import extract as T
from ..operators import fallback as LF
from ..operators import ground as G
from ..operators import layout as L
from ..operators import retrieval as V
from ..operators import state as ST
from ..sources import catalog as C
from ..sources import documents as D
from ..sources import preprocess as PP
from ..sources import providers as P
from ..sources import scratch
from ..sources import sinks as K
from ..sources import store as S
from ..sources.rules import ALL, DEFAULT
from .expressions import AS_OF, MEMO, NAMES
from .registry import base, query, scan

AS_OF_ = F.expr
DECK = """
SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 900 + 1 AS amount, year(o_orderdate) AS y, quarter(o_orderdate) AS q,
  'ARR: $' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 900 + 1 AS STRING) || '.5M as of Q' || CAST(quarter(o_orderdate) AS STRING) || ' ' || CAST(year(o_orderdate) AS STRING)
  || '. Team of ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 900 + 1 AS STRING) || '. Founded in ' || CAST(year(o_orderdate) - 3 AS STRING) || '. '
  || CASE o_orderkey % 3 WHEN 0 THEN 'Closed our Series A round' WHEN 1 THEN 'Raised a pre-seed, then seed' ELSE 'No round yet' END || '. '
  || CASE o_orderkey % 4 WHEN 0 THEN 'The founder had an exit' WHEN 1 THEN 'exit signs' ELSE '' END AS text
FROM {orders}"""
QEND = "last_day(make_date(CAST(y AS INT), CAST(q AS INT) * 3, 1))"
SCEN = f"CASE WHEN {QEND} > {AS_OF} THEN 'projection' ELSE 'actual' END"
ENGINE = f"""SELECT id, 'arr' AS metric_code, CAST(amount * 1000000 + 500000 AS VARCHAR) AS value, 'Q' || q || ' ' || y AS period_label, {SCEN} AS scenario FROM b
UNION ALL SELECT id, 'employee_count', CAST(amount AS VARCHAR), 'Q' || q || ' ' || y, {SCEN} FROM b
UNION ALL SELECT id, 'founding_year', CAST(y - 3 AS VARCHAR), 'Q' || q || ' ' || y, {SCEN} FROM b
UNION ALL SELECT id, 'funding_stage', CASE id % 3 WHEN 0 THEN '3' ELSE '1' END, NULL, NULL FROM b WHERE id % 3 < 2
UNION ALL SELECT id, 'prior_successful_exit', 'true', NULL, NULL FROM b WHERE id % 4 = 0"""


def _extracted(b, codes=None):
    return T.extract(b, ALL, F.expr(AS_OF), ["id"], codes)


@query(ENGINE, DECK, spread=True)
def ext_engine(b):
    return _extracted(b).select("id", "metric_code", "value", "period_label", "scenario")


@query(f"SELECT id, CAST(amount * 1000000 + 500000 AS VARCHAR) AS value, {QEND} AS as_of_date FROM b", DECK, spread=True)
def ext_regex(b):
    return _extracted(b, ["arr"]).select("id", "value", "as_of_date")


@query("SELECT id, CASE id % 3 WHEN 0 THEN '3' ELSE '1' END AS value FROM b WHERE id % 3 < 2", DECK, spread=True)
def ext_enum_map(b):
    return _extracted(b, ["funding_stage"]).select("id", "value")


@query("SELECT metric_code, count(*) AS n FROM (" + ENGINE + ") GROUP BY 1", DECK, spread=True)
def ext_dedupe(b):
    # Every observation twice, of one extraction.
    both = _extracted(b).select("id", "metric_code", "value", "as_of_date", "scenario", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank"))
    kept = T.dedupe(both, ["id", "metric_code", "value", "as_of_date", "scenario"], [F.asc("rank")])
    return kept.groupBy("metric_code").agg(F.count("*").alias("n"))


@query("SELECT id, code FROM (SELECT id, unnest(['funding_stage', 'prior_successful_exit']) AS code FROM b) WHERE NOT (code = 'funding_stage' AND id % 3 < 2) AND NOT (code = 'prior_successful_exit' AND id % 4 = 0)", DECK, spread=True)
def ext_missing(b):
    want = b.select("id", F.explode(F.array(F.lit("funding_stage"), F.lit("prior_successful_exit"))).alias("code"))
    have = _extracted(b, ["funding_stage", "prior_successful_exit"]).select("id", F.col("metric_code").alias("code"))
    return want.join(have, ["id", "code"], "left_anti")


GRID = "SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 90 + 1 AS v, year(o_orderdate) AS y FROM {orders}"


def _grid(b):
    s = lambda c: F.col(c).cast("string")
    head = F.array(F.lit("Metric"), s("y"), F.concat(s("y"), F.lit("E")))
    rows = F.array(head, F.array(F.lit("ARR ($M)"), s("v"), F.lit("-")), F.array(F.lit(" Head\ncount "), F.concat(s("v"), F.lit("0")), s("v")), F.array(F.lit("Notes"), s("v"), s("v")))
    return b.select("id", rows.alias("grid"))


@query(f"""SELECT id, 'arr' AS metric_code, CAST(y AS VARCHAR) AS period_label, v * 1e6 AS value, CASE WHEN make_date(CAST(y AS INT), 12, 31) > {AS_OF} THEN 'projection' ELSE 'actual' END AS scenario FROM b""", GRID)
def ext_table_grid(b):
    return T.table_observations(_grid(b), ["id"], F.expr(AS_OF)).select("id", "metric_code", "period_label", "value", "scenario")


@query("SELECT id, CAST(0 AS INT) AS header FROM b", GRID)
def ext_table_header(b):
    return _grid(b).select("id", T.table_header(F.col("grid")).alias("header"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'arr' WHEN 1 THEN 'gross_margin' WHEN 2 THEN 'employee_count' END AS code FROM part")
def ext_row_metric(spark, sf):
    label = F.when(F.col("p_partkey") % 4 == 0, "ARR ($M)").when(F.col("p_partkey") % 4 == 1, "Gross  margin, %").when(F.col("p_partkey") % 4 == 2, "Headcount").otherwise("Notes")
    return scan(spark, sf, "part").select("p_partkey", T.row_metric(label).alias("code"))


MATRIX = "SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 90 + 1 AS v, 'Financials 2024 2025 2026E ARR ($M) ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 1 AS STRING) || ' 5 7.5 Gross margin -3% 64% 71% Customers 9 38' AS text FROM {orders}"
MATRIX_SQL = f"""SELECT id, m AS metric_code, p AS period_label, x::DOUBLE AS value, CASE WHEN p = '2026E' THEN 'estimate' ELSE 'projection' END AS scenario FROM (
SELECT id, 'arr' m, '2024' p, v * 1e6 x FROM b UNION ALL SELECT id, 'arr', '2025', 5e6 FROM b UNION ALL SELECT id, 'arr', '2026E', 7.5e6 FROM b
UNION ALL SELECT id, 'gross_margin', '2024', -3 FROM b UNION ALL SELECT id, 'gross_margin', '2025', 64 FROM b UNION ALL SELECT id, 'gross_margin', '2026E', 71 FROM b
UNION ALL SELECT id, 'customer_count', '2024', 9 FROM b UNION ALL SELECT id, 'customer_count', '2025', 38 FROM b)"""


@query(MATRIX_SQL, MATRIX, spread=True)
def ext_matrix(b):
    return T.matrix_observations(b, ["id"], F.expr(AS_OF)).select("id", "metric_code", "period_label", "value", "scenario")


@query(f"SELECT metric_code, count(*) AS n FROM ({MATRIX_SQL}) GROUP BY 1", MATRIX, spread=True)
def ext_layout(b):
    m = T.matrix_observations(b, ["id"], F.expr(AS_OF)).withColumn("o", F.lit(1))
    return T.dedupe(m.unionByName(m), ["id", "metric_code", "period_label"], [F.asc("o")]).groupBy("metric_code").agg(F.count("*").alias("n"))


SLIDES = """
SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS doc, CAST(o_orderkey % 4 AS INT) AS seq, CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS a, o_orderdate AS day,
  CASE o_orderkey % 4
  WHEN 0 THEN 'SERIES A ' || CASE WHEN month(o_orderdate) <= 6 THEN 'April ' ELSE 'Oct ' END || CAST(year(o_orderdate) AS STRING)
  WHEN 1 THEN 'TRACTION $4.5M ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 60 AS STRING) || ' 138% $' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 110 AS STRING) || 'K ARR Paying customers ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS STRING) || '% gross margin'
  WHEN 2 THEN 'FINANCIALS 2024 2025 2026E ARR ($M) ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS STRING) || '.5 2 7.5 Revenue ($M) 1 ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS STRING) || ' 3 Gross margin 64% -' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS STRING) || '% 71% Burn ($M) (1.5) (' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS STRING) || ') 8 Customers 9 ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS STRING) || ' Headcount 12 28 ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS STRING) || '. Path to $52M ARR by 2019'
  ELSE 'MILESTONES Reach $' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS STRING) || 'M ARR by end of 2027. Grow team from 3 to ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS STRING) || '. ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 10 AS STRING) || '-month runway'
  END AS text
FROM {orders}"""
_ROWS = [("arr", "{a} * 1e6 + 500000", "2000000", "7500000"), ("revenue", "1000000", "{a} * 1000000", "3000000"), ("gross_margin", "64", "-{a}", "71"), ("burn_rate", "1500000", "{a} * 1000000", "8000000"), ("customer_count", "9", "{a}", None), ("employee_count", "12", "28", "{a}")]
_CELLS = " UNION ALL ".join(f"SELECT doc, seq, '{m}' AS metric_code, CAST(CAST({x.format(a='a')} AS BIGINT) AS VARCHAR) AS value, '{p}' AS period_label, '{s}' AS scenario, make_date({p[:4]}, 12, 31) AS as_of_date FROM b WHERE seq = 2" for m, *cells in _ROWS for x, p, s in zip(cells, ("2024", "2025", "2026E"), ("projection", "projection", "estimate"), strict=True) if x)
LAYOUT_SQL = f"""
WITH d AS (SELECT doc, last_day(make_date(CAST(year(day) AS INT), CASE WHEN month(day) <= 6 THEN 4 ELSE 10 END, 1)) AS deck FROM b WHERE seq = 0)
{_CELLS}
UNION ALL SELECT doc, seq, 'arr', CAST((a + 100) * 1000 AS VARCHAR), 'deck_date', 'actual', deck FROM b JOIN d USING (doc) WHERE seq = 1
UNION ALL SELECT doc, seq, 'customer_count', CAST(a + 50 AS VARCHAR), 'deck_date', 'actual', deck FROM b JOIN d USING (doc) WHERE seq = 1
UNION ALL SELECT doc, seq, 'gross_margin', CAST(a AS VARCHAR), 'deck_date', 'actual', deck FROM b JOIN d USING (doc) WHERE seq = 1
UNION ALL SELECT doc, seq, 'arr', CAST(a * 1000000 AS VARCHAR), '2027', 'projection', make_date(2027, 12, 31) FROM b WHERE seq = 3
UNION ALL SELECT doc, seq, 'employee_count', CAST(a AS VARCHAR), '2027', 'projection', make_date(2027, 12, 31) FROM b WHERE seq = 3
UNION ALL SELECT doc, seq, 'arr', '52000000', '2019', 'projection', make_date(2019, 12, 31) FROM b WHERE seq = 2
UNION ALL SELECT doc, seq, 'runway_months', CAST(a AS VARCHAR), 'deck_date', 'actual', deck FROM b JOIN d USING (doc) WHERE seq = 3"""


@query(LAYOUT_SQL, SLIDES)
def ext_layout_slides(b):
    found = L.layout_observations(b, ALL, F.expr(AS_OF), "doc", "seq", ["doc", "seq"])
    return found.select("doc", "seq", "metric_code", "value", "period_label", "scenario", "as_of_date")


CARD = "SELECT id, amount, day, 'Traction KPI Deck ' || CASE WHEN id % 2 = 0 THEN '$' || CAST(amount AS STRING) || 'M 62 118% $5k ARR Paying customers' ELSE 'Reach $' || CAST(amount AS STRING) || 'M ARR by end of 2027. Grow team from 3 to ' || CAST(amount AS STRING) END || ' ' || CAST(amount % 90 AS STRING) || '% gross margin. 24-month runway' AS text FROM (" + MEMO + ")"


@query("SELECT id, amount FROM b WHERE id % 2 = 0", CARD)
def ext_kpi_cards(b):
    live = F.lower("text").rlike("traction|kpi|metric") & ~F.lower("text").rlike(r"\b(reach|hit|get to|grow team)\b")
    return b.where(live).select("id", "amount")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 5000.0::DOUBLE ELSE amount * 1e6 END AS value FROM b", CARD)
def ext_money_card(b):
    """Amount nearest to the label: all matches by position, ties to the first."""
    money = r"\$\s*[0-9.]+\s*(?:k|m|b|million|billion)?"
    parts = F.split("text", rf"(?i)(?={money})")
    label = F.position(F.lit("ARR"), F.col("text"))
    starts = F.transform(parts, lambda p, i: F.struct(F.aggregate(F.slice(parts, F.lit(1), i), F.lit(1), lambda a, x: a + F.length(x)).alias("at"), p.alias("p")))
    near = F.filter(F.transform(F.filter(starts, lambda s: s["p"].startswith("$")), lambda s: F.struct(F.abs(s["at"] - label).alias("d"), s["at"].alias("at"), s["p"].alias("p"))), lambda s: s["d"] <= 90)
    best = F.array_min(near)["p"]
    value = N.money(F.regexp_extract(best, r"\$\s*([0-9.]+)", 1), F.regexp_extract(best, r"(?i)^\$\s*[0-9.]+\s*(k|m|b|million|billion)?", 1))
    return b.where(label > 0).select("id", value.alias("value"))


@query("SELECT id, 62.0::DOUBLE AS customers FROM b WHERE id % 2 = 0", CARD)
def ext_kpi_pair(b):
    p = r"(?i)\$\s*[0-9.]+\s*(?:k|m|b)?\s+([0-9]{1,6})\s+[0-9]{1,3}%\s+\$\s*[0-9.]+\s*(?:k|m|b)?\s+ARR\s+Paying\s+customers\b"
    v = F.regexp_extract("text", p, 1)
    return b.where(v != "").select("id", v.try_cast("double").alias("customers"))


@query("SELECT id, 118.0::DOUBLE AS n FROM b WHERE id % 2 = 0", CARD)
def ext_count_card(b):
    """The last whole number before the customers' label: 118, since 5 has a letter after it."""
    placed = L.with_places(b.withColumn("deck_date", F.col("day")), F.expr(AS_OF))
    return placed.select("id", F.explode(L.count_card()).alias("f")).select("id", F.col("f.x").alias("n"))


@query("SELECT id, CAST(amount % 90 AS DOUBLE) AS gm FROM b", CARD)
def ext_percent_card(b):
    return b.select("id", F.regexp_extract("text", r"(?i)\b(-?[0-9]{1,3}(?:\.[0-9]+)?)\s*%\s+(?:gross\s+margin|gm)\b", 1).try_cast("double").alias("gm"))


@query("SELECT id, 'arr' AS metric_code, amount * 1e6 AS value, '2027' AS year FROM b WHERE id % 2 = 1 UNION ALL SELECT id, 'employee_count', CAST(amount AS DOUBLE), '2027' FROM b WHERE id % 2 = 1", CARD)
def ext_milestones(b):
    goal = r"(?i)\b(?:reach|hit|get\s+to)\s+\$\s*([0-9.]+)\s*(k|m|b)?\s+ARR\s+by\s+(?:end\s+of\s+)?(20[0-9]{2})\b"
    grow = r"(?i)\bgrow\s+team\s+from\s+[0-9]{1,6}\s+to\s+([0-9]{1,6})\b"
    found = F.regexp_extract_all("text", F.lit(goal), F.lit(0))
    arr = b.select("id", F.explode(found).alias("m")).select("id", F.lit("arr").alias("metric_code"), N.money(F.regexp_extract("m", goal, 1), F.regexp_extract("m", goal, 2)).alias("value"), F.regexp_extract("m", goal, 3).alias("year"))
    at, m = F.regexp_instr("text", F.lit(grow)), F.regexp_extract("text", grow, 0)
    team = b.where(F.col("text").rlike(grow)).select("id", F.lit("employee_count").alias("metric_code"), F.regexp_extract("text", grow, 1).try_cast("double").alias("value"), M.year_near(F.col("text"), at, F.length(m)).alias("year"))
    return arr.unionByName(team)


@query("SELECT id, 24.0::DOUBLE AS months, last_day(day) AS deck_date FROM b", CARD)
def ext_runway(b):
    v = F.regexp_extract("text", r"(?i)\b([0-9]{1,3})[-\s]?months?\s+runway\b", 1).try_cast("double")
    return b.where(v.isNotNull()).select("id", v.alias("months"), F.last_day("day").alias("deck_date"))


ASKED = [("motion", "Of the that, with tion and THING", 3), ("texte", "que dans les une pour la", 2), ("satz", "und der die mit nicht", 4), ("nothing", "of to in at", 3)]
WORDS_SQL = r"""SELECT DISTINCT {key}, w AS word FROM (SELECT {key}, unnest(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}_]+')) AS w FROM {table})
  WHERE length(w) >= 3 AND w NOT IN ('the', 'a', 'an', 'of', 'and', 'or', 'to', 'for', 'in', 'on', 'is', 'are', 'was', 'were', 'be', 'by', 'at', 'as', 'with', 'from')"""
RANKED_SQL = f"""WITH q(query_id, query, k) AS (VALUES {", ".join(str(q) for q in ASKED)}),
qw AS ({WORDS_SQL.format(key="query_id, k", text="query", table="q")}), cw AS ({WORDS_SQL.format(key="conv_id, turn", text="text", table="conversations")}),
s AS (SELECT conv_id, turn, query_id, k, CAST(count(*) AS INT) AS score FROM cw JOIN qw USING (word) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, query_id ORDER BY score DESC, turn) AS INT) AS rank FROM s QUALIFY rank <= k)"""


@query(RANKED_SQL + " SELECT conv_id, query_id, turn, score, rank FROM r")
def ext_retrieve_topk(spark, sf):
    """From a stored inverted index, several queries at once; one of stop words only finds nothing."""
    path = scratch.folder(spark, "index")
    V.write(V.postings(scan(spark, sf, "conversations"), ["conv_id", "turn"]), path)
    queries = spark.createDataFrame(ASKED, "query_id string, query string, k int")
    return V.search(spark, path, queries, ["conv_id"], ["turn"]).select("conv_id", "query_id", "turn", "score", "rank")


@query(RANKED_SQL + " SELECT conv_id, query_id, turn, score, rank FROM r")
def ext_retrieve_scan(spark, sf):
    """The same in one pass over the chunks."""
    return V.scan(scan(spark, sf, "conversations"), ASKED, ["conv_id"], ["turn"]).select("conv_id", "query_id", "turn", "score", "rank")


QUOTED_SQL = """, t AS (SELECT r.*, c.text FROM r JOIN conversations c USING (conv_id, turn)),
p AS (SELECT DISTINCT conv_id, query_id, CASE conv_id % 4 WHEN 0 THEN 'nowhere at all' ELSE word END AS quote FROM r JOIN qw USING (query_id))
SELECT conv_id, query_id, quote, arg_min(turn, rank) AS turn, min(rank) AS rank FROM p JOIN t USING (conv_id, query_id) WHERE contains(text, quote) GROUP BY ALL"""


@query(RANKED_SQL + QUOTED_SQL)
def ext_quote_ranked(spark, sf):
    """Quotes resolve to the first chunk by retrieval rank that holds them."""
    ranked = V.scan(scan(spark, sf, "conversations"), ASKED, ["conv_id"], ["turn"])
    quotes = ranked.select("conv_id", "query_id", F.explode(V.words(F.element_at(F.create_map(*[F.lit(x) for i, q, _ in ASKED for x in (i, q)]), F.col("query_id")))).alias("w"))
    quotes = quotes.select("conv_id", "query_id", F.when(F.col("conv_id") % 4 == 0, "nowhere at all").otherwise(F.col("w")).alias("quote")).distinct()
    return V.first_source(ranked, quotes, ["conv_id", "query_id"], ["turn"]).join(ranked.select("conv_id", "query_id", "turn", "rank"), ["conv_id", "query_id", "turn"])


NOTES = """SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 900 + 1 AS v, year(o_orderdate) AS y FROM {orders}"""
CHAIN_SQL = f"""WITH m AS (SELECT *, unnest(['employee_count', 'customer_count', 'gross_margin']) AS metric_code FROM b),
a AS (SELECT *, CASE metric_code WHEN 'gross_margin' THEN v % 100 ELSE v END AS n FROM m WHERE NOT (metric_code = 'employee_count' AND id % 4 = 0)),
ok AS (SELECT * FROM a WHERE n % 6 < 2 AND NOT (metric_code <> 'customer_count' AND n % 7 = 0))
SELECT id, metric_code, CAST(n AS VARCHAR) AS value, CASE metric_code WHEN 'employee_count' THEN 'slide_1' WHEN 'customer_count' THEN 'slide_3' ELSE 'slide_5' END AS locator,
  CASE metric_code WHEN 'gross_margin' THEN y || 'E' ELSE CAST(y AS VARCHAR) END AS period_label, CASE metric_code WHEN 'gross_margin' THEN 'estimate' ELSE CASE WHEN make_date(CAST(y AS INT), 12, 31) > {AS_OF} THEN 'projection' ELSE 'actual' END END AS scenario,
  make_date(CAST(y AS INT), 12, 31) AS as_of_date, 0.65::DOUBLE AS confidence,
  CASE metric_code WHEN 'employee_count' THEN 'slide_1,slide_2' WHEN 'customer_count' THEN 'slide_3,slide_4' ELSE 'slide_5' END AS retrieved FROM ok"""


EXCERPT, NUMBER, PERIOD = re.compile(r"\[slide_\d\] (.*)"), re.compile(r"\d+"), re.compile(r"\b\d{4}E?\b")


def stand_in_model(prompt):
    """A model that reads the first number of the excerpts, and misbehaves by it."""
    head, _, text = prompt.partition("Excerpts:\n")
    metric, first = head.partition("\nMetric: ")[2].partition("\n")[0], EXCERPT.search(text)[1]
    n, period = int(NUMBER.search(first)[0]), PERIOD.search(first.partition("in ")[2])[0]
    kind = n % 6
    if kind == 4:
        return "No idea."
    if kind == 5:
        raise RuntimeError("over quota")
    answer = {"value": None if kind == 2 else n, "evidence_quote": first + " or so" if kind == 3 else first, "period_label": None if n % 7 == 0 and metric != "customer_count" else period}
    return f"```json\n{json.dumps(answer)}\n```" if kind == 0 else json.dumps(answer)


@query(CHAIN_SQL, NOTES, spread=True)
def ext_llm_chain(b):
    """Retrieval, prompt, provider, answer, quote, type, range and period in one operator."""
    s = lambda c: F.col(c).cast("string")
    texts = [F.concat(F.lit("Team of "), "v", F.lit(" employees and staff in "), "y"), F.concat(F.lit("Our headcount and team size: "), "v"), F.concat("v", F.lit(" paying customers, logos in "), "y"), F.lit("customers of customers"), F.concat(F.lit("Gross margin GM "), (F.col("v") % 100).cast("string"), F.lit("% profit in "), s("y"), F.lit("E"))]
    slides = b.select("id", F.posexplode(F.array(*texts)).alias("ordinal", "text")).withColumn("locator", F.concat(F.lit("slide_"), (F.col("ordinal") + 1).cast("string")))
    codes = F.array(F.lit("customer_count"), F.lit("gross_margin"), F.lit("burn_rate"), F.lit("no_such_metric"), F.when(F.col("id") % 4 != 0, "employee_count"))
    missing = b.select("id", F.explode(F.array_compact(codes)).alias("metric_code"))
    found = LF.fallback(slides, missing, stand_in_model, F.expr(AS_OF), ["id"])
    return found.select("id", "metric_code", "value", "locator", "period_label", "scenario", "as_of_date", "confidence", F.array_join("retrieved", ",").alias("retrieved"))


@query("SELECT id, CAST(amount AS VARCHAR) AS value FROM b WHERE amount <= 700 AND id % 3 < 2 AND id % 5 <> 0", MEMO)
def ext_llm_fallback(b):
    """Guards over a table of provider responses: quote in chunk, range, period."""
    answers = b.select("id", F.concat(F.lit("We have "), "amount", F.lit(" clients in 2024")).alias("chunk"), F.concat(F.lit('{"value": '), "amount", F.lit(', "quote": "We have '), F.when(F.col("id") % 3 < 2, F.col("amount").cast("string")).otherwise("many"), F.lit(' clients", "period": '), F.when(F.col("id") % 5 == 0, F.lit("null")).otherwise(F.lit('"2024"')), F.lit("}")).alias("raw"))
    o = X.json_object(F.col("raw"), "value bigint, quote string, period string")
    ok = answers.withColumn("o", o).where(F.col("chunk").contains(F.col("o.quote")) & (F.col("o.value") <= 700) & M.parse_label(F.col("o.period"), F.expr(AS_OF))["as_of_date"].isNotNull())
    return ok.select("id", F.col("o.value").cast("string").alias("value"))


@query("SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def ext_quote_verify(spark, sf):
    q = scan(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    return T.contains_join(scan(spark, sf, "documents").select("doc_id", "text"), q, "text", "quote").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def jn_contains(spark, sf):
    q = scan(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    return T.contains_join(scan(spark, sf, "documents").select("doc_id", "text"), q, "text", "quote").select("item_id", "doc_id")


@query(r"""WITH n AS (SELECT conv_id, turn, text, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM conversations),
m AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN substr(text, 1, 30) WHEN 1 THEN 'zzz zzz zzz zzz zzz zzz' ELSE 'short' END AS quote FROM n)
SELECT conv_id, turn, CASE WHEN length(trim(quote)) < 20 THEN 'too_short' WHEN conv_id % 3 = 1 THEN 'not_found' ELSE 'verified' END AS status FROM m""")
def ext_link_verify(spark, sf):
    c = F.col("conv_id")
    quote = F.when(c % 3 == 0, F.substring("text", 1, 30)).when(c % 3 == 1, "zzz zzz zzz zzz zzz zzz").otherwise("short")
    return scan(spark, sf, "conversations").select("conv_id", "turn", G.quote_check(quote, F.col("text")).alias("status"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' ELSE 'not_found' END AS status FROM supplier")
def ext_founder_match(spark, sf):
    s = scan(spark, sf, "supplier")
    url = F.when(F.col("s_suppkey") % 3 < 2, F.concat(F.lit("https://www.linkedin.com/in/p"), "s_suppkey")).otherwise(F.lit("https://x.com/in/p"))
    hits = s.select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("rank")).join(s.select("s_suppkey", "s_name", url.alias("url")), "s_suppkey")
    title = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Founder, "), "s_name")).otherwise("Founder")
    first = ST.first_by(hits.where(X.linkedin_profile(F.col("url"))), ["s_suppkey"], [F.asc("rank")])
    found = first.select("s_suppkey", F.when(X.mentions(title, F.lit(""), F.col("s_name"), F.lit(None).cast("string")), "verified").otherwise("unverified").alias("status"))
    return s.select("s_suppkey").join(found, "s_suppkey", "left").select("s_suppkey", F.coalesce("status", F.lit("not_found")).alias("status"))


@query("SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS value FROM events WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) >= 40")
def ext_web_metric(spark, sf):
    listed = F.concat(F.lit("["), "props", F.lit(", {}]"))
    first = F.from_json(listed, "array<struct<k: bigint>>")[0]["k"]
    return scan(spark, sf, "events").select("event_id", first.alias("value")).where(first / 100 >= 0.4)


GNAME = "SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'we are ' || upper(s_name) || ' here' WHEN 1 THEN 'only Supplier text' ELSE 'nothing' END AS text FROM {supplier}"


@query("SELECT id, CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence FROM b", GNAME)
def ext_ground_name(b):
    two = F.regexp_replace("name", "#", " #")
    return b.select("id", G.name_confidence(F.when(F.col("id") % 3 == 1, two).otherwise(F.col("name")), F.col("text")).alias("confidence"))


@query("SELECT id, CASE WHEN website IS NULL THEN 0.0 WHEN id % 4 = 1 THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence FROM b", NAMES)
def ext_ground_website(b):
    name = F.when(F.col("id") % 4 == 1, F.lit("Quux")).otherwise(F.concat(F.lit("Firm"), "id"))
    text = F.concat(F.lit("see firm"), "id", F.lit(".io!"))
    site = F.when(F.col("id") % 4 == 1, F.concat(F.lit("http://firm"), "id", F.lit(".io"))).otherwise(F.col("website"))
    return b.select("id", G.website_confidence(site, name, text).alias("confidence"))


@query("SELECT conv_id, turn, 1.0::DOUBLE AS confidence FROM conversations WHERE length(text) > 0")
def ext_ground_claim(spark, sf):
    return scan(spark, sf, "conversations").where("length(text) > 0").select("conv_id", "turn", G.claim_confidence(F.substring("text", 1, 25), F.col("text")).alias("confidence"))


RECORD = """SELECT s_suppkey AS id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'https://firm' || CAST(s_suppkey AS STRING) || '.io/a' WHEN 1 THEN 'linkedin.com/in/x' WHEN 2 THEN 'https://www.gone' || CAST(s_suppkey AS STRING) || '.com' END AS website,
  CASE s_suppkey % 3 WHEN 0 THEN 'makes valves' WHEN 1 THEN 'industrial marble fountains in small series' END AS description, 'Oslo' AS location, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'pumps' END AS sector, CASE s_suppkey % 6 WHEN 0 THEN 'Seed' END AS funding_stage,
  CASE s_suppkey % 4 WHEN 0 THEN 'Ann Absent|Bo Berg' WHEN 1 THEN 'Ann Absent' WHEN 2 THEN '' END AS people,
  CASE WHEN s_suppkey % 11 <> 0 THEN 'We are ' || CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE 'a firm' END || ', see firm' || CAST(s_suppkey AS STRING) || '.io. Bo Berg in OSLO makes valves and marble fountains after a seed round.' END AS text FROM {supplier}"""
RECORD_SQL = """WITH e AS (
SELECT id, 'name' AS field, CASE WHEN text IS NOT NULL AND id % 2 = 0 THEN 1.0 ELSE 0.0 END AS confidence, NULL AS best FROM b
UNION ALL SELECT id, 'website', CASE WHEN text IS NOT NULL AND id % 4 = 0 THEN 0.8 ELSE 0.0 END, NULL FROM b WHERE id % 4 <> 3
UNION ALL SELECT id, 'description', CASE WHEN text IS NULL THEN 0.0 WHEN id % 3 = 0 THEN 1.0 ELSE 0.7 END, NULL FROM b WHERE id % 3 <> 2
UNION ALL SELECT id, 'location', CASE WHEN text IS NULL THEN 0.0 ELSE 1.0 END, NULL FROM b
UNION ALL SELECT id, 'sector', 0.0, NULL FROM b
UNION ALL SELECT id, 'funding_stage', CASE WHEN text IS NULL THEN 0.0 ELSE 1.0 END, NULL FROM b WHERE id % 6 = 0
UNION ALL SELECT id, 'founders', CASE WHEN text IS NOT NULL AND id % 4 = 0 THEN 1.0 ELSE 0.0 END, CASE WHEN text IS NOT NULL AND id % 4 = 0 THEN 'Bo Berg' ELSE 'Ann Absent' END FROM b WHERE id % 4 < 2)"""


def _records(b):
    return G.ground_fields(b.withColumn("founders", F.split("people", r"\|")).drop("people"), ["id"])


@query(RECORD_SQL + " SELECT id, field, confidence::DOUBLE AS confidence, confidence > 0 AS grounded, best FROM e", RECORD)
def ext_ground_all(b):
    """Every field of a record by its own rule; founders by their best one."""
    return _records(b)


@query(RECORD_SQL + " SELECT id, round((sum(w * confidence) / sum(w))::DOUBLE, 4) AS score FROM (SELECT *, CASE field WHEN 'name' THEN 3 WHEN 'website' THEN 2 WHEN 'funding_stage' THEN 0.5 ELSE 1 END AS w FROM e) GROUP BY 1", RECORD)
def ext_ground_score(b):
    return G.record_score(_records(b), ["id"]).withColumn("score", F.round("score", 4))


SITE_SQL = r"""WITH p AS (SELECT page_id, lower(coalesce(html, '')) AS page, trim(regexp_extract(lower(html), '<title[^>]*>([^<]+)</title>', 1)) AS title, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages),
n AS (SELECT *, lower(trim(CASE page_id % 5 WHEN 0 THEN host WHEN 1 THEN regexp_extract(title, '[a-z]{3,}') || ' zzqxj' WHEN 2 THEN 'Body zzqxj' WHEN 3 THEN ' zzqxj  BODY html ' ELSE 'zzqxj' END)) AS name FROM p),
w AS (SELECT *, list_filter(regexp_split_to_array(name, '\s+'), lambda x: length(x) >= 3) AS words FROM n)
SELECT page_id, CASE WHEN contains(page, name) THEN 1.0 WHEN contains(title, words[1]) THEN 0.8 WHEN contains(page, words[1]) THEN 0.7 WHEN len(list_filter(words, lambda x: contains(page, x))) >= 2 THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM w"""


@query(SITE_SQL)
def ext_site_verify(spark, sf):
    """The whole ladder: name, first word in title or page, two words, nothing."""
    p, k = scan(spark, sf, "pages"), F.col("page_id") % 5
    own = F.when(k == 0, F.regexp_extract("url", "://([^/]+)", 1)).when(k == 1, F.concat(F.regexp_extract(G.page_title(F.col("html")), "[a-z]{3,}", 0), F.lit(" zzqxj"))).when(k == 2, "Body zzqxj").when(k == 3, " zzqxj  BODY html ").otherwise("zzqxj")
    return p.select("page_id", G.site_confidence(own, F.col("html")).alias("confidence"))


@query("SELECT conv_id, turn, 0.6::DOUBLE AS confidence FROM conversations WHERE regexp_matches(text, '[a-z]{4}') AND length(text) < 0 UNION ALL SELECT conv_id, turn, 1.0 FROM conversations WHERE length(text) > 0")
def ext_source_verify(spark, sf):
    return scan(spark, sf, "conversations").where("length(text) > 0").select("conv_id", "turn", G.source_confidence(F.substring("text", 1, 18), F.col("text")).alias("confidence"))


# Entities -----------------------------------------------------------------


FIRMS = f"""SELECT id, name, website, CASE id % 6 WHEN 0 THEN file WHEN 2 THEN file WHEN 5 THEN 'Firm_' || CAST(id AS STRING) || '_Trading.pdf' WHEN 4 THEN NULL ELSE 'x.pdf' END AS file,
  'Supplier#' || lpad(CAST(id AS STRING), 9, '0') || CASE id % 5 WHEN 3 THEN ' Labs' ELSE '' END AS short,
  CASE id % 4 WHEN 0 THEN 'firm' || CAST(id AS STRING) || '.com' WHEN 1 THEN 'firm' || CAST(id AS STRING) || '.io' WHEN 2 THEN 'firm' || CAST(id AS STRING) || '.co.uk' END AS host FROM ({NAMES})"""
#: Documents in which name and domain, alias, file name and fuzzy, nothing, name and fuzzy, alias in the file name decide.
HEADS = f"""SELECT *, CASE id % 6 WHEN 0 THEN 'About ' || short || ' on ' || coalesce(host, 'paper') WHEN 1 THEN 'Deck of Firm ' || CAST(id AS STRING) || ' Trading, today'
  WHEN 2 THEN replace(short, 'Supplier', 'Suplier') WHEN 3 THEN 'nothing here' WHEN 4 THEN short END AS head FROM ({FIRMS})"""


def _entity(spark, sf, more=None, least=E.LEAST):
    s = base(spark, sf, HEADS)
    aliases = s.select(F.col("id").alias("company_id"), F.concat(F.lit(" Firm "), "id", F.lit(" Trading")).alias("alias"), F.lit("legal_name").alias("alias_type"))
    orphans = s.select(F.col("id") + 10_000_000, F.lit("Deck of"), F.lit("dba"))
    return E.resolve(s.select(F.col("id").alias("doc_id"), "file", "head"), s.select(F.col("id").alias("company_id"), "name", "website"), aliases.union(orphans), least)


def _plain_sql(text):
    return f"' ' || trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g')) || ' '"


def _tokens_sql(text, least, noise):
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^a-z0-9]+'), lambda t: length(t) >= {least} AND t NOT IN ({', '.join(repr(n) for n in noise)}))"


#: Every pair is scored. Common letters of two strings in order by bits: v loses a bit for each.
ENTITY = f"""WITH s AS ({HEADS.replace("{", "").replace("}", "")}),
d AS (SELECT id AS doc_id, {_plain_sql("head")} AS ph, {_plain_sql("file")} AS pf, {_tokens_sql("regexp_replace(file, '[.][^.]*$', '')", 3, X.NOISE)} AS ft, string_split(lower(coalesce(head, '')), ' ') AS hw,
  list_sort(list_distinct(list_filter(string_split(lower(coalesce(head, '')), ' '), lambda w: w <> ''))) AS x FROM s),
c AS (SELECT id AS company_id, host, ' firm ' || id || ' trading ' AS alias, {_plain_sql("short")} AS name, {_tokens_sql("name", 2, X.SUFFIXES)} AS nt, list_sort(list_distinct(string_split(lower(short), ' '))) AS y FROM s),
raw AS (SELECT *, CASE WHEN contains(pf, alias) OR contains(ph, alias) THEN 0.6 ELSE 0.0 END::DOUBLE + CASE WHEN contains(pf, name) OR contains(ph, name) THEN 0.5 ELSE 0.0 END::DOUBLE
  + CASE WHEN list_contains(hw, host) THEN 0.3 ELSE 0.0 END::DOUBLE + 0.25::DOUBLE * (len(list_filter(nt, lambda t: list_contains(ft, t)))::DOUBLE / len(nt)) AS raw FROM d, c),
near AS (SELECT *, array_to_string(list_sort(list_intersect(x, y)), ' ') AS shared, list_sort(list_filter(x, lambda w: NOT list_contains(y, w))) AS l, list_sort(list_filter(y, lambda w: NOT list_contains(x, w))) AS r FROM raw WHERE raw + 0.25 >= 0.4),
whole AS (SELECT *, trim(shared || ' ' || array_to_string(l, ' ')) AS one, trim(shared || ' ' || array_to_string(r, ' ')) AS two FROM near),
lcs AS (SELECT *, length(two) - bit_count(list_reduce(list_transform(string_split(one, ''), lambda ch: list_sum(list_transform(range(length(two)), lambda k: CASE WHEN substr(two, k + 1, 1) = ch THEN 1::BIGINT << k ELSE 0 END))::BIGINT),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(two)) - 1), (1::BIGINT << length(two)) - 1)) AS common FROM whole),
ratio AS (SELECT *, CASE WHEN len(x) = 0 THEN 0.0 WHEN shared <> '' AND (len(l) = 0 OR len(r) = 0) THEN 100.0
  ELSE greatest(200.0::DOUBLE * common / (length(one) + length(two)), CASE WHEN shared <> '' THEN greatest(200.0::DOUBLE * length(shared) / (length(shared) + length(one)), 200.0::DOUBLE * length(shared) / (length(shared) + length(two))) ELSE 0.0 END) END::DOUBLE AS ratio FROM lcs),
scored AS (SELECT doc_id, company_id, raw + CASE WHEN ratio >= 80 THEN 0.25::DOUBLE * (ratio / 100.0::DOUBLE) ELSE 0.0 END AS raw FROM ratio),
best AS (SELECT doc_id, company_id, round(least(1.0, raw), 4)::DOUBLE AS score FROM scored WHERE raw >= 0.4
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(least(1.0, raw), 4) DESC, company_id) <= 5)"""


@query(ENTITY + " SELECT * FROM best")
def agg_signal_sum(spark, sf):
    """All five signals against the scores of all pairs."""
    return _entity(spark, sf)


@query(ENTITY + " SELECT doc_id, company_id, score >= 0.85 AS accept FROM best")
def jn_cross_entity(spark, sf):
    return _entity(spark, sf).select("doc_id", "company_id", (F.col("score") >= E.ACCEPT).alias("accept"))


@query(ENTITY + " SELECT * FROM best")
def agg_signal_all(spark, sf):
    """The same from a stored index."""
    s, path = base(spark, sf, HEADS), scratch.folder(spark, "companies")
    aliases = s.select(F.col("id").alias("company_id"), F.concat(F.lit("Firm "), "id", F.lit(" Trading")).alias("alias"), F.lit("legal_name").alias("alias_type"))
    E.write_index(s.select(F.col("id").alias("company_id"), "name", "website"), aliases, path)
    return E.resolve_stored(s.select(F.col("id").alias("doc_id"), "file", "head"), path)


@query(None, NAMES)
def exp_token_set_ratio(b):
    return b.select("id", E.token_set_ratio_udf(F.col("name"), F.concat(F.lit("the "), F.lower("name"))).alias("ratio"))


# Sources ------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '2000-01-01'")
def src_table_scan(spark, sf):
    return scan(spark, sf, "orders").where("o_orderdate >= date '2000-01-01'").select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def src_point_lookup(spark, sf):
    return scan(spark, sf, "customer").where("c_custkey = 42").select("c_custkey", "c_name").limit(1)


@query("SELECT s_suppkey, s_name FROM supplier")
def src_list_companies(spark, sf):
    return scan(spark, sf, "supplier").select("s_suppkey", "s_name").orderBy("s_name")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey = 7")
def src_get_company(spark, sf):
    return scan(spark, sf, "supplier").where("s_suppkey = 7").select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT DISTINCT p_type FROM part")
def src_list_metric_types(spark, sf):
    return scan(spark, sf, "part").select("p_type").distinct().orderBy("p_type")


@query("SELECT n_nationkey, n_name FROM nation")
def src_list_data_sources(spark, sf):
    return scan(spark, sf, "nation").select("n_nationkey", "n_name").orderBy("n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = 'nation_3'")
def src_source_by_name_ci(spark, sf):
    return scan(spark, sf, "nation").where(F.lower("n_name") == F.lower(F.lit("Nation_3"))).select("n_nationkey", "n_name").limit(1)


@query("SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3")
def src_table_browser(spark, sf):
    return D.browse(scan(spark, sf, "region"), "region", ["r_regionkey"], 3, allowed={"region", "nation"}).select("r_regionkey", "r_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 8)")
def src_metric_ids_by_code(spark, sf):
    return scan(spark, sf, "part").where(F.col("p_partkey").isin(3, 5, 8)).select("p_partkey", "p_name")


@query("SELECT event_id, user_id, ts FROM events WHERE user_id = 8")
def src_founders(spark, sf):
    return scan(spark, sf, "events").where("user_id = 8").select("event_id", "user_id", "ts").orderBy("ts")


@query("SELECT s_suppkey, s_name FROM supplier")
def src_aliases(spark, sf):
    return scan(spark, sf, "supplier").select("s_suppkey", "s_name")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY'")
def src_extractor(spark, sf):
    return scan(spark, sf, "part").where("p_brand = 'Brand#2' and p_type = 'ECONOMY'").select("p_partkey")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_partkey = 11")
def src_metric_by_id(spark, sf):
    return scan(spark, sf, "part").where("p_partkey = 11").select("p_partkey", "p_name", "p_type")


@query("SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id < 5)")
def src_doc_by_hash(spark, sf):
    d = scan(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.join(d.where("doc_id < 5").select("h").distinct(), "h", "left_semi").select("doc_id")


@query(r"""SELECT doc_id, CAST(i - 1 AS INT) AS ordinal, text FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, trim(regexp_replace(unnest(p), '\s+', ' ', 'g')) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE length(text) >= 20""")
def src_pdf_chunks(spark, sf):
    return D.chunks(scan(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "\n").select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), "text")


SHEETS = """SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) % 90 + 1 AS v, year(o_orderdate) AS y,
  'Overview of the company and  its market' || chr(10) || 'in brief' || chr(12) || 'short' || chr(12) || 'Financials, as reported' || chr(10) || '| Metric | ' || CAST(year(o_orderdate) AS STRING) || ' | ' || CAST(year(o_orderdate) AS STRING) || 'E |' || chr(10)
  || '| ARR ($M) | ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 1 AS STRING) || ' | - |' || chr(10) || chr(10) || 'a | b' || chr(10) || 'end' AS text FROM {orders}"""
SHEETS_SQL = """SELECT id, 0 AS ordinal, 'slide_1' AS locator, 'Overview of the company and its market in brief' AS text, '' AS tables FROM b
UNION ALL SELECT id, 2, 'slide_3', 'Financials, as reported | Metric | ' || y || ' | ' || y || 'E | | ARR ($M) | ' || v || ' | - | a | b end', 'Metric,' || y || ',' || y || 'E;ARR ($M),' || v || ',-/a,b' FROM b"""


@query(SHEETS_SQL, SHEETS, spread=True)
def src_pages(b):
    """Pages with their tables attached, in one pass; short pages leave gaps in the ordinals."""
    pages = PP.preprocess(b, PP.TextPages(), ["id"], "text")
    tables = F.array_join(F.transform("tables", lambda t: F.array_join(F.transform(t, lambda r: F.array_join(r, ",")), ";")), "/")
    return pages.select("id", "ordinal", "locator", "text", tables.alias("tables"))


@query(f"SELECT id, 'slide_3' AS locator, 'arr' AS metric_code, CAST(y AS VARCHAR) AS period_label, v * 1e6 AS value, CASE WHEN make_date(CAST(y AS INT), 12, 31) > {AS_OF} THEN 'projection' ELSE 'actual' END AS scenario FROM b", SHEETS, spread=True)
def src_page_tables(b):
    """The tables of pages as observations."""
    grids = PP.page_tables(PP.preprocess(b, PP.TextPages(), ["id"], "text"), ["id"])
    return T.table_observations(grids, ["id", "locator"], F.expr(AS_OF)).select("id", "locator", "metric_code", "period_label", "value", "scenario")


@query(None)
def src_rules_yaml(spark, sf):
    return spark.createDataFrame([(r.code, r.kind, r.confidence, len(r.patterns)) for r in DEFAULT], "code string, kind string, confidence double, patterns int")


@query("SELECT doc_id, substr(sha256(text), 1, 2) || '/' || sha256(text) || '.txt' AS path FROM documents")
def snk_blob(spark, sf):
    return scan(spark, sf, "documents").select("doc_id", D.blob_path(F.sha2("text", 256), "txt").alias("path"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS head FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) <= 3) GROUP BY 1")
def src_head_chunks(spark, sf):
    return D.head_text(scan(spark, sf, "conversations"), ["conv_id"], ["turn", "text"], "text", 3)


INDEX_SQL = f"""WITH s AS ({HEADS.replace("{", "").replace("}", "")}), n AS (SELECT id, unnest([lower(short), 'firm ' || id || ' trading']) AS phrase FROM s),
k AS (SELECT 'domain' AS kind, host AS term FROM s WHERE host IS NOT NULL UNION ALL SELECT 'domain', 'alias' || id || '.dev' FROM s WHERE id % 3 = 0
UNION ALL SELECT 'name', lower(short) FROM s UNION ALL SELECT 'alias', 'firm ' || id || ' trading' FROM s
UNION ALL (SELECT 'word', w FROM (SELECT DISTINCT id, unnest(regexp_split_to_array(phrase, '[^a-z0-9]+')) AS w FROM n)))
SELECT kind, term, count(*) AS companies FROM k GROUP BY 1, 2"""


@query(INDEX_SQL)
def src_entity_index(spark, sf):
    """Domains, names, aliases and words by counted frequency, from a stored index;
    blank aliases and those of unknown companies aren't in it."""
    s, path = base(spark, sf, HEADS), scratch.folder(spark, "companies")
    alias = lambda value, kind: F.struct(F.col("id").alias("company_id"), value.alias("alias"), F.lit(kind).alias("alias_type"))
    rows = F.array(alias(F.concat(F.lit("Firm "), "id", F.lit(" Trading ")), "dba"), alias(F.lit("  "), "dba"), F.when(F.col("id") % 3 == 0, alias(F.concat(F.lit("Alias"), "id", F.lit(".dev")), "domain")), F.struct((F.col("id") + 10_000_000).alias("company_id"), F.lit("ghost").alias("alias"), F.lit("dba").alias("alias_type")))
    E.write_index(s.select(F.col("id").alias("company_id"), "name", "website"), s.select(F.explode(F.array_compact(rows)).alias("a")).select("a.*"), path)
    return E.frequencies(spark.read.parquet(f"{path}/terms"))


WRITTEN = "SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_custkey % 4 <> 1"
SECOND = "SELECT c_custkey AS id, c_nationkey + 100 AS nation, CASE WHEN c_custkey % 2 = 0 THEN 'moved' END AS segment FROM customer WHERE c_custkey % 8 < 2"


@query(f"""WITH a AS ({WRITTEN}), z AS ({SECOND})
SELECT 1 AS version, id, nation, segment FROM a UNION ALL SELECT 2, coalesce(a.id, z.id), coalesce(z.nation, a.nation), coalesce(z.segment, a.segment) FROM a FULL JOIN z ON a.id = z.id""")
def snk_write(spark, sf):
    """Two upserts into a bucketed store, read as each left it."""
    c = scan(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    store = S.Store(spark, scratch.folder(spark, "store"), c.schema, ["id"])
    store.create()
    first = store.upsert(c.where("id % 4 <> 1"), {"nation": "last", "segment": "coalesce"}, [F.asc("nation")])
    moved = c.where("id % 8 < 2").select("id", (F.col("nation") + 100).alias("nation"), F.when(F.col("id") % 2 == 0, "moved").alias("segment"))
    second = store.upsert(moved, {"nation": "last", "segment": "coalesce"}, [F.asc("nation")])
    return store.read(first).withColumn("version", F.lit(first)).unionByName(store.read(second).withColumn("version", F.lit(second)))


# Columns and types of the driver's star schema.
COLUMNS = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}
WHOLE = ("int", "bigint")
STATISTICS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{k}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, {f'CAST(min({c}) AS BIGINT)' if k in WHOLE else 'CAST(NULL AS BIGINT)'} AS least, {f'CAST(max({c}) AS BIGINT)' if k in WHOLE else 'CAST(NULL AS BIGINT)'} AS greatest FROM {t}"
    for t, columns in COLUMNS.items()
    for c, k in columns.items()
)


@query(STATISTICS_SQL)
def src_catalog_meta(spark, sf):
    """Rows, nulls and bounds of every column, from the files' footers."""
    return C.statistics(spark, {t: f"{sf}/{t}.parquet" for t in COLUMNS})


UNIQUE = [("nation", ["n_nationkey"]), ("supplier", ["s_suppkey"]), ("orders", ["o_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("lineitem", ["l_suppkey"]), ("events", ["user_id"])]
LINKED = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("lineitem", "l_partkey", "supplier", "s_suppkey")]
CHECKS_SQL = " UNION ALL ".join(
    [f"SELECT '{t}' AS \"table\", 'unique' AS \"check\", '{','.join(k)}' AS columns, count(*) AS violations FROM (SELECT {', '.join(k)} FROM {t} WHERE {' AND '.join(c + ' IS NOT NULL' for c in k)} GROUP BY ALL HAVING count(*) > 1)" for t, k in UNIQUE]
    + [f"SELECT '{t}', 'references', '{c}', count(*) FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {o} WHERE {k} IS NOT NULL)" for t, c, o, k in LINKED]
    + ["SELECT 'documents', 'not null', 'text', count(*) FROM documents WHERE text IS NULL", "SELECT 'labels', 'among', 'quality', count(*) FROM labels WHERE quality NOT IN (0)"]
)


@query(CHECKS_SQL)
def src_catalog_checks(spark, sf):
    """Violations of keys, references, nulls and allowed values."""
    t = lambda name: scan(spark, sf, name)
    found = [C.unique(t(name), name, k) for name, k in UNIQUE] + [C.references(t(name), name, c, t(o), k) for name, c, o, k in LINKED]
    found += [C.not_null(t("documents"), "documents", "text"), C.among(t("labels"), "labels", "quality", [0])]
    return reduce(lambda a, b: a.unionByName(b), found)


@query("SELECT s_suppkey, 'employees,stage' AS fields FROM supplier")
def src_discovery(spark, sf):
    injected = scan(spark, sf, "supplier").select("s_suppkey", F.array(F.lit("employees"), F.lit("stage")).alias("f"))
    return injected.select("s_suppkey", F.array_join("f", ",").alias("fields"))


# Workflow -----------------------------------------------------------------


@query("SELECT id, CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'outreach' WHEN priority = '3-MEDIUM' THEN CASE WHEN amount < 360 THEN 'failed' ELSE 'search' END ELSE 'manual_required' END AS route FROM b", MEMO)
def wf_gap_route(b):
    p, confidence = F.col("priority"), F.col("amount") / 900
    return b.select("id", F.when(p.isin("1-URGENT", "2-HIGH"), "outreach").when(p == "3-MEDIUM", F.when(confidence < 0.4, "failed").otherwise("search")).otherwise("manual_required").alias("route"))


COMPANIES = """SELECT c_custkey AS company_id, c_custkey % 12 AS metric_id, c_name AS company, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS industry, CASE WHEN c_custkey % 3 <> 0 THEN 'c' || CAST(c_custkey AS STRING) || '.com' END AS website, 'growth' AS metric,
  CASE WHEN c_custkey % 2 = 0 THEN 'yearly' END AS description, CASE c_custkey % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'text' END AS value_type, CASE c_custkey % 8 WHEN 0 THEN 'Ask Founders' WHEN 1 THEN 'Tavily' WHEN 2 THEN 'LinkedIn' WHEN 3 THEN 'manual' WHEN 4 THEN NULL ELSE 'Web Search' END AS obtain_method FROM {customer}"""
NEWS = """SELECT o_custkey AS company_id, o_orderkey AS rank, o_orderpriority AS title, 'http://news.example/' || CAST(o_orderkey AS STRING) AS url, CAST(floor(o_totalprice) AS BIGINT) % 50 AS n,
  'Sales of ' || CAST(o_custkey AS STRING) || ' grew ' || CAST(CAST(floor(o_totalprice) AS BIGINT) % 50 AS STRING) || ' percent in ' || CAST(year(o_orderdate) AS STRING) || '.' AS content FROM {orders}"""


def reader(prompt: str) -> str:
    """A provider for queries: drafts a mail, or answers with the first result's percentage;
    how surely, how fenced, and with which quote depends on it, and some calls fail."""
    found = re.search(r"\[1\] .*\nURL: (.*)\nCONTENT: (.* grew (\d+) percent in \d+\.)", prompt)
    if not found:
        return " Hi there, " + ", ".join(re.findall(r"^(?:Company|Metric): (.*)$", prompt, re.M)) + "? The investment team\n"
    url, quote, n = found[1], found[2], int(found[3])
    if n % 7 == 3:
        raise RuntimeError("no answer")
    said = json.dumps({"value": n, "source_url": url, "evidence_quote": f"{n} percent" if n % 4 == 1 else quote, "confidence": n % 10 / 10})
    return f"```json\n[{said}]\n```" if n % 3 == 0 else said


def _web(spark, sf):
    """Search results by company, and the pages they lead to: some lack the quote, some are gone."""
    news = base(spark, sf, NEWS)
    page = F.when(F.col("rank") % 4 == 1, F.upper(F.regexp_replace("content", " ", "  "))).when(F.col("rank") % 4 == 2, "another page altogether").otherwise(F.col("content"))
    return news, news.where("rank % 4 <> 0").select("url", F.concat(F.lit("<p> "), page, F.lit(" </p>")).alias("text"))


READ_SQL = """a AS (SELECT *, n % 7 = 3 AS broke, n <> 0 AND n % 10 >= 4 AS sure, CASE WHEN n % 4 = 1 THEN n || ' percent' ELSE content END AS quote,
  CASE WHEN n % 4 = 1 THEN 'quote_too_short' WHEN rank % 4 = 0 THEN 'fetch_error' WHEN rank % 4 = 2 THEN 'quote_not_in_page' ELSE 'verified' END AS reason FROM r)"""
GAP_FILL_SQL = f"""WITH w AS ({NEWS.replace("{orders}", "orders")}), r AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY rank) = 1), {READ_SQL},
o AS (SELECT b.company_id, b.metric_id, b.company, gap_type, a.n, a.url, a.quote, a.reason, a.sure, CASE gap_type WHEN 'manual_required' THEN 'skipped' WHEN 'outreach' THEN 'drafted' ELSE CASE WHEN broke THEN 'error' WHEN sure THEN 'filled' ELSE 'no_data' END END AS status
  FROM (SELECT *, CASE WHEN obtain_method = 'Ask Founders' THEN 'outreach' WHEN obtain_method IN ('Tavily', 'LinkedIn', 'Web Search') THEN 'search' ELSE 'manual_required' END AS gap_type FROM b) b LEFT JOIN a USING (company_id))"""


def _gaps(b, sf):
    news, pages = _web(b.sparkSession, sf)
    queries = b.select("company_id", AG.metric_query(F.col("company"), F.col("metric"), F.col("website")).alias("query"))
    return AG.fill_gaps(b, news.join(queries, "company_id"), pages, reader)


@query(GAP_FILL_SQL + " SELECT company_id, metric_id, gap_type, status, CASE WHEN status = 'filled' THEN CAST(n AS VARCHAR) END AS value, CASE WHEN status = 'filled' THEN quote END AS evidence_quote, CASE WHEN status = 'filled' THEN reason END AS verify_reason FROM o", COMPANIES)
def wf_gap_fill(b, sf):
    return _gaps(b, sf).select("company_id", "metric_id", "gap_type", "status", "value", "evidence_quote", "verify_reason")


@query(GAP_FILL_SQL + """ SELECT company_id, metric_id, gap_type, CASE status WHEN 'drafted' THEN 'pending' WHEN 'filled' THEN 'resolved' ELSE 'failed' END AS status, CASE status WHEN 'drafted' THEN 'Hi there, ' || company || ', growth? The investment team'
  WHEN 'filled' THEN 'Value: ' || n || chr(10) || 'Source: ' || url || chr(10) || 'Quote: ' || quote || chr(10) || 'Verified: ' || CAST(reason = 'verified' AS VARCHAR) || ' (' || reason || ')' ELSE 'No confident match found.' END AS output_draft FROM o WHERE status NOT IN ('skipped', 'error')""", COMPANIES)
def wf_gap_actions(b, sf):
    return AG.gap_actions(_gaps(b, sf))


@query("SELECT company_id, metric_id, 'Hi there, ' || company || ', growth? The investment team' AS output_draft, 'pending' AS status FROM b WHERE obtain_method = 'Ask Founders'", COMPANIES)
def wf_outreach_llm(b, sf):
    """Drafts for the gaps that only founders can fill, logged and not sent."""
    return AG.gap_actions(_gaps(b.where(F.col("obtain_method").isin(AG.FOUNDER)), sf)).drop("gap_type")


MARKET_AT = "DATE '1998-09-01'"
MARKET = """SELECT company_id, metric_id, value, raw_evidence, evidence_url, url_verified, confidence, captured_by, captured_at, override, row_number() OVER (PARTITION BY company_id, metric_id ORDER BY override DESC, captured_at DESC, value DESC) = 1 AS is_latest, metric, value_type
FROM (SELECT o_custkey AS company_id, 1 + o_orderkey % 3 AS metric_id, CAST(o_orderkey AS STRING) AS value, o_orderpriority AS raw_evidence, CAST(NULL AS STRING) AS evidence_url, false AS url_verified, CAST(0.5 AS DOUBLE) AS confidence, 'seed' AS captured_by, CAST(o_orderdate AS DATE) AS captured_at,
  o_orderkey % 10 = 0 AS override, CASE o_orderkey % 3 WHEN 0 THEN 'TAM' WHEN 1 THEN 'CAGR' ELSE 'growth' END AS metric, CASE o_orderkey % 3 WHEN 1 THEN 'number' END AS value_type FROM {orders}) x"""
MARKET_SQL = f"""WITH c AS (SELECT c_custkey AS company_id, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS industry FROM customer), w AS ({NEWS.replace("{orders}", "orders")}),
r AS (SELECT w.*, industry FROM w JOIN c USING (company_id) WHERE industry IS NOT NULL AND n <> 0 QUALIFY row_number() OVER (PARTITION BY industry ORDER BY rank) = 1), {READ_SQL},
o AS (SELECT b.company_id, b.metric_id, CASE WHEN broke THEN 'error' WHEN sure THEN 'updated' ELSE 'no_data' END AS status, n, url, quote, reason, (n % 10)::DOUBLE / 10 AS sureness FROM b LEFT JOIN c USING (company_id) LEFT JOIN a USING (industry) WHERE is_latest AND NOT override AND captured_at < {MARKET_AT} - INTERVAL 180 DAY)"""


def _market(b, sf):
    spark = b.sparkSession
    news, pages = _web(spark, sf)
    companies = base(spark, sf, COMPANIES).select("company_id", "industry")
    results = news.where("n <> 0").join(companies, "company_id").where("industry is not null").withColumn("query", AG.market_query(F.col("industry")))
    return AG.refresh_market(b, companies, results, pages, reader, F.expr(MARKET_AT))


@query(MARKET_SQL + " SELECT company_id, metric_id, status, CASE WHEN status = 'updated' THEN CAST(n AS VARCHAR) END AS value, CASE WHEN status = 'updated' THEN url END AS source_url, CASE WHEN status = 'updated' THEN reason = 'verified' END AS url_verified FROM o", MARKET)
def wf_market_refresh(b, sf):
    return _market(b, sf).select("company_id", "metric_id", "status", "value", "source_url", "url_verified")


@query(MARKET_SQL + f""", h AS (SELECT company_id, metric_id, value, captured_by, captured_at, override, url_verified, confidence FROM b UNION ALL SELECT company_id, metric_id, CAST(n AS VARCHAR), 'market_agent', {MARKET_AT}, false, reason = 'verified', sureness FROM o WHERE status = 'updated')
SELECT *, row_number() OVER (PARTITION BY company_id, metric_id ORDER BY override DESC, captured_at DESC, captured_by DESC, value DESC) = 1 AS is_latest FROM h""", MARKET)
def wf_market_history(b, sf):
    """History after a refresh: new values are the latest ones, those that an analyst holds stay."""
    added = AG.new_values(_market(b, sf), "updated", "market_agent", F.expr(MARKET_AT))
    return AG.with_values(b, added).drop("raw_evidence", "evidence_url")


STORED = """SELECT o_orderkey AS value_id, o_custkey AS company_id, o_orderkey % 12 AS metric_id, CAST(CAST(floor(o_totalprice) AS BIGINT) % 50 AS STRING) AS value,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS evidence, CAST(NULL AS STRING) AS url, CASE o_orderkey % 4 WHEN 0 THEN 'Alpha_Scout run' WHEN 1 THEN 'analyst' END AS captured_by,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS captured_at, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(0.5 AS DOUBLE) END AS confidence, o_orderkey % 10 = 0 AS override, o_orderkey % 3 <> 0 AS is_latest,
  CASE WHEN o_orderkey % 13 = 0 THEN CAST(7 AS BIGINT) END AS winning_observation_id FROM {orders}"""
TWICE = f"{STORED} UNION ALL SELECT value_id + 1000000000, company_id, metric_id, value, evidence, url, 'alpha_scout', captured_at, confidence, override, true, NULL FROM ({STORED}) WHERE value_id % 9 = 0"
BACKFILL_SQL = """WITH v AS (SELECT *, CASE WHEN override THEN 'analyst_override' WHEN contains(lower(captured_by), 'alpha_scout') THEN 'alpha_scout_v1' ELSE 'seed_data_v1' END AS extractor,
  md5(company_id || '||' || metric_id || '||' || value || '||' || coalesce(evidence, '') || '||' || coalesce(CAST(captured_at AS VARCHAR), '')) AS fingerprint FROM b),
r AS (SELECT extractor, company_id, row_number() OVER (ORDER BY company_id, extractor) AS run_id FROM (SELECT DISTINCT extractor, company_id FROM v)),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY company_id, metric_id, captured_at NULLS FIRST, value_id) = 1),
o AS (SELECT f.*, run_id, row_number() OVER (ORDER BY company_id, metric_id, captured_at NULLS FIRST, value_id) AS observation_id FROM f JOIN r USING (extractor, company_id))"""


@query(BACKFILL_SQL + " SELECT run_id, extractor, company_id, 'success' AS status, count(observation_id) AS observations FROM r LEFT JOIN o USING (run_id, extractor, company_id) GROUP BY ALL", TWICE)
def wf_backfill(b):
    return BF.backfill(b).runs


@query(BACKFILL_SQL + " SELECT observation_id, run_id, company_id, metric_id, value, evidence, coalesce(confidence, 1.0) AS confidence, captured_at, fingerprint FROM o", TWICE)
def wf_backfill_observations(b):
    return BF.backfill(b).observations.drop("url")


@query(BACKFILL_SQL + " SELECT value_id, observation_id FROM o WHERE is_latest AND NOT override AND winning_observation_id IS NULL", TWICE)
def wf_backfill_links(b):
    """Links of a backfill and of a second one after it, which adds none."""
    once = BF.backfill(b)
    return once.links.unionByName(BF.backfill(b, once.runs, once.observations).links)


HOST_ = r"nullif(regexp_replace(regexp_extract(lower(CASE WHEN regexp_matches(website, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN website ELSE 'http://' || website END), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1), '^www\.', ''), '')"


@query(f"SELECT DISTINCT id AS company_id, {HOST_} AS alias FROM b WHERE website IS NOT NULL AND id % 8 <> 0", NAMES)
def wf_domain_alias_seed(b):
    found = b.select(F.col("id").alias("company_id"), X.host(F.col("website")).alias("alias")).where("alias is not null")
    return ST.insert_ignore(found.where("company_id % 8 = 0"), found, ["company_id", "alias"], [F.lit(1)])


@query(f"SELECT id AS company_id, name AS alias FROM b UNION SELECT id, {HOST_} FROM b WHERE website IS NOT NULL", NAMES)
def wf_alias_seed_new(b):
    text = F.concat(F.lit("slides.pdf at "), F.coalesce(X.host(F.col("website")), F.lit("")))
    return b.select(F.col("id").alias("company_id"), F.col("name").alias("alias")).unionByName(b.select(F.col("id").alias("company_id"), F.explode(X.domains(text)).alias("alias"))).distinct()


@query("SELECT c_nationkey, '# ' || CAST(c_nationkey AS VARCHAR) || chr(10) || string_agg('- ' || c_name, chr(10) ORDER BY c_name) AS brief FROM customer WHERE c_acctbal > 9000 GROUP BY 1")
def wf_share_brief(spark, sf):
    c = scan(spark, sf, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_name")).alias("n"))
    return c.select("c_nationkey", F.concat(F.lit("# "), F.col("c_nationkey").cast("string"), F.lit("\n"), F.array_join(F.transform("n", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("brief"))


@query("SELECT c_custkey, 'Hi ' || c_name || ', please send: ' || lower(c_mktsegment) AS mail FROM customer WHERE c_acctbal < 0")
def wf_outreach_template(spark, sf):
    return scan(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey", F.concat(F.lit("Hi "), "c_name", F.lit(", please send: "), F.lower("c_mktsegment")).alias("mail"))


@query("SELECT user_id, coalesce(max(ts) < TIMESTAMP '2024-01-23 00:00:00', true) AS refetch FROM events GROUP BY 1")
def wf_news_ttl(spark, sf):
    cut = F.expr("timestamp_ntz'2024-01-30 00:00:00' - interval 7 days")
    return scan(spark, sf, "events").groupBy("user_id").agg(F.coalesce(F.max("ts") < cut, F.lit(True)).alias("refetch"))


@query("SELECT page_id, length(html) <= 10485760 AND starts_with(html, '<!DOCTYPE') AS accepted FROM pages")
def wf_upload_guard(spark, sf):
    return scan(spark, sf, "pages").select("page_id", (F.length("html") <= 10 * 1024 * 1024).alias("a"), F.col("html").startswith("<!DOCTYPE").alias("z")).select("page_id", (F.col("a") & F.col("z")).alias("accepted"))


# Services and sinks -------------------------------------------------------


def echo(prompt: str) -> str:
    """A provider for tests and queries: answers with the prompt's length."""
    return str(len(prompt))


@query("SELECT s_suppkey, CAST(length('Metric of ' || s_name) AS VARCHAR) AS answer FROM supplier")
def src_llm(spark, sf):
    prompts = scan(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("Metric of "), "s_name").alias("prompt"))
    return P.ask(prompts, echo).select("s_suppkey", "answer")


@query("SELECT c_custkey, c_custkey % 3 = 0 AS found FROM customer")
def src_web_search(spark, sf):
    q = scan(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" news")).alias("query"))
    injected = q.where("c_custkey % 3 = 0").select("query", F.lit(1).alias("rank"), F.lit("t").alias("title"), F.lit("http://x").alias("url"), F.lit("c").alias("content"))
    return P.web_results(q, injected).select("c_custkey", "found")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'seeded'")
def snk_seed(spark, sf):
    n = scan(spark, sf, "nation").select("n_nationkey", "n_name")
    return K.seed(spark, [(3, "ignored"), (100, "seeded")], "n_nationkey int, n_name string", n, ["n_nationkey"], [F.asc("n_name")])


@query("SELECT day, CAST(least(n, 40) AS BIGINT) AS granted FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)")
def wf_llm_budget(spark, sf):
    """The cap as a query: calls granted each day. The guard itself is sources.providers.Budget."""
    days = scan(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return days.select("day", F.least("n", F.lit(40)).cast("long").alias("granted"))
