"""Scoring, resolver, joins, windows, set operations and state over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fold as W
from ..operators import resolve as R
from ..operators import score as S
from ..operators import agents as AG
from ..operators import state as T
from ..sources import documents as D
from ..sources import scratch
from ..streaming import ingest
from .registry import base, query, scan

FOLD_SQL = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY {entity} ORDER BY {order}) AS rn FROM ({log})),
rules(a, e, z) AS (VALUES {rules}),
f AS (SELECT {entity}, CAST(0 AS BIGINT) AS rn, CAST(NULL AS {id}) AS {key}, '{start}' AS from_state, '{start}' AS to_state, true AS legal, CAST(NULL AS DOUBLE) AS noted FROM n WHERE rn = 1
  UNION ALL SELECT n.{entity}, n.rn, n.{key}, f.to_state, coalesce(r.z, f.to_state), r.z IS NOT NULL, coalesce(n.note, f.noted)
  FROM f JOIN n ON n.{entity} IS NOT DISTINCT FROM f.{entity} AND n.rn = f.rn + 1 LEFT JOIN rules r ON r.a = f.to_state AND r.e = n.event)"""


def _fold_sql(machine, log, entity, order, key, id="BIGINT"):
    rules = ", ".join(str((a, e, z)) for (a, e), z in machine.rules.items())
    return FOLD_SQL.format(log=log, entity=entity, order=order, key=key, id=id, start=machine.start, rules=rules)


OBS = """
SELECT l_suppkey AS company_id, l_partkey % 12 AS metric_id,
  CASE WHEN l_returnflag = 'A' THEN 'actual' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'estimate' WHEN l_returnflag = 'R' THEN 'projection' WHEN l_linestatus = 'O' THEN 'forecast' END AS scenario,
  CASE WHEN l_linenumber <> 7 THEN last_day(CAST(l_shipdate AS DATE)) END AS as_of_date,
  l_linenumber AS source_priority, l_shipdate AS captured_at, l_discount AS confidence, CAST(floor(l_quantity) AS INT) AS value,
  l_orderkey AS k1, l_partkey AS k2, l_linenumber AS k3, l_extendedprice AS k4
FROM {lineitem}"""
TIE = ["k1", "k2", "k3", "k4"]
RANK = "CASE scenario WHEN 'actual' THEN 0 WHEN 'estimate' THEN 2 WHEN 'projection' THEN 3 WHEN 'forecast' THEN 4 ELSE 1 END"
WIN = f"row_number() OVER (PARTITION BY company_id, metric_id ORDER BY {RANK}, as_of_date DESC NULLS LAST, source_priority, captured_at DESC NULLS LAST, confidence DESC NULLS LAST, k1, k2, k3, k4)"
VALS = """
SELECT l_suppkey AS company_id, p_type AS mtype, p_brand AS metric,
  CASE WHEN (l_suppkey + p_size) % 13 = 0 OR (l_suppkey + length(p_type)) % 7 = 0 THEN NULL ELSE CAST(max(CAST(floor(l_quantity) AS BIGINT)) % 5 + 1 AS DOUBLE) END AS score, CAST(max(l_partkey) % 3 + 1 AS DOUBLE) AS weight
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_suppkey, p_type, p_brand, p_size"""
TYPES = "SELECT p_type AS mtype, p_type IN ('ECONOMY', 'MEDIUM', 'PROMO', 'LARGE') AS must_have, CAST(length(p_type) AS DOUBLE) / 4 AS weight FROM {part} GROUP BY p_type"
FIN = """
SELECT o_custkey AS company_id, CASE o_orderkey % 5 WHEN 0 THEN 'gross_margin' WHEN 1 THEN 'runway_months' WHEN 2 THEN 'revenue' WHEN 3 THEN 'burn_rate' ELSE 'funding_stage' END AS code,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) AS x, CASE WHEN o_orderkey % 2 = 0 THEN 'month' ELSE 'year' END AS granularity FROM {orders}"""
T_LIVE = "t AS (SELECT company_id, mtype, round(sum(score * weight) FILTER (score IS NOT NULL) / nullif(sum(weight) FILTER (score IS NOT NULL), 0), 2) AS score FROM b GROUP BY 1, 2)"
T_DIM = TYPES.replace("{", "").replace("}", "")


def _types(spark, sf):
    return base(spark, sf, TYPES)


@query(f"SELECT company_id, metric_id, scenario, as_of_date, value, confidence FROM (SELECT *, {WIN} AS rn FROM b) WHERE rn = 1", OBS)
def win_resolver_pick(b):
    return R.pick(b, ["company_id", "metric_id"], TIE).select("company_id", "metric_id", "scenario", "as_of_date", "value", "confidence")


@query(f"SELECT company_id, metric_id, value FROM (SELECT *, {WIN.replace('as_of_date DESC NULLS LAST, source_priority, captured_at DESC NULLS LAST, ', 'as_of_date DESC NULLS LAST, ')} AS rn FROM b) WHERE rn = 1", OBS)
def win_pick_demo(b):
    order = [R.scenario_rank(F.col("scenario")), F.col("as_of_date").desc_nulls_last(), F.col("confidence").desc_nulls_last(), *TIE]
    return T.first_by(b, ["company_id", "metric_id"], order).select("company_id", "metric_id", "value")


@query(f"SELECT company_id, count(*) AS metrics, sum(value) AS total FROM (SELECT *, {WIN} AS rn FROM b) WHERE rn = 1 GROUP BY 1", OBS)
def qry_resolve_all(b):
    return R.pick(b, ["company_id", "metric_id"], TIE).groupBy("company_id").agg(F.count("*").alias("metrics"), F.sum("value").alias("total"))


@query(f"SELECT company_id, count(*) AS metrics, sum(value) AS total FROM (SELECT *, {WIN} AS rn FROM b) WHERE rn = 1 GROUP BY 1", OBS)
def str_ingest_winners(b):
    """The rows of qry_resolve_all from a stream of several batches with keyed state."""
    spark, at = b.sparkSession, scratch.folder(b.sparkSession, "stream")
    dealt = D.spread(b, 500_000)
    dealt.write.parquet(f"{at}/in")  # a file for each task
    most = -(-dealt.rdd.getNumPartitions() // 4)  # four batches, however many files
    source = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", most).parquet(f"{at}/in")
    keys = ["company_id", "metric_id"]
    ingest.to_gold(source, f"{at}/gold", f"{at}/checkpoint", keys, TIE, {"availableNow": True}).awaitTermination()
    return ingest.winners(spark, f"{at}/gold", keys).groupBy("company_id").agg(F.count("*").alias("metrics"), F.sum("value").alias("total"))


PVA = """WITH r AS (SELECT company_id, metric_id, as_of_date, value, CASE WHEN scenario = 'actual' THEN 'a' ELSE 'p' END AS kind FROM b WHERE scenario IS NOT NULL AND as_of_date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY company_id, metric_id, as_of_date, CASE WHEN scenario = 'actual' THEN 'a' ELSE 'p' END ORDER BY captured_at DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) = 1)
SELECT p.company_id, p.metric_id, p.as_of_date, p.value AS projected, a.value AS actual, a.value - p.value AS delta, CASE WHEN p.value <> 0 THEN round((a.value - p.value) * 100.0::DOUBLE / abs(p.value), 4) END AS delta_pct
FROM r p JOIN r a ON p.company_id = a.company_id AND p.metric_id = a.metric_id AND p.as_of_date = a.as_of_date WHERE p.kind = 'p' AND a.kind = 'a'"""


@query(PVA, OBS)
def qry_projection_vs_actual(b):
    return R.projection_vs_actual(b, ["company_id", "metric_id"], TIE)


@query("""WITH r AS (SELECT company_id, metric_id, as_of_date, max(value) FILTER (scenario <> 'actual') AS projected, max(value) FILTER (scenario = 'actual') AS actual FROM b WHERE scenario IS NOT NULL AND as_of_date IS NOT NULL GROUP BY ALL)
SELECT *, actual - projected AS delta FROM r WHERE projected IS NOT NULL AND actual IS NOT NULL""", OBS)
def jn_projection_actual(b):
    """Greatest projected against greatest actual value of a target date, by one join."""
    keys = ["company_id", "metric_id", "as_of_date"]
    rows = b.where("scenario is not null and as_of_date is not null")
    side = lambda c, name: rows.where(c).groupBy(*keys).agg(F.max("value").alias(name))
    both = side("scenario <> 'actual'", "projected").join(side("scenario = 'actual'", "actual"), keys)
    return both.withColumn("delta", F.col("actual") - F.col("projected"))


@query("SELECT company_id, metric_id, as_of_date, k1, row_number() OVER (PARTITION BY company_id, metric_id, as_of_date ORDER BY captured_at DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) AS rn FROM b", OBS)
def win_row_number(b):
    w = Window.partitionBy("company_id", "metric_id", "as_of_date").orderBy(F.desc("captured_at"), *[F.desc(t) for t in TIE])
    return b.select("company_id", "metric_id", "as_of_date", "k1", F.row_number().over(w).alias("rn"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1 THEN md5(text) ELSE md5(text) || ':' || CAST(doc_id AS VARCHAR) END AS fp FROM documents")
def win_disambiguate(spark, sf):
    d = scan(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    rn = F.row_number().over(Window.partitionBy("h").orderBy("doc_id"))
    return d.select("doc_id", F.when(rn == 1, F.col("h")).otherwise(F.concat("h", F.lit(":"), "doc_id")).alias("fp"))


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def win_distinct_on(spark, sf):
    e = scan(spark, sf, "events")
    return T.first_by(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts").orderBy(F.desc("ts"))


@query("SELECT l_suppkey, l_partkey, l_shipdate, l_quantity FROM lineitem WHERE l_suppkey = 7 AND l_partkey % 12 = 3")
def qry_value_history(spark, sf):
    li = scan(spark, sf, "lineitem").where("l_suppkey = 7 and l_partkey % 12 = 3")
    return li.select("l_suppkey", "l_partkey", "l_shipdate", "l_quantity").orderBy(F.desc("l_shipdate"), "l_partkey")


@query("SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_stage FROM events")
def qry_stage_history(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return scan(spark, sf, "events").select("event_id", "user_id", "event_type", F.lag("event_type").over(w).alias("from_stage"))


@query(f"WITH b AS ({OBS.replace('{', '').replace('}', '')}) SELECT v.company_id, s_name AS company, v.metric_id, v.value FROM (SELECT *, {WIN} AS rn FROM b) v LEFT JOIN supplier ON s_suppkey = v.company_id WHERE rn = 1")
def qry_latest_values(spark, sf):
    latest = R.pick(base(spark, sf, OBS), ["company_id", "metric_id"], TIE)
    s = scan(spark, sf, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company"))
    return latest.join(s, "company_id", "left").select("company_id", "company", "metric_id", "value")


@query("SELECT doc_id, coalesce(quality, toxic, 0) AS flag FROM documents LEFT JOIN labels USING (doc_id)")
def srt_coalesce_desc(spark, sf):
    d, l = scan(spark, sf, "documents").select("doc_id"), scan(spark, sf, "labels")
    return d.join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", "toxic", F.lit(0)).alias("flag")).orderBy(F.desc("flag"), "doc_id")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def srt_multi(spark, sf):
    return scan(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal").orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def lim_topk(spark, sf):
    c = scan(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return T.top_k(c, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query("SELECT DISTINCT l_suppkey, l_partkey % 12 AS metric_id FROM lineitem")
def set_distinct(spark, sf):
    return scan(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 12).alias("metric_id")).distinct()


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def set_union_all(spark, sf):
    c = scan(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(scan(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def set_difference(spark, sf):
    used = scan(spark, sf, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return scan(spark, sf, "part").select("p_partkey").subtract(used)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    return scan(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(scan(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


# Scoring ------------------------------------------------------------------


@query("SELECT company_id, mtype, round(sum(score * weight) / nullif(sum(weight), 0), 4) AS avg FROM b GROUP BY 1, 2", VALS)
def agg_weighted_avg_view(b):
    return b.groupBy("company_id", "mtype").agg(F.round(F.sum(F.col("score") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0)), 4).alias("avg"))


@query("SELECT company_id, bool_and(score IS NOT NULL) AS complete FROM b GROUP BY 1", VALS)
def agg_bool_and(b):
    return b.groupBy("company_id").agg(F.bool_and(F.col("score").isNotNull()).alias("complete"))


@query("SELECT company_id, round(exp(sum(ln(greatest(s, 0.01) / 5))), 6) AS product FROM (SELECT company_id, mtype, coalesce(avg(score), 0.01) AS s FROM b GROUP BY 1, 2) GROUP BY 1", VALS)
def agg_product(b):
    per = b.groupBy("company_id", "mtype").agg(F.coalesce(F.avg("score"), F.lit(0.01)).alias("s"))
    return per.groupBy("company_id").agg(F.round(F.exp(F.sum(F.ln(F.greatest("s", F.lit(0.01)) / 5))), 6).alias("product"))


@query(f"WITH {T_LIVE} SELECT company_id, round(sum(score * length(mtype)) / nullif(sum(CASE WHEN score IS NOT NULL THEN length(mtype) END), 0), 4) AS base FROM t GROUP BY 1", VALS)
def agg_base_score(b):
    t = S.type_scores(b)
    return t.groupBy("company_id").agg(F.round(S.weighted_average(F.col("score"), F.length("mtype").cast("double")), 4).alias("base"))


@query(f"WITH {T_LIVE} SELECT * FROM t", VALS)
def agg_type_score_live(b):
    return S.type_scores(b)


CARD = f"""WITH {T_LIVE}, d AS ({T_DIM}), g AS (SELECT s_suppkey AS company_id, d.* FROM supplier CROSS JOIN d),
f AS (SELECT g.*, t.score FROM g LEFT JOIN t ON g.company_id = t.company_id AND g.mtype = t.mtype),
a AS (SELECT company_id, sum(score * weight) FILTER (score IS NOT NULL) / nullif(sum(weight) FILTER (score IS NOT NULL), 0) AS base, min(score) FILTER (must_have) AS weakest,
  coalesce(string_agg(mtype, ',' ORDER BY mtype) FILTER (must_have AND score IS NULL), '') AS missing FROM f GROUP BY 1)
SELECT company_id, round(base, 4) AS base, CASE WHEN missing = '' THEN round(weakest / 5, 4) END AS multiplier, CASE WHEN missing = '' THEN round(base * weakest / 5, 4) END AS overall, missing FROM a"""


def _suppliers(spark, sf):
    return scan(spark, sf, "supplier").select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("name"))


def _card(spark, sf):
    return S.scorecard(S.type_scores(base(spark, sf, VALS)), _suppliers(spark, sf), _types(spark, sf))


VALS_SQL = VALS.replace("{", "").replace("}", "")
CARD_SQL = CARD.replace("WITH ", f"WITH b AS ({VALS_SQL}), ", 1)


@query(CARD_SQL)
def qry_scorecard(spark, sf):
    return _card(spark, sf)


@query(f"SELECT company_id, missing FROM ({CARD_SQL}) WHERE missing <> ''")
def agg_missing_types(spark, sf):
    return _card(spark, sf).where("missing <> ''").select("company_id", "missing")


@query(f"SELECT company_id, s_name AS name, overall, row_number() OVER (ORDER BY overall DESC NULLS LAST, s_name) AS place FROM ({CARD_SQL}) c JOIN supplier ON s_suppkey = company_id")
def qry_rank_all(spark, sf):
    named = S.rank(_card(spark, sf).join(_suppliers(spark, sf), "company_id"))
    return named.select("company_id", "name", "overall", F.row_number().over(Window.orderBy(F.col("overall").desc_nulls_last(), "name", "company_id")).alias("place"))


@query(f"""WITH b AS ({VALS_SQL}), d AS ({T_DIM}), p AS (SELECT company_id, b.mtype, must_have, d.weight AS tw, sum(score * b.weight) / nullif(sum(b.weight), 0) AS ts, bool_and(score IS NOT NULL) AS ok FROM b JOIN d ON b.mtype = d.mtype GROUP BY ALL),
c AS (SELECT company_id, sum(ts * tw) / nullif(sum(tw), 0) AS base, bool_and(ok) FILTER (must_have) AS complete, exp(sum(ln(greatest(coalesce(ts, 0.01), 0.01) / 5)) FILTER (must_have)) AS penalty FROM p GROUP BY 1)
SELECT s_suppkey AS company_id, CASE WHEN c.company_id IS NOT NULL AND coalesce(complete, true) THEN round(base * coalesce(penalty, 1.0), 2) END AS score FROM supplier LEFT JOIN c ON s_suppkey = c.company_id""")
def qry_score_view(spark, sf):
    return S.score_view(base(spark, sf, VALS), _suppliers(spark, sf), _types(spark, sf))


@query("""WITH w AS (SELECT company_id, max(x) FILTER (code = 'gross_margin') AS gm, max(x) FILTER (code = 'runway_months') AS rw, max(x) FILTER (code = 'revenue') AS rev, max(x) FILTER (code = 'burn_rate') AS burn,
  bool_or(granularity = 'month') FILTER (code = 'burn_rate') AS monthly, max(x) FILTER (code = 'funding_stage') AS st FROM b GROUP BY 1),
p AS (SELECT company_id, CASE WHEN gm IS NOT NULL THEN least(5, greatest(1, gm / 20)) END AS a, CASE WHEN rw IS NOT NULL THEN least(5, greatest(1, rw / 6)) END AS r,
  CASE WHEN burn > 0 AND rev IS NOT NULL THEN least(5, greatest(1, 1 + 2 * (rev / CASE WHEN monthly THEN burn * 12 ELSE burn END))) END AS u, CASE WHEN st IS NOT NULL THEN least(5, greatest(1, st)) END AS s FROM w)
SELECT company_id, round((coalesce(a * 0.35::DOUBLE, 0) + coalesce(r * 0.25::DOUBLE, 0) + coalesce(u * 0.25::DOUBLE, 0) + coalesce(s * 0.15::DOUBLE, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN r IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN u IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN s IS NULL THEN 0 ELSE 0.15::DOUBLE END, 0), 4) AS financials,
  (a IS NOT NULL)::INT + (r IS NOT NULL)::INT + (u IS NOT NULL)::INT + (s IS NOT NULL)::INT AS n_inputs FROM p""", FIN)
def agg_financials(b):
    return S.financials(b, digits=4)


@query("SELECT s_suppkey, p_brand FROM supplier CROSS JOIN (SELECT DISTINCT p_brand FROM part WHERE p_type = 'PROMO') WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN part p ON l_partkey = p.p_partkey WHERE l_suppkey = s_suppkey AND p.p_brand = part.p_brand AND l_quantity > 40)".replace("(SELECT DISTINCT p_brand FROM part WHERE p_type = 'PROMO')", "(SELECT DISTINCT p_brand FROM part WHERE p_type = 'PROMO') part"))
def qry_missing_must_haves(spark, sf):
    part = scan(spark, sf, "part")
    need = part.where("p_type = 'PROMO'").select("p_brand").distinct()
    have = scan(spark, sf, "lineitem").where("l_quantity > 40").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("s_suppkey"), "p_brand").distinct()
    grid = scan(spark, sf, "supplier").select("s_suppkey").crossJoin(F.broadcast(need))  # brands are a dimension
    return grid.join(have, ["s_suppkey", "p_brand"], "left_anti")


@query("SELECT max(ts) AS newest FROM events")
def agg_max(spark, sf):
    return scan(spark, sf, "events").agg(F.max("ts").alias("newest"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def agg_count_group(spark, sf):
    return scan(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def agg_count_filter_join(spark, sf):
    c = scan(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'")
    return scan(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.count("*").alias("n"))


@query("SELECT source, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 4) AS good, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 4) AS toxic, round(avg(CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END), 4) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def agg_enrichment_rates(spark, sf):
    l = scan(spark, sf, "labels").withColumn("has", F.lit(True))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    return scan(spark, sf, "documents").select("doc_id", "source").join(l, "doc_id", "left").groupBy("source").agg(rate(F.col("quality") == 1).alias("good"), rate(F.col("toxic") == 1).alias("toxic"), rate(F.col("has")).alias("labelled"))


@query("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def agg_coverage_counts(spark, sf):
    return scan(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT event_type AS stage, count(*) AS companies FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1) GROUP BY 1")
def agg_stage_funnel(spark, sf):
    last = scan(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"))
    return last.groupBy("stage").agg(F.count("*").alias("companies"))


# Joins --------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P'")
def jn_inner_equi(spark, sf):
    o = scan(spark, sf, "orders").where("o_orderstatus = 'P'")
    c, n = scan(spark, sf, "customer"), scan(spark, sf, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def jn_left_outer(spark, sf):
    o = scan(spark, sf, "orders").where("o_totalprice > 400000")
    c = scan(spark, sf, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus, c_name, n_name, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P' LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2 LEFT JOIN region ON n_regionkey = r_regionkey")
def jn_provenance_chain(spark, sf):
    t = lambda n: scan(spark, sf, n)
    return (
        t("lineitem")
        .join(t("orders").where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(F.broadcast(t("nation").where("n_regionkey <> 2")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("l_orderkey", "l_linenumber", "l_partkey", "o_orderstatus", "c_name", "n_name", "r_name")
    )


@query("SELECT l_orderkey, l_linenumber, o_orderpriority, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
def jn_resolver_candidates(spark, sf):
    li = scan(spark, sf, "lineitem")
    return li.join(scan(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(scan(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "o_orderpriority", "p_brand")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def jn_semi(spark, sf):
    o = scan(spark, sf, "orders").where("o_totalprice > 450000")
    return scan(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def jn_anti(spark, sf):
    o = scan(spark, sf, "orders").where("o_orderstatus = 'P'")
    return scan(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT doc_id, CASE WHEN rn > 1 THEN md5(text) || ':' || CAST(doc_id AS VARCHAR) ELSE md5(text) END AS fp FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) rn FROM documents)")
def jn_update_from(spark, sf):
    d = scan(spark, sf, "documents").select("doc_id", F.md5("text").alias("fp"))
    ranked = d.withColumn("rn", F.row_number().over(Window.partitionBy("fp").orderBy("doc_id"))).where("rn > 1").select("doc_id", F.concat("fp", F.lit(":"), "doc_id").alias("new"))
    return d.join(ranked, "doc_id", "left").select("doc_id", F.coalesce("new", "fp").alias("fp"))


@query("SELECT r.r_regionkey AS k, coalesce(CAST(n.n_regionkey * 10 AS DOUBLE), CAST(r.r_regionkey AS DOUBLE)) AS weight FROM region r FULL JOIN (SELECT DISTINCT n_regionkey FROM nation WHERE n_regionkey > 1) n ON r.r_regionkey = n.n_regionkey")
def jn_dict_merge(spark, sf):
    house = scan(spark, sf, "region").select(F.col("r_regionkey").alias("mtype"), F.col("r_regionkey").cast("double").alias("weight"))
    own = scan(spark, sf, "nation").where("n_regionkey > 1").select(F.col("n_regionkey").alias("mtype"), (F.col("n_regionkey") * 10.0).alias("weight")).distinct()
    return S.weights(house, own).select(F.col("mtype").alias("k"), "weight")


@query("SELECT a.c_nationkey AS k, len(list_intersect(a.segs, b.segs)) > 0 AS overlaps FROM (SELECT c_nationkey, list(DISTINCT c_mktsegment) AS segs FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a JOIN (SELECT c_nationkey, list(DISTINCT c_mktsegment) AS segs FROM customer WHERE c_acctbal < 0 GROUP BY 1) b USING (c_nationkey)")
def jn_domain_set(spark, sf):
    c = scan(spark, sf, "customer")
    side = lambda w, n: c.where(w).groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias(n))
    return side("c_acctbal > 9000", "a").join(side("c_acctbal < 0", "z"), "c_nationkey").select(F.col("c_nationkey").alias("k"), F.arrays_overlap("a", "z").alias("overlaps"))


# State --------------------------------------------------------------------


@query(f"WITH old AS (SELECT * FROM b WHERE k3 <= 3), new AS (SELECT * FROM b WHERE k3 > 3) SELECT company_id, metric_id, value, k1, row_number() OVER (PARTITION BY company_id, metric_id ORDER BY captured_at DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC) = 1 AS is_latest FROM b", OBS)
def mut_scd_latest(b):
    rows = b.withColumn("override", F.lit(False)).withColumn("is_latest", F.lit(False))
    return T.scd_latest(rows.where("k3 <= 3"), rows.where("k3 > 3"), ["company_id", "metric_id"], "captured_at", TIE).select("company_id", "metric_id", "value", "k1", "is_latest")


@query(f"SELECT company_id, metric_id, CASE WHEN company_id % 10 = 0 THEN -1 ELSE value END AS value, company_id % 10 = 0 AS override FROM (SELECT *, {WIN} AS rn FROM b) WHERE rn = 1", OBS)
def mut_resolver_store(b):
    winners = R.pick(b, ["company_id", "metric_id"], TIE).select("company_id", "metric_id", "value")
    locked = b.where("company_id % 10 = 0").select("company_id", "metric_id").distinct().withColumn("value", F.lit(-1))
    free = T.unlocked(winners, locked, ["company_id", "metric_id"]).withColumn("override", F.lit(False))
    return free.unionByName(locked.withColumn("override", F.lit(True)))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents WHERE doc_id % 2 = 1 AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY 2")
def mut_insert_ignore(spark, sf):
    d = scan(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    return T.insert_ignore(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["h"], [F.asc("doc_id")])


UPS = "SELECT c_custkey % 700 AS k, c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name, c_custkey % 5 = 0 AS verified FROM {customer}"
O, Nw = "(SELECT * FROM b WHERE id < 500)", "(SELECT * FROM b WHERE id >= 500 QUALIFY row_number() OVER (PARTITION BY k ORDER BY id DESC) = 1)"


def _ups(b, rules):
    return T.upsert(b.where("id < 500"), b.where("id >= 500"), ["k"], rules, [F.desc("id")])


@query(f"SELECT coalesce(o.k, n.k) AS k, coalesce(n.name, o.name) AS name, coalesce(o.verified, false) OR coalesce(n.verified, false) AS verified, coalesce(o.id, n.id) AS id FROM {O} o FULL JOIN {Nw} n ON o.k = n.k", UPS)
def mut_upsert_coalesce(b):
    return _ups(b, {"name": "coalesce", "verified": "or", "id": "keep"})


@query(f"SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS name FROM {O} o FULL JOIN {Nw} n ON o.k = n.k", UPS)
def mut_upsert_founder(b):
    return _ups(b, {"name": "last"})


@query(f"SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(o.id, n.id) AS id FROM {O} o FULL JOIN {Nw} n ON o.k = n.k", UPS)
def mut_upsert_news(b):
    return _ups(b, {"name": "last", "id": "keep"})


@query(f"SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.id ELSE o.id END AS id FROM {O} o FULL JOIN {Nw} n ON o.k = n.k", UPS)
def mut_upsert_weight(b):
    return _ups(b, {"id": "last"})


@query("""WITH d AS (SELECT doc_id, md5(text) AS h FROM documents), o AS (SELECT h, min(doc_id) AS doc_id FROM d WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT h, min(doc_id) AS doc_id FROM d WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT n.h, coalesce(o.doc_id, n.doc_id) AS doc_id, o.h IS NULL AS created FROM n LEFT JOIN o ON n.h IS NOT DISTINCT FROM o.h""")
def mut_upsert_document(spark, sf):
    """Documents by content hash against those that are stored: which row answers, and whether it is new."""
    d = scan(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    old = d.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("doc_id"))
    return T.get_or_create(old, d.where("doc_id % 2 = 1").select("h", "doc_id"), ["h"], [F.asc("doc_id")])[1]


@query("SELECT conv_id, turn, CASE WHEN max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) = 1 THEN max(CASE WHEN role = 'assistant' THEN text END) ELSE max(text) END AS text FROM conversations GROUP BY 1, 2")
def mut_upsert_chunks(spark, sf):
    c = scan(spark, sf, "conversations")
    old = c.where("role <> 'assistant' or role is null").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    return T.upsert(old, c.where("role = 'assistant'"), ["conv_id", "turn"], {"text": "last"}, [F.desc("text")])


@query("SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def mut_insert_alias(spark, sf):
    old = scan(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    return T.insert_ignore(old, scan(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), ["k"], [F.asc("k")])


@query("SELECT s_suppkey, lower(s_name) AS key, s_name FROM supplier WHERE s_suppkey % 2 = 1")
def mut_create_company(spark, sf):
    s = scan(spark, sf, "supplier").select("s_suppkey", F.lower("s_name").alias("key"), "s_name")
    return T.insert_ignore(s.where("s_suppkey % 2 = 0"), s, ["key"], [F.asc("s_suppkey")])


RUN_LOG = """SELECT o_orderkey AS run_id, 0 AS step, 'start' AS event, CAST(NULL AS DOUBLE) AS note FROM {orders}
UNION ALL SELECT o_orderkey, 1, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'error' END, CAST(0 AS DOUBLE) FROM {orders}
UNION ALL SELECT o_orderkey, 2, 'start', NULL FROM {orders} WHERE o_orderkey % 5 = 0
UNION ALL SELECT l_orderkey, 3, CASE WHEN max(l_linenumber) > 3 THEN 'success' ELSE 'error' END, CAST(count(*) AS DOUBLE) FROM {lineitem} GROUP BY l_orderkey"""


@query(_fold_sql(W.RUNS, RUN_LOG.replace("{", "").replace("}", ""), "run_id", "step", "step", "INT") + " SELECT run_id, arg_max(to_state, rn) AS status, CAST(coalesce(max(noted) FILTER (legal AND from_state = 'running'), 0) AS BIGINT) AS observations, count(*) FILTER (NOT legal) AS refused FROM f GROUP BY 1")
def mut_run_lifecycle(spark, sf):
    """Runs from a log of starts and finishes: a run finishes once, by its first good
    finish; a second start or finish, or one of no kind, is refused."""
    log = base(spark, sf, RUN_LOG)
    folded = W.fold(log, W.RUNS, "run_id", ["step"], "event", "note")
    closed = F.max(F.when(F.col("legal") & (F.col("from_state") == "running"), F.col("noted")))
    return folded.groupBy("run_id").agg(F.max_by("to_state", "step").alias("status"), F.coalesce(closed, F.lit(0)).cast("long").alias("observations"), F.count_if(~F.col("legal")).alias("refused"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'new' END, c_mktsegment) AS source, c_custkey % 4 = 0 AS verified FROM customer")
def mut_founder_verified(spark, sf):
    c = scan(spark, sf, "customer")
    found = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("new"))
    return c.join(found, "c_custkey", "left").select("c_custkey", F.coalesce("new", "c_mktsegment").alias("source"), F.col("new").isNotNull().alias("verified"))


MARKED = """SELECT page_id AS id, url, CASE page_id % 5 WHEN 0 THEN 'brief' WHEN 1 THEN 'nobody ever wrote these words here' WHEN 2 THEN NULL ELSE upper(substring(regexp_replace(html, '[^ -~]', ''), 20, 60)) END AS quote, page_id % 7 = 0 AS url_verified, CASE WHEN page_id % 7 = 0 THEN DATE '2024-01-01' END AS url_verified_at,
  CASE WHEN page_id % 6 <> 0 THEN regexp_replace(html, '[^ -~]', '') END AS page FROM {pages}"""


@query(r"""WITH n AS (SELECT id, url, quote, url_verified, url_verified_at, page, regexp_replace(trim(regexp_replace(lower(quote), '\s+', ' ', 'g')), ' ([,.;:)\]!?])', '\1', 'g') AS q, regexp_replace(trim(regexp_replace(lower(page), '\s+', ' ', 'g')), ' ([,.;:)\]!?])', '\1', 'g') AS t FROM b),
u AS (SELECT url, q, bool_or(contains(t, q)) AS hit FROM (SELECT DISTINCT n.q, m.url, m.t FROM n JOIN n m USING (url)) GROUP BY ALL)
SELECT id, CASE WHEN id % 3 = 0 THEN url_verified ELSE coalesce(length(quote) >= 20 AND hit, false) END AS url_verified, CASE WHEN id % 3 = 0 THEN url_verified_at ELSE DATE '2024-06-01' END AS url_verified_at FROM n LEFT JOIN u USING (url, q)""", MARKED)
def mut_mark_url(b):
    """Flags of stored quotes set by a check against their pages; rows that weren't checked keep theirs."""
    pages = b.select("url", F.col("page").alias("text"))
    checked = AG.verify_urls(b.where("id % 3 <> 0").select("id", "url", "quote"), pages, "url", "quote")
    return AG.mark_urls(b.select("id", "url_verified", "url_verified_at"), checked, ["id"], F.expr("DATE '2024-06-01'"))


STAGES = ["signup", "view", "click", "purchase"]
ALLOWED = {"signup": ["view", "click"], "view": ["click", "signup"], "click": ["view", "purchase"], "purchase": ["signup"]}
MOVES = W.moves(STAGES, "signup", ALLOWED)
MOVES_SQL = _fold_sql(MOVES, "SELECT user_id, event_id, ts, event_type AS event, CASE WHEN event_type = 'error' THEN value END AS note FROM events", "user_id", "ts, event_id", "event_id")


def _moves(spark, sf):
    """Stage transitions of users; what isn't allowed (errors too) is reported, and scores come with errors."""
    e = scan(spark, sf, "events").withColumn("score", F.when(F.col("event_type") == "error", F.col("value")))
    return W.fold(e, MOVES, "user_id", ["ts", "event_id"], "event_type", "score")


@query(MOVES_SQL + " SELECT event_id, user_id, from_state, to_state, legal, noted AS score_snapshot FROM f WHERE rn > 0")
def mut_stage_events(spark, sf):
    """Every event with the stage before and after it and the score at that time."""
    return _moves(spark, sf).select("event_id", "user_id", "from_state", "to_state", "legal", F.col("noted").alias("score_snapshot"))


@query(MOVES_SQL + " SELECT user_id, arg_max(to_state, rn) AS state, count(*) FILTER (legal AND rn > 0) AS moves, count(*) FILTER (NOT legal) AS refused FROM f GROUP BY 1")
def mut_stage_transition(spark, sf):
    return W.current(_moves(spark, sf), "user_id", ["ts", "event_id"])


@query("SELECT event_id, user_id, event_type FROM events UNION ALL SELECT event_id + 1000000, user_id, 'review' FROM events WHERE event_type = 'click'")
def mut_add_event(spark, sf):
    e = scan(spark, sf, "events").select("event_id", "user_id", "event_type")
    return e.unionByName(e.where("event_type = 'click'").select((F.col("event_id") + 1000000).alias("event_id"), "user_id", F.lit("review").alias("event_type")))


@query("SELECT DISTINCT lower(n_name) AS name FROM nation UNION SELECT lower(r_name) FROM region")
def mut_get_or_create_source(spark, sf):
    old = scan(spark, sf, "nation").select(F.lower("n_name").alias("name"))
    new = scan(spark, sf, "region").select(F.lower("r_name").alias("name"))
    return old.distinct().unionByName(T.insert_ignore(old, new, ["name"], [F.asc("name")]))


@query("SELECT c_custkey, m, v FROM (SELECT c_custkey, 'employees' AS m, CAST(c_custkey % 300 + 1 AS VARCHAR) AS v FROM customer UNION ALL SELECT c_custkey, 'year', CAST(1900 + c_custkey % 200 AS VARCHAR) FROM customer WHERE 1900 + c_custkey % 200 BETWEEN 1950 AND 2100 UNION ALL SELECT c_custkey, 'stage', CAST(c_nationkey % 5 + 1 AS VARCHAR) || '.0' FROM customer) WHERE NOT (c_custkey % 9 = 0 AND m = 'stage')")
def mut_discovery_seed(spark, sf):
    c = scan(spark, sf, "customer")
    year = 1900 + F.col("c_custkey") % 200
    three = F.stack(F.lit(3), F.lit("employees"), (F.col("c_custkey") % 300 + 1).cast("string"), F.lit("year"), F.when(year.between(1950, 2100), year.cast("string")), F.lit("stage"), (F.col("c_nationkey") % 5 + 1).cast("double").cast("string"))
    rows = c.select("c_custkey", three.alias("m", "v")).where("v is not null")
    locked = c.where("c_custkey % 9 = 0").select("c_custkey", F.lit("stage").alias("m"))
    return T.unlocked(rows, locked, ["c_custkey", "m"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey <> 7")
def mut_delete_force(spark, sf):
    return scan(spark, sf, "lineitem").where(~F.col("l_suppkey").eqNullSafe(7)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'added' WHEN p_partkey % 4 = 0 THEN CASE WHEN p_partkey % 8 = 0 THEN lower(p_type) ELSE 'code_' || p_partkey END ELSE lower(p_type) END AS code,
  p_partkey % 3 <> 0 AND p_partkey % 4 = 0 AND p_partkey % 8 <> 0 AS changed FROM part""")
def mut_metric_codes(spark, sf):
    """Codes set by id where they differ, and metrics inserted that aren't there."""
    p = scan(spark, sf, "part").select("p_partkey", F.lower("p_type").alias("code"))
    codes = p.where("p_partkey % 4 = 0").select("p_partkey", F.when(F.col("p_partkey") % 8 == 0, F.col("code")).otherwise(F.concat(F.lit("code_"), "p_partkey")).alias("code"))
    known = T.set_codes(p.where("p_partkey % 3 <> 0"), codes, "p_partkey", "code")
    added = T.insert_ignore(known, p.select("p_partkey", F.lit("added").alias("code"), F.lit(False).alias("changed")), ["p_partkey"], [F.asc("code")])
    return known.unionByName(added)


GAP_LOG = "SELECT o_custkey * 10 + o_orderkey % 7 AS gap_id, o_orderdate AS day, o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'log' WHEN 1 THEN 'sent' WHEN 2 THEN 'resolved' ELSE 'log' END AS event, CAST(NULL AS DOUBLE) AS note FROM {orders}"
GAP_SQL = _fold_sql(W.GAPS, GAP_LOG.replace("{", "").replace("}", ""), "gap_id", "day, id", "id")


@query(GAP_SQL + " SELECT gap_id, arg_max(to_state, rn) AS state, count(*) FILTER (legal AND rn > 0) AS moves, count(*) FILTER (NOT legal) AS refused FROM f GROUP BY 1")
def mut_gap_log(spark, sf):
    """Gap actions from their log: logged once, then sent and resolved."""
    return W.current(W.fold(base(spark, sf, GAP_LOG), W.GAPS, "gap_id", ["day", "id"], "event", "note"), "gap_id", ["day", "id"])
