"""Missing and stale metrics filled from a web search and a language model: query,
results, prompt, answer, gate, check of the quote on its page, and what is written.

The model and the search are injected. Requests that are alike (one industry's market,
say) are asked once and the answers joined back. Outcomes are written to scratch
once, since every read of them would ask the model again; actions and values follow
from them by projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_text import recovered
from ..functions.text import normal_quote
from ..sources.providers import ask
from ..sources.scratch import saved
from .state import broadcast_if_small, scd_latest

# How metrics are obtained, least confidence, shortest quote, results of a search and their length, days until a market value is stale.
WEB, FOUNDER = ["Tavily", "LinkedIn", "Web Search"], ["Ask Founders"]
LEAST, QUOTE, RESULTS, CONTENT, STALE = 0.4, 20, 5, 800, 180
# Forms of a value by type.
FORMS = {"boolean": "true or false", "score_1_5": "a digit from 1 to 5", "number": "a number without a unit", "text": "a phrase of at most 60 characters"}


def _said(c: Column, other: str = "") -> Column:
    return F.coalesce(c, F.lit(other))


def metric_query(company: Column, metric: Column, website: Column) -> Column:
    return F.concat(_said(company), F.lit(" "), _said(metric), F.lit(" "), _said(website))


def founder_query(founder: Column, company: Column) -> Column:
    return F.concat(F.lit('"'), _said(founder), F.lit('" "'), _said(company), F.lit('" site:linkedin.com/in/'))


def market_query(industry: Column) -> Column:
    """A null or empty industry counts as technology."""
    return F.concat(F.coalesce(F.nullif(industry, F.lit("")), F.lit("technology")), F.lit(" industry market size growth CAGR 2025 2026"))


def news_query(company: Column, industry: Column) -> Column:
    return F.trim(F.concat(_said(company), F.lit(" "), _said(industry), F.lit(" startup funding news")))


def value_form(value_type: Column) -> Column:
    out = F.lit("a short text")
    for kind, form in FORMS.items():
        out = F.when(value_type == kind, form).otherwise(out)
    return out


def _lines(**parts: Column) -> Column:
    return F.concat(*[x for label, c in parts.items() for x in (F.lit(f"{label}: "), _said(c), F.lit("\n"))])


def search_prompt(company: Column, industry: Column, website: Column, metric: Column, description: Column, value_type: Column, block: Column) -> Column:
    """Asks for one value of one company, or of an industry where company is null."""
    about = F.when(company.isNotNull(), _lines(Company=company, Website=website)).otherwise("")
    rule = "Answer with one JSON object: value, source_url, evidence_quote, confidence (0 to 1). Copy the quote from one result letter by letter; take no other company's figures and mix no sources. Where nothing fits, the first three are null and confidence is 0.\n\n"
    return F.concat(F.lit("Find one value in the search results below.\n"), about, _lines(Industry=industry, Metric=metric, Description=description, Value=value_form(value_type)), F.lit(rule), block)


def outreach_prompt(company: Column, industry: Column, metric: Column, description: Column) -> Column:
    rule = "Write the body of a short, friendly mail to the founder (six sentences at most) that asks for this one figure and says why it counts. Begin with 'Hi there,' and sign as the investment team. Invent nothing and leave no gaps to fill in.\n"
    return F.concat(F.lit(rule), _lines(Company=_said(company, "your company"), Industry=_said(industry, "your sector"), Metric=metric, Description=_said(description, "none")))


def result_blocks(results: DataFrame) -> DataFrame:
    """(query, block): the first RESULTS results of each query (query, rank, title,
    url, content) as numbered text. Null contents are empty; ties by url, title and
    content. Ranks are cut before rows meet, so a hot query is no hot task."""
    order = [F.asc_nulls_last(c) for c in ("rank", "url", "title", "content")]
    place = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    top = results.select("query", "rank", "title", "url", "content").where("query is not null").withColumn("_k", place).where(F.col("_k") <= RESULTS)
    text = F.concat(F.lit("["), F.col("_k").cast("string"), F.lit("] "), _said(F.col("title")), F.lit("\nURL: "), _said(F.col("url")), F.lit("\nCONTENT: "), F.substring(_said(F.col("content")), 1, CONTENT))
    parts = F.array_sort(F.collect_list(F.struct("_k", text.alias("text"))))  # RESULTS at most
    return top.groupBy("query").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("block"))


_ANSWER = ["value", "source_url", "evidence_quote"]


def read_answers(answers: DataFrame) -> DataFrame:
    """answers (answer) with value, source_url, evidence_quote, confidence and
    `confident`: all there and the confidence LEAST or more. An answer is an object, or
    the first of a list; a value of 0, false or no characters counts as none, and so
    does a confidence that is no number."""
    found = answers.withColumn("_v", F.try_parse_json(recovered(F.col("answer"))))
    found = found.withColumn("_v", F.when(F.schema_of_variant("_v").startswith("ARRAY"), F.try_variant_get("_v", "$[0]", "variant")).otherwise(F.col("_v")))
    found = found.withColumn("_v", F.when(F.schema_of_variant("_v").startswith("OBJECT"), F.col("_v")))
    value = F.try_variant_get("_v", "$.value", "variant")
    plain = F.schema_of_variant(value)
    text = F.try_variant_get("_v", "$.value", "string")
    none = (plain == "BOOLEAN") & (text == "false") | plain.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get("_v", "$.value", "double") == 0)
    found = found.withColumn("value", F.when(~F.coalesce(none, F.lit(False)), F.nullif(text, F.lit(""))))
    for name in _ANSWER[1:]:
        found = found.withColumn(name, F.nullif(F.try_variant_get("_v", f"$.{name}", "string"), F.lit("")))
    sure = F.try_variant_get("_v", "$.confidence", "double")
    found = found.withColumn("confidence", F.when(~F.isnan(sure), sure)).drop("_v")
    there = [F.col(c).isNotNull() for c in _ANSWER]
    return found.withColumn("confident", there[0] & there[1] & there[2] & F.coalesce(F.col("confidence") >= LEAST, F.lit(False)))


def verify_urls(rows: DataFrame, pages: DataFrame, url: str = "source_url", quote: str = "evidence_quote") -> DataFrame:
    """rows with url_verified and verify_reason: missing_input, quote_too_short,
    fetch_error (no page (url, text), or one without text), verified or
    quote_not_in_page. Of several pages of a URL one with the quote is enough. Each pair
    of URL and quote is looked up once, and page texts are never joined to rows."""
    pairs = rows.select(F.col(url).alias("_u"), F.col(quote).alias("_q")).where((F.col("_u") != "") & (F.length("_q") >= QUOTE)).distinct()
    seen = pages.select(F.col("url").alias("_u"), F.col("text").alias("_t")).where("_t is not null").join(broadcast_if_small(pairs), "_u")
    hits = seen.groupBy("_u", "_q").agg(F.bool_or(F.contains(normal_quote(F.col("_t")), normal_quote(F.col("_q")))).alias("_hit"))
    hits = hits.withColumnsRenamed({"_u": "_hu", "_q": "_hq"})
    j = rows.join(broadcast_if_small(hits), (F.col(url) == F.col("_hu")) & (F.col(quote) == F.col("_hq")), "left")
    missing = F.coalesce(F.col(url), F.lit("")).eqNullSafe("") | F.coalesce(F.col(quote), F.lit("")).eqNullSafe("")
    reason = F.when(missing, "missing_input").when(F.length(quote) < QUOTE, "quote_too_short").when(F.col("_hit").isNull(), "fetch_error").when(F.col("_hit"), "verified").otherwise("quote_not_in_page")
    return j.withColumn("verify_reason", reason).withColumn("url_verified", reason == "verified").drop("_hu", "_hq", "_hit")


def mark_urls(rows: DataFrame, checked: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """rows (keys, url_verified, url_verified_at) with what verify_urls says of their keys, at
    that time; of several checks of a key one that holds is enough. Rows without a
    check stay as they are, and a check without a row adds none."""
    marks = checked.groupBy(*[F.col(k).alias(f"_m_{k}") for k in keys]).agg(F.bool_or("url_verified").alias("_ok"))
    on = [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys]
    j = rows.join(broadcast_if_small(marks), on, "left")
    j = j.withColumns({"url_verified": F.coalesce("_ok", "url_verified"), "url_verified_at": F.when(F.col("_ok").isNotNull(), at).otherwise(F.col("url_verified_at"))})
    return j.drop("_ok", *[f"_m_{k}" for k in keys])


def _asked(requests: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """requests with answer and error; equal prompts are asked once. Prompts go to the
    provider with their keys, and only keys and answers come back."""
    key = F.sha2("prompt", 256)
    once = requests.select("prompt").where("prompt is not null").distinct().withColumn("_k", key)
    return requests.withColumn("_k", key).join(ask(once, provider, keep=["_k"]), "_k", "left").drop("_k")


def fill_gaps(gaps: DataFrame, results: DataFrame, pages: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """One outcome for each gap (company_id, metric_id, company, industry, website,
    metric, description, value_type, obtain_method; other columns are dropped).

    gap_type: outreach (a draft is written), search (the value is looked for) or
    manual_required (any other method, null too). status: drafted, filled, no_data,
    skipped, or error where the model failed. Without search results the model isn't
    asked. Nothing is sent. Repeated gaps have repeated outcomes.
    """
    method = F.col("obtain_method")
    kind = F.when(method.isin(FOUNDER), "outreach").when(method.isin(WEB), "search").otherwise("manual_required")
    names = ["company_id", "metric_id", "company", "industry", "website", "metric", "description", "value_type"]
    routed = gaps.select(*names, kind.alias("gap_type")).withColumn("query", F.when(F.col("gap_type") == "search", metric_query(F.col("company"), F.col("metric"), F.col("website"))))
    j = routed.join(result_blocks(results), "query", "left")
    c = {n: F.col(n) for n in names}
    search = F.when(F.col("block").isNotNull(), search_prompt(_said(c["company"]), c["industry"], c["website"], c["metric"], c["description"], c["value_type"], F.col("block")))
    prompt = F.when(F.col("gap_type") == "outreach", outreach_prompt(c["company"], c["industry"], c["metric"], c["description"])).when(F.col("gap_type") == "search", search)
    # Read before they are saved: the check reads its rows several times.
    answered = saved(read_answers(_asked(j.select("company_id", "metric_id", "gap_type", prompt.alias("prompt")), provider).drop("prompt")), "gaps")
    checked = verify_urls(answered, pages)
    failed = F.col("error").isNotNull()
    status = F.when(F.col("gap_type") == "manual_required", "skipped").when(failed, "error").when(F.col("gap_type") == "outreach", "drafted").when(F.col("confident"), "filled").otherwise("no_data")
    draft = F.when(F.col("gap_type") == "outreach", F.regexp_replace("answer", r"(?U)^\s+|\s+\z", ""))
    filled = lambda name: F.when(F.col("status") == "filled", F.col(name)).alias(name)
    out = checked.withColumn("status", status)
    return out.select("company_id", "metric_id", "gap_type", "status", draft.alias("draft"), "error", *[filled(n) for n in (*_ANSWER, "confidence", "url_verified", "verify_reason")])


def gap_actions(outcomes: DataFrame) -> DataFrame:
    """Log rows (company_id, metric_id, gap_type, output_draft, status) of outcomes: drafts
    are pending, searches resolved or failed; what was skipped or broke off has none."""
    found = F.concat(F.lit("Value: "), "value", F.lit("\nSource: "), "source_url", F.lit("\nQuote: "), "evidence_quote", F.lit("\nVerified: "), F.col("url_verified").cast("string"), F.lit(" ("), "verify_reason", F.lit(")"))
    text = F.when(F.col("status") == "drafted", F.col("draft")).when(F.col("status") == "filled", found).otherwise("No confident match found.")
    state = F.when(F.col("status") == "drafted", "pending").when(F.col("status") == "filled", "resolved").otherwise("failed")
    return outcomes.where(F.col("status").isin("drafted", "filled", "no_data")).select("company_id", "metric_id", "gap_type", text.alias("output_draft"), state.alias("status"))


HISTORY = ["value", "raw_evidence", "evidence_url", "url_verified", "confidence", "captured_by", "captured_at", "override"]


def new_values(outcomes: DataFrame, done: str, agent: str, at: Column) -> DataFrame:
    """History rows (company_id, metric_id, HISTORY) of the outcomes with status `done`."""
    renamed = {"raw_evidence": F.col("evidence_quote"), "evidence_url": F.col("source_url"), "captured_by": F.lit(agent), "captured_at": at, "override": F.lit(False)}
    return outcomes.where(F.col("status") == done).select("company_id", "metric_id", *[renamed.get(c, F.col(c)).alias(c) for c in HISTORY])


def stale(history: DataFrame, at: Column, days: int = STALE) -> DataFrame:
    """Current rows older than so many days that no analyst holds; a null time is not stale."""
    return history.where(F.col("is_latest") & ~F.coalesce("override", F.lit(False)) & (F.col("captured_at") < F.date_sub(at, days)))


def refresh_market(history: DataFrame, companies: DataFrame, results: DataFrame, pages: DataFrame, provider: Callable[[str], str], at: Column, days: int = STALE) -> DataFrame:
    """One outcome for each stale row of history (company_id, metric_id, metric, value_type,
    captured_at, override, is_latest), with companies (company_id, industry).

    status: updated, no_data or error; a value is written with its check, whether the
    quote was found or not. Companies of one industry, metric and type share one
    request. Companies that aren't there count as of the industry technology.
    """
    due = stale(history, at, days).select("company_id", "metric_id", "metric", "value_type")
    known = companies.groupBy("company_id").agg(F.min("industry").alias("industry"))
    due = due.join(known, "company_id", "left").withColumn("industry", F.coalesce(F.nullif("industry", F.lit("")), F.lit("technology")))
    due = saved(due, "stale")
    topics = ["industry", "metric", "value_type"]
    asks = due.select(*topics).distinct().withColumn("query", market_query(F.col("industry"))).join(result_blocks(results), "query", "left")
    none = F.lit(None).cast("string")
    prompt = F.when(F.col("block").isNotNull(), search_prompt(none, F.col("industry"), none, F.col("metric"), none, F.col("value_type"), F.col("block")))
    answered = saved(read_answers(_asked(asks.select(*topics, prompt.alias("prompt")), provider).drop("prompt")), "markets")
    checked = verify_urls(answered, pages)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("confident"), "updated").otherwise("no_data")
    checked = checked.withColumn("status", status)
    kept = [F.when(F.col("status") == "updated", F.col(n)).alias(n) for n in (*_ANSWER, "confidence", "url_verified", "verify_reason")]
    told = checked.select(*[F.col(t).alias(f"_{t}") for t in topics], "status", "error", *kept)
    on = [F.col(t).eqNullSafe(F.col(f"_{t}")) for t in topics]
    return due.join(broadcast_if_small(told), on[0] & on[1] & on[2]).drop(*[f"_{t}" for t in topics])


def with_values(history: DataFrame, added: DataFrame) -> DataFrame:
    """history (company_id, metric_id, HISTORY, is_latest) with new rows: the newest of each
    company and metric is the latest one, and rows that an analyst holds take none."""
    columns = ["company_id", "metric_id", *HISTORY]
    return scd_latest(history.select(*columns, "is_latest"), added.select(*columns).withColumn("is_latest", F.lit(True)), ["company_id", "metric_id"], "captured_at", ["captured_by", "value", "evidence_url"])
