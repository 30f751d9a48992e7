"""Grounding: is a claim in the text, and how surely."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Weights of fields; domains that prove nothing.
FIELDS = {"name": 3.0, "website": 2.0, "description": 1.0, "location": 1.0, "sector": 1.0, "founders": 1.0, "funding_stage": 0.5, "funding_amount": 0.5}
GENERIC = ["linkedin.com", "crunchbase.com", "twitter.com", "facebook.com", "instagram.com", "youtube.com", "medium.com", "github.com", "techcrunch.com", "forbes.com", "bloomberg.com", "reuters.com", "wamda.com", "magnitt.com", "zawya.com"]


def name_confidence(name: Column, text: Column) -> Column:
    """Whole name 1.0, first of several words .7, without a suffix .6, else 0."""
    low = F.lower(text)
    words = F.split(F.trim(name), r"\s+")
    bare = F.lower(F.regexp_replace(name, r"(?i) (ai|tech|inc|ltd|llc|co|labs|io)\z", ""))
    return (
        F.when(low.contains(F.lower(name)), 1.0)
        .when((F.size(words) > 1) & (F.length(words[0]) >= 3) & low.contains(F.lower(words[0])), 0.7)
        .when((F.length(bare) >= 3) & (bare != F.lower(name)) & low.contains(bare), 0.6)
        .otherwise(0.0)
    )


def website_confidence(website: Column, name: Column, text: Column) -> Column:
    """Generic 0; name in domain .9, its first word .7, URL in text 1.0, domain in text .8."""
    host = X.host(website)
    plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    first = F.regexp_replace(F.lower(F.split(name, r"\s+")[0]), "[^a-z0-9]", "")
    flat = F.regexp_replace(host, "[^a-z0-9]", "")
    low = F.lower(text)
    return F.when(host.isNull() | reduce(lambda a, b: a | b, [host.contains(d) for d in GENERIC]), 0.0).when(flat.contains(plain), 0.9).when((F.length(first) >= 3) & flat.contains(first), 0.7).when(low.contains(F.lower(website)), 1.0).when(low.contains(host), 0.8).otherwise(0.0)


def claim_confidence(claim: Column, text: Column) -> Column:
    """Verbatim 1.0; of longer claims two of the first five words of 4 letters: .5 + .1 each, .8 at most."""
    low = F.lower(text)
    words = F.slice(F.filter(F.split(F.lower(claim), r"\s+"), lambda w: F.length(w) >= 4), 1, 5)
    n = F.size(F.filter(words, lambda w: low.contains(w)))
    return F.when(low.contains(F.lower(claim)), 1.0).when((F.length(claim) > 20) & (n >= 2), F.least(F.lit(0.8), 0.5 + 0.1 * n)).otherwise(0.0)


def source_confidence(claim: Column, text: Column) -> Column:
    """Verbatim 1.0; half of the words of 4 letters .6; else 0."""
    low = F.lower(text)
    words = F.filter(F.split(F.lower(claim), r"\s+"), lambda w: F.length(w) >= 4)
    n = F.size(F.filter(words, lambda w: low.contains(w)))
    return F.when(low.contains(F.lower(claim)), 1.0).when((F.size(words) > 0) & (n / F.size(words) >= 0.5), 0.6).otherwise(0.0)


#: Fields whose text is looked for as a claim.
CLAIMS = ["description", "location", "sector", "funding_stage", "funding_amount"]


def ground_fields(record: DataFrame, keys: list[str], text: str = "text", fields: list[str] | None = None) -> DataFrame:
    """(keys, field, confidence, grounded, best) for each field of a record that is there.

    fields: those of FIELDS among the columns, unless given. name, website and claims have
    their own rules; founders, an array, counts as its best one, named in `best` (the first
    among equals). A null field, and founders without a name, give no row; a null text
    grounds nothing. All fields are one array on the record's row: no shuffle, one scan.
    """
    has = fields or [f for f in FIELDS if f in record.columns]
    page = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col("name"), F.lit("")) if "name" in record.columns else F.lit("")

    def found(field: str) -> Column:
        x, no = F.col(field), F.lit(None).cast("string")
        if field == "founders":
            each = F.transform(F.filter(x, lambda f: F.trim(f) != ""), lambda f: F.struct(F.coalesce(claim_confidence(f, page), F.lit(0.0)).alias("c"), f.alias("f")))
            top = F.array_max(F.transform(each, lambda e: e["c"]))
            best = F.get(F.filter(each, lambda e: e["c"] == top), F.lit(0))["f"]
            return F.when(top.isNotNull(), F.struct(F.lit(field).alias("field"), top.alias("confidence"), best.alias("best")))
        score = name_confidence(x, page) if field == "name" else website_confidence(x, name, page) if field == "website" else claim_confidence(x, page)
        score = F.when((F.trim(x) == "") | (page == ""), 0.0).otherwise(F.coalesce(score, F.lit(0.0)))
        return F.when(x.isNotNull(), F.struct(F.lit(field).alias("field"), score.alias("confidence"), no.alias("best")))

    rows = record.select(*keys, F.array_compact(F.array(*[found(f) for f in has])).alias("_g")).withColumn("_g", F.explode_outer("_g")).where("_g is not null")
    return rows.select(*keys, "_g.field", "_g.confidence", (F.col("_g.confidence") > 0).alias("grounded"), "_g.best")


def record_score(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score): the weighted mean of a record's fields, as ground_fields gives them."""
    weights = F.create_map(*[F.lit(v) for kv in FIELDS.items() for v in kv])
    w = F.coalesce(F.try_element_at(weights, "field"), F.lit(1.0))
    return evidence.groupBy(*keys).agg((F.sum(w * F.col("confidence")) / F.sum(w)).alias("score"))


def grounding_score(fields: dict[str, Column]) -> Column:
    """Weighted average of the confidences of the fields given (null fields left out)."""
    weight = {k: FIELDS.get(k, 1.0) for k in fields}
    total = reduce(lambda a, b: a + b, [F.coalesce(c * weight[k], F.lit(0.0)) for k, c in fields.items()])
    over = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), weight[k]).otherwise(0.0) for k, c in fields.items()])
    return total / F.nullif(over, F.lit(0.0))


def quote_check(quote: Column, text: Column, least: int = 20) -> Column:
    """verified, too_short, no_page or not_found, on normalised text."""
    q, t = X.normal_quote(quote), X.normal_quote(text)
    return F.when(F.length(F.trim(quote)) < least, "too_short").when(text.isNull(), "no_page").when(t.contains(q), "verified").otherwise("not_found")


# Confidences of a site that has the name, its first word in the title, in the page, or two of its words.
WHOLE, IN_TITLE, IN_PAGE, SOME = 1.0, 0.8, 0.7, 0.6


def page_title(html: Column) -> Column:
    """The title in small letters; empty if there is none."""
    return F.trim(F.regexp_extract(F.lower(html), r"<title[^>]*>([^<]+)</title>", 1))


def site_confidence(name: Column, html: Column) -> Column:
    """How sure it is that a page is of the company: whole name, else the first word of
    three letters in the title or the page, else two of such words; 0 for none. The
    whole page counts, and a null page or a blank name gives 0."""
    page, clean = F.lower(F.coalesce(html, F.lit(""))), F.trim(F.lower(F.coalesce(name, F.lit(""))))
    words = F.filter(F.split(clean, r"\s+"), lambda w: F.length(w) >= 3)
    first = F.get(words, F.lit(0))
    hits = F.size(F.filter(words, lambda w: F.contains(page, w)))
    out = F.when((clean != "") & F.contains(page, clean), WHOLE).when(F.contains(page_title(page), first), IN_TITLE).when(F.contains(page, first), IN_PAGE)
    return out.when(hits >= 2, SOME).otherwise(0.0)
