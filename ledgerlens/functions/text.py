"""Text expressions: white space, quotes, domains, tokens. All Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from company names and from file names.
SUFFIXES = "inc incorporated ltd limited llc l.l.c. corp corporation co company gmbh ag sa s.a. plc technologies tech holdings holding group ventures fz-llc fz pte pty".split()
NOISE = "deck pitch pitchdeck slides series round seed preseed v1 v2 v3 final draft confidential copy report summary".split()
FILE_ENDINGS = "pdf ppt pptx doc docx xls xlsx csv png jpg jpeg gif txt".split()


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normal_quote(text: Column) -> Column:
    """Lower case, single spaces, none before closing punctuation."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), r" ([,.;:)\]!?])", "$1")


def context(text: Column, start: Column, length: Column, window: int = 30) -> Column:
    """Slice of window characters on either side of a 1-based match."""
    low = F.greatest(F.lit(1), start - window)
    high = F.least(F.length(text) + 1, start + length + window)
    return F.substring(text, low, high - low)


def find_exact(needle: Column, text: Column) -> Column:
    """1-based position of needle in text, whatever the case; null if not there."""
    at = F.position(F.lower(needle), F.lower(text))
    return F.when((at > 0) & (F.length(needle) > 0), at)


def clean_row(row: Column) -> Column:
    return F.transform(row, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def host(url: Column) -> Column:
    """Host without www. and port, in lower case; a missing scheme is fine."""
    full = F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url))
    h = F.regexp_extract(F.lower(full), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def domains(text: Column) -> Column:
    """Distinct domain-like tokens, sorted, without file names."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b((?:[a-z0-9-]+\.)+[a-z]{2,})\b"), F.lit(1))
    bare = F.transform(found, lambda d: F.regexp_replace(d, r"^www\.", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda d: ~F.substring_index(d, ".", -1).isin(FILE_ENDINGS))))


def domain_root(domain: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(domain), r"^www\.", ""), r"\.")[0]


def _tokens(text: Column) -> Column:
    return F.split(F.lower(text), r"[^a-z0-9]+")


def file_tokens(name: Column) -> Column:
    """Words of a file name without its ending (all after the last dot)."""
    return F.filter(_tokens(F.regexp_replace(name, r"\.[^.]*\z", "")), lambda t: (F.length(t) >= 3) & ~t.isin(NOISE))


def name_tokens(name: Column) -> Column:
    return F.filter(_tokens(name), lambda t: (F.length(t) >= 2) & ~t.isin(SUFFIXES))


def strip_suffixes(name: Column) -> Column:
    """The name without the suffixes at its end. Dots and commas after a word don't
    count, so suffixes that end in a dot are never met, as in the fixed rule."""
    met = "|".join(s for s in SUFFIXES if not s.endswith("."))
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), rf"(?i)((^| )({met})[.,]*)+$", ""))


def whole_word(needle: Column, text: Column) -> Column:
    """needle in text with no letter or digit on either side (both lower case)."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "), F.lit(" "))
    plain = F.trim(F.regexp_replace(F.lower(needle), r"[^a-z0-9]+", " "))
    return (F.length(plain) > 0) & padded.contains(F.concat(F.lit(" "), plain, F.lit(" ")))


def token_overlap(names: Column, others: Column) -> Column:
    """Share of names that are in others; 0 for no names."""
    hit = F.size(F.filter(names, lambda t: F.array_contains(others, t)))
    return F.when(F.size(names) > 0, hit / F.size(names)).otherwise(0.0)


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in words])


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def split_names(text: Column) -> Column:
    """Comma-separated names, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def linkedin_profile(url: Column) -> Column:
    return F.lower(url).rlike(r"^https?://([a-z0-9-]+\.)?linkedin\.com/in/[^/]+")


def mentions(title: Column, snippet: Column, company: Column, website: Column) -> Column:
    """The company's name, or its domain's root of 4 letters at least, in title or snippet."""
    text = F.lower(F.concat_ws(" ", title, snippet))
    root = domain_root(host(website))
    return F.coalesce(text.contains(F.lower(company)), F.lit(False)) | F.coalesce((F.length(root) >= 4) & text.contains(root), F.lit(False))


def html_text(html: Column) -> Column:
    """Markup to text: scripts and styles dropped, tags to spaces, spaces collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def json_object(text: Column, schema: str) -> Column:
    """Strict: code fences off, then an object of the schema; null otherwise."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```\z", ""))
    return F.when(bare.startswith("{") & bare.endswith("}"), F.from_json(bare, schema))


def parse_date(text: Column) -> Column:
    """First of the accepted formats, on the first 19 characters."""
    t = F.substring(F.trim(text), 1, 19)
    formats = [(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\z", "yyyy-MM-dd'T'HH:mm:ss"), (r"^\d{4}-\d{2}-\d{2}\z", "yyyy-MM-dd"), (r"^\d{4}/\d{2}/\d{2}\z", "yyyy/MM/dd"), (r"^\d{2}/\d{2}/\d{4}\z", "MM/dd/yyyy"), (r"^[A-Z][a-z]{2} \d{2}, \d{4}\z", "MMM dd, yyyy"), (r"^\d{2} [A-Z][a-z]{2} \d{4}\z", "dd MMM yyyy")]
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f)).cast("date")) for p, f in formats])
