"""Idempotency keys of observations, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of an observation's key; null counts as empty.
FIELDS = ["as_of_date", "company_id", "currency", "evidence_text", "metric_id", "normalized_value", "period_label", "scenario", "source_chunk_id", "source_document_id"]
# Letters that JSON writes short.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escaped(c: Column) -> Column:
    """One code point in a JSON string of ASCII letters only."""
    code = F.ascii(c)
    low = code - 0x10000
    out = F.when(code.between(32, 126), c).when(code < 0x10000, _unit(code)).otherwise(F.concat(_unit(F.shiftright(low, 10) + 0xD800), _unit(low.bitwiseAND(0x3FF) + 0xDC00)))
    for plain, written in SHORT.items():
        out = F.when(c == plain, written).otherwise(out)
    return out


def json_text(text: Column) -> Column:
    """text as a JSON string, all but ASCII as \\uXXXX in small letters; most texts need no escape."""
    escaped = F.array_join(F.transform(F.split(text, ""), _escaped), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r'\A[ !#-\[\]-~]*\z'), text).otherwise(escaped), F.lit('"'))


def fingerprint_json(fields: dict[str, Column]) -> Column:
    """md5 of the compact JSON of all fields, keys in order, null as the empty text."""
    parts = [F.concat(F.lit(f'"{name}":'), json_text(F.coalesce(fields[name].cast("string"), F.lit("")))) for name in sorted(fields)]
    return F.md5(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).cast("binary"))
