"""JSON out of a model's answer: fenced, with text around it, or cut off."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A whole string, or one that is cut off, or a brace.
_TOKEN = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)|[{}]', re.DOTALL)
#: Objects with one level of objects inside.
_SHALLOW = re.compile(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}")
_NONE = object()


def _read(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return _NONE


def objects(text: str) -> list[str]:
    """The outermost {...} of a text that are closed, braces in strings aside."""
    out, depth, begin = [], 0, 0
    for token in _TOKEN.finditer(text):
        if token[0] == "{":
            begin = token.start() if depth == 0 else begin
            depth += 1
        elif token[0] == "}":
            depth -= 1
            if depth == 0:
                out.append(text[begin : token.end()])
            depth = max(depth, 0)
    return out


def _cut_off(text: str):
    """Of a list that breaks off its whole objects, of an object its first whole one."""
    whole = objects(text)
    if text.startswith("["):
        return [x for x in map(_read, whole) if x is not _NONE] or _NONE
    return _read(whole[0]) if text.startswith("{") and whole else _NONE


def _attempts(text: str):
    """Readings of a text from the strictest to the loosest."""
    parts = text.split("```") if "```" in text else []
    for part in (p.strip().removeprefix("json").strip() for p in parts):
        if part[:1] in ("{", "["):
            yield _read(part)
            yield _cut_off(part)
    yield _read(text)
    brace, bracket = text.find("{"), text.find("[")
    if 0 <= bracket and (brace < 0 or bracket < brace):
        yield _read(text[bracket : text.rfind("]") + 1])
    if brace >= 0:
        yield _read(text[brace : text.rfind("}") + 1])
    yield _cut_off(text)
    named = [x for x in map(_read, _SHALLOW.findall(text)) if x is not _NONE and "name" in x]
    yield named or _NONE


def recover(text: str | None):
    """What can be read of an answer; None if nothing can, or for null."""
    return None if text is None else next((x for x in _attempts(text.strip()) if x is not _NONE), None)


def recovered(answer: Column) -> Column:
    """recover() as JSON text, in Arrow batches; null if nothing can be read."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        found = [recover(None if t is None or t is pd.NA or t != t else t) for t in texts]
        return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False) for x in found], dtype=object)

    return run(answer)
