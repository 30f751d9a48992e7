"""Extraction rules: read from JSON or dicts, checked before any job starts."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from re import _parser


@dataclass(frozen=True)
class Rule:
    code: str
    kind: str  # money, number or enum
    patterns: tuple[str, ...] = ()
    choices: tuple[tuple[str, str], ...] = ()  # enum: keyword to value, in order
    gate: tuple[str, ...] = ()  # enum: any of these words must be there
    low: float | None = None
    high: float | None = None
    requires: tuple[str, ...] = ()
    granularity: str = "point_in_time"
    currency: str | None = None
    confidence: float = 0.9
    extra: dict = field(default_factory=dict, hash=False, compare=False)


def load(source: str | list[dict]) -> list[Rule]:
    """Rules of JSON text or dicts; raises ValueError naming the bad rule."""
    out, seen = [], set()
    for r in json.loads(source) if isinstance(source, str) else source:
        code = r.get("code", "")
        if not re.fullmatch(r"[a-z][a-z0-9_]*", code) or code in seen:
            raise ValueError(f"bad or repeated code {code!r}")
        seen.add(code)
        if r.get("kind") not in ("money", "number", "enum"):
            raise ValueError(f"{code}: unknown kind {r.get('kind')!r}")
        if r["kind"] == "enum" and not r.get("choices") or r["kind"] != "enum" and not r.get("patterns"):
            raise ValueError(f"{code}: nothing to look for")
        for p in r.get("patterns", ()):
            try:
                groups = re.compile(p).groups
            except re.error as e:
                raise ValueError(f"{code}: {e}") from e
            if groups != (2 if r["kind"] == "money" else 1):
                raise ValueError(f"{code}: {p!r} needs {'amount and unit' if r['kind'] == 'money' else 'one group'}")
        if not set(r.get("requires", ())) <= {"as_of_date", "scenario", "period_granularity"}:
            raise ValueError(f"{code}: unknown requirement")
        if not 0 <= r.get("confidence", 0.9) <= 1:
            raise ValueError(f"{code}: confidence out of range")
        names = {"code", "kind", "low", "high", "granularity", "currency", "confidence"}
        choices = r.get("choices", {})
        out.append(Rule(**{k: v for k, v in r.items() if k in names}, patterns=tuple(r.get("patterns", ())), choices=tuple(choices.items()), gate=tuple(r.get("gate", ())), requires=tuple(r.get("requires", ()))))
    return out


def factors(pattern: str) -> set[str]:
    """Texts in small letters of which every match holds one; empty if none is certain."""

    def best(sets: list[set[str]]) -> set[str]:
        return max((s for s in sets if s), key=lambda s: (min(map(len, s)), -len(s)), default=set())

    def of(items) -> set[str]:
        found, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(arg).lower()
                continue
            found.append({run} if run.strip() else set())
            run = ""
            if op is _parser.SUBPATTERN:
                found.append(of(arg[3]))
            elif op is _parser.BRANCH:
                each = [of(branch) for branch in arg[1]]
                found.append(set().union(*each) if all(each) else set())
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0] > 0:
                found.append(of(arg[2]))
        return best(found)

    return of(_parser.parse(pattern))


_MONEY = r"\$?\s*([0-9][0-9.,]*)\s*(billion|million|thousand|mm|k|m|b)?\b"
_AMOUNT = r"\s*([0-9][0-9.,]*)\s*(k|mm|million|m|billion|b)?"
#: Rules of our own wording for the usual metrics.
DEFAULT = load(
    [
        {"code": "arr", "kind": "money", "patterns": [rf"(?i)\b(?:ARR|annual recurring revenue)(?:\s+of|:|\s+is|\s+was)?\s+{_MONEY}", rf"(?i){_MONEY}\s+(?:in\s+)?ARR\b"], "low": 0, "high": 1e11, "requires": ["as_of_date", "scenario"], "granularity": "year", "currency": "USD"},
        {"code": "mrr", "kind": "money", "patterns": [rf"(?i)\b(?:MRR|monthly recurring revenue)(?:\s+of|:|\s+is|\s+was)?\s+{_MONEY}", rf"(?i){_MONEY}\s+MRR\b"], "low": 0, "high": 1e10, "requires": ["as_of_date"], "granularity": "month", "currency": "USD"},
        {"code": "employee_count", "kind": "number", "patterns": [r"(?i)\bteam\s+of\s+([0-9]{1,6})\b", r"(?i)\b([0-9]{1,6})\s+(?:full-time\s+)?employees\b"], "low": 0, "high": 500000, "requires": ["as_of_date"], "confidence": 0.88},
        {"code": "founding_year", "kind": "number", "patterns": [r"(?i)\b(?:founded|started|incorporated)\s+in\s+([0-9]{4})\b"], "low": 1900, "high": 2030, "confidence": 0.92},
        {"code": "funding_stage", "kind": "enum", "choices": {"pre-seed": "1", "seed": "2", "series a": "3", "series b": "4", "series c": "5"}, "confidence": 0.92},
        {"code": "prior_successful_exit", "kind": "enum", "choices": {"exit": "true", "acquired by": "true"}, "gate": ["founder", "ceo"], "confidence": 0.8},
    ]
)

# Ranges, contracts, confidences and keywords of the other metrics.
MORE = load(
    [
        {"code": "revenue", "kind": "money", "patterns": [rf"(?i)\${_AMOUNT}\s*(?:in\s+)?revenue\b", rf"(?i)\brevenue(?:\s+(?:FY)?(?:19|20)[0-9]{{2}})?[:\s]+\$?{_AMOUNT}\b"], "low": 0, "high": 1e12, "requires": ["as_of_date", "scenario"], "granularity": "year", "currency": "USD", "confidence": 0.85},
        {"code": "gross_margin", "kind": "number", "patterns": [r"(?i)\b(?:gross\s+margin|gm)[:\s]+(-?[0-9]{1,3}(?:\.[0-9]+)?)\s*%", r"(?i)(-?[0-9]{1,3}(?:\.[0-9]+)?)\s*%\s+(?:gross\s+margin|gm)\b"], "low": -100, "high": 100, "requires": ["as_of_date", "scenario"], "granularity": "year", "confidence": 0.88},
        {"code": "burn_rate", "kind": "money", "patterns": [rf"(?i)\${_AMOUNT}\s*(?:monthly\s+|cash\s+)?burn(?:\s+rate)?\b", rf"(?i)\b(?:monthly\s+)?burn(?:\s+rate)?[:\s]+\$?{_AMOUNT}\b"], "low": 0, "high": 1e9, "requires": ["as_of_date", "scenario"], "granularity": "month", "currency": "USD", "confidence": 0.85},
        {"code": "customer_count", "kind": "number", "patterns": [r"(?i)([0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)\s+(?:paying\s+)?customers\b", r"(?i)\b(?:paying\s+)?customers[:=\s]+([0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)\b"], "low": 0, "high": 1e10, "requires": ["as_of_date", "scenario"], "confidence": 0.85},
        {"code": "runway_months", "kind": "number", "patterns": [r"(?i)([0-9]{1,3})\s+months?\s+(?:of\s+)?runway\b", r"(?i)\brunway[:\s]+(?:of\s+)?([0-9]{1,3})\s+months?\b"], "low": 0, "high": 120, "requires": ["as_of_date"]},
        {
            "code": "technical_cofounder",
            "kind": "enum",
            "choices": dict.fromkeys(["technical co-founder", "technical cofounder", "cto & co-founder", "cto and co-founder", "cto, co-founder", "co-founder & cto", "co-founder and cto", "co-founder, cto", "engineer co-founder"], "true"),
            "gate": ["founder", "co-founder", "cofounder", "founding team"],
            "confidence": 0.8,
        },
    ]
)
#: All twelve metrics. The query over DEFAULT keeps to its six.
ALL = DEFAULT + MORE
