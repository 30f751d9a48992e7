"""Every match of a rule holds one of its factors."""

import random
import re

import pytest

from ledgerlens.sources import rules as R


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"(?i)\bteam\s+of\s+([0-9]+)", {"team"}),
        (r"(?i)\b(?:ARR|annual recurring revenue)\b", {"arr", "annual recurring revenue"}),
        (r"(?i)\bburn(?:\s+rate)?[:\s]", {"burn"}),
        (r"[0-9]+|x", set()),
        (r"(?:abc)?[0-9]", set()),
        (r"(?:abc)+d", {"abc"}),
        (r"\s+ \s+", set()),
    ],
)
def test_factors(pattern, want):
    assert R.factors(pattern) == want


def test_matches_hold_a_factor():
    r = random.Random(1)
    words = "ARR arr annual recurring revenue MRR monthly team of TEAM employees 35 1,200 $2.4M million in founded started 2019 burn rate gross margin GM -5% : customers paying runway months Revenue FY2024 full-time".split()
    tried = 0
    for rule in R.ALL:
        for p in rule.patterns:
            needed = R.factors(p)
            assert needed, p
            for _ in range(3000):
                text = " ".join(r.choice(words) for _ in range(6))
                if re.search(p, text):
                    tried += 1
                    assert any(f in text.lower() for f in needed), (p, text)
    assert tried > 100
