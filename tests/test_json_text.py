"""Answers of models as JSON: every way in which they break."""

import json

import pytest

from ledgerlens.functions import json_text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ("[1, 2]", [1, 2]),
        ('```json\n{"a": [1, {"b": 2}]}\n```', {"a": [1, {"b": 2}]}),
        ('Here:\n```\n[{"a": 1}, {"a": "x}', [{"a": 1}]),
        ('Sure: {"a": "}{"} ok?', {"a": "}{"}),
        ('Sure: [{"a": 1}] ok?', [{"a": 1}]),
        ('[{"a": 1}, {"a": {"b": 2}}, {"a": "tr', [{"a": 1}, {"a": {"b": 2}}]),
        ('[{"a": 1}, {"a": 2 3}, {"a": 4}, {"a"', [{"a": 1}, {"a": 4}]),
        ('{"a": 1} and {"b": 2}', {"a": 1}),
        ('{"a": "\\"}"} {', {"a": '"}'}),
        ('x {"name": "A", "c": {"d": 1}} y {"b": 1} {"name": "B"}', [{"name": "A", "c": {"d": 1}}, {"name": "B"}]),
        ("nothing", None),
        ("", None),
        ("}{", None),
        ('{"a": 1', None),
        (None, None),
    ],
)
def test_recover(text, want):
    assert json_text.recover(text) == want


def test_recovered_column(spark):
    df = spark.createDataFrame([(1, 'x {"é": 1} y'), (2, None), (3, "no"), (4, "")], "id int, t string")
    got = {r.id: r.j for r in df.select("id", json_text.recovered(df.t).alias("j")).collect()}
    assert json.loads(got[1]) == {"é": 1} and [got[k] for k in (2, 3, 4)] == [None] * 3
