"""Quotes in texts, against the nested loop."""

import random

import pytest
from ledgerlens.functions import text as X
from ledgerlens.operators import extract, ground
from pyspark.sql import functions as F


def pairs(df):
    return sorted(df.select("doc_id", "item_id").collect())


@pytest.mark.parametrize("block", [20_000, 3])
def test_contains_join(spark, monkeypatch, block):
    monkeypatch.setattr(extract, "QUOTES", block)
    r = random.Random(2)
    texts = [(k, "".join(r.choice("ab c\n.é") for _ in range(r.randrange(60)))) for k in range(80)] + [(90, "xab cd ef"), (91, "word here"), (92, None), (93, ""), (93, "")]
    quotes = [(k, "".join(r.choice("ab c") for _ in range(r.randrange(1, 5)))) for k in range(25)] + [(30, "ab cd"), (31, "word"), (32, None), (33, ""), (34, "b c"), (34, "b c"), (35, "é")]
    t, q = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, quote string")
    got = pairs(extract.contains_join(t, q, "text", "quote"))
    assert got == sorted((d, i) for d, x in texts for i, y in quotes if x is not None and y is not None and y in x)
    assert {(90, 30), (91, 31)} <= set(got)
    assert not extract.contains_join(t, q.where("false"), "text", "quote").count() and not extract.contains_join(t.where("false"), q, "text", "quote").count()


def test_fixed_lists(spark):
    row = spark.range(1).select(
        X.strip_suffixes(F.lit("Tabby Technologies Inc")).alias("bare"),
        X.file_tokens(F.lit("acme_slides_preseed_report.pdf")).alias("file"),
        ground.website_confidence(F.lit("https://uk.techcrunch.com/x"), F.lit("Techcrunch"), F.lit("techcrunch")).alias("site"),
    ).first()
    assert (row.bare, row.file, row.site) == ("Tabby", ["acme"], 0.0)
