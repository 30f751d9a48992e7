"""Pages with tables from text, bytes and a parser that fails half way."""

from ledgerlens.sources import preprocess as P

PAGES = "k long, text string, error string"
LONG = "A page of text that is long enough"


def test_pages(spark):
    text = f"{LONG}\n a | b \n|c|\n\nx | y\fshort\f{LONG}  \t again"
    docs = spark.createDataFrame([(1, text, "clash"), (2, None, ""), (3, "", ""), (1, LONG, "")], PAGES)
    got = P.preprocess(docs, P.TextPages(), ["k"], "text").collect()
    assert sorted((r.k, r.ordinal, r.locator, r.page_number, r.text, r.char_count, str(r.tables), r.error) for r in got) == [
        (1, 0, "slide_1", 1, LONG, len(LONG), "[]", None),
        (1, 0, "slide_1", 1, f"{LONG} a | b |c| x | y", len(LONG) + 16, "[[['a', 'b'], ['c']], [['x', 'y']]]", None),
        (1, 2, "slide_3", 3, f"{LONG} again", len(LONG) + 6, "[]", None),
    ]
    assert sorted((r.locator, r.table_index, str(r.grid)) for r in P.page_tables(P.preprocess(docs, P.TextPages(), ["k"], "text"), ["k"]).collect()) == [("slide_1", 0, "[['a', 'b'], ['c']]"), ("slide_1", 1, "[['x', 'y']]")]


class Half:
    source_type = "bytes"

    def pages(self, content):
        yield content.decode(), []
        raise ValueError("page 2 is broken")


def test_a_broken_document_keeps_its_pages(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG)], "k long, text string").selectExpr("k", "cast(text as binary) as raw")
    got = P.preprocess(docs, Half(), ["k"], "raw").collect()
    assert sorted((r.k, r.ordinal is None, r.error) for r in got) == [(k, x, e) for k in (1, 2) for x, e in ((False, None), (True, "ValueError: page 2 is broken"))]


def test_from_sql(spark):
    P.register(spark, "text_pages", P.TextPages())
    spark.createDataFrame([(1, LONG + "\f" + LONG)], "k long, t string").createOrReplaceTempView("docs_of_sql")
    assert [tuple(r) for r in spark.sql("SELECT k, p.ordinal FROM docs_of_sql, LATERAL text_pages(t) p ORDER BY 2").collect()] == [(1, 0), (1, 1)]


def test_nothing(spark):
    assert P.preprocess(spark.createDataFrame([], PAGES), P.TextPages(), ["k"], "text").collect() == []
