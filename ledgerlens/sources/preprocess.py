"""Preprocessors: documents to chunks, one a page, with the page's tables.

What reads a file format is injected: any picklable object with `pages(content)`, which
yields (text, tables) page by page, a table being rows of cells. It runs over Arrow
batches, a document at a time, and pages leave by the block, so that a task holds a
batch of documents and a block of pages. SQL can call it too, as a UDTF, with a lateral join.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from .documents import LEAST

Table = list[list[str | None]]
PAGE = "ordinal int, locator string, page_number int, text string, char_count int, tables array<array<array<string>>>, error string"
#: Pages, characters of pages and documents that a task holds as Python objects at a time.
BLOCK, CHARS, DOCUMENTS = 1_000, 1_000_000, 64


class Preprocessor(Protocol):
    #: Kind of source, as in source_document.
    source_type: str

    def pages(self, content: str | bytes) -> Iterator[tuple[str, list[Table]]]: ...


class TextPages:
    """Plain text: pages between form feeds, tables of lines with cells between bars."""

    source_type = "text"

    def pages(self, content: str | bytes) -> Iterator[tuple[str, list[Table]]]:
        text = content.decode() if isinstance(content, bytes) else content
        for page in text.split("\f"):
            tables, rows = [], []
            for line in [*page.split("\n"), ""] if "|" in page else []:
                if "|" in line:
                    rows.append([c.strip() for c in line.strip().strip("|").split("|")])
                elif rows:
                    tables.append(rows)
                    rows = []
            yield page, tables


def _read(preprocessor: Preprocessor, content: str | bytes | None, least: int) -> Iterator[tuple]:
    """PAGE rows of a document."""
    if content is None:
        return
    pages = preprocessor.pages(content)
    for k in range(10**9):
        try:
            raw, tables = next(pages)
        except StopIteration:
            return
        except Exception as e:  # the document's own failure, not the job's
            yield None, None, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        text = " ".join((raw or "").split())
        if len(text) >= least:
            yield k, f"slide_{k + 1}", k + 1, text, len(text), tables or [], None


def reader(preprocessor: Preprocessor, least: int = LEAST):
    """The UDTF of a preprocessor: content to PAGE rows. Pages of fewer than `least`
    characters, white space collapsed, are passed over, but ordinals count them. A
    document that can't be read, or not to its end, gives a row with an error after
    the pages that could; null content gives no rows."""

    @udtf(returnType=PAGE)
    class Pages:
        def eval(self, content):
            yield from _read(preprocessor, content, least)

    return Pages


def _encodable(x):
    """x without halves of surrogate pairs, which have no UTF-8."""
    if isinstance(x, list | tuple):
        return [_encodable(y) for y in x]
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) else x


def _column(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        return pa.array(_encodable(values), kind)


_CELLS = pa.list_(pa.list_(pa.list_(pa.string())))
_KINDS = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), _CELLS, pa.string()]


def preprocess(docs: DataFrame, preprocessor: Preprocessor, keys: list[str], content: str, least: int = LEAST) -> DataFrame:
    """(keys, PAGE) of documents with their content in a column, text or bytes; the rows are
    those of `reader`."""
    names, page = [f"_k{i}" for i in range(len(keys))], [c.split()[0] for c in PAGE.split(", ")]
    named = docs.select(*[F.col(c).alias(n) for n, c in zip(names, keys, strict=True)], F.col(content).alias("_content"))
    schema = T.StructType([*named.schema.fields[:-1], *T.StructType.fromDDL(PAGE)])

    def run(batches):
        for batch in batches:
            at, rows, held = [], [], 0

            def block(batch=batch):
                made = [_column(list(c), kind) for c, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)]
                return pa.RecordBatch.from_arrays([*[batch.column(n).take(pa.array(at)) for n in names], *made], names=[*names, *page])

            for begin in range(0, batch.num_rows, DOCUMENTS):
                for i, c in enumerate(batch.slice(begin, DOCUMENTS).column("_content").to_pylist(), begin):
                    for row in _read(preprocessor, c, least):
                        at.append(i)
                        rows.append(row)
                        held += row[4] or 0
                        if len(rows) >= BLOCK or held >= CHARS:
                            yield block()
                            at, rows, held = [], [], 0
            if rows:
                yield block()

    return named.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keys, strict=True)))


def register(spark: SparkSession, name: str, preprocessor: Preprocessor) -> None:
    """SELECT ... FROM docs, LATERAL name(content)"""
    spark.udtf.register(name, reader(preprocessor))


def page_tables(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, locator, table_index, grid) of every table, for extract.table_observations."""
    found = pages.select(*keys, "locator", F.posexplode_outer("tables").alias("table_index", "grid"))
    return found.where("grid is not null")
