"""Fill-in-middle transformation.

A Split pre-tokenizer of the tokenizers library, whose pattern matches any single
code point and isolates each match, gives the offsets of a text's code points
without any training. The length of the offset array is the text's length n; the
offsets at the two drawn ranks cut it into prefix, middle and suffix. The array has
two levels: isolated matches of RUN code points over the whole text (the last may be
shorter), and of single code points inside the last run and those of the two ranks.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The sentinels, and the shares in percent of transformed and of suffix-first documents.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT, SPM_PERCENT, SEED = 90, 20, 1
#: Code points in a run, and in a stretch of text that is split at once.
RUN, STRETCH = 256, 1 << 20


@functools.cache
def splitter(pattern: str):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(pattern), "isolated")


def starts(text: str, most: int = 1) -> list[int]:
    """Offsets at which the text's code points begin, or its runs of `most` of them."""
    pattern = "(?m:.)" if most == 1 else f"(?m:.{{1,{most}}})"  # m: the dot matches line ends too
    return [at[0] for _, at in splitter(pattern).pre_tokenize_str(text)]


class Units:
    """The code points of a text by rank: offsets of its runs, and inside the runs
    that are asked for offsets of each code point."""

    def __init__(self, text: str):
        self.text = text
        self.runs = [k + at for k in range(0, len(text), STRETCH) for at in starts(text[k : k + STRETCH], RUN)]
        full = max(0, len(self.runs) - 1)
        self.n = full * RUN + len(starts(text[self.runs[full] :])) if self.runs else 0

    def offset(self, rank: int) -> int:
        """Where the unit of this rank begins; n is the end of the text."""
        if rank >= self.n:
            return len(self.text)
        at = self.runs[rank // RUN]
        return at + starts(self.text[at : at + RUN])[rank % RUN]


def draws(key, seed: int = SEED) -> list[int]:
    """Four 32-bit integers of the document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(key, text: str, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    units, (h1, h2, h3, h4) = Units(text), draws(key, seed)
    n = units.n
    if not n or h3 % 100 >= fim or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y = units.offset(a), units.offset(b)
    prefix, middle, suffix = text[:x], text[x:y], text[y:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of docs.

    A null text counts as empty; empty texts and texts that hold a sentinel stay
    plain. The draws depend on the id alone, so repeated rows are cut alike and
    reruns agree; a null id is drawn as an empty one. Texts are cut whole, however
    long. Other columns are ignored; an empty table gives no rows.
    """

    def cut(batches):
        for b in batches:
            rows = [transform(k, t or "", seed, fim, spm) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ([],) * 5
            longs = [pa.array(c, pa.int64()) for c in (n, prefix, middle)]
            yield pa.RecordBatch.from_arrays([b.column(0), longs[0], pa.array(form, pa.string()), longs[1], longs[2], pa.array(output, pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    chosen = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return chosen.mapInArrow(cut, OUT)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from the output and its form: a transformed output holds each sentinel once."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)

    def text(first: str, second: str, suffix_first: bool) -> Column:
        parts = F.substring_index(F.substring_index(head, second, 1), first, -1), F.substring_index(head, second, -1)
        prefix, suffix = parts[::-1] if suffix_first else parts
        return F.concat(prefix, middle, suffix)

    return F.when(form == "psm", text(PREFIX, SUFFIX, False)).when(form == "spm", text(SUFFIX, PREFIX, True)).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    back = F.sha2(F.encode(restored(F.col("output"), F.col("form")), "UTF-8"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), back.alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
formed AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM formed
"""
