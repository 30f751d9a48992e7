"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that can be a whole pre-token is encoded alone;
those that give exactly one token are kept as proven. Then a text is cut at its
white space (which the tokenizer drops and never joins over), proven pieces
count 1, other pieces are cut into pre-tokens, of which the proven ones count 1
and only the rest is merged, once per piece and worker.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .bpe import SAFE, in_bytes, tokenizer
from .common import table

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
#: Entries that a worker keeps of pieces it has counted; a bound on memory only.
REMEMBERED = 1_200_000
#: Fixed value: the pre-token pattern of the vocabulary file.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Python splits at these four, the tokenizer doesn't; and "<|" may begin a special string.
UNSURE = re.compile("[\x1c-\x1f]|<\\|")


def lengths(name: str, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer(name).encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def proven(name: str) -> frozenset[str]:
    """Lower-case ASCII strings of the vocabulary that are one pre-token and
    that, encoded alone, are one token. Lower case and ASCII, so the normaliser
    leaves them as they are."""
    end = "</w>"
    words = [v.removesuffix(end) for v in tokenizer(name).get_vocab() if v.endswith(end)]
    words = [w for w in words if w and w.isascii() and w == w.lower() and not UNSURE.search(w) and PRETOKEN.fullmatch(w)]
    return frozenset(w for w, n in zip(words, lengths(name, words), strict=True) if n == 1)


class Counter:
    """Counts texts; remembers pieces and the pre-tokens it has merged."""

    def __init__(self, name: str):
        self.name, self.whole, self.model = name, proven(name), tokenizer(name).model
        self.known, self.merged = dict.fromkeys(self.whole, 1), {}

    def _learn(self, pieces: list[str]) -> None:
        foreign = []
        for p in pieces:
            if p in self.known:
                continue
            if not SAFE.fullmatch(p):  # the normaliser may compose or fold it
                self.known[p] = 0
                foreign.append(p)
                continue
            total = 0
            for token in PRETOKEN.findall(p.lower()):
                if token in self.whole:
                    total += 1
                    continue
                n = self.merged.get(token)
                if n is None:
                    n = self.merged[token] = len(self.model.tokenize(in_bytes(token)))
                total += n
            self.known[p] = total
        for p, n in zip(foreign, lengths(self.name, foreign), strict=True):
            self.known[p] = n

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        unsure = [k for k, t in enumerate(texts) if UNSURE.search(t)]
        for k, n in zip(unsure, lengths(self.name, [texts[k] for k in unsure]), strict=True):
            out[k] = n
        skip = set(unsure)
        for k, t in enumerate(texts):
            if k in skip:
                continue
            pieces = t.split()
            try:
                out[k] = sum(map(self.known.__getitem__, pieces))
            except KeyError:
                self._learn(pieces)
                out[k] = sum(map(self.known.__getitem__, pieces))
            if len(self.known) > REMEMBERED:
                self.known = dict.fromkeys(self.whole, 1)
            if len(self.merged) > REMEMBERED:
                self.merged = {}
        return out


@functools.cache
def counter(name: str) -> Counter:
    return Counter(name)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. Texts are counted whole,
    however long. Repeated rows and null keys keep their rows; other columns are
    ignored; an empty table gives no rows.
    """

    def count(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = counter(vocabulary).count(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    chosen = docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text")
    return chosen.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
