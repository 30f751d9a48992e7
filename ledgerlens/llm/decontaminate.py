"""Benchmark decontamination by latent semantic retrieval.

0. Texts are read once; the hashes of their words are kept.
1. Frequencies of all words (hashed to SLOTS) over all passages of the corpus give
   TF-IDF weights. They don't depend on the benchmark.
2. A randomised SVD of all TF-IDF passages: every task multiplies its passages
   with one random matrix, the sums of all tasks give the leading singular
   vectors (Nystrom form, so one pass is enough).
3. Items are cut into pieces, documents into windows, overlapping by halves. Both
   are folded into the latent space (each direction by its singular value), and a
   window is a candidate for the pieces that are near enough by cosine. Nothing is
   looked up in another way.
4. Candidates are checked on the words: a longest common subsequence with most of
   the item's words; for paraphrases with 3 in 5 of them, the rarer words covered,
   and the answer (the item's last sentence, or its last words) there too; for
   paraphrases in other words with 2 in 5, the answer, and a latent cosine of the
   whole item; or RUN words in a row of an item, however little of it they are.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import saved, table, trim

#: Words of a passage of the SVD; hashed vocabulary; singular vectors kept, random ones more.
PASSAGE, SLOTS, RANK, OVER = 64, 1 << 13, 64, 8
#: Words of half a window (or piece of an item).
HALF = 8
#: Least latent cosine of a window and a piece, and share of the piece's weight in common, for a candidate.
COSINE, COVER = 0.45, 0.25
#: LCS over the item's words: enough alone; enough with the rest of the checks; enough with the item's cosine.
VERBATIM, PARAPHRASE, WEIGHT, ANSWER, OTHER, ALIKE = 0.8, 0.6, 0.5, 0.5, 0.4, 0.75
#: Items with fewer words must be there word for word; below ALONE they must be all words of the document.
SHORT, ALONE = 8, 4
#: Words in a row of an item that are enough alone.
RUN = 13
#: Items, and words of items, that are searched in one pass (a bound on memory; results don't depend on it).
ITEMS, ITEM_WORDS = 20_000, 2_000_000
#: Sums of matrices added up by one task.
FAN = 64


def words_of(texts: list[str | None]):
    """Yields (first, word hashes, offsets) for runs of texts; words are runs of
    letters and digits, in lower case."""
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    return wordhash.word_lists(raw, wordhash.NOT_WORD)


def _short(hashes: np.ndarray) -> np.ndarray:
    """32 bits of each hash; 0 and 1 are no word."""
    return (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(2)


def _slot(words: np.ndarray) -> np.ndarray:
    return ((words >> np.uint32(5)) % np.uint32(SLOTS)).astype(np.uint16)


def _padded(words: np.ndarray, offsets: np.ndarray, width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of `width` words, first row of each document and the end): documents
    words[offsets[i]:offsets[i + 1]], their last rows filled up with `pad`."""
    count = np.diff(offsets)
    rows = -(-count // width)
    first = np.concatenate(([0], np.cumsum(rows)))
    out = np.full(int(first[-1]) * width, pad, dtype=words.dtype)
    out[np.arange(len(words)) + np.repeat(first[:-1] * width - offsets[:-1], count)] = words
    return out.reshape(-1, width), first


def lcs(item: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel, Hyyro); item maps
    a word to the bit set of its places."""
    full = (1 << length) - 1
    v = full
    for w in words:
        if m := item.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def in_a_row(a: np.ndarray, b: np.ndarray, n: int = RUN) -> bool:
    """Whether a and b share n words in a row."""
    if len(a) < n or len(b) < n:
        return False
    eq = a[:, None] == b[None, :]
    got, done = eq, 1
    while done < n:
        step = min(done, n - done)
        got = got[: len(got) - step, : got.shape[1] - step] & got[step:, step:]
        done += step
    return bool(got.any())


class Benchmark:
    """Items with words, the hashed vocabulary and, later, weights and latent space."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.vocabulary = np.arange(SLOTS)
        self.ids, self.words, self.answers, self.places = [], [], [], []
        one = lambda text: next((_short(h) for _, h, _ in words_of([text])), np.zeros(0, dtype=np.uint32))
        for i, text in zip(ids, texts, strict=True):
            words = one(text)
            if len(words):
                sentences = [s for s in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if s]
                last = one(sentences[-1]) if len(sentences) > 1 else words[-5:]
                at: dict[int, int] = {}
                for k, w in enumerate(words.tolist()):
                    at[w] = at.get(w, 0) | 1 << k
                self.ids.append(i)
                self.words.append(words)
                self.places.append(at)
                self.answers.append(set((last if len(last) >= 3 else words[-5:]).tolist()))
        size = 2 * HALF
        self.item_of, self.begins = [], []
        for k, words in enumerate(self.words):
            begins = list(range(0, max(1, len(words) - size + 1), HALF))
            if begins[-1] + size < len(words):
                begins.append(len(words) - size)
            self.begins += begins
            self.item_of += [k] * len(begins)
        self.pieces = np.ones((len(self.begins), size), dtype=np.uint32)
        for k, (i, b) in enumerate(zip(self.item_of, self.begins, strict=True)):
            own = self.words[i][b : b + size]
            self.pieces[k, : len(own)] = own
        #: A shorter piece is a smaller part of its window.
        self.least = (COSINE * np.sqrt((self.pieces > 1).sum(axis=1) / size)).astype(np.float32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, slots) of all words."""
        return np.arange(len(hashes)), _slot(_short(hashes)).astype(np.int64)

    def weigh(self, frequency: np.ndarray, passages: int) -> None:
        self.idf = np.log((2 + passages) / (1 + frequency))

    def fold(self, vectors: np.ndarray, values: np.ndarray) -> None:
        """Latent vectors of the slots and, from them, of the pieces and items."""
        live = values > 1e-3 * max(values, default=0)
        self.latent = np.zeros((SLOTS + 1, max(1, int(live.sum()))), dtype=np.float32)
        if live.any():
            self.latent[:SLOTS] = vectors[:, live] * self.idf[:, None] / values[live]
        self.weight = np.append(self.idf, 0).astype(np.float32)
        slots = np.where(self.pieces > 1, _slot(self.pieces), SLOTS)
        self.queries = _unit(self.latent[slots].sum(axis=1))
        self.wholes = _unit(np.array([self.latent[_slot(w)].sum(axis=0) for w in self.words]))
        self.shares = self.weight[slots]
        self.shares /= self.shares.sum(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-30)[:, None]


def hits(docs: DataFrame, block=None) -> DataFrame:
    """(doc_id, words) of rows (text, doc_id): hashes of all words, as unsigned
    32-bit integers. Ids are of any type."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for _, hashes, offsets in words_of(batch.column(0).to_pylist()):
                raw = _short(hashes).tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "words"])

    return docs.mapInArrow(run, f"doc_id {kind}, words binary")


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets) of a batch of hits."""
    parts = [x.as_buffer() if x.is_valid else b"" for x in batch.column(1)]
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint32), offsets


def _passages(batch: pa.RecordBatch, size: int = 64):
    """Yields (slots of passages, sorted; first occurrences of their distinct ones)."""
    words, offsets = _read(batch)
    rows, _ = _padded(_slot(words), offsets, PASSAGE, SLOTS)
    for k in range(0, len(rows), size):
        m = np.sort(rows[k : k + size], axis=1)
        first = np.ones(m.shape, dtype=bool)
        first[:, 1:] = m[:, 1:] != m[:, :-1]
        yield m, first


def frequencies(found: DataFrame) -> tuple[np.ndarray, int]:
    """(passages that have a word of each slot, passages)."""

    def count(batches):
        total, n = np.zeros(SLOTS + 1, dtype=np.int64), 0
        for batch in batches:
            for m, first in _passages(batch, 4096):
                total += np.bincount(m[first], minlength=SLOTS + 1)
                n += len(m)
        total[SLOTS] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    rows = found.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # SLOTS + 1 rows at most
    out = np.zeros(SLOTS + 1, dtype=np.int64)
    out[rows.slot.to_numpy()] = rows.n.to_numpy()
    return out[:SLOTS], int(out[SLOTS])


def topics(found: DataFrame, block, rank: int = RANK, over: int = OVER) -> tuple[np.ndarray, np.ndarray]:
    """(leading right singular vectors in columns, singular values) of the matrix
    of unit TF-IDF passages."""
    spark = found.sparkSession
    width = rank + over
    omega = np.random.default_rng(17).standard_normal((SLOTS + 1, width)).astype(np.float32)
    omega[SLOTS] = 0
    shared = spark.sparkContext.broadcast(omega)  # of fixed size
    parts = 16

    def multiply(batches):
        from pyspark import TaskContext

        o, idf = shared.value, np.append(block.value.idf, 0).astype(np.float32)
        z = np.zeros((SLOTS + 1, width), dtype=np.float32)
        for batch in batches:
            for m, first in _passages(batch):
                slots = m.ravel()
                begin = np.flatnonzero(first)
                value = idf[slots[begin]] * np.diff(np.append(begin, len(slots)))
                norm = np.sqrt(np.maximum(np.bincount(begin // PASSAGE, weights=value * value, minlength=len(m)), 1e-30))
                # Each occurrence counts by itself, so a word's occurrences add up to its frequency.
                one = idf[m] / norm[:, None].astype(np.float32)
                y = np.matmul(one[:, None, :], o.take(slots, axis=0).reshape(*m.shape, width))[:, 0]
                order = np.argsort(slots, kind="stable")
                back = y.take(order // PASSAGE, axis=0)
                back *= one.ravel()[order][:, None]
                sums = np.cumsum(back, axis=0, out=back)
                last = np.flatnonzero(np.diff(slots[order].astype(np.int32), append=-1))
                total = sums[last]
                total[1:] -= sums[last[:-1]]
                z[slots[order[last]]] += total
        trim()
        for k, rows in enumerate(np.array_split(z[:SLOTS], parts)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([rows.tobytes()], pa.binary())], names=["part", "task", "rows"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["rows"].iloc[0]) // 4)
        for r in pdf["rows"]:
            total += np.frombuffer(r, dtype=np.float32)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "task": [pdf["task"].iloc[0] // FAN], "rows": [total.astype(np.float32).tobytes()]})

    sums = found.mapInArrow(multiply, "part int, task int, rows binary")
    tasks = max(1, found.rdd.getNumPartitions())
    while True:  # a tree: no task adds more than FAN sums
        sums = sums.groupBy("part", F.expr(f"task div {FAN}")).applyInPandas(add, "part int, task int, rows binary")
        tasks = -(-tasks // FAN)
        if tasks == 1:
            break
    sums = sums.toPandas().sort_values("part")  # `parts` rows
    if not len(sums):
        return np.zeros((SLOTS, 0)), np.zeros(0)
    z = np.concatenate([np.frombuffer(r, dtype=np.float32).reshape(-1, width) for r in sums["rows"]]).astype(np.float64)
    omega = omega[:SLOTS].astype(np.float64)
    shift = 1e-6 * max(1e-12, np.linalg.norm(z))
    z = z + shift * omega
    core = omega.T @ z
    lower = np.linalg.cholesky((core + core.T) / 2 + shift * np.eye(width))
    u, s, _ = np.linalg.svd(np.linalg.solve(lower, z.T).T, full_matrices=False)
    return u[:, :rank], np.maximum(s[:rank] ** 2 - shift, 0) ** 0.5


def candidates(b: Benchmark, words: np.ndarray, offsets: np.ndarray, windows: int = 2048):
    """Yields arrays (document, first word of the window in it, piece, cosine) of
    windows that are near a piece and share enough of its weight."""
    halves, first = _padded(words, offsets, HALF, 0)
    n = len(halves)
    doc = np.searchsorted(first, np.arange(n), side="right") - 1
    windows = max(64, min(windows, (1 << 22) // max(1, len(b.pieces))))
    for x in range(0, n, windows):
        own = halves[x : x + windows + 1]
        slots = np.where(own > 0, _slot(own), SLOTS)
        latent = np.concatenate([np.matmul(_ONES, b.latent.take(s.ravel(), axis=0).reshape(*s.shape, -1))[:, 0] for s in (slots[k : k + 256] for k in range(0, len(slots), 256))])
        d = doc[x : x + windows + 1]
        size = min(windows, n - x)
        both = np.zeros(size, dtype=bool)
        both[: len(d) - 1] = d[1:][:size] == d[:-1][:size]
        alone = ~both & (first[d[:size] + 1] - first[d[:size]] == 1)
        w = latent[:size].copy()
        w[both] += latent[1:][both[: len(latent) - 1]] if both.any() else 0
        at = np.flatnonzero(both | alone)
        cosine = _unit(w[at]) @ b.queries.T
        hit, piece = np.nonzero(cosine >= b.least)
        for k in range(0, len(hit), 1 << 15):
            h, p = hit[k : k + (1 << 15)], piece[k : k + (1 << 15)]
            where = at[h]
            text = own[np.minimum(where[:, None] + np.array([0, 1]), len(own) - 1)].reshape(len(h), -1)
            text[~both[where], HALF:] = 0
            common = np.zeros((len(h), 2 * HALF), dtype=bool)
            pieces = b.pieces[p]
            for j in range(2 * HALF):
                common |= pieces == text[:, j, None]
            good = np.flatnonzero((b.shares[p] * common).sum(axis=1) >= COVER)
            h, p = h[good], p[good]
            where = at[h]
            yield d[where], (x + where - first[d[where]]) * HALF, p, cosine[h, p]


_ONES = np.ones((1, HALF), dtype=np.float32)


def _check(b: Benchmark, k: int, whole: np.ndarray, begin: int) -> tuple[float, bool] | None:
    """(LCS over the item's words, answer there) if the document `whole` holds
    item k, whose first word would be at `begin` or so."""
    item = b.words[k]
    n = len(item)
    if n < ALONE:
        return (1.0, True) if np.array_equal(whole, item) else None
    near = whole[max(0, begin - n - HALF) : begin + 2 * n + HALF]
    if n < SHORT:
        return (1.0, True) if in_a_row(near, item, n) else None
    words = near.tolist()
    ratio = lcs(b.places[k], n, words) / n
    there = set(words)
    answer = len(b.answers[k] & there) >= ANSWER * len(b.answers[k])
    if ratio >= VERBATIM:
        return ratio, answer
    if answer and ratio >= PARAPHRASE:
        own = np.unique(item)
        weight = b.weight[_slot(own)]
        if float(weight[[w in there for w in own.tolist()]].sum()) >= WEIGHT * float(weight.sum()):
            return ratio, answer
    if answer and ratio >= OTHER:
        latent = b.latent[_slot(whole[max(0, begin) : max(0, begin) + n])].sum(axis=0)
        if float(latent @ b.wholes[k]) >= ALIKE * float(np.sqrt(latent @ latent)):
            return ratio, answer
    return (ratio, answer) if in_a_row(near, item) else None


def search(found: DataFrame, block) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) from hits."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def look(batches):
        b = block.value
        for batch in batches:
            words, offsets = _read(batch)
            keys, best, seen = batch.column(0).to_pylist(), {}, set()
            for docs, begins, pieces, cosines in candidates(b, words, offsets):
                for d, at, p, c in zip(docs.tolist(), begins.tolist(), pieces.tolist(), cosines.tolist(), strict=True):
                    k = b.item_of[p]
                    begin = at - b.begins[p]
                    old = best.get((d, k))
                    if (d, k, begin) in seen:
                        continue
                    seen.add((d, k, begin))
                    got = _check(b, k, words[offsets[d] : offsets[d + 1]], begin)
                    if got and (old is None or (got[0], c) > (old[1], old[0])):
                        best[d, k] = (min(1.0, c), *got)
            rows = [(keys[d], b.ids[k], *v) for (d, k), v in sorted(best.items())]
            kinds = (batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["doc_id", "item_id", "cosine", "lcs", "answer"])
        trim()

    return found.mapInArrow(look, f"doc_id {kind}, item_id long, cosine double, lcs double, answer boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS, key: str = "long") -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): each document with each benchmark
    item that it holds, word for word, as a paraphrase or by RUN words in a row;
    cosine is that of a window and a piece that led to the check; key: the type of doc_id.

    Null and empty texts hold nothing, and null and empty items are held by
    nothing; items of fewer than SHORT words are held word for word only, those of
    fewer than ALONE words only by documents without other words; items that
    repeat are found under each id. Rows that repeat are searched each. Null ids
    stay null. Other columns are ignored; with an empty table on either side there
    are no rows. Documents are searched whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast(key).alias("doc_id"))
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    kept, space, found, held, size = None, None, None, ([], []), 0

    def one_block() -> None:
        nonlocal kept, space, found, size
        b = Benchmark(*held)
        if b.ids:
            if kept is None:
                kept = saved(hits(rows), "hits")
                weights = frequencies(kept)
                b.weigh(*weights)
                space = (weights, topics(kept, spark.sparkContext.broadcast(b)))
            b.weigh(*space[0])
            b.fold(*space[1])
            part = search(kept, spark.sparkContext.broadcast(b))
            found = part if found is None else found.unionByName(part)
        held[0].clear()
        held[1].clear()
        size = 0

    for r in wanted.orderBy(F.col("item_id").asc_nulls_last(), "text").toLocalIterator():  # the stated query set, `items` at a time
        held[0].append(r["item_id"])
        held[1].append(r["text"])
        size += len(r["text"] or "") // 2
        if len(held[0]) == items or size >= ITEM_WORDS:
            one_block()
    if held[0]:
        one_block()
    if found is None:
        schema = T._parse_datatype_string(f"doc_id {key}, item_id long, cosine double, lcs double, answer boolean")
        return spark.createDataFrame([], schema)
    return found


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
