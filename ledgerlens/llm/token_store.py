"""Content-addressed store of token ids.

Each document's ids (with an end id) are cut where a rolling hash over the last
WINDOW ids says so, so equal passages give equal chunks. Chunks are named by a
hash of their bytes and stored once (`chunks`); a document is the list of its
chunks' names (`recipes`, in ascending doc_id order, with the position of its
first id and a Merkle root over them). The Merkle manifest (`manifest`) has a root
over the documents of each block of ids and one over all blocks.

Reading back first compares the recipes with the manifest. Then it takes every
stored chunk once: its bytes must hash to its name, and its crc32 and length are
combined along the recipes, which must have their roots and lengths. `restore`
rebuilds the ids themselves.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .bpe import SAFE, byte_alphabet, in_bytes, tokenizer
from .common import prefix_sums, scratch_path, spread_join, table, trim

VOCABULARY, END = "byte_bpe_50k.json", 2
#: Chunks: window of the rolling hash, least, mean (a power of 2) and most ids.
WINDOW, LEAST, MEAN, MOST = 16, 64, 256, 2048
#: Bytes of a chunk's name.
NAME = 16
#: Ids of a block of the manifest; blocks under one node above them.
BLOCK, UNDER = 1 << 18, 1 << 12
#: Parts that name a chunk above which it is joined in copies.
HOT = 2000
#: Words and other pieces that a worker remembers before it begins anew. A bound on memory only.
REMEMBERED = 450_000
#: Bytes of text that a worker encodes at once.
SLICE = 2 << 20
#: Fixed value: the pre-token pattern of the vocabulary file.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A piece of letters with marks behind them: two pre-tokens of that pattern.
MARKED = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
SPACE = byte_alphabet()[0x20]
_GEAR = wordhash.stream(9, 1 << 17)
_ROLL = wordhash.stream(10, WINDOW) | np.uint64(1)


class Encoder:
    """Ids of texts, as little-endian integers of `dtype`.

    A single space between other characters always begins a pre-token, so the
    pieces between such spaces encode independently. Most are a word with marks
    behind it, which are two pre-tokens: Arrow takes them apart, and only words and
    marks that aren't remembered are merged by the library's model. Texts with other
    spaces, other characters or special strings go to the library."""

    def __init__(self, name: str):
        self.tokenizer = tokenizer(name)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._clear()

    def _clear(self) -> None:
        #: Entries: ids[begin[e]:begin[e] + size[e]]; entry 0 has none.
        self.ids, self.begin, self.size = np.zeros(0, dtype=self.dtype), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.words, self.marks, self.odd, self.first, self.merged = {}, {"": 0}, {}, {}, {}

    def _ids(self, token: str) -> list[int]:
        return [x.id for x in self.model.tokenize(in_bytes(token))]

    def _word(self, word: str) -> list[int]:
        return [x.id for x in self.model.tokenize(SPACE + (word if word.isascii() else in_bytes(word)))]

    def _pieces(self, text: str) -> list[int]:
        out = []
        for t in PRETOKEN.findall(text):
            if (ids := self.merged.get(t)) is None:
                ids = self.merged[t] = self._ids(t)
            out += ids
        return out

    def _odd(self, piece: str) -> list[int]:
        """No ids for a piece that isn't one: its text goes to the library."""
        return [] if not piece or piece[0].isspace() or piece[-1].isspace() else self._pieces(" " + piece)

    def _head(self, piece: str) -> list[int]:
        return [] if piece[-1:].isspace() else self._pieces(piece)

    def _entries(self, known: dict[str, int], names: list[str], ids_of) -> np.ndarray:
        """The entries of names, new ones from ids_of."""
        found = list(map(known.get, names))
        new = [k for k, e in enumerate(found) if e is None]
        if new:
            ids, sizes = [], []
            for k in new:
                own = ids_of(names[k])
                ids += own
                sizes.append(len(own))
            n = np.array(sizes, dtype=np.int64)
            entry = len(self.size)
            self.begin = np.append(self.begin, len(self.ids) + np.cumsum(n) - n)
            self.size = np.append(self.size, n)
            self.ids = np.append(self.ids, np.array(ids, dtype=self.dtype))
            for k, e in zip(new, range(entry, entry + len(new)), strict=True):
                found[k] = known[names[k]] = e
        return np.array(found, dtype=np.int64)

    def _distinct(self, known: dict[str, int], column: pa.Array, ids_of) -> np.ndarray:
        coded = column.dictionary_encode()
        return self._entries(known, coded.dictionary.to_pylist(), ids_of)[coded.indices.to_numpy()]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each). Pieces are cut and made distinct
        by Arrow, so that Python sees each of a batch's words once."""
        if len(self.size) > REMEMBERED or len(self.merged) > REMEMBERED // 4:
            self._clear()
        fast = [bool(t) and "<|" not in t and t[0] != " " and SAFE.fullmatch(t) is not None for t in texts]
        lists = pc.split_pattern(pa.array([t for t, f in zip(texts, fast, strict=True) if f], pa.large_string()), " ")
        starts = lists.offsets.to_numpy()
        pieces = lists.flatten().dictionary_encode()
        names, at = pieces.dictionary, pieces.indices.to_numpy().astype(np.int64)
        taken = pc.extract_regex(names, MARKED)
        plain = taken.is_valid().to_numpy(zero_copy_only=False)
        # Two entries a piece: the word and its marks, or the odd piece and none.
        pair = np.zeros((len(names), 2), dtype=np.int64)
        good = taken.filter(pa.array(plain))
        pair[plain, 0] = self._distinct(self.words, good.field("word"), self._word)
        pair[plain, 1] = self._distinct(self.marks, good.field("marks"), self._ids)
        pair[~plain, 0] = self._entries(self.odd, names.filter(pa.array(~plain)).to_pylist(), self._odd)
        # The first piece of a text has no space before it: an entry of its own.
        heads = self._entries(self.first, names.take(pa.array(at[starts[:-1]])).to_pylist(), self._head)
        at[starts[:-1]] = len(pair) + np.arange(len(heads))
        pair = np.concatenate([pair, np.column_stack([heads, np.zeros_like(heads)])]).ravel()
        table = _gathered(self.ids, self.begin[pair], self.size[pair])
        size = self.size[pair].reshape(-1, 2).sum(axis=1)
        n = size[at]
        ids = _gathered(table, (np.cumsum(size) - size)[at], n)
        ends = np.concatenate(([0], np.cumsum(n)))[starts] if len(at) else np.zeros(1, dtype=np.int64)
        bad = np.add.reduceat(n == 0, starts[:-1]) > 0 if len(at) else np.zeros(0, dtype=bool)
        if all(fast) and not bad.any():
            return ids, np.diff(ends)
        quick = iter(range(len(ends) - 1))
        parts = []
        for t, f in zip(texts, fast, strict=True):
            k = next(quick) if f else None
            parts.append(ids[ends[k] : ends[k + 1]] if f and not bad[k] else self.whole(t) if t else ids[:0])
        return np.concatenate(parts) if parts else ids, np.array([len(p) for p in parts], dtype=np.int64)


def _gathered(ids: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ids[begin[i]:begin[i] + n[i]] of all i, joined."""
    return ids[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


@functools.cache
def encoder(name: str) -> Encoder:
    return Encoder(name)


def cuts(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each document ids[offsets[i]:offsets[i + 1]] the ends of its chunks.
    No chunk is shorter than LEAST >= WINDOW ids (but the last), so no window
    reaches over a document's or a chunk's beginning."""
    value = _GEAR[ids]
    h = np.zeros(len(ids), dtype=np.uint64)
    for j in range(min(WINDOW, len(ids))):
        h[j:] += value[: len(ids) - j] * _ROLL[j]
    marks = np.flatnonzero((wordhash.mix(h) & np.uint64(MEAN - 1)) == 0) + 1
    at = np.searchsorted(marks, offsets)
    out = []
    for i in range(len(offsets) - 1):
        begin, end, ends = int(offsets[i]), int(offsets[i + 1]), []
        for m in marks[at[i] : at[i + 1]].tolist():
            while m - begin > MOST:
                begin += MOST
                ends.append(begin)
            if m - begin >= LEAST:
                ends.append(m)
                begin = m
        while end - begin > MOST:
            begin += MOST
            ends.append(begin)
        if begin < end:
            ends.append(end)
        out.append(ends)
    return out


def name_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=NAME).digest()


def merkle(names: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd last node goes up as it is."""
    level = names or [b""]
    level = [hashlib.blake2b(b"\x00" + x, digest_size=16).digest() for x in level]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\x01" + b"".join(level[k : k + 2]), digest_size=16).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """(doc_id, n_tokens, root, chunks: array of (name, n, ids)), one row per row of docs."""

    def run(batches):
        trim()
        e = encoder(vocabulary)
        for b in (part for batch in batches for part in _slices(batch)):
            if b.num_rows:
                ids, count = e.encode([t or "" for t in b.column(1).to_pylist()])
                offsets = np.concatenate(([0], np.cumsum(count + 1)))
                out = np.full(len(ids) + len(count), end, dtype=e.dtype)
                out[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
                yield _rows(b.column(0), out, offsets)
        trim()

    chosen = docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"cast(`{text}` as string) as text")
    return chosen.mapInArrow(run, "doc_id long, n_tokens long, root binary, chunks array<struct<name: binary, n: int, ids: binary>>")


def _slices(batch: pa.RecordBatch):
    """Runs of rows of about SLICE bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
    edges = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SLICE)) + 1
    for x, y in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        yield batch.slice(x, y - x)


_CHUNKS = pa.struct([("name", pa.binary()), ("n", pa.int32()), ("ids", pa.binary())])


def _rows(keys, ids: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    raw, width = ids.tobytes(), ids.dtype.itemsize
    names, lengths, parts, roots, per = [], [], [], [], [0]
    for begin, ends in zip(offsets[:-1].tolist(), cuts(ids, offsets), strict=True):
        own = []
        for e in ends:
            parts.append(raw[begin * width : e * width])
            lengths.append(e - begin)
            own.append(name_of(parts[-1]))
            begin = e
        names += own
        roots.append(merkle(own))
        per.append(len(names))
    chunks = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(lengths, pa.int32()), pa.array(parts, pa.binary())], fields=list(_CHUNKS))
    return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets), pa.int64()), pa.array(roots, pa.binary()), pa.ListArray.from_arrays(pa.array(per, pa.int32()), chunks)], names=["doc_id", "n_tokens", "root", "chunks"])


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Write the store of docs to path/{chunks,recipes,manifest}.

    A null text is an empty one: its only id is the end id. Rows are in
    ascending order of the key, null keys last; repeated rows are stored as often
    (their chunks once), in any order among equals. Other columns are ignored; an
    empty table gives an empty store. A document may be of any length.
    """
    spark = docs.sparkSession
    dtype = encoder(vocabulary).dtype
    staged = f"{path}/staged"
    encode(docs, key, text, vocabulary, end).write.option("compression", "zstd").parquet(staged)
    rows = spark.read.schema("doc_id long, n_tokens long, root binary, chunks array<struct<name: binary, n: int, ids: binary>>").parquet(staged)
    chunk = rows.select(F.explode("chunks").alias("c")).select("c.name", "c.n", "c.ids")
    chunk.groupBy("name").agg(F.first("n").alias("n"), F.first("ids").alias("ids"), F.count("*").alias("uses")).write.option("compression", "zstd").parquet(f"{path}/chunks")
    joined = F.unhex(F.array_join(F.transform(F.col("chunks.name"), lambda x: F.hex(x)), ""))  # one pass, however many chunks
    lists = rows.select("doc_id", "n_tokens", "root", joined.alias("names"))
    placed = prefix_sums(lists, [], ["doc_id"], "n_tokens", "start")
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    about = [F.lit(v).alias(c) for c, v in (("width", dtype.itemsize), ("vocabulary", vocabulary), ("end", end))]
    _blocks(spark.read.schema(_RECIPE).parquet(f"{path}/recipes")).select("*", *about).write.parquet(f"{path}/manifest")
    documents, root = _total(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest"))
    spark.createDataFrame([(-1, documents, root, dtype.itemsize, vocabulary, end)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


_MANIFEST = "block long, documents long, root binary, width int, vocabulary string, `end` int"


def _blocks(recipes: DataFrame) -> DataFrame:
    """(block, documents, root) of recipes: the Merkle root of the documents that
    begin among the BLOCK ids of a block. A leaf binds a document's id, place,
    length and root."""

    def root(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "n_tokens"])
        leaves = [f"{k} {s} {n} ".encode() + bytes(r or b"") for k, s, n, r in zip(pdf["key"], pdf["start"], pdf["n_tokens"], pdf["root"], strict=True)]
        return pd.DataFrame({"block": [pdf["start"].iloc[0] // BLOCK], "documents": [len(pdf)], "root": [merkle(leaves)]})

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    return recipes.select(key, "start", "n_tokens", "root").groupBy(F.expr(f"start div {BLOCK}")).applyInPandas(root, "block long, documents long, root binary")


def _total(blocks: DataFrame) -> tuple[int, bytes]:
    """(documents, root) of the whole store, by way of a node for UNDER blocks."""

    def root(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({"node": [pdf["block"].iloc[0] // UNDER], "documents": [pdf["documents"].sum()], "root": [merkle([f"{k} {n} ".encode() + bytes(r or b"") for k, n, r in zip(pdf["block"], pdf["documents"], pdf["root"], strict=True)])]})

    nodes = blocks.groupBy(F.expr(f"block div {UNDER}")).applyInPandas(root, "node long, documents long, root binary")
    nodes = nodes.orderBy("node").toPandas()  # a row for BLOCK * UNDER ids
    return int(nodes.documents.sum()), merkle([bytes(x) for x in nodes.root])


def verify(spark: SparkSession, path: str) -> int:
    """Raise unless the recipes are those of the manifest, none missing, changed or
    added, and the manifest's blocks give its total; returns the ids' width."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    total = manifest.where("block < 0").first()
    if total is None:
        raise ValueError("the manifest has no total")
    blocks = manifest.where("block >= 0").select("block", "documents", "root")
    if _total(blocks) != (total["documents"], bytes(total["root"])):
        raise ValueError("the manifest's blocks haven't its root")
    now = _blocks(spark.read.schema(_RECIPE).parquet(f"{path}/recipes"))
    then = blocks.select(*[F.col(c).alias(f"_{c}") for c in blocks.columns])
    same = F.col("documents").eqNullSafe(F.col("_documents")) & F.col("root").eqNullSafe(F.col("_root"))
    wrong = now.join(then, F.col("block") == F.col("_block"), "full").where(~same).select(F.coalesce("block", "_block")).take(1)
    if wrong:
        raise ValueError(f"the recipes of block {wrong[0][0]} aren't those of the manifest")
    return total["width"]


@functools.cache
def _shift(n_bytes: int) -> np.ndarray:
    """Four tables of 256: what n_bytes zero bytes do to a crc32 register."""
    base = zlib.crc32(bytes(n_bytes))
    # crc32 is affine: its change with the starting value is linear.
    bits = [zlib.crc32(bytes(n_bytes), 1 << k) ^ base for k in range(32)]
    out = np.zeros((4, 256), dtype=np.uint32)
    for t in range(4):
        for k in range(8):
            low = 1 << k
            out[t, low : 2 * low] = out[t, :low] ^ np.uint32(bits[8 * t + k])
    return out


def combine(crcs: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """crc32 of the joined parts of each document, from its parts' crc32 and
    lengths in bytes: parts offsets[i]:offsets[i + 1] are document i's."""
    sizes, which = np.unique(lengths, return_inverse=True)
    tables = np.stack([_shift(int(n)) for n in sizes]) if len(sizes) else np.zeros((0, 4, 256), dtype=np.uint32)
    count = np.diff(offsets)
    out = np.zeros(len(count), dtype=np.uint32)
    live = np.flatnonzero(count > 0)
    out[live] = crcs[offsets[:-1][live]]
    for j in range(1, int(count.max()) if len(count) else 0):
        live = live[count[live] > j]
        at = offsets[:-1][live] + j
        c, k = out[live], which[at]
        out[live] = tables[k, 0, c & 255] ^ tables[k, 1, c >> 8 & 255] ^ tables[k, 2, c >> 16 & 255] ^ tables[k, 3, c >> 24] ^ crcs[at].astype(np.uint32)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of a store; raises if
    the recipes aren't those of the manifest, a recipe doesn't have its root, or a
    chunk is missing or its bytes don't have its name."""
    dtype = np.dtype(f"<u{verify(spark, path)}")

    def check(batches):
        for b in batches:
            names, crc, n = b.column(0).to_pylist(), [], []
            for name, raw in zip(names, b.column(1), strict=True):
                raw = raw.as_py()
                if name_of(raw) != name:
                    raise ValueError(f"chunk {name.hex()} is damaged")
                ids = np.frombuffer(raw, dtype=dtype).astype("<u4")
                crc.append(zlib.crc32(ids.tobytes()))
                n.append(len(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crc, pa.int64()), pa.array(n, pa.int64())], names=["name", "crc", "n"])

    stored = spark.read.schema(_CHUNK).parquet(f"{path}/chunks")
    chunks = stored.select("name", "ids").mapInArrow(check, "name binary, crc long, n long")
    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")
    # A chunk that very many parts name is joined in copies.
    uses = stored.select("name", F.col("uses").alias("_m"))
    parts = spread_join(_parts(recipes, "start"), chunks, "name", "left", counts=uses, hot=HOT)
    found = parts.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("at", "crc", "n"))).alias("parts"))
    found = found.select("start", F.col("parts.crc").alias("crc"), F.col("parts.n").alias("n"))
    whole = found.join(recipes, "start").select("start", "doc_id", "n_tokens", "root", "names", "crc", "n")

    def rebuild(batches):
        for b in batches:
            crc, n = b.column(5), b.column(6)
            offsets = crc.offsets.to_numpy().astype(np.int64)
            offsets -= offsets[0]
            if crc.flatten().null_count:
                raise ValueError("a chunk is missing")
            c, k = crc.flatten().to_numpy(), n.flatten().to_numpy()
            if len(offsets) > 1 and not np.array_equal(np.add.reduceat(k, offsets[:-1]), b.column(2).to_numpy()):
                raise ValueError("a document's length isn't that of its chunks")
            for root, names in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if merkle([names[x : x + NAME] for x in range(0, len(names), NAME)]) != root:
                    raise ValueError("a recipe hasn't its root")
            out = combine(c.astype(np.uint32), 4 * k, offsets)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), b.column(2), pa.array(out.astype(np.int64), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.mapInArrow(rebuild, "doc_id long, start long, n_tokens long, ids_crc32 long")


_CHUNK = "name binary, n int, ids binary, uses long"
_RECIPE = "doc_id long, n_tokens long, root binary, names binary, start long"


def _parts(recipes: DataFrame, *columns: str) -> DataFrame:
    """A row (columns, at, name) for each chunk of each recipe."""
    at = F.explode(F.sequence(F.lit(0), (F.length("names") / NAME).cast("int") - 1))
    return recipes.select(*columns, "names", at.alias("at")).select(*columns, "at", F.substring("names", F.col("at") * NAME + 1, F.lit(NAME)).alias("name"))


def restore(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids: array of int) of a store, rebuilt from its chunks."""
    dtype = np.dtype(f"<u{verify(spark, path)}")
    chunks = spark.read.schema(_CHUNK).parquet(f"{path}/chunks").select("name", "ids")
    recipes = spark.read.schema(_RECIPE).parquet(f"{path}/recipes")
    parts = _parts(recipes, "doc_id", "start").join(chunks, "name")
    whole = parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))

    def join(batches):
        for pdf in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in ps), dtype=dtype).tolist() for ps in pdf["parts"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "start": pdf["start"], "ids": ids})

    return whole.mapInPandas(join, "doc_id long, start long, ids array<int>")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
