"""MinHash near-duplicates by a chosen-path similarity join.

Texts with the same words are one class. Each class has T minwise values of its
shingle set. In each of TREES trees a node's members are branched by selected
minwise values, so that classes that agree on all values of a path meet; nodes
of at most SMALL members are compared exhaustively on their sketches, and what
looks similar is confirmed on full shingle sets. Trees are independent: a pair
of similarity 0.75 misses all of them with probability 0.25 ** TREES, times what
the sketch filter loses (about 1e-6).

Nodes that stay large are first compared with one pivot (one pair a member).
Then components are found, and only huge nodes that still hold several components
branch on, so a group of thousands of near copies costs a few pairs a member.
Small nodes with many similar pairs across components are compared on full sets
at once and give a spanning forest, so candidates grow with the members alone.
Mixed nodes of up to MEDIUM members, and whatever is still large after DEPTH
levels, are compared exhaustively too, in pairs of blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import maybe_broadcast, saved, small, spread_join, table, trim
from .components import components

SHINGLE, SIMILARITY = 5, 75
T, TREES, BRANCH, SMALL, MEDIUM, DEPTH = 48, 8, 3, 1000, 8000, 5
#: Of T minwise values, those that must agree; with similarity 0.75 fewer do with probability 1e-6.
AGREE = 21
#: Similar pairs a member above which a node is compared exhaustively on full sets at once.
MANY = 2
_FACTORS = wordhash.stream(5, T) | np.uint64(1)
_PLACES = wordhash.stream(6, SHINGLE) | np.uint64(1)


def shingles(texts: list[str | None], size: int = SHINGLE):
    """For each text: (sorted distinct 64-bit hashes of its shingles, hashes of its words)."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower: A-Z only
    for _, hashes, offsets in wordhash.word_lists(raw):
        windows = hashes[:0]
        if len(hashes) >= size:
            n = len(hashes) - size + 1
            windows = np.zeros(n, dtype=np.uint64)
            for j in range(size):
                windows += hashes[j : j + n] * _PLACES[j]
            windows = wordhash.mix(windows)
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            words = hashes[a:b]
            if b - a >= size:
                yield np.unique(windows[a : b - size + 1]), words
            elif b > a:
                yield wordhash.mix((words * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)), words
            else:
                yield words, words


def signature(values: np.ndarray) -> np.ndarray:
    """T minwise values of a set, as 32-bit ints."""
    least = np.full(T, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(values), 2048):
        least = np.minimum(least, (values[k : k + 2048, None] * _FACTORS).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def content_id(words: np.ndarray) -> int:
    """64 bits of the word sequence, equal for texts with the same words only."""
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, cid, n_shingles, sig) of rows (doc_id, raw, text)."""

    def run(batches):
        for b in batches:
            cid, n, sig = [], [], []
            for values, words in shingles(b.column(2).to_pylist()):
                n.append(len(values))
                cid.append(content_id(words) if len(values) else None)
                sig.append(signature(values).tolist() if len(values) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cid, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], names=["doc_id", "raw", "cid", "n_shingles", "sig"])
        trim()

    return docs.mapInArrow(run, "doc_id long, raw long, cid long, n_shingles long, sig array<int>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, set) of the classes in wanted (cid, raw), from the texts again.
    A class's text is found by the hash of one of its raw texts."""
    keys = wanted.select(F.col("raw").alias("_raw")).distinct()
    if small(keys, 2_000_000):  # at most 16 MB
        keys = F.broadcast(keys)

    def run(batches):
        for b in batches:
            cid, sets = [], []
            for values, words in shingles(b.column(0).to_pylist()):
                cid.append(content_id(words))
                sets.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(sets, pa.binary())], names=["cid", "set"])

    found = docs.join(keys, F.col("raw") == F.col("_raw"), "left_semi").select("text").mapInArrow(run, "cid long, set binary")
    return found.dropDuplicates(["cid"])


def confirm(found: DataFrame, docs: DataFrame, classes: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """Links (a, b) among candidates (a, b, node): pairs, and members (a, node)
    of nodes to be compared exhaustively, of which a spanning forest is returned."""
    ids = found.select(F.col("a").alias("cid")).unionByName(found.where("b is not null").select(F.col("b").alias("cid"))).distinct()
    sets = saved(full_sets(docs, classes.select("cid", "raw").join(maybe_broadcast(ids, 1_000_000), "cid")), "sets")
    left = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
    # The pivot of a hot node is the `a` of all its pairs.
    joined = spread_join(found.where("node is null").select("a", "b"), left, "a", hot=SMALL // 2).join(right, "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            a_, b_, sa, sb = (b.column(k) for k in range(4))
            keep = []
            for x, y in zip(sa, sb, strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                keep.append(100 * common >= similarity * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a_.filter(mask), b_.filter(mask)], names=["a", "b"])

    def exhaust(pdf: pd.DataFrame) -> pd.DataFrame:
        ids_, lists = pdf["a"].to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in pdf["sa"]]
        size, edges = np.array([len(x) for x in lists]), []
        common = _common(lists)
        linked = 100 * common >= similarity * (size[:, None] + size[None, :] - common)
        edges = [(ids_[x], ids_[y]) for x, y in _forest(linked)]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    links = joined.mapInArrow(run, "a long, b long")
    dense = found.where("node is not null").select("node", "a")
    if dense.take(1):
        links = links.unionByName(dense.join(left, "a").groupBy("node").applyInPandas(exhaust, "a long, b long"))
    return links


def _common(lists: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets, as one product of incidence blocks."""
    m = len(lists)
    _, number, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(x) for x in lists])
    keep = count[number] > 1
    row, number = row[keep], np.unique(number[keep], return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    out = np.zeros((m, m), dtype=np.float32)
    np.fill_diagonal(out, [len(x) for x in lists])
    whole = out.copy()
    step = 2048
    bounds = np.searchsorted(number, np.arange(0, (int(number[-1]) + 1 if len(number) else 0) + step, step))
    out[:] = 0
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        block = np.zeros((m, step), dtype=np.float32)
        block[row[a:b], number[a:b] - k * step] = 1
        out += block @ block.T
    np.fill_diagonal(out, whole.diagonal())
    return out.astype(np.int64)


def _similar(marks: np.ndarray) -> np.ndarray:
    """Which pairs of rows agree in AGREE places at least."""
    m = len(marks)
    same = np.zeros((m, m), dtype=np.int16)
    for j in range(marks.shape[1]):
        same += marks[:, j, None] == marks[None, :, j]
    return same >= AGREE


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest, stars where they can be."""
    m, seen, edges = len(near), np.zeros(len(near), dtype=bool), []
    for root in range(m):
        if seen[root]:
            continue
        seen[root], queue = True, [root]
        while queue:
            x = queue.pop(0)
            for y in np.flatnonzero(near[x] & ~seen):
                seen[y] = True
                edges.append((x, int(y)))
                queue.append(int(y))
    return edges


def small_node_pairs(nodes: DataFrame, across: bool) -> DataFrame:
    """Candidates (a, b, node) from rows (node, members: array of (cid, label,
    marks)). across: similar pairs with different labels, or, where these are
    many, the members of the node that have such pairs; else a spanning forest
    of the similar pairs."""

    def run(batches):
        for pdf in batches:
            pairs: set[tuple[int, int]] = set()
            dense: list[tuple[int, int]] = []
            for node, members in zip(pdf["node"], pdf["members"], strict=True):
                ids = sorted(((x["cid"], x["label"], x["marks"]) for x in members), key=lambda x: x[0])
                near = _similar(np.frombuffer(b"".join(x[2] for x in ids), dtype=np.uint8).reshape(len(ids), T))
                if across:
                    label = np.array([x[1] for x in ids])
                    near &= label[:, None] != label[None, :]
                    active = np.flatnonzero(near.any(axis=1))
                    if near.sum() > 2 * MANY * len(active):
                        dense += [(ids[x][0], node) for x in active]
                        continue
                    found = zip(*np.nonzero(np.triu(near)), strict=True)
                else:
                    found = _forest(near)
                pairs.update((ids[x][0], ids[y][0]) for x, y in found)
            rows = [(min(p), max(p), None) for p in sorted(pairs)] + [(c, None, n) for c, n in dense]
            yield pd.DataFrame({c: pd.array([r[k] for r in rows], dtype="Int64") for k, c in enumerate(("a", "b", "node"))})

    return nodes.mapInPandas(run, "a long, b long, node long")


def _marks(sig) -> F.Column:
    """One byte of each minwise value, as binary."""
    return F.unhex(F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v.bitwiseAND(255)), 2, "0")), ""))


def _collected(members: DataFrame) -> DataFrame:
    return members.groupBy("node").agg(F.collect_list(F.struct("cid", "label", "marks")).alias("members"))


def _branch(members: DataFrame, level: int) -> DataFrame:
    """Rows (node, cid, label) of the next level from rows (node, cid, label, sig)."""
    ways = [F.pmod(F.xxhash64(F.col("node"), F.lit(level), F.lit(j)), F.lit(T)).cast("int") for j in range(BRANCH)]
    child = [F.xxhash64(F.col("node"), F.lit(j), w, F.element_at("sig", w + 1)) for j, w in enumerate(ways)]
    return members.select(F.explode(F.array(*child)).alias("node"), "cid", "label")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of class ids that have links, from classes (cid, raw, sig)."""
    base = classes.select("cid", "raw", "sig", _marks(F.col("sig")).alias("marks"))
    roots = F.array(*[F.xxhash64(F.lit("tree"), F.lit(r), F.element_at("sig", r + 1)) for r in range(TREES)])
    members = base.select(F.explode(roots).alias("node"), "cid", F.col("cid").alias("label"))
    labels, mixed_small = None, None
    for level in range(DEPTH + 1):
        last = level == DEPTH
        sizes = members.groupBy("node").agg(F.count("*").alias("m"), F.min("cid").alias("pivot"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("m > 1 and l0 <> l1")
        sizes = saved(sizes.drop("l0", "l1"), "sizes")
        nodes = saved(spread_join(members, sizes, "node", counts=sizes.select("node", F.col("m").alias("_m")), hot=SMALL), "nodes")
        little, large = nodes.where(F.col("m") <= SMALL), nodes.where(F.col("m") > SMALL)
        hot, huge = bool(large.take(1)), bool(nodes.where(F.col("m") > MEDIUM).take(1))
        pairs = small_node_pairs(_collected(little.join(base.select("cid", "marks"), "cid")), across=level > 0)
        if mixed_small is not None:
            pairs = pairs.unionByName(small_node_pairs(mixed_small, across=True))
        if hot:
            pairs = pairs.unionByName(large.where("cid <> pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b"), F.lit(None).cast("long").alias("node")))
        pairs = saved(pairs.distinct(), "pairs")
        found = confirm(pairs, docs, base)
        if labels is not None:
            found = found.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        labels = saved(components(found), "labels")
        if last or level > 0 and not hot:
            break
        relabel = lambda d: d.drop("label").join(labels.select(F.col("node").alias("cid"), F.col("component").alias("_l")), "cid", "left").withColumn("label", F.coalesce("_l", "cid")).drop("_l")
        rest = saved(_mixed(saved(relabel(nodes if level == 0 else large), "relabelled")), "mixed")
        again = rest.where(F.col("m") <= SMALL).select("node", "cid", "label")
        if hot:
            blocked = rest.where(F.col("m") > SMALL) if level + 1 == DEPTH else rest.where((F.col("m") > SMALL) & (F.col("m") <= MEDIUM))
            again = again.unionByName(_in_blocks(blocked))
        mixed_small = _collected(again.join(base.select("cid", "marks"), "cid"))
        members = rest.where("false").select("node", "cid", "label")
        if huge and level + 1 < DEPTH:
            members = _branch(rest.where(F.col("m") > MEDIUM).join(base.select("cid", "sig"), "cid"), level + 1)
    return labels


def _mixed(members: DataFrame) -> DataFrame:
    """Members (node, label, ..) of nodes that hold several labels."""
    found = saved(members.groupBy("node").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("_m")).where("l0 <> l1"), "labelled")
    return spread_join(members, found.select("node"), "node", "left_semi", counts=found.select("node", "_m"), hot=SMALL)


def _in_blocks(members: DataFrame) -> DataFrame:
    """Nodes (node, m, cid, label) of m > SMALL members as many nodes of SMALL
    members or so: one for each two blocks of half as many."""
    n = F.ceil(F.col("m") * 2 / SMALL).cast("int")
    block = F.pmod(F.xxhash64(F.lit("block"), "cid"), F.col("_n")).cast("int")
    dealt = members.withColumn("_n", n).withColumn("_b", block)
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: j != F.col("_b")))
    return dealt.withColumn("_o", other).select(F.xxhash64("node", F.least("_b", "_o"), F.greatest("_b", "_o")).alias("node"), "cid", "label")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, raw), one row per row of docs;
    raw is the text's hash.

    Texts without words (null, empty, white space) have 0 shingles and no links.
    Rows with the same words are linked. component_id is the smallest non-null id
    reachable; a row with a null id is kept only if its component has no other
    id. Repeated rows of one id each get a row, and are kept alike. Other columns
    are ignored; an empty table gives no rows. Texts are taken whole.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("raw"), F.col(text).cast("string").alias("text"))
    sketched = saved(sketch(rows), "sketches")
    classes = saved(sketched.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"), F.min("raw").alias("raw"), F.min("sig").alias("sig")), "classes")
    labels = links(rows, classes)
    named = classes.select("cid", "least").join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = saved(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    joined = named.join(least, "component").select(F.col("cid").alias("_cid"), "component_id")
    out = sketched.select("doc_id", "n_shingles", "cid", "raw").join(joined, F.col("cid") == F.col("_cid"), "left")
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "raw")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("raw")
