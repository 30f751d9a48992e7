"""Embedding near-duplicates by product quantisation.

Coarse centroids and residual codebooks are fitted on a bounded sample. Every
distinct vector is put in the inverted list of its nearest centroid with a code
of its residual and the code's error. Every vector visits its PROBES nearest
lists; there, inner products come from look-up tables (asymmetric: the visitor
is exact), and since an approximate cosine is off by the error at most, only
residents that can't reach the threshold are left out. The rest get exact
cosines in double precision. Lists and visits are dealt out in blocks, so a list
with a third of all vectors is many tasks.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .components import components

COSINE = 0.9
#: Sample (values, not rows, so that wide vectors don't need more memory), mean
#: length of a list, most lists, lists visited, width of a subspace, codes of one.
SAMPLE_VALUES, LIST, LISTS, PROBES, SUBSPACE, CODES = 1_280_000, 64, 2048, 24, 4, 64
#: Most residents and visitors of a task.
RESIDENTS, VISITORS = 1024, 4096


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = nearest(x, c)[:, 0]
        n = np.bincount(a, minlength=k)
        order = np.argsort(a, kind="stable")
        used = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(n[used])[:-1])), axis=0)
        c[used] = sums / n[used, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int = 1) -> np.ndarray:
    """Indexes of the n nearest rows of c for each row of x, nearest first."""
    out = np.empty((len(x), min(n, len(c))), dtype=np.int32)
    half = (c * c).sum(axis=1) / 2
    for k in range(0, len(x), 2048):
        d = half - x[k : k + 2048] @ c.T
        if out.shape[1] == 1:
            out[k : k + 2048, 0] = d.argmin(axis=1)
            continue
        top = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
        out[k : k + 2048] = np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, axis=1), axis=1, kind="stable"), axis=1)
    return out


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = kmeans(sample, lists, 8)
        residual = sample - self.coarse[nearest(sample, self.coarse)[:, 0]]
        self.edges = [*range(0, sample.shape[1], SUBSPACE), sample.shape[1]]
        self.books = [kmeans(residual[:, a:b], CODES, 6) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def codes(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norm of what they miss)."""
        residual = x - self.coarse[home]
        out, missed = np.empty((len(x), len(self.books)), dtype=np.uint8), np.zeros(len(x))
        for j, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            out[:, j] = nearest(residual[:, a:b], self.books[j])[:, 0]
            missed += ((residual[:, a:b] - self.books[j][out[:, j]]) ** 2).sum(axis=1)
        return out, np.sqrt(missed)

    def approximate(self, visitors: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Inner products of visitors with coded residents of a list, from tables."""
        out = np.repeat((visitors @ self.coarse[home])[:, None], len(codes), axis=1)
        for j, (a, b) in enumerate(zip(self.edges[:-1], self.edges[1:], strict=True)):
            out += (visitors[:, a:b] @ self.books[j].T)[:, codes[:, j]]
        return out


def _unit(column) -> np.ndarray:
    x = np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors.

    Null, empty and zero vectors and those with null or non-finite components link
    with nothing. Vectors of each length that occurs are searched by themselves,
    lengths of few vectors by all pairs. Equal vectors link with each other. Rows that repeat an id are
    vectors of their own, with links to each other. A null id is never a
    component's smallest id unless all are null. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))

    def prepare(batches):
        for b in batches:
            cid, raw = [], []
            for v in b.column(1).to_pylist():
                good = v is not None and len(v) > 0 and None not in v
                x = np.array(v, dtype=np.float64) if good else None
                if good and np.isfinite(x).all() and x.any():
                    # An exact power of two, so that no square under- or overflows.
                    raw.append(np.ldexp(x, -np.frexp(np.abs(x).max())[1]).tobytes())
                    cid.append(int.from_bytes(hashlib.blake2b(raw[-1], digest_size=8).digest(), "little", signed=True))
                else:
                    raw.append(None)
                    cid.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cid, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "cid", "raw"])

    prepared = rows.mapInArrow(prepare, "vec_id long, cid long, raw binary")
    classes = saved(prepared.where("cid is not null").groupBy("cid").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"), F.first("raw").alias("raw")), "vectors")
    classes = classes.withColumn("dim", F.expr("octet_length(raw) div 8"))
    lengths = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length
    if lengths:
        few = [d for d, n in lengths.items() if n <= RESIDENTS and n * d <= SAMPLE_VALUES and n < max(lengths.values())]
        found = [_search(classes.where(F.col("dim") == d).drop("dim"), n, d, cosine, probes) for d, n in lengths.items() if d not in few]
        if few:
            found.append(_pairs(classes.where(F.col("dim").isin(few)), cosine))
        counts, edges = (functools.reduce(DataFrame.unionByName, x) for x in zip(*found, strict=True))
        labels = components(edges)
        named = classes.select("cid", "w", "least").join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left").join(counts, "cid", "left")
        named = saved(named.withColumn("component", F.coalesce("component", "cid")), "named")
    else:
        named = classes.select("cid", "w", "least", F.col("cid").alias("component"), F.lit(0).cast("long").alias("links"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    links = (F.coalesce("links", F.lit(0)) + F.col("w") - 1).cast("long")
    found = named.join(least, "component").select(F.col("cid").alias("_cid"), links.alias("_links"), "component_id")
    out = prepared.select("vec_id", "cid").join(found, F.col("cid") == F.col("_cid"), "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _pairs(classes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """As _search, by all pairs of each length."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, cid, w = _unit(pdf["raw"]), pdf["cid"].to_numpy(), pdf["w"].to_numpy()
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        n = near @ w
        ends = _forest(*(cid[k] for k in np.nonzero(np.triu(near))))
        links = pd.DataFrame({"a": cid[n > 0], "b": None, "n": n[n > 0]})
        return pd.concat([links, pd.DataFrame(ends, columns=["a", "b"]).assign(n=0)]) if ends else links

    return _split(classes.select("dim", "cid", "w", "raw").groupBy("dim").applyInPandas(compare, "a long, b long, n long"))


def _split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    found = saved(found, "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    return counts, found.where("b is not null").select("a", "b")


def _search(classes: DataFrame, n: int, dim: int, cosine: float, probes: int) -> tuple[DataFrame, DataFrame]:
    """(cid, links) and forest edges (a, b)."""
    spark = classes.sparkSession
    rows = max(256, SAMPLE_VALUES // dim)
    sample = _unit(classes.orderBy("cid").limit(rows).select("raw").toPandas()["raw"])  # cid is a hash: a random sample
    model = spark.sparkContext.broadcast(Quantiser(sample, max(1, min(LISTS, n // LIST))))  # at most LISTS + CODES rows of floats

    def place(batches):
        m = model.value
        for pdf in batches:
            if len(pdf):
                x = _unit(pdf["raw"])
                near = nearest(x, m.coarse, probes)
                codes, missed = m.codes(x, near[:, 0])
                yield pd.DataFrame({"cid": pdf["cid"], "w": pdf["w"], "raw": pdf["raw"], "home": near[:, 0], "probes": list(near), "codes": [c.tobytes() for c in codes], "missed": missed})

    placed = saved(classes.select("cid", "w", "raw").mapInPandas(place, "cid long, w long, raw binary, home int, probes array<int>, codes binary, missed double"), "placed")
    visits = placed.select("cid", "w", "raw", "home", F.explode("probes").alias("list"))
    sizes = placed.groupBy(F.col("home").alias("list")).agg(F.count("*").alias("m")).join(visits.groupBy("list").agg(F.count("*").alias("q")), "list")
    grid = F.broadcast(sizes.select(F.col("list").alias("_list"), F.ceil(F.col("m") / RESIDENTS).cast("int").alias("nr"), F.ceil(F.col("q") / VISITORS).cast("int").alias("nv")))  # at most LISTS rows
    block = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "cid"), of).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    none = lambda kind: F.lit(None).cast(kind)
    residents = placed.join(grid, F.col("home") == F.col("_list")).select(F.col("home").alias("list"), block("r", F.col("nr")).alias("rb"), every("nv").alias("vb"), F.lit(True).alias("resident"), "cid", "w", "raw", "home", "probes", "codes", "missed")
    visitors = visits.join(grid, F.col("list") == F.col("_list")).select("list", every("nr").alias("rb"), block("v", F.col("nv")).alias("vb"), F.lit(False).alias("resident"), "cid", "w", "raw", "home", none("array<int>").alias("probes"), none("binary").alias("codes"), none("double").alias("missed"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        r, v = pdf[pdf.resident], pdf[~pdf.resident]
        if not len(r) or not len(v):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        m, home = model.value, int(r["home"].iloc[0])
        x, q = _unit(r["raw"]), _unit(v["raw"])
        codes = np.frombuffer(b"".join(r["codes"]), dtype=np.uint8).reshape(len(r), -1)
        rid, qid, rw, qw, qhome = r["cid"].to_numpy(), v["cid"].to_numpy(), r["w"].to_numpy(), v["w"].to_numpy(), v["home"].to_numpy()
        probed = np.zeros((len(r), len(m.coarse)), dtype=bool)
        for k, p in enumerate(r["probes"]):
            probed[k, p] = True
        missed = r["missed"].to_numpy()
        links_q, links_r, edges = np.zeros(len(v), dtype=np.int64), np.zeros(len(r), dtype=np.int64), set()
        for s in range(0, len(v), 512):
            e = slice(s, s + 512)
            # A pair that both sides find counts in the list of the smaller number, a pair of one list once.
            once = ~probed[:, qhome[e]].T | (home < qhome[e])[:, None]
            once = np.where((qhome[e] == home)[:, None], qid[e][:, None] < rid[None, :], once)
            a, b = np.nonzero(once & (m.approximate(q[e], home, codes) + missed[None, :] >= cosine - 1e-9))
            if not len(a):
                continue
            if len(a) > 0.02 * once.size:
                exact = (q[e] @ x.T)[a, b]
            else:
                exact = np.einsum("ij,ij->i", q[e][a], x[b])
            a, b = a[exact >= cosine], b[exact >= cosine]
            links_q[e] += np.bincount(a, weights=rw[b], minlength=len(q[e])).astype(np.int64)
            links_r += np.bincount(b, weights=qw[e][a], minlength=len(r)).astype(np.int64)
            edges.update(_forest(qid[e][a], rid[b]))
        ends = _forest(*np.array(sorted(edges), dtype=np.int64).reshape(-1, 2).T)
        out = pd.DataFrame({"a": np.concatenate([qid, rid]), "n": np.concatenate([links_q, links_r])})
        out = out[out.n > 0].assign(b=None)
        return pd.concat([out, pd.DataFrame(ends, columns=["a", "b"]).assign(n=0)])[["a", "b", "n"]] if ends else out[["a", "b", "n"]]

    return _split(residents.unionByName(visitors).groupBy("list", "rb", "vb").applyInPandas(compare, "a long, b long, n long"))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the edges (a, b) those that join what was apart."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = find(x), find(y)
        if rx != ry:
            root[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
