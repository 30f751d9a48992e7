"""Compression classifier of text quality.

Two zstandard dictionaries are trained, one on pieces of good and one on pieces
of bad labelled texts. A text is compressed piece by piece with either; the
difference of the two sizes over the text's size is its only feature, and a
monotone curve fitted on other labelled rows turns it into a probability.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Bytes of a piece; bytes of a dictionary.
PIECE, DICTIONARY, LEVEL = 1024, 32_768, 3
#: Labelled rows of each class that train the dictionaries, and as many that fit
#: the curve: the bound on the sample, whatever the size of the tables. Texts are
#: taken whole, and no further rows once those of a class have SAMPLE_BYTES.
SAMPLE, SAMPLE_BYTES = 2_000, 16 << 20
THRESHOLD, FOLDS = 0.3, 5


def fold(key) -> F.Column:
    """crc32 of the id's decimal text, mod FOLDS; rows of fold 0 are held out."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def pieces(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


@functools.lru_cache(maxsize=4)
def compressor(dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    """(size under the bad dictionary - size under the good one) / bytes; 0 for no text."""
    parts = pieces(text)
    g, b = compressor(good), compressor(bad)
    total = sum(map(len, parts))
    return sum(len(b.compress(p)) - len(g.compress(p)) for p in parts) / total if total else 0.0


def train_dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too few pieces to train on: they are the dictionary
        return b"".join(samples)[-DICTIONARY:] or b" " * 8


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """(differences, probabilities, slope, middle, intercept): an isotonic curve
    (pool adjacent violators) and, to order what it leaves level, a logistic one.
    Weights undo the equal sampling of the classes."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean difference, mean label, weight
    for v, t, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        blocks.append([v, float(t), w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            v2, t2, w2 = blocks.pop()
            v1, t1, w1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), (t1 * w1 + t2 * w2) / (w1 + w2), w1 + w2]
    at, probability = [b[0] for b in blocks], [b[1] for b in blocks]
    middle, scale = float(x.mean()), float(x.std()) or 1.0
    weight = weight / weight.mean()
    a = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (weight * (y - p)) - 1e-3 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return at, probability, float(w[0] / scale), middle, float(w[1])


def probability(curve, x: float) -> float:
    at, level, slope, middle, intercept = curve
    smooth = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * (x - middle) + intercept))))
    return 0.98 * float(np.interp(x, at, level)) + 0.02 * smooth


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(good dictionary, bad dictionary, curve), or a single number, the score of
    all, where one class has no rows. Labels that are null or neither 0 nor 1, or
    that contradict each other, are not used."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).where("_q in (0, 1) and _id is not null").groupBy("_id").agg(F.min("_q").alias("_q"), F.max("_q").alias("_q2")).where("_q = _q2 ").where(fold(F.col("_id")) != 0)
    order = F.xxhash64(F.lit("quality"), F.col("_id"))
    chosen = None
    for q in (0, 1):
        part = known.where(F.col("_q") == q).orderBy(order, "_id").limit(2 * sample).select("_id", "_q")
        chosen = part if chosen is None else chosen.unionByName(part)
    use = F.when(F.pmod(F.xxhash64(F.lit("half"), F.col("_id")), F.lit(2)) == 0, F.lit("train")).otherwise(F.lit("curve"))
    rows = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.col("text").cast("string").alias("text"), F.col("_q").cast("int").alias("q"), use.alias("use"), "_id")

    def cut(batches):
        for b in batches:
            text, q = b.column(0).to_pylist(), b.column(1).to_pylist()
            parts = list(map(pieces, text))
            yield pa.RecordBatch.from_arrays([pa.array([p for ps in parts for p in ps], pa.binary()), pa.array([q[k] for k, ps in enumerate(parts) for _ in ps], pa.int32())], names=["piece", "q"])

    # A few thousand rows, dealt by class and half.
    before = Window.partitionBy("q", "use").orderBy(order, "_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_bytes", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("_bytes") < SAMPLE_BYTES)
    found = rows.where("use = 'train'").select("text", "q").mapInArrow(cut, "piece binary, q int").toPandas()
    found = found.sort_values("piece", kind="mergesort")
    prior = known.agg(F.avg("_q")).first()[0]
    if set(found.q) != {0, 1}:
        return 0.5 if prior is None else float(prior)
    bad, good = (train_dictionary(list(found.piece[found.q == q].sample(frac=1, random_state=7))) for q in (0, 1))

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([difference(t, good, bad) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["x", "q"])

    seen = rows.where("use = 'curve'").select("text", "q").mapInArrow(measure, "x double, q int").toPandas().sort_values(["x", "q"])
    if set(seen.q) != {0, 1}:
        return float(prior)
    total = {r["_q"]: r["n"] for r in known.groupBy("_q").agg(F.count("*").alias("n")).collect()}  # two rows
    q = seen.q.to_numpy()
    return good, bad, fit_curve(seen.x.to_numpy(), q, np.array([total[0], total[1]])[q] / np.bincount(q)[q])


def score(docs: DataFrame, model, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of docs.

    Whole texts are scored. Null and empty texts have difference 0 and the
    curve's score for that. Null keys count as the empty string's fold. Repeated
    rows keep their rows; other columns are ignored (with `keep`, those are
    returned before score and predicted instead of doc_id and held_out).
    """
    columns = keep or ["doc_id"]
    source = docs.select(*columns) if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at = source.columns.index("text")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if keep or f.name != "text"], "`_score` double"])

    def run(batches):
        for b in batches:
            if isinstance(model, float):
                s = [model] * b.num_rows
            else:
                good, bad, curve = model
                s = [probability(curve, difference(t, good, bad)) for t in b.column(at).to_pylist()]
            left = [b.column(k) for k in range(b.num_columns) if keep or k != at]
            yield pa.RecordBatch.from_arrays([*left, pa.array(s, pa.float64())], names=[*[n for k, n in enumerate(b.schema.names) if keep or k != at], "_score"])

    scored = source.mapInArrow(run, schema)
    if keep:
        return scored.where(F.col("_score") >= threshold).drop("_score")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
