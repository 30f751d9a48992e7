"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has virtual nodes on a ring of fixed points; a key belongs to the first
virtual node clockwise from its own point. A shard takes keys in hash order until it
is full; keys beyond go on clockwise to the next shard that isn't. That happens for
all shards at once, in rounds: each round fills a shard at least or is the last, so
there are at most as many rounds as shards, and after the first only overflow moves.

DataFrame functions only. Where a shard fills up is found in two levels: loads are
summed by (shard, bucket of the hash order), a window over the sums finds the bucket
in which each shard fills, and only that bucket's rows are ranked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .crc_sql import CRC_TABLE, crc32

SHARDS, POINTS, NODES, BUCKETS, SEED = 16, 1 << 16, 1024, 4096, "ring-1"
#: Copies of equal rows that are dealt as one; more are several parts.
PART = 10_000


def _draw(hexed: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(hexed, first, digits), 16, 10).cast("long")


def virtual_nodes(spark: SparkSession, shards: int) -> DataFrame:
    """(point, shard). A shard's nodes don't depend on the other shards; of nodes on
    one point that of the smallest hash holds it."""
    at = spark.range(shards * NODES, numPartitions=1).select(F.floor(F.col("id") / NODES).cast("int").alias("shard"), (F.col("id") % NODES).alias("_v"))
    at = at.withColumn("_h", F.md5(F.concat_ws(":", F.lit(SEED), "shard", "_v").cast("binary")))
    return at.groupBy((_draw(F.col("_h"), 1, 8) % POINTS).alias("point")).agg(F.min_by("shard", "_h").alias("shard"))


def owners(nodes: DataFrame) -> DataFrame:
    """(point, shard) for every point of the ring: the first node clockwise."""
    clockwise = Window.orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)  # a frame to the end would take a square of work
    ring = nodes.sparkSession.range(POINTS).toDF("point").join(nodes, "point", "left")
    around = F.min_by("shard", F.when(F.col("shard").isNotNull(), F.col("point"))).over(Window.partitionBy())
    return ring.select("point", F.coalesce(F.last("shard", ignorenulls=True).over(clockwise), around).alias("shard"))


def sizes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, size, text_crc32): bytes and one more, and the crc of the UTF-8 bytes."""
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))


def units(sized: DataFrame) -> DataFrame:
    """Equal rows as one row with their number `n` (at most PART), its point on the
    ring, and its place in the hash order (`bucket`, `place`)."""
    per = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_all"))
    per = per.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_all") - 1) / PART))))
    per = per.withColumn("n", F.least(F.lit(PART).cast("long"), F.col("_all") - F.col("_part") * PART))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    point = _draw(F.md5(F.concat_ws(":", F.lit(SEED), name).cast("binary")), 1, 8) % POINTS
    place = F.md5(F.concat_ws(":", name, "size", "text_crc32", "_part").cast("binary"))
    return per.select("doc_id", "size", "text_crc32", "n", point.alias("point"), place.alias("place")).withColumn("bucket", (_draw(F.col("place"), 1, 8) % BUCKETS).cast("int"))


def _load(law: str) -> Column:
    return F.lit(1).cast("long") if law == "rows" else F.col("size")


def _round(waiting: DataFrame, nodes: DataFrame, room: dict[int, int], law: str) -> DataFrame:
    """waiting with the shard that each row comes to and `k`, the copies that it takes.
    room: what is left of each open shard."""
    still = F.array([F.lit(s) for s in room])
    left = F.create_map(*[F.lit(x) for s in room for x in (s, room[s])])
    owner = owners(nodes.where(F.array_contains(still, F.col("shard"))))
    there = waiting.join(F.broadcast(owner), "point")  # POINTS rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = there.groupBy("shard", "bucket").agg(F.sum(F.col("n") * _load(law)).alias("_w"))
    sums = sums.withColumn("_left", F.element_at(left, F.col("shard")) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    cuts = sums.where((F.col("_left") > 0) & (F.col("_w") >= F.col("_left"))).select("shard", F.col("bucket").alias("_cut"), "_left")
    cuts = F.broadcast(saved(cuts, "cuts"))  # a row for each shard at most
    there = there.join(cuts, "shard", "left")
    whole = there.where(F.col("_cut").isNull() | (F.col("bucket") != F.col("_cut"))).withColumn("k", F.when(F.col("bucket") > F.col("_cut"), 0).otherwise(F.col("n")))
    ranked = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("_left") - F.coalesce(F.sum(F.col("n") * _load(law)).over(ranked), F.lit(0))
    edge = there.where(F.col("bucket") == F.col("_cut")).withColumn("_rest", rest)
    edge = edge.withColumn("k", F.greatest(F.lit(0), F.least(F.col("n"), F.ceil(F.col("_rest") / _load(law))))).drop("_rest")
    return whole.unionByName(edge).drop("_cut", "_left").withColumn("k", F.col("k").cast("long"))


def capacities(total: int, shards: int, law: str) -> dict[int, int]:
    """A shard takes a row while its load is under its capacity."""
    if law == "rows":
        return {s: total // shards + (s < total % shards) for s in range(shards)}
    return dict.fromkeys(range(shards), -(-total // shards))


def placed(sized: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """(doc_id, size, text_crc32, place, bucket, shard, k): k copies of a row in a shard."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"law is rows or bytes, not {law}")
    waiting = saved(units(sized), "units")
    total = waiting.agg(F.sum(F.col("n") * _load(law))).first()[0] or 0
    nodes = saved(virtual_nodes(waiting.sparkSession, shards), "nodes")
    room = {s: c for s, c in capacities(total, shards, law).items() if c > 0}
    rounds = []
    while room:
        done = saved(_round(waiting, nodes, room, law), "round")
        taken = done.groupBy("shard").agg(F.sum(F.col("k") * _load(law)).alias("w"), F.sum(F.col("n") - F.col("k")).alias("over")).collect()  # a row for each shard
        rounds.append(done.where("k > 0"))
        if not any(r.over for r in taken):
            break
        for r in taken:
            room[r.shard] -= r.w
        room = {s: c for s, c in room.items() if c > 0}
        waiting = done.where("k < n").withColumn("n", F.col("n") - F.col("k")).drop("shard", "k")
    if not rounds:
        rounds = [waiting.withColumn("shard", F.lit(0)).withColumn("k", F.col("n"))]
    return reduce(DataFrame.unionByName, [r.select("doc_id", "size", "text_crc32", "place", "bucket", "shard", "k") for r in rounds])


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of docs.

    law rows: numbers of rows are at most one apart, since capacities add up to the
    number of rows. law bytes: a shard takes rows until it holds its equal share, so
    it ends less than one document above it. Slots count from 0 in each shard, in hash
    order. grown_shard is null: with another shard capacities shrink everywhere, so
    rows move between old shards too (README has the share).

    A null text has no bytes and size 1; a null id is a key like any other. Rows that
    repeat have one point on the ring and go on clockwise from full shards row by
    row; rows equal in id, size and crc are dealt as one with a count. The order is
    by hash, so reruns and other partitionings agree. Other columns are ignored. An
    empty table gives no rows.
    """
    rows = saved(placed(sizes(docs, key, text), shards, law), "placed")
    counts = rows.groupBy("shard", "bucket").agg(F.sum("k").alias("_m"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.coalesce(F.sum("k").over(inside), F.lit(0)))
    rows = rows.join(F.broadcast(offsets), ["shard", "bucket"])  # shards * BUCKETS rows
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    rows = rows.select("*", copy.alias("_copy"))
    return rows.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("_offset") + F.col("_first") + F.col("_copy")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op12_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same in DuckDB, row by row; its rounds are written out, one for each shard."""
    hexed = "CAST('0x' || substr({}, 1, 8) AS BIGINT)".format
    ctes = [
        f"d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, {crc32("coalesce(text, '')")} AS crc FROM documents, {CRC_TABLE})",
        "parts AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS name, row_number() OVER (PARTITION BY doc_id, size, crc) - 1 AS rn FROM d)",
        f"w0 AS MATERIALIZED (SELECT doc_id, size, crc, rn, {hexed(f"md5('{SEED}:' || name)")} % {POINTS} AS point, md5(concat_ws(':', name, size, crc, rn // {PART})) AS place FROM parts)",
        f"b AS MATERIALIZED (SELECT *, {hexed('place')} % {BUCKETS} AS bucket FROM w0)",
        f"n0 AS MATERIALIZED (SELECT point, arg_min(s, h) AS s FROM (SELECT s, md5(concat_ws(':', '{SEED}', s, v)) AS h, {hexed("md5(concat_ws(':', '" + SEED + "', s, v))")} % {POINTS} AS point FROM range({SHARDS}) a(s), range({NODES}) b(v)) GROUP BY point)",
        f"room0 AS (SELECT s, (SELECT count(*) FROM w0) // {SHARDS} + CASE WHEN s < (SELECT count(*) FROM w0) % {SHARDS} THEN 1 ELSE 0 END AS room FROM range({SHARDS}) a(s))",
    ]
    for k in range(SHARDS):
        ctes += [
            f"o{k} AS MATERIALIZED (SELECT point, s FROM n0 SEMI JOIN (SELECT s FROM room{k} WHERE room > 0) USING (s))",
            f"c{k} AS (SELECT w.*, coalesce(o.s, (SELECT arg_min(s, point) FROM o{k})) AS s FROM {'b' if k == 0 else f'w{k}'} w ASOF LEFT JOIN o{k} o ON w.point <= o.point)",
            f"r{k} AS MATERIALIZED (SELECT c{k}.*, room, row_number() OVER (PARTITION BY s ORDER BY bucket, place, rn) <= room AS taken FROM c{k} JOIN room{k} USING (s))",
            f"w{k + 1} AS (SELECT doc_id, size, crc, rn, point, place, bucket FROM r{k} WHERE NOT taken)",
            f"room{k + 1} AS (SELECT s, room - coalesce(m, 0) AS room FROM room{k} LEFT JOIN (SELECT s, count(*) AS m FROM r{k} WHERE taken GROUP BY s) USING (s))",
        ]
    every = " UNION ALL ".join(f"SELECT doc_id, size, crc, rn, place, bucket, s FROM r{k} WHERE taken" for k in range(SHARDS))
    return f"""WITH {", ".join(ctes)}, placed AS ({every})
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(s AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY s ORDER BY bucket, place, rn) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed"""


OP12_SQL = _sql()
