"""Prefix trie of conversations, as succinct level-order tries.

Turns become label hashes of 128 bits, and a conversation's prefixes running sums of
hashes of label and place (two sums of 61 bits), taken in two levels over range
partitions, so that neither a long conversation nor a common prefix is one task. Nodes
with more than HEAVY turn rows below them are the upper levels. The rest falls into
shards, one for each light node under a heavy one: numpy builds the LOUDS bits and
label arrays of some shards at a time, finds parents by rank and select, and rolls up
in reverse level order with add.at. The heavy levels are merged by partial aggregation.

Sums over a heavy node's subtree need no walk: every heavy node and every shard is
owned by its smallest member. Members other than the smallest own nothing outside
the subtree, so its sum is what all its members own, without what the smallest owns
above it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_broadcast, partitions, saved, spread_join, table
from .crc_sql import CRC_TABLE, crc32

#: Fixed values of the contract: turns taken over are fewer than TURNS, from the first conversation of each GROUP.
TURNS, GROUP = 6, 100
#: Turn rows below a node from which it belongs to the upper levels; turn rows of the shards built at once.
HEAVY, AT_ONCE = 500, 100_000
#: Bytes of a piece of a node's list of members; rows up to which a table is broadcast.
PIECE, ROWS = 1 << 20, 200_000
MASK = (1 << 61) - 1
EMPTY = hashlib.sha256(b"").hexdigest()
ID = ["n1", "n2"]


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], keep: list[str]) -> DataFrame:
    """The columns in keep (key first) and, modulo 2^61, sums of longs over the rows of
    the same key up to this one in the order given; key isn't null.

    Two levels: inside range partitions, then what the key that a partition begins
    with has before it, for which one row a partition is enough.
    """
    spark, names = df.sparkSession, list(sums)
    keys = [F.col(key), *order]
    by = df.withColumns({f"_{n}": v.cast("long").bitwiseAND(F.lit(MASK)) for n, v in sums.items()})
    ranged = by.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).select(*keep, *[f"_{n}" for n in names])
    fields = [T.StructField(f.name, f.dataType, True) for f in df.select(*keep).schema] + [T.StructField(n, T.LongType()) for n in [*names, "_row"]]
    schema = T.StructType([*fields, T.StructField("_pid", T.IntegerType())])

    def local(batches):
        from pyspark import TaskContext

        pid, last, row, seen = TaskContext.get().partitionId(), None, 0, [np.int64(0)] * len(names)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k = b.column(0).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.r_[last is None or k[0] != last, k[1:] != k[:-1]])
            group = np.searchsorted(begins, np.arange(n), "right")  # 0: goes on from the last batch
            out = []
            for j in range(len(names)):
                v = b.column(len(keep) + j).to_numpy(zero_copy_only=False)
                total = np.cumsum(v)  # wraps, and 2^61 divides 2^64
                total = (total - np.r_[-seen[j], total[begins] - v[begins]][group]) & MASK
                seen[j] = total[-1]
                out.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *out, pa.array(np.arange(row, row + n)), pa.array(np.full(n, pid, np.int32))], names=schema.names)
            last, row = k[-1], row + n

    level = saved(ranged.mapInArrow(local, schema), "running")
    ends = level.groupBy("_pid").agg(F.min_by(key, "_row").alias("first"), F.max_by(F.struct(key, *names), "_row").alias("last"))
    carry, before, carries = [0] * len(names), None, []
    for r in sorted(ends.collect(), key=lambda r: r._pid):  # a row for each partition
        carry = carry if before == r["first"] else [0] * len(names)
        carries.append((r._pid, r["first"], *carry))
        one = r["first"] == r["last"][0]
        carry, before = [(x + (c if one else 0)) & MASK for x, c in zip(r["last"][1:], carry, strict=True)], r["last"][0]
    found = spark.createDataFrame(carries, T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_first", T.LongType()), *[T.StructField(f"_c_{n}", T.LongType()) for n in names]]))
    level = level.join(F.broadcast(found), "_pid", "left")  # a row for each partition
    more = {n: F.when(F.col(key) == F.col("_first"), (F.col(n) + F.col(f"_c_{n}")).bitwiseAND(F.lit(MASK))).otherwise(F.col(n)) for n in names}
    return level.withColumns(more).select(*keep, *names)


def turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, l1, l2, chars, pos): the turns' labels and code points, pos from 1."""
    text_, role_ = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (text, role))
    t = rows.select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), role_.alias("role"), text_.alias("text")).where("conv_id is not null")
    order = [F.col("turn").asc_nulls_first()]
    if t.groupBy("conv_id", "turn").count().where("count > 1").take(1):
        order += [F.col("role"), F.col("text")]
    labels = {f"l{k}": F.xxhash64(F.lit(k), "role", "text") for k in (1, 2)}
    labelled = t.withColumns(labels | {"chars": F.char_length("text").cast("long")})
    if len(order) == 1:
        labelled = labelled.drop("role", "text")  # texts aren't shuffled
    return running(labelled, "conv_id", order, {"pos": F.lit(1)}, ["conv_id", "l1", "l2", "chars"])


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, d, l1, l2, chars, len): turns of the rebuilt conversations, d from 1,
    and a row of depth 0 for each."""
    head = own.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < TURNS)).groupBy(F.col("conv_id").alias("base"))
    heads = head.agg(F.sort_array(F.collect_list(F.struct("pos", "l1", "l2", "chars"))).alias("head"))  # TURNS - 1 at most
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("_m")).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    convs = convs.join(heads, "base", "left").withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS)
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<pos: bigint, l1: bigint, l2: bigint, chars: bigint>>)")), F.lit(1), F.col("h").cast("int")))
    convs = saved(convs.withColumn("hb", F.size("head")).withColumn("len", F.col("hb") + F.greatest(F.lit(0), F.col("_m") - F.col("h"))), "conversations")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("d"), zero.alias("l1"), zero.alias("l2"), zero.alias("chars"), "len")
    taken = convs.select("conv_id", "len", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("d"), "t.l1", "t.l2", "t.chars", "len")
    kept = spread_join(own, convs.select("conv_id", "h", "hb", "len"), "conv_id", counts=convs.select("conv_id", "_m")).where("pos > h")
    return roots.unionByName(taken).unionByName(kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("hb")).alias("d"), "l1", "l2", "chars", "len"))


def _mixed(k: int) -> Column:
    """The hash of a label and its place; the root has none."""
    return F.when(F.col("d") == 0, 0).otherwise(F.xxhash64(F.lit(k), "l1", "l2", "d").bitwiseAND(F.lit(MASK)))


def prefixes(rows: DataFrame) -> DataFrame:
    """rows with the ids of the node that a turn leads to (n1, n2) and of its parent (u1, u2)."""
    out = running(rows, "conv_id", [F.col("d")], {"n1": _mixed(1), "n2": _mixed(2)}, ["conv_id", "d", "l1", "l2", "chars", "len"])
    return out.withColumns({f"u{k}": (F.col(f"n{k}") - _mixed(k)).bitwiseAND(F.lit(MASK)) for k in (1, 2)})


class Louds:
    """A level-order trie of the conversations of some shards below one top node.

    bits: for the top and then every node in level order a 1 for each child, and a 0.
    The i-th 1 is node i (the top is 0), so its parent is the number of 0s before it.
    """

    def __init__(self, shard: np.ndarray, begin: np.ndarray, l1: np.ndarray, l2: np.ndarray, chars: np.ndarray):
        lengths = np.diff(begin)
        self.end = np.zeros(len(shard), np.int64)  # the node at which each conversation ends
        at, live, level, counts = shard.astype(np.int64), np.flatnonzero(lengths > 0), 0, [np.array([len(np.unique(shard))])]
        labels, self.levels, total, width = [], [1], 1, 1
        while len(live):
            here = begin[live] + level
            order = np.lexsort((l2[here], l1[here], at[live]))
            live, here = live[order], here[order]
            new = np.r_[True, (at[live][1:] != at[live][:-1]) | (l1[here][1:] != l1[here][:-1]) | (l2[here][1:] != l2[here][:-1])]
            first = np.flatnonzero(new)
            if level:
                counts.append(np.bincount(at[live][first] - (total - width), minlength=width))
            width = len(first)
            node = total + np.cumsum(new) - 1
            labels.append(np.stack([l1[here[first]], l2[here[first]], chars[here[first]]]))
            total += width
            self.levels.append(total)
            at[live] = node
            level += 1
            done = lengths[live] == level
            self.end[live[done]] = node[done]
            live = live[~done]
        counts.append(np.zeros(width if level else 0, np.int64))
        self.l1, self.l2, self.chars = np.concatenate([np.zeros((3, 1), np.int64), *labels], axis=1)
        counts = np.concatenate(counts)
        self.bits = np.ones(int(counts.sum()) + len(counts), bool)
        self.bits[np.cumsum(counts + 1) - 1] = False

    @property
    def parents(self) -> np.ndarray:
        ones = np.flatnonzero(self.bits)  # select
        return np.r_[-1, ones - np.arange(len(ones))]  # rank of 0

    @property
    def children(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def rolled(self, values: np.ndarray, how=np.add) -> np.ndarray:
        """values of nodes, with those of all nodes below: from the last level up."""
        out, parents = values.copy(), self.parents
        for k in range(len(self.levels) - 1, 1, -1):
            nodes = slice(self.levels[k - 1], self.levels[k])
            how.at(out, parents[nodes], out[nodes])
        return out


LIGHT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, n1 long, n2 long"


def _nodes(shard, conv, depth, up1, up2, begin, l1, l2, chars) -> pa.RecordBatch:
    """The nodes of some shards; only their tops have the ids of their (heavy) parents."""
    t = Louds(shard, begin, l1, l2, chars)
    n = len(t.chars)
    members, least, where = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    np.add.at(members, t.end, 1)
    np.minimum.at(least, t.end, conv)
    members, least = t.rolled(members), t.rolled(least, np.minimum)
    for k in range(1, len(t.levels)):
        where[t.levels[k - 1] : t.levels[k]] = k - 1
    tops = np.flatnonzero(t.parents == 0)  # in the order of the shards
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    start = np.zeros(n, np.int64)
    start[tops] = depth[first]
    for k in range(2, len(t.levels)):
        nodes = slice(t.levels[k - 1], t.levels[k])
        start[nodes] = start[t.parents[nodes]]
    leaves = t.rolled((t.children == 0).astype(np.int64))
    spared = t.rolled(np.where(np.arange(n) > 0, (members - 1) * t.chars, 0))
    ends, order = [EMPTY] * n, np.lexsort((conv, t.end))
    cuts = np.flatnonzero(np.r_[True, t.end[order][1:] != t.end[order][:-1], True])
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        ends[t.end[order[x]]] = hashlib.sha256(",".join(map(str, conv[order[x:y]].tolist())).encode()).hexdigest()
    top = t.parents[1:] == 0
    up = np.zeros((2, n), np.int64)
    up[0, tops], up[1, tops] = up1[first], up2[first]
    longs = [least[1:], (start + where)[1:], pa.array(least[t.parents[1:]], mask=top), members[1:], t.children[1:], leaves[1:], spared[1:]]
    ids = [pa.array(u[1:], mask=~top) for u in up]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c for c in longs], pa.array(ends[1:]), *ids], names=[c.split()[0] for c in LIGHT.split(", ")])


def _shards(batches):
    """Shards come one after the other; some are built together, none is cut."""
    held, size = [], 0

    def built(rows: pa.Table):
        rows = rows.combine_chunks()
        c = {name: rows[name].combine_chunks() for name in rows.column_names}
        n1, n2, up1, up2, conv, depth = (c[x].to_numpy(zero_copy_only=False) for x in ("n1", "n2", "u1", "u2", "conv_id", "depth"))
        shard = np.cumsum(np.r_[0, (n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])])
        begin = np.r_[0, np.cumsum(np.diff(c["labels"].offsets.to_numpy()))]
        l1, l2, chars = (c["labels"].flatten().field(x).to_numpy(zero_copy_only=False) for x in ("l1", "l2", "chars"))
        return _nodes(shard, conv, depth, up1, up2, begin, l1, l2, chars)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += len(b.column("labels").flatten())
        if size < AT_ONCE:
            continue
        rows = pa.Table.from_batches(held)
        n1, n2 = (rows[x].to_numpy() for x in ID)
        last = np.flatnonzero((n1 != n1[-1]) | (n2 != n2[-1]))  # the last shard may go on
        if len(last):
            yield built(rows[: last[-1] + 1])
            held = rows[last[-1] + 1 :].to_batches()
            size = sum(len(x.column("labels").flatten()) for x in held)
    if held:
        yield built(pa.Table.from_batches(held))


def light_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of the shards, from the turns below the heavy levels: a conversation has
    at most HEAVY of them, and so has a shard."""
    labels = F.transform(F.sort_array(F.collect_list(F.struct("d", "l1", "l2", "chars"))), lambda x: F.struct(x["l1"].alias("l1"), x["l2"].alias("l2"), x["chars"].alias("chars")))
    tops = [F.min_by(c, "d").alias(c) for c in ("n1", "n2", "u1", "u2")]
    per = rows.groupBy("conv_id").agg(*tops, F.min("d").alias("depth"), labels.alias("labels"))
    ordered = per.repartition(partitions(rows.sparkSession), *ID).sortWithinPartitions(*ID, "conv_id")
    return ordered.select("n1", "n2", "u1", "u2", "conv_id", "depth", "labels").mapInArrow(_shards, LIGHT)


def _pieces(batches):
    """Ids of one node after another, as texts of about PIECE bytes."""
    node, first, text, size = None, None, [], 0

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*node, first)] + [pa.array([",".join(text)])], names=["n1", "n2", "first", "ids"])

    for b in batches:
        for n1, n2, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if node != (n1, n2) or size > PIECE:
                if text:
                    yield piece()
                node, first, text, size = (n1, n2), conv, [], 0
            text.append(str(conv))
            size += len(text[-1]) + 1
    if text:
        yield piece()


def _hashed(batches):
    """One digest of the pieces of each node, which come in order."""
    node, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()])], names=["n1", "n2", "ends_sha256"])

    for b in batches:
        for n1, n2, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if node != (n1, n2):
                if node:
                    yield row()
                node, digest = (n1, n2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if node:
        yield row()


def digests(members: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) of (n1, n2, conv_id): ids in order, comma between. A
    node's ids may be many: they are joined to pieces in range partitions, and only
    the digest, which has an order, runs over the pieces of a node in one task."""
    n = partitions(members.sparkSession)
    pieces = members.select(*ID, "conv_id").repartitionByRange(n, *ID, "conv_id").sortWithinPartitions(*ID, "conv_id").mapInArrow(_pieces, "n1 long, n2 long, first long, ids string")
    ordered = pieces.repartition(n, *ID).sortWithinPartitions(*ID, "first").select(*ID, "ids")
    return ordered.mapInArrow(_hashed, "n1 long, n2 long, ends_sha256 string")


def heavy_nodes(heavy: DataFrame, rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes of the upper levels. heavy: their ids, parents and members; rows: the
    turns that lead to them; tops: the tops of the shards, with their parents' ids."""
    below = heavy.where("depth > 0").select(F.col("u1").alias("n1"), F.col("u2").alias("n2")).unionByName(tops.select(*ID))
    nodes = heavy.join(below.groupBy(*ID).agg(F.count("*").alias("n_children")), ID, "left").fillna(0, ["n_children"])
    nodes = saved(nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("spared", (F.col("n_convs") - 1) * F.col("chars")), "heavy")
    owned = nodes.select("conv_id", "leaf", "spared").unionByName(tops.select("conv_id", F.col("n_leaves").alias("leaf"), F.col("saved_tokens").alias("spared")))
    owned = owned.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("spared").alias("spared"))
    of_members = spread_join(rows.select(*ID, "conv_id"), owned, "conv_id").groupBy(*ID).agg(F.sum("leaf").alias("all_leaves"), F.sum("spared").alias("all_spared"))
    above = running(nodes, "conv_id", [F.col("depth")], {"leaves_to": F.col("leaf"), "spared_to": F.col("spared")}, ["conv_id", *ID])
    out = nodes.join(of_members, ID).join(above.drop("conv_id"), ID)
    out = out.join(digests(rows.where("d = len")), ID, "left").fillna(EMPTY, ["ends_sha256"])
    return out.select("conv_id", "depth", "n_convs", "n_children", (F.col("all_leaves") - F.col("leaves_to") + F.col("leaf")).alias("n_leaves"), (F.col("all_spared") - F.col("spared_to") + F.col("spared")).alias("saved_tokens"), "ends_sha256", F.col("u1").alias("n1"), F.col("u2").alias("n2"))


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), one row per distinct prefix of the rebuilt conversations.

    Turns are ordered by turn, null first; of equal turns by role, then text; rows
    that repeat are turns each. Null roles and texts are empty. Rows without a
    conversation id belong to no conversation. Conversations of any length and
    prefixes of any number of members are counted whole. Equal turns are told by
    hashes of 128 bits, prefixes by 122. Other columns are ignored; without
    conversations there are no nodes, not even the root.
    """
    found = saved(prefixes(rebuilt(turns(rows, conv, turn, role, text))), "prefixes")
    per = found.groupBy(*ID).agg(F.sum(F.col("len") - F.col("d") + 1).alias("below"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("d").alias("depth"), F.max("chars").alias("chars"), F.max("u1").alias("u1"), F.max("u2").alias("u2"))
    heavy = saved(per.where((F.col("below") > HEAVY) | (F.col("depth") == 0)).drop("below"), "upper")
    is_heavy = maybe_broadcast(heavy.select(*ID), ROWS)
    light = saved(light_nodes(found.join(is_heavy, ID, "left_anti")), "light")
    tops = light.where("n1 is not null")
    upper = heavy_nodes(heavy, found.join(is_heavy, ID, "left_semi"), tops)
    parents = maybe_broadcast(heavy.select(*ID, F.col("conv_id").alias("parent_conv_id")), ROWS)
    joined = upper.unionByName(tops.drop("parent_conv_id")).join(parents, ID, "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent_conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return light.where("n1 is null").select(*columns).unionByName(joined.select(*columns))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, {{'k': sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'n': length(coalesce(text, ''))}} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(x ORDER BY pos) AS xs FROM t GROUP BY conv_id),
h AS (SELECT conv_id, xs, {crc32("CAST(conv_id AS VARCHAR)")} % {TURNS} AS h FROM own, {CRC_TABLE}),
c AS (
  SELECT h.conv_id, coalesce(b.xs[1:h.h], []) || h.xs[h.h + 1:] AS xs
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % {GROUP}),
r AS (SELECT conv_id, xs, len(xs) AS n, unnest(range(len(xs) + 1)) AS depth FROM c),
p AS (SELECT conv_id, n, depth, sha256(CAST(xs[1:depth] AS VARCHAR)) AS node, CASE WHEN depth > 0 THEN sha256(CAST(xs[1:depth - 1] AS VARCHAR)) END AS up,
  CASE WHEN depth > 0 THEN xs[depth].n ELSE 0 END AS chars FROM r),
g AS (SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY node, depth),
k AS (SELECT up AS node, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY up),
v AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k USING (node)),
a AS (SELECT anc.node, sum((v.n_children = 0)::INT) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens
  FROM v JOIN p low ON low.node = v.node AND low.conv_id = v.conv_id JOIN p anc ON anc.conv_id = v.conv_id AND anc.depth <= v.depth GROUP BY anc.node)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN a USING (node) LEFT JOIN v u ON u.node = v.up
"""
