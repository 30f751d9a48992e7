"""Ordered folds of event logs: state machines over the events of each entity.

An event maps every state to a state, and maps compose, so a stretch of a log is one
map. Events are range-partitioned by (entity, order). A first pass gives, for each
partition, the map of its first entity's stretch (which may have begun earlier) and
where its last entity ends; these few rows are composed in order, and a second pass
runs every partition from the state that it begins with. An entity with a third of
all events is spread over partitions like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import saved


@dataclass(frozen=True)
class Machine:
    """States, the one that entities begin with, and where events lead: rules from
    (state, event) to state. What has no rule is illegal and changes nothing."""

    states: tuple[str, ...]
    start: str
    rules: dict[tuple[str, str], str]

    def next(self, state: str, event: str | None) -> str | None:
        return self.rules.get((state, event))


def moves(states: list[str], start: str, allowed: dict[str, list[str]] | None = None) -> Machine:
    """A machine whose events are the states to go to; by default from any other."""
    return Machine(tuple(states), start, {(a, b): b for a in states for b in states if (b in allowed.get(a, []) if allowed is not None else a != b)})


# Runs are started, then finished once; gaps are logged, sent and resolved.
RUNS = Machine(("none", "running", "success", "error"), "none", {("none", "start"): "running", ("running", "success"): "success", ("running", "error"): "error"})
GAPS = Machine(("none", "pending", "sent", "resolved"), "none", {("none", "log"): "pending", ("pending", "sent"): "sent", ("pending", "resolved"): "resolved", ("sent", "resolved"): "resolved"})


def fold(events: DataFrame, machine: Machine, entity: str, order: list[str], event: str, note: str | None = None, partitions: int | None = None) -> DataFrame:
    """The events with from_state, to_state, legal, and `noted`: the last non-null value
    of the column `note` (a double) up to the event, as a snapshot.

    Order must be total in an entity; nulls come first. Events that are null or have no
    rule from the current state are illegal: to_state is from_state. Entities that are
    null are one entity. No events, no rows. Columns of events with these names are
    replaced.
    """
    spark, keys = events.sparkSession, [F.col(entity), *[F.col(c) for c in order]]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = events.drop("from_state", "to_state", "legal", "noted")
    rows = events.withColumns({"_e": F.col(event).cast("string"), "_v": (F.col(note) if note else F.lit(None)).cast("double"), "_k": F.to_json(F.struct(F.col(entity).alias("k")), {"ignoreNullFields": "false"})})
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id())
    dealt = saved(ranged, "events")  # both passes see the same partitions
    sorted_ = dealt.repartition(n, "_pid").sortWithinPartitions("_pid", *keys)
    states = machine.states

    def summary(batches):
        """A row for each stretch of a partition that matters to the next one."""
        pid = first = last = None
        at, seen, whole = {}, None, True

        def row():
            return pa.RecordBatch.from_pylist([{"pid": pid, "first": first, "last": last, "whole": whole, "at": [at[s] for s in states], "seen": seen}], schema=SUMMARY)

        for b in batches:
            for p, k, e, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != pid:
                    if pid is not None:
                        yield row()
                    pid, first, last, whole, at, seen = p, k, k, True, {s: s for s in states}, None
                elif k != last:
                    last, whole, at, seen = k, False, dict.fromkeys(states, machine.start), None
                at = {s: machine.next(t, e) or t for s, t in at.items()} if whole else dict.fromkeys(states, machine.next(at[states[0]], e) or at[states[0]])
                seen = v if v is not None else seen
        if pid is not None:
            yield row()

    found = sorted_.select("_pid", "_k", "_e", "_v").mapInArrow(summary, "pid int, first string, last string, whole boolean, at array<string>, seen double").collect()  # a row for each partition
    begin, before = {}, (None, None, None)
    for r in sorted(found, key=lambda r: r.pid):
        state, seen = before[1:] if before[0] == r["first"] else (machine.start, None)
        begin[r.pid] = (state, seen)
        after = r["at"][states.index(state)]
        carried = seen if r["seen"] is None and r["whole"] else r["seen"]
        before = (r["last"], after, carried)

    def run(batches):
        pid = key = state = seen = None
        for b in batches:
            out = {"from_state": [], "to_state": [], "legal": [], "noted": []}
            for p, k, e, v in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_pid", "_k", "_e", "_v")), strict=True):
                if p != pid:
                    pid, key, (state, seen) = p, k, begin[p]
                elif k != key:
                    key, state, seen = k, machine.start, None
                to = machine.next(state, e)
                seen = v if v is not None else seen
                for c, x in zip(out, (state, to or state, to is not None, seen), strict=True):
                    out[c].append(x)
                state = to or state
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out["from_state"], pa.string()), pa.array(out["to_state"], pa.string()), pa.array(out["legal"], pa.bool_()), pa.array(out["noted"], pa.float64())], names=[*names, *out])

    names = events.columns
    more = [T.StructField("from_state", T.StringType()), T.StructField("to_state", T.StringType()), T.StructField("legal", T.BooleanType()), T.StructField("noted", T.DoubleType())]
    return sorted_.mapInArrow(run, T.StructType([*events.schema.fields, *more]))


SUMMARY = pa.schema([("pid", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("whole", pa.bool_()), ("at", pa.list_(pa.string())), ("seen", pa.float64())])


def current(folded: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """(entity, state, moves, refused): where each entity is, and its legal and illegal events."""
    last = F.max_by("to_state", F.struct(*order))
    return folded.groupBy(entity).agg(last.alias("state"), F.count_if("legal").alias("moves"), F.count_if(~F.col("legal")).alias("refused"))
