"""WARC archives and their capture index.

Records are gzip members of their own, written by Spark's text writer as raw
bytes (its "line separator" is an empty gzip member, which readers pass over), so
the files may lie on any file system that Spark writes, with Spark's commits.
Equal payloads are stored once: the record with the largest page_id is a
response, the others are revisits that refer to it.

Reading back, archives are streamed record by record (Spark's text reader splits
them at the empty members), so that neither a file nor a split is held at once.
Captures are sorted to runs of a bounded length; the runs are cut at common key
bounds and each stretch is merged k-way by a loser tree on (URL key, time,
page_id), which gives globally ordered capture histories.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, partitions, saved, scratch_path, spread_join, table

#: Fixed value: a gzip member of nothing.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: Records of an archive file at most, captures of a run, and of a merge task (about).
RECORDS, RUN, MERGE = 50_000, 5_000, 200_000
#: Captures without a time are dated from here, one second for each id.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_LINE = "\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def when(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % (366 * 86_400))).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str | None) -> str:
    """SURT form: host labels reversed, no scheme, www., port or fragment; query sorted."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){(parts.path or '/').lower()}{'?' + query if query else ''}"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str | None = None) -> bytes:
    """One gzip member holding a WARC/1.1 response or revisit record."""
    date = date or when(page_id)
    http = _LINE.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]).encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = re.sub(r"[\r\n]", "", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        "",
        "",
    ]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(_LINE.join(head).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + z.flush()


def members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a file that aren't empty."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        if raw.startswith(EMPTY, at):
            at += len(EMPTY)
            continue
        z, out, n = zlib.decompressobj(31), [], at
        while not z.eof:
            if n >= len(raw):
                raise ValueError(f"the member at {at} is cut off")
            out.append(z.decompress(view[n : n + (1 << 16)]))
            n += 1 << 16
        end = min(n, len(raw)) - len(z.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def parse(content: bytes) -> dict:
    """The index entry of a record; raises if a response's payload hasn't its digest."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8", "surrogatepass").split(_LINE)[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    url = fields["WARC-Target-URI"]
    return {"url_key": url_key(url), "captured_at": fields["WARC-Date"], "page_id": number(fields["WARC-Record-ID"]), "url": url, "record_type": fields["WARC-Type"], "payload_digest": digest, "payload_bytes": size, "refers_to": number(fields.get("WARC-Refers-To"))}


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record for each row of pages to path.

    A null html is an empty payload; a null url an empty one. Rows of equal
    payloads and of the largest id are responses, the others revisits; rows that
    repeat the largest id are responses each, and rows without an id always are.
    Other columns are ignored; an empty table gives no records.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    digests = saved(rows.select("page_id", "digest"), "digests")
    copies = saved(digests.groupBy("digest").agg(F.count("*").alias("_m"), F.max("page_id").alias("refers_to")).where("_m > 1"), "copies")
    # One payload, such as the empty page, may be that of a third of all rows.
    pairs = spread_join(digests, copies.select("digest", "refers_to"), "digest", counts=copies.select("digest", "_m"))
    revisits = pairs.where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    revisits = maybe_broadcast(saved(revisits, "revisits"), 1_000_000)  # at most 60 MB

    def pack(batches):
        for b in batches:
            page_id, urls, html_, refers = (b.column(k) for k in range(4))
            out = [record(p.as_py(), u.as_py(), h.as_buffer().to_pybytes() if h.is_valid else b"", r.as_py()) for p, u, h, r in zip(page_id, urls, html_, refers, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    joined = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    raw = joined.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    raw.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", RECORDS).text(path)


class LoserTree:
    """K-way merge: inner nodes keep the losers, so a new head replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        return next(self.runs[i], None)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, i: int) -> None:
        at, winner = (i + self.k) // 2, i
        while at:
            if self.losers[at] == -1:  # waits for its other side
                self.losers[at] = winner
                return
            if self._beats(self.losers[at], winner):
                self.losers[at], winner = winner, self.losers[at]
            at //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.heads[w := self.losers[0]] is not None:
            yield self.heads[w], w
            self.heads[w] = self._next(w)
            self._play(w)


_INDEX = "url_key string, captured_at string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, offset long, length long"
_RUNS = _INDEX + ", start long, end long, run string, seq long"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under path in the order of (url_key,
    captured_at, page_id), partition by partition. Members without an empty one
    between them are read as well, but then a file is one split."""
    columns = [x.split()[0] for x in _RUNS.split(", ")]
    whole = ("page_id", "refers_to")  # may be null: no detour over floats

    def runs(batches):
        """Entries with their place in the file's split, RUN of them sorted at a time."""
        split, end, found, n = None, 0, [], 0

        def run():
            found.sort(key=_order)
            out = pd.DataFrame({c: pd.array([r[c] for r in found], dtype="Int64") if c in whole else [r[c] for r in found] for c in found[0]})
            out["run"], out["seq"] = f"{split[0]}:{split[1]}:{n}", range(len(out))
            return out[columns]

        for pdf in batches:
            for name, start, raw in zip(pdf["file"], pdf["start"], pdf["value"], strict=True):
                if split != (name, start):
                    if found:
                        yield run()
                    split, end, found, n = (name, start), 0, [], 0
                at, end = end, end + len(raw) + len(EMPTY)
                found += [parse(c) | {"file": name, "start": start, "offset": at + k, "length": size, "end": end} for k, size, c in members(raw)]
                if len(found) >= RUN:
                    yield run()
                    found, n = [], n + 1
        if found:
            yield run()

    lines = spark.read.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    raw = lines.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    found = saved(raw.mapInPandas(runs, _RUNS), "runs")
    # A record's offset in the file: in its split, and the splits before.
    before = F.coalesce(F.sum("_end").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = found.groupBy("file", "start").agg(F.max("end").alias("_end")).select("file", "start", before.alias("_before"))
    placed = found.join(maybe_broadcast(splits, 100_000), ["file", "start"]).withColumn("offset", F.col("offset") + F.col("_before"))
    placed = placed.select(*[x.split()[0] for x in _INDEX.split(", ")], "run", "seq")
    keys = [F.col(c).asc_nulls_first() for c in ("url_key", "captured_at", "page_id", "file", "offset")]
    tasks = max(partitions(spark), found.count() // MERGE + 1)
    cut = placed.repartitionByRange(tasks, *keys).sortWithinPartitions("run", "seq")

    def merge(batches):
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held)
        heads = list(zip(t["url_key"].to_pylist(), t["captured_at"].to_pylist(), [-1 if x is None else x for x in t["page_id"].to_pylist()], range(t.num_rows), strict=True))
        stretches: dict[str, list] = {}
        for run, head in zip(t["run"].to_pylist(), heads, strict=True):
            stretches.setdefault(run, []).append(head)
        order = [head[3] for head, _ in LoserTree([iter(x) for x in stretches.values()])]
        yield from t.drop_columns(["run", "seq"]).take(order).combine_chunks().to_batches()

    return cut.mapInArrow(merge, _INDEX)


def _order(entry: dict) -> tuple:
    return entry["url_key"], entry["captured_at"], -1 if entry["page_id"] is None else entry["page_id"]


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p),
v AS (SELECT *, list_transform(range(8), lambda i: CAST(('0x' || substr(d, CAST(1 + 5 * i AS INTEGER), 5)) AS BIGINT)) AS q FROM m)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(q, lambda x:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 15) & 31 AS INTEGER) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 10) & 31 AS INTEGER) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> 5) & 31 AS INTEGER) + 1, 1) ||
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM v
"""
