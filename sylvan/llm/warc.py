"""WARC archives of captures, with a merged index in URL-key order.

Writing. A payload of at least ``REVISIT_BYTES`` that occurs more than once is stored once, with the
smallest page_id, as a response record; the others become revisit records that name it. Which digests
repeat, and their smallest page_id, is a pre-aggregated count over (digest, page_id, length), without
payloads; pages then meet only that table, in a join that may be split for a digest with very many pages.
An archive is a series of gzip members, one a record; with it goes its index run, the archive's captures
sorted by (URL key, timestamp, page_id). Archive and run are one row of a Parquet table, so that any store
Spark writes to can hold them and lost tasks leave nothing behind.

Index merge. The key space is cut in two levels: coarse ranges by quantiles of a sample of about ``SPLIT_SAMPLE``
captures by a hash, and each of them into ranges of about ``RANGE_CAPTURES`` by quantiles of a denser sample
that a task for each coarse range takes, so neither the driver nor a task holds more as the index grows;
``DEEPEST`` coarse levels follow each other where one isn't enough. Runs are cut at these splitters (which
affect only how even the ranges are), and each range's segments, already sorted, are merged by a loser tree.
Ranges in order give the whole capture history in order, and a capture's position in it. A key with very many
captures is split too, since splitters hold timestamp and page_id.

Defined results. Null html: empty payload. Null url: an empty target. Null page_id: always a response, and
first in its key's order. Very long payloads: whole, a record each, in an archive of their own size. Repeated
rows: of several rows with the smallest page_id one is the response, the others revisit it; captures that tie in
URL key, time and page_id follow archive and offset. Empty table: no archives. Further columns, whatever their
names, aren't read; a ``captured`` timestamp column is used where there is one, else the time is ``EPOCH`` plus
page_id seconds.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from sylvan.llm.arrow import in_arrow
from sylvan.operators.prefix import running
from sylvan.session import cut, table_path

REVISIT_BYTES = 100
#: Compressed bytes after which an archive is closed.
ARCHIVE_BYTES = 4_000_000
SPLIT_SAMPLE, RANGE_CAPTURES = 4096, 50_000
#: Ranges that the first level makes at most, and levels after it.
COARSE, DEEPEST = 512, 4
EPOCH = datetime(2020, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "struct<url_key:string,captured:string,page_id:bigint,archive:string,offset:bigint,length:bigint>"
_ENTRY = pa.struct([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_FIELDS = [f.name for f in _ENTRY]


def url_key(url: str) -> str:
    """The sort key of a URL: host labels reversed, without scheme and leading www, then path and query."""
    try:
        u = urlsplit(url if "//" in url else f"//{url}")
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.lower()
    host = host.removeprefix("www.")
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + tail.lower()


def record(page_id: int | None, url: str, when: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit's block is the HTTP header alone, which keeps the payload's length."""
    digest = hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    name = f"urn:page:{'none' if page_id is None else page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {when}"]
    head += [f"WARC-Target-URI: {re.sub(r'[\r\n]', lambda m: '%%%02X' % ord(m[0]), url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's page_id, payload_bytes, payload_digest, record_type and refers_to; a response's payload is digested anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda x: None if x == "<urn:page:none>" else int(x[10:-1])
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(refers) if refers else None}


def decided(pages: DataFrame) -> DataFrame:
    """(page_id, url, captured, html, refers_to, revisit) of every page."""
    stamp = pages["captured"].cast("timestamp") if "captured" in pages.columns else F.lit(None).cast("timestamp")
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), stamp.alias("captured"), F.coalesce("html", F.lit("")).alias("html"), F.sha2(body, 256).alias("digest"), F.length(body).cast("long").alias("n"))
    large = base.where((F.col("n") >= REVISIT_BYTES) & F.col("page_id").isNotNull()).select("digest", "page_id")
    same = large.groupBy("digest", "page_id").agg(F.count("*").alias("rows")).groupBy("digest")
    same = same.agg(F.min(F.struct("page_id", "rows")).alias("first"), F.sum("rows").alias("all")).where(F.col("all") > 1)
    same = cut(same.select(F.col("digest").alias("of"), F.col("first.page_id").alias("first"), F.col("first.rows").alias("ties")))
    rows = base.join(same, (F.col("digest") == F.col("of")) & (F.col("n") >= REVISIT_BYTES) & F.col("page_id").isNotNull(), "left")
    names = ["page_id", "url", "captured", "html", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit"]
    later = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    if same.where("ties > 1").isEmpty():
        return rows.withColumn("revisit", later).select(*names)
    tied = F.coalesce((F.col("page_id") == F.col("first")) & (F.col("ties") > 1), F.lit(False))
    again = rows.where(tied).withColumn("revisit", F.row_number().over(W.partitionBy("digest").orderBy("url", "captured")) > 1)
    return rows.where(~tied).withColumn("revisit", later).select(*names).union(again.select(*names))


def archives(pages: DataFrame, prefix: str = "captures") -> DataFrame:
    """(archive, data, run): archives of all pages, each with its sorted index run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        data, entries = bytearray(), []

        def close() -> pa.RecordBatch:
            nonlocal data, entries, number
            name = f"{prefix}-{part:06d}-{number:06d}.warc.gz"
            ordered = sorted(entries, key=lambda e: (e[0], e[1], -1 if e[2] is None else e[2], e[3]))
            rows = [dict(zip(_FIELDS, (k, w, p, name, o, n))) for k, w, p, o, n in ordered]
            out = pa.RecordBatch.from_pydict({"archive": pa.array([name]), "data": pa.array([bytes(data)], pa.binary()), "run": pa.array([rows], pa.list_(_ENTRY))})
            data, entries, number = bytearray(), [], number + 1
            return out

        for batch in batches:
            for page_id, url, stamp, html, refers_to, revisit in zip(*(batch.column(c).to_pylist() for c in range(6))):
                when = (stamp if stamp is not None else EPOCH + timedelta(seconds=(page_id or 0) % 10**10)).strftime("%Y-%m-%dT%H:%M:%SZ")
                packed = gzip.compress(record(page_id, url, when, html.encode(), refers_to, revisit), 3, mtime=0)
                entries.append((url_key(url), when, page_id, len(data), len(packed)))
                data += packed
                if len(data) >= ARCHIVE_BYTES:
                    yield close()
        if entries:
            yield close()

    return in_arrow(decided(pages), run, f"archive string, data binary, run array<{ENTRY}>")


def write_archives(pages: DataFrame, path: str) -> None:
    archives(pages).write.option("compression", "none").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives, parsed: archive, offset, and what ``parse`` gives."""
    kinds = [("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data, places in zip(*(batch.column(c).to_pylist() for c in range(3))):
                rows = [(name, o, *parse(gzip.decompress(data[o : o + n])).values()) for o, n in sorted((p["offset"], p["length"]) for p in places)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[n for n, _ in kinds])

    table = spark.read.schema(f"archive string, data binary, run array<{ENTRY}>").parquet(path)
    places = F.transform("run", lambda e: F.struct(e["offset"].alias("offset"), e["length"].alias("length")))
    return in_arrow(table.select("archive", "data", places.alias("places")), run, "archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so each next item costs one path of matches."""

    def __init__(self, runs: Sequence[Sequence], key) -> None:
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.width = max(1, len(runs))
        self.losers = [-1] * self.width
        for r in range(len(runs)):
            self._play(r)

    def _head(self, r: int):
        return self.key(self.runs[r][self.at[r]]) if self.at[r] < len(self.runs[r]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None and (x is not None or a < b) or x is not None and (x, a) < (y, b)

    def _play(self, r: int) -> None:
        """Send run r from its leaf up; each match's loser stays, a free place takes the run that comes."""
        node = (r + self.width) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = r
                return
            if self._beats(self.losers[node], r):
                self.losers[node], r = r, self.losers[node]
            node //= 2
        self.losers[0] = r

    def __iter__(self) -> Iterator:
        if not self.runs:
            return
        while self._head(w := self.losers[0]) is not None:
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.losers[0] = -1
            self._play(w)


def _key(e: tuple) -> tuple:
    return (e[0], e[1], -1 if e[2] is None else e[2], e[3], e[4])


def _segments(splitters: Sequence[tuple], rows: list[dict]) -> Iterator[tuple[int, list[dict]]]:
    """A sorted segment cut at the splitters: (number of the range, what falls into it)."""
    order = [_key(tuple(e[f] for f in _FIELDS)) for e in rows]
    cuts = [0, *(bisect_left(order, s) for s in splitters), len(rows)]
    return ((i, rows[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a)


def _quantiles(keys: list[tuple], parts: int) -> list[tuple]:
    keys = sorted(keys)
    parts = max(1, min(parts, len(keys)))
    return [keys[len(keys) * i // parts] for i in range(1, parts)]


def _split(segments: DataFrame, deep: int) -> DataFrame:
    """(range, segment) with every range cut into as many as its captures ask for, at most ``SPLIT_SAMPLE // 8`` of them.

    A range is its numbers on all levels, in order. Each range's splitters come from its own sample, by one task.
    """
    sizes = segments.groupBy("range").agg(F.sum(F.size("segment")).alias("n")).withColumn("parts", F.least(F.floor(F.col("n") / RANGE_CAPTURES) + 1, F.lit(SPLIT_SAMPLE // 8)).cast("int"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / SPLIT_SAMPLE)).cast("long")
    entries = segments.join(sizes, "range").select("range", "parts", step.alias("step"), F.explode("segment").alias("e"))
    sample = entries.where((F.col("parts") > 1) & (F.pmod(F.xxhash64(F.col("e.archive"), F.col("e.offset"), F.lit(deep)), F.col("step")) == 0))

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        rows = [tuple(e[f] for f in _FIELDS) for e in table.column("e").to_pylist()]
        found = _quantiles([_key(r) for r in rows], table.column("parts")[0].as_py())
        entry = [dict(zip(_FIELDS, (k, w, None if p < 0 else p, a, o, 0))) for k, w, p, a, o in found]
        return pa.table({"range": pa.array([key[0].as_py()], pa.list_(pa.int32())), "splitters": pa.array([entry], pa.list_(_ENTRY))})

    chosen = sample.select("range", "parts", "e").groupBy("range").applyInArrow(choose, f"range array<int>, splitters array<{ENTRY}>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, found in zip(*(batch.column(c).to_pylist() for c in range(3))):
                parts = list(_segments([_key(tuple(e[f] for f in _FIELDS)) for e in found or []], rows))
                yield pa.RecordBatch.from_pydict({"range": pa.array([[*at, i] for i, _ in parts], pa.list_(pa.int32())), "segment": pa.array([x for _, x in parts], pa.list_(_ENTRY))})

    return in_arrow(segments.join(chosen, "range", "left").select("range", "segment", "splitters"), run, f"range array<int>, segment array<{ENTRY}>")


def history(spark: SparkSession, path: str) -> DataFrame:
    """The merged index: (position, url_key, captured, page_id, archive, offset, length), position from 0 in global order."""
    runs = spark.read.schema(f"archive string, data binary, run array<{ENTRY}>").parquet(path).select("run")
    n = runs.agg(F.sum(F.size("run"))).first()[0] or 0
    sample = runs.select(F.explode("run").alias("e")).select("e.*").where(F.pmod(F.xxhash64("archive", "offset"), F.lit(max(1, n // SPLIT_SAMPLE))) == 0)
    keys = [_key(tuple(r[f] for f in _FIELDS)) for r in sample.collect()] if n > RANGE_CAPTURES else []  # about SPLIT_SAMPLE rows
    splitters = _quantiles(keys, min(n // RANGE_CAPTURES + 1, COARSE))

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column(0).to_pylist():
                parts = list(_segments(splitters, rows))
                yield pa.RecordBatch.from_pydict({"range": pa.array([[i] for i, _ in parts], pa.list_(pa.int32())), "segment": pa.array([x for _, x in parts], pa.list_(_ENTRY))})

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = [[tuple(e[f] for f in _FIELDS) for e in s] for s in table.column("segment").to_pylist()]
        merged = list(LoserTree(parts, _key))
        columns = {f: pa.array(c, _ENTRY.field(f).type) for f, c in zip(_FIELDS, zip(*merged))}
        return pa.table({"range": pa.array([key[0].as_py()] * len(merged), pa.list_(pa.int32())), "number": pa.array(range(len(merged)), pa.int64())} | columns)

    cutted = in_arrow(runs, coarse, f"range array<int>, segment array<{ENTRY}>")
    levels, room = 0, COARSE * RANGE_CAPTURES
    while n > room // 8 and levels < DEEPEST:
        cutted = _split(cut(cutted), levels)
        levels, room = levels + 1, room * SPLIT_SAMPLE // 8
    cutted = cut(cutted)
    places = running(cutted.groupBy("range").agg(F.sum(F.size("segment")).cast("long").alias("n")), ["range"], {"before": "n"}).select("range", "before")
    merged = cutted.groupBy("range").applyInArrow(merge, "range array<int>, number long, url_key string, captured string, page_id long, archive string, offset long, length long")
    return merged.join(places, "range").select((F.col("before") + F.col("number")).alias("position"), *_FIELDS)


def through_archives(pages: DataFrame) -> DataFrame:
    """Write all pages' archives to the shared folder, merge their index, and read the records it lists, with url_key, captured and position."""
    spark = pages.sparkSession
    path = table_path(spark, "archives")
    write_archives(pages, path)
    listed = history(spark, path).select("archive", "offset", "url_key", "captured", "position")
    return read_records(spark, path).join(listed, ["archive", "offset"]).drop("archive", "offset")
