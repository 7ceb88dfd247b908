"""WARC archives: writing with revisit records, and splittable reading with boundary-chain verification.

Archives are gzip members, one a record. A reading task takes a byte range, treats every gzip magic in it as a
candidate, and emits (offset, successor) for those that unpack to a WARC record. Magic inside payloads yields
candidates too; they are rejected because no chain from the start of the file reaches them: each task shortens
its own chains to their exits from the range, and pointer jumping over those exits finds the one offset at which
the file's true chain enters each range. Records are then read from the entries.

Ranges are dealt over a bounded number of tasks, each of which takes RANGES_BYTES of archive, or an even share where
that would leave cores without work.

Defined results: an empty table gives no archives and no rows; payloads of any length are written whole (one at a
time in memory); other columns, whatever their names, are ignored; a null payload is empty; of rows with equal payloads the largest page_id's are responses (all of
them, if that id repeats) and others are revisits of it; rows with a null page_id count as smallest, and are
responses where no other row has their payload; a null url is written as urn:null.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, scratch_path, ship, small
from millrace.llm.storage import create, filesystem

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/1.0\r\n"
SPLIT, PIECE, LEVEL = 4 << 20, 1 << 16, 6
#: Bytes of archive that a reading task takes at least, where there are enough for all cores.
RANGES_BYTES = 1 << 30
#: Rows of (page, response) that are broadcast at most; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]).encode() + b"\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record as a gzip member. A revisit keeps the HTTP headers, with the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url is not None else "urn:null"), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return _member(headers, http if revisit else http + payload)


def parse(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return Record(headers, rest[: int(headers["content-length"])])


def _page(uri: str) -> int | None:
    value = uri.strip("<>").rpartition(":")[2]
    return int(value) if value != "None" else None


def write(pages: DataFrame, id_column: str, url_column: str, payload_column: str, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes a record per row and returns (path, size) of the archives, one per partition.

    A task's file has a name of its own; only files named in the checkpointed result are archives, so tasks may
    run again. Payloads are shuffled only where there are more revisits than can be broadcast.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col(id_column).cast("bigint").alias("id"), F.col(url_column).alias("url"), F.coalesce(payload_column, F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    keys = rows.filter(F.octet_length("payload") >= least_bytes).select("id", "digest")
    shared = keys.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("first")).filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first")
    later = cut(keys.join(shared, F.col("digest") == F.col("of")).filter("NOT (id <=> first)").select(F.col("id").alias("r_id"), "of", "first").distinct())
    decided = rows.join(small(later, BROADCAST_ROWS), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("of")), "left").select("id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path = None, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is None:
                    file = create(path)
                    file.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"software: millrace\r\n"))
                page_id, url, payload, first = row
                file.write(page_member(page_id, url, payload.encode("utf-8", "replace"), first, first is not None))
        if file is not None:
            size = file.tell()
            file.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size]})

    return cut(decided.mapInArrow(run, "path string, size bigint"))


def member_end(file, offset: int) -> tuple[int | None, bytes]:
    """Where the gzip member at the offset ends, if it is a WARC record, and its first bytes. Holds one piece at a time."""
    unpack, at, head = zlib.decompressobj(31), offset, b""
    file.seek(offset)
    try:
        while not unpack.eof:
            piece = file.read(PIECE)
            if not piece:
                return None, b""
            at += len(piece)
            data = piece
            while not unpack.eof:
                out = unpack.decompress(data, PIECE)
                if len(head) < len(VERSION):
                    head += out[: len(VERSION) - len(head)]
                    if not VERSION.startswith(head[: len(VERSION)]):
                        return None, b""
                data = unpack.unconsumed_tail
                if not data and len(out) < PIECE:  # a full piece may leave output to fetch without input
                    break
        return (at - len(unpack.unused_data), head) if head == VERSION else (None, b"")
    except zlib.error:
        return None, b""


def successors(file, start: int, end: int) -> list[tuple[int, int]]:
    """(offset, successor) of every candidate that begins in [start, end)."""
    file.seek(start)
    data, found, at = file.read(end - start + len(MAGIC) - 1), [], -1
    while (at := data.find(MAGIC, at + 1)) >= 0:
        stop, _ = member_end(file, start + at)
        if stop is not None:
            found.append((start + at, stop))
    return found


def exits(found: list[tuple[int, int]], end: int) -> list[int]:
    """Per candidate of a range, where its chain leaves the range; -1 if it breaks off inside."""
    leaves: dict[int, int] = {}
    for offset, stop in reversed(found):
        leaves[offset] = stop if stop >= end else leaves.get(stop, -1)
    return [leaves[offset] for offset, _ in found]


def task_count(spark: SparkSession, ranges: int, split: int) -> int:
    """Tasks for so many byte ranges: no more than ranges, and, beyond four a core, one for RANGES_BYTES."""
    return max(1, min(ranges, max(4 * spark.sparkContext.defaultParallelism, -(-ranges * split // RANGES_BYTES))))


def entries(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, size, entry, end): for each byte range that the file's true chain enters, where, and the range's end.

    Raises ValueError if a file's chain doesn't reach its end: the file is cut short or damaged.
    """
    spark = archives.sparkSession
    ship(spark)
    ranges = archives.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split).cast("bigint"))).alias("start"))
    n = ranges.count()
    if not n:
        return spark.createDataFrame([], "path string, size bigint, entry bigint, end bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                fs, path = filesystem(task["path"])
                with fs.open_input_file(path) as file:
                    end = min(task["start"] + split, task["size"])
                    found = successors(file, task["start"], end)
                yield pa.RecordBatch.from_arrays([pa.array([task["path"]] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(exits(found, end), pa.int64())], names=["path", "offset", "successor", "exit"])

    candidates = cut(ranges.repartition(task_count(spark, n, split)).mapInArrow(run, "path string, offset bigint, successor bigint, exit bigint"))
    # only a candidate at which some range's chain arrives, or a file starts, can be an entry
    arrivals = candidates.select("path", F.col("exit").alias("offset")).union(archives.select("path", F.lit(0).cast("bigint"))).filter("offset >= 0").distinct()
    jump = cut(arrivals.join(candidates.select("path", "offset", F.col("exit").alias("to")), ["path", "offset"]))
    reached = archives.select("path", F.lit(0).cast("bigint").alias("offset"))
    most = archives.agg(F.max("size")).first()[0]
    for _ in range(math.ceil(math.log2(most / split + 2)) + 1):  # each round doubles how far a jump goes
        reached = cut(reached.union(reached.join(jump, ["path", "offset"]).select("path", "to")).distinct())
        hop = jump.select("path", F.col("offset").alias("to"), F.col("to").alias("further"))
        jump = cut(jump.join(hop, ["path", "to"], "left").select("path", "offset", F.coalesce("further", "to").alias("to")))
    broken = archives.select("path", F.col("size").alias("offset")).join(reached, ["path", "offset"], "left_anti").limit(3).collect()
    if broken:
        raise ValueError(f"the record chain doesn't reach the end of {[x['path'] for x in broken]}")
    return archives.join(reached, "path").filter("offset < size").select("path", "size", F.col("offset").alias("entry"), F.least(F.col("size"), (F.floor(F.col("offset") / split) + 1) * split).cast("bigint").alias("end"))


def read(archives: DataFrame, split: int = SPLIT, payloads: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of the page records of (path, size) archives."""
    spark: SparkSession = archives.sparkSession
    starts = cut(entries(archives, split))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def rows(file, at: int, end: int) -> Iterator[tuple]:
        while at < end:
            file.seek(at)
            unpack, parts = zlib.decompressobj(31), []
            while not unpack.eof:
                piece = file.read(PIECE)
                at += len(piece)
                parts.append(unpack.decompress(piece))
            at -= len(unpack.unused_data)
            record = parse(b"".join(parts))
            kind = record.headers["warc-type"]
            if kind in ("response", "revisit"):
                http, _, payload = record.block.partition(b"\r\n\r\n")
                if kind == "response":
                    length, digest = len(payload), base32_sha1(payload)
                else:
                    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).partition(b":")[2])
                    digest = record.headers["warc-payload-digest"].removeprefix("sha1:")
                refers = record.headers.get("warc-refers-to")
                yield (_page(record.headers["warc-record-id"]), record.headers["warc-target-uri"], length, digest, kind, _page(refers) if refers else None, payload)

    def batch_of(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                fs, path = filesystem(task["path"])
                with fs.open_input_file(path) as file:
                    part, held = [], 0
                    for row in rows(file, task["entry"], task["end"]):
                        part.append(row)
                        held += len(row[6]) * payloads + 200
                        if held > 8 << 20:
                            yield batch_of(part)
                            part, held = [], 0
                    yield batch_of(part)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payloads
    ship(spark)
    return starts.repartition(task_count(spark, starts.count(), split)).mapInArrow(run, schema)


def oracle_sql() -> str:
    """The rows of write() and read(), with base32 spelt out of the hexadecimal SHA-1."""
    digit = "instr('0123456789abcdef', substr(hex, {0}, 1)) - 1"
    five = f"((({digit.format('5 * i // 4 + 1')}) * 16 + CASE WHEN 5 * i // 4 + 2 <= 40 THEN {digit.format('5 * i // 4 + 2')} ELSE 0 END) >> (3 - 5 * i % 4)) & 31"
    return f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM p)
        SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({five})::INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM q"""
