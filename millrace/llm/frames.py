"""Patched frame-of-reference files of token ids.

A file is a sequence of blocks of BLOCK ids. A block stores its minimum; the differences from it are packed
at the width that the block's PERCENTILE smallest differences need; larger ones are stored whole in an
exception list. The footer indexes the block starts, so any range of ids is read without what precedes it,
and lists the documents with their numbers of ids.

Defined results: a null text has only the end id; documents that tie in doc_id follow their texts' XXH64, then
their texts; a null doc_id sorts first; rows that repeat are stored each; an empty table gives no files and no rows;
texts of any length are encoded whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import encoded, vocabulary
from millrace.llm.common import cut, scratch_path, ship, slices, texts
from millrace.llm.storage import create, filesystem

BLOCK, PERCENTILE, MAGIC = 4096, 95.0, b"PFORIDS1"
_HEAD = struct.Struct("<IIHH")  # minimum, ids, width, exceptions
_TAIL = struct.Struct("<QQQ8s")  # footer offset, blocks, documents


def pack(values: np.ndarray, width: int) -> bytes:
    """`width` low bits of each value, end to end, little-endian."""
    if not width:
        return b""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=width)
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    whole = np.zeros((n, 32), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1)


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block; ids: 1 to 65,535 integers below 2**32."""
    low = int(ids.min())
    rest = (ids - low).astype(np.uint32)
    nth = min(len(rest) - 1, int(np.ceil(len(rest) * percentile / 100)) - 1)
    width = int(np.partition(rest, nth)[nth]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    packed = pack(rest, width)
    return _HEAD.pack(low, len(rest), width, len(odd)) + packed + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    low, n, width, n_odd = _HEAD.unpack_from(data)
    at = _HEAD.size + (n * width + 7) // 8
    rest = unpack(data[_HEAD.size : at], n, width)
    rest[np.frombuffer(data, "<u2", n_odd, at)] = np.frombuffer(data, "<u4", n_odd, at + 2 * n_odd)
    return rest + np.uint32(low)


class IdWriter:
    """Writes documents' ids to an open binary file; holds one block and the footer."""

    def __init__(self, file: BinaryIO):
        self.file, self.starts, self.waiting, self.n_waiting = file, [len(MAGIC)], [], 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        file.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.counts += counts.tolist()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= BLOCK:
            whole = np.concatenate(self.waiting)
            end = len(whole) // BLOCK * BLOCK
            for at in range(0, end, BLOCK):
                self._block(whole[at : at + BLOCK])
            self.waiting, self.n_waiting = [whole[end:]], len(whole) - end

    def _block(self, ids: np.ndarray) -> None:
        data = encode_block(ids)
        self.file.write(data)
        self.starts.append(self.starts[-1] + len(data))

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        self.file.write(np.array(self.starts, "<u8").tobytes())
        self.file.write(np.array([x or 0 for x in self.doc_ids], "<i8").tobytes())
        self.file.write(np.array([x is None for x in self.doc_ids], np.uint8).tobytes())
        self.file.write(np.array(self.counts, "<u8").tobytes())
        self.file.write(_TAIL.pack(self.starts[-1], len(self.starts) - 1, len(self.counts), MAGIC))


class IdReader:
    """Reads a file of IdWriter."""

    def __init__(self, file: BinaryIO, size: int):
        self.file = file
        file.seek(size - _TAIL.size)
        at, blocks, docs, magic = _TAIL.unpack(file.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids, or cut short")
        file.seek(at)
        footer = file.read(size - _TAIL.size - at)
        self.starts = np.frombuffer(footer, "<u8", blocks + 1).astype(np.int64)
        ids = np.frombuffer(footer, "<i8", docs, 8 * (blocks + 1)).tolist()
        null = np.frombuffer(footer, np.uint8, docs, 8 * (blocks + 1 + docs)).tolist()
        self.doc_ids = [None if n else i for i, n in zip(ids, null, strict=True)]
        self.counts = np.frombuffer(footer, "<u8", docs, 8 * (blocks + 1 + docs) + docs).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        self.file.seek(int(self.starts[k]))
        return decode_block(self.file.read(int(self.starts[k + 1] - self.starts[k])))

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the start-th on; only the blocks that hold them are read."""
        if n <= 0:
            return np.empty(0, np.uint32)
        first = start // BLOCK
        whole = np.concatenate([self.block(k) for k in range(first, (start + n - 1) // BLOCK + 1)])
        return whole[start - first * BLOCK : start - first * BLOCK + n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id's place in the file, ids) of each document, in order; each block is decoded once."""
        block, at, start = -1, np.empty(0, np.uint32), 0
        for doc_id, n in zip(self.doc_ids, self.counts.tolist(), strict=True):
            parts, place, left = [], start, n
            while left:
                if place // BLOCK != block:
                    block = place // BLOCK
                    at = self.block(block)
                parts.append(at[place % BLOCK : place % BLOCK + left])
                place, left = place + len(parts[-1]), left - len(parts[-1])
            yield doc_id, start, np.concatenate(parts) if parts else np.empty(0, np.uint32)
            start += n


def write_ids(docs: DataFrame, id_column: str, text_column: str, vocabulary_path: str, end_id: int, folder: str | None = None) -> list[dict]:
    """Encodes all texts and writes them in ascending order of id_column; returns the files in that order.

    Each task of a range partition writes one file under a name of its own, so a task that runs twice harms
    nothing: only files that the checkpointed manifest names belong to the result. The manifest has a row
    per file and is all that comes to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "ids")
    ordered = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text")).withColumns({"th": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    # rows of one id, or of no id, may be many: they are split by text hash, and equal rows, which any order serves, by place
    ordered = ordered.repartitionByRange("id", "th", "nth").sortWithinPartitions("id", "th", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, file, docs_in, ids_in = vocabulary(vocabulary_path), None, 0, 0
        for batch in (part for whole in batches for part in slices(whole, 1)):
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, ids, counts in encoded(texts(batch.column(1)), bpe):
                if file is None:
                    part, path = batch.column(2)[0].as_py(), f"{folder}/{uuid.uuid4().hex}.ids"
                    file = create(path)
                    writer = IdWriter(file)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                writer.add(doc_ids[lo:hi], ids, counts + 1)
                docs_in, ids_in = docs_in + hi - lo, ids_in + len(ids)
        if file is not None:
            writer.close()
            size = file.tell()
            file.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "size": [size], "n_docs": [docs_in], "n_ids": [ids_in]})

    manifest = cut(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, "part bigint, path string, size bigint, n_docs bigint, n_ids bigint"))
    return [x.asDict() for x in sorted(manifest.collect(), key=lambda x: x["part"])]


def read_documents(spark, files: list[dict]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read from the files."""
    ship(spark)
    starts = np.cumsum([0] + [x["n_ids"] for x in files]).tolist()
    tasks = spark.createDataFrame([(x["path"], x["size"], s) for x, s in zip(files, starts, strict=False)], "path string, size bigint, start bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.to_pylist():
                fs, path = filesystem(task["path"])
                with fs.open_input_file(path) as file:
                    rows: list[tuple] = []
                    for doc_id, start, ids in IdReader(file, task["size"]).documents():
                        rows.append((doc_id, task["start"] + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                        if len(rows) == 8192:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tasks.repartition(max(1, len(files))).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
