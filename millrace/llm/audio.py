"""Audio columns: 8-bit PCM in WAV, polyphase resampling, log-mel filterbanks and energy segmentation.

All frames of a recording become tensors of the fixed shape FRAMES x MELS with the time span that they cover;
the last is padded with the floor value. Hysteresis marks frames: a segment opens when a frame's energy rises
above a high threshold and closes when it falls below a low one; a mark says that a frame is in a segment, and
no frame is left out for having none.

Media are stored as a Parquet column, tensors with their spans and marks as Arrow files (a fixed-shape tensor
column), both in the shared folder; digests are made from what is read back. Files that tasks write have names of
their own and only those in the checkpointed manifest count, so a task may run twice.

Every recording is computed alone, BLOCK_FRAMES frames at a time, and equal recordings have equal features to the
last bit. Beside the recording itself, a task holds its log-mel energies, about a quarter of its bytes.

Defined results: a null or empty payload is padded like any other; repeated rows and null ids are rows like any
other; an empty table gives no files and no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.common import Scratch, cut, scratch_path, ship, slices
from millrace.llm.storage import create, filesystem

PAD_TO = 192
SAMPLE_RATE, TARGET_RATE = 16_000, 8_000
WINDOW, HOP, MELS, FRAMES = 256, 192, 20, 32
#: Hysteresis in natural-log energy above the recording's mean energy.
RISE, FALL = 0.0, -0.35
FLOOR = -8.0
#: Frames that are transformed at once.
BLOCK_FRAMES = 4096


def wav(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """Mono 8-bit unsigned PCM; each payload byte is a sample. An odd length takes the format's pad byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + (len(payload) & 1), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) & 1)


def read_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a mono 8-bit WAV; chunks that it doesn't know are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        if name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def padded(raw: bytes, to: int = PAD_TO) -> bytes:
    """raw and bytes 32 up to a positive multiple of `to`."""
    return raw + b" " * (-len(raw) % to or (to if not raw else 0))


@lru_cache(maxsize=8)
def _filter(up: int, down: int, taps: int = 8) -> np.ndarray:
    """Windowed-sinc low-pass in `up` phases of 2 * taps * max(up, down) / up coefficients each."""
    most = max(up, down)
    half = taps * most
    x = np.arange(-half, half + 1)
    h = np.sinc(x / most) * np.hamming(len(x))
    h *= up / h.sum()
    return np.concatenate([h, np.zeros(-len(h) % up)]).reshape(-1, up).T.copy()


def reach(start: int, stop: int, up: int, down: int) -> tuple[int, int]:
    """The inputs [lo, hi), in part beyond the signal's ends, that outputs start to stop - 1 depend on."""
    h = _filter(up, down)
    delay = (h.size - 1) // 2
    return (start * down + delay) // up - h.shape[1] + 1, ((stop - 1) * down + delay) // up + 1


def resampled(source: np.ndarray, start: int, stop: int, up: int, down: int) -> np.ndarray:
    """Outputs start to stop - 1 from the inputs that they reach. Output n uses only the filter phase (n * down) % up."""
    h = _filter(up, down)
    width, delay, (lo, _) = h.shape[1], (h.size - 1) // 2, reach(start, stop, up, down)
    out, windows = np.empty(stop - start, np.float32), np.lib.stride_tricks.sliding_window_view(source, width)
    for first in range(start, min(start + up, stop)):  # outputs `up` apart share a phase and step by `down` inputs
        place = first * down + delay
        n = len(range(first, stop, up))
        out[first - start :: up] = windows[place // up - width + 1 - lo :: down][:n] @ h[place % up][::-1].astype(np.float32)
    return out


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """The whole signal at up / down times its rate."""
    n = -(-len(x) * up // down)
    if not n:
        return np.empty(0, np.float32)
    lo, hi = reach(0, n, up, down)
    return resampled(np.concatenate([np.zeros(-lo, np.float32), x.astype(np.float32), np.zeros(max(0, hi - len(x)), np.float32)])[: hi - lo], 0, n, up, down)


@lru_cache(maxsize=4)
def mel_bank(rate: int, window: int = WINDOW, mels: int = MELS) -> np.ndarray:
    """Triangles, equally spaced on the mel scale: (window / 2 + 1) x mels."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(window // 2 + 1) * rate / window
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log-mel energies, log energy of each frame) of 8-bit samples, resampled; at least one frame."""
    down = rate // TARGET_RATE
    length = -(-len(samples) // down)
    n = max(1, 1 + -(-(length - WINDOW) // HOP))
    mean = float(samples.sum(dtype=np.int64)) / max(1, len(samples))
    shape, bank, floor = np.hanning(WINDOW).astype(np.float32), mel_bank(TARGET_RATE), np.float32(np.exp(FLOOR))
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for lo in range(0, n, BLOCK_FRAMES):
        hi = min(n, lo + BLOCK_FRAMES)
        start, stop = lo * HOP, (hi - 1) * HOP + WINDOW
        signal = np.zeros(stop - start, np.float32)
        if (own := min(stop, length)) > start:
            a, b = reach(start, own, 1, down)
            source = np.zeros(b - a, np.float32)
            first, last = max(a, 0), min(b, len(samples))
            source[first - a : last - a] = (samples[first:last] - np.float32(mean)) / np.float32(128)
            signal[: own - start] = resampled(source, start, own, 1, down)
        frames = np.lib.stride_tricks.sliding_window_view(signal, WINDOW)[::HOP] * shape
        power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
        mel[lo:hi] = np.log(np.maximum(power @ bank, floor))
        energy[lo:hi] = np.log(np.maximum(power.sum(1), floor))
    return mel, energy


def segments(energy: np.ndarray, rise: float, fall: float) -> np.ndarray:
    """Frame ranges [start, end) of hysteresis segmentation: open above rise, close below fall."""
    mark = np.where(energy > rise, 1, np.where(energy < fall, -1, 0))
    known = np.flatnonzero(mark)
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[np.maximum(last, 0)] == 1) if len(known) else np.zeros(len(mark), bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return edge.reshape(-1, 2)


def marked_features(samples: bytes, rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n x FRAMES x MELS float32 tensors, n x 2 spans in milliseconds, n x FRAMES marks of the frames in segments)."""
    mel, energy = log_mel(np.frombuffer(samples, np.uint8), rate)
    level, end = float(energy.mean()), len(mel)
    n = -(-end // FRAMES)
    block, marks = np.full((n * FRAMES, MELS), FLOOR, np.float32), np.zeros(n * FRAMES, bool)
    block[:end] = mel
    for first, last in segments(energy, level + RISE, level + FALL).tolist():
        marks[first:last] = True
    at = FRAMES * np.arange(n)
    spans = np.stack([at * HOP, (np.minimum(at + FRAMES, end) - 1) * HOP + WINDOW], 1) * 1000 // TARGET_RATE
    return block.reshape(n, FRAMES, MELS), spans, marks.reshape(n, FRAMES)


def tensor_array(tensors: np.ndarray) -> pa.FixedShapeTensorArray:
    """The tensors as an Arrow column of fixed shape."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors, np.float32)) if len(tensors) else pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS)), pa.array([], pa.list_(pa.float32(), FRAMES * MELS)))


def store(df: DataFrame, id_column: str, text_column: str, scratch: Scratch | None = None) -> DataFrame:
    """(id, n_bytes, media): each text's padded bytes as a WAV column, written to the shared folder and read from there."""
    ship(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            raw = [(x or "").encode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([wav(padded(x)) for x in raw], pa.large_binary())], names=[id_column, "n_bytes", "media"])

    media = df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_bytes bigint, media binary")
    return (scratch or Scratch(df.sparkSession)).store(media, "media", "zstd")


RECORDING = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_tensors", pa.int64())]
TENSOR = pa.schema([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("mel", pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))), ("marks", pa.list_(pa.bool_(), FRAMES))])


def tensor_batch(tensors: np.ndarray, spans: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
    flags = pa.FixedSizeListArray.from_arrays(pa.array(marks.reshape(-1)), FRAMES)
    return pa.RecordBatch.from_arrays([pa.array(spans[:, 0], pa.int64()), pa.array(spans[:, 1], pa.int64()), tensor_array(tensors), flags], schema=TENSOR)


def write_tensors(media: DataFrame, id_column: str, folder: str | None = None) -> DataFrame:
    """Writes what `store` made as tensors; (path, n) of each pair of files: path.recordings with a row per recording,
    and path.tensors with its tensors, in the same order."""
    spark = media.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "tensors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options, n, files = pa.ipc.IpcWriteOptions(compression="zstd"), 0, []
        for batch in (part for whole in batches for part in slices(whole, 2)):
            if not files:
                path = f"{folder}/{uuid.uuid4().hex}"
                sinks = [create(f"{path}.{x}") for x in ("recordings", "tensors")]
                schema = pa.schema([("id", batch.column(0).type), *RECORDING])
                files = [pa.ipc.new_stream(sink, x, options=options) for sink, x in zip(sinks, (schema, TENSOR), strict=True)]
            rows, waiting, held = [], [], 0
            for n_bytes, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                blob = blob.as_py()
                samples, rate = read_wav(blob)
                made = marked_features(samples, rate)
                rows.append((n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), len(made[0])))
                waiting.append(made)
                held += len(made[0])
                if held > 512:
                    files[1].write_batch(tensor_batch(*(np.concatenate(x) for x in zip(*waiting, strict=True))))
                    waiting, held = [], 0
            if waiting:
                files[1].write_batch(tensor_batch(*(np.concatenate(x) for x in zip(*waiting, strict=True))))
            files[0].write_batch(pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(RECORDING))], schema=schema))
            n += len(rows)
        if files:
            for file in (*files, *sinks):
                file.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n": [n]})

    return cut(media.select(id_column, "n_bytes", "media").mapInArrow(run, "path string, n bigint"))


def recordings(path: str) -> Iterator[tuple[dict, Iterator[pa.RecordBatch]]]:
    """(row of the recording, its tensors in pieces) of a pair of files; the tensors of one must be taken before the next one."""
    fs, place = filesystem(path)
    with fs.open_input_stream(f"{place}.recordings") as one, fs.open_input_stream(f"{place}.tensors") as two:
        tensors, rest = pa.ipc.open_stream(two), None

        def own(left: int) -> Iterator[pa.RecordBatch]:
            nonlocal rest
            while left:
                if rest is None or not len(rest):
                    rest = tensors.read_next_batch()
                piece = rest.slice(0, left)
                rest, left = rest.slice(len(piece)), left - len(piece)
                yield piece

        for batch in pa.ipc.open_stream(one):
            for row in batch.to_pylist():
                yield row, own(row["n_tensors"])


def tensor_digest(pieces: Iterator[pa.RecordBatch]) -> str:
    """SHA-256 over those of a recording's tensors, spans and marks, whatever the pieces."""
    parts = [hashlib.sha256() for _ in range(4)]
    for piece in pieces:
        parts[0].update(np.ascontiguousarray(piece.column(2).to_numpy_ndarray(), "<f4").tobytes())
        parts[1].update(piece.column(0).to_numpy().astype("<i8").tobytes())
        parts[2].update(piece.column(1).to_numpy().astype("<i8").tobytes())
        parts[3].update(piece.column(3).flatten().to_numpy(zero_copy_only=False).tobytes())
    return hashlib.sha256(b"".join(x.digest() for x in parts)).hexdigest()


def digests(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """What the stored form of each text holds when it is read back, and a digest of its stored tensors, spans and marks."""
    spark, kind = df.sparkSession, df.schema[id_column].dataType.simpleString()
    scratch = Scratch(spark)
    files = write_tensors(store(df, id_column, text_column, scratch), id_column)
    scratch.discard()  # the digests of the media stand beside the tensors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (x for batch in batches for x in batch.column(0).to_pylist()):
            rows: list[dict] = []
            for row, tensors in recordings(path):
                row["feature"] = f"{row['n_tensors']}x{FRAMES}x{MELS}:{tensor_digest(tensors)}"
                rows.append(row)
                if len(rows) == 4096:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    id_type = to_arrow_type(df.schema[id_column].dataType)
    names = [x for x, _ in RECORDING[:-1]]
    kinds = [k for _, k in RECORDING[:-1]]

    def _rows(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], id_type), *(pa.array([r[x] for r in rows], k) for x, k in zip(names, kinds, strict=True)), pa.array([r["feature"] for r in rows], pa.string())], names=[id_column, *names, "feature"])

    ship(spark)
    return files.repartition(max(1, files.count())).mapInArrow(run, f"`{id_column}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
