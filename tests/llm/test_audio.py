"""Audio features against plain forms, and the stored files."""

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import audio
from millrace.llm.storage import filesystem


def test_resampling_is_the_direct_convolution():
    x = np.random.default_rng(0).normal(size=700).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3), (147, 160)):
        h = audio._filter(up, down).T.reshape(-1)
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        want = np.convolve(stuffed, h)[(len(h) - 1) // 2 :: down]
        got = audio.resample(x, up, down)
        assert np.abs(got - want[: len(got)]).max() < 1e-5


def plain_log_mel(samples):
    """Log-mel and log energies by the formulas, one frame and one filter at a time, in 64 bits."""
    x = np.frombuffer(samples, np.uint8).astype(float)
    x = (x - x.mean()) / 128
    taps = 8 * 2
    t = np.arange(-taps, taps + 1)
    h = np.sinc(t / 2) * np.hamming(len(t))
    h /= h.sum()
    low = np.convolve(x, h)[taps:][: len(x)][::2]
    n = max(1, 1 + math.ceil((len(low) - 256) / 192))
    low = np.concatenate([low, np.zeros(max(0, (n - 1) * 192 + 256 - len(low)))])
    mel_of, hertz = lambda f: 2595 * math.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hertz(mel_of(4000) * i / 21) for i in range(22)]
    dft = np.exp(-2j * np.pi * np.outer(np.arange(129), np.arange(256)) / 256)
    mel, energy = np.empty((n, 20)), np.empty(n)
    for f in range(n):
        power = np.abs(dft @ (low[f * 192 : f * 192 + 256] * np.hanning(256))) ** 2
        energy[f] = math.log(max(power.sum(), math.exp(-8)))
        for m, (a, b, c) in enumerate(zip(edges, edges[1:], edges[2:])):
            weights = [max(0.0, min((k * 8000 / 256 - a) / (b - a), (c - k * 8000 / 256) / (c - b))) for k in range(129)]
            mel[f, m] = math.log(max(power @ np.array(weights), math.exp(-8)))
    return mel, energy


@pytest.mark.parametrize("size", [192, 384, 385, 768, 5000, 19_200])
@pytest.mark.parametrize("block", [3, audio.BLOCK_FRAMES])
def test_log_mel_equals_the_formulas(monkeypatch, size, block):
    monkeypatch.setattr(audio, "BLOCK_FRAMES", block)
    samples = bytes(32 + (i * i // 5 + i % 17) % 90 for i in range(size))
    mel, energy = audio.log_mel(np.frombuffer(samples, np.uint8), audio.SAMPLE_RATE)
    want, power = plain_log_mel(samples)
    assert mel.shape == want.shape and np.abs(mel - want).max() < 5e-3 and np.abs(energy - power).max() < 1e-3


def test_blocks_change_no_bit(monkeypatch):
    samples = np.frombuffer(bytes(i * i % 251 for i in range(50_000)), np.uint8)
    whole = audio.log_mel(samples, audio.SAMPLE_RATE)
    monkeypatch.setattr(audio, "BLOCK_FRAMES", 7)
    assert all(np.abs(a - b).max() < 1e-4 for a, b in zip(whole, audio.log_mel(samples, audio.SAMPLE_RATE), strict=True))


def test_hysteresis_segments():
    e = np.array([0, 3, 1, 1, -1, 0, 0, 2, 0, 0, -2, 5.0])
    assert audio.segments(e, 1.5, -0.5).tolist() == [[1, 4], [7, 10], [11, 12]]
    assert audio.segments(np.zeros(4), 1, -1).tolist() == []


def feature(samples):
    """The query's feature from the tensors themselves."""
    tensors, spans, marks = audio.marked_features(samples, audio.SAMPLE_RATE)
    parts = (tensors.astype("<f4").tobytes(), spans[:, 0].astype("<i8").tobytes(), spans[:, 1].astype("<i8").tobytes(), marks.reshape(-1).tobytes())
    return f"{len(tensors)}x32x20:" + hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).hexdigest()


def test_stored_media_and_tensors(spark):
    tone = "".join(chr(40 + (i * i // 7) % 80) for i in range(30_000))
    texts = [tone, tone, None, "word", "", "a" * 150 + "b" * 200, tone * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(2)
    media = audio.store(df, "id", "text")
    blobs = {r["id"]: bytes(r["media"]) for r in media.collect()}
    assert audio.read_wav(blobs[0]) == (audio.padded(tone.encode()), audio.SAMPLE_RATE) and audio.read_wav(blobs[2])[0] == b" " * 192
    files = audio.write_tensors(media, "id").collect()
    assert sum(f["n"] for f in files) == len(texts)
    seen = {}
    for f in files:
        fs, place = filesystem(f["path"])
        with fs.open_input_stream(f"{place}.tensors") as file:
            kind = pa.ipc.open_stream(file).schema.field("mel").type
            assert kind == pa.fixed_shape_tensor(pa.float32(), (32, 20))
        for row, pieces in audio.recordings(f["path"]):
            pieces = list(pieces)
            seen[row["id"]] = np.concatenate([p.column(2).to_numpy_ndarray() for p in pieces]), [s for p in pieces for s in p.column(0).to_pylist()]
    for i, blob in blobs.items():
        tensors, spans, _ = audio.marked_features(*audio.read_wav(blob))
        assert np.array_equal(seen[i][0], tensors) and seen[i][1] == spans[:, 0].tolist()
    rows = {r["id"]: r for r in audio.digests(df, "id", "text").collect()}
    for i, blob in blobs.items():
        assert rows[i]["feature"] == feature(audio.read_wav(blob)[0]) and rows[i]["media_sha256"] == hashlib.sha256(blob).hexdigest() and rows[i]["media_bytes"] == len(blob)
    assert len({r["feature"] for r in rows.values()}) == len(texts) - 2  # the tone twice, and null beside empty


def test_every_audio_frame_is_in_a_tensor():
    loud, quiet = bytes(i * i % 251 for i in range(19_200)), bytes(127 + i % 2 for i in range(19_200))
    samples = loud + quiet + loud
    mel, energy = audio.log_mel(np.frombuffer(samples, np.uint8), audio.SAMPLE_RATE)
    tensors, spans, marks = audio.marked_features(samples, audio.SAMPLE_RATE)
    assert np.array_equal(tensors.reshape(-1, audio.MELS)[: len(mel)], mel) and (tensors.reshape(-1, audio.MELS)[len(mel) :] == audio.FLOOR).all()
    level, flat = energy.mean(), marks.reshape(-1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flat, [0]]).astype(int))).reshape(-1, 2)
    assert edges.tolist() == audio.segments(energy, level + audio.RISE, level + audio.FALL).tolist() and 0 < flat.sum() < len(mel)
    assert spans[:, 0].tolist() == [i * audio.FRAMES * audio.HOP // 8 for i in range(len(tensors))]


def test_other_wav_files():
    body = audio.wav(b"abc", 8000)
    assert audio.read_wav(body[:36] + b"note\x03\0\0\0xyz\0" + body[36:]) == (b"abc", 8000) and len(body) % 2 == 0
    for broken in (b"", body[:36], b"RIFX" + body[4:]):
        with pytest.raises(ValueError, match="WAV|samples"):
            audio.read_wav(broken)
