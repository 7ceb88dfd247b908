"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the n-grams of its normal form (words, A-Z and Latin-1 letters lower-cased, one space
between) that it holds, hashed to 2**bits places. Feature j has the value r_j, the log ratio of its document
frequencies in the two classes; a support vector machine with squared hinge loss is fitted to these values and
penalised in their space, so a feature's ratio sets how cheaply it takes weight. Labels are learnt from at most
most_texts rows of each class, those whose ids hash lowest; scores use the text alone.

Orders, number of features and cost were chosen by cross-validation on rows that may teach. `selected` keeps the
n-grams with the largest |r| * sqrt(document frequency); None keeps all that occur in least_frequency texts.

Defined results: null and empty texts have no features and get the score of the bias; labels that are null, or
of documents that don't exist, teach nothing; without both classes every score is near the one class's label (0 if
nothing is labelled); repeated labels count as often as they stand; of documents that share an id, the one whose
text sorts first is learnt from; texts of any length are taken whole, CHUNK bytes at a time (a longer one alone);
empty tables give no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_texts, cut, runs, ship

ORDERS, BITS = (5, 6, 7), 20
#: Labelled rows of each class that training reads at most.
MOST_TEXTS = 8000
SELECTED, LEAST_FREQUENCY = 2048, 5
#: Cost of a unit of loss against a unit of the weights' squares; most rounds over the rows, and when they end.
COST, ROUNDS, TOLERANCE = 10.0, 20, 0.01
#: Bytes of text that are turned into features at once.
CHUNK = 1 << 19
_NORMAL = np.array([b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256)], np.uint8)


def lower_latin(flat: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capital letters U+00C0 to U+00DE made small."""
    after = np.flatnonzero(flat[:-1] == 0xC3) + 1
    capital = after[(flat[after] >= 0x80) & (flat[after] <= 0x9E) & (flat[after] != 0x97)]
    flat = flat.copy()
    flat[capital] += 0x20
    return flat


def features(flat: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each feature that a document holds, each once; `wanted`: of these features only."""
    sizes, flat = np.diff(offsets), lower_latin(flat)
    # a space before each document and after the last, so that words at the edges have both their boundaries
    body = np.full(len(flat) + len(sizes) + 1, 32, np.uint8)
    body[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes) + 1] = _NORMAL[flat]
    keep = np.concatenate([[True], (body[1:] != 32) | (body[:-1] != 32)])
    starts = offsets[:-1] + np.arange(len(sizes))
    keep[starts] = True
    document = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes + 1)
    document = np.append(document, np.uint64(max(0, len(sizes) - 1)))[keep] if len(sizes) else np.empty(0, np.uint64)
    body = body[keep].astype(np.uint64)
    found = []
    for order in orders:
        if len(body) < order:
            continue
        h = np.zeros(len(body) - order + 1, np.uint64)
        for i in range(order):
            h = (h << np.uint64(8)) | body[i : i + len(h)]
        bucket = ((h + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        # the last byte may be the space that opens the next document; anything beyond it is of another text
        own = document[: len(h)] == document[order - 2 : order - 2 + len(h)]
        own &= (document[order - 1 : order - 1 + len(h)] == document[: len(h)]) | ((h & np.uint64(255) == 32) & (h >> np.uint64(8) & np.uint64(255) != 32))
        if wanted is not None:
            own &= wanted[bucket]
        found.append(document[: len(h)][own] << np.uint64(bits) | bucket[own])
    pairs = np.concatenate(found) if found else np.empty(0, np.uint64)
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    return (pairs >> np.uint64(bits)).astype(np.int64), (pairs & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of every feature, float32: the fitted weight times the ratio
    bias: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    def scores(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        document, feature = features(flat, offsets, self.weights != 0, self.orders, self.bits)
        z = self.bias + np.bincount(document, weights=self.weights[feature].astype(np.float64), minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def held_out(id_column: str, modulus: int = 5) -> Column:
    """Rows that teach nothing: CRC-32 of the id as text is divisible by the modulus. A null id is one of them."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == 0, F.lit(True))


def log_ratios(n0: np.ndarray, n1: np.ndarray, texts0: int, texts1: int) -> np.ndarray:
    """Naive Bayes: ln of how much likelier a text of class 1 holds the feature than one of class 0."""
    return np.log((n1 + 1) / (texts1 + 2)) - np.log((n0 + 1) / (texts0 + 2))


def fit(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, modulus: int = 5, most_texts: int = MOST_TEXTS, selected: int | None = SELECTED, least_frequency: int = LEAST_FREQUENCY, orders: tuple[int, ...] = ORDERS, bits: int = BITS, cost: float = COST, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Model:
    """Learns from labelled rows that are not held out. What comes to the driver is bounded by 2**bits counts and by
    2 * most_texts rows of at most `selected` (or 2**bits) features, whatever the size of the tables."""
    ship(docs.sparkSession)
    width = 1 << bits
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).filter(F.col("label").isin(0, 1)).filter(~held_out("id", modulus))
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        share = float(count.get(1, 0) > 0)
        return Model(np.zeros(width, np.float32), 30.0 if share else -30.0, orders, bits)
    sample = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most_texts)
        sample = part if sample is None else sample.union(part)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    times = sample.groupBy("id", "label").agg(F.count("*").cast("int").alias("times"))
    # one text an id, combined before the shuffle: however often an id repeats, there are 2 * most_texts rows at most
    once = texts.join(F.broadcast(times), "id").groupBy("id", "label", "times").agg(F.min("text").alias("text"))
    rows = cut(once.select("label", "text", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("label", "text"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width), np.int32)
        for batch in batches:
            label = batch.column(0).to_numpy().astype(np.int64)
            flat, offsets = byte_texts(batch.column(1))
            for lo, hi in runs(np.diff(offsets), CHUNK):
                document, feature = features(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], None, orders, bits)
                for c in (0, 1):
                    total[c] += np.bincount(feature[label[lo:hi][document] == c], minlength=width).astype(np.int32)
        seen = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen], pa.int64()), pa.array(total[1, seen], pa.int64())], names=["feature", "n0", "n1"])

    table = rows.mapInArrow(counts, "feature bigint, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= least_frequency).toArrow()
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = table.column("n0").to_numpy(), table.column("n1").to_numpy()
    ratio = log_ratios(n0, n1, n.get(0, 0), n.get(1, 0))
    best = np.lexsort((table.column("feature").to_numpy(), -np.abs(ratio) * np.sqrt(n0 + n1)))[:selected]
    chosen, ratio = table.column("feature").to_numpy()[best], ratio[best]
    index = np.full(width, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            flat, offsets = byte_texts(batch.column(1))
            for lo, hi in runs(np.diff(offsets), CHUNK):
                document, feature = features(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], index >= 0, orders, bits)
                at = np.searchsorted(document, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(index[feature], pa.int32()))], names=["label", "own"])

    drawn = rows.mapInArrow(select, "label int, own array<int>").toArrow()
    own = drawn.column("own").combine_chunks()
    sizes = np.diff(own.offsets.to_numpy()) if len(own) else np.empty(0, np.int64)
    label = drawn.column("label").to_numpy()
    # a row weighs as its class does in all labels, however many rows of it were drawn
    share = {c: count[c] / sum(count.values()) * len(label) / max(1, int((label == c).sum())) for c in (0, 1)}
    if not len(label):
        return Model(np.zeros(width, np.float32), float(np.log(count[1] / count[0])), orders, bits)
    weights, bias = solve(np.split(own.flatten().to_numpy(), np.cumsum(sizes)[:-1]), label, ratio, cost * np.where(label == 1, share[1], share[0]), rounds, tolerance)
    full = np.zeros(width, np.float32)
    full[chosen] = weights * ratio
    return Model(full, bias, orders, bits)


def solve(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """(w, b) that minimise (|w|**2 + b**2) / 2 + sum of cost_i * max(0, 1 - y_i (w.x_i + b))**2 by dual coordinate descent.

    x_i: the ratios, over the root of the rows' mean square sum, of the features that row i holds. The weights
    returned are for the ratios as they are. Rows are taken in an order that depends on nothing but their number.
    """
    rows = [np.sort(r) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (label[i], rows[i].tobytes()))  # not the order in which they arrived
    unit = 1 / np.sqrt(max(1e-12, np.mean([np.square(ratio[r]).sum() for r in rows])))
    x = [ratio[r] * unit for r in rows]
    y, slack = np.where(label == 1, 1.0, -1.0), 0.5 / cost
    scale = np.array([v @ v + 1 for v in x]) + slack
    w, b, dual, draw = np.zeros(len(ratio)), 0.0, np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in draw.permutation(order).tolist():
            gradient = y[i] * (w[rows[i]] @ x[i] + b) - 1 + slack[i] * dual[i]
            if dual[i] == 0 and gradient >= 0:
                continue
            worst = max(worst, abs(gradient))
            step = max(dual[i] - gradient / scale[i], 0.0) - dual[i]
            dual[i] += step
            w[rows[i]] += step * y[i] * x[i]
            b += step * y[i]
        if worst < tolerance:
            break
    return w * unit, float(b)


def score(docs: DataFrame, model: Model, id_column: str, text_column: str, keep: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """(id, score, kept columns[, text]) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights, whatever the input
    chosen = docs.select(id_column, text_column, *keep)
    fields = [docs.schema[c] for c in (id_column, *keep, *[text_column] * keep_text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            flat, offsets = byte_texts(batch.column(1))
            for lo, hi in runs(np.diff(offsets), CHUNK):
                s = model.scores(flat[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), *part.columns[2:], *[part.column(1)] * keep_text], names=[id_column, "score", *keep, *[text_column] * keep_text])

    return chosen.mapInArrow(run, ", ".join([f"`{fields[0].name}` {fields[0].dataType.simpleString()}", "score double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in fields[1:])]))
