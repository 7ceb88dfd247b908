"""Language-model scoring by context-tree weighting over bytes.

A text is modelled as its words, A-Z lower-cased, with one space between them and an end mark behind. A byte is
eight binary decisions; each decision has a tree of contexts of 0 to DEPTH preceding bytes. Nodes count zeros
and ones over all training texts; a node's Krichevsky-Trofimov estimate and the product of its children's
weighted probabilities are mixed half and half, recursively, so a prediction mixes the estimates of all depths.
Contexts that training never met leave their weight to the deepest one that it did.

How it is distributed: texts are first stored in numbered blocks of some BLOCK_BYTES. One pass over them gives each
block's distinct (DEPTH + 1)-byte grams and words with their training counts; these are added up over all blocks.
Grams that share their TOP latest context bytes (2**24 at most) meet in one task, which weights their subtree with
array operations; depth 2 (2**24 nodes at most) is mixed by distributed aggregation, depths 0 and 1 (65,280 nodes
at most) on the driver. Each block asks for the predictions and counts of the grams and words that it has, by two
joins, and its answers are written as a file of its own; a last pass reads each block with its answers. Grams and
words that make up at least 1/HEAVY of training (there can be no more than HEAVY of each) stand in most blocks, so
they are broadcast and not asked for. Nothing whose size grows with the data is broadcast, and the number of passes
over the texts doesn't depend on the model.

The base model is add-one smoothing over words.

Defined results: a null or empty text is one end mark; rows that repeat are scored, and learnt from, each; a null
id counts as held out; without training texts every byte costs 8 bits and base scores are 0; an empty table gives
no rows; a text longer than a block is a block of its own; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, byte_sizes, runs, scratch_path, ship, slices
from millrace.llm.storage import filesystem

#: Context bytes in all, and of them the latest ones whose subtrees are weighted in one task each.
DEPTH, TOP = 5, 3
END = b"\n"
#: Bytes of text whose grams and words are looked up together.
BLOCK_BYTES = 64 << 20
HEAVY = 1 << 20
#: Bytes of text that are turned into grams at once; grams that a task gathers before it passes counts on.
CHUNK, TABLE_GRAMS = 1 << 20, 4_000_000
#: Grams that are weighted at once, beside those of the last subtree.
STREAM = 1 << 19
LN10 = math.log(10)


def held_out(id_column: str, modulus: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == rest, F.lit(True))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z, and white space of ASCII


def grams(streams: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(gram of each byte, its text) of texts that end in END; the latest context byte is a gram's highest, the byte itself its lowest."""
    pad = END * depth
    body = np.frombuffer(pad + pad.join(streams), np.uint8).astype(np.uint64)
    sizes = np.array([len(x) for x in streams], np.int64)
    starts = np.cumsum(sizes + depth) - sizes
    place = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    key = body[place]
    for j in range(1, depth + 1):
        key |= body[place - j] << np.uint64(8 * (depth + 1 - j))
    return key, np.repeat(np.arange(len(streams)), sizes)


def run_lengths(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.empty(0, np.int64)
    return sorted_keys[first], np.diff(np.append(first, len(sorted_keys)))


def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series eight steps up, for x > 0."""
    y = x + 8
    shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7) if np.size(x) and np.max(x) < 1e30 else np.prod([x + i for i in range(8)], axis=0)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / y**2) / y**2) / y - np.log(shift)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return ln_gamma(n0 + 0.5) + ln_gamma(n1 + 0.5) - math.log(math.pi) - ln_gamma(n0 + n1 + 1.0)


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted probability, weight of the node's own estimate); below: sums of the children's, None at a leaf."""
    own = kt(n0, n1)
    if below is None:
        return own, np.ones(len(own))
    mixed = np.logaddexp(own, below) - math.log(2)
    return mixed, np.exp(own - math.log(2) - mixed)


def descend(n0: np.ndarray, n1: np.ndarray, weight: np.ndarray, mixed: np.ndarray, left: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One depth down. mixed, left, stop: the parents' part of P(1), unspent weight, and P(1) if the context ends there."""
    one = (n1 + 0.5) / (n0 + n1 + 1.0)
    met = n0 + n1 > 0
    return np.where(met, mixed + left * weight * one, mixed), np.where(met, left * (1 - weight), left), np.where(met, mixed + left * one, stop)


class Subtree:
    """The nodes of depths TOP to `depth` over some grams, for one of the eight decisions of a byte.

    keys: sorted and distinct, all grams that share their TOP highest bytes with one of them.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, level: int, depth: int = DEPTH):
        symbol = (keys & np.uint64(255)).astype(np.int64)
        prefix = np.uint64(1 << level) | (symbol >> (8 - level)).astype(np.uint64)
        self.bit = symbol >> (7 - level) & 1
        node = keys & ~np.uint64(255) | prefix  # sorted, as keys are
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        self.of_gram = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
        ones = np.add.reduceat(n * self.bit, first)
        self.layers = [(node[first], (np.add.reduceat(n, first) - ones).astype(float), ones.astype(float))]
        below = None
        self.weighted, weight = weigh(*self.layers[0][1:], below)
        self.weights, self.parents = [weight], []
        for d in range(depth - 1, TOP - 1, -1):
            ids, n0, n1 = self.layers[-1]
            drop = np.uint64(8 * (depth - d) + 8)
            up, parent = np.unique(ids >> drop << np.uint64(8) | ids & np.uint64(255), return_inverse=True)
            self.parents.append(parent)
            total = lambda x, parent=parent, up=up: np.bincount(parent, weights=x, minlength=len(up))
            self.layers.append((up << drop - np.uint64(8) & ~np.uint64(255) | up & np.uint64(255), total(n0), total(n1)))
            self.weighted, weight = weigh(*self.layers[-1][1:], total(self.weighted))
            self.weights.append(weight)

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram with the TOP bytes and the prefix, zeros, ones, ln weighted probability) of the nodes of depth TOP."""
        return (*self.layers[-1], self.weighted)

    def ln_probability(self, ids: np.ndarray, mixed: np.ndarray, left: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Per gram, ln of the probability of its decision; the arguments are what depth TOP - 1 leaves to the nodes of depth TOP, sorted by gram."""
        at = np.searchsorted(ids, self.layers[-1][0])
        state = mixed[at], left[at], stop[at]
        for i in range(len(self.layers) - 1, -1, -1):
            _, n0, n1 = self.layers[i]
            state = descend(n0, n1, self.weights[i], *state)
            if i:
                state = tuple(x[self.parents[i - 1]] for x in state)
        one = state[2][self.of_gram]
        return np.log(np.where(self.bit == 1, one, 1 - one))


def subtrees(batches: Iterator[pa.RecordBatch], most: int = STREAM) -> Iterator[list[np.ndarray]]:
    """The columns, the first being a sorted gram, in pieces that hold whole subtrees (at least one, and some `most` rows)."""
    waiting: list[list[np.ndarray]] = []
    for batch in batches:
        waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(x[0]) for x in waiting) >= most:
            whole = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            of = whole[0] >> 8 * (DEPTH + 1 - TOP)
            end = int(np.searchsorted(of, of[-1]))
            if end:
                yield [x[:end] for x in whole]
            waiting = [[x[end:] for x in whole]]
    if waiting and any(len(x[0]) for x in waiting):
        yield [np.concatenate(x) for x in zip(*waiting, strict=True)]


def merged(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run, equal keys' counts added up, of several sorted runs."""
    key, count = np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0, np.int64), *n])
    order = np.argsort(key, kind="stable")
    distinct, size = run_lengths(key[order])
    return distinct, np.add.reduceat(count[order], np.cumsum(size) - size) if len(distinct) else count


def blocks(rows: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with `block`, stored: consecutive rows of a task share a number until their texts reach block_bytes.

    Numbers are drawn anew in each attempt of a task; those of the attempt that is stored count. rows: ..., text.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = uuid.uuid4().int >> 65, 0
        for batch in batches:
            sizes = byte_sizes(batch.column(batch.num_columns - 1))
            number = np.empty(len(batch), np.int64)
            for i, n in enumerate(sizes.tolist()):
                if held and held + n > block_bytes:
                    block, held = uuid.uuid4().int >> 65, 0
                number[i] = block
                held += n
            yield pa.RecordBatch.from_arrays([pa.array(number), *batch.columns], names=["block", *batch.schema.names])

    return scratch.store(rows.mapInArrow(run, "block bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)), "blocks", "zstd")


def by_block(batches: Iterator[pa.RecordBatch], text_column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows of it), in pieces of about a megabyte."""
    for batch in (part for whole in batches for part in slices(whole, text_column)):
        number = batch.column(0).to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi > lo:
                yield int(number[lo]), batch.slice(lo, hi - lo)


def key_counts(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, gram, word, n), stored: a row per distinct gram, and per distinct word, of a block; n counts training only, so
    what only held-out texts have has 0. A block that is read in parts may have a key more than once. texts: as `blocks` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, keys, counts, learnt_words, other_words = None, [], [], Counter(), set()

        def rows() -> Iterator[pa.RecordBatch]:
            key, n = merged(keys, counts)
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(key.astype(np.int64)), pa.nulls(len(key), pa.string()), pa.array(n)], names=["block", "gram", "word", "n"])
            only = [w for w in other_words if w not in learnt_words]
            word, n = [*learnt_words, *only], [*learnt_words.values(), *[0] * len(only)]
            if word:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), block)), pa.nulls(len(word), pa.int64()), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["block", "gram", "word", "n"])
            keys.clear(), counts.clear(), learnt_words.clear(), other_words.clear()

        for number, part in by_block(batches, 2):
            if number != block:
                if block is not None:
                    yield from rows()
                block = number
            held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
            split = [words(x) for x in part.column(2).to_pylist()]
            for lo, hi in runs(np.array([sum(map(len, w)) + len(w) for w in split], np.int64), CHUNK):
                key, owner = grams([b" ".join(w) + END for w in split[lo:hi]])
                out = held[lo:hi][owner]
                for some, teach in ((key[~out], 1), (key[out], 0)):
                    distinct, n = run_lengths(np.sort(some))
                    keys.append(distinct)
                    counts.append(n * teach)
            for own, out in zip(split, held.tolist(), strict=True):
                own.append(END)
                other_words.update(own) if out else learnt_words.update(own)
            if sum(map(len, keys)) > TABLE_GRAMS:
                key, n = merged(keys, counts)
                keys[:], counts[:] = [key], [n]
                if len(key) > TABLE_GRAMS:  # a block of very many grams: in parts
                    yield from rows()
        if block is not None:
            yield from rows()

    return scratch.store(texts.select("block", "held_out", "text").mapInArrow(run, "block bigint, gram bigint, word string, n bigint"), "keys")


def model(counted: DataFrame, scratch: Scratch) -> DataFrame:
    """(gram, log10p), stored: the weighted prediction of every gram. counted: gram, n (0 where training lacks it)."""
    ship(counted.sparkSession)
    shift = 8 * (DEPTH + 1 - TOP)
    dealt = counted.select("gram", "n").repartition(F.shiftright("gram", shift)).sortWithinPartitions("gram")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, n in subtrees(batches):
            for level in range(8):
                node, *sums = Subtree(keys.astype(np.uint64), n, level).top()
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), *map(pa.array, sums)], names=["node", "n0", "n1", "ln"])

    third = scratch.store(dealt.mapInArrow(summarise, "node bigint, n0 double, n1 double, ln double"), "nodes")

    def level_up(nodes: DataFrame, depth: int) -> DataFrame:
        """Sums by the node one depth up, its bytes in the highest places."""
        gone = 8 * (DEPTH + 1 - depth)
        parent = F.shiftleft(F.shiftright("node", gone), gone).bitwiseOR(F.col("node").bitwiseAND(F.lit(255)))
        return nodes.groupBy(parent.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("ln").alias("below"))

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n0, n1, below = (c.to_numpy() for c in batch.columns)
            ln, own = weigh(n0, n1, below)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ln), pa.array(own)], names=["node", "n0", "n1", "ln", "own"])

    second = scratch.store(level_up(third, 2).mapInArrow(weighted, "node bigint, n0 double, n1 double, ln double, own double"), "nodes")
    tables = np.zeros((3, 256, 256))
    for r in level_up(second, 1).collect():  # at most 256 * 255 nodes
        tables[:, r["node"] >> 8 * DEPTH, r["node"] & 255] = r["n0"], r["n1"], r["below"]
    n0, n1, below = tables
    total, weight = weigh(n0.ravel(), n1.ravel(), below.ravel())
    r0, r1 = n0.sum(0), n1.sum(0)
    _, root = weigh(r0, r1, total.reshape(256, 256).sum(0))
    top = descend(r0, r1, root, np.zeros(256), np.ones(256), np.full(256, 0.5))
    tops = [np.broadcast_to(x, (256, 256)).ravel() for x in top]
    state = tuple(x.reshape(256, 256) for x in descend(n0.ravel(), n1.ravel(), weight, *tops))
    shared = counted.sparkSession.sparkContext.broadcast(state)  # three tables of 256 x 256

    def descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n0, n1, own = (c.to_numpy() for c in batch.columns)
            left = descend(n0, n1, own, *(x[node >> 8 * DEPTH, node & 255] for x in shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, left)], names=["parent", "mixed", "rest", "stop"])

    states = second.select("node", "n0", "n1", "own").mapInArrow(descended, "parent bigint, mixed double, rest double, stop double")
    gone = 8 * (DEPTH + 2 - TOP)
    parent = F.shiftleft(F.shiftright("node", gone), gone).bitwiseOR(F.col("node").bitwiseAND(F.lit(255)))
    given = third.select("node", parent.alias("parent")).join(states, "parent").select(F.col("node").alias("gram"), F.lit(None).cast("bigint").alias("n"), "mixed", "rest", "stop")
    nothing = [F.lit(None).cast("double").alias(x) for x in ("mixed", "rest", "stop")]
    both = given.union(counted.select("gram", "n", *nothing)).repartition(F.shiftright("gram", shift)).sortWithinPartitions(F.shiftright("gram", shift), F.col("n").isNotNull(), "gram")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n, *state in subtrees(batches):
            is_state = np.isnan(n.astype(np.float64))
            keys, counts = gram[~is_state].astype(np.uint64), n[~is_state].astype(np.int64)
            above = gram[is_state].astype(np.uint64), *(x[is_state] for x in state)
            if len(keys):
                total = sum(Subtree(keys, counts, level).ln_probability(*above) for level in range(8))
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array((total / LN10).astype(np.float32))], names=["gram", "log10p"])

    return scratch.store(both.mapInArrow(predict, "gram bigint, log10p float"), "predictions")


def text_scores(streams: list[bytes], keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values of each text's grams, all of which `keys` (sorted) must hold."""
    out = np.zeros(len(streams))
    for lo, hi in runs(np.array([len(x) for x in streams], np.int64), CHUNK):
        key, owner = grams(streams[lo:hi])
        both = np.sort(key << np.uint64(16) | owner.astype(np.uint64))  # a run has at most 2**14 texts
        gram, n = run_lengths(both >> np.uint64(16))
        at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        if not (len(keys) and (keys[at] == gram).all()):
            raise ValueError("a gram of a text has no prediction")
        out[lo:hi] += np.bincount((both & np.uint64(65535)).astype(np.int64), weights=np.repeat(values[at], n), minlength=hi - lo)
    return out


def answers(keys: DataFrame, predictions: DataFrame, counts: DataFrame, heavy_grams: DataFrame, heavy_words: DataFrame, path: str) -> None:
    """Writes, for each block, the predictions of its grams and the training counts of its words, but for the heavy ones
    (HEAVY rows at most each), as files in the folder `path`."""
    grams_asked = keys.filter("gram IS NOT NULL").select("block", "gram").join(F.broadcast(heavy_grams), "gram", "left_anti")
    words_asked = keys.filter("word IS NOT NULL").select("block", "word").join(F.broadcast(heavy_words), "word", "left_anti")
    of_grams = grams_asked.join(predictions, "gram").select("block", "gram", F.lit(None).cast("string").alias("word"), F.col("log10p").cast("double").alias("value"))
    of_words = words_asked.join(counts, "word").select("block", F.lit(None).cast("bigint").alias("gram"), "word", F.col("n").cast("double").alias("value"))
    of_grams.union(of_words).repartition("block").sortWithinPartitions("block", "gram").write.partitionBy("block").parquet(path)


def read_answers(folder: str, block: int) -> tuple[np.ndarray, np.ndarray, dict[bytes, float]]:
    """(grams, their log10 probabilities, log10(count + 1) of the words that training has) of a block, without heavy ones."""
    fs, path = filesystem(f"{folder}/block={block}")
    files = [x.path for x in fs.get_file_info(FileSelector(path, allow_not_found=True)) if x.base_name.endswith(".parquet")]
    if not files:
        return np.empty(0, np.uint64), np.empty(0), {}
    table = pa.concat_tables([pq.read_table(x, filesystem=fs, partitioning=None) for x in files]).combine_chunks()
    is_gram = table.column("gram").is_valid()
    some, rest = table.filter(is_gram), table.filter(table.column("word").is_valid())
    known = zip(rest.column("word").to_pylist(), np.log10(rest.column("value").to_numpy() + 1).tolist(), strict=True)
    return some.column("gram").to_numpy().astype(np.uint64), some.column("value").to_numpy(), {w.encode(): v for w, v in known}


def score(docs: DataFrame, id_column: str, text_column: str, held: Column, block_bytes: int = BLOCK_BYTES, heavy: int = HEAVY) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of docs.

    score: log10 of the text's probability; bits_per_byte: its code length over the bytes of the text as modelled.
    """
    spark, kind = docs.sparkSession, docs.schema[id_column].dataType.simpleString()
    ship(spark)
    kept, scratch = Scratch(spark), Scratch(spark)  # what the result reads, and what it takes to get there
    texts = blocks(docs.select(F.col(id_column).alias("id"), held.alias("held_out"), F.col(text_column).alias("text")), kept, block_bytes)
    keys = key_counts(texts, scratch)
    counts = scratch.store(keys.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    counted = scratch.store(keys.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    predictions = model(counted, scratch)
    all_grams = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # counts add up to the total, so there are `heavy` of them at most (n is not 0)
    heavy_grams, heavy_words = counted.filter((F.col("n") > 0) & (F.col("n") * heavy >= all_grams)), counts.filter(F.col("n") * heavy >= total)
    table, known = predictions.join(F.broadcast(heavy_grams.select("gram")), "gram").toArrow(), heavy_words.toArrow()
    common = dict(zip((w.encode() for w in known.column("word").to_pylist()), np.log10(known.column("n").to_numpy() + 1.0).tolist(), strict=True))
    shared = spark.sparkContext.broadcast((table.column("gram").to_numpy().astype(np.uint64), table.column("log10p").to_numpy().astype(np.float64), common))
    del table, known, common
    folder = scratch_path(spark, "answers")
    answers(keys, predictions, counts, heavy_grams.select("gram"), heavy_words.select("word"), folder)
    scratch.discard()
    run = _scored(folder, shared, id_column, total, math.log10(total + distinct + 1))
    return texts.select("block", "id", "held_out", "text").mapInArrow(run, f"`{id_column}` {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")


def _scored(folder: str, shared: Broadcast, id_column: str, train_tokens: int, unit: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [id_column, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for number, part in by_block(batches, 3):
            if number != block:
                block, (keys, values, known) = number, read_answers(folder, number)
                keys, values = np.concatenate([keys, shared.value[0]]), np.concatenate([values, shared.value[1]])
                order = np.argsort(keys, kind="stable")
                keys, values, common = keys[order], values[order], shared.value[2]
            split = [words(x) for x in part.column(3).to_pylist()]
            streams = [b" ".join(w) + END for w in split]
            scores = text_scores(streams, keys, values)
            n_tokens, n_known, base = [], [], []
            for own in split:
                own.append(END)
                found = [v for w in own if (v := common.get(w) or known.get(w))]
                n_tokens.append(len(own))
                n_known.append(len(found))
                base.append(math.fsum(found) - len(own) * unit)
            bits = -scores * math.log2(10) / np.array([len(x) for x in streams])
            n = len(part)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(n, train_tokens)), pa.array(base, pa.float64()), pa.array(scores), pa.array(bits)], names=names)

    return run
