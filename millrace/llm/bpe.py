"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct pre-tokens ("words") that a batch adds are laid end to end in one flat array of symbols.
A round looks up the rank of every adjacent pair by binary search over sorted pair keys, takes each
word's lowest rank and merges all its occurrences, from the left; words without a pair left drop out.
Words that were met before come from a bounded memo, so a batch costs merges only for new words.

Defined results: a null text is the empty text and has no ids; strings of special tokens inside a text
become those tokens' ids, as the tokenizers library does by default; a repeated row gives equal rows; texts of any
length are encoded whole, an empty table gives no rows, and other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import ragged, runs, ship, slices, texts

#: Fixed value: the pre-token pattern of the byte-level vocabulary; \s stands for Unicode White_Space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same pattern for texts of ASCII and Latin letters only, which the faster re module can express.
LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SIMPLE_WORDS = rf"'(?:s|t|re|ve|m|ll|d)| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r {LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
ODD = rf"[^\x00-\x7f{LATIN}]"
#: Words that the memo holds before it starts anew.
MEMO_WORDS = 200_000
NO_RANK = np.iinfo(np.int32).max


def byte_alphabet() -> list[str]:
    """The printable character that the vocabulary file uses for each of the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """Numbers words in the order in which they are first asked for; take() gives those added since."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def take(self) -> list[str]:
        new, self.new = self.new, []
        return new


class ByteBPE:
    """A byte-level BPE vocabulary from a tokenizers JSON file."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_alphabet()
        to_byte = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.byte_ranks = self._pair_ranks(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for word, i in vocab.items():
            spelled[i] = bytes(to_byte[c] for c in word) if all(c in to_byte for c in word) else word.encode()
        for word, i in self.special.items():
            spelled[i] = word.encode()
        self.token_bytes, self.token_at = _pool(spelled)
        self.decimal_bytes, self.decimal_at = _pool([b"%d," % i for i in range(size)])
        self.words, self.simple_words, self.odd = regex.compile(WORDS), re.compile(SIMPLE_WORDS), re.compile(ODD)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo_words = memo_words
        self._reset()

    def _reset(self) -> None:
        self.memo = Memo()
        self.pool, self.at, self.used, self.n_words = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0, 0
        for word in self.special:
            self.memo[word]
        self.memo.take()
        self._add(np.array([*self.special.values()], np.int32), np.ones(len(self.special), np.int64))

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Stores the ids of the memo's next words."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.n_words + len(counts) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[self.n_words + 1 : self.n_words + 1 + len(counts)] = self.used + np.cumsum(counts)
        self.used, self.n_words = self.used + len(ids), self.n_words + len(counts)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        spot = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[spot] == pair, self.ranks[spot], NO_RANK)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each has."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(x) for x in words], np.int64)
        symbols, owner = self.byte_ids[flat], np.repeat(np.arange(len(words), dtype=np.int32), size)
        rank = np.append(self.byte_ranks[flat[:-1], flat[1:]], NO_RANK)  # of each symbol with its successor
        last = np.cumsum(size) - 1
        rank[last] = NO_RANK
        done_ids, done_owner = [], []
        while len(symbols):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            size = np.diff(np.append(first, len(symbols)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), size)
            keep = lowest != NO_RANK
            if not keep.all():
                done_ids.append(symbols[~keep])
                done_owner.append(owner[~keep])
            # a run of overlapping places (aaa) merges every second one
            place = np.flatnonzero(keep & (rank == lowest))
            start = np.flatnonzero(np.diff(place, prepend=-2) != 1)
            nth = np.arange(len(place)) - np.repeat(start, np.diff(np.append(start, len(place))))
            place = place[nth & 1 == 0]
            symbols[place] = self.merged[rank[place]]
            rank[place] = rank[place + 1]  # NO_RANK if the word ends there; else looked up below
            keep[place + 1] = False
            moved = np.cumsum(keep) - 1
            place = moved[place]
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            again = place[np.append(owner, -1)[place + 1] == owner[place]]
            before = place[place > 0] - 1
            again = np.concatenate([again, before[owner[before] == owner[before + 1]]])
            rank[again] = self._pair_ranks(symbols[again], symbols[again + 1])
        ids, owners = np.concatenate([np.empty(0, np.int32), *done_ids]), np.concatenate([np.empty(0, np.int32), *done_owner])
        order = np.argsort(owners, kind="stable")  # a word's ids left the rounds together, in order
        return ids[order], np.bincount(owners, minlength=len(words))

    def _split(self, text: str) -> list[str]:
        if self.splits is None or not any(x in text for x in self.special):
            return (self.words if self.odd.search(text) else self.simple_words).findall(text)
        out: list[str] = []
        for i, part in enumerate(self.splits.split(text)):
            out += [part] if i % 2 else self.words.findall(part)
        return out

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        if self.n_words > self.memo_words:
            self._reset()
        split = [self._split(x) for x in batch]
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        index = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(split)), np.int64, int(per_text.sum()))
        new = self.memo.take()
        for lo, hi in runs(np.fromiter(map(len, new), np.int64, len(new)), 1 << 19, 1 << 17):
            self._add(*self.merge_words([w.encode("utf-8", "replace") for w in new[lo:hi]]))
        starts, counts = self.at[index], self.at[index + 1] - self.at[index]
        ids = self.pool[ragged(starts, counts)]
        bounds = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each range of ids; bytes that are no UTF-8 become U+FFFD."""
        return [x.decode("utf-8", "replace") for x in _spell(ids, counts, self.token_bytes, self.token_at)]

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The decimal ids of each range, joined by commas."""
        return [x[:-1] for x in _spell(ids, counts, self.decimal_bytes, self.decimal_at)]


def _pool(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64)
    return np.frombuffer(b"".join(items), np.uint8), at


def _spell(ids: np.ndarray, counts: np.ndarray, pool: np.ndarray, at: np.ndarray) -> list[bytes]:
    starts, lengths = at[ids], at[ids + 1] - at[ids]
    flat = pool[ragged(starts, lengths)].tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    """One vocabulary a worker process, with its memo."""
    return ByteBPE(path)


def encoded(values: list[str], bpe: ByteBPE, chunk_chars: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids, counts) of bounded runs of rows."""
    for lo, hi in runs(np.array([len(x) for x in values], np.int64), chunk_chars):
        yield lo, hi, *bpe.encode(values[lo:hi])


def encode_column(df: DataFrame, id_column: str, text_column: str, path: str) -> DataFrame:
    """(id_column, ids array<int>) of every row of df."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            for lo, hi, ids, counts in encoded(texts(batch.column(1)), bpe):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=[id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def decode_column(df: DataFrame, id_column: str, ids_column: str, path: str) -> DataFrame:
    """(id_column, text) of every row's ids; null ids are no ids."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            lists = batch.column(1)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.asarray(lists.flatten(), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bpe.decode(ids, counts), pa.string())], names=[id_column, "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, text string")


def round_trip_column(df: DataFrame, id_column: str, text_column: str, path: str) -> DataFrame:
    """(id_column, ids array<int>, decoded_sha256, lossless) of every row: the ids, and whether what they decode to is the text."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            values = texts(batch.column(1))
            for lo, hi, ids, counts in encoded(values, bpe):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                back = bpe.decode(ids, counts)
                sha = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in back]
                same = [x == y for x, y in zip(back, values[lo:hi], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=[id_column, "ids", "decoded_sha256", "lossless"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, decoded_sha256 string, lossless boolean")


def digest_column(df: DataFrame, id_column: str, text_column: str, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from the ids."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            for lo, hi, ids, counts in encoded(texts(batch.column(1)), bpe):
                sha = [hashlib.sha256(x).hexdigest() for x in bpe.decimals(ids, counts)]
                back = [hashlib.sha256(x.encode("utf-8")).hexdigest() for x in bpe.decode(ids, counts)]
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(sha), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
