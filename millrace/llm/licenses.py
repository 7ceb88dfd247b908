"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice that may carry k edits is cut into k + 1 pieces; by the pigeonhole principle every occurrence within
k edits keeps a piece whole, at most k characters from its place. The pieces are found exactly in each text's
normal form (A-Z lower-cased words, one space between), a bit-parallel edit distance leaves of each candidate
window the ranges that hold an occurrence, and the regex library's bounded-error matching, whose cost grows fast
with the edits, gives their spans and edits. Edits may not fall on the words that tell licenses apart: a match whose
span lacks one of the notice's exact words is none, and terms of the Creative Commons family are read, exactly, from
the words behind the match.

Defined results: a null or wordless text has no words, places or labels and the score 0; nothing depends on a
text's length or on other rows, so repeated rows have equal results; texts are taken whole, one at a time; spans are
in words of the text, counted from 0; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import ship, slices

#: Phrases whose exact places are counted, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Openings of public licenses' short notices, with their labels and the words that must stand in them unedited.
NOTICES = (
    ("released under the mit license", "mit", ("mit",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", ()),
    ("licensed under the apache license version 2 0", "apache", ("apache",)),
    ("this work is licensed under the gnu general public license version", "gpl", ("gnu", "general")),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", ("gnu", "general")),
    ("gnu lesser general public license", "lgpl", ("lesser",)),
    ("licensed under cc by", "cc-by", ("cc", "by")),
    ("this work is licensed under a creative commons attribution", "cc-by", ("creative", "commons", "attribution")),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ()),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", ()),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", ("mozilla",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("unencumbered",)),
)
#: Words (or two words as one) that may follow a notice of the label, and what they add to it.
TERMS = {"cc-by": {"nc": "-nc", "noncommercial": "-nc", "nd": "-nd", "noderivatives": "-nd", "noderivs": "-nd", "sa": "-sa", "sharealike": "-sa"}}
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 15
#: Every byte of UTF-8 that is in no word, after lower-casing.
_BREAKS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    edits: int
    seeds: tuple[tuple[bytes, int], ...]  # piece, its place in the notice
    pattern: regex.Pattern
    bits: dict[int, int]  # a byte's places in the notice, as a mask
    exact: frozenset[bytes] = frozenset()


def notice(text: str, label: str, exact: tuple[str, ...] = (), chars_per_edit: int = CHARS_PER_EDIT) -> Notice:
    raw = text.encode()
    k = len(raw) // chars_per_edit
    cuts = [len(raw) * i // (k + 1) for i in range(k + 2)]
    seeds = tuple((raw[a:b], a) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    return Notice(raw, label, k, seeds, regex.compile(rb"(?e)(?:" + regex.escape(raw, literal_spaces=True) + rb"){e<=%d}" % k), {c: sum(1 << i for i, x in enumerate(raw) if x == c) for c in set(raw)}, frozenset(x.encode() for x in exact))


@lru_cache(maxsize=4)
def notices(table: tuple[tuple[str, str, tuple[str, ...]], ...] = NOTICES) -> tuple[Notice, ...]:
    return tuple(notice(*x) for x in table)


def normal_form(text: str | None) -> bytes:
    """The words, A-Z lower-cased, with a space before and after each."""
    return b" " + b" ".join((text or "").encode("utf-8", "replace").lower().translate(_BREAKS).split()) + b" "


def places(body: bytes, phrase: bytes) -> list[int]:
    """Where the phrase's words stand consecutively, as offsets of the space before it; places may overlap."""
    found, needle, at = [], b" " + phrase + b" ", -1
    while (at := body.find(needle, at + 1)) >= 0:
        found.append(at)
    return found


def word_numbers(body: bytes, offsets: list[int]) -> list[int]:
    """The word of a normal form that stands at, or begins behind, each offset; one pass over the text for all of them."""
    if not offsets:
        return []
    spaces = np.flatnonzero(np.frombuffer(body, np.uint8)[1:] == 32) + 1
    return np.searchsorted(spaces, offsets, side="right").tolist()


def windows(body: bytes, n: Notice) -> list[tuple[int, int]]:
    """Disjoint ranges that hold all occurrences within the edits: around each seed, merged where they touch."""
    spans = []
    for seed, place in n.seeds:
        at = -1
        while (at := body.find(seed, at + 1)) >= 0:
            spans.append((max(0, at - place - n.edits), min(len(body), at - place + len(n.text) + n.edits)))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def near(body: bytes, n: Notice, a: int, b: int) -> list[tuple[int, int]]:
    """Disjoint ranges of [a, b) that hold all occurrences within the edits there: none if there is none (Myers)."""
    size = len(n.text)
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, edits = full, 0, size
    out: list[tuple[int, int]] = []
    for at in range(a, b):
        same = n.bits.get(body[at], 0)
        v, h = same | down, (((same & up) + up) ^ up) | same
        more, less = down | (~(h | up) & full), up & h
        edits += bool(more & top) - bool(less & top)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | (~(v | more) & full), more & v
        if edits <= n.edits:
            start = max(a, at + 1 - size - n.edits)
            while out and start <= out[-1][1]:
                start = min(start, out.pop()[0])
            out.append((start, at + 1))
    return out


def fuzzy(body: bytes, n: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice's occurrences in a normal form."""
    out = []
    for a, b in (part for window in windows(body, n) for part in near(body, n, *window)):
        for m in n.pattern.finditer(body, a, b):
            out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
    return out


def label_of(body: bytes, n: Notice, start: int, end: int) -> str | None:
    """The label of a match: None if its span, out to whole words, lacks an exact word; with the terms that follow it."""
    start, end = body.rfind(b" ", 0, start + 1), body.find(b" ", end - 1)
    if not n.exact <= set(body[start:end].split()):
        return None
    label, terms = n.label, TERMS.get(n.label, {})
    behind = [x.decode("utf-8", "replace") for x in body[end : end + 80].split()] if terms else []
    while behind:
        take = next((k for k in (1, 2) if "".join(behind[:k]) in terms), 0)
        if not take:
            break
        label, behind = label + terms["".join(behind[:take])], behind[take:]
    return label


def scan(df: DataFrame, id_column: str, text_column: str, phrases: tuple[tuple[str, str], ...] = PHRASES, table: tuple[tuple[str, str, tuple[str, ...]], ...] = NOTICES) -> DataFrame:
    """A row per row of df: words, exact places, labels, the best match's score, and every notice's span and edits."""
    ship(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()
    span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))

    def one(text: str | None) -> tuple:
        body = normal_form(text)
        base = [(at, label) for phrase, label in phrases for at in places(body, phrase.encode())]
        found = [(start, end, edits, n, label) for n in notices(table) for start, end, edits in fuzzy(body, n) if (label := label_of(body, n, start, end)) is not None]
        best = max([1 - edits / len(n.text) for _, _, edits, n, _ in found] + [1.0 if base else 0.0])
        firsts, lasts = word_numbers(body, [x[0] for x in found]), word_numbers(body, [x[1] - 1 for x in found])
        spans = [{"label": label, "first_word": a, "last_word": b, "edits": edits} for a, b, (_, _, edits, _, label) in zip(firsts, lasts, found, strict=True)]
        base_labels = sorted({x for _, x in base})
        starts = word_numbers(body, [x for x, _ in base])
        labels = sorted({*base_labels, *(x["label"] for x in spans)})
        return body.count(b" ") - 1 if len(body) > 2 else 0, len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), best, spans

    names = [id_column, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            rows = [one(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label: string, first_word: bigint, last_word: bigint, edits: int>>")
