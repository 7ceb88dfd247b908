"""License scans against plain edit distances."""

import random

import pytest

from millrace.llm import licenses


def test_fuzzy_notices():
    n = licenses.notice("licensed under the apache license version 2 0", "apache")
    rng = random.Random(3)
    for _ in range(60):
        text = bytearray(n.text)
        for _ in range(rng.randint(0, n.edits)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice([b"", b"q", b"z"])
        body = b" foo bar " + bytes(text) + b" baz "
        hits = licenses.fuzzy(body, n)
        assert hits and hits[0][2] <= n.edits
    assert licenses.fuzzy(b" licensed under something else entirely ", n) == []


def test_notices_at_their_bound_of_edits():
    rng = random.Random(6)
    for n in licenses.notices():
        assert n.edits == len(n.text) // 15
        for extra in (0, 1):
            for _ in range(4):
                text = bytearray(n.text)
                for at in rng.sample(range(len(text)), n.edits + extra):
                    text[at] = ord("#")
                hits = licenses.fuzzy(b" foo bar " + bytes(text) + b" baz ", n)
                assert [x[2] for x in hits] == ([] if extra else [n.edits])
    for edits, text in ((5, "this source code is subject to the terms of the mozilla public license"), (6, "redistribution and use in source or binary forms with or without modification is permitted")):
        assert [x[2] for n in licenses.notices() for x in licenses.fuzzy(licenses.normal_form(text), n)] == [edits]


def test_license_spans(spark):
    df = spark.createDataFrame([(1, "Intro. Licenced under the Apache Licence, Version 2.0! Tail"), (2, "clean")], "id bigint, text string")
    got = {r["id"]: r for r in licenses.scan(df, "id", "text").collect()}
    assert got[1]["labels"] == "apache" and got[1]["base_labels"] == "" and got[1]["n_base"] == 0
    assert (got[1]["spans"][0]["first_word"], got[1]["spans"][0]["last_word"], got[1]["spans"][0]["edits"]) == (1, 8, 2)
    assert got[2]["score"] == 0 and got[2]["labels"] == ""


def test_a_better_notice_behind_a_worse_one_hides_no_span():
    n = licenses.notice("released under the mit license", "mit")
    body = licenses.normal_form("relaesed under the mit license released under the mit license releasd under the mit license")
    assert [x[2] for x in licenses.fuzzy(body, n)] == [2, 0, 1]
    assert licenses.word_numbers(body, [x[0] for x in licenses.fuzzy(body, n)]) == [0, 5, 10]


def test_word_numbers_of_many_places():
    body = licenses.normal_form(" ".join(random.Random(2).choice(("mit license", "a", "bcd")) for _ in range(300)))
    at = licenses.places(body, b"mit license")
    assert licenses.word_numbers(body, at) == [len(body[1:x].split()) for x in at] and licenses.word_numbers(body, []) == []


def distance(a, b):
    """Levenshtein distance of two byte strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def ends(body, notice, most):
    """Where substrings within `most` edits of the notice end."""
    row, out = list(range(len(notice) + 1)), []
    for at, x in enumerate(body, 1):
        last, row = row, [0]
        for j, y in enumerate(notice, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if row[-1] <= most:
            out.append(at)
    return out


@pytest.mark.parametrize("n", [n for n in licenses.notices() if len(n.text) < 80], ids=lambda n: n.text.decode()[:30])
def test_fuzzy_search_equals_plain_edit_distances(n):
    rng = random.Random(len(n.text))
    for _ in range(25):
        body = bytearray(b" ")
        for _ in range(rng.randint(1, 3)):
            text = bytearray(n.text)
            for _ in range(rng.randint(0, n.edits + 3)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 2)] = rng.choice([b"", b"q", b"e", b" "])
            body += text + rng.choice([b" ", b" some words between ", b" " + n.text[:20] + b" "])
        body, want = bytes(body), ends(body, n.text, n.edits)
        hits = licenses.fuzzy(body, n)
        assert bool(hits) == bool(want)
        for start, end, edits in hits:
            assert distance(body[start:end], n.text) == edits <= n.edits
        # each place where an occurrence ends belongs to a hit that it overlaps
        assert all(any(start < at and end > at - len(n.text) - n.edits for start, end, _ in hits) for at in want)


def test_terms_are_told_apart(spark):
    texts = {f"Text. Licensed under CC {x} 4.0. More": f"cc-{x.lower()}" for x in ("BY", "BY-ND", "BY-SA", "BY-NC", "BY-NC-SA", "BY-NC-ND")}
    texts |= {f"This work is licenced under a Creative Commons {x} 4.0 International License": y for x, y in (
        ("Attribution", "cc-by"), ("Attribution-NoDerivatives", "cc-by-nd"), ("Attribution-ShareAlike", "cc-by-sa"), ("Attribution-NonCommercial", "cc-by-nc"),
        ("Attribution Non-Commercial Share Alike", "cc-by-nc-sa"),
    )}
    texts |= {"Licensed under CC BX 4.0": "", "licensed under cc0": "", "Released under the BIT license": "", "Relased under the MIT Licence": "mit", "under the GNU Lesser General Public License": "gpl,lgpl", "the gnu lessor general public licence": ""}
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: r["labels"] for r in licenses.scan(df, "id", "text").collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == texts
