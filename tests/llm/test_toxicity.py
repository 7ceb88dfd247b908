"""The classifier against a plain form of the same model."""

import random
import re

import brute
import numpy as np
import pytest

from millrace.llm import toxicity


def grams(text, orders=toxicity.ORDERS):
    """The n-grams of a text, as bytes."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or ("\u00c0" <= c <= "\u00de" and c != "\u00d7") else c for c in text or "")
    words = re.findall(rb"[0-9a-z\x80-\xff]+", low.encode())
    body = b" " + b" ".join(words) + b" " if words else b""
    return {body[i : i + n] for n in orders for i in range(len(body) - n + 1)}


def plain(docs, labels, cost):
    """Scores of all docs by the primal problem over unhashed n-grams, by Newton steps."""
    text = dict(docs)
    teach = [(text[d], t) for d, t in labels if d in text and t in (0, 1) and brute.crc(d) % 5]
    y = np.array([2.0 * t - 1 for _, t in teach])
    own = [grams(t) for t, _ in teach]
    every = sorted(set().union(*own))
    have = np.array([[g in o for g in every] for o in own], float)
    n1, n0 = have[y > 0].sum(0), have[y < 0].sum(0)
    ratio = np.log((n1 + 1) / ((y > 0).sum() + 2)) - np.log((n0 + 1) / ((y < 0).sum() + 2))
    x = have * ratio
    unit = 1 / np.sqrt((x**2).sum(1).mean())
    z = np.hstack([x * unit, np.ones((len(y), 1))])
    value = lambda w: w @ w / 2 + cost * (np.maximum(0, 1 - y * (z @ w)) ** 2).sum()
    w = np.zeros(z.shape[1])
    for _ in range(60):
        slack = np.maximum(0, 1 - y * (z @ w))
        inside = z[slack > 0]
        step = np.linalg.solve(np.eye(len(w)) + 2 * cost * inside.T @ inside, w - 2 * cost * z.T @ (y * slack))
        size = 1.0
        while value(w - size * step) > value(w) and size > 1e-9:
            size /= 2
        w = w - size * step
    weight = dict(zip(every, w[:-1] * ratio * unit, strict=True))
    return {d: 1 / (1 + np.exp(-(w[-1] + sum(weight.get(g, 0.0) for g in grams(t))))) for d, t in docs}


def fixture():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeidnrst\u00e9") for _ in range(rng.randint(2, 6)))
    docs = [(i, " ".join([word() for _ in range(rng.randint(1, 5))] + ["Zoggle!"] * (i % 3 == 0) + ["R\u00c9CHT"] * (i % 4 == 0))) for i in range(36)]
    return docs + [(100, ""), (101, None), (102, "zoggle"), (103, "r\u00e9cht \u65e5\u672c")], [(i, int(i % 3 == 0)) for i in range(36)] + [(5, None), (900, 1)]


def test_scores_equal_the_plain_form(spark):
    docs, labels = fixture()
    df, known = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    # labels without a text count in the classes' shares: leave them out here, so that all rows weigh the same
    model = toxicity.fit(df, known.filter("doc_id < 900"), "doc_id", "text", "toxic", selected=None, least_frequency=1, bits=22, rounds=5000, tolerance=1e-9)
    want = plain(docs, labels, toxicity.COST)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model, "doc_id", "text").collect()}
    assert got == pytest.approx(want, abs=1e-4) and got[102] > 0.5 > got[103]


def test_ratios_scale_the_features():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(40, 9, replace=False)) for _ in range(80)]
    label = np.array([int(0 in r or 1 in r or i % 9 == 0) for i, r in enumerate(rows)])
    n1, n0 = (np.bincount(np.concatenate([r for r, t in zip(rows, label, strict=True) if t == c]), minlength=40) for c in (1, 0))
    ratio = toxicity.log_ratios(n0, n1, int((label == 0).sum()), int(label.sum()))
    cost = np.full(80, 0.02)
    effect = lambda r: toxicity.solve(rows, label, r, cost, 2000, 1e-9)[0] * r
    fitted, flat = effect(ratio), effect(np.ones(40))
    assert np.corrcoef(fitted, flat)[0, 1] < 0.95
    louder = ratio.copy()
    louder[0] *= 4  # a feature whose ratio grows takes more of the weight
    assert effect(louder)[0] > 1.3 * fitted[0] > 0
    assert np.allclose(effect(ratio * 5), fitted)  # one unit for all ratios changes nothing


def test_selection_can_be_lifted(spark):
    docs, labels = fixture()
    df, known = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    few = toxicity.fit(df, known, "doc_id", "text", "toxic", selected=10, least_frequency=2)
    many = toxicity.fit(df, known, "doc_id", "text", "toxic", selected=None, least_frequency=1)
    seen = set().union(*(grams(t) for d, t in docs if d < 36 and brute.crc(d) % 5))
    assert (few.weights != 0).sum() <= 10 < 200 < (many.weights != 0).sum() <= len(seen)


def test_no_text_for_any_label(spark):
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(40)], "doc_id bigint, toxic int")
    df = spark.createDataFrame([(900, "a text")], "doc_id bigint, text string")
    assert toxicity.score(df, toxicity.fit(df, labels, "doc_id", "text", "toxic"), "doc_id", "text").first()["score"] < 0.5
