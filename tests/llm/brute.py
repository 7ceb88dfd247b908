"""Plain forms of the text operators, for comparison on small tables."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

from millrace.llm.queries import byte_bpe_path


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def simhash(text):
    words = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_duplicates(docs):
    fps = [simhash(t) for _, t in docs]
    of = groups(sorted(set(fps)), lambda a, b: (a ^ b).bit_count() <= 3)
    out = []
    for (doc_id, _), fp in zip(docs, fps, strict=True):
        ids = [d for (d, _), f in zip(docs, fps, strict=True) if of[f] == of[fp] and d is not None]
        out.append((doc_id, f"{fp:016x}", min(ids, default=None)))
    return out


def tokens(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


def contaminated(docs, items, n=10):
    wins = {}
    for item, text in items:
        w = tokens(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = tokens(text), set(), set()
        for size in {len(k) for k in wins}:
            for i in range(len(w) - size + 1):
                if own := wins.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= own
        close = set()
        for k, own in wins.items():
            places = [i for i, x in enumerate(w) if x == k[0]]  # a stretch with all of its words has its first
            if any(set(k) <= set(w[s : s + 2 * len(k)]) for p in places for s in range(max(0, p - 2 * len(k) + 1), p + 1)):
                close |= own
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(close)))
    return out


def warc(pages):
    sha = lambda x: base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()
    first = {}
    for page_id, html in pages:
        if page_id is not None:
            first[sha(html)] = max(first.get(sha(html), page_id), page_id)
    rows = []
    for page_id, html in pages:
        to = first.get(sha(html))
        alone = to is None or to == page_id
        rows.append((page_id, len((html or "").encode()), sha(html), "response" if alone else "revisit", None if alone else to))
    return rows


def chat(turns, controls):
    """The rows of conversations, by turn (none first), role and text, and of the marked one."""
    said = "</s>[INST] ok [/INST]"
    rows = [(c, t, r or "", x or "") for c, t, r, x in turns] + [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    held = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in controls))
    out = []
    for conv in {c for c, *_ in rows}:
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        size = sum(len("<|im_start|>") + len("<|im_end|>") + 2 + len(r) + len(x) + len(held.findall(x)) for _, _, r, x in own)
        out.append((conv, len(own), sha("".join(f"{r}\n{x}\n" for _, _, r, x in own)), len(loss), sha(loss), size))
    return out


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe_path())
    t.no_padding()
    t.no_truncation()
    return t


def bpe(docs):
    t, out = tokenizer(), []
    for doc_id, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def packed(docs):
    t, at, out = tokenizer(), 0, []
    mark = lambda t: 42 if t is None else (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)
    for doc_id, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, mark(x[1]), (x[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def language(docs):
    """(id, held_out, n_tokens, n_known, train_tokens, base_score)"""
    cut = lambda t: [*re.findall("[^\x20\x09-\x0d]+", lower(t)), "\n"]
    held = lambda d: d is None or crc(d) % 7 == 2
    c = Counter(w for d, t in docs if not held(d) for w in cut(t))
    total = sum(c.values())
    return [(d, held(d), len(cut(t)), sum(c[w] > 0 for w in cut(t)), total, sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in cut(t))) for d, t in docs]


def license_base(docs):
    out = []
    for doc_id, text in docs:
        w = tokens(text)
        found = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in found]
        out.append((doc_id, len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return out
