"""The registered queries against plain forms, on tables with every odd case, and on empty tables."""

import brute
import pytest

from millrace.llm.queries import queries

Q = queries()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def same(df, want, *columns):
    assert rows(df, *columns) == sorted(want, key=repr)


def test_near_duplicates(spark, folder, docs):
    same(Q["op1_simhash_dedup"](spark, folder), brute.near_duplicates(docs), "doc_id", "fingerprint", "component_id")


def test_decontamination(spark, folder, docs):
    from conftest import ITEMS

    same(Q["op2_decontaminate"](spark, folder), brute.contaminated(docs, ITEMS), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near")


def test_warc(spark, folder):
    from conftest import PAGES

    same(Q["op3_warc"](spark, folder), brute.warc([(p, h) for p, _, h in PAGES]), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_conversations(spark, folder):
    from conftest import TURNS

    from millrace.llm.chat import CONTROLS

    same(Q["op4_chat_format"](spark, folder), brute.chat(TURNS, CONTROLS), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def test_bpe(spark, folder, docs):
    same(Q["op6_bpe"](spark, folder), brute.bpe(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_base_scores(spark, folder, docs):
    got = rows(Q["op7_ctw_score"](spark, folder), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    want = sorted(brute.language(docs), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(abs(a[5] - b[5]) < 1e-6 for a, b in zip(got, want, strict=True))
    assert all(x[6] < 0 for x in got)


def test_packed_ids(spark, folder, docs):
    same(Q["op8_token_ids"](spark, folder), brute.packed(docs), "doc_id", "start", "n_tokens", "ids_crc32")


def test_licenses(spark, folder, docs):
    df = Q["op9_license_scan"](spark, folder)
    same(df, brute.license_base(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    for r in df.collect():
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_toxicity_rows(spark, folder, docs):
    got = Q["op10_toxicity"](spark, folder).collect()
    assert sorted(repr(r["doc_id"]) for r in got) == sorted(repr(d) for d, _ in docs)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is None or brute.crc(r["doc_id"]) % 5 == 0)


def test_audio_payloads(spark, folder, docs):
    import hashlib
    import zlib

    def want(doc_id, text):
        raw = (text or "").encode()
        body = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        return doc_id, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:])

    df = Q["op5_audio_features"](spark, folder).cache()
    same(df, [want(*d) for d in docs], "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    per_text = df.select("payload_sha256", "media_sha256", "feature").distinct()
    assert per_text.count() == df.select("payload_sha256").distinct().count()


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_tables(spark, empty, name):
    got = Q[name](spark, empty).collect()
    assert [r["conv_id"] for r in got] == [-7] if name == "op4_chat_format" else got == []
