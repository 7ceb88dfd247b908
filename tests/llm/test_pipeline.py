"""The whole pipeline against plain forms of its stages, each over what the plain form before it kept."""

import brute
import xxhash
from conftest import ITEMS

from millrace.llm import toxicity
from millrace.llm.common import table


def mark(text):
    return 42 if text is None else (xxhash.xxh64_intdigest(text.encode(), 42) + (1 << 63)) % (1 << 64) - (1 << 63)


def unlike(rows):
    """One row of each group of linked fingerprints: smallest id, none last, then smallest text hash."""
    prints = [brute.simhash(t) for _, t in rows]
    of = brute.groups(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    best = {}
    for (doc_id, text), p in zip(rows, prints, strict=True):
        rank = (doc_id is None, doc_id or 0, mark(text))
        best[of[p]] = min(best.get(of[p], (rank, doc_id, text)), (rank, doc_id, text), key=lambda x: x[0])
    return [(d, t) for _, d, t in best.values()]


def test_rows_of_the_pipeline(spark, folder, docs):
    import corpus_pipeline

    documents = table(spark, folder, "documents")
    # the scores themselves are held against a plain form in test_toxicity
    model = toxicity.fit(documents, table(spark, folder, "labels"), "doc_id", "text", "toxic")
    scored = toxicity.score(documents, model, "doc_id", "text", keep_text=True).collect()
    clean = [(r["doc_id"], r["text"]) for r in scored if r["score"] < 0.5]
    assert len(scored) == len(docs) and 0 < len(clean) < len(docs)
    kept = unlike(clean)
    assert len(kept) < len(clean)
    plain = [d for d, r in zip(kept, brute.contaminated(kept, ITEMS), strict=True) if not r[5]]
    assert len(plain) < len(kept)
    want = sorted(((d, n, sha) for d, n, _, sha in brute.bpe(plain)), key=repr)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(((r["doc_id"], len(r["ids"]), r["decoded_sha256"]) for r in got), key=repr) == want
    assert all(r["lossless"] for r in got)


def test_stages_return_the_columns_of_documents(spark, folder):
    import corpus_pipeline

    documents = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert tuple(stage(spark, documents, folder).columns) == corpus_pipeline.COLUMNS, name
