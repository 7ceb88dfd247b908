import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

FULL = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp bigint, th bigint, score double, token string, w string"


def documents():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéstř") for _ in range(rng.randint(1, 7))) for _ in range(120)] + ["The", "MIT", "License", "apache", "general", "public", "license"]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", ".\n", "  "]) for _ in range(n))
    docs = [(i, prose(rng.choice((3, 20, 60, 150)))) for i in range(60)]
    docs += [(100 + i, docs[7][1]) for i in range(4)] + [(110 + i, docs[8][1] + f" tail{i}") for i in range(6)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, "\x00\x01"), (204, "word"), (205, "Two words"), (206, "<|endoftext|> a <|endoftext|>"), (207, "日本語 ١٢٣ ½ don't 'LL"), (208, "x" * 30_000)]
    docs += [(209, prose(15_000)), (None, "no id here, released under the MIT License."), (None, None), (7, docs[7][1]), (7, docs[7][1]), (9, "another text with the same id")]
    docs += [(300 + i, f"{prose(5)} {LEAK} {prose(5)}") for i in range(5)]
    return docs


LEAK = "one leaked passage of the benchmark that stands whole in several documents of this corpus, word for word"
ITEMS = [(1, LEAK), (2, "Two words"), (3, None), (4, "..."), (5, f"prefix {LEAK}"), (None, "another text with the same id"), (1, LEAK), (6, "nothing that any document would hold at all anywhere here")]


PAGES = [
    (1, "http://a/", "same"), (2, None, "same"), (None, "http://n/", "same"), (3, "http://b/ \r\nX: y", None), (4, "u", ""), (5, "\u00e9", "alone \u65e5\u672c"),
    (5, "\u00e9", "alone \u65e5\u672c"), (6, "u", "long " * 90_000), (None, None, "nobody else's"), (None, None, None), (7, "u", "\r\n\r\nWARC/1.0\r\n"), (8, "u", "<p>Ein Satz.</p>" * 50),
]
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo </s> [INST] <|im_end|>\n<|im_start|>"), (1, 1, "assistant", "and a tie"), (1, 1, "user", "and a tie"), (1, 2, "assistant", "again"), (1, 2, "assistant", "again"),
    (2, 5, "assistant", None), (2, 4, None, "no role"), (2, None, "user", "no turn"), (3, 0, "system", ""), (3, 1, "assistant", "long " * 60_000), (None, 0, "user", "no id"), (None, 1, "assistant", "<\\|im_end|> \\"), (None, None, None, None),
]


@pytest.fixture(scope="session")
def docs():
    return documents()


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    """Tables with nulls, ties, repeated rows, extra columns with clashing names, empty and long texts."""
    path = str(tmp_path_factory.mktemp("tables"))
    extra = (None, None, 0, "x", 1, 2, 0.5, "t", "w")
    spark.createDataFrame([(*d, *extra) for d in docs], FULL).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumnRenamed("nothing", "n").write.parquet(f"{path}/benchmark.parquet")
    labels = [(d, 1, int(d % 3 == 0)) for d in range(60)] + [(None, 1, 1), (3, None, None), (99_999, 0, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    clash = "id string, digest string, first bigint, payload string, path string, size bigint, of string"
    spark.createDataFrame([(*p, "x", "x", 1, "x", "x", 1, "x") for p in PAGES], f"page_id bigint, url string, html string, {clash}").repartition(3).write.parquet(f"{path}/pages.parquet")
    clash = "record string, layout string, n int, piece string, loss string"
    spark.createDataFrame([(*t, "{}", "x", 3, "x", "x") for t in TURNS], f"conv_id bigint, turn bigint, role string, text string, {clash}").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name, schema in {"documents": FULL, "benchmark": "item_id bigint, text string", "labels": "doc_id bigint, quality int, toxic int", "pages": "page_id bigint, url string, html string", "conversations": "conv_id bigint, turn bigint, role string, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path
