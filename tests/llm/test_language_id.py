"""Language ID: every label is learned, groups change nothing, and the pipeline's stage rejects what no language fits."""

import random

import pytest

from ledgerlark.llm import language_id
from ledgerlark.llm.common import table

JUNK = ["qwxz zxqw jkjk vvvv", "To jest zdanie po polsku, które powinno zostać odrzucone, ponieważ nie znamy tego języka.", "これは日本語の文章です。これも日本語の文章です。", "x7fq zzkw " * 40]


def invented(r, seed):
    own = random.Random(seed)
    words = ["".join(own.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(own.randint(3, 8))) for _ in range(40)]
    return " ".join(r.choices(words, k=60))


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(5)
    return spark.createDataFrame([(n, invented(r, n % 150), f"l{n % 150:03}") for n in range(3000)], "doc_id long, text string, lang string")


def test_every_label_is_learned(spark, many):
    some = language_id.sample(many)
    assert len({lang for lang, _, _ in some}) == 150
    rows = language_id.identify(many).join(many, "doc_id").filter("held_out").select("lang", "lang_pred").collect()
    assert len(rows) > 400 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_sample_is_bounded(many):
    some = language_id.sample(many, doc_limit=4, total=150 * 500)
    by = {}
    for lang, text, _ in some:
        by.setdefault(lang, []).append(len(text))
    assert len(by) == 150 and all(sum(own[:-1]) < 500 and len(own) <= 4 for own in by.values())


def test_a_language_of_long_texts_alone_is_learned_from_a_beginning(spark):
    docs = spark.createDataFrame([(n, f"{'short text of a language ' * 9}{n}", "a") for n in range(1, 9)] + [(n, "langer text einer sprache " * 900, "b") for n in range(20, 29)], "doc_id long, text string, lang string")
    some = language_id.sample(docs, byte_limit=10_000)
    assert [len(text) for lang, text, _ in some if lang == "b"] == [10_000] and len({lang for lang, _, _ in some}) == 2


def test_groups_change_nothing():
    r = random.Random(2)
    some = sorted((f"l{n % 20:02}", invented(r, n % 20).encode(), n) for n in range(60))
    texts = [invented(r, n).encode() for n in range(30)] + [b"", b"\xff\x00 zz"]
    whole = language_id.code_lengths([language_id.fit([x[:2] for x in some])], texts)
    models = language_id.learned(some)
    assert len(models) == 3
    assert abs(language_id.code_lengths(models, texts) - whole).max() < 1e-3 * whole.max()


def test_stage_rejects_junk_and_keeps_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    junk = spark.createDataFrame([(-1 - n, t, None, "junk", len(t)) for n, t in enumerate(JUNK)] + [(-9, None, "en", None, None), (-10, "", "en", None, 0)], docs.schema)
    kept = {r.doc_id for r in language_id.accepted(docs.unionByName(junk)).select("doc_id").collect()}
    assert min(kept) >= 0
    lettered = [r.doc_id for r in docs.select("doc_id", "text").collect() if any(map(str.isalpha, r.text or ""))]
    assert len(kept) >= 0.99 * len(lettered)


def test_stage_without_labels_or_rows(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert language_id.accepted(docs.limit(0)).collect() == []
    assert language_id.accepted(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect() == []
