"""The corpus pipeline, stage by stage, against the operators' plain results; the last stage against the tokenizer."""

import math
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerlark.llm import language_id, line_dedup, quality
from ledgerlark.llm.common import table, written


def kept(docs):
    return Counter(r[0] for r in docs.select("doc_id").collect())


def plain_bits(trees, lang, text):
    """Code length of a text by contexts looked up one by one."""
    bits, order = 0.0, language_id.MAX_ORDER
    for i, byte in enumerate(text):
        for k in range(min(i, order), -1, -1):
            counts = trees.get((lang, text[i - k : i]))
            if counts:
                total, distinct = sum(counts.values()), len(counts)
                if byte in counts:
                    bits += math.log2((total + distinct) / counts[byte])
                    break
                bits += math.log2((total + distinct) / distinct)
        else:
            bits += 8
    return bits


def plainly_accepted(docs):
    """Ids that the language stage keeps, with trees, bounds and scores worked out one by one."""
    some = language_id.sample(docs)
    trees = {}
    for lang, text, n in some:
        for i in range(len(text)) if n % language_id.ASIDE else ():
            for k in range(min(i, language_id.MAX_ORDER) + 1):
                trees.setdefault((lang, text[i - k : i]), Counter())[text[i]] += 1
    languages = sorted({lang for lang, _ in trees})
    most = {}
    for lang in languages:
        own = [plain_bits(trees, lang, text) / len(text) for owner, text, n in some if owner == lang and n % language_id.ASIDE == 0]
        most[lang] = min(8.0, language_id.ROOM * max(own)) if len(own) >= language_id.FEWEST else 8.0
    for r in docs.select("doc_id", "text").collect():
        text = (r.text or "").encode()
        if any(map(str.isalpha, r.text or "")):
            bits = {lang: plain_bits(trees, lang, text) for lang in languages}
            best = min(languages, key=lambda lang: (bits[lang], lang))
            score = 1 / sum(2 ** max(bits[best] - b, -1000) for b in bits.values())
            if score >= language_id.LEAST_SCORE and bits[best] <= most[best] * len(text) + language_id.SHORT:
                yield r.doc_id


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "line_dedup", "near_dedup", "packing"]
    outs = []
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, before, sf_dir), name)
        if name != "packing":
            assert after.dtypes == docs.dtypes
        outs.append((before, after))
        before = after
    (q0, q1), (l0, l1), (d0, d1), (n0, n1), (p0, p1) = outs

    scored = quality.classify(q0, table(spark, sf_dir, "labels"))
    assert kept(q1) == kept(scored.filter("predicted = 1"))
    assert q1.subtract(q0).count() == 0

    assert kept(l1) == Counter(plainly_accepted(l0))

    dropped = line_dedup.drop_repeated_lines(d0).select("doc_id", "text")
    assert d1.select("doc_id", "text").exceptAll(dropped).count() == 0 and kept(d1) == kept(d0)
    assert d1.filter("n_chars <> char_length(text)").count() == 0

    import importlib.util
    from pathlib import Path

    spec = importlib.util.spec_from_file_location("near_dups_by_force", Path(__file__).with_name("test_near_dups.py"))
    force = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(force)
    groups = force.brute([(r.doc_id, r.text) for r in n0.select("doc_id", "text").collect()])
    assert kept(n1) == Counter(i for i, (_, top) in groups.items() if i == top)

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in p0.select("doc_id", "text").collect()}
    assert {r.doc_id: r.n for r in p1.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == tokens

    rows = corpus_pipeline.run(spark, sf_dir)
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, p1.collect()))


def test_line_stage_keeps_columns_named_like_its_counts(spark, sf_dir):
    line = "a line that two documents share"
    docs = spark.createDataFrame([(1, line, 7, "x"), (2, f"{line}\nown", 8, "y"), (3, None, None, None)], "doc_id long, text string, n_lines int, N_dropped string")
    found = corpus_pipeline.drop_lines(spark, docs, sf_dir)
    assert found.dtypes == docs.dtypes
    assert {tuple(r) for r in found.collect()} >= {(1, line, 7, "x"), (2, "own", 8, "y")}
    assert {tuple(r)[:1] + tuple(r)[2:] for r in found.collect()} == {(1, 7, "x"), (2, 8, "y"), (3, None, None)}
