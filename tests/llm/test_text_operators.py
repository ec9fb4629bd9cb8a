"""The numbered operators that SQL cannot express: brute force, exact round trips, held-out accuracy, and odd inputs."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import exact_dedup, jpeg, language_id, licenses, line_dedup, media, near_dups, packing, quality, sentencepieces, url_filters
from ledgerlark.llm.common import table
from ledgerlark.llm.queries import QUERIES

ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "Straße für Ünïcode — 漢字 😀 ▁ \u0000 <|endoftext|> </s> <0x41>"),
    (5, "the same line of text\nthe same line of text"),
    (6, "the same line of text"),
    (6, "the same line of text"),
    (7, "  two  spaces  \r\n" + "x" * 10_000),
    (8, "long words and lines " * 20_000),
    (None, "a text without an id"),
]


def odd(spark):
    """Nulls, repeats, empty and very long texts, and columns with names that the operators use inside."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    extra = {c: F.lit(c) for c in ("id", "block", "length", "kept_id", "n_lines", "score", "registers", "row", "_bucket")}
    return docs.withColumns(extra | {"lang": F.when(F.col("doc_id") > 3, "en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


def pairs(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(params=["table", "odd"])
def docs(request, spark, sf_dir):
    return table(spark, sf_dir, "documents") if request.param == "table" else odd(spark)


def test_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    expected = Counter()
    for doc_id, text in pairs(docs):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[doc_id, len(ids), ids.tobytes()] += 1
    rows = packing.pack_documents(docs, path, keep_ids=True).collect()
    starts = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        starts.setdefault((r.doc_id, r.start), []).append(r)
    for (doc_id, start), same in starts.items():
        if start == 0:
            for first in same:
                whole = bytes(first.ids)
                while len(whole) < 4 * first.doc_tokens:
                    whole += next(r.ids for r in starts[doc_id, len(whole) // 4] if r.doc_tokens == first.doc_tokens)
                expected[doc_id, first.doc_tokens, whole] -= 1
    assert not +expected and not -expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
    assert len(sequences) <= math.ceil(sum(r.length for r in rows) / packing.SEQUENCE * 1.02) + 1


@pytest.mark.parametrize("seed", range(5))
def test_place_covers_every_rank(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(n): int(rng.integers(1, 5000)) for n in rng.choice(np.arange(1, 2049), 300, replace=False)}
    filled = Counter()
    for length, a, b, first, offset in packing.place(histogram):
        assert a < b and offset + length <= 2048
        filled[length] += b - a
    assert filled == Counter(histogram)


def test_sentencepiece(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = Counter()
    for doc_id, text in pairs(docs):
        ids = library.encode(text or "")
        expected[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in sentencepieces.encode_documents(docs, path).collect()) == expected


def test_sentencepiece_on_random_texts():
    """Strings of pieces, runs of spaces and odd characters, against the library."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    digest, rng = sentencepieces.Digester(path), np.random.default_rng(5)
    shown, odd = [p for p in digest.table.shown if not p.startswith("<0x")], ["\n", "\t", "e\u0301", "漢", "😀", "\0", "  ", "     ", "▁", "aaaa", "111", "\r\n", "ß"]
    pick = lambda: odd[rng.integers(len(odd))] if rng.random() < 0.3 else shown[rng.integers(len(shown))]
    texts = ["".join(pick() for _ in range(rng.integers(25))) for _ in range(3000)] + [c * n for c in "a =" for n in range(1, 120)] + ["ab" * 500, "=" * 3000]
    for text, (ids, n, decoded) in zip(texts, digest(texts), strict=True):
        expected = library.encode(text)
        assert (ids, n, decoded) == (",".join(map(str, expected)), len(expected), library.decode(expected)), text


def test_media_round_trip(docs):
    expected = Counter()
    for doc_id, text in pairs(docs):
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        expected[doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])] += 1
    stored = media.store(docs)
    rows = media.features(stored).collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected
    kept = Counter((r.doc_id, len(r.media), hashlib.sha256(r.media).hexdigest()) for r in stored.collect())
    assert Counter((r.doc_id, r.media_bytes, r.media_sha256) for r in rows) == kept


def test_every_byte_survives():
    for payload in (bytes(range(256)) * 3, b"\xff" * 192, b"\0" * 192, np.random.default_rng(1).bytes(192 * 50)):
        image = jpeg.decode_many([jpeg.encode(payload)])[0]
        assert jpeg.payload_of(image) == payload
        assert image.thumbnail.shape == (image.height // 8, image.width // 8)


def test_broken_media_is_refused():
    whole = jpeg.encode(b"a" * 192)
    for bad in (b"", b"GIF89a", whole[:40], whole.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(ValueError):
            jpeg.decode_many([bad])


def test_exact_dedup(docs):
    groups = {}
    rows = pairs(docs)
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    expected = Counter()
    for doc_id, text in rows:
        same = groups[text or ""]
        keep = max((i for i in same if i is not None), default=None)
        expected[doc_id, keep, len(same), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact_dedup.deduplicate_once(docs).collect()) == expected


def test_digest_index_keeps_what_it_saw(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_of_a_test", 4)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "a"), (8, "c")], "doc_id long, text string")
    exact_dedup.deduplicate(first, index).collect()
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.deduplicate(second, index).collect()}
    assert found == {9: (3, False), 8: (8, True)}
    assert index.read().count() == 3
    spark.sql(f"DROP TABLE {index.name}")


def test_line_dedup(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows, held = [(line_dedup.NO_ID if i is None else i, t or "") for i, t in pairs(docs)], {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    for doc_id, text in rows:
        for line in text.split("\n"):
            held.setdefault(key(line), set()).add(doc_id)
    expected = Counter()
    for doc_id, text in rows:
        lines = text.split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or doc_id == min(held[key(x)])]
        expected[doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    out = line_dedup.drop_repeated_lines(docs)
    assert [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"] == out.columns
    assert Counter((line_dedup.NO_ID if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()) == expected


def test_perfect_hash():
    rng = np.random.default_rng(3)
    h1, h2 = (rng.integers(0, 2**63, 20_000).astype(np.uint64) for _ in range(2))
    found = line_dedup.PerfectHash.build(h1, h2).slots(h1, h2)
    assert sorted(found.tolist()) == list(range(20_000))


def area(scores, target):
    """Area under the ROC curve."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for s in np.unique(scores):
        ranks[scores == s] = ranks[scores == s].mean()
    n = target.sum()
    return (ranks[target == 1].sum() - n * (n + 1) / 2) / (n * (len(target) - n))


def test_quality_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op7_quality"](spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").filter("held_out").select("score", "quality").toPandas()
    assert area(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.9


def test_quality_rows(docs, spark, sf_dir):
    rows = quality.classify(docs, table(spark, sf_dir, "labels")).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in pairs(docs))
    for r in rows:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_language_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op8_language_id"](spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id")
    rows = rows.filter("held_out and lang is not null and lang_pred <> 'und'").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.95


def test_language_rows(docs):
    texts = dict(pairs(docs))
    rows = language_id.identify(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in pairs(docs))
    for r in rows:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or "")))
        assert 0 <= r.score <= 1


def test_code_lengths_by_hand():
    """The automaton's code lengths equal those of contexts looked up one by one."""
    labelled = [("a", b"abracadabra " * 5), ("b", b"banana bandana " * 4)]
    model = language_id.fit(labelled)
    trees = {}
    for lang, text in labelled:
        for k in range(language_id.MAX_ORDER + 1):
            for i in range(len(text) - k):
                trees.setdefault((lang, text[i : i + k]), Counter())[text[i + k]] += 1
    for text in (b"abba banana", b"zzz", b"cadabra" * 400):
        found = language_id.code_lengths([model], [text])[0]
        for n, lang in enumerate(model.languages):
            bits = 0.0
            for i, byte in enumerate(text):
                for k in range(min(i, language_id.MAX_ORDER), -1, -1):
                    counts = trees.get((lang, text[i - k : i]))
                    if not counts:
                        continue
                    total, distinct = sum(counts.values()), len(counts)
                    if byte in counts:
                        bits += math.log2((total + distinct) / counts[byte])
                        break
                    bits += math.log2((total + distinct) / distinct)
                else:
                    bits += 8
            assert found[n] == pytest.approx(bits, rel=1e-4)


def test_license_inheritance(spark):
    files = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.py", "print"),
        (3, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "a/b/c/d/y.py", None),
        (5, "z.py", ""),
        (6, None, "Licensed under the Apache License, Version 2.0.\ncode"),
        (7, "a/b/c/d/y.py", "nothing"),
    ]
    rows = licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    assert {r.doc_id: (r.licence, r.origin, r.from_directory) for r in rows} == {
        1: ("MIT", "own", None),
        2: ("MIT", "inherited", "a"),
        3: ("GPL-3.0", "own", None),
        4: ("GPL-3.0", "inherited", "a/b/c"),
        5: (None, "none", None),
        6: ("Apache-2.0", "own", None),
        7: ("GPL-3.0", "inherited", "a/b/c"),
    }


def test_license_scan_finds_every_statement(spark, sf_dir):
    """Every document with a template's statement as a line of its own has a licence."""
    rows = {r.doc_id: r for r in QUERIES["op1_license_scan"](spark, sf_dir).collect()}
    statements = {licenses.TEMPLATES[k][1]: licenses.TEMPLATES[k][0] for k in range(len(licenses.TEMPLATES))}
    whole = pairs(table(spark, sf_dir, "documents"))
    assert len(rows) == len(whole)
    for doc_id, text in whole:
        said = {statements[line] for line in (text or "").split("\n") if line in statements}
        assert not said or rows[doc_id].licence in said


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com/en/q", "http://example.com", "https://x.net/es/1", "https://x.net/de", "https://notexample.com/en/", "http://x.net?u=://com/"]
    rows = {r.url: r for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).join(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "page_id").collect()}
    assert {u: (rows[u].host, rows[u].path, rows[u].rule) for u in urls} == {
        None: ("", "", None),
        "": ("", "", None),
        "no scheme": ("", "", None),
        "http://": ("", "", None),
        urls[4]: ("www.example.com", "/en/x", "www.example.com/en/"),
        urls[5]: ("example.com", "/en/", "example.com/en/"),
        urls[6]: ("a.example.com", "/en/q", "example.com/en/"),
        urls[7]: ("example.com", "", None),
        urls[8]: ("x.net", "/es/1", "net/es/"),
        urls[9]: ("x.net", "/de", None),
        urls[10]: ("notexample.com", "/en/", "com/"),
        urls[11]: ("x.net", "", None),
    }
    assert [rows[u].verdict for u in urls[4:7]] == ["allow", "block", "block"]


def test_empty_tables(spark, sf_dir):
    none = table(spark, sf_dir, "documents").filter("doc_id < 0")
    labels = table(spark, sf_dir, "labels").filter("doc_id < 0")
    for out in (
        licenses.scan(licenses.as_files(none)),
        packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")),
        line_dedup.drop_repeated_lines(none),
        media.features(media.store(none)),
        near_dups.groups(none),
        quality.classify(none, labels),
        language_id.identify(none),
        exact_dedup.deduplicate_once(none),
        sentencepieces.encode_documents(none, public_tokenizers.path("piece_bpe_32k.model")),
        url_filters.judge(table(spark, sf_dir, "pages").filter("page_id < 0")),
    ):
        assert out.count() == 0
