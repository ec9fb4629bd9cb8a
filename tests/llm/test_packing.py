"""Ids of op2_packing and the pipeline's last stage against the tokenizers library as it is, added tokens included."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlark.llm import packing
from ledgerlark.llm.queries import QUERIES

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n <|endoftext| >", "Ünï 漢字<|endoftext|>  two ", "plain", "", None]


def test_added_tokens(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = {}
    for n, text in enumerate(TEXTS):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected[n] = (0, len(ids), zlib.crc32(ids.tobytes()), len(ids))
    assert library.encode(TEXTS[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for found in (QUERIES["op2_packing"](spark, str(tmp_path)), corpus_pipeline.pack(spark, docs, str(tmp_path))):
        assert {r.doc_id: (r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found.collect()} == expected


RANDOM = random.Random(1)
HISTOGRAMS = {
    "one length": {100: 10**6},
    "all lengths": {k: RANDOM.randrange(1, 10**6) for k in range(1, 2049)},
    "few of each": {k: RANDOM.randrange(1, 100) for k in range(1, 2049)},
    "mostly short": {k: 1 + int(10**9 * 2.718 ** (-k / 100)) for k in range(1, 2049)},
    "short alone": {k: RANDOM.randrange(1, 10**9) for k in range(1, 65)},
    "ones": {1: 10**12 + 7},
    "one piece": {5: 1},
    "none": {},
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_placement_is_tight_and_whole(name):
    """Every rank has one place, sequences have no gap, padding is small; the intervals do not grow with the counts."""
    histogram = HISTOGRAMS[name]
    places = packing.place(histogram)
    assert len(places) < 40_000
    ranks, patterns = {}, {}
    for length, a, b, first, offset in places:
        ranks.setdefault(length, []).append((a, b))
        patterns.setdefault(first, []).append((offset, length, b - a))
    for length, own in ranks.items():
        at = 0
        for a, b in sorted(own):
            assert a == at < b
            at = b
        assert at == histogram[length]
    base = 0
    for first, items in sorted(patterns.items()):
        assert first == base and len({many for _, _, many in items}) == 1
        at = 0
        for offset, length, _ in sorted(items):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE
        base += items[0][2]
    least = -(-sum(k * n for k, n in histogram.items()) // packing.SEQUENCE)
    room = packing.SEQUENCE // 100 * 100 / packing.SEQUENCE if name == "one length" else 1  # 20 of 100 tokens are the most
    assert base <= least / room * 1.02 + 1


def test_short_documents_share_sequences(spark):
    docs = spark.createDataFrame([(k, "one short text") for k in range(5_000)] + [(5_000 + k, "") for k in range(3_000)], "doc_id long, text string")
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    tokens = sum(r.length for r in rows)
    assert len(rows) == 8_000 and len({(r.sequence_id, r.offset) for r in rows}) == 8_000
    assert max(r.sequence_id for r in rows) + 1 <= tokens / packing.SEQUENCE * 1.02 + 1
