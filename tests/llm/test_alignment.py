"""Token alignment against both libraries: whole texts encoded at once, every pair of tokens compared."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import alignment
from ledgerlark.llm.common import table
from ledgerlark.llm.packing import _BYTE_OF
from ledgerlark.llm.queries import _tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "Straße für Ünïcode — 漢字 😀 \u0000 <|endoftext|> </s> <0x41>"),
    (5, "a text with a ▁ mark"),
    (6, "a  b   c \n\n d\t e f 　g  "),
    (6, "a  b   c \n\n d\t e f 　g  "),
    (7, "  two  spaces  \r\n" + "x" * 3000),
    (8, "long words and lines " * 400),
    (9, " "),
    (10, "don't we'll I'm 'tis it 's"),
    (11, "a \x1c b \x85 c   d"),
    (12, "x" * 70 + " " + "日本語" * 40),
    (None, "a text without an id"),
]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(_tokenizer(A))
    plain.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=_tokenizer(B))
    found, count = [], Counter()
    for doc_id, text in rows:
        a = plain.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        a_bytes = [bytes(_BYTE_OF[c] for c in plain.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            found.append((doc_id, [], [], [], []))
            continue
        spans = []
        for tokens in (a_bytes, b_bytes):
            at, own = 0, []
            for token in tokens:
                own.append((at, at + len(token)))
                at += len(token)
            spans.append(own)
        links, begin = [], 0
        for i, (s, e) in zip(a, spans[0], strict=True):
            while spans[1][begin][1] <= s:
                begin += 1
            at = begin
            while at < len(b) and spans[1][at][0] < e:
                links.append((i, b[at]))
                at += 1
        groups, left, right = [], [], []
        ends = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        for cut in sorted(ends):
            left = [i for i, (s, e) in zip(a, spans[0], strict=True) if e <= cut and s >= (groups[-1][0] if groups else 0)]
            right = [i for i, (s, e) in zip(b, spans[1], strict=True) if e <= cut and s >= (groups[-1][0] if groups else 0)]
            groups.append((cut, ",".join(map(str, left)) + "|" + ",".join(map(str, right))))
        count.update(links)
        found.append((doc_id, a, b, [g for _, g in groups], links))
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    return Counter(
        (doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for doc_id, a, b, groups, links in found
    )


def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    return docs.withColumns({c: F.lit(c) for c in ("block", "pair", "total", "whole", "b", "groups", "chunks", "n_a")})


@pytest.mark.parametrize("block_chars", [alignment.BLOCK_CHARS, 3_000])
def test_odd_texts(spark, block_chars):
    got = alignment.align(odd(spark), _tokenizer(A), _tokenizer(B), block_chars=block_chars)
    assert got.columns == [c.split()[0] for c in alignment.RESULT.split(", ")]
    assert Counter(map(tuple, got.collect())) == brute(ODD)


def test_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.length("text") < 2_000)
    got = alignment.align(docs, _tokenizer(A), _tokenizer(B), block_chars=20_000)
    assert Counter(map(tuple, got.collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_groups_are_kept(spark):
    docs = spark.createDataFrame([(1, "hello there"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.align(docs, _tokenizer(A), _tokenizer(B), keep=True).collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256 and rows[1].groups.count(";") == rows[1].n_groups - 1
    assert rows[2].groups == "" and rows[2].groups_sha256 == ""


def test_empty_table(spark):
    assert alignment.align(odd(spark).limit(0), _tokenizer(A), _tokenizer(B)).collect() == []
