"""Packing token pieces into fixed-length sequences: shortest pack first over the length histogram.

Documents are tokenized once, with an end id, and cut into full pieces and one rest. Only the histogram of piece
lengths (one row a length, at most 2,048) reaches the driver. There lengths are placed longest first, each into the pattern that is
shortest so far and still has room; a pattern stands for as many sequences as it was placed for, so the work depends on the number of lengths
and not on the documents. Patterns come back as rank intervals, joined to the pieces by length and rank within the
length. The rank is counted in salted buckets, so that the most frequent length is no single group.

Defined results. Null and empty texts are the end id alone. Added tokens in texts are ordinary text unless added=True (the
registered query and the pipeline), which gives the ids of the tokenizers library with add_special_tokens=False. Every id lies in exactly one piece. Equal rows are packed each by itself.
An empty table gives an empty result. The intervals that are broadcast are bounded by the number of lengths (see place()).
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import short_batches, texts, written

SEQUENCE = 2048
END_ID = 1
PIECES_PER_BUCKET = 500_000
LEAST_BUCKETS = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Token ids of texts as bytes (little-endian unsigned 32 bits).

    Reads the byte-level BPE vocabulary of a tokenizers file and encodes by tiktoken, whose ids for it are the same and
    which is about three times as fast. The file's added tokens in a text are ordinary text, or with added=True the
    added tokens' own ids, as the library finds them unless told otherwise.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocabulary = whole["model"]["vocab"]
        tokens = whole.get("added_tokens") or []
        if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take white space or whole words are not supported")
        ranks = {bytes(_BYTE_OF[c] for c in token): i for token, i in vocabulary.items() if all(c in _BYTE_OF for c in token)}
        self.added = {t["content"]: t["id"] for t in tokens}
        special = {token: i for token, i in vocabulary.items() if re.fullmatch(r"<\|\w+\|>", token)} | self.added
        for token in special:
            ranks.pop(token.encode(), None)
        self.bpe = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str, added: bool = False) -> bytes:
        if added and any(token in text for token in self.added):
            return array("I", self.bpe.encode(text, allowed_special=set(self.added), disallowed_special=())).tobytes()
        return array("I", self.bpe.encode_ordinary(text)).tobytes()


def _byte_alphabet() -> dict[str, int]:
    """How byte-level vocabularies write bytes: visible Latin-1 characters as themselves, the rest from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


_BYTE_OF = _byte_alphabet()


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)


def tokenize(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False, added: bool = False) -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids_crc32, doc_tokens, and the ids themselves if asked for."""
    short_batches(docs.sparkSession)
    tail, width = end_id.to_bytes(4, "little"), 4 * sequence

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            ids, whole = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [[] for _ in range(6)]
            for doc_id, text in zip(ids, whole, strict=True):
                found = encoder.encode(text, added) + tail
                for at in range(0, len(found), width):
                    piece = found[at : at + width]
                    row = (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(found) // 4, piece)
                    for column, value in zip(out, row[: 5 + keep_ids], strict=False):
                        column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in out[:5]] + [pa.array(out[5], pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return texts(docs).mapInArrow(run, PIECES + ", ids binary" * keep_ids)


def place(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(length, rank from, rank to, first sequence, offset): where the pieces of a length go, by rank.

    Each step lengthens one pattern, of as many sequences as it has or as pieces are left. Where no pattern has room, a new one gets as many sequences as
    the pieces left fill, so that pieces of one length share sequences too. A step uses up a length or lengthens a whole pattern, so the number of steps
    and of intervals depends on the lengths and not on their counts (some 30,000 for all lengths up to 2,048).
    """
    heap: list[tuple[int, int, int, list]] = []  # tokens, number (for ties), sequences, [(length, first rank, offset)]
    done, number = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if heap and heap[0][0] + length <= sequence:
                tokens, _, many, items = heapq.heappop(heap)
            else:  # no room anywhere
                tokens, many, items = 0, -(-left // (sequence // length)), []
            used = min(left, many)
            if used < many:
                rest = [(n, r + used, o) for n, r, o in items]
                number += 1
                heapq.heappush(heap, (tokens, number, many - used, rest))
            number += 1
            entry = (tokens + length, number, used, [*items, (length, rank, tokens)])
            done.append(entry) if tokens + length == sequence else heapq.heappush(heap, entry)
            rank += used
            left -= used
    out, base = [], 0
    for _, _, many, items in done + heap:
        out += [(n, r, r + many, base, o) for n, r, o in items]
        base += many
    return out


def pack(pieces: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...), which must be a written table or cheap to recompute."""
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # a row a length
    buckets = max(LEAST_BUCKETS, -(-sum(histogram.values()) // PIECES_PER_BUCKET))
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = pieces.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start")
    ranked = pieces.withColumn("_row", F.row_number().over(within)).join(bases, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_row") - 1)
    # Intervals are cut at multiples of their mean width (of the length), so that a piece meets one or two of them and not all of its length.
    intervals = place(histogram, sequence)
    many = Counter(n for n, *_ in intervals)
    width = {n: -(-histogram[n] // many[n]) for n in many}
    cut = [(n, slot, a, b, first, offset) for n, a, b, first, offset in intervals for slot in range(a // width[n], (b - 1) // width[n] + 1)]
    widths = spark.createDataFrame(sorted(width.items()), "length long, _width long")
    slots = spark.createDataFrame(cut, "length long, _slot long, _from long, _to long, _first long, _offset long")
    ranked = ranked.join(F.broadcast(widths), "length").withColumn("_slot", F.call_function("div", F.col("_rank"), F.col("_width")))
    placed = ranked.join(F.broadcast(slots), ["length", "_slot"]).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    kept = [c for c in pieces.columns if c != "_bucket"]
    return placed.select(*kept, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False, added: bool = False) -> DataFrame:
    """Tokenize, cut and pack whole documents. The pieces are written once, so that no text is tokenized twice."""
    return pack(written(tokenize(docs, path, sequence, end_id, keep_ids, added), "pieces"), sequence)
