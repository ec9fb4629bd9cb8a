"""Alignment of two tokenizers over the same text, and how often each pair of their tokens is linked in the whole corpus.

1. A token covers a range of bytes. The ranges of the B tokens are a static interval index (their sorted ends); each A token asks it by
   bisection for the B tokens that it overlaps: the links. A gap between tokens that no link spans bounds a group.
2. Neither tokenizer joins across a single space that stands between visible characters, so texts are cut there first; a chunk is aligned once
   and kept in a bounded cache. Documents are dealt into blocks of bounded length. A block leaves one row with its distinct pairs and their
   numbers, and one row a document with the chunks that it holds.
3. Spark sums the pairs over all blocks (a pair is once in a block, however many documents hold it), finds each B token's highest count
   and brings both back to the blocks, where the documents' sums are taken.

Defined results. Null and empty texts, and texts whose joined A or B bytes are not space+text (those with U+2581), have no tokens: zeros
and the empty string. Rows that repeat a doc_id, or lack one, each give a row, and each count in the corpus. An empty table gives an empty result. Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import short_batches, texts, written
from ledgerlark.llm.media import runs
from ledgerlark.llm.packing import Encoder
from ledgerlark.llm.sentencepieces import SPACE, PrefixTable

#: Characters of a block; a longer text is a block of its own. It bounds what a task holds.
BLOCK_CHARS = 8_000_000
#: Chunks that a generation of the cache holds, and the longest that it keeps.
CACHED, LONGEST = 100_000, 64
#: Characters of texts whose chunks are resolved together.
TOGETHER = 1_000_000
#: Where neither tokenizer joins: before a single space between visible characters.
_CUT = re.compile(r"(?<! ) (?=\S)")
STAGED = (
    "block long, whole boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "chunks array<int>, times array<long>, pairs array<long>, numbers array<long>, links array<int>, ends array<long>"
)
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def overlaps(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each A token the first and last B token that it overlaps, and whether a group ends with it."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    first = np.searchsorted(b_ends, a_ends - a_sizes, "right")
    last = np.searchsorted(b_ends - b_sizes, a_ends, "left") - 1
    return first, last, b_ends[last] == a_ends


class Aligner:
    """Aligned chunks: (A tokens, B tokens, groups, links, groups as text, links as 64-bit A id << 32 | B id)."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Encoder(a_path).bpe, PrefixTable(b_path)
        self.a_size = np.zeros(self.a.n_vocab, np.int64)
        for i in range(self.a.n_vocab):
            try:
                self.a_size[i] = len(self.a.decode_single_token_bytes(i))
            except KeyError:
                continue  # an unused id
        self.b_size = np.array([1 if i in self.b.byte_of else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(self.b.pieces)])
        self.a_names = np.array([f"{i}{mark}" for mark in ",|" for i in range(len(self.a_size))], object)
        self.b_names = np.array([f"{i}{mark}" for mark in ",;\n" for i in range(len(self.b_size))], object)
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    @staticmethod
    def cut(text: str) -> list[str]:
        """Keys of the chunks of space+text; the leading space of a key's chunk is left out if a visible character follows it."""
        parts = _CUT.split(" " + text)
        return parts if parts[0] else parts[1:]

    def learn(self, keys: set[str]) -> dict[str, tuple]:
        """Align the chunks that the cache does not hold yet; short ones are kept there, long ones are returned."""
        if len(self.new) >= CACHED:
            self.new, self.old = {}, self.new
        missing = keys.difference(self.new)
        self.new.update({k: self.old[k] for k in missing.intersection(self.old)})
        unseen = list(missing.difference(self.old))
        longer = {}
        if unseen:
            bare = [k[1:] if k[0] == " " else k for k in unseen]
            words = [self.b.words(t) if " " in t else [t] for t in bare]
            found = iter(self.b.ids([SPACE + w for some in words for w in some]))
            b = [next(found) if len(some) == 1 else [i for _ in some for i in next(found)] for some in words]
            for key, row in zip(unseen, self.align([self.a.encode_ordinary(" " + t) for t in bare], b), strict=True):
                (self.new if len(key) <= LONGEST else longer)[key] = row
        return longer

    def align(self, of_a: list[list[int]], of_b: list[list[int]]) -> list[tuple]:
        """All chunks as one text: the tokens of a chunk end where those of the other tokenizer end."""
        a_many, b_many = (np.fromiter(map(len, x), np.int64, len(x)) for x in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n) for x, n in ((of_a, a_many.sum()), (of_b, b_many.sum())))
        first, last, ending = overlaps(self.a_size[a], self.b_size[b])
        many = last - first + 1
        links = np.repeat(a, many) << 32 | b[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
        b_ending = np.zeros(len(b), np.int64)
        b_ending[last[ending]] = 1
        group = np.concatenate([2 * (np.cumsum(ending) - ending), 2 * (np.cumsum(b_ending) - b_ending) + 1])
        a_stops, b_stops = np.cumsum(a_many) - 1, np.cumsum(b_many) - 1
        marks = b_ending.copy()
        marks[b_stops] = 2
        named = np.concatenate([self.a_names[a + ending * len(self.a_size)], self.b_names[b + marks * len(self.b_size)]])
        named = "".join(named[np.argsort(group, kind="stable")].tolist()).split("\n")
        upto = np.cumsum(many)[a_stops]
        groups, n_links = (np.diff(x, prepend=0).tolist() for x in (np.cumsum(ending)[a_stops], upto))
        raw, stops = links.astype("<i8").tobytes(), (8 * upto).tolist()
        parts = [raw[x:y] for x, y in zip([0, *stops[:-1]], stops, strict=True)]
        return list(zip(a_many.tolist(), b_many.tolist(), groups, n_links, named, parts, strict=False))


@cache
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One aligner a Python worker, with its cache."""
    return Aligner(a_path, b_path)


class Block:
    """Documents and the distinct chunks among them."""

    def __init__(self, number: int, keep: bool):
        self.number, self.keep, self.chars = number, keep, 0
        self.slots: dict[str, int] = {}
        self.found: list[tuple] = []
        self.ids, self.hashes, self.groups, self.chunks, self.times = ([] for _ in range(5))

    def add(self, doc_id, text: str, keys: list[str], known: dict[str, tuple], longer: dict[str, tuple]) -> None:
        slots, found = self.slots, self.found
        for key in set(keys).difference(slots):
            slots[key] = len(found)
            found.append(known.get(key) or longer[key])
        held = [slots[k] for k in keys]
        named = ";".join([found[s][4] for s in held])
        chunks, times = np.unique(np.array(held, np.int32), return_counts=True)
        self.chars += len(text)
        self.ids.append(doc_id)
        self.hashes.append(hashlib.sha256(named.encode()).hexdigest() if held else "")
        self.groups.append(named if self.keep else None)
        self.chunks.append(chunks)
        self.times.append(times)

    def batch(self) -> pa.RecordBatch:
        """A row for each document and then the block's own."""
        n, sizes = len(self.ids), np.array([f[3] for f in self.found], np.int64)
        links = np.frombuffer(b"".join([f[5] for f in self.found]), "<i8")
        stops = np.cumsum([0, *map(len, self.chunks)])
        chunks, times = np.concatenate(self.chunks), np.concatenate(self.times)
        held = np.bincount(chunks, times, len(self.found)).astype(np.int64)
        pairs, which = np.unique(links, return_inverse=True)
        numbers = np.bincount(which, np.repeat(held, sizes), len(pairs)).astype(np.int64)

        def summed(k: int) -> pa.Array:
            upto = np.concatenate([[0], np.cumsum(np.array([f[k] for f in self.found], np.int64)[chunks] * times)]) if len(chunks) else np.zeros(1, np.int64)
            return pa.array([*np.diff(upto[stops]).tolist(), None], pa.int64())

        def of_docs(values: np.ndarray, kind) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([*stops, stops[-1]], pa.int32()), pa.array(values, kind))

        def own(values: np.ndarray, kind) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(values)], pa.int32()), pa.array(values, kind))

        arrays = [pa.array([self.number] * (n + 1), pa.int64()), pa.array([False] * n + [True]), pa.array([*self.ids, None], pa.int64())]
        arrays += [summed(k) for k in range(4)] + [pa.array([*x, None], pa.string()) for x in (self.hashes, self.groups)]
        arrays += [of_docs(chunks, pa.int32()), of_docs(times, pa.int64()), own(pairs, pa.int64()), own(numbers, pa.int64())]
        arrays += [own(which.astype(np.int32), pa.int32()), own(np.cumsum(sizes), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in STAGED.split(", ")])


def staged(docs: DataFrame, a_path: str, b_path: str, keep: bool, block_chars: int) -> DataFrame:
    """Documents and blocks, aligned."""
    short_batches(docs.sparkSession)

    def run(batches):
        aligner, number = aligner_of(a_path, b_path), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        block = Block(number, keep)
        for batch in batches:
            ids, whole = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, y in runs([len(t) for t in whole], TOGETHER):
                cut = [aligner.cut(t) if t and SPACE not in t else [] for t in whole[x:y]]
                longer = aligner.learn(set().union(*cut))
                for doc_id, text, keys in zip(ids[x:y], whole[x:y], cut, strict=True):
                    if block.ids and block.chars + len(text) > block_chars:
                        yield block.batch()
                        number += 1
                        block = Block(number, keep)
                    block.add(doc_id, text, keys, aligner.new, longer)
        if block.ids:
            yield block.batch()

    return texts(docs).mapInArrow(run, STAGED)


def _sums(key, counts: pa.Table, rows: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents; counts: pair, total, best of the block's pairs."""
    own, docs = rows.filter(rows["whole"]), rows.filter(pa.compute.invert(rows["whole"]))
    order = np.argsort(counts["pair"].to_numpy())
    links, ends = (own[c].combine_chunks().flatten().to_numpy() for c in ("links", "ends"))
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    held = docs["chunks"].combine_chunks()
    sizes = np.diff(held.offsets.to_numpy()) if len(held) else np.zeros(0, np.int64)
    chunks, times = held.flatten().to_numpy(), docs["times"].combine_chunks().flatten().to_numpy()
    out = {c: docs[c] for c in docs.column_names if c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups")}
    for name, source in (("n_best", "best"), ("count_sum", "total")):
        of_pair = counts[source].to_numpy().astype(np.int64)[order]
        of_chunk = np.add.reduceat(of_pair[links], begins) if len(begins) else np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(of_chunk[chunks] * times)]).astype(np.int64)
        stops = np.cumsum(sizes)
        out[name] = pa.array(upto[stops] - upto[stops - sizes], pa.int64())
    return pa.table(out)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, b, total: how many links of the whole corpus hold an id pair."""
    return blocks.groupBy("pair").agg(F.sum("number").alias("total")).withColumn("b", F.col("pair").bitwiseAND(F.lit(2**32 - 1)))


def align(docs: DataFrame, a_path: str, b_path: str, keep: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every whole text; with keep, the groups too."""
    aligned = written(staged(docs, a_path, b_path, keep, block_chars), "aligned")
    blocks = aligned.filter("whole").select("block", F.inline(F.arrays_zip("pairs", "numbers")).alias("pair", "number"))
    counts = written(pair_counts(blocks), "pair_counts")
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))  # at most a row a B id: the vocabulary bounds the broadcast
    counts = counts.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("int").alias("best"))
    known = blocks.select("block", "pair").join(counts, "pair").select(F.col("block").alias("of_block"), "pair", "total", "best")
    columns = ["block", "whole", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * keep, "chunks", "times", "links", "ends"]
    names = [c.split()[0] for c in RESULT.split(", ")] + ["groups"] * keep

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _sums(key, left, right).select(names)

    return known.groupBy("of_block").cogroup(aligned.select(*columns).groupBy("block")).applyInArrow(run, RESULT + ", groups string" * keep)
