"""Line deduplication by a sharded minimal perfect hash.

A line's key is the line without ASCII white space at both ends, with A-Z lower-cased; keys of at least ten code points
count. Keys are known by 128-bit hashes. Keys of two or more documents are indexed: hash shards each hold a minimal perfect
hash (bit levels, each key in the first level where it lands alone) over compact arrays of fingerprints, counts and owners (the
smallest doc_id). The number of shards grows with the indexed keys and with the probes. Documents are dealt into blocks; a block sends each of its distinct keys once to its shard, probes the
arrays there, and gets back the few that repeat. No line is joined with a line, and a line that every document holds costs one
probe a block.

Defined results. Null and empty texts are one empty line. Short keys are never dropped. Rows that share a doc_id are one
document. A null doc_id counts as the greatest id. A document whose lines all go keeps an empty text. An empty table gives an
empty result. All columns of the input are returned, with text replaced; n_lines and n_dropped replace columns of that name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.llm.common import SPACES, ascii_lower, fresh, short_batches, written

LEAST_POINTS = 10
KEYS_PER_SHARD = 100_000
#: Most rows that probe one shard, on average: 33 bytes each.
PROBES_PER_SHARD = 1_000_000
BLOCKS_PER_SPLIT = 8
NO_ID = 2**63 - 1
GAMMA = 1.5
#: Spark's xxhash64 hashes its arguments one after the other: the hash of the first is the seed of the next.
SEEDS = tuple(xxhash.xxh64_intdigest(s, seed=42) for s in (b"a", b"b"))
INDEX = "shard long, sizes binary, bits binary, fingerprints binary, counts binary, owners binary"


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x += h2
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1 ^ ((h2 << np.uint64(17)) | (h2 >> np.uint64(47)))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys: each gets its own slot of 0..n-1; other keys get any slot or none."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], np.arange(len(h1))
        while len(left):
            size = max(8, int(GAMMA * len(left)))
            at = (_mix(h1[left], h2[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that is surely none of those built from."""
        found, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + (_mix(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            found[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
        return found


def _unsigned(column) -> np.ndarray:
    return np.asarray(column, np.int64).view(np.uint64)


def _build_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = _unsigned(rows["h1"]), _unsigned(rows["h2"])
    table = PerfectHash.build(h1, h2)
    at = table.slots(h1, h2)

    def laid(values, kind) -> bytes:
        out = np.zeros(len(at), kind)
        out[at] = values
        return out.tobytes()

    counts = laid(np.minimum(rows["n"].to_numpy(), 2**32 - 1), np.uint32)
    return pd.DataFrame([(key[0], table.sizes.tobytes(), np.packbits(table.bits).tobytes(), laid(_fingerprint(h1, h2), np.uint64), counts, laid(rows["owner"], np.int64))], columns=["shard", "sizes", "bits", "fingerprints", "counts", "owners"])


def _probe_shard(index: pa.Table, probes: pa.Table) -> pa.Table:
    kind = pa.schema([("block", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("owner", pa.int64()), ("count", pa.int64())])
    if not index.num_rows or not probes.num_rows:
        return kind.empty_table()
    row = {k: v[0] for k, v in index.to_pydict().items()}
    sizes = np.frombuffer(row["sizes"], np.int64)
    table = PerfectHash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool))
    prints, counts, owners = (np.frombuffer(row[k], t) for k, t in (("fingerprints", np.uint64), ("counts", np.uint32), ("owners", np.int64)))
    h1, h2 = (_unsigned(probes[k].to_numpy()) for k in ("h1", "h2"))
    at = table.slots(h1, h2)
    hit = np.flatnonzero((at >= 0) & (prints[at] == _fingerprint(h1, h2)))
    at = at[hit]
    return pa.Table.from_arrays([pa.array(probes["block"].to_numpy()[hit]), pa.array(h1[hit].view(np.int64)), pa.array(h2[hit].view(np.int64)), pa.array(owners[at]), pa.array(counts[at].astype(np.int64))], schema=kind)


def keys_of(docs: DataFrame, blocks: int) -> DataFrame:
    """block, h1, h2, owner, last, n: a row for each distinct key of a block of documents."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    lines = docs.select(_block(blocks).alias("block"), doc.alias("doc"), F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("line"))
    lines = lines.select("block", "doc", F.btrim("line", F.lit(SPACES)).alias("key")).filter(F.char_length("key") >= LEAST_POINTS)
    lines = lines.select("block", "doc", ascii_lower(F.col("key")).alias("key"))
    hashed = lines.select("block", "doc", F.xxhash64(F.lit("a"), "key").alias("h1"), F.xxhash64(F.lit("b"), "key").alias("h2"))
    return hashed.groupBy("block", "h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))


def _block(blocks: int):
    """The block of a row: by its doc_id, and by its text where that is null, as many rows may have none."""
    doc = F.col("doc_id").cast("long")
    return F.pmod(F.xxhash64(doc, F.when(doc.isNull(), F.col("text"))), F.lit(blocks)).cast("long")


def shards_for(repeated: int, probes: int) -> int:
    """Shards such that neither the index nor the probes of one are many."""
    return max(16, -(-repeated // KEYS_PER_SHARD), -(-probes // PROBES_PER_SHARD))


def build_index(keys: DataFrame) -> tuple[DataFrame, int]:
    """(index, shards): one row a shard over the keys that two or more documents hold. keys: a written table, all of which will probe."""
    totals = keys.groupBy("h1", "h2").agg(F.min("owner").alias("owner"), F.max("last").alias("last"), F.sum("n").alias("n"))
    repeated = written(totals.filter("owner < last").drop("last"), "repeated-lines")
    shards = shards_for(repeated.count(), keys.count())
    rows = repeated.withColumn("shard", F.pmod("h1", F.lit(shards)))
    return rows.groupBy("shard").applyInPandas(_build_shard, INDEX), shards


def _drop_in_block(docs: pa.Table, hits: pa.Table, schema: pa.Schema, text: str, doc: str) -> pa.Table:
    owners = {h1 & (2**64 - 1): (h2 & (2**64 - 1), owner) for h1, h2, owner in zip(*(hits[k].to_pylist() for k in ("h1", "h2", "owner")), strict=True)}
    kept, n_lines, n_dropped = [], [], []
    for doc_id, whole in zip(docs[doc].to_pylist(), docs[text].to_pylist(), strict=True):
        doc_id = NO_ID if doc_id is None else doc_id
        lines, out = (whole or "").split("\n"), []
        for line in lines:
            key = line.strip(SPACES)
            if len(key) >= LEAST_POINTS:
                raw = key.encode().lower()
                held = owners.get(xxhash.xxh64_intdigest(raw, seed=SEEDS[0]))
                if held and held[1] != doc_id and held[0] == xxhash.xxh64_intdigest(raw, seed=SEEDS[1]):
                    continue
            out.append(line)
        kept.append("\n".join(out))
        n_lines.append(len(lines))
        n_dropped.append(len(lines) - len(out))
    new = {text: kept, "n_lines": n_lines, "n_dropped": n_dropped}
    return pa.Table.from_arrays([pa.array(new[f.name], f.type) if f.name in new else docs[f.name].cast(f.type).combine_chunks() for f in schema], schema=schema)


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with every repeated line dropped but in the smallest doc_id that holds it, and n_lines, n_dropped."""
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.drop("n_lines", "n_dropped")
    blocks = max(16, BLOCKS_PER_SPLIT * docs.rdd.getNumPartitions())
    keys = written(keys_of(docs, blocks), "line-keys")
    index, shards = build_index(keys)
    probes = keys.select(F.pmod("h1", F.lit(shards)).alias("shard"), "block", "h1", "h2")
    hits = index.groupBy("shard").cogroup(probes.groupBy("shard")).applyInArrow(_probe_shard, "block long, h1 long, h2 long, owner long, count long")
    block = fresh(docs, "block")
    dealt = docs.withColumn(block, _block(blocks))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]).add("n_lines", "long").add("n_dropped", "long")
    arrow = _arrow(schema)

    def drop(rows: pa.Table, found: pa.Table) -> pa.Table:
        return _drop_in_block(rows, found, arrow, "text", "doc_id")

    return dealt.groupBy(block).cogroup(hits.groupBy("block")).applyInArrow(drop, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
