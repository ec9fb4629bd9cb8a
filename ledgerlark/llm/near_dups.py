"""Near-duplicate groups by SetSketch registers.

1. Each document's set of word shingles gets a sketch; documents with equal sets are one set from here on (128-bit key).
2. Register values are banded; sets that share a band's values share a bucket. Stars, not pairs: each set is compared with the
   least set of its buckets. Of the candidates, those whose similarity is estimated (jointly, by likelihood) far below the
   threshold go; the rest are verified on their full sets.
3. Only buckets that still hold several components need more: there every set outside the bucket's largest component is compared with all
   sets of other components, block against block, by counting common shingles on 32 bits of each (never too few), of near copies only
   what they differ by; what is left is verified. Blocks are bounded by their shingles, so they bound what one task holds.
4. Components come from star rounds over verified links. No link, set or component reaches the driver.

With 40 bands of 6 registers, a pair of similarity 0.8 shares no bucket with probability 5e-6.

Defined results. Null and empty texts and texts without words have the empty set and are linked with nothing. Rows that repeat
a doc_id with the same set are one document; each row is returned. Rows without a doc_id come after all ids; a group
without any id has the component_id null. Of a group, the rows of the smallest doc_id with one same set are kept. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm import shingles
from ledgerlark.llm.common import fresh, short_batches, texts, written
from ledgerlark.llm.graph import components

BANDS, ROWS = 40, 6
#: Shingles of a block when buckets are compared in blocks; a larger set is a block of its own.
BLOCK = 200_000
#: Sides of a block pair, and pivots that a block pair's sets are compared with.
FIRST, SECOND, PIVOTS = 1, 2, 16
#: Texts whose sets and sketches are computed together, in characters.
TOGETHER = 1_000_000


@dataclass(frozen=True)
class Policy:
    words: int = 5
    percent: int = 80  # similarity that links, as a whole percentage
    slack: float = 0.13  # five standard deviations of the estimate: candidates estimated lower than this below go


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), n, k1, k2 (the set's key), registers (little-endian 16-bit values)."""
    from ledgerlark.llm.media import runs

    short_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            whole = batch.column(3).to_pylist()
            for a, b in runs([len(t) for t in whole], TOGETHER):
                sets = shingles.shingle_sets(whole[a:b], words)
                registers = shingles.sketches(sets)
                keys = [shingles.set_key(s) for s in sets]
                columns = [[len(s) for s in sets], [k[0] for k in keys], [k[1] for k in keys]]
                own = [batch.column(k).slice(a, b - a) for k in range(3)]
                yield pa.RecordBatch.from_arrays(own + [pa.array(c, pa.int64()) for c in columns] + [pa.array([r.tobytes() for r in registers], pa.binary())], names=["doc_id", "t1", "t2", "n", "k1", "k2", "registers"])

    return texts(docs).select("doc_id", *_text_key(F.col("text"), "t1", "t2"), "text").mapInArrow(run, "doc_id long, t1 long, t2 long, n long, k1 long, k2 long, registers binary")


def _text_key(text, *names: str) -> list:
    return [F.xxhash64(F.lit(seed), text).alias(name) for seed, name in zip("ab", names, strict=True)]


def banded(sets: DataFrame) -> DataFrame:
    """id, order (none, doc_id, id), bucket: a row for each set and band."""
    width = 2 * ROWS
    at = F.sequence(F.lit(0), F.lit(BANDS - 1))
    rows = sets.select("id", F.struct("none", "doc_id", "id").alias("order"), "registers", F.explode(at).alias("band"))
    return rows.select("id", "order", F.xxhash64("band", F.expr(f"substring(registers, band * {width} + 1, {width})")).alias("bucket"))


def _similar(left: list[bytes], right: list[bytes], n1, n2) -> np.ndarray:
    a, b = (np.frombuffer(b"".join(x), "<u2").reshape(-1, shingles.REGISTERS) for x in (left, right))
    return shingles.compare(a, b, np.asarray(n1), np.asarray(n2))


def verified(pairs: DataFrame, sets: DataFrame, whole: DataFrame, policy: Policy, estimated: bool = False) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold. Estimates first, then both texts' sets are intersected."""
    cut, percent, words = policy.percent / 100 - policy.slack, policy.percent, policy.words

    def side(table: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
        return table.select(F.col("id").alias(name), *[F.col(k).alias(v) for k, v in columns.items()])

    def promising(batches):
        for batch in batches:
            x = batch.to_pydict()
            if batch.num_rows:
                keep = _similar(x["r1"], x["r2"], x["n1"], x["n2"]) >= cut
                yield batch.select(["u", "v"]).filter(pa.array(keep))

    def linked(batches):
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for a in range(0, len(left), 32):
                some = shingles.shingle_sets(left[a : a + 32] + right[a : a + 32], words)
                for s, t in zip(some[: len(some) // 2], some[len(some) // 2 :], strict=True):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    if not estimated:
        pairs = pairs.join(side(sets, "u", {"registers": "r1", "n": "n1"}), "u").join(side(sets, "v", {"registers": "r2", "n": "n2"}), "v")
        sizes = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
        pairs = written(pairs.filter(sizes).select("u", "v", "r1", "r2", "n1", "n2").mapInArrow(promising, "u long, v long"), "promising")
    both = pairs.join(side(whole, "u", {"text": "t1"}), "u").join(side(whole, "v", {"text": "t2"}), "v")
    return both.select("u", "v", "t1", "t2").mapInArrow(linked, "u long, v long")


def _blocks(rows: DataFrame) -> DataFrame:
    """Pairs of blocks to be compared: sets outside their bucket's largest component against all sets of the bucket.

    rows: bucket, id, n, component. Returns bucket, i, j, side (FIRST, SECOND or both), id, n, component: a set is once in a block pair.
    """
    per = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("n"))
    largest = F.max(F.struct("sets", "n", F.col("component").alias("c")))
    top = per.groupBy("bucket").agg(largest.alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
    top = top.filter("kinds > 1").select("bucket", F.col("top.c").alias("largest"), F.col("all"), (F.col("all") - F.col("top.n")).alias("rest"))
    rows = rows.join(top, "bucket")
    rest_blocks, all_blocks = F.ceil(F.col("rest") / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.lit(2**31 - 1))
    rows = rows.select("bucket", "id", "n", "component", (F.col("component") != F.col("largest")).alias("apart"), rest_blocks.alias("ni"), all_blocks.alias("nj"), own.alias("own"))
    i, j = F.pmod("own", "ni").cast("int"), F.pmod("own", "nj").cast("int")
    every = F.sequence(F.lit(0), F.col("nj") - 1)
    first = rows.filter("apart").select("bucket", i.alias("i"), F.explode(every).alias("j"), j.alias("mine"), "id", "n", "component")
    first = first.select("bucket", "i", "j", F.when(F.col("j") == F.col("mine"), FIRST | SECOND).otherwise(FIRST).alias("side"), "id", "n", "component")
    second = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), j.alias("j"), F.lit(SECOND).alias("side"), "id", "n", "component", "apart", i.alias("mine"))
    second = second.filter(~F.col("apart") | (F.col("i") != F.col("mine"))).drop("apart", "mine")
    return first.unionByName(second)


def short_members(whole: DataFrame, words: int) -> DataFrame:
    """id, members: 32 bits of each shingle of a text."""
    from ledgerlark.llm.media import runs

    def run(batches):
        for batch in batches:
            ids, some = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in runs([len(t) for t in some], TOGETHER):
                members = [(s >> np.uint64(32)).astype("<u4").tobytes() for s in shingles.shingle_sets(some[a:b], words)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(members, pa.binary())], names=["id", "members"])

    return whole.select("id", "text").mapInArrow(run, "id long, members binary")


class _Block:
    """Sets of a block pair. Sets that differ little from one of them, the pivot, are kept as what they differ by.

    With C the pivot, S = C - D + A, and d(S) = D + A, two such sets have |C| - |D| - |D'| + |d(S) & d(S')| members in common, so a group of near copies
    is compared by its differences alone. Other pairs are compared by their members. Members are 32 bits of a shingle, so as many
    as were the same within a set are allowed for: what is found is never too few.
    """

    def __init__(self, rows: pa.Table, percent: int):
        self.percent = percent
        self.ids, self.n, self.own, side = (rows[k].to_numpy() for k in ("id", "n", "component", "side"))
        self.left, self.right = (side & FIRST) > 0, (side & SECOND) > 0
        self.members = [np.unique(np.frombuffer(m, "<u4")) for m in rows["members"].to_pylist()]
        self.spare = self.n - np.array([len(m) for m in self.members])

    def pairs(self) -> list[tuple[int, int]]:
        found, rest = [], np.arange(len(self.ids))
        for _ in range(PIVOTS):
            if not len(rest):
                break
            pivot = int(rest[len(rest) // 2])
            near, less, differing = self._around(pivot, rest)
            names, size = near.tolist(), len(self.members[pivot])
            some = near[self.left[near]]
            found += self._meet(some, near[self.right[near]], dict(zip(names, differing, strict=True)), dict(zip(names, less.tolist(), strict=True)), size)
            outside = self.right.copy()
            outside[near] = False
            found += self._meet(some, np.flatnonzero(outside), self.members)
            rest = np.setdiff1d(rest, near, assume_unique=True)
        return found + self._meet(rest[self.left[rest]], np.flatnonzero(self.right), self.members)

    def _around(self, pivot: int, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The sets that differ from the pivot by at most half of their members; for each |D| and D + A."""
        centre = self.members[pivot]
        sizes = np.array([len(self.members[k]) for k in rest])
        rest = rest[(2 * sizes >= len(centre)) & (sizes <= 2 * len(centre))]
        near, less, differing = [], [], []
        for k in rest.tolist():
            mine = self.members[k]
            both = np.intersect1d(centre, mine, assume_unique=True)
            if len(centre) + len(mine) - 2 * len(both) <= max(len(mine), 1) // 2:
                near.append(k)
                less.append(len(centre) - len(both))
                differing.append(np.setxor1d(centre, mine, assume_unique=True))
        return np.array(near, np.int64), np.array(less, np.int64), differing

    def _meet(self, left: np.ndarray, right: np.ndarray, tokens, less: dict[int, int] | None = None, size: int = 0) -> list[tuple[int, int]]:
        """Pairs that may be similar enough: common tokens are counted, for differences turned into common members."""
        if not len(left) or not len(right):
            return []
        held = [tokens[k] for k in right.tolist()]
        token, holder = np.concatenate(held), np.repeat(np.arange(len(right)), [len(h) for h in held])
        order = np.argsort(token, kind="stable")
        token, holder = token[order], holder[order]
        base = np.array([size - less[k] for k in right.tolist()]) if less else 0
        n, own, spare, ids = self.n[right], self.own[right], self.spare[right], self.ids[right]
        out = []
        for k in left.tolist():
            begin, end = np.searchsorted(token, tokens[k], "left"), np.searchsorted(token, tokens[k], "right")
            many = end - begin
            at = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            common = np.bincount(holder[at], minlength=len(right)) + np.minimum(spare, self.spare[k])
            if less:
                common = common + base - less[k]
            near = (own != self.own[k]) & (100 * common >= self.percent * (self.n[k] + n - common))
            out += [(min(int(self.ids[k]), o), max(int(self.ids[k]), o)) for o in ids[near].tolist()]
        return out


def compared(blocks: DataFrame, percent: int) -> DataFrame:
    """u, v of all block pairs: rows of a block lie together, and are compared once its last row has come."""
    columns = ["bucket", "i", "j", "side", "id", "n", "component", "members"]

    def pairs(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = _Block(pa.Table.from_batches(parts), percent).pairs()
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def run(batches):
        key, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    now = tuple(keys[:, a].tolist())
                    if parts and now != key:
                        yield pairs(parts)
                        parts = []
                    key = now
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield pairs(parts)

    dealt = blocks.select(*columns).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def groups(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return _grouped(docs, policy).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def _grouped(docs: DataFrame, policy: Policy) -> DataFrame:
    """doc_id, t1, t2, n, component_id, kept and component (a number of its own; null for the empty set) for every row."""
    rows = written(sketched(docs, policy.words), "sketched")
    # One row a set, with a number of its own and the row of its smallest doc_id: doc_ids may be null, or have several sets.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2", "n", "registers")).alias("least")
    keys = rows.filter("n > 0").groupBy("k1", "k2").agg(least)
    sets = written(keys.select("k1", "k2", F.monotonically_increasing_id().alias("id"), "least.*"), "sets")
    buckets = banded(sets)
    # The centre is the set of the smallest doc_id: where copies follow their original, most meet it and become one component.
    shared = buckets.groupBy("bucket").agg(F.min("order").alias("centre"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(buckets.join(shared.select("bucket", "centre"), "bucket").select("bucket", "id", "order", "centre"), "buckets")
    candidates = members.select("id").distinct()
    wanted = sets.join(candidates, "id", "left_semi").select("id", F.col("doc_id").alias("_doc"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    here = texts(docs).select("doc_id", *_text_key(F.col("text"), "t1", "t2"), "text")
    same = here["doc_id"].eqNullSafe(wanted["_doc"]) & (here["t1"] == wanted["_t1"]) & (here["t2"] == wanted["_t2"])
    whole = written(here.join(wanted, same).select("id", "text").dropDuplicates(["id"]), "candidates")

    nearest = members.filter("order > centre").groupBy("id").agg(F.min("centre").alias("least")).select(F.col("least.id").alias("u"), F.col("id").alias("v"))
    found = _joined(candidates.select("id", F.col("id").alias("component")), verified(nearest, sets, whole, policy))
    stars = members.filter("order > centre").select(F.col("centre.id").alias("u"), F.col("id").alias("v")).distinct()
    found = _joined(found, verified(_apart(stars, found), sets, whole, policy))
    sized = members.select("bucket", "id").join(found, "id").join(sets.select("id", "n"), "id")
    blocks = _blocks(sized).join(short_members(whole, policy.words), "id")
    found = _joined(found, verified(written(compared(blocks, policy.percent), "compared"), sets, whole, policy, estimated=True))

    of_set = sets.select("k1", "k2", "id", "none", "doc_id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    tops = of_set.groupBy("component").agg(F.min(F.struct("none", "doc_id", "id")).alias("top"))
    tops = tops.select("component", F.col("top.doc_id").alias("component_id"), F.col("top.id").alias("first"))
    of_set = of_set.join(tops, "component").select("k1", "k2", "component", "component_id", (F.col("id") == F.col("first")).alias("on_top"))
    columns = ["doc_id", "t1", "t2", "n", "component_id", "kept", "component"]
    out = rows.filter("n > 0").join(of_set, ["k1", "k2"]).withColumn("kept", F.col("on_top") & F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*columns)
    alone = {"component_id": F.col("doc_id"), "kept": F.lit(True), "component": F.lit(None).cast("long")}
    return out.unionByName(rows.filter("n = 0").withColumns(alone).select(*columns))


def one_of_each(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The documents that stay, with all their columns: the smallest doc_id of each group, once.

    Of the rows without a word, those that repeat a doc_id count once; those without a doc_id all stay.
    """
    doc, t1, t2, component, once, apart = (fresh(docs, c) for c in ("kept_id", "kept_t1", "kept_t2", "kept_component", "kept_once", "kept_apart"))
    kept = _grouped(docs, policy).filter("kept").select(F.col("doc_id").alias(doc), F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("component").alias(component)).distinct()
    own = [F.xxhash64(F.lit(seed), F.coalesce(docs["text"].cast("string"), F.lit(""))) for seed in "ab"]
    rows = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept[doc]) & (own[0] == kept[t1]) & (own[1] == kept[t2]))
    empty = F.col(component).isNull()
    rows = rows.withColumns({once: F.when(empty, F.col(doc)), apart: F.when(empty & F.col(doc).isNull(), F.monotonically_increasing_id())})
    return rows.dropDuplicates([component, once, apart]).select(*docs.columns)


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose sets are in different components so far."""
    x = pairs.join(found.select(F.col("id").alias("u"), F.col("component").alias("cu")), "u")
    return x.join(found.select(F.col("id").alias("v"), F.col("component").alias("cv")), "v").filter("cu <> cv").select("u", "v")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after adding links between sets; found: id, component."""
    x = links.join(found.select(F.col("id").alias("u"), F.col("component").alias("cu")), "u")
    x = x.join(found.select(F.col("id").alias("v"), F.col("component").alias("cv")), "v").filter("cu <> cv")
    merged = components(x.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    after = found.join(merged.withColumnRenamed("node", "old").withColumnRenamed("component", "new"), F.col("component") == F.col("old"), "left")
    return written(after.select("id", F.coalesce("new", "component").alias("component")), "components")
