"""Hard negatives of anchors, exactly, from inverted lists of k-means clusters with their radii.

1. Centroids are fitted on a bounded sample; every row is put on the list of its nearest centroid, and a list keeps the largest distance
   of its rows (its radius). Long lists, as those of copies, are cut into blocks of bounded size.
2. By Cauchy-Schwarz no row of a list scores above q.c + |q| r with an anchor q, nor below q.c - |q| r. Lists outside an anchor's windows are skipped.
3. An anchor visits its lists by that upper bound, in two waves: the first few lists give each window's kth score; then those of the rest
   whose bound is not strictly below it. So nothing is lost, whatever the clusters are.
4. A visit is a row that carries the anchor's vector to a list. The rows of a block and its visits lie together, block first; visits stream
   past it, so a task holds one block, not its anchors.

Positives are searched this way among rows of the anchor's label (one window without limits), negatives among the others (a window a positive).

Defined results. Rows without vec_id, label or vector, or with a null or non-finite component, take no part. Rows that repeat a vec_id all count; an
anchor's positives have another vec_id. Shorter vectors are as if filled with zeros. Ties go by vec_id. An empty table, or one without anchors, gives an
empty result. Scores must fit 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.llm.common import short_batches, written

#: Rows that the centroids are fitted on (those with the smallest hashes), the most centroids, and the rounds of fitting.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 512, 8
#: Rows of a block of a list, rows that are scored together, and lists of the first wave.
BLOCK, TOGETHER, FIRST = 262_144, 16_384, 4
#: Bounds are floating point: this much (relative to the vectors' lengths) is allowed for.
SLACK = 1e-9
LEAST, MOST = -(2**63) + 1, 2**63 - 1
FOUND = "query long, slot int, score long, id long"


@dataclass(frozen=True)
class Policy:
    positives: int = 5
    negatives: int = 10
    low: int = 30  # a negative's score as a percentage of its positive's, at least
    high: int = 90  # and at most


def quantized(vectors: DataFrame, label: Column, scale: float = 256.0) -> DataFrame:
    """vec_id, label, components (floor(scale * x) as long) of the rows that take part."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    components = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), components.alias("components"))


def kmeans(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids, begun at distinct vectors spread evenly over the sample; those left without a row go."""
    distinct = np.unique(sample, axis=0)
    centroids = distinct[np.unique(np.linspace(0, len(distinct) - 1, k).astype(int))].astype(float)
    for _ in range(rounds):
        own = nearest(sample, centroids)
        held = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = sums[held > 0] / held[held > 0, None]
    return centroids


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * (vectors @ centroids.T)).argmin(1)


@dataclass
class Lists:
    """What tasks need of the index: the shape of vectors, centroids, radii, and the number of blocks of each list."""

    dims: int
    kind: str  # of the packed components
    exact: bool  # whether sums of floating-point products are exact
    centroids: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray

    def padded(self, components) -> list[int]:
        return [*components, *[0] * (self.dims - len(components))]

    def matrix(self, packed: list[bytes]) -> np.ndarray:
        found = np.frombuffer(b"".join(packed), self.kind).reshape(len(packed), self.dims)
        return found.astype(float if self.exact else np.int64)

    def assigned(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """cluster, vec_id, label, vector, distance of rows (vec_id, label, components)."""
        vectors = np.array([self.padded(c) for c in batch.column(2).to_pylist()], np.int64).reshape(batch.num_rows, self.dims)
        own = nearest(vectors.astype(float), self.centroids)
        distance = np.sqrt(((vectors - self.centroids[own]) ** 2).sum(1))
        packed = pa.array([v.tobytes() for v in vectors.astype(self.kind)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch.column(0), batch.column(1), packed, pa.array(distance)], names=["cluster", "vec_id", "label", "vector", "distance"])

    def visited(self, batch: pa.RecordBatch, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, cluster and salt of each visit in the first wave or in the second."""
        x = batch.to_pydict()
        vectors = self.matrix(x["vector"]).astype(float)
        dots, size = vectors @ self.centroids.T, np.sqrt((vectors**2).sum(1))[:, None]
        reach = size * self.radii + SLACK * size * (self.radii + np.sqrt((self.centroids**2).sum(1))) + 1e-6
        upper, lower = dots + reach, dots - reach

        def within(floors: str) -> np.ndarray:
            least = np.array([min(v, default=MOST) for v in x[floors]], float)[:, None]
            most = np.array([max(v, default=LEAST) for v in x["highs"]], float)[:, None]
            return (self.blocks > 0) & (upper >= least) & (lower <= most)

        chosen = within("lows")
        place = np.where(chosen, -upper, np.inf).argsort(1, kind="stable").argsort(1)
        chosen &= (place < FIRST) if first else (place >= FIRST) & within("floors")
        row, cluster = np.nonzero(chosen)
        times = self.blocks[cluster]
        salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(row, times), np.repeat(cluster, times), salt

    def matches(self, held: tuple[np.ndarray, np.ndarray, list[bytes]], visits: pa.RecordBatch, same: bool, k: int):
        """query, slot, score, id: the first k rows of a block (ids, labels, vectors) in each window of its visits."""
        x = visits.select(["query", "vec_id", "label", "vector", "highs", "floors"]).to_pydict()
        anchors = self.matrix(x["vector"])
        for a in range(0, len(held[2]), TOGETHER):
            ids, labels, vectors = (h[a : a + TOGETHER] for h in held)
            scores = (anchors @ self.matrix(vectors).T).astype(np.int64)
            out: list[tuple] = []
            for q, own, label, highs, floors, score in zip(x["query"], x["vec_id"], x["label"], x["highs"], x["floors"], scores, strict=True):
                fits = (labels == label) & (ids != own) if same else labels != label
                at = np.flatnonzero(fits & (score >= min(floors)) & (score <= max(highs)))
                if len(at):
                    at = at[np.lexsort((ids[at], -score[at]))]
                    falling = -score[at]
                    for slot, (high, floor) in enumerate(zip(highs, floors, strict=True)):
                        begin, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -floor, "right")
                        some = at[begin : min(end, begin + k)]
                        out += [(q, slot, s, i) for s, i in zip(score[some].tolist(), ids[some].tolist(), strict=True)]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["query", "slot", "score", "id"])


def fitted(rows: DataFrame) -> tuple[Lists, int]:
    """The shape of the vectors and the centroids of a sample (radii and blocks to be set), and the number of rows."""
    top = F.max(F.array_max(F.transform("components", lambda x: F.abs(x))))
    many, dims, largest = rows.agg(F.count(F.lit(1)), F.max(F.size("components")), top).first()
    dims, largest = dims or 0, largest or 0
    kind = next(t for t, limit in (("<i2", 2**15 - 1), ("<i4", 2**31 - 1), ("<i8", 2**63)) if largest <= limit)
    lists = Lists(dims, kind, dims * largest**2 < 2**53, np.zeros((1, dims)), np.zeros(1), np.zeros(1, np.int64))
    if many:
        sample = rows.orderBy(F.xxhash64("vec_id", "components")).limit(SAMPLE).select("components").collect()
        lists.centroids = kmeans(np.array([lists.padded(r[0]) for r in sample], float), max(1, min(MOST_LISTS, int(many**0.5 / 2))))
    return lists, many


class Index:
    """The lists' rows (cluster, salt, vec_id, label, vector) and what tasks need of them."""

    def __init__(self, rows: DataFrame, block: int = BLOCK):
        short_batches(rows.sparkSession)
        lists, _ = fitted(rows)

        def assign(batches):
            yield from (lists.assigned(b) for b in batches if b.num_rows)

        own = rows.select("vec_id", "label", "components").mapInArrow(assign, "cluster int, vec_id long, label long, vector binary, distance double")
        own = written(own, "lists")
        of_list = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()  # at most MOST_LISTS rows
        lists.radii, lists.blocks = np.zeros(len(lists.centroids)), np.zeros(len(lists.centroids), np.int64)
        for r in of_list:
            lists.radii[r.cluster], lists.blocks[r.cluster] = r.radius, -(-r.n // block)
        blocks = rows.sparkSession.createDataFrame([(k, int(n)) for k, n in enumerate(lists.blocks)], "cluster int, blocks long")
        salt = F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("salt")
        self.lists, self.rows = lists, own.join(F.broadcast(blocks), "cluster").select("cluster", salt, "vec_id", "label", "vector")

    def visits(self, queries: DataFrame, first: bool) -> DataFrame:
        """cluster, salt and the query's columns, for the blocks that an anchor visits in the first wave or in the second.

        queries: query, vec_id, label, vector, lows, highs (its windows), floors (lowest scores that are still of use).
        """
        columns, lists = ["query", "vec_id", "label", "vector", "lows", "highs", "floors"], self.lists

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    rows, cluster, salt = lists.visited(batch, first)
                    for a in range(0, len(rows), 10_000):
                        part = batch.select(columns).take(pa.array(rows[a : a + 10_000]))
                        keys = [pa.array(v[a : a + 10_000], pa.int32()) for v in (cluster, salt)]
                        yield pa.RecordBatch.from_arrays(keys + part.columns, names=["cluster", "salt", *columns])

        shape = "cluster int, salt int, query long, vec_id long, label long, vector binary, lows array<long>, highs array<long>, floors array<long>"
        return queries.select(*columns).mapInArrow(run, shape)

    def scored(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """FOUND: the first k rows of each visited block in each of the anchor's windows."""
        columns, lists = ["cluster", "salt", "visit", "query", "vec_id", "label", "vector", "highs", "floors"], self.lists
        none = F.lit(None)
        rows = self.rows.withColumns({"visit": F.lit(False), "query": none.cast("long"), "highs": none.cast("array<long>"), "floors": none.cast("array<long>")})
        dealt = rows.select(*columns).unionByName(visits.withColumn("visit", F.lit(True)).select(*columns))
        dealt = dealt.repartition("cluster", "salt").sortWithinPartitions("cluster", "salt", "visit")

        def run(batches):
            key, parts, held = None, [], None
            for batch in batches:
                keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
                cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b == a:
                        continue
                    if tuple(keys[:2, a].tolist()) != key:
                        key, parts, held = tuple(keys[:2, a].tolist()), [], None
                    part = batch.slice(a, b - a)
                    if not keys[2, a]:
                        parts.append((part.column(4).to_numpy(), part.column(5).to_numpy(), part.column(6).to_pylist()))
                    elif parts:  # else the block has no row
                        if held is None:
                            held = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [v for p in parts for v in p[2]]
                        yield from lists.matches(held, part, same, k)

        return dealt.mapInArrow(run, FOUND)

    def search(self, queries: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """query, slot, rank, score, id: the first k rows in each window. queries: query, vec_id, label, vector, lows, highs."""
        queries = queries.withColumn("floors", F.col("lows"))
        some = written(ranked(self.scored(self.visits(queries, True), same, k), k), f"{name}_first")
        full = some.groupBy("query", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).filter(F.col("n") == k)
        kths = full.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kths"))  # an entry a window
        floors = F.transform("lows", lambda low, slot: F.greatest(low, F.coalesce(F.try_element_at("kths", slot), low)))
        rest = queries.drop("floors").join(kths, "query", "left").withColumn("floors", floors)
        more = self.scored(self.visits(rest, False), same, k)
        return written(ranked(some.drop("rank").unionByName(more), k), name)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of each query and slot, with their rank from 1."""
    order = Window.partitionBy("query", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _percent(a: Column, percent: int, up: bool) -> Column:
    """percent of whole numbers, rounded up or down, without products beyond 64 bits."""
    rest = F.pmod(a, F.lit(100))
    part = F.call_function("div", rest * percent + (99 if up else 0), F.lit(100))
    return F.call_function("div", a - rest, F.lit(100)) * percent + part


def mine(rows: DataFrame, anchor: Column, policy: Policy = Policy(), block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. rows: vec_id, label, components (integers)."""
    index = Index(rows, block)
    anchors = index.rows.filter(anchor).select(F.monotonically_increasing_id().alias("query"), "vec_id", "label", "vector")
    anchors = written(anchors, "anchors")
    whole = [F.array(F.lit(x).cast("long")).alias(name) for x, name in ((LEAST, "lows"), (MOST, "highs"))]
    positives = index.search(anchors.select("*", *whole), True, policy.positives, "positives")

    ordered = F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("found")  # at most policy.positives
    windows = positives.groupBy("query").agg(ordered)
    lows = F.transform("found", lambda p: _percent(p["score"], policy.low, True))
    highs = F.transform("found", lambda p: _percent(p["score"], policy.high, False))
    negatives = index.search(anchors.join(windows.select("query", lows.alias("lows"), highs.alias("highs")), "query"), False, policy.negatives, "negatives")
    of_positive = positives.select("query", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    of_anchor = anchors.select("query", F.col("vec_id").alias("anchor_id"))
    out = negatives.join(of_positive, ["query", "slot"]).join(of_anchor, "query")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND (a.label <> b.label OR a.vec_id <> b.vec_id)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER best)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER best <= 10"""
