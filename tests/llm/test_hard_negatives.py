"""Hard negatives against all pairs: random tables with ties, copies, odd rows, other numbers of lists and blocks."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import hard_negatives as hn
from ledgerlark.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchor, policy=hn.Policy()):
    """rows: (vec_id, label, components)."""
    out = Counter()
    for a, label, v in rows:
        if not anchor(a):
            continue
        score = lambda r, v=v: sum(x * y for x, y in zip(v, r[2], strict=False))
        same = sorted((-score(r), r[0]) for r in rows if r[1] == label and r[0] != a)[: policy.positives]
        other = sorted((-score(r), r[0]) for r in rows if r[1] != label)
        for p, positive in same:
            fits = [(-n, i) for n, i in other if policy.low * -p <= 100 * -n <= policy.high * -p][: policy.negatives]
            for rank, (n, i) in enumerate(fits, 1):
                out[a, positive, rank, i, -p, n] += 1
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, components array<long>")


@pytest.mark.parametrize(("dims", "spread", "block"), [(3, 4, 7), (8, 300, 1000), (2, 1, 5), (4, 40_000, 20)])
def test_against_all_pairs(spark, dims, spread, block):
    r = random.Random(dims)
    rows = [(k // 2 if k % 17 == 0 else k, r.randrange(4), [r.randint(-spread, spread) for _ in range(dims)]) for k in range(400)]
    rows += [(1000 + k, 1, [spread] * dims) for k in range(100)]  # a large group of copies
    got = hn.mine(table(spark, rows), F.col("vec_id") % 10 == 0, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == brute(rows, lambda a: a % 10 == 0)


def test_policy_and_short_vectors(spark):
    rows = [(k, k % 3, [k % 7, k % 5 - 2][: k % 3]) for k in range(90)]
    policy = hn.Policy(positives=2, negatives=3, low=10, high=100)
    got = hn.mine(table(spark, rows), F.col("vec_id") < 20, policy)
    assert Counter(map(tuple, got.collect())) == brute(rows, lambda a: a < 20, policy)


def test_large_scores_are_exact(spark):
    r = random.Random(3)
    rows = [(k, k % 2, [2**30 + r.randrange(50), r.randrange(50)]) for k in range(60)]
    policy = hn.Policy(low=90, high=100)
    got = hn.mine(table(spark, rows), F.col("vec_id") < 9, policy)
    assert Counter(map(tuple, got.collect())) == brute(rows, lambda a: a < 9, policy)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [0.1 * (k % 9), -0.2 * (k % 4), 0.3], k % 3) for k in range(300)]
    odd = [(300, None, 1), (400, [0.1, None, 0.2], 1), (500, [0.1, nan, 0.2], 1), (600, [0.1, -inf, 0.2], 1), (700, [0.1, 0.2, 0.3], None), (None, [0.1, 0.2, 0.3], 1)]
    docs = spark.createDataFrame(rows + odd + rows[:3], SCHEMA).withColumns({c: F.lit(c) for c in ("cluster", "salt", "score", "components", "query")})
    prepared = hn.quantized(docs, F.col("label"))
    exact = [(k, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for k, v, label in rows + rows[:3]]
    assert sorted(map(tuple, prepared.collect())) == sorted(exact)
    assert Counter(map(tuple, hn.mine(prepared, F.col("vec_id") % 100 == 0).collect())) == brute(exact, lambda a: a % 100 == 0)


def test_lists_outside_the_windows_are_skipped():
    lists = hn.Lists(1, "<i2", True, np.array([[100.0], [0.0], [-100.0]]), np.array([5.0, 5.0, 5.0]), np.array([1, 2, 1]))
    import pyarrow as pa

    query = {"query": [1], "vec_id": [1], "label": [1], "vector": [np.array([1], "<i2").tobytes()], "lows": [[-50]], "highs": [[50]], "floors": [[20]]}
    batch = pa.RecordBatch.from_pydict(query)
    assert [x.tolist() for x in lists.visited(batch, True)] == [[0, 0], [1, 1], [0, 1]]  # only the middle list, both of its blocks
    assert [x.tolist() for x in lists.visited(batch, False)] == [[], [], []]


def test_empty_tables(spark):
    rows = [(k, k % 2, [k]) for k in range(1, 50)]
    assert hn.mine(table(spark, rows), F.col("vec_id") < 0).collect() == []
    assert hn.mine(table(spark, rows).limit(0), F.lit(True)).collect() == []


def test_query(spark, sf_dir):
    from conftest import compare

    compare(spark, sf_dir, QUERIES["op11_hard_negatives"], ORACLE_SQL["op11_hard_negatives"])
