"""Near-duplicate groups against all pairs of whole sets."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import near_dups
from ledgerlark.llm.common import table


def sets_of(text, words):
    found = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute(rows, words=5, percent=80):
    """doc_id -> (set size, component)."""
    sets = {}
    for doc_id, text in rows:
        sets[doc_id] = sets_of(text, words)
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, ids = {}, sorted(sets)
    for i in ids:
        near = {j for s in sets[i] for j in holders.get(s, ())}
        for j in near:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    return {i: (len(sets[i]), top(i)) for i in ids}


def check(docs, words=2):
    rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
    expected = brute(rows, words)
    found = near_dups.groups(docs, near_dups.Policy(words=words)).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("words", [2, 5])
def test_whole_table(spark, sf_dir, words):
    check(table(spark, sf_dir, "documents"), words)


def test_chain_of_near_copies(spark):
    """Texts that drift: neighbours are similar, the ends are not; many strangers share most of their words."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(40):
        drift = [f"d{i}" if i < k else w for i, w in enumerate(base)]
        rows.append((k, " ".join(drift)))
    for k in range(300):
        rows.append((1000 + k, " ".join(f"x{k}.{i}" if i % 7 == 0 else w for i, w in enumerate(base))))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "ONE\ttwo"), (8, "É a"), (9, "é a"), (10, "a " * 50_000), (11, "a a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "component": F.lit("x"), "n": F.lit(None).cast("int")})
    check(docs)
    kept = near_dups.one_of_each(docs)
    assert kept.columns == docs.columns
    empty = docs.filter("doc_id < 0")
    assert near_dups.groups(empty).count() == 0
    assert near_dups.one_of_each(empty).count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    found = sorted(tuple(r) for r in near_dups.groups(docs, near_dups.Policy(words=2)).collect())
    assert found == [(1, 5, 1, True), (1, 5, 1, True), (2, 5, 1, False)]
    assert [r.doc_id for r in near_dups.one_of_each(docs).collect()] == [1]


@pytest.mark.parametrize(("size", "changed"), [(120, 0.03), (120, 0.08), (40, 0.5)])
def test_blocks_find_every_similar_pair(size, changed):
    """Groups of near copies, larger and smaller sets and strangers: nothing that reaches the threshold is left out, little more is found."""
    import random

    import numpy as np
    import pyarrow as pa

    r = random.Random(size)
    pools = [r.sample(range(2**32), size) for _ in range(3)]
    sets = []
    for k in range(90):
        base = pools[k % 3][: size - k % 7]
        sets.append(np.array([r.randrange(2**32) if r.random() < changed else x for x in base] + ([base[0]] if k % 11 == 0 else []), "<u4"))
    sides = [r.choice((near_dups.FIRST, near_dups.SECOND, near_dups.FIRST | near_dups.SECOND)) for _ in sets]
    rows = pa.table({"id": range(90), "n": list(map(len, sets)), "component": [k // 2 for k in range(90)], "side": sides, "members": pa.array([s.tobytes() for s in sets], pa.binary())})
    found, expected = set(near_dups._Block(rows, 80).pairs()), set()
    for a in range(90):
        for b in range(90):
            if sides[a] & near_dups.FIRST and sides[b] & near_dups.SECOND and a // 2 != b // 2:
                both = len(np.intersect1d(sets[a], sets[b])) + min(len(sets[a]) - len(set(sets[a].tolist())), len(sets[b]) - len(set(sets[b].tolist())))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    expected.add((min(a, b), max(a, b)))
    assert found == expected
    assert bool(expected) == (changed < 0.1)
