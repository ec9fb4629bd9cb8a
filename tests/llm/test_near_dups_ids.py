"""Near-duplicate groups where doc_ids are null or have several texts: no link and no document is lost."""

from collections import Counter

from ledgerlark.llm import near_dups

A = " ".join(f"a{i}" for i in range(60))
NEAR = A.replace("a59", "b59")
WORDS = near_dups.Policy(words=2)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_row_without_an_id_keeps_the_links(spark):
    docs = docs_of(spark, [(None, A), (5, A), (9, NEAR)])
    found = {r.doc_id: (r.component_id, r.kept) for r in near_dups.groups(docs, WORDS).collect()}
    assert found == {None: (5, False), 5: (5, True), 9: (5, False)}
    assert [tuple(r) for r in near_dups.one_of_each(docs, WORDS).collect()] == [(5, A)]


def test_documents_without_ids_stay_apart(spark):
    strangers = [(None, f"x{k} y{k} z{k}") for k in range(20)]
    docs = docs_of(spark, [*strangers, (None, A), (None, A), (None, NEAR), (None, ""), (None, None)])
    kept = Counter(r.text for r in near_dups.one_of_each(docs, WORDS).collect())
    assert all(kept.pop(t) == 1 for _, t in strangers)
    assert kept.pop("") == 1 and kept.pop(None) == 1
    assert len(kept) == 1 and set(kept.values()) == {1} and set(kept) <= {A, NEAR}


def test_texts_that_share_an_id(spark):
    other = " ".join(f"c{i}" for i in range(60))
    docs = docs_of(spark, [(5, A), (5, other), (5, other), (7, NEAR), (8, other.replace("c0 ", "d0 ")), (3, ""), (3, " ")])
    found = {(r.doc_id, r.component_id, r.kept) for r in near_dups.groups(docs, WORDS).collect()}
    assert found == {(5, 5, True), (7, 5, False), (8, 5, False), (3, 3, True)}
    kept = Counter(map(tuple, near_dups.one_of_each(docs, WORDS).collect()))
    assert kept.pop((5, A)) == 1 and kept.pop((5, other)) == 1
    assert sum(kept.values()) == 1 and next(iter(kept))[0] == 3
