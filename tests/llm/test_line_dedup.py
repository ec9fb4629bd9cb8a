"""Line dedup where most lines are unique, or many documents have no id: no group of rows grows with the table."""

from collections import Counter

from pyspark.sql import functions as F

from ledgerlark.llm import line_dedup


def mostly_unique(spark):
    """4,000 documents of 5 lines of their own; every eighth also holds one of 10 common lines; a third without an id."""
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.concat(F.lit("a line of its own "), F.col("id"), F.lit("."), k)), "\n")
    common = F.when(F.col("id") % 8 == 0, F.concat(F.lit("\nevery page has this line "), F.col("id") % 10)).otherwise("")
    return spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(own, common).alias("text"))


def test_shards_follow_the_probes(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PROBES_PER_SHARD", 500)
    docs = mostly_unique(spark)
    keys = line_dedup.written(line_dedup.keys_of(docs, 16), "line-keys")
    index, shards = line_dedup.build_index(keys)
    assert shards >= keys.count() / 500 > 16
    biggest = keys.groupBy(F.pmod("h1", F.lit(shards)).alias("s")).count().agg(F.max("count")).collect()[0][0]
    assert biggest < 1000
    rows, held = [(line_dedup.NO_ID if r[0] is None else r[0], r[1]) for r in docs.collect()], {}
    for i, text in rows:
        for line in text.split("\n"):
            held.setdefault(line, set()).add(i)
    expected = Counter((i, "\n".join(x for x in t.split("\n") if min(held[x]) == i)) for i, t in rows)
    found = line_dedup.drop_repeated_lines(docs).collect()
    assert Counter((line_dedup.NO_ID if r.doc_id is None else r.doc_id, r.text) for r in found) == expected


def test_shards_of_a_large_table():
    assert 600_000_000 / line_dedup.shards_for(1_500_000, 600_000_000) <= 1_000_000
    assert line_dedup.shards_for(5_000_000, 5_000_000) == 50


def test_rows_without_an_id_are_dealt(spark):
    docs = mostly_unique(spark)
    blocks = {r[0] for r in line_dedup.keys_of(docs.filter("doc_id is null"), 16).select("block").distinct().collect()}
    assert len(blocks) == 16
