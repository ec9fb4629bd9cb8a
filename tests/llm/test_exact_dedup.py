"""The digest index: a hot text is one row before the anti-join, also in later batches."""

from ledgerlark.llm import exact_dedup


def test_groups_are_formed_before_the_anti_join(spark):
    docs = spark.createDataFrame([(n, "hot" if n % 3 else f"text {n}") for n in range(3000)], "doc_id long, text string")
    spark.sql("DROP TABLE IF EXISTS digest_index_of_a_plan")
    index = exact_dedup.DigestIndex(spark, "digest_index_of_a_plan", 4)
    try:
        exact_dedup.deduplicate(docs.filter("doc_id < 1500"), index).count()
        unseen = index.unseen(exact_dedup.groups_of(exact_dedup.digests(docs.filter("doc_id >= 1500"))))
        unseen.collect()
        plan = unseen._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "HashAggregate" not in plan and "sha2" not in plan  # the join reads groups that are written already
        assert unseen.count() == 500
        again = exact_dedup.deduplicate(docs.filter("doc_id >= 1500"), index)
        assert again.count() == 1500 and again.filter("kept").count() == 500
        assert index.read().count() == 1001 and exact_dedup.deduplicate(docs.limit(0), index).collect() == []
    finally:
        spark.sql("DROP TABLE IF EXISTS digest_index_of_a_plan")
