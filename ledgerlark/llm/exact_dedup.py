"""Exact deduplication by a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 digest of the text. A batch is reduced to one row
a digest and written, laid out in the same buckets, and deduplicated by a sort-merge anti-join: the index side is read as it
lies, without a shuffle. (Spark sorts a bucket again when reading it, unless it is known to be one file.) New digests are appended.

Defined results. Null and empty texts are equal (the empty text). Of equal texts the largest doc_id stays; rows
that repeat a doc_id with the same text are one document and share its fate. A null doc_id never stays unless its
group has no other id. Texts are never changed. An empty batch gives an empty result and leaves the index alone.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm.common import texts, written

ROWS_PER_BUCKET = 4_000_000


class DigestIndex:
    """Digest table of the texts seen so far: digest, keep_id, group_size; bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 16):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index does not hold. They are written first, as Spark would else move the anti-join below
        the grouping and shuffle every row of a hot text."""
        if not self.exists():
            return groups.repartition(self.buckets, "digest")
        laid = written(groups, "digest-groups").repartition(self.buckets, "digest")
        return laid.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add groups that the index does not hold yet. A batch given again adds nothing; an index has one writer at a time."""
        new = self.unseen(groups)
        if self.exists():
            new = written(new, "digest-batch").repartition(self.buckets, "digest")  # a table can't be read and written in one job
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the 32-byte digest of each text."""
    return texts(docs).select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))


def groups_of(rows: DataFrame) -> DataFrame:
    """One row a digest. Where this is read as it is, counts are combined before the shuffle, so a hot text costs one row a task."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Mark each document of a batch and append the batch's new digests to the index.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Texts that the index held before keep the index's
    document and size, so all their rows in this batch are dropped unless they are that document.
    """
    rows = written(digests(docs), "digests")
    index.append(groups_of(rows))
    # Read by path, not as a bucketed scan, so that both sides are shuffled.
    location = index.spark.sql(f"DESCRIBE FORMATTED {index.name}").filter("col_name = 'Location'").first()["data_type"]
    held = index.spark.read.schema(index.read().schema).parquet(location)
    return marked(rows, held)


def marked(rows: DataFrame, held: DataFrame) -> DataFrame:
    """The rows with their digest's document and size; both sides are shuffled, so a hot digest can be split at run time."""
    return rows.join(held, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate_once(docs: DataFrame) -> DataFrame:
    """deduplicate() of a whole table against an index of its own, which is dropped before the rows are returned.

    The table goes through the index in two batches, the larger doc_ids first, so a text that the index holds already keeps the
    right document: the second batch is anti-joined with the first one's digests and only new ones are appended. Rows without an id are
    in the second batch. Sizes are counted over both. The split point moves rows between batches and changes no result.
    """
    spark = docs.sparkSession
    rows = written(digests(docs), "digests")
    total, middle = rows.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", 0.5, 100)).first()
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", max(16, 2 ** math.ceil(math.log2(max(1, total) / ROWS_PER_BUCKET))))
    first = F.coalesce(F.col("doc_id") >= F.lit(middle), F.lit(False))
    try:
        for batch in (rows.filter(first), rows.filter(~first)):
            index.append(groups_of(batch))
        sizes = groups_of(rows).select("digest", "group_size").repartition(index.buckets, "digest")
        held = written(index.read().select("digest", "keep_id").hint("merge").join(sizes, "digest"), "digest-groups")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {index.name}")
    return marked(rows, held)
