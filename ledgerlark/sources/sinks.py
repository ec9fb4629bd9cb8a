"""Tables that only grow by new facts: upsert, append, append on change, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.keys import canonical_json


def last_of_batch(batch: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of rows with the same key the last by position."""
    others = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(position)).alias("_r")).select(*keys, "_r.*")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], first_seen: str, last_seen: str) -> DataFrame:
    """The table after an upsert: the newest values, the first time a key was seen. At equal times the new batch wins."""
    others = [c for c in old.columns if c not in (*keys, first_seen)]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    merged = both.groupBy(*keys).agg(F.min(first_seen).alias(first_seen), F.max_by(F.struct(*others), F.struct(last_seen, "_new")).alias("_r"))
    return merged.select(*keys, first_seen, "_r.*").select(*old.columns)


def unseen(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key the table does not hold, once each. Rows with the same key must be equal."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def append(path: str, old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Append unseen rows as Parquet; (inserted, replayed)."""
    offered = new.dropDuplicates(keys).count()
    rows = unseen(old, new, keys)
    inserted = rows.count()
    if inserted:
        rows.write.mode("append").parquet(path)
    return inserted, offered - inserted


def changed(old: DataFrame, new: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """New observations that differ from the one before them, be it held or new: going back to an older value is a change."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(at, "_new")
    now = F.struct(*values)
    rows = both.withColumn("_before", F.lag(now).over(w)).filter((F.col("_new") == 1) & (F.col("_before").isNull() | ~F.col("_before").eqNullSafe(now)))
    return rows.drop("_new", "_before")


def export(df: DataFrame, metadata: dict[str, str], path: str, kind: str = "csv") -> str:
    """Write rows with the metadata repeated in each, and return the export's fingerprint."""
    out = df.withColumns({k: F.lit(v) for k, v in sorted(metadata.items())})
    writer = out.write.mode("errorifexists")
    writer.option("header", True).csv(path) if kind == "csv" else writer.json(path)
    return set_fingerprint(out).first()["fingerprint"]


def set_fingerprint(df: DataFrame) -> DataFrame:
    """One row: n and a fingerprint of all rows, whatever their order: the digest of the sums of the rows' digests.

    Sums combine before the shuffle, so no task ever holds all rows.
    """
    row = F.sha2(canonical_json(**{c: F.col(c).cast("string") for c in df.columns}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return df.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("0")) for p in parts]), 256).alias("fingerprint"))
