"""Landed pages that point to each other by cursors: a window's chain is followed from its first page, with a guard against
repeated cursors and a cap on pages; a collection of windows resumes at the first that is not whole.

Pages are read by Spark from any store. Only a window's cursors, not its items, are gathered in one row to follow the chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How a chain ends: its last page has no next cursor; a cursor comes again; the cap is reached; a page is not there, or is there twice with different next cursors.
COMPLETE, REPEATED, LIMIT, MISSING, CONFLICT = "complete", "repeated_cursor", "page_limit", "missing_page", "conflicting_page"


def chains(pages: DataFrame, window: str, cap: int, cursor: str = "cursor", following: str = "next_cursor") -> DataFrame:
    """window, status, path (the cursors of the pages in order; the first page's is empty). Null and empty cursors are the same.

    As the provider is asked: at most cap pages, each cursor once. A window without a first page has the status missing_page.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    links = pages.select(window, plain(cursor).alias("at"), plain(following).alias("to")).distinct()
    first = links.groupBy(window, "at").agg(F.min("to").alias("to"), (F.count(F.lit(1)) > 1).alias("conflict"))
    held = first.groupBy(window).agg(F.map_from_entries(F.collect_list(F.struct("at", "to"))).alias("next"), F.bool_or("conflict").alias("conflict"))
    empty = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("status"))

    def step(state: Column, _: Column) -> Column:
        at, path = state["at"], state["path"]
        to = F.try_element_at(F.col("next"), at)
        longer = F.concat(path, F.array(at))
        status = F.when(to.isNull(), MISSING).when(to == "", COMPLETE).when(F.array_contains(longer, to), REPEATED)
        moved = F.struct(F.coalesce(to, F.lit("")).alias("at"), F.when(to.isNull(), path).otherwise(longer).alias("path"), status.alias("status"))
        return F.when(state["status"].isNotNull(), state).otherwise(moved)

    found = held.withColumn("end", F.aggregate(F.sequence(F.lit(1), F.lit(cap)), empty, step))
    status = F.when(F.col("conflict"), CONFLICT).otherwise(F.coalesce("end.status", F.lit(LIMIT)))
    return found.select(window, status.alias("status"), F.col("end.path").alias("path"))


def items(pages: DataFrame, found: DataFrame, window: str, cursor: str = "cursor", column: str = "items") -> DataFrame:
    """window, page, place and the items of whole chains, in the order of the pages; windows with another status give none."""
    order = found.filter(F.col("status") == COMPLETE).select(window, F.posexplode("path").alias("page", "_at"))
    rows = pages.withColumn("_at", F.coalesce(F.col(cursor).cast("string"), F.lit(""))).dropDuplicates([window, "_at"])
    return rows.join(order, [window, "_at"]).select(window, "page", F.posexplode(column).alias("place", "item"))


def last_of_each(rows: DataFrame, window: str, key: Column) -> DataFrame:
    """key, item: of an item that occurs on several pages of a window the last one counts."""
    return rows.groupBy(window, key.alias("key")).agg(F.max_by("item", F.struct("page", "place")).alias("item"))


def resumed(windows: DataFrame, start: str, end: str, status: str, most: int) -> DataFrame:
    """One row: windows_completed, completed, next_start and failure of a run over windows in their order.

    A run takes at most so many windows and stops at the first that is not complete (a missing status has not been collected); it resumes there.
    """
    order = Window.orderBy(start)  # windows are a plan, a row a month or so
    numbered = windows.select(start, end, status).withColumn("_n", F.row_number().over(order))
    bad = numbered.filter(~F.col(status).eqNullSafe(F.lit(COMPLETE)) & (F.col("_n") <= most)).agg(F.min(F.struct("_n", start, F.coalesce(status, F.lit("not_collected")).alias("why"))).alias("bad"))
    whole = numbered.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_n") == most + 1, F.col(start))).alias("after"))
    out = whole.crossJoin(bad)  # one row each
    done = F.coalesce(F.col("bad._n") - 1, F.least("n", F.lit(most)))
    return out.select(done.cast("long").alias("windows_completed"), (F.col("bad").isNull() & (F.col("n") <= most)).alias("completed"), F.coalesce(F.col(f"bad.{start}"), F.col("after")).alias("next_start"), F.col("bad.why").alias("failure"))
