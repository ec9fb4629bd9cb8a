"""Time-aware and text-aware joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.text import contains_phrase


def as_of(targets: DataFrame, history: DataFrame, key: str, cutoff: str, at: str, value: str, name: str) -> DataFrame:
    """For each target, the value of the key's last history row strictly before the cutoff; null if there is none.

    Both sides are laid in one ordered stream a key, so the work is a sort and not a range join; history at the cutoff itself
    comes after the target. Ties in history go to the largest value.
    """
    marked = targets.select(key, F.col(cutoff).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(history.schema[value].dataType).alias("_value"), F.struct(*targets.columns).alias("_row"))
    facts = history.select(key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.col(value).alias("_value"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy(key).orderBy("_at", "_kind", "_value").rowsBetween(Window.unboundedPreceding, -1)
    both = marked.unionByName(facts).withColumn(name, F.last("_value", ignorenulls=True).over(w))
    return both.filter("_kind = 0").select("_row.*", name)


def in_window(left: DataFrame, right: DataFrame, left_pair: tuple[str, str], right_pair: tuple[str, str], left_at: str, right_at: str, seconds: int) -> DataFrame:
    """Rows with the same unordered pair whose times lie at most so far apart."""
    a = left.withColumn("_pair", F.array_sort(F.array(*left_pair)))
    b = right.withColumn("_pair", F.array_sort(F.array(*right_pair)))
    gap = F.abs(F.unix_micros(F.col(left_at).cast("timestamp")) - F.unix_micros(F.col(right_at).cast("timestamp")))
    return a.join(b, "_pair").filter(gap <= seconds * 1_000_000).drop("_pair")


def _openings(text: Column, words: Column) -> Column:
    """Hashes of all runs of so many words in a text."""
    # the words are bound once by the outer transform, so that they are not split anew for each run
    return F.flatten(F.transform(F.array(F.split(text, " ")), lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, words), " ")))))


def phrase_owners(texts: DataFrame, phrases: DataFrame, text: str, phrase: str, owner: str, key: str, lead: int = 4) -> DataFrame:
    """(key, owner) where a text holds a phrase of one owner alone; phrases that several owners share say nothing.

    The hash of a phrase's first words (lead of them, or all of a shorter phrase) is an equi-join key with the runs of as many words in the
    texts. Texts travel only to be compared with phrases whose opening they hold. Texts without a key and empty phrases say nothing.
    """
    alone = phrases.groupBy(phrase).agg(F.count_distinct(owner).alias("_n"), F.min(owner).alias(owner)).filter("_n = 1").drop("_n")
    alone = alone.filter(F.length(phrase) > 0).withColumn("_n", F.least(F.size(F.split(phrase, " ")), F.lit(lead)))
    alone = alone.withColumn("_run", F.xxhash64(F.substring_index(phrase, " ", lead)))
    several = F.size(F.split(text, " "))
    runs = [F.when(several >= n, _openings(F.col(text), F.lit(n))) for n in range(1, lead + 1)]
    held = [texts.select(key, F.explode(F.array_distinct(runs[r["_n"] - 1])).alias("_run")) for r in alone.select("_n").distinct().sort("_n").collect()]  # at most lead lengths
    if not held:
        return texts.filter(F.lit(False)).select(key, F.lit(None).cast(phrases.schema[owner].dataType).alias(owner))
    found = reduce(DataFrame.unionByName, held).join(alone, "_run").select(key, owner, phrase).distinct()
    return found.join(texts, key).filter(contains_phrase(F.col(text), F.col(phrase))).select(key, owner).distinct()


def paired(a: DataFrame, b: DataFrame, key: str, outcome: str, score: str) -> DataFrame:
    """One row: how two scored models compare on the keys that both have with equal outcomes.

    paired, unpaired_a, unpaired_b, mismatches, mean_a, mean_b, mean_delta, a_lower, b_lower, equal.
    """
    x = a.select(key, F.col(outcome).alias("_oa"), F.col(score).alias("_sa"))
    y = b.select(key, F.col(outcome).alias("_ob"), F.col(score).alias("_sb"))
    z = x.join(y, key, "full_outer")
    both = F.col("_sa").isNotNull() & F.col("_sb").isNotNull()
    same = both & (F.col("_oa") == F.col("_ob"))
    n = F.count_if(same)

    def mean(c: Column) -> Column:
        return F.round(F.sum(F.when(same, c)) / F.nullif(n, F.lit(0)), 12).cast("decimal(20,12)")

    return z.agg(
        n.alias("paired"),
        (F.count("_sa") - n).alias("unpaired_a"),
        (F.count("_sb") - n).alias("unpaired_b"),
        F.count_if(both & (F.col("_oa") != F.col("_ob"))).alias("mismatches"),
        mean(F.col("_sa")).alias("mean_a"),
        mean(F.col("_sb")).alias("mean_b"),
        mean(F.col("_sa") - F.col("_sb")).alias("mean_delta"),
        F.count_if(same & (F.col("_sa") < F.col("_sb"))).alias("a_lower"),
        F.count_if(same & (F.col("_sa") > F.col("_sb"))).alias("b_lower"),
        F.count_if(same & (F.col("_sa") == F.col("_sb"))).alias("equal"),
    )


def differing_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two sets has, with the side: empty if the sets are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
