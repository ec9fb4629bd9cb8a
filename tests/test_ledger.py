"""Largest affordable quantities and capped entries against plain loops."""

import random
from decimal import ROUND_UP, Decimal

from pyspark.sql import functions as F

from ledgerlark.operators import ledger

CENT = Decimal("0.01")


def total(price, quantity, fee):
    gross = (price * quantity).quantize(CENT, ROUND_UP)
    return gross + (gross * fee).quantize(CENT, ROUND_UP)


def test_affordable_is_the_largest(spark):
    rng = random.Random(3)
    cases = [(str(Decimal(rng.randint(1, 10 ** rng.randint(1, 6) - 1)).scaleb(-6)), str(Decimal(rng.randint(0, 10 ** rng.randint(1, 9))).scaleb(-2))) for _ in range(2000)] + [("0", "5"), (None, "5"), ("0.5", None), ("0.5", "-1"), ("0.000001", "0.01")]
    rows = spark.createDataFrame(cases, "price string, capital string").select(F.col("price").cast("decimal(10,6)").alias("p"), F.col("capital").cast("decimal(18,2)").alias("c"))
    for fee in ("0.02", "0"):
        for r in rows.withColumn("q", ledger.affordable(F.col("p"), F.col("c"), fee)).collect():
            if not r["p"] or r["c"] is None or r["c"] < 0:
                assert r["q"] == 0
            else:
                assert total(r["p"], r["q"], Decimal(fee)) <= r["c"] < total(r["p"], r["q"] + 1, Decimal(fee))


def test_capped_entries(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), n, None if n % 17 == 0 else rng.randint(1, 500) / 100) for n in range(300)]
    df = spark.createDataFrame(rows, "k string, n int, amount double")
    found = ledger.capped_entries(df, "k", ["n"], "amount", F.lit(100), F.lit(4)).collect()
    totals, expected = {}, {}
    for k, n, amount in rows:
        fits = amount is not None and amount <= 4 and round(totals.get(k, 0) + amount, 2) <= 100
        totals[k] = round(totals.get(k, 0) + (amount if fits else 0), 2)
        expected[n] = (k, fits, totals[k])
    assert {r["n"]: (r["k"], r["accepted"], float(r["committed"])) for r in found} == expected
