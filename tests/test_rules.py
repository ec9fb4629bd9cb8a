"""Rules of quotes, times and texts on literal inputs."""

from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators import joins, markets, matching


def wrong(spark, cases, schema, found):
    """The cases whose last column differs from what is found."""
    rows = spark.createDataFrame(cases, schema)
    return rows.filter(~found.eqNullSafe(F.col("expected"))).collect()


def test_quote_state(spark):
    cases = [
        (10.0, "0.40", "0.45", "fresh"),
        (900.9, "0.40", "0.45", "fresh"),
        (-5.0, "0.45", "0.45", "fresh"),
        (901.0, None, None, "stale"),  # age comes before all else
        (10.0, None, "0.45", "unusable"),
        (10.0, "0", "0.45", "unusable"),
        (10.0, "0.40", "1", "unusable"),
        (10.0, "0.46", "0.45", "unusable"),
    ]
    dec = lambda c: F.col(c).cast("decimal(10,4)")
    assert wrong(spark, cases, "age double, bid string, ask string, expected string", markets.quote_state(F.col("age"), dec("bid"), dec("ask"))) == []


def test_valid_book_checks_the_last_price(spark):
    cases = [("0.40", "0.45", "0.55", "0.60", "0.50", True), ("0.40", "0.45", "0.55", "0.60", "1.01", False), ("0.40", "0.45", "0.55", "0.60", None, True), ("0.46", "0.45", "0.55", "0.54", None, False), (None, None, None, None, None, True)]
    book = [F.col(c).cast("decimal(10,4)") for c in "abcde"]
    assert wrong(spark, cases, "a string, b string, c string, d string, e string, expected boolean", markets.valid_book(*book)) == []


def test_temporal_score(spark):
    cases = [(0, False, 1.0), (10800, False, 1.0), (10801, False, 0.85), (43201, False, 0.6), (86401, False, 0.3), (129600, False, 0.3), (129601, False, 0.0), (None, False, 0.0), (43200, True, 0.5525), (129601, True, 0.0)]
    assert wrong(spark, cases, "gap long, from_close boolean, expected double", matching.temporal_score(F.col("gap"), F.col("from_close")).cast("double")) == []


def test_confidence_is_decimal(spark):
    cases = [("1", "1", "1.0000"), ("0.95", "0.5525", "0.8308"), ("0.5", "0", "0.3500")]
    found = matching.confidence(F.col("team").cast("decimal(5,4)"), F.col("time").cast("decimal(5,4)")).cast("string")
    assert wrong(spark, cases, "team string, time string, expected string", found) == []


def test_texts(spark):
    keys = [("a", True), ("", False), ("-a", False), ("a" * 100, True), ("a" * 101, False), ("a.b_c:d-1", True), ("a b", False), ("a\n", False)]
    assert wrong(spark, keys, "k string, expected boolean", text.is_idempotency_key(F.col("k"))) == []
    tokens = [("_nba_ game", 1), ("nba2", 0), ("The NBA", 1), ("nfl-nba", 2), (None, None)]
    assert wrong(spark, tokens, "t string, expected int", text.tokens_found(F.col("t"), ["nba", "nfl"])) == []
    shares = [("0.1234", "+12.3%"), ("-0.05", "\u22125.0%"), ("0", "0.0%"), (None, "Unavailable"), ("0.0001", "+0.0%")]
    assert wrong(spark, shares, "v string, expected string", text.signed_percent(F.col("v").cast("decimal(10,4)"))) == []


def test_phrases_of_any_length(spark):
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b y"), (3, "b a"), (4, None), (5, ""), (6, "a b c d x a b c d e"), (7, "d")], "k int, t string")
    phrases = spark.createDataFrame([("p", "a b c d e"), ("q", "d"), ("r", "a b"), ("s", "shared words"), ("u", "shared words"), ("v", ""), ("w", "a b c d e f g")], "o string, phrase string")
    found = {tuple(r) for r in joins.phrase_owners(texts, phrases, "t", "phrase", "o", "k").collect()}
    assert found == {(1, "p"), (1, "q"), (1, "r"), (2, "r"), (6, "p"), (6, "q"), (6, "r"), (7, "q")}
    assert joins.phrase_owners(texts, phrases.filter("false"), "t", "phrase", "o", "k").count() == 0
