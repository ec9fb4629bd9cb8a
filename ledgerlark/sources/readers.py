"""Readers with explicit schemas: nested JSON pages, strict CSV, window plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators.rules import cascade

MARKETS = "page int, cursor string, events array<struct<event_ticker string, title string, markets array<struct<ticker string, title string, yes_sub_title string, no_sub_title string, status string, market_type string, result string, yes_bid string, yes_ask string, no_bid string, no_ask string, last_price string, close_time string, settlement_time string, settlement_value string>>>>"
GAMES = "dates array<struct<date string, games array<struct<gamePk long, gameDate string, status string, abstract string, code string, home struct<id long, name string, score int>, away struct<id long, name string, score int>>>>>"
PITCHES = "game_pk long, at_bat_number int, pitch_number int, game_date date, game_type string, pitcher long, batter long, events string, type string, release_speed decimal(8,3), release_spin_rate decimal(10,3), launch_speed decimal(8,3), launch_speed_angle int, estimated_woba_using_speedangle decimal(8,6), woba_value decimal(8,6), woba_denom decimal(8,6)"


def number(c: Column, kind: str = "decimal(10,4)") -> Column:
    """A number from text; empty or malformed text is null."""
    return F.nullif(F.trim(c), F.lit("")).try_cast(kind)


def market_pages(spark: SparkSession, path: str, retrieved: Column | None = None) -> DataFrame:
    """Landed pages of events with nested markets, a row a market: of a ticker that occurs on several pages the last page counts.

    retrieved: when the pages were landed, now if it is not given.
    """
    pages = spark.read.schema(MARKETS).option("mode", "FAILFAST").json(path)
    return markets_of(pages, F.current_timestamp() if retrieved is None else retrieved)


def markets_of(pages: DataFrame, retrieved: Column) -> DataFrame:
    rows = pages.select("page", F.posexplode("events").alias("_e", "event")).select("page", "_e", F.col("event.event_ticker").alias("event_ticker"), F.col("event.title").alias("event_title"), F.posexplode("event.markets").alias("_m", "market"))
    last = rows.groupBy(F.col("market.ticker").alias("ticker")).agg(F.max_by(F.struct("event_ticker", "event_title", "market"), F.struct("page", "_e", "_m")).alias("r"))
    m = F.col("r.market")
    quotes = {k: number(m[k]) for k in ("yes_bid", "yes_ask", "no_bid", "no_ask", "last_price")}
    some = F.coalesce(*[q.cast("string") for q in quotes.values()]).isNotNull()
    return last.select(
        "ticker",
        F.col("r.event_ticker").alias("event_ticker"),
        F.coalesce(F.nullif(m["title"], F.lit("")), F.nullif(m["yes_sub_title"], F.lit("")), F.nullif(F.col("r.event_title"), F.lit("")), F.col("ticker")).alias("title"),
        F.lower(m["status"]).alias("status"),
        F.array(F.struct(F.lit("yes").alias("side"), m["yes_sub_title"].alias("label")), F.struct(F.lit("no").alias("side"), m["no_sub_title"].alias("label"))).alias("outcomes"),
        F.when(some, F.struct(*[q.alias(k) for k, q in quotes.items()])).alias("price"),
        official_resolution(m["status"], m["market_type"], m["result"], number(m["settlement_value"], "decimal(7,6)"), F.to_timestamp(F.nullif(m["settlement_time"], F.lit(""))), retrieved).alias("resolution"),
        F.to_timestamp(F.nullif(m["close_time"], F.lit(""))).alias("close_time"),
    )


def official_resolution(status: Column, market_type: Column, result: Column, payout: Column, settled: Column, retrieved: Column) -> Column:
    """(yes_payout, no_payout, settled_at) of a settled binary market; null if anything is missing or off.

    The payout is never inferred: yes comes with 1, no with 0, scalar with a payout between them, settled no later than retrieved.
    """
    said = F.lower(F.trim(result))
    agrees = ((said == "yes") & (payout == 1)) | ((said == "no") & (payout == 0)) | ((said == "scalar") & (payout > 0) & (payout < 1))
    ok = F.lower(F.trim(status)).isin("finalized", "settled") & (F.lower(F.trim(market_type)) == "binary") & agrees & (settled <= retrieved)
    return F.when(ok, F.struct(payout.cast("decimal(7,6)").alias("yes_payout"), (1 - payout).cast("decimal(7,6)").alias("no_payout"), settled.alias("settled_at")))


def games(spark: SparkSession, path: str) -> DataFrame:
    """A schedule: dates hold games. Scores only of live and final games."""
    pages = spark.read.schema(GAMES).option("mode", "FAILFAST").json(path)
    rows = pages.select(F.explode("dates").alias("d")).select(F.explode("d.games").alias("g"))
    state = official_status(F.col("g.status"), F.col("g.abstract"), F.col("g.code"))
    score = lambda side: F.when(state.isin("live", "final"), F.col(f"g.{side}.score"))
    return rows.select(
        F.col("g.gamePk").alias("game_id"), F.to_timestamp("g.gameDate").alias("starts"), F.to_date(F.from_utc_timestamp(F.to_timestamp("g.gameDate"), "America/New_York")).alias("event_date"), state.alias("status"), F.col("g.home.id").alias("home"), F.col("g.away.id").alias("away"), score("home").alias("home_score"), score("away").alias("away_score")
    ).dropDuplicates(["game_id"])


#: How a game in play is shown, beside its period.
PLAYING = ("1st qtr", "2nd qtr", "halftime", "3rd qtr", "4th qtr", "overtime")


def game_status(status: Column, postponed: Column, period: Column, starts: Column, retrieved: Column) -> Column:
    """State of a game whose status is a text for display: a clock or a future start means scheduled."""
    s = F.lower(F.trim(status))
    return F.coalesce(
        cascade(
            ("postponed", F.coalesce(postponed, F.lit(False)) | s.contains("postpon")),
            ("canceled", s.contains("cancel")),
            ("final", s.startswith("final")),
            ("live", (F.coalesce(period, F.lit(0)) > 0) | s.isin(*PLAYING)),
            ("scheduled", s.contains(":") | s.isin("scheduled", "tbd") | F.coalesce(starts > retrieved, F.lit(False))),
        ),
        F.lit("unknown"),
    )


def official_status(detailed: Column, abstract: Column, code: Column) -> Column:
    """State of a game of the official schedule, by its detailed and abstract state and its code."""
    word = lambda c: F.lower(F.coalesce(c, F.lit("")))
    detail, state, letter = word(detailed), word(abstract), word(code)
    return F.coalesce(
        cascade(
            ("postponed", detail.contains("postpon") | detail.contains("suspend")),
            ("canceled", detail.contains("cancel")),
            ("final", (state == "final") | letter.isin("f", "o")),
            ("live", (state == "live") | letter.isin("i", "m")),
            ("scheduled", (state == "preview") | letter.isin("p", "s")),
        ),
        F.lit("unknown"),
    )


def pitches(spark: SparkSession, path: str) -> DataFrame:
    """Pitch observations from CSV: malformed rows stop the read, empty cells are null."""
    return spark.read.schema(PITCHES).option("mode", "FAILFAST").option("header", True).option("nullValue", "").option("encoding", "UTF-8").option("enforceSchema", False).csv(path)


def pitch_violations(rows: DataFrame, first, last, game_types: tuple[str, ...] = ("R",)) -> DataFrame:
    """subject, code: repeated pitches, dates outside the window, other kinds of games."""
    key = F.concat_ws("|", "game_pk", "at_bat_number", "pitch_number")
    twice = rows.groupBy(key.alias("subject")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("subject", F.lit("duplicate_pitch").alias("code"))
    outside = rows.filter(~F.col("game_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(key.alias("subject"), F.lit("outside_window").alias("code"))
    other = rows.filter(~F.col("game_type").isin(*game_types)).select(key.alias("subject"), F.lit("game_type").alias("code"))
    return twice.unionByName(outside).unionByName(other)


def windows(spark: SparkSession, first: str, last: str, days: int = 31) -> DataFrame:
    """Inclusive windows of at most so many days that cover first to last."""
    starts = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"interval {days} days"))
    rows = spark.range(1).select(F.explode(starts).alias("window_from"))
    return rows.select("window_from", F.least(F.date_add("window_from", days - 1), F.lit(last).cast("date")).alias("window_to"))


def guard_span(first, last, most_days: int) -> None:
    """Refuse ranges that are reversed or too long."""
    if last < first:
        raise ValueError("the range ends before it begins")
    if (last - first).days + 1 > most_days:
        raise ValueError(f"the range has more than {most_days} days")
