"""Matching free-text contracts to events: scores, margins and ordered outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlark.functions.rounding import clamp, half_up

MATCH, MARGIN, WINDOW_HOURS = 0.90, 0.10, 36
# Hours of distance and their scores, the score of the rest of the window, the share of times
# taken from a market's close, and the weights of team and time.
STEPS = ((3, "1.00"), (12, "0.85"), (24, "0.60"))
REST, FROM_CLOSE = "0.30", "0.65"
TEAM_WEIGHT, TIME_WEIGHT = "0.70", "0.30"


def _fixed(value: str) -> Column:
    return F.lit(value).cast("decimal(3,2)")


def temporal_score(gap_seconds: Column, from_close: Column, window_hours: int = WINDOW_HOURS) -> Column:
    """By distance in time, nothing outside the window or without a time; times taken from a market's close count less."""
    score = F.when(~F.coalesce(gap_seconds <= window_hours * 3600, F.lit(False)), _fixed("0.00"))
    for hours, value in STEPS:
        score = score.when(gap_seconds <= hours * 3600, _fixed(value))
    score = score.otherwise(_fixed(REST))
    return F.when(from_close, half_up((score * _fixed(FROM_CLOSE)).cast("decimal(8,4)"), 4)).otherwise(score).cast("decimal(5,4)")


def confidence(team: Column, temporal: Column) -> Column:
    """Weighted sum of both scores in decimals, to four digits."""
    whole = team.cast("decimal(12,6)") * _fixed(TEAM_WEIGHT) + temporal.cast("decimal(12,6)") * _fixed(TIME_WEIGHT)
    return half_up(clamp(whole, 0, 1).cast("decimal(20,10)"), 4).cast("decimal(5,4)")


def ranked(candidates: DataFrame, market: str, event: str, score: str) -> DataFrame:
    """Per market: best event, its score, and the runner-up's: confidence first, then the smaller id."""
    w = Window.partitionBy(market).orderBy(F.col(score).desc(), F.col(event).asc())
    top = candidates.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    return top.groupBy(market).agg(
        F.max(F.when(F.col("_n") == 1, F.col(event))).alias("best"),
        F.max(F.when(F.col("_n") == 1, F.col(score))).alias("best_score"),
        F.max(F.when(F.col("_n") == 2, F.col(score))).alias("second_score"),
    )


def outcome(signals: Column, pair_events: Column, in_window: Column, has_time: Column, best: Column, second: Column) -> tuple[Column, Column]:
    """(status, reason) of a market, by precedence; nulls of counts mean none."""
    pairs, near, n = (F.coalesce(c, F.lit(0)) for c in (pair_events, in_window, signals))
    reason = (
        F.when(n < 2, "insufficient_team_evidence")
        .when(n > 2, "non_single_game_market")
        .when(pairs == 0, "no_team_pair_event")
        .when(~has_time, "team_pair_only")
        .when(near == 0, "date_mismatch")
        .when(best < MATCH, "low_confidence")
        .when((best - second) < MARGIN, "small_margin")
        .otherwise("matched")
    )
    status = F.when(reason == "matched", "matched").when(reason.isin("team_pair_only", "low_confidence", "small_margin"), "ambiguous").otherwise("unmatched")
    return status, reason


def orientation(yes_label: Column, no_label: Column, home_aliases: Column, away_aliases: Column) -> Column:
    """home or away: the team that YES pays on, from either label; null if labels name both or neither."""
    yes = F.when(F.array_contains(home_aliases, yes_label), "home").when(F.array_contains(away_aliases, yes_label), "away")
    no = F.when(F.array_contains(home_aliases, no_label), "away").when(F.array_contains(away_aliases, no_label), "home")
    return F.when(yes.isNotNull() & no.isNotNull() & (yes != no), F.lit(None).cast("string")).otherwise(F.coalesce(yes, no))


def contract_parts(ticker: Column) -> dict[str, Column]:
    """Series, date, pair and side of a ticker like KXNFLGAME-26SEP13DALNYG-DAL; nulls if it has another form."""
    from ledgerlark.functions.times import contract_date

    form = r"^([A-Z]+)-(\d{2}[A-Z]{3}\d{2})([A-Z]{4,6})-([A-Z]{2,3})$"
    part = lambda n: F.nullif(F.regexp_extract(ticker, form, n), F.lit(""))
    return {"series": part(1), "day": contract_date(part(2)), "pair": part(3), "side": part(4)}
