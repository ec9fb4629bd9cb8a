"""Sequential ratings: exact Elo a game at a time, and a week at a time.

A rating depends on all games before it, so each league is one ordered fold; leagues run in parallel. The games of a league
stream through its fold in order: a task holds the ratings of the teams, not the games. Frozen ratings are applied by joins.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from datetime import UTC, datetime
from decimal import ROUND_HALF_UP, Context, Decimal, localcontext
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

EXACT = Context(prec=40, rounding=ROUND_HALF_UP)
FORECAST = "league string, game_id long, home_rating decimal(12,4), away_rating decimal(12,4), p_home decimal(7,6), p_away decimal(7,6), games_used long, skipped_tie long, skipped_incomplete long, training_sha256 string"


def folded(games: DataFrame, order: list, fold: Callable[[], Callable], schema: str) -> DataFrame:
    """Each league's rows, in order, through a fold of its own: fold() gives a function from a row's values to the values of a result."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(T._parse_datatype_string(schema))
    dealt = games.repartition("league").sortWithinPartitions("league", *order)

    def run(batches):
        league, step = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step is None or row[0] != league:
                    league, step = row[0], fold()
                out.append(step(*row))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], f.type) for n, f in enumerate(kind)], schema=kind)

    return dealt.mapInArrow(run, schema)


@lru_cache(maxsize=200_000)
def chance(lead: Decimal, scale: Decimal) -> Decimal:
    """The home side's, by its lead in rating, in EXACT's digits. Leads have four digits and recur, above all among games of one instant."""
    with localcontext(EXACT):
        return 1 / (1 + Decimal(10) ** (-lead / scale))


def expectation(home: Decimal, away: Decimal, advantage: Decimal, scale: Decimal) -> Decimal:
    return chance(home + advantage - away, scale).quantize(Decimal("0.000001"))


# The names under which a game enters the rolling hash, and those of what became of it.
BECAME = {"used": "processed", "tie": "skipped_tie", "incomplete": "skipped_incomplete"}


_CANONICAL = json.JSONEncoder(sort_keys=True, separators=(",", ":"))


@lru_cache(maxsize=16)
def _in_utc(at: datetime) -> str:
    return (at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)).isoformat()


def game_line(game_id, starts, home, away, home_score, away_score, kind: str) -> bytes:
    """A game as canonical JSON (keys in order, no spaces, ids as text, the start in UTC) and a line end."""
    game = {"event_id": str(game_id), "scheduled_start_time": _in_utc(starts), "home_team_id": str(home), "away_team_id": str(away), "home_score": home_score, "away_score": away_score, "disposition": BECAME[kind]}
    return _CANONICAL.encode(game).encode() + b"\n"


def replay(k: int = 20, advantage: int = 100, scale: int = 400, start: int = 1500) -> Callable:
    """Forecast every game of a league from the games that began strictly before it.

    A fold over league, game_id, starts, home, away, home_score, away_score (null: not played). Ratings have four digits, probabilities
    six, halves go up. Ties and games without scores change nothing but are counted. training_sha256 is the rolling hash of the lines of all
    games before. A game without a start is forecast last and trains nothing.
    """
    four = Decimal("0.0001")
    now: dict = {}  # ratings after every game so far
    then: dict = {}  # of the teams that played at this instant, the ratings before it
    count = {"used": 0, "tie": 0, "incomplete": 0}
    hasher, instant, before = hashlib.sha256(), None, (0, 0, 0, hashlib.sha256().hexdigest())

    def step(league, game_id, starts, home, away, home_score, away_score):
        nonlocal instant, before
        with localcontext(EXACT):
            if starts is not None and starts != instant:
                instant, before = starts, (*count.values(), hasher.hexdigest())
                then.clear()
            h, a = (then.get(t, now.get(t, Decimal(start))).quantize(four) for t in (home, away))
            p = expectation(h, a, Decimal(advantage), Decimal(scale))
            out = (league, game_id, h, a, p, 1 - p, *before)
            if starts is None:
                return out
            kind = "incomplete" if home_score is None or away_score is None else "tie" if home_score == away_score else "used"
            count[kind] += 1
            hasher.update(game_line(game_id, starts, home, away, home_score, away_score, kind))
            if kind == "used":
                h, a = (now.get(t, Decimal(start)) for t in (home, away))
                move = k * (int(home_score > away_score) - chance(h + advantage - a, Decimal(scale)))
                for team in (home, away):
                    then.setdefault(team, now.get(team, Decimal(start)))
                now[home], now[away] = (h + move).quantize(four), (a - move).quantize(four)
            return out

    return step


def elo(games: DataFrame) -> DataFrame:
    columns = ["league", "game_id", "starts", "home", "away", "home_score", "away_score"]
    return folded(games.select(*columns), [F.col("starts").asc_nulls_last(), "game_id"], replay, FORECAST)


WEEKLY = "league string, game_id long, season long, week long, p_home double, prior_mean double, payout double"


def replay_weeks(k: float = 20.0, scale: float = 400.0, start: float = 1500.0, kept: float = 2 / 3) -> Callable:
    """Forecast a week's games from the weeks before it; between seasons ratings move a third of the way back to the start.

    A fold over league, game_id, season, week, home, away, payout (1, 0.5 or 0 for the home side) and the number of games of that
    id. No home advantage. Raises on repeated games and on a team that plays twice in a week.
    """
    ratings: dict = {}
    moves: dict = {}
    playing: set = set()
    at, prior, total, n = None, 0.5, 0.0, 0

    def step(league, game_id, season, week, home, away, payout, copies):
        nonlocal at, prior, total, n, ratings
        if copies > 1:
            raise ValueError("repeated game ids")
        if (season, week) != at:
            ratings |= moves
            moves.clear()
            playing.clear()
            if at is not None and season != at[0]:
                ratings = {t: start + (r - start) * kept ** (season - at[0]) for t, r in ratings.items()}
            at, prior = (season, week), total / n if n else 0.5
        if home == away or home in playing or away in playing:
            raise ValueError("a team plays twice in a week")
        playing.update((home, away))
        h, a = ratings.get(home, start), ratings.get(away, start)
        p = 1 / (1 + 10 ** (-(h - a) / scale))
        if payout is not None:
            moves[home], moves[away] = h + k * (payout - p), a - k * (payout - p)
            total, n = total + payout, n + 1
        return league, game_id, season, week, p, prior, payout

    return step


def weekly_elo(games: DataFrame) -> DataFrame:
    columns = ["league", "game_id", "season", "week", "home", "away", "payout"]
    copies = F.count(F.lit(1)).over(Window.partitionBy("league", "game_id")).alias("copies")
    return folded(games.select(*columns, copies), ["season", "week", "game_id"], replay_weeks, WEEKLY)


ROUNDS = "league string, game_id long, season long, week long, home string, away string, payout double"


def number_rounds() -> Callable:
    """A fold that numbers the rounds of a season from 1: a game opens the next round if one of its teams plays in this one already.

    Over league, game_id, season, week, home, away, payout, in the order of season, week, game_id. A new week is a new round.
    """
    playing: set = set()
    at, number = None, 0

    def step(league, game_id, season, week, home, away, payout):
        nonlocal at, number
        if (season, week) != at or home in playing or away in playing:
            number = number + 1 if at is not None and season == at[0] else 1
            at = (season, week)
            playing.clear()
        playing.update((home, away))
        return league, game_id, season, number, home, away, payout

    return step


def in_rounds(games: DataFrame) -> DataFrame:
    """The games with week replaced by the number of their round, so that every game is kept and no team plays twice in a week."""
    columns = ["league", "game_id", "season", "week", "home", "away", "payout"]
    return folded(games.select(*columns), ["season", "week", "game_id"], number_rounds, ROUNDS)
