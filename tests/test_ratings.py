"""The folds of ratings against plain replays over all games, and that no game is left out."""

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from ledgerlark.plans import registered
from ledgerlark.plans.common import table
from ledgerlark.plans.decisions import _games

QUERIES, _ = registered()


def games_of(spark, sf_dir):
    rows = defaultdict(list)
    for r in _games(lambda name: table(spark, sf_dir, name)).collect():
        rows[r.league].append(r)
    return rows


def test_weekly_keeps_every_game(spark, sf_dir):
    found = {(r.league, r.game_id): r for r in QUERIES["fld2_weekly_elo"](spark, sf_dir).collect()}
    games = games_of(spark, sf_dir)
    assert set(found) == {(k, g.game_id) for k, v in games.items() for g in v}
    for league, some in games.items():
        ratings, season, total, n, waiting, playing, day, prior = {}, None, 0.0, 0, {}, set(), None, 0.5
        for g in sorted(some, key=lambda g: (g.starts.date(), g.game_id)):
            if g.starts.date() != day or {g.home, g.away} & playing:
                ratings |= waiting
                waiting, playing, day, prior = {}, set(), g.starts.date(), total / n if n else 0.5
                if season not in (None, day.year):
                    ratings = {t: 1500 + (r - 1500) * (2 / 3) ** (day.year - season) for t, r in ratings.items()}
                season = day.year
            playing |= {g.home, g.away}
            h, a = ratings.get(g.home, 1500.0), ratings.get(g.away, 1500.0)
            p = 1 / (1 + 10 ** ((a - h) / 400))
            r = found[league, g.game_id]
            assert abs(r.p_home - p) < 1e-8 and abs(r.prior_mean - prior) < 1e-8
            if g.home_score is not None:
                won = (g.home_score > g.away_score) + (g.home_score == g.away_score) / 2
                assert r.payout == won
                waiting |= {g.home: h + 20 * (won - p), g.away: a - 20 * (won - p)}
                total, n = total + won, n + 1


def test_replay_sees_only_earlier_games(spark, sf_dir):
    out = QUERIES["fld1_elo_replay"](spark, sf_dir).collect()
    found = {(r.league, r.game_id): r for r in out}
    games = games_of(spark, sf_dir)
    assert len(out) == len(found) == sum(map(len, games.values()))
    four = Decimal("0.0001")
    with localcontext(prec=40, rounding=ROUND_HALF_UP):
        for league, some in games.items():
            some.sort(key=lambda g: (g.starts, g.game_id))
            ratings, at, used, hashes = {}, 0, 0, {}
            for target in some:
                while some[at].starts < target.starts:
                    g = some[at]
                    at += 1
                    if g.home_score is not None and g.home_score != g.away_score:
                        h, a = (ratings.get(t, Decimal(1500)) for t in (g.home, g.away))
                        move = 20 * ((g.home_score > g.away_score) - 1 / (1 + Decimal(10) ** (-(h + 100 - a) / 400)))
                        ratings[g.home], ratings[g.away], used = (h + move).quantize(four), (a - move).quantize(four), used + 1
                r = found[league, target.game_id]
                h, a = (ratings.get(t, Decimal(1500)) for t in (target.home, target.away))
                assert (r.home_rating, r.away_rating, r.games_used) == (float(h), float(a), used)
                assert r.games_used + r.skipped_tie + r.skipped_incomplete == at
                assert hashes.setdefault(at, r.training_sha256) == r.training_sha256
            assert len(set(hashes.values())) == len(hashes)


def test_raises_on_repeated_games(spark):
    import pytest

    from ledgerlark.operators import ratings

    rows = [("a", 1, 2000, 1, "x", "y", 1.0), ("a", 1, 2000, 2, "x", "y", 0.0), ("b", 1, 2000, 1, "x", "y", None)]
    games = spark.createDataFrame(rows, ratings.ROUNDS)
    assert ratings.weekly_elo(games.filter("league = 'b' or week = 2")).count() == 2
    with pytest.raises(Exception, match="repeated game ids"):
        ratings.weekly_elo(games).collect()
    with pytest.raises(Exception, match="plays twice"):
        ratings.weekly_elo(games.filter("league = 'a'").withColumns({"week": F.lit(1).cast("long"), "game_id": (F.col("payout") + 5).cast("long")})).collect()


def test_games_of_an_instant_share_their_chances():
    from datetime import datetime

    from ledgerlark.operators import ratings

    step = ratings.replay()
    ratings.chance.cache_clear()
    for n in range(200):  # four pairs, and no result: no rating moves
        step("l", n, datetime(2026, 1, 1 + n // 100), str(n % 4), "x", None, None)
    assert ratings.chance.cache_info().misses == 1


def test_lines_are_dealt_before_they_are_grouped(spark, sf_dir):
    plan = QUERIES["rul29_side_differences"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2 and plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning(l_orderkey")
