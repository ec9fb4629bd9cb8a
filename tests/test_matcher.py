"""The matcher on contracts written by hand: every outcome, its boundaries, and odd texts."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from ledgerlark.operators import matcher

TEAMS = [
    (1, "BOS", "Boston", "Celtics", "Boston Celtics"),
    (2, "NYK", "New York", "Knicks", "New York Knicks"),
    (3, "PHI", "Philadelphia", "76ers", "Philadelphia 76ers"),
    (4, "LAC", "Los Angeles", "Clippers", "Los Angeles Clippers"),
    (5, "LAL", "Los Angeles", "Lakers", "Los Angeles Lakers"),
    (6, "UTA", "Utah", "Jazz", "Utah Jazz"),
]
TIP = datetime(2026, 1, 1, 0, 30)
FULL = "Will the Boston Celtics beat the New York Knicks?"
H = timedelta(hours=1)


def at(case):
    """Each case has a time of its own, far from the others' events."""
    return TIP + timedelta(days=30 * case)


#: case, title, subtitle, has an occurrence, has a close, events (hours away, home, away), status, method, reason, confidence, event
CASES = [
    (0, FULL, None, True, True, [(0, 1, 2)], "matched", "exact_team_pair_and_time", "matched", "1.0000", 0),
    (1, "NBA: BOS @ NYK", None, True, True, [(0, 2, 1)], "matched", "exact_team_pair_and_time", "matched", "0.9300", 0),
    (2, "BOS @ NYK", None, True, True, [(0, 1, 2)], "unmatched", "insufficient_team_evidence", "insufficient_team_evidence", "0.0000", None),
    (3, FULL, None, True, True, [(24, 1, 2), (0, 1, 2)], "matched", "exact_team_pair_and_time", "matched", "1.0000", 1),
    (4, FULL, None, True, True, [(-1, 1, 2), (1, 1, 2)], "ambiguous", "exact_team_pair_and_time", "small_margin", "1.0000", None),
    (5, "Will the Boston Celtics win tonight?", None, True, True, [(0, 1, 2)], "unmatched", "insufficient_team_evidence", "insufficient_team_evidence", "0.0000", None),
    (6, "Boston Celtics at Utah Jazz", None, True, True, [(0, 3, 1)], "unmatched", "no_team_pair_event", "no_team_pair_event", "0.0000", None),
    (7, "Boston Celtics v New York Knicks in Pro Soccer", None, True, True, [(0, 1, 2)], "unmatched", "incompatible_sport_signal", "incompatible_sport_signal", "0.0000", None),
    (8, "Boston Celtics, New York Knicks, or Philadelphia 76ers to win?", None, True, True, [(0, 1, 2)], "unmatched", "non_single_game_market", "non_single_game_market", "1.0000", None),
    (9, FULL, None, True, True, [(36, 1, 2)], "ambiguous", "team_pair_and_time", "low_confidence", "0.7900", None),
    (10, FULL, None, True, True, [(36 + 1 / 3600, 1, 2)], "unmatched", "date_mismatch", "date_mismatch", "0.7000", None),
    (11, FULL, None, False, False, [(0, 1, 2)], "ambiguous", "team_pair_only", "team_pair_only", "0.7000", None),
    (12, FULL, None, False, True, [(0, 1, 2)], "ambiguous", "team_pair_and_time", "low_confidence", "0.8950", None),
    (13, "Céltics — KNICKS", None, True, True, [(3, 1, 2)], "matched", "exact_team_pair_and_time", "matched", "0.9650", 0),
    (14, "Jazz beat the Sixers", None, True, True, [(0, 6, 3)], "unmatched", "insufficient_team_evidence", "insufficient_team_evidence", "0.0000", None),
    (15, "Jazz beat the Sixers", "pro basketball", True, True, [(0, 6, 3)], "matched", "exact_team_pair_and_time", "matched", "0.9650", 0),
    (16, "Los Angeles at Boston nba", None, True, True, [(0, 4, 1)], "unmatched", "insufficient_team_evidence", "insufficient_team_evidence", "0.0000", None),
    (17, None, "", True, True, [], "unmatched", "insufficient_team_evidence", "insufficient_team_evidence", "0.0000", None),
    (18, FULL, None, True, True, [(13, 1, 2)], "ambiguous", "team_pair_and_time", "low_confidence", "0.8800", None),
]


def tables(spark):
    markets = [(n, title, sub, at(n) if occurs else None, at(n) + 2 * H if closes and occurs else at(n) if closes else None) for n, title, sub, occurs, closes, *_ in CASES]
    events = [(100 * c[0] + k, home, away, at(c[0]) + timedelta(seconds=round(hours * 3600))) for c in CASES for k, (hours, home, away) in enumerate(c[5])]
    return (
        spark.createDataFrame(markets, "market_id long, title string, subtitle string, occurrence_time timestamp, close_time timestamp"),
        spark.createDataFrame(TEAMS, "team_id long, abbreviation string, city string, name string, full_name string"),
        spark.createDataFrame(events, "event_id long, home long, away long, starts_at timestamp"),
    )


def test_outcomes(spark):
    markets, teams, events = tables(spark)
    rows = {r.market_id: r for r in matcher.match(markets, teams, events, ["title", "subtitle"]).collect()}
    assert len(rows) == len(CASES)
    for n, *_, status, method, reason, score, event in CASES:
        r = rows[n]
        expected = (status, method, reason, Decimal(score), None if event is None else 100 * n + event)
        assert (r.status, r.method, r.reason, r.confidence, r.event_id) == expected, (n, r)
    assert rows[3].margin == Decimal("0.1200") and rows[4].margin == 0 and rows[0].margin == 1


@pytest.mark.parametrize(("least", "margin", "one", "three"), [("0.93", "0.12", "matched", "matched"), ("0.9301", "0.1201", "low_confidence", "small_margin")])
def test_boundaries_are_inclusive(spark, least, margin, one, three):
    markets, teams, events = tables(spark)
    found = matcher.match(markets.filter("market_id in (1, 3)"), teams, events, ["title", "subtitle"], policy=matcher.Policy(least, margin))
    assert {r.market_id: r.reason for r in found.collect()} == {1: one, 3: three}


def test_aliases_of_two_teams_are_none(spark):
    found = {(r.team_id, r.alias) for r in matcher.alias_index(tables(spark)[1], matcher.BASKETBALL).collect()}
    assert {(4, "la clippers"), (5, "la lakers"), (3, "sixers"), (1, "bos"), (2, "new york")} <= found
    assert not any(alias == "los angeles" for _, alias in found)


def test_empty_tables(spark):
    markets, teams, events = tables(spark)
    assert matcher.match(markets.limit(0), teams, events, ["title"]).collect() == []
    rows = matcher.match(markets.filter("market_id = 0"), teams, events.limit(0), ["title"]).collect()
    assert [r.reason for r in rows] == ["no_team_pair_event"]
    assert [r.reason for r in matcher.match(markets.filter("market_id = 0"), teams.limit(0), events, ["title"]).collect()] == ["insufficient_team_evidence"]


def test_events_that_start_together_are_one_row(spark):
    at = [TIP + k * H for k in range(4)]
    asked = spark.createDataFrame([(1, 2, t, False) for t in at for _ in range(50)], "a long, b long, at timestamp, from_close boolean")
    events = spark.createDataFrame([(n, 1, 2, TIP + (n % 2) * 5 * H) for n in range(200)], "event_id long, a long, b long, starts_at timestamp")
    found = {r["at"]: {t.temporal: (t.n, t.event_id, t.gap) for t in r.tiers} for r in matcher.tiers(asked, events, 36).collect()}
    assert len(found) == 4  # not a row a market and event
    assert found[at[0]] == {Decimal("1.0000"): (100, 0, 0), Decimal("0.8500"): (100, 1, 5 * 3600)}
    assert found[at[2]] == {Decimal("1.0000"): (200, 0, 2 * 3600)}
    markets, teams, _ = tables(spark)
    many = events.selectExpr("event_id", "a as home", "b as away", "starts_at")
    row = matcher.match(markets.filter("market_id = 0"), teams, many, ["title", "subtitle"]).collect()[0]
    assert (row.reason, row.margin, row.near_events) == ("small_margin", 0, 200)
