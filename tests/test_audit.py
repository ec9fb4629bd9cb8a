"""Order of issues, outliers, and the rolling hash of games as it is written out."""

import hashlib
from datetime import datetime

from ledgerlark.operators import audit, ratings


def test_issues_come_in_order(spark):
    shape = "subject string, code string, severity string"
    one = spark.createDataFrame([("b", "z", "warning"), ("b", "z", "error"), ("a", "z", "error")], shape)
    two = spark.createDataFrame([("c", "a", "warning"), ("a", "a", "error")], shape)
    assert [tuple(r) for r in audit.issues(one, two).collect()] == [("a", "a", "error"), ("a", "z", "error"), ("b", "z", "error"), ("c", "a", "warning"), ("b", "z", "warning")]


def test_outliers(spark):
    rows = [("x", float(v)) for v in [0] * 20 + [100]] + [("y", float(v)) for v in range(10)] + [("z", None)]
    found = audit.outliers(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    assert {r.k: r.outliers for r in found.collect()} == {"x": 1, "y": 0, "z": 0}


def test_chain_of_three_games(spark):
    games = [
        ("nba", 7, datetime(2026, 1, 1, 0, 30), 1, 2, 101, 99),
        ("nba", 8, datetime(2026, 1, 2), 2, 1, None, None),
        ("nba", 9, datetime(2026, 1, 3), 1, 2, 90, 90),
        ("nba", 10, datetime(2026, 1, 4), 1, 2, 1, 2),
    ]
    lines = [
        b'{"away_score":99,"away_team_id":"2","disposition":"processed","event_id":"7","home_score":101,"home_team_id":"1","scheduled_start_time":"2026-01-01T00:30:00+00:00"}\n',
        b'{"away_score":null,"away_team_id":"1","disposition":"skipped_incomplete","event_id":"8","home_score":null,"home_team_id":"2","scheduled_start_time":"2026-01-02T00:00:00+00:00"}\n',
        b'{"away_score":90,"away_team_id":"2","disposition":"skipped_tie","event_id":"9","home_score":90,"home_team_id":"1","scheduled_start_time":"2026-01-03T00:00:00+00:00"}\n',
    ]
    rows = spark.createDataFrame(games, "league string, game_id long, starts timestamp, home long, away long, home_score long, away_score long")
    found = {r.game_id: r.training_sha256 for r in ratings.elo(rows).collect()}
    assert found == {7 + n: hashlib.sha256(b"".join(lines[:n])).hexdigest() for n in range(4)}
