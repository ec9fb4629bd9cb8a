"""Likely and declared contracts of a league, written by hand."""

from ledgerlark.operators import listings

HOOPS = listings.Words("nba", "xxnba", ("boston celtics", "new york knicks", "miami heat", "portland trail blazers"), ("bos", "nyk", "mia", "por"), not_series=("XXNFLGAME",))
#: series, event, event's text, category, title, subtitle, likely
LIKELY = [
    ("XXNFLGAME", "nba", None, "Sports", "NBA", None, False),
    ("XXNBAGAME", None, None, "Politics", "anything", None, True),
    (None, None, "{'league': 'NBA'}", None, "x", None, True),
    (None, None, None, "Politics", "NBA finals", None, False),
    (None, None, None, "SPORTS", "Who wins the NBA title?", None, True),
    (None, None, None, "", "Celtics and Knicks", None, True),
    (None, None, None, None, "Boston Celtics", "the Heat", True),
    (None, None, None, None, "BOS vs MIA", None, True),
    (None, None, None, None, "boss vs miami", None, False),
    (None, None, None, None, "Will the Heat win?", None, False),
    (None, None, None, None, "heat blazers", None, True),
    (None, None, None, None, None, None, False),
]


def test_likely(spark):
    rows = spark.createDataFrame([(n, *r[:6]) for n, r in enumerate(LIKELY)], "id int, series string, event string, event_text string, category string, title string, subtitle string")
    found = listings.likely(*[listings.F.col(c) for c in ("series", "event", "event_text", "category", "title", "subtitle")], HOOPS)
    assert {r.id: r.x for r in rows.select("id", found.alias("x")).collect()} == {n: r[6] for n, r in enumerate(LIKELY)}


SERIES = [listings.Series("nba", "XXNBAGAME"), listings.Series("mlb", "XXMLBGAME", "Pro Baseball"), listings.Series("nfl", "XXNFLGAME", "Pro Football", True)]
NFL = {"provider": "p", "category": "Sports", "market_type": "Binary", "series": "XXNFLGAME", "event_id": "XXNFLGAME-26SEP13DALNYG", "market_id": "XXNFLGAME-26SEP13DALNYG-DAL", "scope": "Game", "competition": "Pro Football", "title": "Dallas at New York Winner?", "more": None}
CASES = [
    ("nfl", {}),
    (None, {"provider": "q"}),
    (None, {"category": "sports"}),
    (None, {"market_type": "scalar"}),
    (None, {"event_id": None}),
    (None, {"scope": "Season"}),
    (None, {"competition": "College Football"}),
    (None, {"market_id": "XXNFLGAME-26SEP13DALNYG-DALL"}),
    (None, {"market_id": "XXNFLGAME-26SEP13DALNYG-X-DAL"}),
    (None, {"event_id": "XXNFLGAME-26sep13", "market_id": "XXNFLGAME-26sep13-DAL"}),
    (None, {"title": "Dallas at New York"}),
    (None, {"title": "Dallas wins by 7"}),
    (None, {"more": "First half"}),
    ("nfl", {"more": "Overtime counts"}),
    ("nba", {"series": "XXNBAGAME", "event_id": "anything", "competition": None, "title": "x"}),
    (None, {"series": "XXMLBGAME", "competition": "Pro Football"}),
    ("mlb", {"series": "XXMLBGAME", "competition": "Pro Baseball"}),
    (None, {"series": None}),
]


def test_classified(spark):
    rows = spark.createDataFrame([(n, *{**NFL, **c}.values()) for n, (_, c) in enumerate(CASES)], "id int, " + ", ".join(f"{k} string" for k in NFL))
    columns = {k: listings.F.col(k) for k in NFL} | {"texts": listings.F.array("title", "more")}
    found = listings.classified(columns, SERIES, "p")
    assert {r.id: r.x for r in rows.select("id", found.alias("x")).collect()} == {n: league for n, (league, _) in enumerate(CASES)}
