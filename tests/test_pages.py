"""Cursor chains of landed pages, written as JSON and read by Spark: guards, caps, order and where a run resumes."""

import json

from ledgerlark.sources import pages

LANDED = [
    ("whole", None, "b", [1, 2]), ("whole", "b", "c", [3]), ("whole", "c", "", [4, 1]),
    ("single", "", None, []),
    ("again", None, "b", [1]), ("again", "b", "c", [2]), ("again", "c", "b", [3]),
    ("itself", None, "b", [1]), ("itself", "b", "b", [2]),
    ("gap", None, "b", [1]), ("gap", "c", None, [2]),
    ("headless", "b", None, [1]),
    ("long", None, "1", [0]), *[("long", str(n), str(n + 1), [n]) for n in range(1, 5)], ("long", "5", None, [5]),
    ("exact", None, "1", [0]), *[("exact", str(n), str(n + 1), [n]) for n in range(1, 4)], ("exact", "4", None, [4]),
    ("split", None, "b", [1]), ("split", None, "c", [1]), ("split", "b", None, [2]), ("split", "c", None, [2]),
    ("twice", None, "b", [1]), ("twice", None, "b", [1]), ("twice", "b", None, [2]),
]
STATUS = {"whole": "complete", "single": "complete", "again": "repeated_cursor", "itself": "repeated_cursor", "gap": "missing_page", "headless": "missing_page", "long": "page_limit", "exact": "complete", "split": "conflicting_page", "twice": "complete"}


def landed(spark, tmp_path):
    for n, (window, cursor, following, items) in enumerate(LANDED):
        (tmp_path / f"{n}.json").write_text(json.dumps({"window": window, "cursor": cursor, "next_cursor": following, "items": items}))
    return spark.read.schema("window string, cursor string, next_cursor string, items array<long>").option("mode", "FAILFAST").json(str(tmp_path))


def test_chains(spark, tmp_path):
    rows = landed(spark, tmp_path)
    found = pages.chains(rows, "window", 5)
    assert {r.window: r.status for r in found.collect()} == STATUS
    assert {r.window: r.path for r in found.collect()}["whole"] == ["", "b", "c"]
    read = [(r.window, r.page, r.place, r.item) for r in pages.items(rows, found, "window").collect()]
    assert sorted(x[1:] for x in read if x[0] == "whole") == [(0, 0, 1), (0, 1, 2), (1, 0, 3), (2, 0, 4), (2, 1, 1)]
    assert {x[0] for x in read} == {"whole", "exact", "twice"} and sum(x[0] == "twice" for x in read) == 2
    last = {r.key: r.item for r in pages.last_of_each(pages.items(rows, found, "window").filter("window = 'whole'").selectExpr("window", "page", "place", "named_struct('id', item, 'page', page) as item"), "window", pages.F.col("item.id")).collect()}
    assert last[1].page == 2 and last[2].page == 0
    assert pages.chains(rows.limit(0), "window", 5).collect() == []


def test_resume(spark):
    def run(status, most):
        rows = spark.createDataFrame([(f"2024-0{n + 1}-01", f"2024-0{n + 1}-28", s) for n, s in enumerate(status)], "start string, stop string, status string")
        return tuple(pages.resumed(rows, "start", "stop", "status", most).first())

    assert run(["complete"] * 3, 9) == (3, True, None, None)
    assert run(["complete"] * 3, 2) == (2, False, "2024-03-01", None)
    assert run(["complete", "page_limit", "complete"], 9) == (1, False, "2024-02-01", "page_limit")
    assert run([None, "complete"], 9) == (0, False, "2024-01-01", "not_collected")
    assert run(["complete", "complete", "page_limit"], 2) == (2, False, "2024-03-01", None)
    assert run([], 3) == (0, True, None, None)
