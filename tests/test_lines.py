"""Packed lines come back as they were, and the gates' queries deal them packed, each a few times, with the results of their SQL on odd tables too."""

import math
import re
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from conftest import compare

from ledgerlark.operators import capital
from ledgerlark.plans import gates
from ledgerlark.plans.lines import LINE, Packing

USUAL = (7, 8, 9, 3, 17.0, 1234.56, 0.07, 0.08, "R", "F", datetime(1998, 3, 4))
ODD = {
    "l_orderkey": [None, -1, 1 << 40], "l_partkey": [1 << 33], "l_suppkey": [1 << 27, -5], "l_linenumber": [16, None], "l_quantity": [0.125, math.nan, 1e300], "l_extendedprice": [1234.567, -1.0, math.inf],
    "l_discount": [0.1 + 0.2, 1.28], "l_tax": [None, 0.0333], "l_returnflag": ["", "AN", "X", None], "l_linestatus": ["P"], "l_shipdate": [datetime(1998, 3, 4, 5, 6, 7, 8), datetime(1969, 12, 31), None],
}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_packed_lines_come_back(spark, kind):
    rows = [USUAL, (0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, "A", "O", datetime(1970, 1, 1)), ((1 << 36) - 1, (1 << 33) - 1, (1 << 27) - 1, 15, 163.83, 10737418.23, 1.27, 1.27, "N", "O", datetime(2100, 1, 1))]
    rows += [tuple(v if n == c else u for n, u in zip(LINE, USUAL, strict=True)) for c, values in ODD.items() for v in values]
    kinds = dict.fromkeys(LINE, "double") | dict.fromkeys(LINE[:3], "long") | {"l_linenumber": "int", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": kind}
    lines = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))
    packing = Packing(lines.schema)
    packed = packing.pack(lines, ["i"])
    assert {r.i for r in packed.filter("_odd is null").collect()} == {0, 1, 2}
    for there in (packed, packing.folded(packing.flat(packed))):
        out = packing.unpacked(there).select("i", *LINE)
        assert [f.dataType for f in out.schema] == [f.dataType for f in lines.schema]
        assert [repr(tuple(r)) for r in out.orderBy("i").collect()] == [repr(tuple(r)) for r in lines.orderBy("i").collect()]


def test_lines_are_dealt_by_order_and_by_share_only(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, most in (("rul6_authorized_capital", 1), ("rul4_risk_gate", 5), ("rul7_entry", 5), ("nst8_risk_checks", 7)):
            plan = gates.R.queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") <= most, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def odd_dir(sf_dir, tmp_path_factory):
    """Lines that share a number with another supplier's, an order twice, sums, prices and discounts of three digits."""
    out, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    t = {n: f"read_parquet('{Path(sf_dir) / n}.parquet')" for n in ("lineitem", "orders", "customer", "part")}
    shared = f"SELECT * REPLACE (l_partkey - 1 AS l_partkey, l_suppkey + 10000 AS l_suppkey, l_extendedprice - 1 AS l_extendedprice, l_shipdate - to_days(CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END) AS l_shipdate) FROM {t['lineitem']} WHERE l_orderkey % 10 < 3 AND l_partkey > 0"
    odd = "CASE WHEN l_orderkey % 7 = 0 THEN l_discount + 0.004 ELSE l_discount END AS l_discount, CASE WHEN l_orderkey % 7 = 1 THEN l_extendedprice + 0.001 ELSE l_extendedprice END AS l_extendedprice"
    tables = {
        "lineitem": f"SELECT * REPLACE ({odd}) FROM (SELECT * FROM {t['lineitem']} UNION ALL {shared})",
        "orders": f"SELECT * REPLACE (CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice + 0.001 ELSE o_totalprice END AS o_totalprice) FROM {t['orders']} UNION ALL SELECT * REPLACE (o_totalprice + 1 AS o_totalprice) FROM {t['orders']} WHERE o_orderkey % 50 = 0",
        "customer": f"FROM {t['customer']}", "part": f"FROM {t['part']}",
    }
    for n, q in tables.items():
        con.execute(f"COPY ({q}) TO '{out / n}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("large", [False, True])
@pytest.mark.parametrize("name", ["rul4_risk_gate", "rul7_entry", "rul6_authorized_capital"])
def test_odd_tables_match_sql(spark, odd_dir, monkeypatch, name, large):
    if large:
        monkeypatch.setattr(capital, "SLICED_ROWS", 0)
        monkeypatch.setattr(gates, "SMALL_PARTS", 0)
    compare(spark, odd_dir, gates.R.queries[name], gates.R.sql[name])


def test_lines_of_one_number_lie_together(spark, odd_dir, sf_dir):
    table = lambda change: lambda name: change(spark.read.parquet(f"{odd_dir}/{name}.parquet"))
    assert gates.together(table(lambda d: d))
    for column, value in (("l_linenumber", "12"), ("l_orderkey", "null"), ("l_suppkey", "null")):
        assert not gates.together(table(lambda d, c=column, v=value: d.withColumn(c, gates.F.expr(f"if(l_orderkey = 5, {v}, {c})"))))


def test_usual_lines_differ_in_low_bits_only(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    words = Packing(lines.schema).pack(lines).selectExpr("count(distinct _high)", "max(_terms)", "count(_odd)", "count(*)").first()
    assert words[0] == 1 and words[1] < 1 << 56 and words[2] == 0 < words[3]


def test_orders_are_dealt_once_with_their_money_packed(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("rul4_risk_gate", "rul7_entry"):
            plan = gates.R.queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 3, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("total, balance", [(0.0, -0.01), (499993.18, 9999.8), (((1 << 40) - 1) / 100, -20971.52), (671088.64, 20971.51)])
def test_money_comes_back(spark, total, balance):
    tables = {
        "orders": spark.createDataFrame([(5, 1, total), (6, 1, total), (6, 1, 0.125)], "o_orderkey long, o_custkey long, o_totalprice double"),
        "customer": spark.createDataFrame([(1, balance)], "c_custkey long, c_acctbal double"),
        "lineitem": spark.createDataFrame([(k, *USUAL[1:]) for k in (5, 6, 7)], ", ".join(f"{n} {k}" for n, k in zip(LINE, ["long"] * 3 + ["int"] + ["double"] * 4 + ["string"] * 2 + ["timestamp"], strict=True))),
    }
    packing = Packing(tables["lineitem"].schema)
    rows = gates.purchased(tables.get, packing.pack(tables["lineitem"]), packing)
    found = packing.unpacked(rows, ["l_orderkey"]).select("l_orderkey", gates.F.col("_money").isNotNull(), gates.F.inline(gates.bought_again()))
    assert sorted(map(tuple, found.collect())) == sorted([(5, True, total, balance), (6, False, total, balance), (6, False, 0.125, balance)])


def test_many_customers_match_sql(spark, odd_dir, monkeypatch):
    monkeypatch.setattr(gates, "SMALL_CUSTOMERS", 0)
    compare(spark, odd_dir, gates.R.queries["rul7_entry"], gates.R.sql["rul7_entry"])


@pytest.mark.parametrize("rows", [500_000, 1])
def test_risk_checks_of_odd_tables_match_sql(spark, odd_dir, monkeypatch, rows):
    monkeypatch.setattr(gates.risk, "BLOCK_ROWS", rows)
    compare(spark, odd_dir, gates.R.queries["nst8_risk_checks"], gates.R.sql["nst8_risk_checks"])


@pytest.mark.parametrize("name", ["rul4_risk_gate", "rul7_entry", "nst8_risk_checks"])
def test_no_method_is_too_long_to_be_compiled(spark, sf_dir, name):
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = debug.codegenString(gates.R.queries[name](spark, sf_dir)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) <= 8000
