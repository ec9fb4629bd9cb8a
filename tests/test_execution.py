"""Fills of capital whose double lies beside half a cent, against SQL."""

from conftest import compare, duck
from ledgerlark.plans import registered


def test_capital_beside_half_a_cent(spark, tmp_path):
    path = tmp_path / "lineitem.parquet"
    duck(tmp_path).execute(f"""COPY (SELECT row_number() OVER ()::BIGINT AS l_orderkey, 1::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, 1::INTEGER AS l_linenumber, 10::DOUBLE AS l_quantity,
      (e * 10 + 5)::DOUBLE AS l_extendedprice, d / 100.0::DOUBLE AS l_discount, 0.01::DOUBLE AS l_tax, 'A' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2000-01-01' AS l_shipdate
      FROM range(0, 3000) t(e), range(0, 11) u(d)) TO '{path}' (FORMAT parquet)""")
    queries, sql = registered()
    compare(spark, str(tmp_path), queries["rul7_execution"], sql["rul7_execution"])
