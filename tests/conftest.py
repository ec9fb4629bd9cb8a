"""One local session for all tests, and the comparison of a query with its SQL in DuckDB."""

import math
import os
import sys
import tempfile
from collections import Counter
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    work = tempfile.mkdtemp(prefix="spark-")
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.sql.warehouse.dir": f"{work}/warehouse",
        "spark.checkpoint.dir": f"{work}/shared",
    }
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else p / '*.parquet'}')")
    return con


def normal(value):
    """Numbers to nine significant digits; everything else as it prints."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, str):
        return value
    try:
        x = float(value)
    except (TypeError, ValueError):
        return str(value)
    return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, query, sql):
    """Column names, the number of rows and every value must agree."""
    df = query(spark, sf_dir)
    names, found = rows_of(df.columns, df.collect())
    cur = duck(sf_dir).execute(sql)
    expected_names, expected = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert names == expected_names
    assert sum(found.values()) == sum(expected.values())
    assert found == expected, (list((found - expected).items())[:3], list((expected - found).items())[:3])
