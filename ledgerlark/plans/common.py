"""Helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as text, integers as longs: types that every engine writes alike."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType | T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.IntegerType | T.ShortType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        out.append(c.alias(f.name))
    return df.select(*out)


class Registry:
    """Queries and their SQL by name."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = lambda spark, sf_dir: plain(f(lambda name: table(spark, sf_dir, name)))
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
