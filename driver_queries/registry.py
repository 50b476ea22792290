"""Registration of queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ITEMS: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without a negative zero."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), DIGITS) + 0.0).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def query(name: str, items: str, sql: str | None = None, doubles: str = ""):
    """Register ``fn(spark, folder)``; ``doubles`` names the SQL columns to round."""

    def register(fn):
        QUERIES[name] = lambda spark, folder: rounded(fn(spark, folder))
        ITEMS[name] = items
        if sql is not None:
            replace = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            star = f"* REPLACE ({replace})" if replace else "*"
            ORACLES[name] = f"SELECT {star} FROM (\n{sql.strip()}\n) AS result"
        return fn

    return register
