"""Query registry: every entry pairs a Spark callable with, where SQL can express it, an oracle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


# shifts the rounding point away from values that end in an exact half (prices have few decimals)
OFFSET = 1.7e-3


def rd(x, digits: int):
    """One rounded column, like rounded()."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x + OFFSET * 10.0 ** -digits, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6, cols: list[str] | None = None) -> DataFrame:
    """Round double columns for stable comparison between engines."""
    names = cols or df.columns
    kinds = dict(zip(df.columns, [f.dataType for f in df.schema.fields]))
    return df.select(*[
        (F.round(F.col(c) + OFFSET * 10.0 ** -digits, digits) + F.lit(0.0)).alias(c) if isinstance(kinds[c], T.DoubleType) else F.col(c)
        for c in names])
