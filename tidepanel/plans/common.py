"""Shared inputs of the registered queries."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import backtest, splits
from ..session import shared_folder
from ..sources.tables import bars


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return splits.momentum_signal(bars(spark, sf))


def stock_run(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.run(signals(spark, sf), backtest.cost("stock"))


def scratch(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/tidepanel-{uuid.uuid4().hex}"


_STORED: dict[tuple[str, str, str], object] = {}


def once(spark: SparkSession, name: str, sf: str, build):
    """What ``build`` gives, made once for an application and an input folder: for results that several queries start from."""
    key = (spark.sparkContext.applicationId, name, sf)
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]
