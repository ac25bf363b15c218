"""User-supplied strategies, factors and window functions, and a look-ahead test for them."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.windows import Layers, Series, apply_layers

C = F.col
FACTORS: dict[str, Callable[[Series], Layers]] = {}


def strategy(fn: Callable[[DataFrame, Series], DataFrame]) -> Callable[[DataFrame, Series], DataFrame]:
    """A function from (panel, series spec) to the panel plus ``signal``; checked for the column it must add."""
    def wrapped(panel: DataFrame, p: Series = Series()) -> DataFrame:
        out = fn(panel, p)
        if "signal" not in out.columns:
            raise ValueError("a strategy must return a 'signal' column")
        return out
    return wrapped


def factor(name: str):
    def register(fn):
        FACTORS[name] = fn
        return fn
    return register


def compute(panel: DataFrame, names: list[str], p: Series = Series()) -> DataFrame:
    df = panel
    for n in names:
        df = apply_layers(df, FACTORS[n](p))
    return df


def looks_ahead(panel: DataFrame, name: str, cutoff, tol: float = 1e-9) -> DataFrame:
    """Rows where the factor changes when bars after the cutoff are taken away: empty for a causal factor."""
    cut = F.lit(cutoff).cast("timestamp_ntz")
    full = compute(panel, [name]).where(C("ts") <= cut).select("symbol", "ts", C(name).alias("full"))
    part = compute(panel.where(C("ts") <= cut), [name]).select("symbol", "ts", C(name).alias("part"))
    j = full.join(part, ["symbol", "ts"])
    moved = (F.abs(C("full") - C("part")) > tol) | (C("full").isNull() != C("part").isNull())
    return j.where(moved)


def share_of_rises(values: np.ndarray) -> np.ndarray:
    return (np.diff(values, axis=1) > 0).mean(axis=1)


def rolling_apply(df: DataFrame, x: str, n: int, fn: Callable[[np.ndarray], np.ndarray], out: str, p: Series = Series()) -> DataFrame:
    """Array function over full trailing windows, an Arrow batch of windows (rows x n) at a time."""
    @F.pandas_udf(T.DoubleType())
    def run(windows: pd.Series) -> pd.Series:
        res = pd.Series(np.nan, index=windows.index)
        ok = windows.map(lambda a: a is not None and len(a) == n)
        if ok.any():
            res[ok] = fn(np.stack(windows[ok].to_list()))
        return res
    d = df.withColumn("_w", F.collect_list(C(x)).over(p.last(n)))
    return d.withColumn(out, F.nanvl(run("_w"), F.lit(None).cast("double"))).drop("_w")
