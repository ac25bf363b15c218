"""Fractional differences over a fixed window, and the least order that makes a series stationary, found for all symbols at once."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.trailing import Trailing, dot as weighted, trailing
from ..functions.windows import Series, col, nz
from ..session import cut_lineage

C = F.col

#: values of one block of a series; a block also carries the values before it that its windows reach into
BLOCK = 4096


def frac_weights(d: float, threshold: float = 1e-3) -> np.ndarray:
    """Binomial weights of (1 - L)**d, oldest first, cut where they fall below the threshold."""
    # after the first, |w_k| falls like k ** -(d + 1); doubling the length reaches the first weight below the threshold
    size = 64
    while True:
        k = np.arange(1, size)
        w = np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])
        small = np.flatnonzero(np.abs(w) < threshold)
        if len(small):
            return w[:small[0]][::-1]
        size *= 2


def dot(frame: Column, weights) -> Column:
    """Sum of products of an array and literal weights, null where the array is shorter."""
    total = F.aggregate(F.zip_with(frame, F.lit([float(x) for x in weights]), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(frame) == len(weights), total)


def fracdiff(x, d: float, threshold: float = 1e-3, p: Series = Series()) -> Column:
    """Fixed-width fractional difference: one trailing array, one dot product. Null in the warm-up and over a missing value."""
    if not 0.0 <= d <= 2.0:
        raise ValueError("d must lie in [0, 2]")
    if d == 0.0:
        return col(x)
    w = frac_weights(d, threshold)
    return dot(F.collect_list(col(x).cast("double")).over(p.w.rowsBetween(1 - len(w), 0)), w)


def fracdiff_columns(df: DataFrame, d: float, columns=("open", "high", "low", "close"), threshold: float = 1e-4,
                     p: Series = Series(), suffix: str = "_fd") -> DataFrame:
    """Fixed-width fractional differences of several columns in one pass; as ``fracdiff``."""
    if not 0.0 <= d <= 2.0:
        raise ValueError("d must lie in [0, 2]")
    w = frac_weights(d, threshold) if d else np.ones(1)
    return trailing(df, {f"{c}{suffix}": Trailing(weighted(w), (c,), len(w)) for c in columns}, p)


def series_blocks(df: DataFrame, x: str, before: int, rows: int = BLOCK, *carry: str) -> DataFrame:
    """symbol, block, lead, v[, carry..]: the present values of a series in order, cut into blocks; v starts with ``lead`` values of the block
    before (``before`` of them, fewer at the start). A series of any length is many rows of bounded size."""
    if rows < before:
        raise ValueError("a block must hold the values that the next one reaches into")
    d = df.where(C(x).isNotNull() & ~F.isnan(C(x).cast("double")))
    d = d.select("symbol", "ts", C(x).cast("double").alias("_x"), *carry, (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).alias("_rn"))
    d = d.groupBy("symbol", F.floor(C("_rn") / rows).alias("block")).agg(F.sort_array(F.collect_list(F.struct("_rn", C("_x").alias("x"), "ts"))).alias("_v"))
    own = F.transform("_v", lambda s: s["x"])
    last = F.slice(own, F.greatest(F.size("_v") - before + 1, F.lit(1)), before)
    lead = F.coalesce(F.lag(last).over(Window.partitionBy("symbol").orderBy("block")), F.array().cast("array<double>"))
    return d.withColumns({"_own": own, "_lead": lead}).select("symbol", "block", F.size("_lead").alias("lead"), F.concat("_lead", "_own").alias("v"), F.transform("_v", lambda s: s["ts"]).alias("times"))


def _difference(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Differences at the places that have a whole window, the first at len(w) - 1."""
    return np.correlate(v, w, "valid") if len(v) >= len(w) else np.zeros(0)


def _moments(threshold: float):
    """Sums for the regression dy = a + b y1 + c dy1 over the own rows of a block; y1 is taken relative to ``shift`` to keep digits."""
    @F.pandas_udf("n double, s1 double, s2 double, s0 double, s11 double, s22 double, s00 double, s12 double, s10 double, s20 double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for v, lead, d, shift in batches:
            out = np.zeros((len(v), 10))
            for i, (x, skip, order, mid) in enumerate(zip(v, lead, d, shift)):
                if order != order:
                    continue
                w = frac_weights(order, threshold)
                y = _difference(np.asarray(x, float), w)[max(0, skip - len(w) - 1):]
                if len(y) > 2:
                    dy = np.diff(y)
                    a, b, c = y[1:-1] - mid * w.sum(), dy[:-1], dy[1:]
                    out[i] = len(a), a.sum(), b.sum(), c.sum(), a @ a, b @ b, c @ c, a @ b, a @ c, b @ c
            yield pd.DataFrame(out, columns=["n", "s1", "s2", "s0", "s11", "s22", "s00", "s12", "s10", "s20"])

    return run


def dickey_fuller(m: DataFrame, *keys: str) -> DataFrame:
    """Adds n and t_stat, the t value of y1 in dy = a + b y1 + c dy1, to sums of moments."""
    centred = {f"_{i}{j}": C(f"s{min(i, j)}{max(i, j)}" if (i, j) not in ((1, 0), (2, 0)) else f"s{i}{j}") - C(f"s{i}") * C(f"s{j}") / nz("n") for i, j in ((1, 1), (2, 2), (0, 0), (1, 2), (1, 0), (2, 0))}
    d = m.withColumns(centred)
    det = nz(C("_11") * C("_22") - C("_12") * C("_12"))
    d = d.withColumns({"_b": (C("_22") * C("_10") - C("_12") * C("_20")) / det, "_c": (C("_11") * C("_20") - C("_12") * C("_10")) / det, "_det": det})
    rss = F.greatest(C("_00") - C("_b") * C("_10") - C("_c") * C("_20"), F.lit(0.0))
    t = C("_b") / nz(F.sqrt(rss / F.when(C("n") > 3, C("n") - 3) * C("_22") / C("_det")))
    return d.select(*keys, "n", t.alias("t_stat"))


def least_orders(df: DataFrame, x: str = "close", low: float = 0.0, high: float = 1.0, tolerance: float = 0.01, threshold: float = 1e-4,
                 critical: float = -2.86, fewest: int = 20, rows: int = BLOCK) -> DataFrame:
    """symbol, optimal_d: the least order of differencing at which a Dickey-Fuller test (one lag, constant) finds the series stationary.

    ``low`` if it passes, ``high`` if that fails, else bisection to ``tolerance``. All symbols take a step together, each with its own order:
    a step is one pass over the blocks and one aggregate of ten sums a symbol. Fewer than ``fewest`` differences count as not stationary.
    """
    steps = int(np.ceil(np.log2((high - low) / tolerance) + 1e-12))
    longest = max(len(frac_weights(d, threshold)) for d in np.linspace(low, high, 2 ** steps + 1))
    blocks = series_blocks(df, x, longest + 1, max(rows, longest + 1)).drop("times")
    mean = df.groupBy("symbol").agg(F.avg(F.nanvl(C(x).cast("double"), F.lit(None).cast("double"))).alias("shift"))
    blocks = cut_lineage(blocks.join(mean, "symbol"))
    state = blocks.groupBy("symbol").agg(F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(None).cast("double").alias("found"))
    moments = _moments(threshold)
    names = ["n", "s1", "s2", "s0", "s11", "s22", "s00", "s12", "s10", "s20"]
    for step in range(steps + 2):
        at = C("lo") if step == 0 else C("hi") if step == 1 else (C("lo") + C("hi")) / 2
        tried = blocks.join(state, "symbol").withColumn("d", F.when(C("found").isNull(), at))
        tried = tried.select("symbol", "lo", "hi", "found", "d", moments("v", "lead", F.coalesce("d", F.lit(float("nan"))), "shift").alias("m"))
        sums = tried.groupBy("symbol", "lo", "hi", "found", "d").agg(*[F.sum(f"m.{c}").alias(c) for c in names])
        tested = dickey_fuller(sums, "symbol", "lo", "hi", "found", "d")
        passes = F.coalesce((C("n") + 2 >= fewest) & (C("t_stat") < critical), F.lit(False))
        if step == 0:
            new = {"found": F.when(passes, C("lo"))}
        elif step == 1:
            new = {"found": F.coalesce("found", F.when(~passes, C("hi")))}
        else:
            new = {"hi": F.when(passes, C("d")).otherwise(C("hi")), "lo": F.when(passes, C("lo")).otherwise(F.coalesce("d", "lo"))}
        state = tested.withColumns(new).select("symbol", "lo", "hi", "found")
    return state.select("symbol", F.round(F.coalesce("found", "hi"), 3).alias("optimal_d"))


def fracdiff_by_symbol(df: DataFrame, orders: DataFrame, x: str = "close", threshold: float = 1e-4, rows: int = BLOCK) -> DataFrame:
    """symbol, ts, <x>_fd: each symbol differenced at its own order (orders: symbol, optimal_d); rows without the value are left out, null in the
    warm-up."""
    longest = max(len(frac_weights(d, threshold)) for d in np.linspace(0.0, 1.0, 129))

    @F.pandas_udf("array<double>")
    def run(v: pd.Series, lead: pd.Series, d: pd.Series) -> pd.Series:
        out = []
        for a, skip, order in zip(v, lead, d):
            a, w = np.asarray(a, float), frac_weights(order, threshold)
            y = np.concatenate([np.full(min(len(w) - 1, len(a)), np.nan), _difference(a, w)])[skip:]
            out.append([None if t != t else t for t in y.tolist()])
        return pd.Series(out, dtype=object)

    b = series_blocks(df, x, longest, max(rows, longest)).join(orders, "symbol")
    pairs = F.arrays_zip("times", run("v", "lead", "optimal_d").alias("y"))
    return b.select("symbol", F.explode(pairs).alias("p")).select("symbol", C("p.times").alias("ts"), C("p.y").alias(f"{x}_fd"))
