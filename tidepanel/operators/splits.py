"""Walk-forward splits as tables, range joins with bars, fold-keyed evaluation."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.windows import Series, clip, flag, nz
from . import backtest, metrics
from .features.technical import rsi

C = F.col


def fold_status(bars: DataFrame, train: int = 126, test: int = 21, embargo: int = 21, step: int | None = None, min_folds: int = 5) -> DataFrame:
    """(symbol, n_bars, n_folds, status) of every symbol; status is ``ok`` or ``too few folds``."""
    span = train + embargo + test
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"))
    k = F.when(C("n_bars") >= span, F.floor((C("n_bars") - span) / (step or test)) + 1).otherwise(0)
    return n.withColumn("n_folds", k).withColumn("status", F.when(C("n_folds") >= max(min_folds, 1), "ok").otherwise("too few folds"))


def bar_folds(bars: DataFrame, train: int = 126, test: int = 21, embargo: int = 21, step: int | None = None, min_folds: int = 5) -> DataFrame:
    """Purged folds by bar count per symbol: (symbol, fold, train_start.., test_end) as row positions and dates.

    A symbol with fewer than ``min_folds`` folds has none here and leaves the others alone; ``fold_status`` names it.
    """
    step = step or test
    span = train + embargo + test
    f = fold_status(bars, train, test, embargo, step, min_folds).where("status = 'ok'")
    f = f.select("symbol", F.explode(F.sequence(F.lit(0).cast("bigint"), C("n_folds") - 1)).alias("fold"))
    s = C("fold") * step
    return f.select("symbol", C("fold").cast("int").alias("fold"), s.alias("train_start"), (s + train - 1).alias("train_end"),
                    (s + train + embargo).alias("test_start"), (s + span - 1).alias("test_end"))


def month_folds(bars: DataFrame, train_months: int = 6, test_months: int = 1, embargo_months: int = 1, stride_months: int = 0) -> DataFrame:
    """Calendar folds over the whole panel: one date range per fold, embargo between train and test."""
    stride = stride_months or test_months
    span = bars.agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    d = span.select("b", F.posexplode(F.sequence(C("a"), C("b"), F.make_ym_interval(F.lit(0), F.lit(stride)))).alias("i", "_s"), "a")
    d = d.withColumn("train_start", F.add_months("a", C("i") * stride))
    d = d.withColumn("train_end", F.date_sub(F.add_months("train_start", train_months), 1))
    d = d.withColumn("test_start", F.date_add(F.add_months("train_end", embargo_months), 1))
    d = d.withColumn("test_end", F.date_sub(F.add_months("test_start", test_months), 1))
    d = d.where(C("test_end") <= C("b"))
    return d.select((C("i") + 1).alias("fold"), *[C(c).cast("timestamp_ntz").alias(c) for c in ("train_start", "train_end", "test_start", "test_end")])


def expanding_folds(bars: DataFrame, n_splits: int = 5, purge: int = 21, min_train: int = 50) -> DataFrame:
    """Expanding splits per symbol with the tail of each train part trimmed by the purge gap."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    size = F.floor(C("n") / (n_splits + 1))
    f = n.select("symbol", "n", size.alias("size"), F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    first = C("n") - (n_splits - C("fold")) * C("size")
    f = f.select("symbol", "fold", F.lit(0).cast("bigint").alias("train_start"), (first - 1 - purge - 1).alias("train_end"),
                 first.alias("test_start"), (first + C("size") - 1).alias("test_end"))
    return f.where(C("train_end") + 1 >= min_train)


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("rn", Series().row().cast("bigint"))


def assign_bar_folds(bars: DataFrame, folds: DataFrame) -> DataFrame:
    """Bars x folds by position: one row per (bar, fold, split). The equi-key is the symbol; a bar meets the few folds of its symbol and
    stays with those whose bounds contain it. Fold bounds are not expanded to positions, and a merge keeps them out of the driver: the
    table of folds grows with the symbols."""
    parts = folds.select("symbol", "fold", F.inline(F.array(
        F.struct(F.lit("train").alias("split"), C("train_start").alias("_a"), C("train_end").alias("_b")),
        F.struct(F.lit("test").alias("split"), C("test_start").alias("_a"), C("test_end").alias("_b")))))
    n, p = numbered(bars).alias("n"), parts.hint("merge").alias("p")
    d = n.join(p, (C("n.symbol") == C("p.symbol")) & C("n.rn").between(C("p._a"), C("p._b")))
    return d.select("n.symbol", "n.rn", *[C(f"n.`{c}`") for c in bars.columns if c != "symbol"], "p.fold", "p.split")


def assign_month_folds(bars: DataFrame, folds: DataFrame) -> DataFrame:
    """Range join bars x calendar folds; the fold table has one row per month at most, so it is broadcast."""
    f = F.broadcast(folds)
    inside = C("ts").between(C("train_start"), C("train_end")) | C("ts").between(C("test_start"), C("test_end"))
    d = bars.join(f, inside)
    return d.withColumn("split", F.when(C("ts") <= C("train_end"), "train").otherwise("test")).drop(
        "train_start", "train_end", "test_start", "test_end")


def momentum_signal(bars: DataFrame, fast: int = 20, slow: int = 50, rsi_period: int = 14, threshold: float = 50.0,
                    allow_short: bool = True, p: Series = Series()) -> DataFrame:
    """Moving-average cross filtered by RSI: 1, 0, -1. Computed over the whole history, so a later window
    of bars needs no separate warm-up."""
    d = bars.withColumns({"_d1": p.diff("close"), "_fast": p.mean("close", fast), "_slow": p.mean("close", slow)})
    d = d.withColumn("_rsi", rsi(p, rsi_period))
    long_ = flag((C("_fast") > C("_slow")) & (C("_rsi") > threshold))
    short = flag((C("_fast") < C("_slow")) & (C("_rsi") < 100.0 - threshold))
    return d.withColumn("signal", long_ - short if allow_short else long_).drop("_d1", "_fast", "_slow", "_rsi")


Strategy = Callable[[DataFrame, Series], DataFrame]
FOLD = Series(keys=("symbol", "fold"))


def fold_signals(bars: DataFrame, folds: DataFrame, strategy: Strategy) -> DataFrame:
    """Signals per fold. Series run over the fold's train bars followed by its test bars, so train signals
    start without history and test signals have the train window, and nothing else, behind them."""
    return strategy(assign_bar_folds(bars, folds), FOLD)


def momentum(df: DataFrame, p: Series = Series()) -> DataFrame:
    """The momentum baseline as a strategy."""
    return momentum_signal(df, p=p)


def walk_forward(bars: DataFrame, folds: DataFrame, strategy: Strategy, costs: tuple = backtest.cost("stock"),
                 initial_capital: float = 100_000.0) -> DataFrame:
    """All folds of all symbols in one job: in-sample at no cost, out-of-sample at cost.

    Positions restart inside each (fold, split).
    """
    d = fold_signals(bars, folds, strategy)
    side = F.when(C("split") == "test", backtest.per_side(costs)).otherwise(0.0)
    keys = ("symbol", "fold", "split")
    bt = backtest.run(d, side, keys, initial_capital=initial_capital)
    return metrics.all_metrics(bt, keys)


def stitched(bars: DataFrame, folds: DataFrame, strategy: Strategy, costs: tuple = backtest.cost("stock")) -> DataFrame:
    """Out-of-sample bars of all folds in time order as one backtest per symbol."""
    d = fold_signals(bars, folds, strategy).where("split = 'test'")
    bt = backtest.run(d, costs)
    return metrics.all_metrics(bt, ("symbol",))


def fold_summary(m: DataFrame, keys=("symbol",)) -> DataFrame:
    """Means over folds, overfitting score max(0, (IS - OOS) / |IS|) and verdict."""
    a = m.groupBy(*keys).agg(
        F.avg(F.when(C("split") == "train", C("sharpe_ratio"))).alias("mean_is_sharpe"),
        F.avg(F.when(C("split") == "test", C("sharpe_ratio"))).alias("mean_oos_sharpe"),
        F.avg(F.when(C("split") == "train", C("cagr"))).alias("mean_is_cagr"),
        F.avg(F.when(C("split") == "test", C("cagr"))).alias("mean_oos_cagr"),
        F.stddev_pop(F.when(C("split") == "test", C("sharpe_ratio"))).alias("std_oos_sharpe"),
        F.count_if((C("split") == "test") & (C("sharpe_ratio") > 0)).alias("n_positive"),
        F.count_if(C("split") == "test").alias("n_folds"),
        F.max(F.when(C("split") == "test", C("sharpe_ratio"))).alias("best_oos_sharpe"))
    gap = (C("mean_is_sharpe") - C("mean_oos_sharpe")) / nz(F.abs("mean_is_sharpe"))
    a = a.withColumn("overfitting_score", F.when(F.abs("mean_is_sharpe") > 1e-9, F.greatest(gap, F.lit(0.0))).otherwise(0.0))
    v = (F.when((C("mean_oos_sharpe") >= 0.5) & (C("overfitting_score") < 0.5), "PASS")
         .when((C("mean_oos_sharpe") > 0) & (C("overfitting_score") < 0.8), "MARGINAL").otherwise("FAIL"))
    return a.withColumn("verdict", v)


def edge_verdict(df: DataFrame) -> DataFrame:
    """STRONG / MODERATE / WEAK / NO edge from mean_oos_sharpe, sharpe_real, sharpe_theory, sharpe_base."""
    score = F.greatest((C("sharpe_theory") - C("mean_oos_sharpe")) / F.greatest(F.abs("sharpe_theory"), F.lit(1e-9)), F.lit(0.0))
    d = df.withColumns({"edge_survives": C("sharpe_real") > 0.5, "overfit": score, "beats_baseline": C("sharpe_real") > C("sharpe_base") + 0.1})
    s, o, e = C("mean_oos_sharpe"), C("overfit"), C("edge_survives")
    return d.withColumn("edge", F.when((s >= 0.8) & e & (o < 0.3), "STRONG EDGE").when((s >= 0.5) & e & (o < 0.6), "MODERATE EDGE")
                        .when((s > 0) & (o < 0.8), "WEAK EDGE").otherwise("NO EDGE DETECTED"))
