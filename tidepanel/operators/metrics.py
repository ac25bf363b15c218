"""Performance metrics as aggregates over any grouping of return rows."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import wide
from ..functions.windows import Series, col, flag, nz

C = F.col


def root(x: float) -> float:
    return math.sqrt(x)


def annualised_return(r, periods: int = 252) -> Column:
    n = F.count(col(r))
    return F.when(n == 0, 0.0).otherwise(F.pow(F.product(1.0 + col(r)), periods / nz(n.cast("double"))) - 1.0)


def annualised_volatility(r, periods: int = 252) -> Column:
    """Zero also when the spread is only rounding noise around the mean."""
    s = F.stddev_samp(col(r))
    return F.coalesce(F.when(s > 1e-14 * F.abs(F.avg(col(r))), s * root(periods)), F.lit(0.0))


def sharpe(r, risk_free: float = 0.0, periods: int = 252) -> Column:
    """Geometric annual return of the excess over its annual volatility."""
    ex = col(r) - risk_free / periods if risk_free else col(r)
    vol = annualised_volatility(ex, periods)
    return F.when(vol == 0, 0.0).otherwise(annualised_return(ex, periods) / nz(vol))


def sharpe_like(r, periods: int = 252) -> Column:
    """Arithmetic mean over sample deviation, annualised."""
    return F.avg(col(r)) / (F.stddev_samp(col(r)) + 1e-12) * root(periods)


def sortino(r, risk_free: float = 0.0, periods: int = 252) -> Column:
    ex = col(r) - risk_free / periods if risk_free else col(r)
    vol = F.coalesce(F.stddev_samp(F.when(ex < 0, ex)) * root(periods), F.lit(0.0))
    return F.when(vol == 0, 0.0).otherwise(annualised_return(ex, periods) / nz(vol))


def win_rate(r) -> Column:
    return F.coalesce(F.avg((col(r) > 0).cast("double")), F.lit(0.0))


def profit_factor(r) -> Column:
    gain = F.coalesce(F.sum(F.when(col(r) > 0, col(r))), F.lit(0.0))
    loss = F.abs(F.coalesce(F.sum(F.when(col(r) < 0, col(r))), F.lit(0.0)))
    return F.when(loss == 0, F.lit(float("inf"))).otherwise(gain / nz(loss))


def cagr(eq="equity", ts="ts", periods: int = 252) -> Column:
    """From the first and last equity value over count/periods years."""
    n = F.count(col(eq)).cast("double")
    growth = F.max_by(col(eq), col(ts)) / nz(F.min_by(col(eq), col(ts)))
    return F.when(n < 2, 0.0).otherwise(F.pow(growth, periods / nz(n)) - 1.0)


def underwater(df: DataFrame, keys, eq: str = "equity") -> DataFrame:
    """Running peak and drawdown per bar. Below means by more than rounding noise of the running product."""
    p = Series(keys=tuple(keys))
    d = df.withColumn("peak", F.max(eq).over(p.past))
    return d.withColumn("drawdown", (C(eq) - C("peak")) / nz("peak"))


def drawdown(df: DataFrame, keys, eq: str = "equity") -> DataFrame:
    return underwater(df, keys, eq).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def underwater_runs(df: DataFrame, keys, eq: str = "equity") -> DataFrame:
    """Longest run of bars below the running peak: rows between peaks share an island."""
    p = Series(keys=tuple(keys))
    d = underwater(df, keys, eq).withColumn("_up", flag(C(eq) >= C("peak") * (1.0 - 1e-12)))
    d = d.withColumn("_isl", F.sum("_up").over(p.past))
    runs = d.groupBy(*keys, "_isl").agg(F.sum(1 - C("_up")).alias("_len"))
    return runs.groupBy(*keys).agg(F.max("_len").alias("max_drawdown_duration_bars"))


def all_metrics(df: DataFrame, keys, ret: str = "net_return", eq: str = "equity", periods: int = 252) -> DataFrame:
    """The metric bundle, one row per key. Two passes over the same partitioning: islands, then aggregates."""
    keys = list(keys)
    p = Series(keys=tuple(keys))
    d = underwater(df, keys, eq).withColumn("_up", flag(C(eq) >= C("peak") * (1.0 - 1e-12)))
    d = d.withColumn("_isl", F.sum("_up").over(p.past))
    d = d.withColumn("_run", F.sum(1 - C("_up")).over(
        Window.partitionBy(*keys, "_isl").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))
    out = d.groupBy(*keys).agg(
        cagr(eq, periods=periods).alias("cagr"),
        annualised_return(ret, periods).alias("annualised_return"),
        annualised_volatility(ret, periods).alias("annualised_volatility"),
        sharpe(ret, periods=periods).alias("sharpe_ratio"),
        sortino(ret, periods=periods).alias("sortino_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        F.max("_run").alias("max_drawdown_duration_bars"),
        win_rate(ret).alias("win_rate"), profit_factor(ret).alias("profit_factor"),
        F.count_if(col(ret) != 0).alias("total_trades"))
    calmar = F.when(C("max_drawdown") == 0, 0.0).otherwise(C("annualised_return") / nz(F.abs("max_drawdown")))
    return out.withColumn("calmar_ratio", calmar)


def nav_dashboard(df: DataFrame, keys, nav: str = "equity", periods: int = 252) -> DataFrame:
    """Dashboard metrics of a NAV series: CAGR on n-1 returns, arithmetic Sharpe, drawdown."""
    p = Series(keys=tuple(keys))
    d = underwater(df.withColumn("_r", p.pct(nav)), keys, nav)
    n = F.count("_r").cast("double")
    total = F.max_by(nav, "ts") / nz(F.min_by(nav, "ts"))
    sd = F.stddev_samp("_r")
    return d.groupBy(*keys).agg(
        (total - 1.0).alias("total_return"),
        (F.pow(total, 1.0 / F.greatest(n / periods, F.lit(1e-6))) - 1.0).alias("cagr"),
        (sd * root(periods)).alias("volatility"),
        F.when(sd > 0, F.avg("_r") / nz(sd) * root(periods)).otherwise(0.0).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.count(F.lit(1)).alias("bars"),
        F.min("ts").alias("start"), F.max("ts").alias("end"))


def nav_statistics(df: DataFrame, keys, nav: str = "equity") -> DataFrame:
    """NAV page: profit, positive and negative days, best and worst day with date, calendar-year growth."""
    p = Series(keys=tuple(keys))
    d = underwater(df.withColumn("_r", F.coalesce(p.pct(nav), F.lit(0.0))), keys, nav)
    a = d.groupBy(*keys).agg(
        F.min_by(nav, "ts").alias("start_nav"), F.max_by(nav, "ts").alias("end_nav"),
        F.count_if(C("_r") > 1e-12).alias("pos_days"), F.count_if(C("_r") < -1e-12).alias("neg_days"),
        (F.min("drawdown") * 100.0).alias("max_dd"), F.stddev_samp("_r").alias("_sd"), F.avg("_r").alias("_mu"),
        F.min("ts").alias("period_start"), F.max("ts").alias("period_end"), F.count(F.lit(1)).alias("n_days"),
        F.max(F.struct("_r", F.unix_micros(C("ts").cast("timestamp")).__neg__().alias("k"), "ts")).alias("_b"),
        F.min(F.struct("_r", "ts")).alias("_w"))
    years = F.datediff("period_end", "period_start") / 365.25
    days = C("pos_days") + C("neg_days")
    return a.select(
        *keys, "start_nav", "end_nav", ((C("end_nav") / nz("start_nav") - 1.0) * 100.0).alias("total_ret"),
        (C("end_nav") - C("start_nav")).alias("total_pnl"),
        F.when(days > 0, C("pos_days") / F.nullif(days, F.lit(0)) * 100.0).otherwise(0.0).alias("win_rate"), "max_dd",
        F.when(years > 0, (F.pow(C("end_nav") / nz("start_nav"), 1.0 / nz(years)) - 1.0) * 100.0).otherwise(0.0).alias("ann_ret"),
        F.when(C("_sd") > 0, C("_mu") / nz("_sd") * root(252)).otherwise(0.0).alias("sharpe"),
        "pos_days", "neg_days", "period_start", "period_end", "n_days",
        (C("_b._r") * 100.0).alias("best_day_pct"), C("_b.ts").alias("best_day_dt"),
        (C("_w._r") * 100.0).alias("worst_day_pct"), C("_w.ts").alias("worst_day_dt"))


def monthly_returns(df: DataFrame, keys, ret: str = "net_return") -> DataFrame:
    """Compounded return per calendar month, months as columns."""
    m = df.groupBy(*keys, F.year("ts").alias("year"), F.month("ts").alias("month")).agg((F.product(1.0 + C(ret)) - 1.0).alias("r"))
    out = m.groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.first("r"))
    return out.withColumnsRenamed({str(i): f"m{i:02d}" for i in range(1, 13)})


def holding_runs(df: DataFrame, keys, held: Column) -> DataFrame:
    """Average length of consecutive bars in a position."""
    p = Series(keys=tuple(keys))
    d = df.withColumn("_in", flag(held))
    d = d.withColumn("_chg", flag(C("_in") != F.coalesce(p.lag("_in"), F.lit(-1))))
    d = d.withColumn("_isl", F.sum("_chg").over(p.past)).where("_in = 1")
    runs = d.groupBy(*keys, "_isl").agg(F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(*keys).agg(F.avg("_n").alias("avg_hold_bars"), F.count(F.lit(1)).alias("n_holds"))


def buy_and_hold(bars: DataFrame, keys=("symbol",)) -> DataFrame:
    p = Series(keys=tuple(keys))
    d = underwater(bars.withColumn("_r", p.pct("close")), keys, "close")
    ann = F.pow(1.0 + F.avg("_r"), 252.0) - 1.0
    vol = F.stddev_samp("_r") * root(252)
    return d.groupBy(*keys).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n_bars"),
        ((F.max_by("close", "ts") / F.min_by("close", "ts") - 1.0) * 100.0).alias("total_return"),
        (ann * 100.0).alias("ann_return"), (vol * 100.0).alias("ann_vol"),
        F.when(vol > 0, ann / nz(vol)).otherwise(0.0).alias("sharpe_bnh"),
        (F.min("drawdown") * 100.0).alias("max_dd"), (F.avg("volume") / 1e6).alias("avg_volume_m"))


def information_coefficient(df: DataFrame, features: list[str], target: str = "fwd_return", keys=(), names: list[tuple] | None = None) -> DataFrame:
    """Correlation of each feature with the forward return, as rows (keys.., feature, ic); one pass over wide rows serves all of them."""
    return wide.correlations(df, features, target, list(keys), names).select(*keys, "feature", C("corr").alias("ic"))


def regression_metrics(df: DataFrame, keys, y: str, yhat: str) -> DataFrame:
    e = C(y) - C(yhat)
    a = df.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
        F.avg((F.signum(y) == F.signum(yhat)).cast("double")).alias("directional_accuracy"))
    return a.withColumn("r2", 1.0 - C("_sse") / nz("_sst")).drop("_sse", "_sst")
