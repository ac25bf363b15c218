"""Cross-sectional ranking per date, eligibility, exposure gate, weights and the resulting portfolio."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scale import split_rank
from ..functions.windows import Series, col, nz

C = F.col

def by_date():
    return Window.partitionBy("ts")


def cross_rank(df: DataFrame, x: str, out: str, nulls_best: bool = False, parts: int = 0) -> DataFrame:
    """Percentile rank per date, ties averaged. Missing values are not ranked; ``nulls_best`` ranks them on
    top as the old behaviour did. ``parts`` > 0 splits very wide dates over several tasks."""
    if parts and not nulls_best:
        return split_rank(df, ["ts"], x, out, parts)
    order = F.asc_nulls_last(x)
    ties = F.count(F.lit(1)).over(Window.partitionBy("ts", x))
    r = F.rank().over(by_date().orderBy(order)) + (ties - 1) / 2.0
    n = F.count(F.lit(1) if nulls_best else col(x)).over(by_date())
    expr = r / n
    return df.withColumn(out, expr if nulls_best else F.when(col(x).isNotNull(), expr))


def eligible(df: DataFrame, min_dollar_volume: float = 0.0, min_confidence: float = 0.52, bear_min_confidence: float | None = None,
             momentum_filter: bool = False, confidence: str = "confidence", regime: str | None = None) -> DataFrame:
    """Valid close, liquid enough, confident enough (a separate bar in a bear regime), optionally in an uptrend."""
    ok = C("close").isNotNull() & (C("close") > 0)
    if min_dollar_volume > 0:
        ok = ok & (C("close") * F.coalesce("volume", F.lit(0.0)) >= min_dollar_volume)
    need = F.lit(min_confidence)
    if regime and bear_min_confidence is not None:
        need = F.when(C(regime) == 0, bear_min_confidence).otherwise(min_confidence)
    ok = ok & (col(confidence) >= need)
    if momentum_filter:
        ok = ok & (C("sma_50_above_200") == 1)
    return df.where(ok)


def ranking_score(mode: str, confidence: str = "confidence", vol_adjusted: bool = False) -> Column:
    """Score by mode; missing ranks count as 0.5."""
    half = F.lit(0.5)
    conf = col(confidence)
    scores = {
        "cross_momentum": lambda: F.coalesce(C("cross_mom_rank"), half),
        "liquidity": lambda: C("close") * C("volume"),
        "momentum": lambda: F.coalesce(C("mom_12_1_rank"), half),
        "channel": lambda: F.coalesce(C("channel_pos_52w"), half),
        "composite": lambda: 0.5 * conf + 0.5 * F.coalesce(C("mom_12_1_rank"), half),
        "amihud": lambda: C("close") * C("close") / F.greatest(C("amihud_illiq"), F.lit(1e-12)),
    }
    if mode in scores:
        return scores[mode]()
    return conf / F.greatest(C("vol_21d"), F.lit(0.08)) if vol_adjusted else conf


def breadth(df: DataFrame, flag_col: str = "sma_50_above_200", out: str = "breadth") -> DataFrame:
    """Share of symbols with the flag per date, aggregated first so wide dates combine map-side."""
    return df.groupBy("ts").agg(F.avg((C(flag_col) == 1).cast("double")).alias(out))


def exposure_gate(dates: DataFrame, top_n: int, breadth_threshold: float = 0.0) -> DataFrame:
    """n_eff per date from columns ``bench_on`` (0 = out of the market, NULL = unknown) and ``breadth``."""
    half = F.lit(max(1, top_n // 2))
    low = (C("breadth") < breadth_threshold) if breadth_threshold > 0 else F.lit(False)
    return dates.withColumn("n_eff", F.when(C("bench_on") == 0, 0).when(low, half).otherwise(top_n).cast("int"))


def top_n(df: DataFrame, n, score: str = "score") -> DataFrame:
    """Best n per date, ties by symbol; the rank filter lets Spark cut each partition before the shuffle."""
    w = by_date().orderBy(F.desc(score), "symbol")
    return df.withColumn("rank", F.row_number().over(w)).where(C("rank") <= n)


def weights(df: DataFrame, score: str = "score", proportional: bool = True) -> DataFrame:
    """Score-proportional or equal weights inside the selected names of each date."""
    if proportional:
        return df.withColumn("weight", col(score) / (F.sum(score).over(by_date()) + 1e-9))
    return df.withColumn("weight", 1.0 / F.count(F.lit(1)).over(by_date()))


def top_list(df: DataFrame, n: int = 5, score: str = "score") -> DataFrame:
    """Comma string of the best names per date; only n rows per date reach the list."""
    t = top_n(df, n, score)
    arr = F.array_sort(F.collect_list(F.struct("rank", "symbol")))
    return t.groupBy("ts").agg(F.concat_ws(",", F.transform(arr, lambda s: s["symbol"])).alias("top"))


def portfolio_return(weights_: DataFrame, bars: DataFrame, cost_per_side: float = 0.0015) -> DataFrame:
    """Portfolio of yesterday's weights: sum of lagged weight x return minus turnover cost, per date.

    Weights live on the symbols' own bars (absent = 0), so a name that leaves is sold at its next bar.
    """
    p = Series()
    d = bars.select("symbol", "ts", "close").join(weights_.select("symbol", "ts", "weight"), ["symbol", "ts"], "left")
    d = d.withColumn("w", F.coalesce("weight", F.lit(0.0)))
    d = d.withColumns({"held": F.coalesce(p.lag("w"), F.lit(0.0)), "ret": F.coalesce(p.pct("close"), F.lit(0.0))})
    d = d.withColumn("turn", F.abs(C("held") - F.coalesce(p.lag("held"), F.lit(0.0))))
    day = d.groupBy("ts").agg(F.sum(C("held") * C("ret")).alias("gross_return"), F.sum("turn").alias("turnover"),
                              F.count_if(C("held") != 0).alias("n_held"))
    return day.withColumn("net_return", C("gross_return") - C("turnover") * cost_per_side)


def sector_exposure(w: DataFrame, universe: DataFrame, limit: float = 0.5) -> DataFrame:
    """Weight per date and sector, concentration flag, and effective number of names."""
    d = w.join(universe.select("symbol", "sector"), "symbol", "left").withColumn("sector", F.coalesce("sector", F.lit("unknown")))
    s = d.groupBy("ts", "sector").agg(F.sum("weight").alias("exposure"))
    n = w.groupBy("ts").agg((1.0 / nz(F.sum(C("weight") * C("weight")))).alias("effective_n"))
    return s.join(n, "ts").withColumn("concentrated", C("exposure") > limit)


def last_rows(df: DataFrame, n: int = 1, keys=("symbol",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"))
    return df.withColumn("_r", F.row_number().over(w)).where(C("_r") <= n).drop("_r")
