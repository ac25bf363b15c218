"""Trailing frames by numpy against the window expressions of Spark."""
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.plans.catalogue import quick_round
from tidepanel.plans.registry import rd
from tidepanel.functions import trailing as t
from tidepanel.functions.windows import Series, corr_over, pct_rank, quantile_of
from tidepanel.operators import features as feats

P = Series()


@pytest.fixture(scope="module")
def odd(spark):
    """Series of 1 to 90 bars, one without a symbol, with gaps, ties and a constant stretch."""
    rows = []
    for s, n in (("a", 90), ("b", 3), (None, 40), ("c", 1), ("d", 70)):
        for i in range(n):
            x = 5.1 if s == "d" and 20 <= i < 50 else float((i * 37 + n) % 23) / 3
            rows.append((s, datetime(2020, 1, 1) + timedelta(days=i), None if i % 11 == 4 else x, None if i % 7 == 2 else float(i * i % 19)))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double, y double").repartition(3)


def test_trailing_equals_spark_windows_over_many_small_batches(spark, odd):
    n, f = 12, P.last(12)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = t.trailing(odd, {"r": t.Trailing(t.rank(5), ("x",), n), "q": t.Trailing(t.quantile(0.3, 5), ("x",), n), "s": t.deviations("x", n, 5), "m": t.means("x", n, 5),
                               "hi": t.Trailing(t.most(5), ("x",), n), "lo": t.Trailing(t.most(5, -1), ("x",), n), "c": t.Trailing(t.correlation(5), ("x", "y"), n),
                               "sk": t.Trailing(t.skewness(5), ("x",), n), "ku": t.Trailing(t.kurtosis(5), ("x",), n)}).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = odd.withColumn("_a", F.sort_array(F.collect_list("x").over(f))).withColumns({
        "r": pct_rank("_a", "x", 5), "q": quantile_of("_a", 0.3, 5), "s": F.when(F.count("x").over(f) >= 5, F.stddev_samp("x").over(f)), "m": F.when(F.count("x").over(f) >= 5, F.avg("x").over(f)),
        "hi": F.when(F.count("x").over(f) >= 5, F.max("x").over(f)), "lo": F.when(F.count("x").over(f) >= 5, F.min("x").over(f)),
        "c": F.when(F.count(F.col("x") + F.col("y")).over(f) >= 5, corr_over("x", "y", f)), "sk": P.skew("x", n, 5), "ku": P.kurt("x", n, 5)}).collect()
    want = {(r.symbol, r.ts): r for r in want}
    assert len(got) == len(want) == 204
    for r in got:
        for c in ("r", "q", "s", "m", "hi", "lo", "c", "sk", "ku"):
            w = want[r.symbol, r.ts][c]
            assert (r[c] is None) == (w is None) and (w is None or r[c] == pytest.approx(w, rel=1e-9, abs=1e-9)), (c, r, w)


def test_count_of_a_frame(odd):
    d = odd.withColumns({"a": P.count("x", 9), "b": F.count("x").over(P.last(9))})
    assert d.where("a <> b").count() == 0


def test_catalogue_gathers_no_frames_and_walks_only_short_ones(spark, odd):
    """Frames of a quarter or a year are no longer walked row by row by the windows, and no list is made of them."""
    from tidepanel.sources.tables import MACRO_TICKERS
    bars = odd.select("symbol", "ts", *[F.col("x").alias(c) for c in ("open", "high", "low", "close")], F.col("y").alias("volume"))
    macro = spark.createDataFrame([(k, datetime(2020, 1, 1), 1.0) for k in MACRO_TICKERS], "ticker string, ts timestamp_ntz, close double")
    plan = feats.generate_features(bars, list(feats.FAMILIES), macro)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    assert all(f"RowFrame, -{n - 1}, " not in plan for n in (126, 200, 252))


def test_frames_of_the_bars_alone_are_not_walked(spark, odd):
    """Means, deviations and extremes of the bars and of their returns are trailing kernels before the windows: few frames are left to walk."""
    from tidepanel.sources.tables import MACRO_TICKERS
    bars = odd.select("symbol", "ts", *[F.col("x").alias(c) for c in ("open", "high", "low", "close")], F.col("y").alias("volume"))
    macro = spark.createDataFrame([(k, datetime(2020, 1, 1), 1.0) for k in MACRO_TICKERS], "ticker string, ts timestamp_ntz, close double")
    plan = feats.generate_features(bars, list(feats.FAMILIES), macro)._jdf.queryExecution().optimizedPlan().toString()
    assert all(f"RowFrame, -{n - 1}, " not in plan for n in (50, 63))
    d = bars.withColumn("r", P.pct("close"))
    want = {(r.symbol, r.ts): r for r in d.withColumns({"v": P.std("r", 5), "m": P.mean("r", 21, 10), "s": P.mean("close", 10)}).collect()}
    got = t.trailing(bars, {"v": t.Trailing(t.of_returns(t.std(5)), ("close",), 6), "m": t.Trailing(t.of_returns(t.mean(10)), ("close",), 22), "s": t.means("close", 10)}).collect()
    for r in got:
        for c in ("v", "m", "s"):
            w = want[r.symbol, r.ts][c]
            assert (r[c] is None) == (w is None) and (w is None or r[c] == pytest.approx(w, rel=1e-9, abs=1e-9)), (c, r, w)


def test_reading_the_catalogue_shuffles_nothing(spark, sf):
    """The label is stored with the features: what is read afterwards needs no window over the wide rows."""
    from tidepanel.plans.catalogue import catalogue
    d = catalogue(spark, sf)
    assert d.columns[-2:] == ["fwd_return", "label"]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_tail_risk_and_differences_gather_no_frames(spark, odd):
    from tidepanel.operators import fractional, risk
    b = odd.withColumn("close", F.coalesce("x", F.lit(3.0)))
    for d in (risk.tail_risk(b), fractional.fracdiff_columns(b, 0.5, ("close",))):
        assert "collect_list" not in d._jdf.queryExecution().executedPlan().toString()
        assert d.count() == 204
    w = fractional.frac_weights(0.5, 1e-1)
    got = fractional.fracdiff_columns(b, 0.5, ("close",), 1e-1).withColumn("w", fractional.fracdiff("close", 0.5, 1e-1))
    assert len(w) > 1 and got.where("close_fd IS NULL").count() == got.where("w IS NULL").count() > 0
    assert got.where("abs(close_fd - w) > 1e-9").count() == 0


def test_skewness_walks_no_frame(spark, sf):
    from tidepanel.plans import QUERIES
    assert "skewness" not in QUERIES["WIN-2"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_quick_rounding_gives_what_decimal_text_gives(spark):
    """The catalogue's rounding without decimal text: same values, also where it has to fall back."""
    rng = np.random.default_rng(4)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1e-12, -1e-12, 0.1234565, -0.1234565, 2.5e-6, 1e6, -1e6, 1048576.0, 3e9, 1e18, -1e300]
    xs = odd + (rng.normal(0, 1, 3000) * 10.0 ** rng.integers(-9, 14, 3000)).tolist() + (rng.integers(-10 ** 6, 10 ** 6, 1000) / 2e6).tolist()
    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for digits in (3, 6, 8):
        both = d.select(rd("x", digits).alias("a"), quick_round("x", digits).alias("b"))
        assert both.where("NOT (a <=> b)").count() == 0
    plan = d.select(quick_round("x", 6).alias("b")).where("b > 1")._jdf.queryExecution().optimizedPlan().toString()
    assert "rint" in plan.lower()
