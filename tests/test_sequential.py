import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import walk

from tidepanel.operators import fractional as fr, labels as lb, regime as rg, sequential as sq


def rets(pdf):
    return pdf.sort_values("ts")["close"].pct_change().fillna(0).to_numpy()


def col(df, name, symbol):
    out = df.where(F.col("symbol") == symbol).toPandas().sort_values("ts")
    return out[name].to_numpy()


def test_directional_change_equals_a_loop(panel, panel_pdf):
    got = col(lb.directional_change(panel), "dc_label", "LONG")
    px = panel_pdf[panel_pdf.symbol == "LONG"]["close"].to_numpy()
    ref, up, want = px[0], True, [0]
    for v in px[1:]:
        hit = v >= ref * 1.015 if up else v <= ref * 0.985
        want.append((1 if up else -1) if hit else 0)
        if hit:
            ref, up = v, not up
    assert (got == want).all() and (got != 0).sum() >= 5


def test_cusum_equals_a_loop(panel, panel_pdf):
    got = col(rg.cusum(panel), "cp_cusum", "LONG")
    r = rets(panel_pdf[panel_pdf.symbol == "LONG"])
    z = (r - r.mean()) / r.std()
    hi = lo = 0.0
    want = [0]
    for v in z[1:]:
        hi, lo = max(0, hi + v), max(0, lo - v)
        want.append(int(hi > 4 or lo > 4))
        if want[-1]:
            hi = lo = 0.0
    assert (got == want).all() and got.sum() > 0


def test_segments_find_a_shift_and_equal_a_recursion(spark):
    rng = np.random.default_rng(3)
    series = {"A": np.r_[rng.normal(0, 0.002, 60), rng.normal(0, 0.03, 60), rng.normal(0.05, 0.004, 40)], "B": rng.normal(0, 0.01, 90), "C": np.zeros(30), "D": rng.normal(0, 1e-2, 4)}
    frames = [pd.DataFrame({"symbol": k, "ts": pd.date_range("2020-01-01", periods=len(r)), "close": 100 * np.cumprod(1 + np.r_[0.0, r[1:]])}) for k, r in series.items()]
    out = rg.segments(spark.createDataFrame(pd.concat(frames), "symbol string, ts timestamp_ntz, close double"))

    def splits(x, a, b):
        def cost(s, t):
            return (t - s) * math.log(max(x[s:t].var(), 1e-12))
        gains = [(cost(a, b) - cost(a, i) - cost(i, b), -i) for i in range(a + 5, b - 4)]
        if not gains or max(gains)[0] <= 10:
            return []
        i = -max(gains)[1]
        return splits(x, a, i) + [i] + splits(x, i, b)

    for f in frames:
        x, got = rets(f), np.flatnonzero(col(out, "cp_segment", f["symbol"][0])).tolist()
        assert got == splits(x, 0, len(x))
        assert f["symbol"][0] != "A" or any(abs(g - 60) <= 3 for g in got) and any(abs(g - 120) <= 3 for g in got)
    assert out.count() == sum(map(len, frames))


def test_fresh_run_probability_is_the_posterior_of_the_definition(panel, panel_pdf):
    got = col(rg.fresh_run_prob(panel.where("symbol = 'SHORT'")), "cp_prob", "SHORT")
    x = rets(panel_pdf[panel_pdf.symbol == "SHORT"])
    run, mu, ka, al, be, want = [1.0], [0.0], [1.0], [1.0], [1.0], []
    for v in x:
        pred = []
        for m, k, a, b in zip(mu, ka, al, be):
            nu, sc = 2 * a, math.sqrt(b * (k + 1) / (a * k))
            pred.append(math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * sc ** 2) - (nu + 1) / 2 * math.log(1 + ((v - m) / sc) ** 2 / nu)))
        new = [sum(p * q * 0.02 for p, q in zip(run, pred))] + [p * q * 0.98 for p, q in zip(run, pred)]
        run = [p / sum(new) for p in new]
        want.append(run[0])
        be = [b + 0.5 * k / (k + 1) * (v - m) ** 2 for m, k, b in zip(mu, ka, be)] + [1.0]
        mu = [(k * m + v) / (k + 1) for m, k in zip(mu, ka)] + [0.0]
        ka, al = [k + 1 for k in ka] + [1.0], [a + 0.5 for a in al] + [1.0]
    assert np.allclose(got, want, rtol=1e-9)


def test_drawdown_tiers_tighten_at_once_and_loosen_after_three(spark):
    nav = [100, 94, 89, 79, 101, 102, 103, 103]
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=len(nav)), "equity": np.array(nav, float)})
    got = sq.drawdown_tiers(spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, equity double")).toPandas().sort_values("ts")
    assert got["tier"].tolist() == ["normal", "caution", "derisked", "halted", "halted", "halted", "normal", "normal"]
    assert got["changed"].tolist() == [0, 1, 1, 1, 0, 0, 1, 0]


def test_minimum_holding(spark):
    sig = [1, 1, 0, 0, 0, 0, 0, -1, -1, -1]
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=len(sig)), "signal": sig})
    got = sq.filter_signals(spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, signal int"), 5, 2).toPandas().sort_values("ts")
    assert got["filtered"].tolist() == [0, 1, 1, 1, 1, 1, 0, 0, -1, -1]


def test_fractional_difference_of_order_one_is_the_change(panel):
    d = panel.withColumn("f", fr.fracdiff("close", 1.0)).toPandas().sort_values(["symbol", "ts"])
    assert np.allclose(d["f"].astype(float), d.groupby("symbol")["close"].diff(), equal_nan=True)


def adf_t(y):
    """t value of y1 in dy = a + b y1 + c dy1 by least squares."""
    dy = np.diff(y)
    x = np.column_stack([np.ones(len(dy) - 1), y[1:-1], dy[:-1]])
    b, *_ = np.linalg.lstsq(x, dy[1:], rcond=None)
    e = dy[1:] - x @ b
    return b[1] / np.sqrt(e @ e / (len(e) - 3) * np.linalg.inv(x.T @ x)[1, 1])


def least_order(v, low, high=1.0, tolerance=0.01, threshold=1e-4):
    def passes(d):
        w = fr.frac_weights(d, threshold)
        y = np.array([w @ v[t - len(w) + 1:t + 1] for t in range(len(w) - 1, len(v))])
        return len(y) >= 20 and adf_t(y) < -2.86
    if passes(low):
        return low
    if not passes(high):
        return high
    while high - low >= tolerance:
        mid = (low + high) / 2
        low, high = (low, mid) if passes(mid) else (mid, high)
    return round(high, 3)


def test_least_order_equals_a_loop_whatever_the_blocks(spark):
    rng = np.random.default_rng(4)
    made = {"NOISE": rng.normal(0, 1, 900) + 50, "WALK": np.cumsum(rng.normal(0, 1, 1500)) + 1e4, "TREND": np.cumsum(np.cumsum(rng.normal(0, 1, 900))), "SHORT": rng.normal(0, 1, 12), "WALK2": np.cumsum(rng.normal(0, 1, 700))}
    pdf = pd.concat([pd.DataFrame({"symbol": s, "ts": pd.date_range("2020-01-01", periods=len(v)), "close": v}) for s, v in made.items()])
    df = spark.createDataFrame(pdf, "symbol string, ts timestamp_ntz, close double")
    gap = spark.createDataFrame([("WALK", None, float("nan")), ("WALK", None, None)], df.schema).withColumn("ts", F.lit("2021-01-01 12:00:00").cast("timestamp_ntz"))
    for rows in (512, 4096):
        got = {r.symbol: r.optimal_d for r in fr.least_orders(df.union(gap), low=0.1, rows=rows).collect()}
        want = {s: least_order(v, 0.1) for s, v in made.items()}
        assert got == want and 0.1 < got["WALK"] < 1.0
    out = fr.fracdiff_by_symbol(df, spark.createDataFrame([("WALK", 0.4), ("SHORT", 0.4)], "symbol string, optimal_d double"), rows=512).toPandas().sort_values(["symbol", "ts"])
    w = fr.frac_weights(0.4, 1e-4)
    y = np.array([w @ made["WALK"][t - len(w) + 1:t + 1] for t in range(len(w) - 1, 1500)])
    x = out[out.symbol == "WALK"]["close_fd"].to_numpy(float)
    assert np.isnan(x[:len(w) - 1]).all() and np.allclose(x[len(w) - 1:], y) and out[out.symbol == "SHORT"]["close_fd"].isna().all()


def test_segments_of_short_series_equal_those_in_rounds_and_move_rows_once(spark):
    frames = [walk(s, n, i) for i, (s, n) in enumerate((("A", 260), ("B", 9), ("C", 10), ("D", 120)))]
    frames.append(walk("E", 80, 9).assign(close=50.0))
    d = spark.createDataFrame(pd.concat(frames)[["symbol", "ts", "close"]], "symbol string, ts timestamp_ntz, close double")
    d = d.unionByName(d.where("symbol = 'B'").withColumn("symbol", F.lit(None).cast("string"))).unionByName(d.where("symbol = 'A' AND day(ts) = 3"))
    short, long = rg.segments(d, 1.0), rg.segments(d, 1.0, longest=100)      # A and D go in rounds
    a, b = (sorted(((r.symbol or "", r.ts, r.cp_segment) for r in x.where("symbol <> 'A' OR symbol IS NULL").collect())) for x in (short, long))
    assert a == b and sum(x[2] for x in a) > 0
    assert short.count() == long.count() == d.count()
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
