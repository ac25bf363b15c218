import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from tidepanel.operators import backtest as bk, metrics as mt, ranking as rk, splits as sp


def make(spark, closes, signals):
    ts = pd.date_range("2024-01-01", periods=len(closes), freq="D")
    return spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": ts, "close": np.array(closes, float), "signal": np.array(signals, float)}),
                                 "symbol string, ts timestamp_ntz, close double, signal double")


def test_position_is_delayed_one_bar(spark):
    bt = bk.run(make(spark, [100, 110, 121], [1, 1, 1]), bk.cost("zero")).toPandas().sort_values("ts")
    assert bt["position"].tolist() == [0, 1, 1]
    assert np.allclose(bt["equity"], [100_000, 110_000, 121_000])


def test_costs_are_charged_on_turnover(spark):
    bt = bk.run(make(spark, [100, 100, 100, 100], [1, -1, 0, 0]), 0.001).toPandas().sort_values("ts")
    side = 0.001 + 0.0005 + 0.0002
    assert np.allclose(bt["cost_drag"], [0, side, 2 * side, side])


def test_reversal_makes_two_trades_and_last_one_stays_open(spark):
    bt = bk.run(make(spark, [100, 100, 110, 99, 99, 90], [1, 1, -1, -1, -1, -1]), bk.cost("zero"))
    t = bk.trades(bt).toPandas().sort_values("entry_date").reset_index(drop=True)
    assert t["direction"].tolist() == ["long", "short"]
    assert np.allclose(t["return_pct"], [-1.0, round(-(90 / 99 - 1) * 100, 4)])
    assert t["open_at_end"].tolist() == [False, True] and t["bars_held"].tolist() == [2, 2]


def test_metrics_against_plain_formulas(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(0.001, 0.01, 300)
    eq = 100_000 * np.cumprod(1 + r)
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2020-01-01", periods=300), "net_return": r, "equity": eq})
    m = mt.all_metrics(spark.createDataFrame(pdf), ("symbol",)).first()
    ann = np.prod(1 + r) ** (252 / 300) - 1
    vol = r.std(ddof=1) * np.sqrt(252)
    peak = np.maximum.accumulate(eq)
    assert np.isclose(m["annualised_return"], ann) and np.isclose(m["sharpe_ratio"], ann / vol)
    assert np.isclose(m["max_drawdown"], ((eq - peak) / peak).min())
    longest = run = 0
    for under in eq < peak:
        run = run + 1 if under else 0
        longest = max(longest, run)
    assert m["max_drawdown_duration_bars"] == longest


def test_walk_forward_folds_have_the_gap(panel):
    f = sp.bar_folds(panel.where("symbol IN ('LONG', 'MID')")).toPandas()
    assert ((f.test_start - f.train_end) == 22).all() and ((f.train_end - f.train_start) == 125).all()
    status = {r["symbol"]: r["status"] for r in sp.fold_status(panel).collect()}
    assert status["LONG"] == status["MID"] == "ok" and "too few folds" in status.values()
    assert {r["symbol"] for r in sp.bar_folds(panel).select("symbol").distinct().collect()} == {s for s, v in status.items() if v == "ok"}


def test_top_n_keeps_exactly_n_with_ties(spark):
    pdf = pd.DataFrame({"ts": [1] * 6, "symbol": list("FEDCBA"), "score": [1.0, 1, 1, 1, 2, 2]})
    got = rk.top_n(spark.createDataFrame(pdf), 3).toPandas().sort_values("rank")
    assert got["symbol"].tolist() == ["A", "B", "C"]


def test_block_bootstrap_is_repeatable(panel):
    s = sp.momentum_signal(panel.where("symbol = 'LONG'"))
    a = bk.block_bootstrap(s, 4).toPandas().sort_values("resample")["sharpe"].to_numpy()
    b = bk.block_bootstrap(s, 4).toPandas().sort_values("resample")["sharpe"].to_numpy()
    assert np.array_equal(a, b) and len(set(a)) > 1


def exchanges_above_copies(df):
    """Shuffles and sorts that a plan runs on rows already copied."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    return plan.count("Exchange"), plan.count("Sort [")


def test_copies_of_resampled_bars_are_neither_shuffled_nor_sorted(panel):
    s = sp.momentum_signal(panel)
    for d in (bk.signal_noise(s, 4), bk.crash_injection(s)):
        assert exchanges_above_copies(d) == (0, 0)
    assert "Generate" not in bk.block_bootstrap(s, 4)._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_paths_in_small_steps_equal_one_step(monkeypatch):
    ret = np.random.default_rng(1).normal(0, 0.01, 130)
    whole = np.vstack([r for _, r in bk.block_paths(ret, 7, 42)])
    monkeypatch.setattr(bk, "PATHS", 300)
    parts = list(bk.block_paths(ret, 7, 42))
    assert len(parts) == 4 and np.array_equal(np.vstack([r for _, r in parts]), whole)


def test_noise_equals_a_backtest_of_the_noisy_signals(spark, panel):
    s = sp.momentum_signal(panel.where("symbol = 'MID'"))
    d = s.withColumn("rn", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    x = (F.col("rn").cast("bigint") * 1000003 + 7919 + 42) % 2147483647
    want = bk.sharpes(bk.run(d.withColumn("signal", F.signum(F.col("signal") + 0.05 * bk.gaussian(x)))), ("symbol",)).first()["sharpe"]
    assert np.isclose(bk.signal_noise(s, 2).where("resample = 1").first()["sharpe"], want)


def test_variants_are_copied_after_their_windows(panel):
    d = panel.where("symbol IN ('LONG', 'FLAT')").withColumns({"proba": F.lit(0.8) - F.col("volume") / 2000, "golden_cross": F.lit(1)})
    nav = bk.variant_navs(d, bk.variant_positions())
    assert exchanges_above_copies(nav) == (0, 0)
    hold = nav.where("variant = 'buy_and_hold' AND symbol = 'LONG'").toPandas().sort_values("ts")
    close = panel.where("symbol = 'LONG'").toPandas().sort_values("ts")["close"].to_numpy()
    assert np.allclose(hold["nav"], close / close[0])
    top = np.maximum.accumulate(hold["nav"].to_numpy())
    assert np.allclose(hold["drawdown"], hold["nav"].to_numpy() / top - 1)


def test_fold_bounds_are_neither_expanded_nor_broadcast(panel):
    b = panel.where("symbol IN ('LONG', 'MID')")
    folds = sp.bar_folds(b)
    got = sp.assign_bar_folds(b, folds)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    rows, f = got.toPandas(), folds.toPandas()
    want = sum(int(r.train_end - r.train_start + 1 + r.test_end - r.test_start + 1) for r in f.itertuples())
    assert len(rows) == want and sorted(got.columns) == sorted([*b.columns, "rn", "fold", "split"])
    m = rows.merge(f, on=["symbol", "fold"])
    train = m.rn.between(m.train_start, m.train_end)
    assert (train == (m.split == "train")).all() and (train | m.rn.between(m.test_start, m.test_end)).all()
