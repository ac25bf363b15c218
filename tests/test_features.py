import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import features as feats, labels as lb, user
from tidepanel.sources.panel import as_of_filter, assert_no_future

OWN = [i for i, f in feats.FAMILIES.items() if not any(x.macro for x in feats.closure([i]))]


def frame(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


def test_truncated_history_gives_the_same_past(panel):
    """No feature may look ahead: cutting the future away changes nothing before the cut."""
    cut = "2021-02-01"
    full = frame(feats.generate_features(panel, OWN).where(F.col("ts") <= F.lit(cut + " 23:59:59").cast("timestamp_ntz")))
    part = frame(feats.generate_features(as_of_filter(panel, cut), OWN))
    pd.testing.assert_frame_equal(full, part, rtol=1e-9)


def test_future_spike_leaves_the_past_alone(panel):
    ids = ["FEA-1", "FEA-6", "FEA-9", "FEA-14", "FEA-37", "FEA-59"]
    spike = panel.withColumn("close", F.when(F.col("ts") > F.lit("2021-06-01").cast("timestamp_ntz"), F.col("close") * 5).otherwise(F.col("close")))
    past = F.col("ts") <= F.lit("2021-06-01").cast("timestamp_ntz")
    pd.testing.assert_frame_equal(frame(feats.generate_features(panel, ids).where(past)), frame(feats.generate_features(spike, ids).where(past)), rtol=1e-9)


def test_against_pandas(panel, panel_pdf):
    got = frame(feats.generate_features(panel, ["FEA-2", "FEA-5", "FEA-21", "FEA-56", "FEA-59"]))
    got = got[got.symbol == "LONG"].reset_index(drop=True)
    c = panel_pdf[panel_pdf.symbol == "LONG"]["close"].reset_index(drop=True)
    r = c.pct_change()
    assert np.allclose(got["ret_skew_21d"], r.rolling(21).skew(), equal_nan=True)
    assert np.allclose(got["ret_kurt_21d"], r.rolling(21).kurt(), equal_nan=True)
    d = c.diff()
    rs = d.clip(lower=0).rolling(14).mean() / ((-d.clip(upper=0)).rolling(14).mean() + 1e-9)
    rsi = 100 - 100 / (1 + rs)
    assert np.allclose(got["rsi_14"], rsi, equal_nan=True)
    assert np.allclose(got["rsi_14_rank"], rsi.rolling(63, min_periods=31).rank(pct=True), equal_nan=True)
    sd, m = c.rolling(20).std(), c.rolling(20).mean()
    w = 4 * sd / (m + 1e-9)
    assert (got["bb_squeeze"] == (w < w.rolling(63, min_periods=20).quantile(0.2)).astype(int)).mean() > 0.999
    up = (r > 0).astype(int)
    want = up.groupby((up != up.shift()).cumsum()).cumsum() * up
    assert (got["up_streak"] == want).all()


def test_bounds_on_constant_prices(panel):
    got = frame(feats.generate_features(panel, ["FEA-5", "FEA-7", "FEA-9", "FEA-37"]))
    flat = got[got.symbol == "FLAT"]
    assert (flat["vol_21d"].dropna() == 0).all() and flat["stoch_k"].isna().all()
    assert got["rsi_14"].dropna().between(0, 100).all() and got["hurst_63"].dropna().between(0, 1).all()


def test_cutoff_guard_fails_the_job(panel):
    with pytest.raises(Exception, match="row after the cutoff"):
        assert_no_future(panel, "2020-03-01").count()


def test_triple_barrier_equals_a_loop(panel, panel_pdf):
    got = frame(lb.triple_barrier(panel))
    got = got[got.symbol == "MID"].reset_index(drop=True)
    c = panel_pdf[panel_pdf.symbol == "MID"]["close"].to_numpy()
    vol = pd.Series(c).pct_change().rolling(21, min_periods=5).std().to_numpy()
    for i in range(len(c)):
        lab, ret = 0, 0.0
        if i + 5 < len(c) and vol[i] > 0:
            nxt = c[i + 1:i + 6]
            hit = [p for p in nxt if p >= c[i] * (1 + 1.5 * vol[i]) or p <= c[i] * (1 - vol[i])]
            ret = (hit[0] if hit else nxt[-1]) / c[i] - 1
            lab = 0 if not hit else (1 if hit[0] > c[i] else -1)
        assert got.loc[i, "tb_label"] == lab and np.isclose(got.loc[i, "tb_ret"], ret)


def test_look_ahead_check_finds_a_leak(panel):
    user.factor("leaky")(lambda p: [{"leaky": p.lead("close", 3)}])
    user.factor("causal")(lambda p: [{"causal": p.lag("close", 3)}])
    assert user.looks_ahead(panel, "leaky", "2020-06-01").count() > 0
    assert user.looks_ahead(panel, "causal", "2020-06-01").count() == 0
