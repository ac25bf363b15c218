import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import scale
from tidepanel.functions.windows import Series, ewm, ewms
from tidepanel.operators import features as feats


def test_row_numbers_and_prefix_sums_split_a_symbol(panel, panel_pdf):
    got = scale.prefix_sum(scale.row_numbers(panel, ["symbol"], width="month"), ["symbol"], "volume", "run", width="month").toPandas()
    got = got.sort_values(["symbol", "ts"]).reset_index(drop=True)
    want = panel_pdf.sort_values(["symbol", "ts"]).reset_index(drop=True)
    assert (got["_rn"].values == want.groupby("symbol").cumcount().values).all()
    assert np.allclose(got["run"], want.groupby("symbol")["volume"].cumsum())


@pytest.mark.parametrize("ids", [["FEA-3", "FEA-9"], ["FEA-12", "FEA-20"], ["FEA-15", "FEA-47", "FEA-56"]])
def test_chunked_features_equal_unchunked(panel, ids):
    a = feats.generate_features(panel, ids).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    b = feats.generate_features(panel, ids, chunk_rows=310).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-12)


def test_chunking_refuses_families_without_bound(panel):
    with pytest.raises(ValueError):
        feats.generate_features(panel, ["FEA-14"], chunk_rows=500)


def test_split_rank_equals_pandas_with_one_hot_group(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"ts": np.where(rng.random(3000) < 0.6, 1, rng.integers(2, 9, 3000)), "x": np.round(rng.normal(size=3000), 2)})
    pdf.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).withColumn("id", F.monotonically_increasing_id())
    got = scale.split_rank(df, ["ts"], "x", "r", 7).toPandas().sort_values("id").reset_index(drop=True)
    want = got.groupby("ts")["x"].rank(pct=True)
    assert np.allclose(got["r"].astype(float), want, equal_nan=True)
    assert got["r"].isna().sum() == pdf["x"].isna().sum()


@pytest.mark.parametrize("n", [1, 2, 7, 60, 5000])
def test_exact_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame({"g": ["a"] * n + ["b"] * 11, "v": np.r_[np.round(rng.standard_t(2, n), 2), np.zeros(11)]})
    qs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = scale.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", qs, accuracy=100 if n == 5000 else 10000).toPandas()
    assert len(got) == 2 * len(qs)
    for _, r in got.iterrows():
        assert np.isclose(r["value"], np.quantile(pdf.loc[pdf.g == r["g"], "v"], r["q"])), r


def test_exact_quantiles_without_group(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert scale.exact_quantiles(df, [], "v", [0.5]).first()["value"] == 500.0


def test_bounded_groups_refuses_instead_of_trimming(panel):
    assert scale.bounded_groups(panel, ["symbol"], 700).count() == panel.count()
    with pytest.raises(Exception, match="too long"):
        scale.bounded_groups(panel, ["symbol"], 100).count()


def test_scan_keeps_state_between_arrow_batches(spark, panel, panel_pdf):
    def step(state, pdf):
        run = pdf["volume"].cumsum() + (state or 0.0)
        return pdf[["symbol", "ts"]].assign(run=run), float(run.iloc[-1])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = scale.scan_by_key(panel, ["symbol"], "ts", step, "symbol string, ts timestamp_ntz, run double").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = panel_pdf.assign(run=panel_pdf.groupby("symbol")["volume"].cumsum())
    m = got.merge(want, on=["symbol", "ts"])
    assert len(m) == len(panel_pdf) and np.allclose(m["run_x"], m["run_y"])


@pytest.mark.parametrize("span", [2, 9, 26, 63])
def test_ewm_equals_the_recurrence(panel, panel_pdf, span):
    got = ewm(panel, "close", span, "e", Series(), span).toPandas().sort_values(["symbol", "ts"])
    want = panel_pdf.sort_values(["symbol", "ts"]).groupby("symbol")["close"].transform(lambda s: s.ewm(span=span, adjust=False, min_periods=span).mean())
    assert np.allclose(got["e"].astype(float), want, rtol=1e-12, equal_nan=True)


def test_exponential_means_of_several_spans_share_one_sort(panel, panel_pdf):
    gaps = panel.withColumn("close", F.when(F.dayofmonth("ts") % 5 != 0, F.col("close")))
    spans = (2, 5, 7, 21, 63)
    d = ewms(gaps, "close", {s: f"e{s}" for s in spans}, Series())
    assert d._jdf.queryExecution().executedPlan().toString().count("Sort [") <= 2
    got = d.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)
    for s in spans:
        for _, x in got.groupby("symbol"):
            have = x["close"].notna()
            assert np.allclose(x.loc[have, f"e{s}"], x.loc[have, "close"].ewm(span=s, adjust=False).mean()) and x.loc[~have, f"e{s}"].isna().all()
