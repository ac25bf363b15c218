"""Statistics of wide rows against numpy; a training run and its saved model."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import wide
from tidepanel.operators import drift, ml, splits as sp, training as tr

COLS = ["walk", "ties", "flag", "constant", "gaps", "huge"]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(3)
    n = 3000
    d = pd.DataFrame({"symbol": np.where(np.arange(n) % 3 == 0, "A", "B"), "ts": pd.date_range("2000-01-01", periods=n), "fold": np.arange(n) // 1100,
                      "walk": rng.normal(0, 1, n).cumsum(), "ties": rng.integers(0, 5, n) / 7, "flag": (rng.random(n) < 0.02) * 1.0, "constant": 0.1 + np.zeros(n), "gaps": rng.normal(0, 1, n), "huge": rng.normal(0, 1, n) * 1e12 + 1e13})
    d.loc[rng.random(n) < 0.3, "gaps"] = np.nan
    d.loc[d.fold == 1, "gaps"] = np.nan
    d["label"] = (rng.random(n) < 0.4 + 0.2 * (d.ties > 0.3)).astype(float)
    d.loc[::17, "label"] = np.nan
    d["fwd_return"] = rng.normal(0, 0.01, n) + 0.004 * (d.label.fillna(0) - 0.5)
    return d


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("label", F.nanvl("label", F.lit(None).cast("double"))).repartition(5).cache()


@pytest.mark.parametrize("keys", [[], ["fold"]])
def test_quantiles_are_exact(df, pdf, keys):
    qs = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    for accuracy in (10000, 100):              # the second makes brackets that hold a part of the values only
        got = {(*(r[k] for k in keys), r.feature, r.q): r.value for r in wide.quantiles(df, COLS, qs, keys, accuracy).collect()}
        want = {}
        for k, part in pdf.groupby(keys[0]) if keys else [(None, pdf)]:
            for c in COLS:
                v = part[c].dropna()
                if len(v):
                    want |= {(*([k] if keys else []), c, q): np.quantile(v, q) for q in qs}
        assert got.keys() == want.keys() and all(np.isclose(got[x], want[x], rtol=1e-12, atol=1e-12) for x in want)


def test_contingency_counts(df, pdf):
    edges = {(): {c: np.quantile(pdf[c].dropna(), [0.2, 0.5, 0.8]) for c in COLS}}
    got = {(r.feature, r.bin, r.label): r.n for r in wide.contingency(df, COLS, edges, "label", 2).collect()}
    want = {}
    for c in COLS:
        ok = pdf[c].notna() & pdf.label.notna()
        for b, y in zip(np.searchsorted(edges[()][c], pdf[c][ok], "left"), pdf.label[ok].astype(int)):
            want[c, b, y] = want.get((c, b, y), 0) + 1
    assert got == want


def test_correlations_and_lines(df, pdf):
    got = {(r.fold, r.feature): r for r in wide.correlations(df, COLS, "label", ["fold"]).collect()}
    for k, part in pdf.groupby("fold"):
        for c in COLS:
            d = part[[c, "label"]].dropna()
            if not len(d):
                assert (k, c) not in got
                continue
            r = got[k, c]
            assert r.n == len(d)
            if c == "constant":
                assert r["corr"] is None and r.slope is None
            else:
                slope, icpt = np.polyfit(d[c] - d[c].mean(), d.label, 1)
                assert np.isclose(r["corr"], np.corrcoef(d[c], d.label)[0, 1], rtol=1e-9) and np.isclose(r.slope, slope, rtol=1e-8) and np.isclose(r.intercept, icpt - slope * d[c].mean(), rtol=1e-7)


def test_nothing_to_count(df):
    none = df.where("false")
    assert wide.quantiles(none, COLS, [0.5], ["fold"]).collect() == [] and wide.correlations(none, COLS, "label", ["fold"]).collect() == []
    assert wide.quantiles(none, COLS, [0.5]).collect() == [] and drift.psi(none, COLS).collect() == []


def test_scaling_by_regime_falls_back(df, pdf):
    small = df.withColumn("regime", F.when(F.col("ts") < "2000-01-31", 7).otherwise(1))
    out = ml.robust_scale(small, ["walk", "gaps"], ml.scaler_stats(small, ["walk", "gaps"]), ml.scaler_stats(small, ["walk", "gaps"], "regime")).toPandas().sort_values("ts").reset_index(drop=True)
    p = pdf.sort_values("ts").reset_index(drop=True)
    own = p.ts >= "2000-01-31"
    for rows, part in ((own, p[own]), (~own, p)):          # 30 rows are too few for statistics of their own
        v = part["walk"]
        lo, q1, m, q3, hi = np.quantile(v, [0.01, 0.25, 0.5, 0.75, 0.99])
        assert np.allclose(out["walk"][rows], (p["walk"][rows].clip(lo, hi) - m) / (q3 - q1))
    assert out["gaps"].isna().equals(p["gaps"].isna())


def test_attribution_keeps_rows_whole(df, pdf):
    a = ml.attribution(df.withColumn("signal", F.lit(1)), COLS)
    top = {r.ts: [t.feature for t in r.top] for r in ml.top_attributions(a, 2).collect()}
    dev = (pdf[COLS] - pdf[COLS].mean()).abs().round(9)
    for i in range(0, 3000, 500):
        want = [c for _, c in sorted((-v, c) for c, v in dev.loc[i].items() if v >= 1e-10)][:2]
        assert top[pdf.ts[i]] == want


def test_training_run_and_its_saved_model(spark, df, pdf, tmp_path):
    d = df.withColumn("weight", F.lit(1.0))
    folds = sp.month_folds(d, 24, 12, 1, 18).collect()
    m = tr.train(d, COLS, folds, select=3)
    assert 1 <= len(m.features) <= 3 and "ties" in m.features and abs(sum(m.weights) - 1) < 1e-9 and m.calibrator is not None and m.meta is not None
    f = {r.fold: r for r in folds}
    s = m.scores.toPandas()
    assert len(s) and all(f[k].test_start <= t <= f[k].test_end for k, t in zip(s.fold, s.ts)) and len(s) == len(s.drop_duplicates(["symbol", "ts"]))
    m.save(str(tmp_path / "model"))
    again = tr.TrainedModel.load(spark, str(tmp_path / "model"))
    cols = ["score_mean", "score_std", "calibrated", "meta_p", "confidence", "signal"]
    a, b = (x.score(df).orderBy("ts").select("ts", *cols).toPandas() for x in (m, again))
    assert again.features == m.features and len(a) == 3000 and a.equals(b)
    assert len(again.score(df.drop(m.features[0])).columns) == len(again.score(df).columns) - 1      # a column it lacks counts as zero
    r = tr.report(m, df.select("symbol", "ts", F.lit(1).alias("signal"))).toPandas()
    assert sorted(r.fold) == sorted(s.fold.unique()) and (r.n_test == s.groupby("fold").size().reindex(r.fold).to_numpy()).all() and (r.n_train > 0).all()


def test_linear_members_see_only_their_fold(df, pdf):
    df = df.drop("fold")
    rows = sp.assign_month_folds(df, sp.month_folds(df, 24, 12, 1, 18))
    train, test = rows.where("split = 'train' AND label IS NOT NULL"), rows.where("split = 'test'")
    members = {r.fold: r.members for r in tr.linear_members(train, COLS, size=2).collect()}
    for r in sp.month_folds(df, 24, 12, 1, 18).collect():
        p = pdf[(pdf.ts >= r.train_start) & (pdf.ts <= r.train_end) & pdf.label.notna()]
        c = {x: abs(round(p[[x, "label"]].dropna().corr().iloc[0, 1], 9)) for x in COLS if p[[x, "label"]].dropna()[x].nunique() > 1}
        assert [m.feature for m in members[r.fold]] == [x for x, _ in sorted(c.items(), key=lambda t: (-t[1], t[0]))][:2]
    out = tr.linear_scores(test, tr.linear_members(train, COLS, size=2), COLS).select("fold", "ts", "member_p").toPandas()
    x = out.iloc[0]
    line = [np.clip(m.intercept + m.slope * pdf.set_index("ts").loc[x.ts, m.feature], 0.01, 0.99) for m in members[x.fold]]
    assert np.allclose(x.member_p, line)
