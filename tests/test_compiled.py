"""The one-pass catalogue against the window plan, on rows with gaps, nulls and single bars."""
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.compiled import read, rounded
from tidepanel.functions.windows import Series, clip, flag
from tidepanel.operators import features as feats, labels
from tidepanel.plans import QUERIES, catalogue as cat
from tidepanel.sources.tables import MACRO_TICKERS

SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, mark int"


@pytest.fixture(scope="module")
def panel(spark):
    r, rows = np.random.default_rng(8), []
    for s, n in (("A", 420), ("B", 90), ("C", 1), (None, 30), ("D", 300)):
        price = 100 * np.exp(np.cumsum(r.normal(0, 0.02, n))) if s != "D" else np.full(n, 50.0)
        for i in range(n):
            ts = None if s == "B" and i == 0 else datetime(2021, 1, 1) + timedelta(days=int(i * 1.4))
            c = None if s == "A" and i % 41 == 7 else float(price[i])
            rows.append((s, ts, float(price[i]) * 1.01, None if i % 53 == 3 else float(price[i]) * 1.02, float(price[i]) * 0.98, c, float(r.integers(0, 40)), i))
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(9)
    days = pd.date_range("2020-12-20", "2022-09-01")
    rows = [(t, d.to_pydatetime(), float(v)) for t in MACRO_TICKERS for d, v in zip(days, 100 + r.normal(0, 5, len(days)).cumsum()) if r.random() < 0.6]
    return spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, close double").cache()


def test_one_pass_equals_the_window_plan(panel, series):
    got = cat._all(panel, series, 5).toPandas()
    want = feats.generate_features(labels.forward_label(panel, 5), cat.FAMILIES, series, carry=("fwd_return", "label", "mark"))
    digits = {c: cat.DIGITS.get(f, 6) for f in cat.FAMILIES for c in feats.FAMILIES[f].columns}
    want = want.select(*[c for c in want.columns if c not in digits], *[cat.quick_round(c, n).alias(c) for c, n in digits.items()]).toPandas()
    assert len(got) == len(want) == 841 and set(got.columns) == set(want.columns)
    a, b = (d.sort_values(["symbol", "mark"]).reset_index(drop=True) for d in (got, want))
    moving = (a["symbol"] != "D").to_numpy()      # where prices never change, the sign of a difference of means is rounding noise
    for c in [*cat.COLUMNS, "fwd_return", "label", "mark"]:
        some = moving if c in ("macd_cross", "macd_hist_rank") else slice(None)
        assert np.allclose(a[c].astype(float)[some], b[c].astype(float)[some], rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_no_wide_row_is_shuffled_or_stored(spark, sf):
    plan = cat.streamed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan.split("MapInArrow")[0] and "Window" not in plan
    plan = QUERIES["AGG-21"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "features/families=" not in plan and plan.count("MapInArrow") == 2


def test_expressions_are_read():
    p = Series()
    x = read(p.mean(clip("d", lo=0.0), 14))
    assert x[0] == "case" and x[2][0] == "over" and x[2][2] == ("lit", "-13 .. CURRENT ROW")
    assert read(flag(F.col("a") > -1.5)) == ("cast", ("coalesce", (">", ("col", "a"), ("num", -1.5)), ("num", 0.0)), ("lit", "INT"))
    assert rounded(np.array([0.1234565, 3e9 + 0.1234567, np.nan]), 6, 1.7e-3)[:2].tolist() == [0.123457, 3000000000.123457]
