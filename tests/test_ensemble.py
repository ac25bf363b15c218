"""ML-15: average, stacking and vote, with weights from rows that the members were not fitted on."""
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidepanel.operators import ml
from tidepanel.plans import stats

NAMES = ["a", "b", "c", "d"]


def rows(flip=False):
    r = np.random.default_rng(5)
    parts = []
    for fold in (1, 2):
        n = 400
        ts = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n), "D")
        x = r.normal(size=(n, 4))
        label = (x @ [1.0, 0.5, -0.7, 0.1] + r.normal(size=n) > 0).astype(float)
        held = (np.arange(n) >= 240) & (np.arange(n) < 300)
        label[held] = (x[held] @ [0.2, 2.0, -0.1, 0.0] + r.normal(size=held.sum()) > 0)     # another member is best here
        if fold == 2:
            label[held] = 1.0                                                                # no model to stack with
        test = np.arange(n) >= 300
        if flip:
            label[test] = 1 - label[test]
        label[::37] = np.nan
        parts.append(pd.DataFrame(x, columns=NAMES).assign(symbol="S", ts=ts, fold=fold, split=np.where(test, "test", "train"), valid_from=ts[240], label=label))
    return pd.concat(parts, ignore_index=True)


def frame(spark, flip=False):
    kinds = "a double, b double, c double, d double, symbol string, ts timestamp_ntz, fold int, split string, valid_from timestamp_ntz, label double"
    d = rows(flip)
    return spark.createDataFrame(d.astype(object).where(d.notna(), None), kinds)


@pytest.fixture(scope="module")
def scored(spark):
    return stats.held_out_frame(frame(spark), NAMES).cache()


def test_labels_of_the_scored_rows_do_not_count(spark, scored):
    get = lambda s: stats.blended(s).toPandas().sort_values(["fold", "ts"]).reset_index(drop=True)
    a, b = get(scored), get(stats.held_out_frame(frame(spark, True), NAMES))
    assert len(a) == 200 and list(a.columns) == ["symbol", "ts", "fold", "average", "stack", "vote"]
    assert np.allclose(a[["average", "stack", "vote"]], b[["average", "stack", "vote"]], atol=1e-12)
    assert not np.allclose(a[a.fold == 1]["stack"], a[a.fold == 1]["average"], atol=1e-3)
    assert np.allclose(a[a.fold == 2]["stack"], a[a.fold == 2]["average"], atol=1e-12)


def test_members_end_before_the_held_out_rows(spark, scored):
    d = rows()
    d["label"] = d["label"].where((d["ts"] < d["valid_from"]), 1 - d["label"])
    kinds = "a double, b double, c double, d double, symbol string, ts timestamp_ntz, fold int, split string, valid_from timestamp_ntz, label double"
    other = stats.held_out_frame(spark.createDataFrame(d.astype(object).where(d.notna(), None), kinds), NAMES)
    key = lambda s: {(r.fold, r.ts, i): v for r in s.collect() for i, v in enumerate(r.member_p)}
    assert key(scored) == pytest.approx(key(other)) and set(r.split for r in scored.select("split").distinct().collect()) == {"valid", "test"}


def test_weights_and_stacking_come_from_the_held_out_rows(scored):
    held = scored.where("split = 'valid' AND label IS NOT NULL")
    d = held.where("fold = 1").toPandas()
    p, y = np.stack(d["member_p"]), d["label"].to_numpy(float)
    e = np.maximum(((p > 0.5) == y[:, None]).mean(0) - 0.5, 0)
    got = {r.member: r.weight for r in ml.accuracy_weights(held, keys=("fold",)).where("fold = 1").collect()}
    assert np.allclose([got[i] for i in range(3)], e / e.sum())
    [(_, w)] = ml.stack_weights(held, 3).collect()
    x = np.column_stack([np.ones(len(p)), p])
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - np.r_[0, w[1:]]
    assert np.abs(slope).max() < 1e-9        # the penalised likelihood has its one maximum here


def test_query_names_all_three():
    assert all(f" AS {c}" in entry.oracle_sql()["ML-15"] for c in ("average", "stack", "vote"))
