"""Steps that once sorted, walked or moved more than the job asks for."""
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import labels, quality, risk


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_frontier_sums_move_one_row_an_order(spark):
    o = spark.createDataFrame([(None if i == 40 else i % 30, i * 7 % 11 + 1.0, 0.6) for i in range(41)], "k bigint, qty double, sigma double")

    def costs(d):
        c = risk.schedule_cost(risk.execution_schedule(d), ("k", "lam"))
        return plan(c), {(r.k, r.lam): (r.expected_cost, r.variance_cost) for r in c.collect()}
    now, got = costs(risk.frontier(o, 5, key="k"))
    before, want = costs(risk.frontier(o, 5))
    assert now.count("Exchange") == 1 and now.index("Generate") < now.index("Exchange")
    assert len(got) == 31 * 5 and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_imputation_walks_no_frame_to_the_end(spark, panel):
    gaps = panel.withColumn("close", F.when(F.day("ts") % 9 < 3, None).otherwise(F.col("close")))
    for fill in (quality.impute_linear, quality.impute_ffill):
        d = fill(gaps)
        assert "unboundedfollowing" not in plan(d).lower() and d.columns == gaps.columns and d.count() == panel.count()
        assert d.where("close IS NULL").count() == 0
    w = quality.Series()
    want = gaps.withColumn("w", F.coalesce(w.ffill("close"), w.bfill("close"))).select("symbol", "ts", "w")
    assert quality.impute_ffill(gaps).join(want, ["symbol", "ts"]).where("close <> w").count() == 0


def test_regime_barriers_share_one_sort(spark, panel):
    d = panel.withColumn("regime", F.when(F.col("symbol") == "MID", F.month("ts") % 5))
    got = labels.regime_barriers(d, "regime")
    assert plan(got).count("Sort [") == 1
    n = d.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"))
    few = {(r.symbol, r.regime) for r in n.where("n < 20").collect()}
    plain = {(r.symbol, r.ts): r.tb_label for r in labels.triple_barrier(panel).collect()}
    rows = got.collect()
    assert len(rows) == panel.count() and any(r.regime in (0, 2) and r.tb_label != plain[r.symbol, r.ts] for r in rows)
    assert all(r.tb_label == plain[r.symbol, r.ts] for r in rows if r.regime is None or r.regime > 2 or (r.symbol, r.regime) in few)
