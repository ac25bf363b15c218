"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from tidepanel.operators import backtest as bk, features as feats, metrics as mt, splits as sp
from tidepanel.plans import QUERIES
from tidepanel.plans.common import signals
from tidepanel.session import get_session
from tidepanel.sources.panel import cached_features
from tidepanel.sources.tables import bars, macro

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

# families that look only at the symbol's own bars, as in one training call
OWN = [i for i, f in feats.FAMILIES.items() if not any(x.macro for x in feats.closure([i]))]


def drain(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = get_session("bench", CPUS, partitions=CPUS * 3)
    work = tempfile.mkdtemp(prefix="tidepanel-bench-")  # one local process
    panel = lambda: bars(spark, SF)
    cases = {
        "bars": lambda: drain(panel()),
        "features_own_cold": lambda: drain(cached_features(panel(), lambda b: feats.generate_features(b, OWN), work, OWN)),
        "features_own_cached": lambda: drain(cached_features(panel(), lambda b: feats.generate_features(b, OWN), work, OWN)),
        "features_cross_asset": lambda: drain(feats.generate_features(panel(), ["FEA-22", "FEA-24", "FEA-27", "FEA-40", "FEA-41"], macro(spark, SF))),
        "features_chunked": lambda: drain(feats.generate_features(panel(), ["FEA-9", "FEA-12"], chunk_rows=2000)),
        "backtest_metrics": lambda: drain(mt.all_metrics(bk.run(signals(spark, SF), bk.cost("stock")), ("symbol",))),
        "trades": lambda: drain(bk.trades(bk.run(signals(spark, SF), bk.cost("stock")))),
        "walk_forward": lambda: drain(sp.walk_forward(panel(), sp.bar_folds(panel()), sp.momentum)),
        "bootstrap_50": lambda: drain(bk.block_bootstrap(signals(spark, SF), 50)),
    }
    for key in ("TOP-1", "BT-15", "WIN-12b", "AGG-16", "LBL-1", "REG-2", "REG-5", "RSK-8", "RSK-11", "VAL-9", "DQ-10", "JN-8", "STF-7"):
        cases[key] = lambda key=key: drain(QUERIES[key](spark, SF))
    drain(panel())   # start the JVM side once
    times = {}
    for name, run in cases.items():
        t = time.time()
        run()
        times[name] = round(time.time() - t, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    n = panel().count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF,
                      "bars": n, "feature_rows_per_sec": round(n / times["features_own_cold"], 1), "feature_families": len(OWN)}))


if __name__ == "__main__":
    main()
