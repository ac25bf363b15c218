from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from tidepanel.operators import risk as rs


def test_every_pair_of_a_group_is_compared_in_any_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"S{i}", datetime(2024, 1, 1) + timedelta(int(d)), float(rng.normal(0, 0.01))) for i in range(23) for d in rng.choice(60, 45 if i else 12, replace=False)]
    rows += [("S1", None, 0.5), ("S2", datetime(2024, 6, 1), None), (None, datetime(2024, 1, 1), 0.1)]
    rows += [("FLAT", datetime(2024, 1, 1) + timedelta(d), 0.0) for d in range(60)]
    where = [(f"S{i}", "x" if i % 2 else "y") for i in range(23)] + [("FLAT", "x"), ("S3", "y"), ("S3", "x"), (None, "x"), ("S4", None), ("S5", "z")]
    members = spark.createDataFrame(where, "symbol string, universe string")
    returns = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ret double")
    r = pd.DataFrame(rows, columns=["symbol", "ts", "ret"]).dropna()
    wide = r.pivot(index="ts", columns="symbol", values="ret")
    u = pd.DataFrame(where, columns=["symbol", "universe"]).dropna()
    times = u.merge(u, on="universe").query("symbol_x != symbol_y").groupby(["symbol_x", "symbol_y"]).size()
    want = {}
    for (a, b), k in times.items():
        both = wide[[a, b]].dropna()
        if len(both):
            best, n = want.get(a, (0.0, 0))
            c = abs(both[a].corr(both[b])) if both[a].std() > 0 and both[b].std() > 0 else 0.0
            want[a] = (max(best, c), n + 1) if len(both) * k >= 20 else (best, n)
    monkeypatch.setattr(rs, "DATES", 7)
    for block in (4, 1000):
        got = {x["candidate"]: (x["max_corr"], x["n_compared"]) for x in rs.correlation_within(returns, members, block=block).collect()}
        assert got.keys() == want.keys()
        for k, (c, n) in want.items():
            assert got[k][1] == n and np.isclose(got[k][0], c), k
