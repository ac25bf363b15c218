"""State machines over ordered bars: signal confirmation with minimum holding, drawdown tiers."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.scale import scan_by_key
from ..functions.windows import Series, col

C = F.col


def confirmed(signal, n: int = 2, p: Series = Series()):
    """The signal, once it held for n bars in a row; otherwise 0."""
    f = p.last(n)
    same = (F.min(col(signal)).over(f) == F.max(col(signal)).over(f)) & (F.count(col(signal)).over(f) == n)
    return F.when(same, col(signal)).otherwise(0).cast("int")


def filter_signals(df: DataFrame, min_holding: int = 5, confirm: int = 2, p: Series = Series()) -> DataFrame:
    """Confirmed signals with a minimum holding time; the holding counter travels with an ordered scan."""
    d = df.select("symbol", "ts", "signal").withColumn("want", confirmed("signal", confirm, p) if confirm > 1 else C("signal").cast("int"))

    def step(state, pdf):
        pos, held = state or (0, 0)
        want = pdf["want"].to_numpy()
        out = np.zeros(len(want), dtype="int32")
        for i, w in enumerate(want):
            if pos != 0 and held < min_holding:
                held += 1
            else:
                pos, held = int(w), int(w != 0)
            out[i] = pos
        return pdf[["symbol", "ts", "signal"]].assign(filtered=out), (pos, held)

    kind = dict(df.dtypes)["signal"]
    return scan_by_key(d, ["symbol"], "ts", step, f"symbol string, ts timestamp_ntz, signal {kind}, filtered int")


# Drawdown tiers with threshold and position scale.
TIERS = (("normal", 0.0, 1.00), ("caution", 0.05, 0.75), ("derisked", 0.10, 0.50), ("halted", 0.20, 0.00))


class TierState:
    """Peak, tier and recovery count of one account; tightens at once, loosens after ``recovery`` bars."""

    def __init__(self, peak=None, tier=0, calm=0, recovery=3):
        self.peak, self.tier, self.calm, self.recovery = peak, tier, calm, recovery

    def update(self, nav: float):
        self.peak = nav if self.peak is None or nav > self.peak else self.peak
        dd = (self.peak - nav) / max(self.peak, 1e-9)
        target = max(i for i, (_, bound, _) in enumerate(TIERS) if dd >= bound)
        before = self.tier
        if target < self.tier:
            self.calm += 1
            if self.calm >= self.recovery:
                self.tier, self.calm = target, 0
                if target == 0:
                    self.peak = nav
        else:
            self.tier, self.calm = target, 0
        return dd, self.tier, before != self.tier, max(0.0, self.peak / max(nav, 1e-9) - 1.0)


TIER_SCHEMA = "symbol string, ts timestamp_ntz, nav double, drawdown double, tier string, scale double, changed int, recovery_pct double"


def drawdown_tiers(df: DataFrame, nav: str = "equity", recovery: int = 3) -> DataFrame:
    """Tier, position scale and change flag per bar and account; rows with changed = 1 are the event list."""
    d = df.select("symbol", "ts", C(nav).alias("nav"))

    def step(state, pdf):
        st = state or TierState(recovery=recovery)
        rows = [st.update(float(v)) for v in pdf["nav"]]
        out = pdf.assign(drawdown=[r[0] for r in rows], tier=[TIERS[r[1]][0] for r in rows], scale=[TIERS[r[1]][2] for r in rows],
                         changed=np.array([int(r[2]) for r in rows], dtype="int32"), recovery_pct=[r[3] for r in rows])
        return out, st

    return scan_by_key(d, ["symbol"], "ts", step, TIER_SCHEMA)
