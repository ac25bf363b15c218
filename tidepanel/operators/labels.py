"""Forward-looking labels. They never belong to the feature columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scale import scan_by_key
from ..functions.windows import Series, col, flag, quantile_of

C = F.col
LABEL_COLUMNS = ("label", "fwd_return", "tb_label", "tb_ret", "meta_label", "quantile_signal")
OHLCV = ("open", "high", "low", "close", "volume")
REGIME_COLUMNS = ("regime", "regime_bull", "regime_bear", "regime_hv", "trail_ret_63")


def triple_barrier(df: DataFrame, t_bars: int = 5, pt: float | Column = 1.5, sl: float | Column = 1.0,
                   vol_window: int = 21, p: Series = Series(), out: str = "tb") -> DataFrame:
    """First touch of close*(1 + pt*vol) or close*(1 - sl*vol) within the next bars, else the last of them.

    The last ``t_bars`` rows and rows without volatility get label 0 and return 0.
    """
    pt = pt if isinstance(pt, Column) else F.lit(pt)
    sl = sl if isinstance(sl, Column) else F.lit(sl)
    nxt = F.collect_list("close").over(p.w.rowsBetween(1, t_bars))
    d = df.withColumns({"_r1": p.pct("close"), "_nxt": nxt})
    d = d.withColumn("_vol", p.std("_r1", vol_window, 5))
    up, lo = C("close") * (1.0 + pt * C("_vol")), C("close") * (1.0 - sl * C("_vol"))
    d = d.withColumns({"_up": up, "_lo": lo})
    hit = F.get(F.filter("_nxt", lambda v: (v >= C("_up")) | (v <= C("_lo"))), F.lit(0))
    ready = (F.size("_nxt") == t_bars) & (C("_vol") > 0)
    d = d.withColumn("_hit", hit)
    label = F.when(ready & (C("_hit") >= C("_up")), 1).when(ready & (C("_hit") <= C("_lo")), -1).otherwise(0)
    ret = F.when(ready, F.coalesce(C("_hit"), F.element_at("_nxt", -1)) / C("close") - 1.0).otherwise(0.0)
    return d.withColumns({f"{out}_label": label, f"{out}_ret": ret}).drop("_r1", "_nxt", "_vol", "_up", "_lo", "_hit")


def quantile_label(df: DataFrame, ret: str, out: str, q_upper: float = 0.7, q_lower: float = 0.3, window: int = 63,
                   p: Series = Series(), min_periods: int = 10) -> DataFrame:
    """+1 above the trailing upper quantile, -1 below the lower one, else 0."""
    d = df.withColumn("_q", p.sorted_frame(ret, window))
    hi, lo = quantile_of("_q", q_upper, min_periods), quantile_of("_q", q_lower, min_periods)
    return d.withColumn(out, flag(C(ret) > hi) - flag(C(ret) < lo)).drop("_q")


def fwd_return(p: Series, h: int) -> Column:
    return p.lead("close", h) / C("close") - 1.0


def multi_horizon(df: DataFrame, horizons=(1, 5, 10, 21), p: Series = Series()) -> DataFrame:
    return df.withColumns({f"label_h{h}": flag(fwd_return(p, h) > 0) for h in horizons})


def asymmetric(ret, profit: float = 0.005, loss: float = -0.003) -> Column:
    return F.when(col(ret) >= profit, 1).when(col(ret) <= loss, -1).otherwise(0)


def directional_change(df: DataFrame, theta: float = 0.015, keys=("symbol",)) -> DataFrame:
    """Directional-change events as an ordered scan with state (reference price, direction sought)."""
    import numpy as np

    def step(state, pdf):
        px = pdf["close"].to_numpy(float)
        lab = np.zeros(len(px), dtype="int32")
        if state is None:
            state, i = (px[0], True), 1
        else:
            i = 0
        ref, seeking_up = state
        while i < len(px):
            # jump straight to the next bar that crosses the current barrier
            ahead = px[i:]
            touched = ahead >= ref * (1 + theta) if seeking_up else ahead <= ref * (1 - theta)
            k = int(touched.argmax())
            if not touched[k]:
                break
            i += k
            lab[i] = 1 if seeking_up else -1
            ref, seeking_up = px[i], not seeking_up
            i += 1
        return pdf.assign(dc_label=lab), (ref, seeking_up)

    cols = [*keys, "ts", "close"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields)
    return scan_by_key(df.select(*cols), list(keys), "ts", step, fields + ", dc_label int")


def meta_label(signal, tb_label) -> Column:
    s, t = F.coalesce(col(signal), F.lit(0)), col(tb_label)
    return flag(((s > 0) & (t == 1)) | ((s < 0) & (t == -1)))


def forward_label(df: DataFrame, h: int = 5, p: Series = Series(), parity: bool = False) -> DataFrame:
    """fwd_return and label; without ``parity`` the label of the last bars stays NULL."""
    d = df.withColumn("fwd_return", fwd_return(p, h))
    lab = flag(C("fwd_return") > 0)
    return d.withColumn("label", lab if parity else F.when(C("fwd_return").isNotNull(), lab))


# Barrier multipliers (profit, stop) for regimes 2 bull, 1 sideways, 0 bear.
REGIME_BARRIERS = {2: (2.0, 0.8), 1: (1.5, 1.0), 0: (1.2, 0.8)}


def regime_barriers(df: DataFrame, regime: str, t_bars: int = 5, min_rows: int = 20, parity: bool = True) -> DataFrame:
    """Barrier labels with multipliers by regime; regimes with few bars, and (``parity``) all zero labels,
    take the default barriers."""
    p = Series()
    usable = (C("_n") >= min_rows) & C(regime).isin(list(REGIME_BARRIERS))
    def pick(i):
        e = F.lit(None).cast("double")
        for k, v in REGIME_BARRIERS.items():
            e = F.when(C(regime) == k, F.lit(v[i])).otherwise(e)
        return F.coalesce(e, F.lit((1.5, 1.0)[i]))
    d = triple_barrier(df, t_bars, pick(0), pick(1), out="_a")
    d = triple_barrier(d, t_bars, out="_b")
    # counts of the known regimes over the symbol, whose rows are in the order that all windows share: one sort serves them
    n = F.lit(None).cast("bigint")
    for k in REGIME_BARRIERS:
        n = F.when(C(regime) == k, F.count_if(C(regime) == k).over(p.whole)).otherwise(n)
    d = d.withColumn("_n", n)
    keep = usable & (C("_a_label") != 0) if parity else usable
    return (d.withColumns({"tb_label": F.when(keep, C("_a_label")).otherwise(C("_b_label")),
                           "tb_ret": F.when(keep, C("_a_ret")).otherwise(C("_b_ret"))})
            .drop("_n", "_a_label", "_a_ret", "_b_label", "_b_ret"))
