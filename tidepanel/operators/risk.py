"""Position sizing, tail risk, order screens, capacity, order costs, execution schedules."""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.scale import scan_by_key
from ..functions.trailing import Trailing, deviations, means, share_below, trailing
from ..functions.windows import Series, clip, col, corr_agg, flag, nz

C = F.col
YEAR = math.sqrt(252.0)


def clamp(x, lo, hi) -> Column:
    return clip(x, lo, hi)


@dataclass(frozen=True)
class RiskParams:
    target_vol: float = 0.15
    kelly_fraction: float = 0.25
    fixed_risk: float = 0.01
    max_leverage: float = 2.0
    daily_loss_limit: float = 0.03
    min_confidence: float = 0.60
    max_position: float = 1.0
    max_drawdown: float = 0.25


def vol_target_size(vol, r: RiskParams = RiskParams()) -> Column:
    return F.when(col(vol) > 0, r.target_vol / (col(vol) + 1e-9)).otherwise(0.0)


def kelly_size(edge, variance, r: RiskParams = RiskParams()) -> Column:
    return F.when(col(variance) > 0, r.kelly_fraction * col(edge) / (col(variance) + 1e-12)).otherwise(0.0)


def fixed_risk_size(vol, r: RiskParams = RiskParams()) -> Column:
    return F.when(col(vol) > 0, r.fixed_risk / (col(vol) + 1e-9)).otherwise(0.0)


def hard_limits(size, confidence, daily_return=None, r: RiskParams = RiskParams()) -> Column:
    stop = col(confidence) < r.min_confidence
    if daily_return is not None:
        stop = stop | (col(daily_return) <= -abs(r.daily_loss_limit))
    bound = min(r.max_leverage, r.max_position, 1.0)
    return F.when(stop, 0.0).otherwise(clamp(size, -bound, bound))


def position_size(edge, confidence, vol, variance=None, daily_return=None, r: RiskParams = RiskParams()) -> Column:
    """Signed median of the three sizes, scaled by confidence, inside hard limits."""
    var = col(variance) if variance is not None else col(vol) * col(vol)
    three = F.array(F.abs(vol_target_size(vol, r)), F.abs(kelly_size(edge, var, r)), F.abs(fixed_risk_size(vol, r)))
    med = F.get(F.sort_array(three), F.lit(1))
    scale = clamp((col(confidence) - r.min_confidence) / (1 - r.min_confidence + 1e-9), 0.0, 1.0)
    return hard_limits(F.signum(col(edge)) * med * scale, confidence, daily_return, r)


def share_quantity(signal, vol, nav, price, r: RiskParams = RiskParams()) -> Column:
    """Whole shares for a volatility target."""
    exposure = clamp(vol_target_size(vol, r), -r.max_position, r.max_position)
    ok = (col(vol) > 0) & (col(price) > 0) & (col(nav) > 0)
    return F.when(ok, (F.signum(col(signal)) * F.floor(F.abs(exposure) * col(nav) / nz(col(price)))).cast("int")).otherwise(0)


def managed_positions(df: DataFrame, signal="signal", r: RiskParams = RiskParams(), gate: bool = False, p: Series = Series()) -> DataFrame:
    """Risk-managed position per bar. Without the daily-loss gate it is a column expression; with it the
    position depends on the previous one, so an ordered scan carries (position, close) per symbol."""
    d = df.withColumn("_r1", p.pct("close"))
    d = d.withColumn("_vol", F.coalesce(p.std("_r1", 21) * YEAR, F.lit(0.0)))
    d = d.withColumn("_edge", col(signal) * C("_vol"))
    size = F.abs(position_size("_edge", F.lit(1.0), "_vol", r=r))
    d = d.withColumn("position_size", F.signum(col(signal)) * size)
    if not gate:
        return d.drop("_r1", "_vol", "_edge")

    def step(state, pdf):
        prev, last = state if state else (0.0, None)
        out = pdf["position_size"].to_numpy(float).copy()
        px = pdf["close"].to_numpy(float)
        for i in range(len(out)):
            day = prev * (px[i] / last - 1.0) if last is not None and last > 0 else 0.0
            if day <= -abs(r.daily_loss_limit):
                out[i] = 0.0
            prev, last = out[i], px[i]
        return pdf.assign(position_size=out), (prev, last)

    cols = [*p.keys, "ts", "close", signal, "position_size"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.select(*cols).schema.fields)
    return scan_by_key(d.select(*cols), list(p.keys), "ts", step, fields)


# Size multipliers by regime.
REGIME_MULT = {"bull": 1.0, "bear": 0.5, "sideways": 0.75, "high_vol": 0.60, "unknown": 0.80}


@dataclass(frozen=True)
class SizerParams:
    target_vol: float = 0.15
    kelly_fraction: float = 0.25
    max_position: float = 0.25
    max_portfolio_risk: float = 0.02
    dd_caution: float = 0.05
    dd_derisked: float = 0.10
    dd_halt: float = 0.20
    min_confidence: float = 0.55
    regime_bull_mult: float = 1.0
    regime_bear_mult: float = 0.5
    regime_sideways_mult: float = 0.75


# Safe ranges of tunable sizing parameters.
SAFE_RANGES = {"kelly_fraction": (0.05, 1.0), "target_vol": (0.05, 0.50), "max_position": (0.05, 1.0), "dd_caution": (0.01, 0.15),
               "dd_derisked": (0.05, 0.30), "dd_halt": (0.10, 0.50), "regime_bull_mult": (0.0, 2.0), "regime_bear_mult": (0.0, 2.0),
               "regime_sideways_mult": (0.0, 2.0)}


def safe_parameters(df: DataFrame) -> DataFrame:
    """Clip a table (name, value) of proposed parameters to their safe ranges; unknown names are dropped."""
    t = df.sparkSession.createDataFrame([(k, *v) for k, v in SAFE_RANGES.items()], "name string, lo double, hi double")
    return df.join(F.broadcast(t), "name").withColumn("value", F.least(F.greatest("value", "lo"), C("hi"))).drop("lo", "hi")


def dynamic_size(method: str, signal="signal", confidence="confidence", vol="vol", drawdown="drawdown", regime="regime_name",
                 s: SizerParams = SizerParams()) -> Column:
    """Six sizing methods with drawdown multiplier and position cap."""
    m = s.max_position
    sig, conf, v = col(signal), col(confidence), F.greatest(col(vol), F.lit(1e-4))
    direction = F.signum(sig)
    target = clamp(s.target_vol / (v + 1e-9) * direction, -m, m)
    kelly = clamp(s.kelly_fraction * F.abs(sig) * conf / (v * v + 1e-12) * direction, -m, m)
    edge = F.greatest(conf - s.min_confidence, F.lit(0.0)) / max(1.0 - s.min_confidence, 1e-9)
    conf_edge = clamp(sig * edge, -m, m)
    budget = clamp(direction * s.max_portfolio_risk / (v + 1e-9), -m, m)
    reg = F.lower(col(regime))
    base = (F.when(reg == "bull", target * clamp(0.5 + 0.5 * edge, 0.5, 1.0)).when(reg.isin("bear", "high_vol"), kelly).otherwise(conf_edge))
    mult = F.lit(0.80)
    for k, x in REGIME_MULT.items():
        mult = F.when(reg == k, x).otherwise(mult)
    aware = clamp(base * mult, -m, m)
    raw = {"volatility_target": target, "fractional_kelly": kelly, "confidence_edge": conf_edge, "risk_budget": budget,
           "regime_aware": aware, "drawdown_derisked": aware}[method]
    dd = F.abs(col(drawdown))
    dd_mult = F.when(dd >= s.dd_halt, 0.0).when(dd >= s.dd_derisked, 0.5).when(dd >= s.dd_caution, 0.75).otherwise(1.0)
    return F.when(conf < s.min_confidence, 0.0).otherwise(clamp(raw * dd_mult, -m, m))


SIZING_METHODS = ("volatility_target", "fractional_kelly", "confidence_edge", "risk_budget", "regime_aware", "drawdown_derisked")

# Exposure by tail scenario.
SCENARIO_EXPOSURE = {"normal": 1.00, "caution": 0.70, "extreme": 0.25, "black_swan": 0.25}


def tail_risk(df: DataFrame, look_vol: int = 21, look_tail: int = 252, p: Series = Series()) -> DataFrame:
    """Per bar: volatility z-score, share of returns below -2 sigma, scenario and exposure.

    A low tail share also triggers 'caution', as defined.
    """
    d = df.withColumn("_r", p.pct("close"))
    d = d.withColumn("_n", F.count("_r").over(p.past))
    d = d.withColumn("_v", p.std("_r", look_vol) * YEAR)
    # volatilities of the windows lying fully inside the last ``look_tail`` returns
    f = look_tail - look_vol + 1
    d = trailing(d, {"_vm": means("_v", f, 1), "_vs": deviations("_v", f, 2), "_tail": Trailing(share_below(-2.0), ("_r",), look_tail)}, p)
    z = F.when((C("_n") < 2 * look_vol) | (C("_vs") < 1e-9) | C("_vs").isNull(), 0.0).otherwise((C("_v") - C("_vm")) / nz("_vs"))
    few = C("_n") < look_vol + 5
    d = d.withColumns({"vol_zscore": F.when(few, 0.0).otherwise(z), "tail_prob": F.when(few, 0.10).otherwise(C("_tail"))})
    vz, tp = C("vol_zscore"), C("tail_prob")
    scen = (F.when(few, "normal").when((vz >= 3.5) & (tp <= 0.01), "black_swan").when(vz >= 3.5, "extreme")
            .when((vz >= 2.0) | (tp <= 0.05), "caution").otherwise("normal"))
    d = d.withColumn("scenario", scen)
    ex = F.lit(1.0)
    for k, v in SCENARIO_EXPOSURE.items():
        ex = F.when(C("scenario") == k, v).otherwise(ex)
    return d.withColumn("exposure", ex).drop("_r", "_n", "_v", "_vm", "_vs", "_tail")


def stress_book(bars: DataFrame, periods: DataFrame, net_weight: float, gross_weight: float, n_positions: int) -> DataFrame:
    """Return (percent) of a book over named periods from the direction of its net weight."""
    scale = math.copysign(1.0, net_weight) * gross_weight / n_positions if net_weight else 0.0
    d = bars.join(F.broadcast(periods), C("ts").between(C("start"), C("end")))
    p = Series(keys=("symbol", "period"))
    d = d.withColumn("_r", p.pct("close"))
    a = d.groupBy("symbol", "period").agg(F.count(F.lit(1)).alias("bars"), (F.product(1.0 + scale * F.coalesce(C("_r"), F.lit(0.0))) - 1.0).alias("_x"))
    return a.select("symbol", "period", "bars", F.when(C("bars") < 5, 0.0).otherwise(F.round(C("_x") * 100.0, 2)).alias("return_pct"))


HARD_CHECKS = ("max_leverage", "daily_loss_limit", "drawdown_gate", "vix_filter")


@dataclass(frozen=True)
class OrderLimits:
    max_position: float = 0.25
    max_sector: float = 0.40
    cvar: float = 0.03
    min_cash: float = 0.05
    max_leverage: float = 2.0
    max_risk: float = 0.02
    max_daily_loss: float = 0.03
    max_drawdown: float = 0.20
    vix_halt: float = 40.0
    correlation: float = 0.85
    atr_multiple: float = 2.0
    min_stop: float = 0.02


def return_state(bars: DataFrame, p: Series = Series(), tail: int = 252, recent: int = 21) -> DataFrame:
    """Latest return statistics per symbol: expected shortfall at 5 % of the last 252, population
    volatility of the last 21. Only ``tail`` rows per symbol are kept before the aggregation."""
    w = Window.partitionBy(*p.keys).orderBy(F.desc("ts"))
    r = bars.withColumn("_r", p.pct("close")).withColumn("_k", F.row_number().over(w)).where((C("_k") <= tail) & C("_r").isNotNull())
    cut = F.percentile("_r", F.lit(0.05)).over(Window.partitionBy(*p.keys))
    r = r.withColumn("_q", cut)
    return r.groupBy(*p.keys).agg(F.count("_r").alias("n_ret"), (-F.avg(F.when(C("_r") <= C("_q"), C("_r")))).alias("cvar"),
                                  (F.stddev_pop(F.when(C("_k") <= recent, C("_r"))) * YEAR).alias("vol21"))


def correlation_with_holdings(returns: DataFrame, book: DataFrame, min_overlap: int = 20, block: int = 64) -> DataFrame:
    """Highest |correlation| of each symbol with the holdings of a book (column ``holding``), itself left out: (candidate, max_corr, n_compared).

    The book's returns become one short array per date, in blocks of ``block`` holdings; a bar meets the array of its date and gives one
    product per holding, summed before the shuffle. Pairs are symbols times book, and no pair list is joined to bars."""
    held = returns.join(book.select(C("holding").alias("symbol")).distinct(), "symbol", "left_semi").where("ret IS NOT NULL")
    place = book.select("holding").distinct().withColumn("_block", F.floor((F.row_number().over(Window.orderBy("holding")) - 1) / block))   # a book is a short list
    held = held.select(C("symbol").alias("holding"), "ts", C("ret").alias("rb")).join(place, "holding")
    held = held.groupBy("ts", "_block").agg(F.collect_list(F.struct("holding", "rb")).alias("_held"))
    j = returns.where("ret IS NOT NULL").select(C("symbol").alias("candidate"), "ts", C("ret").alias("ra")).join(held, "ts")
    j = j.select("candidate", "ra", F.inline("_held")).where("candidate <> holding")
    c = j.groupBy("candidate", "holding").agg(F.count(F.lit(1)).alias("overlap"), corr_agg("ra", "rb").alias("corr"))
    ok = F.when(C("overlap") >= min_overlap, F.abs("corr"))
    return c.groupBy("candidate").agg(F.coalesce(F.max(ok), F.lit(0.0)).alias("max_corr"), F.count_if(C("overlap") >= min_overlap).alias("n_compared"))


#: symbols of a block, and dates whose returns are held as one matrix
BLOCK, DATES = 1024, 4096


def _returns_at(times: list[np.ndarray], rets: list[np.ndarray], dates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols x dates: returns (zero where there is none) and 1 where there is one."""
    x, m = np.zeros((len(times), len(dates))), np.zeros((len(times), len(dates)))
    for i, (t, r) in enumerate(zip(times, rets)):
        a, b = np.searchsorted(t, dates[0]), np.searchsorted(t, dates[-1], side="right")
        at = np.searchsorted(dates, t[a:b])
        x[i, at], m[i, at] = r[a:b], 1.0
    return x, m


def _block_correlations(a: list[tuple], b: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Overlap and correlation (NaN where a side does not vary) of every series of ``a`` with every one of ``b``."""
    (ta, ra), (tb, rb) = zip(*a), zip(*b)
    dates = np.unique(np.concatenate([*ta, *tb]))
    n, sx, sy, sxx, syy, sxy = np.zeros((6, len(a), len(b)))
    for i in range(0, len(dates), DATES):
        (x, mx), (y, my) = _returns_at(ta, ra, dates[i:i + DATES]), _returns_at(tb, rb, dates[i:i + DATES])
        n += mx @ my.T
        sx += x @ my.T
        sy += mx @ y.T
        sxx += (x * x) @ my.T
        syy += mx @ (y * y).T
        sxy += x @ y.T
    with np.errstate(all="ignore"):
        vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
        c = (sxy / n - sx / n * (sy / n)) / np.sqrt(vx * vy)
        return n, np.where((vx > 1e-13 * sxx / n) & (vy > 1e-13 * syy / n), c, np.nan)


def correlation_within(returns: DataFrame, members: DataFrame, min_overlap: int = 20, block: int = BLOCK) -> DataFrame:
    """Highest |correlation| of each symbol with the others of its groups: (candidate, max_corr, n_compared).

    members: symbol, universe; a row that comes more than once counts its bars as often. All pairs of a group are compared, which is
    quadratic: a group is cut into blocks of about ``block`` symbols, a pair of blocks is a task of a few matrix products, and what leaves
    it is one row per symbol."""
    m = members.where("symbol IS NOT NULL AND universe IS NOT NULL").groupBy("symbol", "universe").agg(F.count(F.lit(1)).alias("k"))
    blocks = m.groupBy("universe").agg(F.ceil(F.count(F.lit(1)) / block).alias("_nb"))
    of = m.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("universe", "k"))).alias("of"))
    r = returns.where("symbol IS NOT NULL AND ts IS NOT NULL AND ret IS NOT NULL")
    s = r.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(F.unix_micros(C("ts").cast("timestamp")).alias("t"), C("ret").alias("r")))).alias("_s"))
    d = s.join(of, "symbol").select("symbol", C("_s.t").alias("t"), C("_s.r").alias("r"), C("of.universe").alias("groups"), C("of.k").alias("times"), F.explode("of.universe").alias("universe"))
    d = d.join(blocks, "universe").withColumn("own", F.pmod(F.xxhash64("symbol"), C("_nb")))
    d = d.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), C("_nb") - 1)).alias("_other"))
    d = d.withColumns({"lo": F.least("own", "_other"), "hi": F.greatest("own", "_other")}).drop("_nb", "_other")

    def compared(t: pa.Table) -> pa.Table:
        u, lo, hi = (t[c][0].as_py() for c in ("universe", "lo", "hi"))
        own, names = t["own"].to_numpy(), t["symbol"].to_pylist()
        series = [(np.asarray(x.values), np.asarray(y.values)) for x, y in zip(t["t"], t["r"])]
        series = [(x, y - y.mean()) for x, y in series]
        belongs = [dict(zip(g, k)) for g, k in zip(t["groups"].to_pylist(), t["times"].to_pylist())]
        ia, ib = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        if not len(ia) or not len(ib):
            return pa.table({"candidate": pa.array([], pa.string()), "best": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        n, c = _block_correlations([series[i] for i in ia], [series[i] for i in ib])
        every = sorted({g for x in belongs for g in x})
        w = np.array([[x.get(g, 0) for g in every] for x in belongs], float)
        n *= w[ia] @ w[ib].T
        earlier = (w[:, :every.index(u)] > 0).astype(float)     # a pair of two groups is counted in the first of them
        n[earlier[ia] @ earlier[ib].T > 0] = 0
        if lo == hi:
            np.fill_diagonal(n, 0)
        ok = n >= min_overlap
        c = np.where(ok & ~np.isnan(c), np.abs(c), -1.0)
        rows = [(names[i], c[k].max(), int(ok[k].sum())) for k, i in enumerate(ia) if n[k].any()]
        if lo != hi:
            rows += [(names[i], c[:, k].max(), int(ok[:, k].sum())) for k, i in enumerate(ib) if n[:, k].any()]
        return pa.table({"candidate": pa.array([x[0] for x in rows], pa.string()), "best": pa.array([x[1] for x in rows], pa.float64()), "n": pa.array([x[2] for x in rows], pa.int64())})

    out = d.groupBy("universe", "lo", "hi").applyInArrow(compared, "candidate string, best double, n bigint")
    return out.groupBy("candidate").agg(F.greatest(F.max("best"), F.lit(0.0)).alias("max_corr"), F.sum("n").alias("n_compared"))


def screen_orders(orders: DataFrame, lim: OrderLimits = OrderLimits()) -> DataFrame:
    """Fourteen checks per order. Input columns: size, sector_exposure, n_ret, cvar, vol21, atr, price, cash_pct, stop_loss_pct,
    gross_positions, confidence, max_corr, leverage, daily_pnl_pct, drawdown, vix. Hard failures reject,
    soft ones halve the size each (floor 0.10 of it); an ATR breach caps it first."""
    size = F.abs("size")
    have20, have21 = C("n_ret") >= 20, C("n_ret") >= 21
    cvar = F.when(have20, C("cvar") * size).otherwise(0.0)
    has_atr = (C("atr") > 0) & (C("price") > 0)
    stop_pct = C("atr") * lim.atr_multiple / nz("price")
    atr_max = F.least(lim.max_risk / F.greatest(stop_pct, F.lit(0.001)), F.lit(lim.max_position))
    vol_max = 0.15 / F.greatest(C("vol21"), F.lit(0.01)) * C("confidence") * 1.5
    total = C("gross_positions") + size
    checks = {
        "max_position_size": (size <= lim.max_position, size), "sector_concentration": (C("sector_exposure") + size <= lim.max_sector, C("sector_exposure") + size),
        "cvar": (cvar <= lim.cvar, cvar), "atr_sizing": (~has_atr | (size <= atr_max), size),
        "cash_reserve": (C("cash_pct") - size >= lim.min_cash, C("cash_pct") - size), "stop_loss_required": (C("stop_loss_pct") >= lim.min_stop, C("stop_loss_pct")),
        "track_exposure": (total <= lim.max_position, total), "vol_targeting": (~have21 | (size <= vol_max), size),
        "correlation_gate": (C("max_corr") <= lim.correlation, C("max_corr")), "max_leverage": (C("leverage") + size <= lim.max_leverage, C("leverage") + size),
        "daily_loss_limit": (C("daily_pnl_pct") > -lim.max_daily_loss, F.abs(F.least(C("daily_pnl_pct"), F.lit(0.0)))),
        "drawdown_gate": (C("drawdown") <= lim.max_drawdown, C("drawdown")), "vix_filter": ((C("vix") <= 0) | (C("vix") <= lim.vix_halt), C("vix")),
        "portfolio_risk_budget": (~have21 | (size * C("vol21") <= lim.max_risk), F.when(have21, size * C("vol21")).otherwise(0.0)),
    }
    arr = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(ok, F.lit(True)).alias("passed"), v.cast("double").alias("value")) for k, (ok, v) in checks.items()])
    d = orders.withColumn("checks", arr)
    hard = F.filter("checks", lambda c: ~c["passed"] & c["name"].isin(*HARD_CHECKS))
    soft = F.size(F.filter("checks", lambda c: ~c["passed"] & ~c["name"].isin(*HARD_CHECKS)))
    d = d.withColumns({"approved": F.size(hard) == 0, "n_soft": soft, "rejected_by": F.get(hard, F.lit(0))["name"]})
    capped = F.when(has_atr & (size > atr_max), F.signum("size") * atr_max).otherwise(C("size"))
    scaled = capped * F.when(C("n_soft") > 0, F.greatest(F.pow(F.lit(0.5), C("n_soft")), F.lit(0.10))).otherwise(1.0)
    return d.withColumn("final_size", F.when(C("approved"), clamp(scaled, -lim.max_position, lim.max_position)).otherwise(0.0))


def capacity(df: DataFrame, sharpe="sharpe", turnover="turnover", adv: float = 50_000_000.0, gamma: float = 0.6, lam: float = 1.0,
             base_slip: float = 0.0005, max_adv_frac: float = 0.05, capital: float = 100_000.0, min_sharpe: float = 0.30) -> DataFrame:
    """Impact-adjusted Sharpe at set sizes and the capital where it halves or hits the minimum.

    The curve S(c) = S0 (1 - k c**gamma) is monotone, so the crossing is solved in closed form and
    clamped to the search bracket.
    """
    s0, t = col(sharpe), col(turnover)
    k = lam * F.pow(t / 252.0 / adv, F.lit(gamma)) * math.sqrt(252.0) * t
    def at(c):
        return F.greatest(s0 - s0 * k * c ** gamma, F.lit(0.0))
    def solve(target, lo, hi):
        x = (1.0 - target / nz(s0)) / nz(k)
        return F.when(x <= 0, lo).otherwise(F.least(F.greatest(F.pow(F.greatest(x, F.lit(0.0)), 1.0 / gamma), F.lit(lo)), F.lit(hi)))
    pos = s0 > 0
    z = lambda e: F.when(pos, e).otherwise(0.0)
    slip = s0 - 3.0 * base_slip * t * math.sqrt(252.0)
    half = solve(s0 / 2.0, capital, adv * max_adv_frac * 100)
    return df.withColumns({
        "sharpe_at_100k": z(at(1e5)), "sharpe_at_1m": z(at(1e6)), "sharpe_at_10m": z(at(1e7)), "sharpe_at_100m": z(at(1e8)),
        "optimal_capacity_usd": z(half), "max_capacity_usd": z(solve(F.lit(min_sharpe), capital, adv * 100)), "sr_at_3x_slippage": z(slip),
        "passes_slippage_gate": flag(pos & (slip >= 0.30)), "adv_fraction_at_optimal": z(half * t / 252.0 / adv)})


def exit_rules(df: DataFrame, trade_keys=("symbol", "trade_id"), stop: float = 0.10, take: float = 0.0, activate: float = 0.04, trail: float = 0.08) -> DataFrame:
    """First bar of each trade at which a stop, a take-profit or the trailing stop is hit."""
    p = Series(keys=tuple(trade_keys))
    d = df.withColumns({"entry": F.first("close").over(p.past), "trail_high": F.max("close").over(p.past)})
    gain = (C("close") - C("entry")) / (C("entry") + 1e-9)
    why = F.when(gain <= -stop, "STOP_LOSS")
    if take > 0:
        why = why.when(gain >= take, "TAKE_PROFIT")
    why = why.when((gain >= activate) & (C("close") <= C("trail_high") * (1.0 - trail)), "TRAIL_STOP")
    d = d.withColumn("why", why)
    a = d.groupBy(*trade_keys).agg(F.min("ts").alias("entry_ts"), F.max("ts").alias("last_ts"), F.max("trail_high").alias("high"),
                                   F.min(F.when(C("why").isNotNull(), F.struct("ts", "why", "close"))).alias("x"))
    return a.select(*trade_keys, "entry_ts", "last_ts", "high", C("x.ts").alias("exit_ts"), C("x.why").alias("reason"), C("x.close").alias("exit_price"))


def order_costs(df: DataFrame, conservative: bool = False, commission: float = 0.001, slippage: float = 0.0005, spread: float = 0.0002,
                limit_bps: float = 4.0, participation: float = 0.10, min_fill: float = 0.2, impact_bps: float = 1.0) -> DataFrame:
    """Cost columns of orders joined to their bar: side, qty, price, low, high, volume, day_vol.

    Limit price and whether the bar reached it, slipped fill price, volume-capped quantity with reason,
    commission, and the price factor of the order's share of volume.
    """
    vol = F.coalesce("day_vol", F.lit(0.20))
    over = F.greatest(vol - 0.15, F.lit(0.0))
    base, sens, buf_mult, part_mult = (1.35, 2.0, 1.5, 0.6) if conservative else (1.0, 1.2, 1.0, 1.0)
    buy = C("side") == "buy"
    sgn = F.when(buy, 1.0).otherwise(-1.0)
    mult = base * (1.0 + sens * over)
    limit = C("price") - sgn * C("price") * (limit_bps / 10_000.0) * buf_mult * (1.0 + over)
    reached = F.when(buy, C("low") <= limit).otherwise(C("high") >= limit)
    cap = F.floor(C("volume") * (participation * part_mult))
    thin = cap < F.ceil(C("qty") * min_fill)
    qty = F.when(C("volume").isNull(), C("qty")).when(cap <= 0, 0).when(C("qty") <= cap, C("qty")).when(thin, 0).otherwise(cap)
    why = F.when(C("volume").isNull() | ((cap > 0) & (C("qty") <= cap)), "").when(cap <= 0, "no_day_volume").when(thin, "liquidity_too_thin").otherwise("volume_capped_partial_fill")
    d = df.withColumns({"slippage_mult": mult, "limit_price": limit, "limit_reached": flag(F.coalesce(reached, F.lit(True))),
                        "fill_price": C("price") + sgn * (C("price") * spread / 2.0 + C("price") * slippage * mult),
                        "fill_qty": qty.cast("bigint"), "fill_reason": why,
                        "impact_factor": 1.0 + sgn * impact_bps * (F.abs("qty") / F.greatest(C("volume"), F.lit(1.0))) * 100.0 / 10_000.0})
    return d.withColumn("commission", C("fill_price") * C("fill_qty") * commission)


def execution_schedule(orders: DataFrame, n: int = 10, sigma="sigma", eta: float = 0.01, gamma: float = 0.001, lam="lam", qty="qty") -> DataFrame:
    """Closed-form liquidation path per order: rows (order key.., step, remaining, sold)."""
    kappa = F.sqrt(F.greatest(col(lam) * col(sigma) * col(sigma) / (eta + 1e-12), F.lit(0.0)))
    d = orders.withColumn("_k", kappa).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n))))
    def left(j):
        flat = (C("_k") < 1e-10) | (F.abs(F.sinh(C("_k") * n)) < 1e-12)
        return F.when(flat, col(qty) * (1.0 - j / float(n))).otherwise(col(qty) * F.sinh(C("_k") * (n - j)) / nz(F.sinh(C("_k") * n)))
    return d.withColumns({"remaining": left(C("step")), "sold": F.when(C("step") > 0, left(C("step") - 1) - left(C("step")))}).drop("_k")


def schedule_cost(sched: DataFrame, keys, n: int = 10, eta: float = 0.01, gamma: float = 0.001, qty="qty", sigma="sigma", lam="lam") -> DataFrame:
    """Expected cost, variance and utility of each schedule (interval length 1)."""
    x = C(qty)
    rest = [F.max(c).alias(c) for c in (qty, sigma, lam) if c not in keys]
    a = sched.groupBy(*keys).agg(*rest, F.sum(C("sold") * C("sold")).alias("_s2"),
                                 F.sum("sold").alias("_s"), F.sum(F.when(C("step") < n, C("remaining") * C("remaining"))).alias("_x2"))
    cost = 0.5 * gamma * x * x + eta * C("_s2") + 0.5 * gamma * C("_s")
    a = a.withColumns({"expected_cost": cost, "variance_cost": C(sigma) * C(sigma) * C("_x2")})
    return a.withColumn("utility", C("expected_cost") + C(lam) * C("variance_cost")).drop("_s2", "_s", "_x2")


#: orders of one task of a frontier; their groups by order and risk aversion fit in its memory
FRONTIER_ROWS = 50_000


def frontier(orders: DataFrame, points: int = 20, key: str | None = None) -> DataFrame:
    """Schedules over a log grid of risk aversion 1e-8 .. 1e-2 (the grid is a literal array).

    With ``key`` the orders are brought together by it before the grid multiplies them, so that sums by order and risk aversion move no more rows."""
    grid = [10 ** (-8 + 6 * i / (points - 1)) for i in range(points)]
    if key is not None:
        tasks = max(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(orders.count() / FRONTIER_ROWS))
        orders = orders.repartition(tasks, key)
    return orders.withColumn("lam", F.explode(F.array(*[F.lit(g) for g in grid])))
