"""Cross-asset features: macro series attached to bar dates, then windows over the symbol's own bars."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.trailing import Late, Trailing, deviations, means, quantile
from ...functions.windows import Series, above, flag, nz
from ...sources.tables import MACRO_TICKERS
from .base import family
from .technical import ranks, ratio

C = F.col


def attach_macro(panel: DataFrame, macro: DataFrame, tickers: dict[str, str] = MACRO_TICKERS,
                 p: Series = Series(), backfill: bool = False) -> DataFrame:
    """Exact-date join of the pivoted macro table, then last known value along each symbol's bars.

    The pivoted table has one row per calendar day. ``backfill=True`` also fills the first bars from the
    future, which leaks; it exists only to reproduce old numbers.
    """
    wide = (macro.where(C("ticker").isin(list(tickers)))
            .groupBy("ts").pivot("ticker", list(tickers)).agg(F.max("close")))
    wide = wide.withColumnsRenamed({t: f"_raw_{n}" for t, n in tickers.items()})
    df = panel.join(wide, "ts", "left")
    df = df.withColumns({f"_m_{n}": p.ffill(f"_raw_{n}") for n in tickers.values()})
    if backfill:
        df = df.withColumns({f"_m_{n}": F.coalesce(f"_m_{n}", p.bfill(f"_raw_{n}")) for n in tickers.values()})
    return df.drop(*[f"_raw_{n}" for n in tickers.values()])


def m(name: str) -> Column:
    return C(f"_m_{name}")


def z(x, mu, sd):
    """Z-score; a value within rounding noise of its mean scores 0."""
    d = C(x) - C(mu)
    return F.when(F.abs(d) > 1e-9 * F.abs(C(mu)), ratio(d, C(sd))).when(d.isNotNull(), 0.0)


@family("FEA-22", "vix_level vix_ratio vix_lr_ratio vix_1d_chg vix_5d_chg vix_rank vix_spike vix_low vix_fear_zone vix_calm_zone",
        252, macro=["vix"])
def vix(p: Series):
    v = m("vix")
    q = {f"_vix_q{n}": Trailing(quantile(n / 100, 63), ("_m_vix",), 252) for n in (20, 80)}
    rel = ratio(v, C("_vix20"))
    return [{"vix_level": v, "_vix20": means("_m_vix", 20, 10), "_vix252": means("_m_vix", 252, 63),
             "vix_1d_chg": p.pct(v, 1), "vix_5d_chg": p.pct(v, 5)},
            {**ranks({"vix_rank": ("_m_vix", 63, 20)}), **q, "vix_ratio": Late(rel), "vix_lr_ratio": Late(ratio(v, C("_vix252"))),
             "vix_fear_zone": Late(flag(above(v, C("_vix_q80")))),
             "vix_calm_zone": Late(flag(above(C("_vix_q20"), v)))},
            {"vix_spike": Late(flag(rel > 1.30)), "vix_low": Late(flag(rel < 0.85))}]


@family("FEA-23", "vvix_level vvix_zscore vvix_spike vvix_above_ma", 63, macro=["vvix"])
def vvix(p):
    v = m("vvix")
    return [{"vvix_level": v, "_vv20": means("_m_vvix", 20, 10), "_vvmu": means("_m_vvix", 63, 20), "_vvsd": deviations("_m_vvix", 63, 20)},
            {"vvix_zscore": Late(z("vvix_level", "_vvmu", "_vvsd")), "vvix_spike": flag(v > 120),
             "vvix_above_ma": Late(flag(above(v, "_vv20")))}]


@family("FEA-24", "yield_curve_10_3m yield_curve_inverted yield_curve_zscore yield_curve_chg_20d yield_curve_rank yield_curve_5_3m",
        252, macro=["tnx", "irx", "fvx"])
def yield_curve(p):
    y = "yield_curve_10_3m"
    return [{y: (m("tnx") - m("irx")) / 100.0, "yield_curve_5_3m": (m("fvx") - m("irx")) / 100.0},
            {"yield_curve_inverted": flag(C(y) < 0.0), "_ycmu": means(y, 252, 63), "_ycsd": deviations(y, 252, 63),
             "yield_curve_chg_20d": p.diff(y, 20)},
            {**ranks({"yield_curve_rank": (y, 252, 63)}), "yield_curve_zscore": Late(z(y, "_ycmu", "_ycsd"))}]


@family("FEA-25", "vix_ts_front_ratio vix_ts_back_ratio vix_contango vix_ts_slope vix_ts_slope_rank", 63,
        macro=["vix", "vix9d", "vix3m"])
def term_structure(p):
    return [{"vix_ts_front_ratio": ratio(m("vix9d"), m("vix")), "vix_ts_back_ratio": ratio(m("vix"), m("vix3m")),
             "vix_contango": flag(m("vix9d") < m("vix")), "vix_ts_slope": ratio(m("vix3m") - m("vix9d"), m("vix9d"))},
            ranks({"vix_ts_slope_rank": ("vix_ts_slope", 63, 20)})]


@family("FEA-26", "dxy_ret_5d dxy_ret_21d dxy_zscore dxy_above_ma", 63, macro=["dxy"])
def dollar(p):
    v = m("dxy")
    return [{"dxy_ret_5d": p.pct(v, 5), "dxy_ret_21d": p.pct(v, 21), "_dxmu": means("_m_dxy", 63, 20), "_dxsd": deviations("_m_dxy", 63, 20)},
            {"dxy_zscore": Late(z("_m_dxy", "_dxmu", "_dxsd")), "dxy_above_ma": Late(flag(above(v, "_dxmu")))}]


def bond(p, name, short=True):
    """Returns, z-score and moving-average flag shared by the bond funds."""
    v = m(name)
    one = {f"{name}_ret_5d": p.pct(v, 5), f"{name}_ret_21d": p.pct(v, 21),
           f"_{name}mu": means(f"_m_{name}", 20, 10), f"_{name}sd": deviations(f"_m_{name}", 20, 10)}
    two = {f"{name}_zscore": Late(z(f"_m_{name}", f"_{name}mu", f"_{name}sd")), f"{name}_above_ma": Late(flag(above(v, f"_{name}mu")))}
    return one, two


@family("FEA-27", "hyg_ret_5d hyg_ret_21d hyg_zscore hyg_above_ma credit_spread_ratio credit_spread_zscore "
        "credit_spread_chg_5d credit_stress", 20, macro=["hyg", "tlt"])
def credit(p):
    one, two = bond(p, "hyg")
    cs = "credit_spread_ratio"
    return [{**one, cs: ratio(m("hyg"), m("tlt"))},
            {**two, "_csmu": p.mean(cs, 20, 10), "_cssd": deviations(cs, 20, 10), "credit_spread_chg_5d": p.pct(cs, 5)},
            {"credit_spread_zscore": Late(z(cs, "_csmu", "_cssd")), "credit_stress": flag(C(cs) < C("_csmu") * 0.98)}]


def versus_close(name):
    return m(name) / nz("close")


@family("FEA-28", "tlt_ret_5d tlt_above_ma qqq_spy_ratio_chg_5d qqq_spy_momentum gld_ret_21d", 21,
        macro=["tlt", "qqq", "gld"])
def flight(p):
    return [{"tlt_ret_5d": p.pct(m("tlt"), 5), "_tltma": means("_m_tlt", 20, 10), "_qs": versus_close("qqq"),
             "gld_ret_21d": p.pct(m("gld"), 21)},
            {"_qsma": p.mean("_qs", 21, 10), "qqq_spy_ratio_chg_5d": p.pct("_qs", 5)},
            {"tlt_above_ma": Late(flag(above(m("tlt"), "_tltma"))), "qqq_spy_momentum": flag(C("_qs") > C("_qsma"))}]


@family("FEA-29", "skew_level skew_zscore skew_extreme skew_chg_5d skew_rank skew_vix_fear", 126, macro=["skew", "vix"])
def skew_index(p):
    """Present only for symbols with more than 50 known values."""
    v = C("skew_level")
    ok = F.count("_m_skew").over(p.whole) > 50
    return [{"_skok": ok}, {"skew_level": F.when(C("_skok"), m("skew"))},
            {"_skmu": means("skew_level", 63, 20), "_sksd": deviations("skew_level", 63, 20), "skew_chg_5d": p.diff(v, 5)},
            {**ranks({"skew_rank": ("skew_level", 126, 30)}), "_vix_q70": Trailing(quantile(0.7, 20), ("_m_vix",), 63), "skew_zscore": Late(z("skew_level", "_skmu", "_sksd")),
             "skew_extreme": F.when(C("_skok"), flag(v > 140)),
             "skew_vix_fear": Late(F.when(C("_skok"), flag(v > 130) * flag(above(m("vix"), C("_vix_q70")))))}]


@family("FEA-30", "lqd_ret_5d lqd_ret_21d lqd_zscore lqd_above_ma", 21, macro=["lqd"])
def lqd(p):
    return list(bond(p, "lqd"))


@family("FEA-31", "eem_ret_21d eem_above_ma eem_momentum eem_spy_ret_21d", 63, macro=["eem"])
def emerging(p):
    v = m("eem")
    return [{"eem_ret_21d": p.pct(v, 21), "_em21": means("_m_eem", 21, 10), "_em63": means("_m_eem", 63, 20), "_es": versus_close("eem")},
            {"eem_above_ma": Late(flag(above(v, "_em21"))), "eem_momentum": Late(flag(above("_em21", "_em63"))),
             "eem_spy_ret_21d": p.pct("_es", 21)}]


@family("FEA-32", "ief_ret_21d ief_above_ma ief_vs_tlt_mom", 21, macro=["ief", "tlt"])
def intermediate(p):
    v = m("ief")
    return [{"ief_ret_21d": p.pct(v, 21), "_ief21": means("_m_ief", 21, 10), "tlt_ret_5d": p.pct(m("tlt"), 5)},
            {"ief_above_ma": Late(flag(above(v, "_ief21"))), "ief_vs_tlt_mom": C("ief_ret_21d") - C("tlt_ret_5d")}]


SECTORS = ("xlf", "xlk", "xlv", "iwm", "xle")


@family("FEA-40", "xlf_spy_momentum xlf_spy_chg_21d xlk_spy_momentum xlk_spy_chg_5d xlv_spy_defensive iwm_spy_breadth "
        "iwm_spy_chg_21d xle_spy_chg_21d", 21, macro=SECTORS)
def sectors(p):
    names = {"xlf": "xlf_spy_momentum", "xlk": "xlk_spy_momentum", "xlv": "xlv_spy_defensive", "iwm": "iwm_spy_breadth"}
    changes = {"xlf": 21, "xlk": 5, "iwm": 21, "xle": 21}
    return [{f"_v_{s}": versus_close(s) for s in SECTORS},
            {**{f"_vma_{s}": p.mean(f"_v_{s}", 21, 10) for s in names},
             **{f"{s}_spy_chg_{n}d": p.pct(f"_v_{s}", n) for s, n in changes.items()}},
            {out: flag(C(f"_v_{s}") > C(f"_vma_{s}")) for s, out in names.items()}]


@family("FEA-41", "sector_breadth_count sector_breadth_pct broad_bull_market narrow_rally", 21, macro=SECTORS)
def sector_breadth(p):
    n = sum(flag(above(m(s), f"_sma_{s}")) for s in SECTORS)
    return [{f"_sma_{s}": means(f"_m_{s}", 21, 10) for s in SECTORS},
            {"sector_breadth_count": Late(n), "sector_breadth_pct": Late(n / float(len(SECTORS))), "broad_bull_market": Late(flag(n >= 4)), "narrow_rally": Late(flag(n <= 1))}]


@family("FEA-44", "market_fav_score market_fav_norm market_fav_rank", 252,
        needs=["FEA-24", "FEA-25", "FEA-27", "FEA-28", "FEA-34", "FEA-37", "FEA-40"])
def favourability(p):
    score = (C("vix_contango") + C("favorable_season") + (1 - C("yield_curve_inverted")) + C("hurst_trending")
             + C("xlf_spy_momentum") + C("qqq_spy_momentum") + C("iwm_spy_breadth") + (1 - C("credit_stress")))
    return [{"market_fav_score": score}, {**ranks({"market_fav_rank": ("market_fav_score", 252, 63)}), "market_fav_norm": C("market_fav_score") / 8.0}]


@family("FEA-49", "vrp_raw vrp_zscore vrp_rank vrp_positive vrp_chg_5d vrp_chg_21d", 273, macro=["vix"], needs=["FEA-9"])
def variance_premium(p):
    return [{"vrp_raw": m("vix") / 100.0 - C("vol_21d")},
            {"_vrmu": means("vrp_raw", 63, 20), "_vrsd": deviations("vrp_raw", 63, 20),
             "vrp_positive": flag(C("vrp_raw") > 0), "vrp_chg_5d": p.diff("vrp_raw", 5), "vrp_chg_21d": p.diff("vrp_raw", 21)},
            {**ranks({"vrp_rank": ("vrp_raw", 252, 63)}), "vrp_zscore": Late(z("vrp_raw", "_vrmu", "_vrsd"))}]
