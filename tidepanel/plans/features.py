"""FEA-*: one query per feature family over the whole bar panel, each with its own SQL answer."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import features as feats
from ..operators.features import calendar as cal
from ..sources.tables import bars, macro, table
from .registry import query, rounded
from .sql import (above, ALL, BARS, PAST, chain, corr, diff, ewm, flag, hi, lag, last, lo, macro_wide, mean, pct, pick, quant,
                  rank, rank_of, ratio, roll, std)

Y = repr(math.sqrt(252.0))


def ranks(spec: dict[str, tuple[str, int, int]]):
    one, two = {}, {}
    for out, (x, n, mp) in spec.items():
        one[f"_l_{out}"] = rank(x, n, mp)[0]
        two[out] = rank_of(f"_l_{out}", x, mp)
    return one, two


def zsc(x, mu, sd):
    return ratio(f"{x} - {mu}", sd)


def mzsc(x, mu, sd):
    return f"CASE WHEN abs({x} - {mu}) > 1e-9 * abs({mu}) THEN {zsc(x, mu, sd)} WHEN {x} - {mu} IS NOT NULL THEN 0.0 END"


SMA = {f"_s{n}": mean("close", n) for n in (5, 10, 20, 50, 200)}
RET = {"ret_1d": pct("close")}
VOL = [RET, {f"vol_{n}d": f"({std('ret_1d', n)}) * {Y}" for n in (5, 21, 63)}]
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
TR_ = {"_tr": TR}
RSI0 = {"_d1": diff("close")}
RSI1 = {"_g": "CASE WHEN _d1 IS NOT NULL THEN greatest(_d1, 0) END", "_ls": "CASE WHEN _d1 IS NOT NULL THEN -least(_d1, 0) END"}


def rsi(n):
    return f"100.0 - 100.0 / (1.0 + ({mean('_g', n)}) / (({mean('_ls', n)}) + 1e-9))"


RSI = [RSI0, RSI1, {"rsi_14": rsi(14), "rsi_28": rsi(28)}]
OBV = [RSI0, {"_o": "sign(coalesce(_d1, 0)) * volume"}, {"_obv": f"sum(_o) {PAST}"}]
BB0 = {"_s20": mean("close", 20), "_sd20": std("close", 20)}
BB1 = {"bb_pct": ratio("close - (_s20 - 2 * _sd20)", "(_s20 + 2 * _sd20) - (_s20 - 2 * _sd20)"),
       "bb_width": ratio("(_s20 + 2 * _sd20) - (_s20 - 2 * _sd20)", "_s20")}
ADX = [
    {**TR_, "_up": diff("high"), "_dn": f"-{diff('low')}"},
    {"_pdm": "CASE WHEN _up > _dn AND _up > 0 THEN _up ELSE 0 END", "_mdm": "CASE WHEN _dn > _up AND _dn > 0 THEN _dn ELSE 0 END"},
    {"_p14": mean("_pdm", 14), "_m14": mean("_mdm", 14), "_t14": mean("_tr", 14)},
    {"_pdi": f"100 * {ratio('_p14', '_t14')}", "_mdi": f"100 * {ratio('_m14', '_t14')}"},
    {"_dx": f"100 * {ratio('abs(_pdi - _mdi)', '_pdi + _mdi')}"},
    {"adx_14": mean("_dx", 14)}]
MOM = [{"_p252": pct("close", 252), "_p126": pct("close", 126), "_p21": pct("close", 21)},
       {"mom_12_1": "coalesce(_p252 - _p21, 0)", "mom_6_1": "coalesce(_p126 - _p21, 0)"}]
MACD = [{"_e12": ewm("close", 12, 12), "_e26": ewm("close", 26, 26)}, {"_macd": "(_e12 - _e26) / (close + 1e-9)"},
        {"_sig": ewm("_macd", 9, 9)}, {"macd_norm": "_macd", "macd_hist": "_macd - _sig", "macd_cross": flag("_macd > _sig")}]
HL = [63 // k for k in range(2, 10)]
HLAGS = sorted(set(HL))


def hurst_sql():
    """Closed forms by list arithmetic; deviations are partial sums written as list_sum over prefixes."""
    layers = [{"_lp": "ln(close + 1e-9)"}, {"_lr": f"_lp - {lag('_lp')}"},
              {"_h": "list(_lr) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 62 PRECEDING AND 1 PRECEDING)",
               "_hn": "count(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)"}]
    means, devs, rs = {}, {}, {}
    for g in HLAGS:
        means[f"_mu{g}"] = f"list_avg(_h[1:{g}])"
        means[f"_sd{g}"] = f"list_stddev_pop(_h[1:{g}])"
        devs[f"_cs{g}"] = f"list_transform(range(1, {g + 1}), lambda k: list_sum(_h[1:k]) - k * _mu{g})"
        rs[f"_rs{g}"] = f"ln(greatest((list_max(_cs{g}) - list_min(_cs{g})) / (_sd{g} + 1e-12), 1e-9))"
    xs = [math.log(g) for g in HLAGS]
    xm = sum(xs) / len(xs)
    sxx = sum((x - xm) ** 2 for x in xs)
    slope = " + ".join(f"{(x - xm) / sxx!r} * _rs{g}" for x, g in zip(xs, HLAGS))
    return layers + [means, devs, rs, {"hurst_63": f"CASE WHEN _hn = 63 THEN least(greatest({slope}, 0), 1) END"},
                     {"hurst_trending": flag("hurst_63 > 0.55"), "hurst_reverting": flag("hurst_63 < 0.45")}]


HURST = hurst_sql()

# family -> (layers, integer columns)
SQL: dict[str, tuple[list[dict[str, str]], str]] = {
    "FEA-1": ([{f"ret_{n}d": pct("close", n) for n in (1, 2, 3, 5, 10, 20)}], ""),
    "FEA-2": ([RET, {"ret_skew_21d": roll("skewness", "ret_1d", 21), "ret_kurt_21d": roll("kurtosis", "ret_1d", 21)}], ""),
    "FEA-3": ([SMA, {f"sma_{n}_dist": ratio(f"close - _s{n}", f"_s{n}") for n in (5, 10, 20, 50, 200)}], ""),
    "FEA-4": ([SMA, {**{f"cross_{a}_{b}": f"{ratio(f'_s{a}', f'_s{b}')} - 1" for a, b in ((5, 20), (20, 50), (50, 200))},
                     "sma_20_above_50": flag("_s20 > _s50"), "sma_50_above_200": flag("_s50 > _s200")}],
              "sma_20_above_50 sma_50_above_200"),
    "FEA-5": (RSI + [{"rsi_norm": "rsi_14 / 100"}], ""),
    "FEA-6": (MACD, "macd_cross"),
    "FEA-7": ([{"_l": lo("low", 14), "_h": hi("high", 14)}, {"_k": "100 * (close - _l) / nullif(_h - _l, 0)"},
               {"_d": mean("_k", 3)}, {"stoch_k": "_k / 100", "stoch_d": "_d / 100", "stoch_hist": "(_k - _d) / 100"}], ""),
    "FEA-8": ([{f"roc_{n}d": pct("close", n) for n in (5, 10, 21)}], ""),
    "FEA-9": (VOL + [{"vol_ratio_5_21": ratio("vol_5d", "vol_21d"), "vol_ratio_21_63": ratio("vol_21d", "vol_63d")}], ""),
    "FEA-10": ([TR_, {"_a": mean("_tr", 14)}, {"atr_ratio": ratio("_a", "close")}], ""),
    "FEA-11": ([BB0, BB1], ""),
    "FEA-12": (VOL + [{"_mu": mean("vol_21d", 63), "_sd": std("vol_21d", 63)}, {"vol_zscore": zsc("vol_21d", "_mu", "_sd")}], ""),
    "FEA-13": ([{"_mu": mean("volume", 20), "_sd": std("volume", 20)},
                {"volume_ratio": ratio("volume", "_mu"), "volume_zscore": zsc("volume", "_mu", "_sd")}], ""),
    "FEA-14": (OBV + [{"_m": mean("_obv", 20)}, {"obv_trend": ratio("_obv - _m", "abs(_m)")}], ""),
    "FEA-15": (ADX + [{"adx_norm": "adx_14 / 100"}], ""),
    "FEA-16": ([{"_rh": f"CASE WHEN high > {lag('high')} THEN 1.0 ELSE 0.0 END", "_rl": f"CASE WHEN low > {lag('low')} THEN 1.0 ELSE 0.0 END"},
                {"higher_highs_10": f"CASE WHEN count(high) {last(10)} >= 10 THEN sum(_rh) {last(9)} / 9.0 END",
                 "higher_lows_10": f"CASE WHEN count(low) {last(10)} >= 10 THEN sum(_rl) {last(9)} / 9.0 END"},
                {"trend_strength": "higher_highs_10 - (1 - higher_lows_10)"}], ""),
    "FEA-17": ([{"_h": hi("high", 252, 63), "_l": lo("low", 252, 63)},
                {"channel_pos_52w": ratio("close - _l", "_h - _l"), "high_52w_dist": ratio("close - _h", "_h")}], ""),
    "FEA-18": ([{"gap": f"open / {lag('close')} - 1", "intraday_ret": "close / open - 1"}, {"gap_vs_intraday": "gap - intraday_ret"}], ""),
    "FEA-19": (MOM + [{"reversal_1w": f"-{pct('close', 5)}", "reversal_1m": "-_p21"}], ""),
    "FEA-20": (VOL + [{"vol_of_vol": std("vol_21d", 30)}, {"_mu": mean("vol_of_vol", 126, 63), "_sd": std("vol_of_vol", 126, 63)},
                      {"vol_of_vol_norm": ratio("vol_of_vol", "vol_21d"), "vol_of_vol_zscore": zsc("vol_of_vol", "_mu", "_sd")}], ""),
    "FEA-36": (VOL + [{"_hl": "ln((high + 1e-9) / (low + 1e-9))", "_co": "ln((close + 1e-9) / (open + 1e-9))"},
                      {"_gk": f"0.5 * _hl * _hl - {2 * math.log(2) - 1!r} * _co * _co"}, {"_gm": mean("_gk", 21, 10)},
                      {"gk_vol_21d": "CASE WHEN _gm >= 0 THEN sqrt(_gm * 252) END"},
                      {"_mu": mean("gk_vol_21d", 63, 20), "_sd": std("gk_vol_21d", 63, 20)},
                      {"gk_vs_realized_vol": ratio("gk_vol_21d", "vol_21d"), "gk_vol_zscore": zsc("gk_vol_21d", "_mu", "_sd")}], ""),
    "FEA-37": (HURST, "hurst_trending hurst_reverting"),
    "FEA-38": ([RET, {"_r1": lag("ret_1d", 1), "_r5": lag("ret_1d", 5)},
                {f"autocorr_{k}d": f"CASE WHEN count(ret_1d) {last(21)} >= 15 THEN corr(ret_1d, _r{k}) {last(21 - k)} END" for k in (1, 5)}], ""),
    "FEA-39": ([RET, {"_a": "abs(ret_1d) / (volume + 1e-9)"}, {"amihud_illiq": mean("_a", 21, 10), "_mu": mean("_a", 63, 20), "_sd": std("_a", 63, 20)},
                {"amihud_zscore": zsc("_a", "_mu", "_sd")}], ""),
    "FEA-42": ([{"_p63": pct("close", 63), "_p21": pct("close", 21), "_p5": pct("close", 5)}, {"_m": mean("_p5", 20, 10)},
                {"mom_quality_63_21": ratio("_p21", "abs(_p63)"),
                 "mom_accel_21_63": f"{ratio('_p21', 'abs(_p21)')} * ({ratio('abs(_p21)', 'abs(_p63)')} - 0.333)",
                 "mom_accel_5_20avg": "_p5 - _m"}], ""),
    "FEA-43": (RSI + [{"_px": diff("close", 10), "_rs": diff("rsi_14", 10)},
                      {"rsi_divergence_bear": flag("_px > 0 AND _rs < -3"), "rsi_divergence_bull": flag("_px < 0 AND _rs > 3")},
                      {"rsi_divergence": "rsi_divergence_bull - rsi_divergence_bear"}],
               "rsi_divergence_bear rsi_divergence_bull rsi_divergence"),
    "FEA-46": ([RET, {"_dr": "CASE WHEN ret_1d IS NOT NULL THEN least(ret_1d, 0) END", "_ur": "CASE WHEN ret_1d IS NOT NULL THEN greatest(ret_1d, 0) END"},
                {"downvol_21d": f"({std('_dr', 21, 10)}) * {Y}", "_uv": f"({std('_ur', 21, 10)}) * {Y}"},
                {"asymmetric_vol": ratio("downvol_21d", "_uv")},
                {"_mu": mean("asymmetric_vol", 63, 20), "_sd": std("asymmetric_vol", 63, 20)},
                {"vol_asymmetry_z": zsc("asymmetric_vol", "_mu", "_sd")}], ""),
    "FEA-47": (ADX + [{"adx_chg_5d": diff("adx_14", 5), "adx_chg_10d": diff("adx_14", 10)},
                      {"adx_trending": flag("adx_14 > 25 AND adx_chg_5d > 0"), "adx_strength": "adx_14 * adx_chg_5d / (100 + 1e-9)"}], "adx_trending"),
    "FEA-48": ([{"mom_12_0": f"coalesce({pct('close', 252)}, 0)", "mom_1m": f"coalesce({pct('close', 21)}, 0)", "mom_3m": f"coalesce({pct('close', 63)}, 0)"}], ""),
    "FEA-51": ([RET, {"_r5": pct("close", 5)}, {"price_vol_corr_10d": corr("_r5", "volume", 10, 5), "price_vol_corr_21d": corr("ret_1d", "volume", 21, 10)}], ""),
    "FEA-52": (OBV + [{"_h": hi("close", 10, 5), "_l": lo("close", 10, 5), "_v": mean("volume", 20, 10), "_o5": mean("_obv", 5, 3), "_o20": mean("_obv", 20, 10)},
                      {"distribution_signal": flag("close = _h AND volume < _v"), "accumulation_signal": flag("close = _l AND volume < _v"),
                       "obv_momentum": f"{ratio('_o5', 'abs(_o20)')} - 1"}], "distribution_signal accumulation_signal"),
    "FEA-53": ([{"_g": f"coalesce(open / {lag('close')} - 1, 0)", "_i": "coalesce(close / open - 1, 0)"},
                {"_on": mean("_g", 21, 10), "_in": mean("_i", 21, 10)},
                {"overnight_vs_intraday": "_on - _in", "overnight_lead": flag("_on > _in")}], "overnight_lead"),
    "FEA-54": ([{"_h": hi("close", 252, 63)}, {"dist_from_52w_high": ratio("close - _h", "_h")},
                {"near_52w_high": flag("dist_from_52w_high > -0.02"), "at_52w_high": flag("dist_from_52w_high > -0.005")}], "near_52w_high at_52w_high"),
    "FEA-58": ([RET, {"_p": "CASE WHEN ret_1d > 0 THEN 1.0 ELSE 0.0 END"},
                {"ret_consistency_10d": mean("_p", 10, 5), "ret_consistency_21d": mean("_p", 21, 10)},
                {"trend_quality_10_21": "ret_consistency_10d - ret_consistency_21d", "strong_uptrend": flag("ret_consistency_21d > 0.65"),
                 "choppy_market": flag("ret_consistency_21d > 0.40 AND ret_consistency_21d < 0.60")}], "strong_uptrend choppy_market"),
    "FEA-59": ([RET, {"_u": flag("ret_1d > 0"), "_d": flag("ret_1d < 0")},
                {"_cu": f"sum(1 - _u) {PAST}", "_cd": f"sum(1 - _d) {PAST}"},
                {"up_streak": "CAST(sum(_u) OVER (PARTITION BY symbol, _cu ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INTEGER)",
                 "down_streak": "CAST(sum(_d) OVER (PARTITION BY symbol, _cd ORDER BY ts ROWS UNBOUNDED PRECEDING) AS INTEGER)"}], "up_streak down_streak"),
    "FEA-60": ([RET, {"_mu": mean("ret_1d", 63, 20), "_sd": std("ret_1d", 63, 20)}, {"_z": zsc("ret_1d", "_mu", "_sd")},
                {"extreme_down": flag("_z < -2.5"), "extreme_up": flag("_z > 2.5")},
                {"_pd": f"coalesce({lag('extreme_down')}, 0)", "_pu": f"coalesce({lag('extreme_up')}, 0)"},
                {"rev_signal_5d": f"max(_pd) {last(5)} - max(_pu) {last(5)}"}], "extreme_down extreme_up rev_signal_5d"),
    "FEA-33": ([{"month_sin": "sin(2 * pi() * month(ts) / 12)", "month_cos": "cos(2 * pi() * month(ts) / 12)",
                 "dow_sin": "sin(2 * pi() * (isodow(ts) - 1) / 5)", "dow_cos": "cos(2 * pi() * (isodow(ts) - 1) / 5)"}], ""),
    "FEA-34": ([{"favorable_season": flag("month(ts) IN (11, 12, 1, 2, 3, 4)"), "quarter_end": flag("day(ts) >= 28 AND month(ts) IN (3, 6, 9, 12)"),
                 "month_end": flag("day(ts) >= 28"), "january": flag("month(ts) = 1"), "december": flag("month(ts) = 12"),
                 "month_start": flag("day(ts) <= 3"), "payday": flag("day(ts) = 15"),
                 "week_of_month": "CAST((day(ts) - 1) // 7 + 1 AS INTEGER)"}],
               "favorable_season quarter_end month_end january december month_start payday week_of_month"),
    "FEA-35": ([{"_m": "date_trunc('month', ts)"}, {"_f": "CAST(_m AS DATE) + CAST((5 - isodow(_m) + 7) % 7 AS INTEGER) + 14"},
                {"opex_week": flag("CAST(ts AS DATE) BETWEEN _f - 4 AND _f")}], "opex_week"),
    "FEA-57": ([{"month_last_day": flag("CAST(ts AS DATE) = last_day(ts)")},
                {"tom_zone": flag("day(ts) <= 3 OR month_last_day = 1")}], "month_last_day tom_zone"),
}

_r = ranks({"rvol_rank": ("rvol", 63, 20)})
SQL["FEA-55"] = ([{**RET, "_v": mean("volume", 20, 10)}, {"rvol": ratio("volume", "_v")}, _r[0],
                  {**_r[1], "rvol_up": "rvol * CASE WHEN ret_1d > 0 THEN 1 ELSE 0 END", "rvol_down": "rvol * CASE WHEN ret_1d < 0 THEN 1 ELSE 0 END",
                   "rvol_confirm": flag("rvol > 1.5 AND ret_1d > 0")}], "rvol_confirm")
_r = ranks({"bb_width_rank": ("bb_width", 126, 40)})
SQL["FEA-56"] = ([BB0, BB1, {**_r[0], "_q2": quant("bb_width", 63, 0.2, 20), "_q8": quant("bb_width", 63, 0.8, 20)},
                  {**_r[1], "bb_squeeze": flag("bb_width < _q2"), "bb_expansion": flag("bb_width > _q8")}], "bb_squeeze bb_expansion")

# cross-asset families: layers over mbars, integer columns, macro names
M: dict[str, tuple[list[dict[str, str]], str, str]] = {}
_r = ranks({"vix_rank": ("_m_vix", 63, 20)})
M["FEA-22"] = ([{**_r[0], "vix_level": "_m_vix", "_m20": mean("_m_vix", 20, 10), "_m252": mean("_m_vix", 252, 63), "vix_1d_chg": pct("_m_vix", 1),
                 "vix_5d_chg": pct("_m_vix", 5), "_q8": quant("_m_vix", 252, 0.8, 63), "_q2": quant("_m_vix", 252, 0.2, 63)},
                {**_r[1], "vix_ratio": ratio("_m_vix", "_m20"), "vix_lr_ratio": ratio("_m_vix", "_m252"),
                 "vix_spike": flag(f"{ratio('_m_vix', '_m20')} > 1.30"), "vix_low": flag(f"{ratio('_m_vix', '_m20')} < 0.85"),
                 "vix_fear_zone": flag(above("_m_vix", "_q8")), "vix_calm_zone": flag(above("_q2", "_m_vix"))}],
               "vix_spike vix_low vix_fear_zone vix_calm_zone", "vix")
M["FEA-23"] = ([{"vvix_level": "_m_vvix", "_a": mean("_m_vvix", 20, 10), "_mu": mean("_m_vvix", 63, 20), "_sd": std("_m_vvix", 63, 20)},
                {"vvix_zscore": mzsc("_m_vvix", "_mu", "_sd"), "vvix_spike": flag("_m_vvix > 120"), "vvix_above_ma": flag(above("_m_vvix", "_a"))}],
               "vvix_spike vvix_above_ma", "vvix")
_r = ranks({"yield_curve_rank": ("yield_curve_10_3m", 252, 63)})
YC = [{"yield_curve_10_3m": "(_m_tnx - _m_irx) / 100", "yield_curve_5_3m": "(_m_fvx - _m_irx) / 100"}]
M["FEA-24"] = (YC + [{**_r[0], "yield_curve_inverted": flag("yield_curve_10_3m < 0"), "_mu": mean("yield_curve_10_3m", 252, 63),
                      "_sd": std("yield_curve_10_3m", 252, 63), "yield_curve_chg_20d": diff("yield_curve_10_3m", 20)},
                     {**_r[1], "yield_curve_zscore": mzsc("yield_curve_10_3m", "_mu", "_sd")}], "yield_curve_inverted", "tnx irx fvx")
_r = ranks({"vix_ts_slope_rank": ("vix_ts_slope", 63, 20)})
M["FEA-25"] = ([{"vix_ts_front_ratio": ratio("_m_vix9d", "_m_vix"), "vix_ts_back_ratio": ratio("_m_vix", "_m_vix3m"),
                 "vix_contango": flag("_m_vix9d < _m_vix"), "vix_ts_slope": ratio("_m_vix3m - _m_vix9d", "_m_vix9d")}, *_r], "vix_contango", "vix vix9d vix3m")
M["FEA-26"] = ([{"dxy_ret_5d": pct("_m_dxy", 5), "dxy_ret_21d": pct("_m_dxy", 21), "_mu": mean("_m_dxy", 63, 20), "_sd": std("_m_dxy", 63, 20)},
                {"dxy_zscore": mzsc("_m_dxy", "_mu", "_sd"), "dxy_above_ma": flag(above("_m_dxy", "_mu"))}], "dxy_above_ma", "dxy")
CS = [{"credit_spread_ratio": ratio("_m_hyg", "_m_tlt")},
      {"_cmu": mean("credit_spread_ratio", 20, 10), "_csd": std("credit_spread_ratio", 20, 10)},
      {"credit_stress": flag("credit_spread_ratio < _cmu * 0.98")}]
M["FEA-27"] = ([*CS, {"hyg_ret_5d": pct("_m_hyg", 5), "hyg_ret_21d": pct("_m_hyg", 21), "_mu": mean("_m_hyg", 20, 10), "_sd": std("_m_hyg", 20, 10),
                      "credit_spread_chg_5d": pct("credit_spread_ratio", 5), "credit_spread_zscore": mzsc("credit_spread_ratio", "_cmu", "_csd")},
                {"hyg_zscore": mzsc("_m_hyg", "_mu", "_sd"), "hyg_above_ma": flag(above("_m_hyg", "_mu"))}], "credit_stress hyg_above_ma", "hyg tlt")
QS = [{"_qs": "_m_qqq / close"}, {"_qsm": mean("_qs", 21, 10)}, {"qqq_spy_momentum": flag("_qs > _qsm")}]
M["FEA-28"] = ([*QS, {"tlt_ret_5d": pct("_m_tlt", 5), "_t": mean("_m_tlt", 20, 10), "qqq_spy_ratio_chg_5d": pct("_qs", 5), "gld_ret_21d": pct("_m_gld", 21)},
                {"tlt_above_ma": flag(above("_m_tlt", "_t"))}], "qqq_spy_momentum tlt_above_ma", "tlt qqq gld")
_r = ranks({"skew_rank": ("skew_level", 126, 30)})
M["FEA-29"] = ([{"_ok": f"count(_m_skew) {ALL} > 50"}, {"skew_level": "CASE WHEN _ok THEN _m_skew END"},
                {**_r[0], "_mu": mean("skew_level", 63, 20), "_sd": std("skew_level", 63, 20), "skew_chg_5d": diff("skew_level", 5), "_q7": quant("_m_vix", 63, 0.7, 20)},
                {**_r[1], "skew_zscore": mzsc("skew_level", "_mu", "_sd"), "skew_extreme": f"CASE WHEN _ok THEN {flag('skew_level > 140')} END",
                 "skew_vix_fear": f"CASE WHEN _ok THEN {flag('skew_level > 130 AND ' + above('_m_vix', '_q7'))} END"}], "skew_extreme skew_vix_fear", "skew vix")
M["FEA-30"] = ([{"lqd_ret_5d": pct("_m_lqd", 5), "lqd_ret_21d": pct("_m_lqd", 21), "_mu": mean("_m_lqd", 20, 10), "_sd": std("_m_lqd", 20, 10)},
                {"lqd_zscore": mzsc("_m_lqd", "_mu", "_sd"), "lqd_above_ma": flag(above("_m_lqd", "_mu"))}], "lqd_above_ma", "lqd")
M["FEA-31"] = ([{"eem_ret_21d": pct("_m_eem", 21), "_a": mean("_m_eem", 21, 10), "_b": mean("_m_eem", 63, 20), "_es": "_m_eem / close"},
                {"eem_above_ma": flag(above("_m_eem", "_a")), "eem_momentum": flag(above("_a", "_b")), "eem_spy_ret_21d": pct("_es", 21)}], "eem_above_ma eem_momentum", "eem")
M["FEA-32"] = ([{"ief_ret_21d": pct("_m_ief", 21), "_a": mean("_m_ief", 21, 10), "_t": pct("_m_tlt", 5)},
                {"ief_above_ma": flag(above("_m_ief", "_a")), "ief_vs_tlt_mom": "ief_ret_21d - _t"}], "ief_above_ma", "ief tlt")
SEC = [{f"_v_{s}": f"_m_{s} / close" for s in ("xlf", "xlk", "xlv", "iwm", "xle")},
       {f"_a_{s}": mean(f"_v_{s}", 21, 10) for s in ("xlf", "xlk", "xlv", "iwm")},
       {"xlf_spy_momentum": flag("_v_xlf > _a_xlf"), "xlk_spy_momentum": flag("_v_xlk > _a_xlk"), "xlv_spy_defensive": flag("_v_xlv > _a_xlv"),
        "iwm_spy_breadth": flag("_v_iwm > _a_iwm")}]
M["FEA-40"] = ([*SEC, {"xlf_spy_chg_21d": pct("_v_xlf", 21), "xlk_spy_chg_5d": pct("_v_xlk", 5), "iwm_spy_chg_21d": pct("_v_iwm", 21), "xle_spy_chg_21d": pct("_v_xle", 21)}],
               "xlf_spy_momentum xlk_spy_momentum xlv_spy_defensive iwm_spy_breadth", "xlf xlk xlv iwm xle")
M["FEA-41"] = ([{f"_a_{s}": mean(f"_m_{s}", 21, 10) for s in ("xlf", "xlk", "xlv", "iwm", "xle")},
                {"sector_breadth_count": " + ".join(f"({flag(above(f'_m_{s}', f'_a_{s}'))})" for s in ("xlf", "xlk", "xlv", "iwm", "xle"))},
                {"sector_breadth_pct": "sector_breadth_count / 5.0", "broad_bull_market": flag("sector_breadth_count >= 4"), "narrow_rally": flag("sector_breadth_count <= 1")}],
               "sector_breadth_count broad_bull_market narrow_rally", "xlf xlk xlv iwm xle")
_r = ranks({"market_fav_rank": ("market_fav_score", 252, 63)})
M["FEA-44"] = ([*HURST, *YC, *CS, *QS, *SEC,
                {"market_fav_score": f"({flag('_m_vix9d < _m_vix')}) + ({flag('month(ts) IN (11,12,1,2,3,4)')}) + (1 - ({flag('yield_curve_10_3m < 0')})) + hurst_trending "
                 "+ xlf_spy_momentum + qqq_spy_momentum + iwm_spy_breadth + (1 - credit_stress)"},
                {**_r[0], "market_fav_norm": "market_fav_score / 8.0"}, _r[1]], "market_fav_score",
               "vix vix9d vix3m tnx irx fvx hyg tlt qqq gld xlf xlk xlv iwm xle")
_r = ranks({"vrp_rank": ("vrp_raw", 252, 63)})
M["FEA-49"] = (VOL + [{"vrp_raw": "_m_vix / 100 - vol_21d"}, {**_r[0], "_mu": mean("vrp_raw", 63, 20), "_sd": std("vrp_raw", 63, 20),
                      "vrp_positive": flag("vrp_raw > 0"), "vrp_chg_5d": diff("vrp_raw", 5), "vrp_chg_21d": diff("vrp_raw", 21)},
                      {**_r[1], "vrp_zscore": mzsc("vrp_raw", "_mu", "_sd")}], "vrp_positive", "vix")

R21 = {"rsi_14": 63, "macd_hist": 63, "vol_21d": 63, "bb_pct": 63, "obv_trend": 63, "adx_norm": 63, "mom_12_1": 126, "mom_6_1": 126}
_r = ranks({f"{x}_rank": (x, n, max(n // 2, 10)) for x, n in R21.items()})
_obv = OBV[1:] + [{"_om": mean("_obv", 20)}, {"obv_trend": ratio("_obv - _om", "abs(_om)")}]
SQL["FEA-21"] = (RSI + MACD + VOL + [BB0, BB1] + _obv + ADX + [{"adx_norm": "adx_14 / 100"}] + MOM + list(_r), "")


# families with raw levels (five decimals would tie when rounded) or very small values
DIGITS = {"FEA-22": 8, "FEA-23": 8, "FEA-24": 8, "FEA-29": 8, "FEA-39": 8, "FEA-6": 8}


def _register():
    for fid, fam in feats.FAMILIES.items():
        cols = list(fam.columns)
        if fid in SQL:
            layers, ints = SQL[fid]
            sql = chain([BARS], "bars", layers, pick(cols, set(ints.split()), DIGITS.get(fid, 6)))
        else:
            layers, ints, names = M[fid]
            sql = chain(macro_wide(names.split()), "mbars", layers, pick(cols, set(ints.split()), DIGITS.get(fid, 6)))

        def run(spark, sf, fid=fid, cols=cols):
            uses_macro = any(f.macro for f in feats.closure([fid]))
            df = feats.generate_features(bars(spark, sf), [fid], macro(spark, sf) if uses_macro else None)
            return rounded(df.select("symbol", "ts", *cols), DIGITS.get(fid, 6))
        query(fid, sql)(run)


_register()

# Meeting days for FEA-45 come from the data: days with an order worth more than 450 thousand.
EVENTS_SQL = "ev AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 450000)"


@query("FEA-45", f"""WITH {BARS}, {EVENTS_SQL},
x AS (SELECT symbol, ts, max(CASE date_diff('day', d, CAST(ts AS DATE)) WHEN 0 THEN 3.0 WHEN 1 THEN 2.0 ELSE -1.0 END) AS p
      FROM bars JOIN ev ON date_diff('day', d, CAST(ts AS DATE)) BETWEEN -2 AND 1 GROUP BY symbol, ts)
SELECT b.symbol, b.ts, CAST(coalesce(p, 0) AS DOUBLE) AS fomc_proximity,
       CASE WHEN p = 3 THEN 1 ELSE 0 END AS fomc_day, CASE WHEN p = 2 THEN 1 ELSE 0 END AS fomc_post
FROM bars b LEFT JOIN x ON b.symbol = x.symbol AND b.ts = x.ts""")
def fomc(spark, sf):
    ev = (table(spark, sf, "orders").where("o_totalprice > 450000")
          .select(F.col("o_orderdate").cast("date").alias("event")).distinct())
    df = cal.fomc_features(bars(spark, sf), ev)
    return df.select("symbol", "ts", "fomc_proximity", "fomc_day", "fomc_post")


def _holiday_sql() -> str:
    """Holiday rules written as SQL over the years of the data."""
    def nth(m, iso, k):
        first = f"make_date(y, {m}, 1)"
        return f"{first} + CAST((({iso} - isodow({first}) + 7) % 7 + {7 * (k - 1)}) AS INTEGER)"
    may = "make_date(y, 5, 31)"
    fixed = ", ".join(f"CASE isodow(make_date(y, {m}, {d})) WHEN 6 THEN make_date(y, {m}, {d}) - 1 WHEN 7 THEN make_date(y, {m}, {d}) + 1 "
                      f"ELSE make_date(y, {m}, {d}) END" for m, d in ((1, 1), (7, 4), (11, 11), (12, 25)))
    float_ = ", ".join([nth(1, 1, 3), nth(2, 1, 3), f"{may} - CAST(isodow({may}) - 1 AS INTEGER)", nth(9, 1, 1), nth(10, 1, 2), nth(11, 4, 4)])
    return f"hol AS (SELECT unnest([{fixed}, {float_}]) AS d FROM (SELECT unnest(range(1990, 2006)) AS y))"


@query("FEA-50", f"""WITH {BARS}, {_holiday_sql()},
x AS (SELECT symbol, ts, max(5 - date_diff('day', CAST(ts AS DATE), d)) AS p
      FROM bars JOIN hol ON date_diff('day', CAST(ts AS DATE), d) BETWEEN 1 AND 4 GROUP BY symbol, ts)
SELECT b.symbol, b.ts, CAST(coalesce(p, 0) AS INTEGER) AS pre_holiday, CASE WHEN p >= 1 THEN 1 ELSE 0 END AS pre_holiday_flag
FROM bars b LEFT JOIN x ON b.symbol = x.symbol AND b.ts = x.ts""")
def pre_holiday(spark, sf):
    return cal.pre_holiday_features(bars(spark, sf)).select("symbol", "ts", "pre_holiday", "pre_holiday_flag")
