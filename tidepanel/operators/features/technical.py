"""Price, volume and volatility features of one symbol."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ...functions.trailing import Late, Trailing, correlation, deviations, kurtosis, mean, means, most, of_returns, quantile, rank, skewness, std
from ...functions.windows import Series, clip, flag, nz
from .base import family

C = F.col
EPS = 1e-9
YEAR = math.sqrt(252.0)


def ratio(a, b):
    return a / (b + EPS)


@family("FEA-1", "ret_1d ret_2d ret_3d ret_5d ret_10d ret_20d", 20)
def returns(p: Series):
    return [{f"ret_{n}d": p.pct("close", n) for n in (1, 2, 3, 5, 10, 20)}]


@family("FEA-2", "ret_skew_21d ret_kurt_21d", 22)
def shape(p):
    return [{"ret_1d": p.pct("close")},
            {"ret_skew_21d": Trailing(skewness(21), ("ret_1d",), 21), "ret_kurt_21d": Trailing(kurtosis(21), ("ret_1d",), 21)}]


SMAS = (5, 10, 20, 50, 200)


AVERAGES = {f"_sma{n}": means("close", n) for n in SMAS}


@family("FEA-3", " ".join(f"sma_{n}_dist" for n in SMAS), 200, prior=AVERAGES)
def sma_distance(p):
    return [{f"sma_{n}_dist": ratio(C("close") - C(f"_sma{n}"), C(f"_sma{n}")) for n in SMAS}]


@family("FEA-4", "cross_5_20 cross_20_50 cross_50_200 sma_20_above_50 sma_50_above_200", 200, prior=AVERAGES)
def sma_cross(p):
    out = {f"cross_{a}_{b}": ratio(C(f"_sma{a}"), C(f"_sma{b}")) - 1.0 for a, b in ((5, 20), (20, 50), (50, 200))}
    out |= {f"sma_{a}_above_{b}": flag(C(f"_sma{a}") > C(f"_sma{b}")) for a, b in ((20, 50), (50, 200))}
    return [out]


def rsi(p, n, mp=None):
    gain = p.mean(clip("_d1", lo=0.0), n, mp)
    loss = p.mean(-clip("_d1", hi=0.0), n, mp)
    return 100.0 - 100.0 / (1.0 + ratio(gain, loss))


@family("FEA-5", "rsi_14 rsi_28 rsi_norm", 29)
def rsis(p):
    return [{"_d1": p.diff("close")}, {"rsi_14": rsi(p, 14), "_gain": clip("_d1", lo=0.0), "_loss": -clip("_d1", hi=0.0)},
            {"rsi_norm": C("rsi_14") / 100.0, "_gain28": means("_gain", 28), "_loss28": means("_loss", 28),
             "rsi_28": Late(100.0 - 100.0 / (1.0 + ratio(C("_gain28"), C("_loss28"))))}]


@family("FEA-6", "macd_norm macd_hist macd_cross", 0, emas=["close:12:12", "close:26:26", "_macd:9:9"])
def macd(p):
    sig = C("_ema9__macd")
    return [{"macd_norm": C("_macd"), "macd_hist": C("_macd") - sig, "macd_cross": flag(C("_macd") > sig)}]


@family("FEA-7", "stoch_k stoch_d stoch_hist", 16, prior={"_lo14": Trailing(most(14, -1), ("low",), 14), "_hi14": Trailing(most(14), ("high",), 14)})
def stochastic(p):
    low, high = C("_lo14"), C("_hi14")
    return [{"_k": 100.0 * (C("close") - low) / nz(high - low)},
            {"_dd": p.mean("_k", 3)},
            {"stoch_k": C("_k") / 100.0, "stoch_d": C("_dd") / 100.0, "stoch_hist": (C("_k") - C("_dd")) / 100.0}]


@family("FEA-8", "roc_5d roc_10d roc_21d", 21)
def roc(p):
    return [{f"roc_{n}d": C("close") / nz(p.lag("close", n)) - 1.0 for n in (5, 10, 21)}]


@family("FEA-9", "vol_5d vol_21d vol_63d vol_ratio_5_21 vol_ratio_21_63", 64,
        prior={f"_sd{n}": Trailing(of_returns(std(n)), ("close",), n + 1) for n in (5, 21, 63)})
def volatility(p):
    return [{f"vol_{n}d": C(f"_sd{n}") * YEAR for n in (5, 21, 63)},
            {"vol_ratio_5_21": ratio(C("vol_5d"), C("vol_21d")), "vol_ratio_21_63": ratio(C("vol_21d"), C("vol_63d"))}]


def true_range(p):
    prev = p.lag("close")
    return F.greatest(C("high") - C("low"), F.abs(C("high") - prev), F.abs(C("low") - prev))


@family("FEA-10", "atr_ratio", 15)
def atr(p):
    return [{"_tr": true_range(p)}, {"_atr14": means("_tr", 14)}, {"atr_ratio": Late(ratio(C("_atr14"), C("close")))}]


@family("FEA-11", "bb_pct bb_width", 20, prior={"_sma20": AVERAGES["_sma20"], "_sd20": deviations("close", 20)})
def bollinger(p):
    up, lo = C("_sma20") + 2.0 * C("_sd20"), C("_sma20") - 2.0 * C("_sd20")
    return [{"bb_pct": ratio(C("close") - lo, up - lo), "bb_width": ratio(up - lo, C("_sma20"))}]


@family("FEA-12", "vol_zscore", 127, needs=["FEA-9"])
def vol_zscore(p):
    return [{"_vz_mu": means("vol_21d", 63), "_vz_sd": deviations("vol_21d", 63)},
            {"vol_zscore": Late(ratio(C("vol_21d") - C("_vz_mu"), C("_vz_sd")))}]


@family("FEA-13", "volume_ratio volume_zscore", 20, prior={"_vma20": means("volume", 20), "_vsd20": deviations("volume", 20)})
def volume(p):
    return [{"volume_ratio": ratio(C("volume"), C("_vma20")),
             "volume_zscore": ratio(C("volume") - C("_vma20"), C("_vsd20"))}]


def obv(p):
    return [{"_d1": p.diff("close")},
            {"_obv": F.sum(F.signum(F.coalesce(C("_d1"), F.lit(0.0))) * C("volume")).over(p.past)}]


@family("FEA-14", "obv_trend", 0)
def obv_trend(p):
    return [*obv(p), {"_obv20": p.mean("_obv", 20)},
            {"obv_trend": ratio(C("_obv") - C("_obv20"), F.abs(C("_obv20")))}]


@family("FEA-15", "adx_14 adx_norm", 28)
def adx(p):
    up, down = C("_up"), C("_down")
    pdi = 100.0 * ratio(C("_pdm14"), C("_tr14"))
    mdi = 100.0 * ratio(C("_mdm14"), C("_tr14"))
    return [{"_tr": true_range(p), "_up": p.diff("high"), "_down": -p.diff("low")},
            {"_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
             "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0)},
            {"_pdm14": p.mean("_pdm", 14), "_mdm14": p.mean("_mdm", 14), "_tr14": p.mean("_tr", 14)},
            {"_dx": 100.0 * ratio(F.abs(pdi - mdi), pdi + mdi)},
            {"adx_14": p.mean("_dx", 14)}, {"adx_norm": C("adx_14") / 100.0}]


@family("FEA-16", "higher_highs_10 higher_lows_10 trend_strength", 10)
def higher(p):
    highs, lows = (F.when(C(f"_n10_{x}") >= 10, C(f"_rises_{x}")) for x in ("high", "low"))
    return [{f"_rise_{x}": flag(C(x) > p.lag(x)).cast("double") for x in ("high", "low")} | {f"_n10_{x}": p.count(x, 10) for x in ("high", "low")},
            {f"_rises_{x}": means(f"_rise_{x}", 9, 1) for x in ("high", "low")},
            {"higher_highs_10": Late(highs), "higher_lows_10": Late(lows), "trend_strength": Late(highs - (1.0 - lows))}]


@family("FEA-17", "channel_pos_52w high_52w_dist", 252)
def channel(p):
    return [{"_hi252": Trailing(most(63), ("high",), 252), "_lo252": Trailing(most(63, -1), ("low",), 252)},
            {"channel_pos_52w": Late(ratio(C("close") - C("_lo252"), C("_hi252") - C("_lo252"))),
             "high_52w_dist": Late(ratio(C("close") - C("_hi252"), C("_hi252")))}]


@family("FEA-18", "gap intraday_ret gap_vs_intraday", 1)
def gaps(p):
    return [{"gap": C("open") / nz(p.lag("close")) - 1.0, "intraday_ret": C("close") / nz("open") - 1.0},
            {"gap_vs_intraday": C("gap") - C("intraday_ret")}]


def zero(x):
    return F.coalesce(x, F.lit(0.0))


@family("FEA-19", "mom_12_1 mom_6_1 reversal_1w reversal_1m", 252)
def momentum(p):
    return [{"_p252": p.pct("close", 252), "_p126": p.pct("close", 126), "_p21": p.pct("close", 21),
             "reversal_1w": -p.pct("close", 5), "reversal_1m": -p.pct("close", 21)},
            {"mom_12_1": zero(C("_p252") - C("_p21")), "mom_6_1": zero(C("_p126") - C("_p21"))}]


@family("FEA-20", "vol_of_vol vol_of_vol_norm vol_of_vol_zscore", 177, needs=["FEA-9"])
def vol_of_vol(p):
    return [{"vol_of_vol": p.std("vol_21d", 30)},
            {"_vov_mu": means("vol_of_vol", 126, 63), "_vov_sd": deviations("vol_of_vol", 126, 63)},
            {"vol_of_vol_norm": ratio(C("vol_of_vol"), C("vol_21d")),
             "vol_of_vol_zscore": Late(ratio(C("vol_of_vol") - C("_vov_mu"), C("_vov_sd")))}]


def ranks(spec):
    """Rank columns for {out: (source, window, min_periods)}."""
    return {o: Trailing(rank(mp), (x,), n) for o, (x, n, mp) in spec.items()}


RANKED = {"rsi_14": 63, "macd_hist": 63, "vol_21d": 63, "bb_pct": 63, "obv_trend": 63, "adx_norm": 63,
          "mom_12_1": 126, "mom_6_1": 126}


@family("FEA-21", " ".join(f"{x}_rank" for x in RANKED), 0,
        needs=["FEA-5", "FEA-6", "FEA-9", "FEA-11", "FEA-14", "FEA-15", "FEA-19"])
def rolling_ranks(p):
    return [ranks({f"{x}_rank": (x, n, max(n // 2, 10)) for x, n in RANKED.items()})]


@family("FEA-36", "gk_vol_21d gk_vs_realized_vol gk_vol_zscore", 84, needs=["FEA-9"])
def garman_klass(p):
    hl = F.ln((C("high") + EPS) / (C("low") + EPS))
    co = F.ln((C("close") + EPS) / (C("open") + EPS))
    mean = C("_gk_mean")
    return [{"_gk": 0.5 * hl * hl - (2.0 * math.log(2.0) - 1.0) * co * co},
            {"_gk_mean": p.mean("_gk", 21, 10)},
            {"gk_vol_21d": F.when(mean >= 0, F.sqrt(mean * 252.0))},
            {"_gk_mu": means("gk_vol_21d", 63, 20), "_gk_sd": deviations("gk_vol_21d", 63, 20)},
            {"gk_vs_realized_vol": ratio(C("gk_vol_21d"), C("vol_21d")),
             "gk_vol_zscore": Late(ratio(C("gk_vol_21d") - C("_gk_mu"), C("_gk_sd")))}]


def hurst_lags(n: int) -> list[int]:
    return sorted({max(2, n // k) for k in range(2, min(10, n // 4 + 1))})


def rescaled_range_slope(prices: np.ndarray) -> np.ndarray:
    """Slope of log R/S on log lag over the 63 prices before the last of each row; none where one is missing."""
    prices = prices[:, :-1]
    out, ok = np.full(len(prices), np.nan), ~np.isnan(prices).any(1)
    if ok.any():
        ret = np.diff(np.log(prices[ok] + EPS), axis=1)
        lags = hurst_lags(63)
        rs = []
        for lag in lags:
            sub = ret[:, :lag]
            dev = np.cumsum(sub - sub.mean(axis=1, keepdims=True), axis=1)
            rs.append((dev.max(axis=1) - dev.min(axis=1)) / (sub.std(axis=1) + 1e-12))
        y = np.log(np.maximum(np.stack(rs, axis=1), 1e-9))
        x = np.log(lags) - np.mean(np.log(lags))
        out[ok] = np.clip(y @ x / (x @ x), 0.0, 1.0)
    return out


@family("FEA-37", "hurst_63 hurst_trending hurst_reverting", 63, prior={"hurst_63": Trailing(rescaled_range_slope, ("close",), 64)})
def hurst(p):
    """Rescaled range over prefixes of the 63 bars before the current one."""
    return [{"hurst_trending": flag(C("hurst_63") > 0.55), "hurst_reverting": flag(C("hurst_63") < 0.45)}]


@family("FEA-38", "autocorr_1d autocorr_5d", 27)
def autocorr(p):
    """Correlation of the return with its own lag over the pairs that lie inside the 21-bar frame."""
    return [{"ret_1d": p.pct("close")}, {f"_ret_l{k}": p.lag("ret_1d", k) for k in (1, 5)},
            {f"autocorr_{k}d": Trailing(correlation(15, k, first=True), ("ret_1d", f"_ret_l{k}"), 21) for k in (1, 5)}]


@family("FEA-39", "amihud_illiq amihud_zscore", 64)
def amihud(p):
    return [{"ret_1d": p.pct("close")}, {"_ami": F.abs(C("ret_1d")) / (C("volume") + EPS)},
            {"amihud_illiq": means("_ami", 21, 10), "_ami_mu": means("_ami", 63, 20), "_ami_sd": deviations("_ami", 63, 20)},
            {"amihud_zscore": Late(ratio(C("_ami") - C("_ami_mu"), C("_ami_sd")))}]


@family("FEA-42", "mom_quality_63_21 mom_accel_21_63 mom_accel_5_20avg", 63)
def momentum_quality(p):
    r21, r63 = C("_p21"), C("_p63")
    return [{"_p63": p.pct("close", 63), "_p21": p.pct("close", 21), "ret_5d": p.pct("close", 5)},
            {"_r5m": means("ret_5d", 20, 10)},
            {"mom_quality_63_21": ratio(r21, F.abs(r63)),
             "mom_accel_21_63": ratio(r21, F.abs(r21)) * (ratio(F.abs(r21), F.abs(r63)) - 0.333),
             "mom_accel_5_20avg": Late(C("ret_5d") - C("_r5m"))}]


@family("FEA-43", "rsi_divergence_bear rsi_divergence_bull rsi_divergence", 25, needs=["FEA-5"])
def rsi_divergence(p):
    px, rs = C("_px10"), C("_rsi10")
    return [{"_px10": p.diff("close", 10), "_rsi10": p.diff("rsi_14", 10)},
            {"rsi_divergence_bear": flag((px > 0) & (rs < -3)), "rsi_divergence_bull": flag((px < 0) & (rs > 3))},
            {"rsi_divergence": C("rsi_divergence_bull") - C("rsi_divergence_bear")}]


@family("FEA-46", "downvol_21d asymmetric_vol vol_asymmetry_z", 84)
def asymmetric_vol(p):
    return [{"ret_1d": p.pct("close")},
            {"downvol_21d": p.std(clip("ret_1d", hi=0.0), 21, 10) * YEAR,
             "_upvol": p.std(clip("ret_1d", lo=0.0), 21, 10) * YEAR},
            {"asymmetric_vol": ratio(C("downvol_21d"), C("_upvol"))},
            {"_av_mu": means("asymmetric_vol", 63, 20), "_av_sd": deviations("asymmetric_vol", 63, 20)},
            {"vol_asymmetry_z": Late(ratio(C("asymmetric_vol") - C("_av_mu"), C("_av_sd")))}]


@family("FEA-47", "adx_chg_5d adx_chg_10d adx_trending adx_strength", 38, needs=["FEA-15"])
def adx_change(p):
    return [{"adx_chg_5d": p.diff("adx_14", 5), "adx_chg_10d": p.diff("adx_14", 10)},
            {"adx_trending": flag((C("adx_14") > 25) & (C("adx_chg_5d") > 0)),
             "adx_strength": C("adx_14") * C("adx_chg_5d") / (100.0 + EPS)}]


@family("FEA-48", "mom_12_0 mom_1m mom_3m", 252)
def momentum_plain(p):
    return [{"mom_12_0": zero(p.pct("close", 252)), "mom_1m": zero(p.pct("close", 21)), "mom_3m": zero(p.pct("close", 63))}]


@family("FEA-51", "price_vol_corr_10d price_vol_corr_21d", 22)
def price_volume_corr(p):
    return [{"ret_1d": p.pct("close"), "ret_5d": p.pct("close", 5)},
            {"price_vol_corr_10d": Trailing(correlation(5), ("ret_5d", "volume"), 10),
             "price_vol_corr_21d": Trailing(correlation(10), ("ret_1d", "volume"), 21)}]


@family("FEA-52", "distribution_signal accumulation_signal obv_momentum", 0,
        prior={"_hi10": Trailing(most(5), ("close",), 10), "_lo10": Trailing(most(5, -1), ("close",), 10)})
def accumulation(p):
    o = obv(p)
    return [o[0], {**o[1], "_vavg20": p.mean("volume", 20, 10)},
            {"_obv5": p.mean("_obv", 5, 3), "_obv20m": p.mean("_obv", 20, 10)},
            {"distribution_signal": flag((C("close") == C("_hi10")) & (C("volume") < C("_vavg20"))),
             "accumulation_signal": flag((C("close") == C("_lo10")) & (C("volume") < C("_vavg20"))),
             "obv_momentum": ratio(C("_obv5"), F.abs(C("_obv20m"))) - 1.0}]


@family("FEA-53", "overnight_vs_intraday overnight_lead", 22, needs=["FEA-18"])
def overnight(p):
    on, intra = C("_on21"), C("_in21")
    return [{"_gap0": zero(C("gap")), "_in0": zero(C("intraday_ret"))}, {"_on21": means("_gap0", 21, 10), "_in21": means("_in0", 21, 10)},
            {"overnight_vs_intraday": Late(on - intra), "overnight_lead": Late(flag(on > intra))}]


@family("FEA-54", "dist_from_52w_high near_52w_high at_52w_high", 252)
def year_high(p):
    dist = ratio(C("close") - C("_chi252"), C("_chi252"))
    return [{"_chi252": Trailing(most(63), ("close",), 252)},
            {"dist_from_52w_high": Late(dist), "near_52w_high": Late(flag(dist > -0.02)), "at_52w_high": Late(flag(dist > -0.005))}]


@family("FEA-55", "rvol rvol_rank rvol_up rvol_down rvol_confirm", 82)
def relative_volume(p):
    return [{"_vavg20": p.mean("volume", 20, 10), "ret_1d": p.pct("close")},
            {"rvol": ratio(C("volume"), C("_vavg20"))},
            {"rvol_up": C("rvol") * flag(C("ret_1d") > 0), "rvol_down": C("rvol") * flag(C("ret_1d") < 0),
             "rvol_confirm": flag((C("rvol") > 1.5) & (C("ret_1d") > 0))}, ranks({"rvol_rank": ("rvol", 63, 20)})]


@family("FEA-56", "bb_squeeze bb_expansion bb_width_rank", 145, needs=["FEA-11"])
def squeeze(p):
    q = {f"_bbw_q{n}": Trailing(quantile(n / 100, 20), ("bb_width",), 63) for n in (20, 80)}
    return [{**ranks({"bb_width_rank": ("bb_width", 126, 40)}), **q},
            {"bb_squeeze": Late(flag(C("bb_width") < C("_bbw_q20"))),
             "bb_expansion": Late(flag(C("bb_width") > C("_bbw_q80")))}]


@family("FEA-58", "ret_consistency_10d ret_consistency_21d trend_quality_10_21 strong_uptrend choppy_market", 22)
def consistency(p):
    c21 = C("ret_consistency_21d")
    return [{"ret_1d": p.pct("close")}, {"_pos": flag(C("ret_1d") > 0).cast("double")},
            {"ret_consistency_10d": p.mean("_pos", 10, 5), "ret_consistency_21d": p.mean("_pos", 21, 10)},
            {"trend_quality_10_21": C("ret_consistency_10d") - c21, "strong_uptrend": flag(c21 > 0.65),
             "choppy_market": flag((c21 > 0.40) & (c21 < 0.60))}]


def streak(p, cond, name):
    """Length of the current run of ``cond``: distance to the last row where it was false."""
    return [{f"_f_{name}": flag(cond), f"_n_{name}": F.row_number().over(p.w)},
            {f"_z_{name}": F.coalesce(F.max(F.when(C(f"_f_{name}") == 0, C(f"_n_{name}"))).over(p.past), F.lit(0))},
            {name: C(f"_n_{name}") - C(f"_z_{name}")}]


@family("FEA-59", "up_streak down_streak", 0)
def streaks(p):
    up, dn = streak(p, C("ret_1d") > 0, "up_streak"), streak(p, C("ret_1d") < 0, "down_streak")
    return [{"ret_1d": p.pct("close")}] + [u | d for u, d in zip(up, dn)]


@family("FEA-60", "extreme_down extreme_up rev_signal_5d", 69,
        prior={"_r63m": Trailing(of_returns(mean(20)), ("close",), 64), "_r63s": Trailing(of_returns(std(20)), ("close",), 64)})
def extremes(p):
    z = ratio(C("ret_1d") - C("_r63m"), C("_r63s"))
    return [{"ret_1d": p.pct("close")},
            {"extreme_down": flag(z < -2.5), "extreme_up": flag(z > 2.5)},
            {f"_prev_{s}": F.coalesce(p.lag(f"extreme_{s}"), F.lit(0)) for s in ("down", "up")},
            {"rev_signal_5d": F.max("_prev_down").over(p.last(5)) - F.max("_prev_up").over(p.last(5))}]
