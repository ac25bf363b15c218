"""WIN-*, LBL-*, REG-*, STF-*, FN-*, UDF-*: window primitives, labels, regimes, state machines, scalar functions."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import normal, scale
from ..functions import trailing as tr
from ..functions.windows import Series, clip, ewm, flag, nz, pct_rank, quantile_of
from ..operators import backtest as bk, features as feats, fractional as fr, labels as lb, ranking as rk, regime as rg, sequential as sq
from ..sources.tables import bars, events, table
from .common import signals, stock_run
from .performance import BT, FEAT, PROBA, THRESH, feature_frame, scored, with_regime
from .registry import query, rounded
from .sql import (ALL, BARS, PAST, SER, SIG, STOCK, WHOLE, bt, chain, corr, diff, ewm as sewm, flag as sflag, hi, lag, last, lo, mean, pct, pick, quant, rank, rank_of, roll, stack, std, with_)

C = F.col
KEYS = ("symbol", "ts")


def win(key, layers, cols, build, ints=(), digits=6):
    """One primitive over the bar panel: SQL layers against a function of (bars, Series)."""
    @query(key, chain([BARS], "bars", layers, pick(cols, set(ints), digits)))
    def run(spark, sf):
        return rounded(build(bars(spark, sf), Series()).select(*KEYS, *cols), digits)


win("WIN-1", [{"m": mean("close", 21), "s": roll("sum", "volume", 21, 5), "lo": lo("low", 21, 10), "hi": hi("high", 21, 10), "sd": std("close", 21)}], ["m", "s", "lo", "hi", "sd"],
    lambda b, p: b.withColumns({"m": p.mean("close", 21), "s": p.sum("volume", 21, 5), "lo": p.min("low", 21, 10), "hi": p.max("high", 21, 10), "sd": p.std("close", 21)}), digits=7)
win("WIN-2", [{"r": pct("close")}, {"sk": roll("skewness", "r", 63, 21), "ku": roll("kurtosis", "r", 63, 21)}], ["sk", "ku"],
    lambda b, p: tr.trailing(b.select(*KEYS, p.pct("close").alias("r")), {"sk": tr.Trailing(tr.skewness(21), ("r",), 63), "ku": tr.Trailing(tr.kurtosis(21), ("r",), 63)}, p))
win("WIN-3", [{"q10": quant("close", 63, 0.1, 20), "q50": quant("close", 63, 0.5, 20), "q90": quant("close", 63, 0.9, 20)}], ["q10", "q50", "q90"],
    lambda b, p: b.withColumn("_a", p.sorted_frame("close", 63)).withColumns({f"q{int(q * 100)}": quantile_of("_a", q, 20) for q in (0.1, 0.5, 0.9)}), digits=9)
win("WIN-4", [{"_l": rank("close", 126, 0)[0]}, {"r": rank_of("_l", "close", 63)}], ["r"],
    lambda b, p: b.withColumn("_a", p.sorted_frame("close", 126)).withColumn("r", pct_rank("_a", "close", 63)))
win("WIN-5", [{"r": pct("close")}, {"c": corr("r", "volume", 63, 21)}], ["c"], lambda b, p: b.withColumn("r", p.pct("close")).withColumn("c", p.corr("r", "volume", 63, 21)))
win("WIN-6", [{"a": lag("close", 3), "b": f"lead(close, 2) {SER}", "c": diff("close", 5), "d": pct("close", 5)}], ["a", "b", "c", "d"],
    lambda b, p: b.withColumns({"a": p.lag("close", 3), "b": p.lead("close", 2), "c": p.diff("close", 5), "d": p.pct("close", 5)}), digits=10)
win("WIN-7", [{"s": f"sum(volume) {PAST}", "g": f"max(close) {PAST}"}], ["s", "g"],
    lambda b, p: scale.prefix_sum(b, ["symbol"], "volume", "s").withColumn("g", F.max("close").over(p.past)), digits=10)
win("WIN-8", [{"l": f"list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"}, {"n": "coalesce(CAST(len(l) AS INTEGER), 0)", "mx": "list_max(l)", "fin": "l[-1]"}], ["n", "mx", "fin"],
    lambda b, p: b.withColumn("l", F.collect_list("close").over(p.w.rowsBetween(1, 5))).withColumns(
        {"n": F.size("l"), "mx": F.array_max("l"), "fin": F.get("l", F.size("l") - 1)}), ints=["n"], digits=10)
win("WIN-9", [{"e12": sewm("close", 12, 1), "e26": sewm("close", 26, 26), "e63": sewm("close", 63, 63)}], ["e12", "e26", "e63"],
    lambda b, p: ewm(ewm(ewm(b, "close", 12, "e12", p, 1), "close", 26, "e26", p, 26), "close", 63, "e63", p, 63), digits=7)
win("WIN-10", [{"u": f"CASE WHEN close > {lag('close')} THEN 1.0 ELSE 0.0 END"}, {"f": f"CASE WHEN count(close) {last(20)} >= 20 THEN sum(u) {last(19)} / 19.0 END"}], ["f"],
    lambda b, p: b.withColumn("u", flag(C("close") > p.lag("close")).cast("double")).withColumn("f", F.when(F.count("close").over(p.last(20)) >= 20, F.avg("u").over(p.last(19)))))
win("WIN-13", [{"x": f"row_number() {SER} - 1", "y": f"close / first_value(close) {WHOLE}"}, {"r2": f"CASE WHEN count(y) {last(63)} >= 63 THEN regr_r2(y, x) {last(63)} END"}], ["r2"],
    lambda b, p: b.withColumns({"x": p.row().cast("double"), "y": C("close") / F.first("close").over(p.past)}).withColumn("r2", F.when(F.count("y").over(p.last(63)) >= 63, F.regr_r2("y", "x").over(p.last(63)))))
win("WIN-14", [{"r": pct("close")}, {"d": "CASE WHEN r IS NOT NULL THEN least(r, 0) END", "u": "CASE WHEN r IS NOT NULL THEN greatest(r, 0) END"}, {"dn": std("d", 21, 10), "up": std("u", 21, 10)}], ["dn", "up"],
    lambda b, p: b.withColumn("r", p.pct("close")).withColumns({"dn": p.std(clip("r", hi=0.0), 21, 10), "up": p.std(clip("r", lo=0.0), 21, 10)}), digits=9)
win("WIN-15", [{"m": quant("close", 64, 0.5, 1)}], ["m"], lambda b, p: b.withColumn("_a", p.sorted_frame("close", 64)).withColumn("m", quantile_of("_a", 0.5, 1)), digits=9)


def fd_sql(x, d, thr):
    """Fractional difference: the trailing list times the literal weights."""
    w = [float(v) for v in fr.frac_weights(d, thr)]
    return f"CASE WHEN count({x}) {last(len(w))} = {len(w)} THEN list_dot_product(list({x}) {last(len(w))}, {w}::DOUBLE[]) END"


win("WIN-16", [{"f": fd_sql("close", 0.4, 1e-3)}], ["f"], lambda b, p: b.withColumn("f", fr.fracdiff("close", 0.4, 1e-3, p)))


@query("WIN-11", with_(SIG + stack("sig", [{"c": f"CASE WHEN signal IS DISTINCT FROM {lag('signal')} THEN 1 ELSE 0 END"}, {"isl": f"sum(c) {PAST}"}], "x"),
                       "SELECT symbol, ts, signal, CAST(row_number() OVER (PARTITION BY symbol, isl ORDER BY ts) AS INTEGER) AS run FROM x"))
def win11(spark, sf):
    p = Series()
    d = signals(spark, sf).withColumn("_n", F.row_number().over(p.w))
    d = d.withColumn("_c", F.when(p.lag("signal").isNull() | (C("signal") != p.lag("signal")), C("_n")))
    return d.withColumn("run", (C("_n") - F.max("_c").over(p.past) + 1).cast("int")).select(*KEYS, "signal", "run")


MOMR = [BARS, *stack("bars", [{"mom": f"CASE WHEN lag(close, 126) {SER} IS NOT NULL THEN close / lag(close, 126) {SER} - 1 END"}], "mm")]
XR = """SELECT symbol, ts, round(CASE WHEN mom IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY mom NULLS LAST) + (count(*) OVER (PARTITION BY ts, mom) - 1) / 2.0) / count(mom) OVER (PARTITION BY ts) END, 8) AS r FROM mm"""


def momentum_frame(spark, sf):
    p = Series()
    return bars(spark, sf).withColumn("mom", p.pct("close", 126))


@query("WIN-12", with_(MOMR, XR))
def win12(spark, sf):
    return rounded(rk.cross_rank(momentum_frame(spark, sf), "mom", "r").select(*KEYS, "r"), 8)


@query("WIN-12b", with_(MOMR, XR))
def win12b(spark, sf):
    """The same rank with each date split over several tasks."""
    return rounded(rk.cross_rank(momentum_frame(spark, sf), "mom", "r", parts=4).select(*KEYS, "r"), 8)


@query("WIN-17", with_(SIG, f"SELECT symbol, ts, CASE WHEN count(signal) {last(3)} = 3 AND min(signal) {last(3)} = max(signal) {last(3)} THEN signal ELSE 0 END AS confirmed FROM sig"))
def win17(spark, sf):
    return signals(spark, sf).withColumn("confirmed", sq.confirmed("signal", 3)).select(*KEYS, "confirmed")


@query("WIN-1b", chain([BARS], "bars", [{"r": pct("close")}, {"v": f"({std('r', 21)}) * sqrt(252.0)"}, {"_mu": mean("v", 63), "_sd": std("v", 63)}, {"vol_zscore": "(v - _mu) / (_sd + 1e-9)"}], pick(["vol_zscore"])))
def win1b(spark, sf):
    """Nested windows over overlapping chunks of 400 bars: the plan used for very long series."""
    return rounded(feats.generate_features(bars(spark, sf), ["FEA-12"], chunk_rows=400).select(*KEYS, "vol_zscore"))


# labels ----------------------------------------------------------------------------------------
NXT = "list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


def barrier_sql(pt="1.5", sl="1.0", out="tb"):
    return [{f"{out}_r": pct("close"), f"{out}_n": NXT}, {f"{out}_v": std(f"{out}_r", 21, 5)}, {f"{out}_up": f"close * (1 + ({pt}) * {out}_v)", f"{out}_lo": f"close * (1 - ({sl}) * {out}_v)"},
            {f"{out}_hit": f"list_filter({out}_n, lambda v: v >= {out}_up OR v <= {out}_lo)[1]", f"{out}_ok": f"len({out}_n) = 5 AND {out}_v > 0"},
            {f"{out}_label": f"CASE WHEN {out}_ok AND {out}_hit >= {out}_up THEN 1 WHEN {out}_ok AND {out}_hit <= {out}_lo THEN -1 ELSE 0 END",
             f"{out}_ret": f"CASE WHEN {out}_ok THEN coalesce({out}_hit, {out}_n[-1]) / close - 1 ELSE 0 END"}]


@query("LBL-1", chain([BARS], "bars", barrier_sql(), pick(["tb_label", "tb_ret"], {"tb_label"}, 9)))
def lbl1(spark, sf):
    return rounded(lb.triple_barrier(bars(spark, sf)).select(*KEYS, "tb_label", "tb_ret"), 9)


def ql(x, n):
    return {"quantile_label": f"CASE WHEN {x} > qu THEN 1 ELSE 0 END - CASE WHEN {x} < ql THEN 1 ELSE 0 END"}


@query("LBL-2", chain([BARS], "bars", [{"r": pct("close", 5)}, {"qu": quant("r", 63, 0.7, 10), "ql": quant("r", 63, 0.3, 10)}, ql("r", 63)], pick(["quantile_label"], {"quantile_label"})))
def lbl2(spark, sf):
    d = bars(spark, sf).withColumn("r", Series().pct("close", 5))
    return lb.quantile_label(d, "r", "quantile_label").select(*KEYS, "quantile_label")


@query("FEA-64", chain([BARS], "bars", [{"r": pct("close", 5)}, {"qu": quant("r", 126, 0.7, 10), "ql": quant("r", 126, 0.3, 10)}, ql("r", 126), {"past_ret_quantile": "quantile_label"}], pick(["past_ret_quantile"], {"past_ret_quantile"})))
def fea64(spark, sf):
    d = bars(spark, sf).withColumn("r", Series().pct("close", 5))
    return lb.quantile_label(d, "r", "past_ret_quantile", window=126).select(*KEYS, "past_ret_quantile")


HZ = [f"label_h{h}" for h in (1, 5, 10, 21)]
win("LBL-3", [{f"label_h{h}": sflag(f"lead(close, {h}) {SER} / close - 1 > 0") for h in (1, 5, 10, 21)}], HZ, lambda b, p: lb.multi_horizon(b), ints=HZ)
win("LBL-4", [{"r": f"lead(close, 1) {SER} / close - 1"}, {"asym_label": "CASE WHEN r >= 0.005 THEN 1 WHEN r <= -0.003 THEN -1 ELSE 0 END"}], ["asym_label"],
    lambda b, p: b.withColumn("r", lb.fwd_return(p, 1)).withColumn("asym_label", lb.asymmetric("r")), ints=["asym_label"])

DC = [BARS, "o AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)",
      """w AS (SELECT symbol, ts, rn, close AS ref, 0 AS mode, 0 AS lab FROM o WHERE rn = 1 UNION ALL
  SELECT o.symbol, o.ts, o.rn, CASE WHEN (mode = 0 AND close >= ref * 1.015) OR (mode = 1 AND close <= ref * 0.985) THEN close ELSE ref END,
   CASE WHEN mode = 0 AND close >= ref * 1.015 THEN 1 WHEN mode = 1 AND close <= ref * 0.985 THEN 0 ELSE mode END,
   CASE WHEN mode = 0 AND close >= ref * 1.015 THEN 1 WHEN mode = 1 AND close <= ref * 0.985 THEN -1 ELSE 0 END
  FROM w JOIN o ON o.symbol = w.symbol AND o.rn = w.rn + 1)"""]


@query("LBL-5", "WITH RECURSIVE " + ",\n".join(DC) + " SELECT symbol, ts, lab AS dc_label FROM w")
def lbl5(spark, sf):
    return lb.directional_change(bars(spark, sf)).select(*KEYS, "dc_label")


@query("LBL-6", chain(SIG, "sig", [*barrier_sql(), {"meta_label": sflag("(signal > 0 AND tb_label = 1) OR (signal < 0 AND tb_label = -1)")}], pick(["meta_label"], {"meta_label"})))
def lbl6(spark, sf):
    d = lb.triple_barrier(signals(spark, sf))
    return d.withColumn("meta_label", lb.meta_label("signal", "tb_label")).select(*KEYS, "meta_label")


win("LBL-7", [{"fwd_return": f"lead(close, 5) {SER} / close - 1"}, {"label": "CASE WHEN fwd_return IS NOT NULL THEN CASE WHEN fwd_return > 0 THEN 1.0 ELSE 0.0 END END"}], ["fwd_return", "label"],
    lambda b, p: lb.forward_label(b).withColumn("label", C("label").cast("double")), digits=9)


def by_reg(a, b, c, d):
    return f"CASE regime WHEN 2 THEN {a} WHEN 1 THEN {b} WHEN 0 THEN {c} ELSE {d} END"


L8 = [*THRESH, {"_n": "count(*) OVER (PARTITION BY symbol, regime)"}, *barrier_sql(by_reg(2.0, 1.5, 1.2, 1.5), by_reg(0.8, 1.0, 0.8, 1.0), "a"), *barrier_sql(out="b"),
      {"tb_label": "CASE WHEN _n >= 20 AND regime <= 2 AND a_label <> 0 THEN a_label ELSE b_label END", "tb_ret": "CASE WHEN _n >= 20 AND regime <= 2 AND a_label <> 0 THEN a_ret ELSE b_ret END"}]


@query("LBL-8", chain([BARS], "bars", L8, pick(["regime", "tb_label", "tb_ret"], {"regime", "tb_label"}, 9)))
def lbl8(spark, sf):
    d = with_regime(bars(spark, sf))
    return rounded(lb.regime_barriers(d, "regime").select(*KEYS, "regime", "tb_label", "tb_ret"), 9)


@query("LBL-9", chain([BARS], "bars", [{"r": f"lead(close, 5) {SER} / close - 1"}, {"qu": quant("r", 126, 0.7, 10), "ql": quant("r", 126, 0.3, 10)}, ql("r", 126), {"quantile_signal": "quantile_label"}], pick(["quantile_signal"], {"quantile_signal"})))
def lbl9(spark, sf):
    d = lb.forward_label(bars(spark, sf))
    return lb.quantile_label(d, "fwd_return", "quantile_signal", window=126).select(*KEYS, "quantile_signal")


# regimes ---------------------------------------------------------------------------------------
R1 = ["regime", "regime_bull", "regime_bear", "regime_hv", "trail_ret_63"]


@query("REG-1", chain([BARS], "bars", THRESH, pick(R1, set(R1[:4]), 9)))
def reg1(spark, sf):
    return rounded(with_regime(bars(spark, sf)).select(*KEYS, *R1), 9)


from .features import ADX  # noqa: E402  (SQL layers of the trend strength)

R2 = [*ADX, {"_r1": pct("close"), "_ma": mean("close", 50)}, {"_ml": lag("_ma", 5), "hist_vol_20d": f"({std('_r1', 20)}) * sqrt(252.0)"}, {"ma50_slope": "(_ma - _ml) / (abs(_ml) + 1e-9)"},
      {"regime": "CASE WHEN ma50_slope > 0.002 AND hist_vol_20d <= 0.9 AND adx_14 >= 20 THEN 'bull' WHEN ma50_slope < -0.002 AND hist_vol_20d >= 0.5 AND adx_14 >= 20 THEN 'bear' ELSE 'sideways' END"}]


def detected(spark, sf):
    return rg.detect_regime(bars(spark, sf), low_vol=0.9, high_vol=0.5)


@query("REG-2", chain([BARS], "bars", R2, "SELECT symbol, ts, round(ma50_slope, 8) + 0.0 AS ma50_slope, round(hist_vol_20d, 8) AS hist_vol_20d, round(adx_14, 6) AS adx_14, regime FROM {last}"))
def reg2(spark, sf):
    d = detected(spark, sf)
    return d.select(*KEYS, (F.round("ma50_slope", 8) + 0.0).alias("ma50_slope"), F.round("hist_vol_20d", 8).alias("hist_vol_20d"), F.round("adx_14", 6).alias("adx_14"), "regime")


@query("REG-3", chain([BARS], "bars", [*R2, {"conf": "CASE WHEN adx_14 IS NULL THEN 0.5 ELSE least(0.4 + adx_14 / 50, 1.0) END"},
                                      {"adjusted": "CASE WHEN conf < 0.6 THEN 0 ELSE least(greatest(1.0 * CASE regime WHEN 'bull' THEN 1.15 WHEN 'bear' THEN 0.65 ELSE 0.80 END * conf, -1), 1) END"}], pick(["adjusted"])))
def reg3(spark, sf):
    d = detected(spark, sf).withColumn("conf", F.when(C("adx_14").isNull(), 0.5).otherwise(F.least(0.4 + C("adx_14") / 50.0, F.lit(1.0))))
    return rounded(d.withColumn("adjusted", rg.adjust_signal(F.lit(1.0), "regime", "conf")).select(*KEYS, "adjusted"))


CUS = [BARS, f"o AS (SELECT symbol, ts, coalesce({pct('close')}, 0) AS r, row_number() {SER} AS rn FROM bars)",
       "z AS (SELECT symbol, ts, rn, (r - avg(r) OVER (PARTITION BY symbol)) / greatest(stddev_pop(r) OVER (PARTITION BY symbol), 1e-9) AS z FROM o)",
       """w AS (SELECT symbol, ts, rn, 0.0::DOUBLE AS h, 0.0::DOUBLE AS l, 0 AS a FROM z WHERE rn = 1 UNION ALL
  SELECT symbol, ts, rn, CASE WHEN h1 > 4 OR l1 > 4 THEN 0 ELSE h1 END, CASE WHEN h1 > 4 OR l1 > 4 THEN 0 ELSE l1 END, CASE WHEN h1 > 4 OR l1 > 4 THEN 1 ELSE 0 END
  FROM (SELECT z.symbol, z.ts, z.rn, greatest(0, h + z.z) AS h1, greatest(0, l - z.z) AS l1 FROM w JOIN z ON z.symbol = w.symbol AND z.rn = w.rn + 1))"""]


@query("REG-5", "WITH RECURSIVE " + ",\n".join(CUS) + " SELECT symbol, ts, a AS cp_cusum FROM w")
def reg5(spark, sf):
    return rg.cusum(bars(spark, sf))


@query("REG-6")
def reg6(spark, sf):
    """Segments of the returns with a light penalty, so that the walk of the given prices has some."""
    return rg.segments(bars(spark, sf), penalty=6.0)


@query("REG-7", with_([BARS], "SELECT symbol, ts, 0.02::DOUBLE AS cp_prob FROM bars"))
def reg7(spark, sf):
    return rg.fresh_run_prob(bars(spark, sf))


@query("FEA-62")
def fea62(spark, sf):
    return rg.change_point_features(bars(spark, sf)).select(*KEYS, "cp_segment", "cp_cusum", "cp_prob")


def tf(n):
    return f"CASE WHEN e{max(n // 3, 2)} - e{n} > 1e-12 * abs(e{n}) AND dr >= 0 THEN 1 WHEN NOT (e{max(n // 3, 2)} - e{n} > 1e-12 * abs(e{n})) AND dr <= 0 THEN -1 ELSE 0 END"


MTF = [{"_d1": diff("close"), **{f"e{s}": sewm("close", s, 1) for s in (2, 5, 7, 21, 63)}},
       {"g": "CASE WHEN _d1 IS NOT NULL THEN greatest(_d1, 0) END", "s": "CASE WHEN _d1 IS NOT NULL THEN -least(_d1, 0) END"}, {"mg": mean("g", 14, 5), "ms": mean("s", 14, 5)},
       {"rs": "100 - 100 / (1 + mg / (ms + 1e-9))"}, {"dr": "CASE WHEN rs > 55 THEN 1 WHEN rs < 45 THEN -1 ELSE 0 END"}, {f"mtf_{n}": tf(n) for n in (5, 21, 63)},
       {"up": "CAST(mtf_5 > 0 AS INT) + CAST(mtf_21 > 0 AS INT) + CAST(mtf_63 > 0 AS INT)", "nn": "abs(mtf_5) + abs(mtf_21) + abs(mtf_63)"},
       {"mtf_agree": "CASE WHEN nn = 0 THEN 0 WHEN up >= nn / 2.0 THEN up / nn ELSE (nn - up) / nn END"}, {"mtf_confirmed": sflag("mtf_agree >= 0.67")}]
MC = ["mtf_5", "mtf_21", "mtf_63", "mtf_agree", "mtf_confirmed"]


@query("REG-8", chain([BARS], "bars", MTF, pick(MC, {"mtf_5", "mtf_21", "mtf_63", "mtf_confirmed"})))
@query("FEA-63", chain([BARS], "bars", MTF, pick(MC, {"mtf_5", "mtf_21", "mtf_63", "mtf_confirmed"})))
def reg8(spark, sf):
    return rounded(rg.multi_timeframe(bars(spark, sf)).select(*KEYS, *MC))


@query("REG-8b", chain([BARS], "bars", MTF, """SELECT symbol, ts, mtf_5, mtf_21, mtf_63, round(CASE WHEN nn = 0 THEN 0 ELSE up / nn END, 3) AS agreement, CASE WHEN nn = 0 THEN 0 ELSE up / nn END >= 0.67 AS confirmed,
 CASE WHEN nn > 0 AND up / nn >= 0.67 THEN 1 ELSE 0 END AS confirmed_signal FROM {last} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"""))
def reg8b(spark, sf):
    return rg.confirm(rg.multi_timeframe(bars(spark, sf)), 1)


OH = ["open", "high", "low", "close"]
win("REG-9", [{f"{c}_fd": fd_sql(c, 0.5, 1e-4) for c in OH}], [f"{c}_fd" for c in OH], lambda b, p: fr.fracdiff_columns(b, 0.5, threshold=1e-4))
win("FEA-65", [{"close_fd": fd_sql("close", 0.4, 1e-3)}], ["close_fd"], lambda b, p: fr.fracdiff_columns(b, 0.4, ("close",), 1e-3))

# the weights of order d by the gamma function, newest first, and the differences of a whole series
_FDW = "CASE WHEN d = 0 THEN [1.0] WHEN d = 1 THEN [1.0, -1.0] ELSE list_concat([1.0], list_filter(list_transform(range(1, 1200), lambda k: -d * exp(lgamma(k - d) - lgamma(1 - d) - lgamma(k + 1))), lambda w: w <= -1e-4)) END"
_FDY = "list_transform(range(len(w), len(v) + 1), lambda t: list_dot_product(v[t - len(w) + 1:t], list_reverse(w)))"


# prices per bar are stationary noise; their running sum about the mean is a walk, whose order has to be sought
WALK = [BARS, f"mn AS (SELECT *, avg(close) {ALL} AS mu FROM bars)", f"wk AS (SELECT symbol, ts, sum(close - mu) {PAST} AS walk FROM mn)"]


def walk(spark, sf):
    p = Series()
    return bars(spark, sf).withColumn("walk", C("close") - F.avg("close").over(p.whole)).withColumn("walk", F.sum("walk").over(p.past))


def bisected(x: str, source: str, low: float, high: float, tolerance: float) -> list[str]:
    """One common table a step: order to try, its differences, the regression by symbol, the new bracket. The last is named ``orders``."""
    steps = math.ceil(math.log2((high - low) / tolerance))
    out = [f"sv AS (SELECT symbol, list({x} ORDER BY ts)::DOUBLE[] AS v FROM {source} WHERE {x} IS NOT NULL GROUP BY symbol)", f"st0 AS (SELECT symbol, {low}::DOUBLE AS lo, {high}::DOUBLE AS hi, NULL::DOUBLE AS found FROM sv)"]
    for k in range(steps + 2):
        at = ("lo", "hi")[k] if k < 2 else "(lo + hi) / 2"
        new = {0: "lo, hi, CASE WHEN ok THEN lo END AS found", 1: "lo, hi, coalesce(found, CASE WHEN NOT ok THEN hi END) AS found"}.get(k, "CASE WHEN found IS NULL AND NOT ok THEN d ELSE lo END AS lo, CASE WHEN found IS NULL AND ok THEN d ELSE hi END AS hi, found")
        out += [f"dd{k} AS (SELECT *, {_FDW} AS w FROM (SELECT symbol, v, {at} AS d FROM st{k} JOIN sv USING (symbol)))",
                f"yy{k} AS (SELECT symbol, unnest({_FDY}) AS y, unnest(range(len(w), len(v) + 1)) AS t FROM dd{k})",
                f"l1{k} AS (SELECT symbol, t, y - lag(y) OVER w AS dy, lag(y) OVER w AS y1 FROM yy{k} WINDOW w AS (PARTITION BY symbol ORDER BY t))",
                f"l2{k} AS (SELECT *, lag(dy) OVER (PARTITION BY symbol ORDER BY t) AS dy1 FROM l1{k})",
                f"""sm{k} AS (SELECT symbol, count(*) AS n, regr_sxx(dy, y1) AS s11, regr_syy(dy1, y1) AS s22, regr_sxy(dy1, y1) AS s12, regr_sxy(dy, y1) AS s1y, regr_sxy(dy, dy1) AS s2y, regr_syy(dy, y1) AS syy
                 FROM l2{k} WHERE dy1 IS NOT NULL GROUP BY symbol)""",
                f"ts{k} AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS c1 FROM sm{k} WHERE n >= 18)",
                f"st{k + 1} AS MATERIALIZED (SELECT symbol, {new} FROM (SELECT st{k}.*, {at} AS d, coalesce(b1 / sqrt((syy - b1 * s1y - c1 * s2y) / (n - 3) * s22 / (s11 * s22 - s12 * s12)) < -2.86, false) AS ok FROM st{k} LEFT JOIN ts{k} USING (symbol)))"]
    return [*out, f"orders AS (SELECT symbol, round(coalesce(found, hi), 3) AS optimal_d FROM st{steps + 2})"]


@query("REG-10", with_([*WALK, *bisected("walk", "wk", 0.0, 1.0, 0.01)], "SELECT symbol, optimal_d FROM orders"))
def reg10(spark, sf):
    return fr.least_orders(walk(spark, sf), "walk")


@query("REG-10b", with_([BARS, *bisected("close", "bars", 0.0, 1.0, 0.01)], "SELECT symbol, optimal_d FROM orders"))
def reg10b(spark, sf):
    return fr.least_orders(bars(spark, sf))


@query("REG-9b", with_([*WALK, *bisected("walk", "wk", 0.1, 1.0, 0.01), f"dw AS (SELECT *, {_FDW} AS w FROM (SELECT symbol, optimal_d AS d, v FROM orders JOIN sv USING (symbol)))", f"fd AS (SELECT symbol, unnest({_FDY}) AS y, unnest(range(len(w), len(v) + 1)) AS t FROM dw)"],
                       "SELECT symbol, ts, round(y + 1.7e-08, 5) + 0.0 AS walk_fd FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS t FROM wk) LEFT JOIN fd USING (symbol, t)"))
def reg9b(spark, sf):
    """Each symbol at its own least order, sought between 0.1 and 1."""
    d = walk(spark, sf)
    return rounded(fr.fracdiff_by_symbol(d, fr.least_orders(d, "walk", low=0.1), "walk"), 5)


@query("REG-11", """WITH m AS (SELECT o_orderdate AS ts, avg(o_totalprice) / 5e6 AS cpi, stddev_samp(o_totalprice) / 5e6 AS growth FROM orders GROUP BY 1)
SELECT ts, round(cpi + 1.7e-11, 8) AS cpi, round(growth + 1.7e-11, 8) AS growth, r AS macro_regime, e::DOUBLE AS equity_bias, b::DOUBLE AS bond_bias, c::DOUBLE AS commodity_bias FROM (SELECT *, CASE WHEN coalesce(growth, 0) > 0.025 AND NOT cpi > 0.035 THEN 'goldilocks' WHEN NOT coalesce(growth, 0) > 0.025 AND cpi > 0.035 THEN 'stagflation'
 WHEN coalesce(growth, 0) > 0.025 AND cpi > 0.035 THEN 'reflation' ELSE 'deflation' END AS r FROM m)
JOIN (VALUES ('goldilocks', 1.0, 0.5, 0.3), ('reflation', 0.5, -0.5, 1.0), ('stagflation', -0.5, -0.3, 0.8), ('deflation', -0.3, 1.0, -0.5)) p(k, e, b, c) ON k = r""")
def reg11(spark, sf):
    m = table(spark, sf, "orders").groupBy(C("o_orderdate").alias("ts")).agg((F.avg("o_totalprice") / 5e6).alias("cpi"), (F.stddev_samp("o_totalprice") / 5e6).alias("growth"))
    d = m.withColumn("macro_regime", rg.inflation_regime("cpi", F.coalesce("growth", F.lit(0.0)))).join(F.broadcast(rg.playbook(spark)), "macro_regime")
    return rounded(d, 8)


# state machines --------------------------------------------------------------------------------
@query("STF-1", "WITH RECURSIVE " + ",\n".join([*SIG, f"q AS (SELECT symbol, ts, signal, row_number() {SER} AS rn, CASE WHEN count(signal) {last(2)} = 2 AND min(signal) {last(2)} = max(signal) {last(2)} THEN signal ELSE 0 END AS want FROM sig)",
  """w AS (SELECT symbol, ts, signal, rn, want AS pos, abs(want) AS held FROM q WHERE rn = 1 UNION ALL
  SELECT q.symbol, q.ts, q.signal, q.rn, CASE WHEN pos <> 0 AND held < 5 THEN pos ELSE want END, CASE WHEN pos <> 0 AND held < 5 THEN held + 1 ELSE abs(want) END FROM w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn + 1)"""]) +
  " SELECT symbol, ts, signal, pos AS filtered FROM w")
def stf1(spark, sf):
    return sq.filter_signals(signals(spark, sf))


def tier(dd):
    return f"CASE WHEN {dd} >= 0.20 THEN 3 WHEN {dd} >= 0.10 THEN 2 WHEN {dd} >= 0.05 THEN 1 ELSE 0 END"


TIER = [*BT, f"q AS (SELECT symbol, ts, equity AS nav, row_number() {SER} AS rn FROM bt)",
        """w AS (SELECT symbol, ts, nav, rn, nav AS pk, 0 AS tr, 0 AS cm, 0.0::DOUBLE AS dd, 0 AS ch FROM q WHERE rn = 1 UNION ALL
  SELECT symbol, ts, nav, rn, CASE WHEN go AND tg = 0 THEN nav ELSE p1 END, CASE WHEN go OR tg > tr THEN tg ELSE tr END, CASE WHEN tg < tr AND NOT go THEN cm + 1 ELSE 0 END, dd, CASE WHEN go OR tg > tr THEN 1 ELSE 0 END
  FROM (SELECT *, tg < tr AND cm + 1 >= 3 AS go FROM (SELECT *, """ + tier("dd") + """ AS tg FROM (SELECT q.symbol, q.ts, q.nav, q.rn, greatest(w.pk, q.nav) AS p1, w.tr, w.cm, (greatest(w.pk, q.nav) - q.nav) / greatest(w.pk, q.nav) AS dd
   FROM w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn + 1))))"""]


@query("STF-2", "WITH RECURSIVE " + ",\n".join(TIER) + """ SELECT symbol, ts, round(nav, 2) AS nav, round(dd, 6) + 0.0 AS drawdown, (['normal', 'caution', 'derisked', 'halted'])[tr + 1] AS tier, ([1.0, 0.75, 0.5, 0.0])[tr + 1]::DOUBLE AS scale,
 ch AS changed, round(greatest(0, pk / nav - 1), 6) + 0.0 AS recovery_pct FROM w""")
def stf2(spark, sf):
    d = sq.drawdown_tiers(stock_run(spark, sf))
    return d.select(*KEYS, F.round("nav", 2).alias("nav"), F.round("drawdown", 6).alias("drawdown"), "tier", "scale", "changed", F.round("recovery_pct", 6).alias("recovery_pct"))


@query("STF-5", with_([*BT, f"a AS (SELECT *, CASE WHEN sign(position) <> coalesce(lag(sign(position)) {SER}, 0) THEN 1 ELSE 0 END AS nw FROM bt)", f"b AS (SELECT *, sum(nw) {PAST} AS trade_id FROM a)"],
                      "SELECT symbol, ts, CAST(trade_id AS BIGINT) AS trade_id, round(max(close) OVER (PARTITION BY symbol, trade_id ORDER BY ts ROWS UNBOUNDED PRECEDING), 10) AS trail_high FROM b WHERE position <> 0"))
def stf5(spark, sf):
    d = open_trades(stock_run(spark, sf))
    p = Series(keys=("symbol", "trade_id"))
    return d.select(*KEYS, "trade_id", F.round(F.max("close").over(p.past), 10).alias("trail_high"))


def open_trades(run):
    """Bars in a position, numbered by trade."""
    p = Series()
    s = F.signum("position")
    d = run.withColumn("_nw", flag(s != F.coalesce(p.lag(s), F.lit(0.0))))
    return d.withColumn("trade_id", F.sum("_nw").over(p.past)).where("position <> 0")


from .performance import EXPLOG  # noqa: E402
from ..sources.tables import experiments  # noqa: E402


@query("STF-6", with_([EXPLOG], "SELECT id, session, CAST(row_number() OVER (PARTITION BY session ORDER BY id) AS INTEGER) AS n_trials FROM explog WHERE type = 'experiment'"))
def stf6(spark, sf):
    from pyspark.sql import Window
    e = experiments(spark, sf).where("type = 'experiment'")
    return e.select("id", "session", F.row_number().over(Window.partitionBy("session").orderBy("id")).alias("n_trials"))


# scalar functions ------------------------------------------------------------------------------
@query("FN-1", "SELECT s_suppkey, regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '_', 'g') AS safe, upper(replace(trim(s_name), '#', '-')) AS ticker, contains(lower(s_name), 'supplier') AS hit, left(s_name, 4) AS short FROM supplier")
def fn1(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", F.regexp_replace(F.lower(F.trim("s_name")), "[^a-z0-9]+", "_").alias("safe"), F.upper(F.replace(F.trim("s_name"), F.lit("#"), F.lit("-"))).alias("ticker"),
                    F.contains(F.lower("s_name"), F.lit("supplier")).alias("hit"), F.left("s_name", F.lit(4)).alias("short"))


@query("FN-2", f"""WITH {BARS} SELECT symbol, ts, month(ts)::INTEGER AS m, (isodow(ts) - 1)::INTEGER AS wd, day(ts)::INTEGER AS d, quarter(ts)::INTEGER AS q, last_day(ts) AS month_end, date_trunc('month', ts)::DATE AS month_start,
 (CAST(ts AS DATE) + INTERVAL 3 MONTH)::DATE AS plus3 FROM bars""")
def fn2(spark, sf):
    d = C("ts").cast("date")
    return bars(spark, sf).select(*KEYS, F.month("ts").alias("m"), F.weekday("ts").alias("wd"), F.day("ts").alias("d"), F.quarter("ts").alias("q"), F.last_day("ts").alias("month_end"),
                                  F.trunc(d, "month").alias("month_start"), F.add_months(d, 3).alias("plus3"))


win("FN-3", [{"a": "ln(close)", "b": "exp(-volume / 50)", "c": "sqrt(volume)", "d": "sign(close - 101)", "e": "sin(volume) + cos(volume)", "f": "1 / (1 + exp(-(close - 101)))", "g": "(exp(volume / 50) - exp(-volume / 50)) / 2"}], list("abcdefg"),
    lambda b, p: b.withColumns({"a": F.ln("close"), "b": F.exp(-C("volume") / 50), "c": F.sqrt("volume"), "d": F.signum(C("close") - 101), "e": F.sin("volume") + F.cos("volume"),
                                "f": 1 / (1 + F.exp(-(C("close") - 101))), "g": F.sinh(C("volume") / 50)}), digits=9)


def s_erf(x):
    t = f"(1.0 / (1.0 + 0.3275911 * abs({x})))"
    return f"sign({x}) * (1.0 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x})))"


def s_cdf(x):
    return f"(0.5 * (1 + {s_erf(f'(({x}) / sqrt(2.0))')}))"


def s_cdf0(x):
    """The variant without the division by sqrt 2."""
    t = f"(1.0 / (1.0 + 0.3275911 * abs({x})))"
    return f"(0.5 * (1.0 + CASE WHEN {x} >= 0 THEN 1 ELSE -1 END * (1.0 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x})))))"


def s_ppf(p):
    q = f"least(greatest({p}, 1e-12), 1 - 1e-12)"
    t = f"sqrt(-2 * ln(least({q}, 1 - {q})))"
    z = f"({t} - (2.515517 + 0.802853 * {t} + 0.010328 * {t} * {t}) / (1 + 1.432788 * {t} + 0.189269 * {t} * {t} + 0.001308 * {t} * {t} * {t}))"
    return f"(CASE WHEN {q} < 0.5 THEN -{z} ELSE {z} END)"


win("FN-4", [{"z": "(close - 101) / 2", "u": "volume / 151.0"}, {"cdf": s_cdf("z"), "cdf0": s_cdf0("z"), "ppf": s_ppf("u")}], ["cdf", "cdf0", "ppf"],
    lambda b, p: b.withColumns({"z": (C("close") - 101) / 2, "u": C("volume") / 151.0}).withColumns({"cdf": normal.norm_cdf(C("z")), "cdf0": normal.norm_cdf_unscaled(C("z")), "ppf": normal.norm_ppf(C("u"))}), digits=8)


@query("FN-5", "SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * embedding[len(embedding) + 1 - i]::DOUBLE)) + 1.7e-8, 5) + 0.0 AS dot, round(embedding[len(embedding)]::DOUBLE - embedding[1]::DOUBLE + 1.7e-8, 5) + 0.0 AS spread, len(embedding)::INTEGER AS n FROM embeddings")
def fn5(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    dot = F.aggregate(F.zip_with("e", F.reverse("e"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rounded(e.select("vec_id", dot.alias("dot"), (F.element_at("e", -1) - F.element_at("e", 1)).alias("spread"), F.size("e").alias("n")), 5)


@query("FN-6", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 2.0 WHEN '2-HIGH' THEN 1.5 ELSE 1.0 END::DOUBLE AS mult FROM orders")
def fn6(spark, sf):
    m = F.create_map(F.lit("1-URGENT"), F.lit(2.0), F.lit("2-HIGH"), F.lit(1.5))
    return table(spark, sf, "orders").select("o_orderkey", F.coalesce(F.try_element_at(m, C("o_orderpriority")), F.lit(1.0)).alias("mult"))


@query("FN-7", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS ks FROM events")
def fn7(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"), F.get_json_object("props", "$.k").alias("ks"))


@query("FN-8", "SELECT s_suppkey, left(sha256(s_name), 16) AS version, left(md5(s_name), 12) AS fp FROM supplier")
def fn8(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.left(F.sha2("s_name", 256), F.lit(16)).alias("version"), F.left(F.md5("s_name"), F.lit(12)).alias("fp"))


@query("FN-9", "SELECT p_partkey, round(p_retailprice / 7, 4) AS r4, round(p_retailprice / 7) AS r0 FROM part")
def fn9(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(C("p_retailprice") / 7, 4).alias("r4"), F.round(C("p_retailprice") / 7).alias("r0"))
