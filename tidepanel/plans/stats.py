"""STAT-*, RSK-*, ML-*, drift, streaming and user-function queries."""
from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from ..functions.scale import with_row
from ..functions.windows import Series, clip, flag, nz
from ..operators import backtest as bk, drift, features as feats, labels as lb, metrics as mt, ml, ranking as rk, regime as rg, risk as rs, sequential as sq, significance as sg, splits as sp, training as tr, user
from ..session import cut_lineage
from ..sources.tables import bars, events, experiments, table, universe
from ..streaming import bars as sb
from .common import once, scratch, signals, stock_run
from .data import CORR8, SEL, current_book, selected
from .catalogue import CAT, COLUMNS, catalogue, streamed, unpivoted
from .performance import BT, EXPLOG, FEAT, IC, MET, PERIODS, PROBA, PV, SIG, SUMM, WFM, feature_frame, scored, wf_metrics, with_regime
from .registry import query, rd, rounded
from .sql import (ALL, BARS, PAST, SER, STOCK, UNIVERSE, annual, bt, chain, flag as sflag, lag, last, mean, metrics, pct, quant, rnd, rounds, sharpe, stack, std, with_)
from .windows import open_trades, s_cdf, s_cdf0, s_ppf

C = F.col
KEYS = ("symbol", "ts")

REV = [*SIG, "rv AS (SELECT * REPLACE (-signal AS signal) FROM sig)", *bt("rv", STOCK)]

# one run per symbol: annual Sharpe, bars, moments, and the number of trials: the runs of the same search, which is one universe of symbols
RUNS = [*REV, UNIVERSE, "tr AS (SELECT universe, count(*) AS n_trials FROM (SELECT DISTINCT symbol FROM bt) JOIN universe USING (symbol) GROUP BY 1)", f"""runs AS (SELECT symbol AS run_id, r.* EXCLUDE (symbol), n_trials FROM (
  SELECT symbol, {sharpe('net_return')} AS sharpe, count(*) AS n_bars, skewness(net_return) AS skewness, kurtosis(net_return) + 3 AS kurtosis FROM bt GROUP BY symbol) r JOIN universe USING (symbol) JOIN tr USING (universe))"""]


def reversal_run(spark, sf):
    """The baseline with its direction turned round: the bars revert, so part of the symbols pass gates."""
    return bk.run(signals(spark, sf).withColumn("signal", -C("signal")), bk.cost("stock"))


def runs(spark, sf):
    """One run per symbol; the symbols of one universe are the trials of one search."""
    d = reversal_run(spark, sf)
    a = d.groupBy("symbol").agg(mt.sharpe("net_return").alias("sharpe"), F.count(F.lit(1)).alias("n_bars"), F.skewness("net_return").alias("g1"), F.kurtosis("net_return").alias("g2"))
    a = cut_lineage(a.join(universe(spark, sf).select("symbol", "universe"), "symbol"))      # one row a run, read twice
    a = a.join(a.groupBy("universe").agg(F.count(F.lit(1)).alias("n_trials")), "universe")
    k = C("n_bars").cast("double")
    return a.select(C("symbol").alias("run_id"), "sharpe", "n_bars", (C("g1") * F.sqrt(k * (k - 1)) / (k - 2)).alias("skewness"),
                    ((k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * C("g2") + 6) + 3).alias("kurtosis"), "n_trials")


@query("STAT-1", with_([*RUNS, f"t AS (SELECT *, sharpe * sqrt(n_bars / 252.0) AS t FROM runs)"], f"SELECT run_id, round(t, 4) + 0.0 AS t_stat, round(1 - {s_cdf0('t')}, 4) + 0.0 AS p_value, round(n_bars / 252.0, 2) AS n_years, CASE WHEN 1 - {s_cdf0('t')} < 0.05 THEN 1 ELSE 0 END AS significant_at_05 FROM t"))
def stat1(spark, sf):
    d = sg.sharpe_tstat(runs(spark, sf))
    return d.select("run_id", (C("t_stat") + 0.0).alias("t_stat"), (C("p_value") + 0.0).alias("p_value"), "n_years", "significant_at_05")


def psr_z(sr, star="0.0", sk="skewness", ku="kurtosis", n="n_bars"):
    s = f"({sr} / sqrt(252.0))"
    return f"(({s} - {star} / sqrt(252.0)) * sqrt({n} - 1) / sqrt(greatest(1 - {sk} * {s} + ({ku} - 3) / 4 * {s} * {s}, 1e-9)))"


@query("STAT-2", with_([*RUNS, f"z AS (SELECT *, {psr_z('sharpe')} AS z FROM runs)", f"q AS (SELECT *, {s_cdf0('z')} AS p FROM z)"], "SELECT run_id, round(p, 4) + 0.0 AS psr, round(z, 4) + 0.0 AS z_score, CASE WHEN p >= 0.99 THEN 'very_high_confidence' WHEN p >= 0.95 THEN 'statistically_significant' WHEN p >= 0.90 THEN 'suggestive' ELSE 'not_significant' END AS interpretation FROM q"))
def stat2(spark, sf):
    d = sg.probabilistic_sharpe(runs(spark, sf))
    return d.select("run_id", (C("psr") + 0.0).alias("psr"), (C("z_score") + 0.0).alias("z_score"), "interpretation")


def emax(n, ppf=s_ppf):
    return f"((1 - 0.5772156649) * {ppf(f'1 - 1.0 / {n}')} + 0.5772156649 * {ppf(f'1 - 1.0 / ({n} * exp(1))')})"


NT = "greatest(n_trials, 2)::DOUBLE"
DSR = [*RUNS, f"e0 AS (SELECT *, {emax(NT)} AS em, sharpe / sqrt(252.0) AS sd FROM runs)", "e1 AS (SELECT *, sqrt(greatest((1 - sd * (kurtosis - 1) / 4 + sd * sd * (kurtosis - 3) / 8) / (n_bars - 1), 1e-12)) * em * sqrt(252.0) AS star FROM e0)",
       f"e2 AS (SELECT *, {psr_z('sharpe', 'star')} AS z FROM e1)", f"e3 AS (SELECT *, round({s_cdf0('z')}, 4) AS dsr FROM e2)"]


@query("STAT-3", with_(DSR, "SELECT run_id, dsr + 0.0 AS dsr, round(star, 4) + 0.0 AS sr_star_ann, CASE WHEN dsr >= 0.95 THEN 'passes_multiple_testing_correction' WHEN dsr >= 0.90 THEN 'marginal_after_correction' WHEN dsr >= 0.50 THEN 'below_multiple_testing_threshold' ELSE 'likely_false_positive' END AS interpretation FROM e3"))
def stat3(spark, sf):
    d = sg.deflated_sharpe(runs(spark, sf))
    return d.select("run_id", (C("dsr") + 0.0).alias("dsr"), (C("sr_star_ann") + 0.0).alias("sr_star_ann"), "interpretation")


@query("STAT-4", with_([*RUNS, f"g AS (SELECT run_id, sharpe, sharpe / sqrt(252.0) AS sd, {emax(NT)} AS em, unnest(range(50, 6000, 10)) AS nb FROM runs)",
                        "g1 AS (SELECT *, sqrt(greatest((1 - sd * 2.0 / 4) / (nb - 1), 1e-12)) * em * sqrt(252.0) AS star FROM g)", f"g2 AS (SELECT *, {psr_z('sharpe', 'star', '0.0', '3.0', 'nb')} AS z FROM g1)"],
                       f"SELECT run_id, coalesce(min(CASE WHEN round({s_cdf0('z')}, 4) >= 0.95 THEN nb END), 6000)::INTEGER AS min_bars FROM g2 GROUP BY run_id"))
def stat4(spark, sf):
    return sg.minimum_backtest_length(runs(spark, sf))


def s_ppf2(p):
    """Acklam's rational approximation."""
    def poly(cs, x):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out} * {x} + {c!r})"
        return out
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
    q, t = f"(({p}) - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - ({p}))))"
    r = f"({q} * {q})"
    tail = f"{poly(c, t)} / {poly(d, t)}"
    return f"(CASE WHEN ({p}) < 0.02425 THEN {tail} WHEN ({p}) > 0.97575 THEN -({tail}) ELSE {poly(a, r)} * {q} / {poly(b, r)} END)"


@query("STAT-5", with_([*RUNS, f"e0 AS (SELECT *, {NT} AS nn, sharpe / sqrt(252.0) AS sb FROM runs)", f"e1 AS (SELECT *, ((1 - 0.5772156649) * {s_ppf2('(1 - 1.0 / nn)')} + 0.5772156649 * {s_ppf2('(1 - 1.0 / (nn * exp(1)))')}) / sqrt(n_bars) AS star FROM e0)",
  "e2 AS (SELECT *, (sb - star) / sqrt(greatest((1 + sb * sb * (0.5 + (kurtosis - 3) / 4) - skewness * sb) / n_bars, 1e-12)) AS z FROM e1)"], f"SELECT run_id, round({s_cdf('z')}, 4) + 0.0 AS dsr FROM e2"))
def stat5(spark, sf):
    r = runs(spark, sf).withColumn("excess", C("kurtosis") - 3.0)
    return r.select("run_id", (F.round(sg.deflated_sharpe_overfit("sharpe", C("n_trials"), "n_bars", "skewness", "excess"), 4) + 0.0).alias("dsr"))


@query("STAT-6", with_([*RUNS, "z AS (SELECT *, (sharpe - sqrt(2 * ln(10.0)) / sqrt(n_bars)) * sqrt(n_bars - 1) AS z FROM runs)"], f"SELECT run_id, {rnd(s_cdf('z'), 6, 'dsr')} FROM z"))
def stat6(spark, sf):
    return rounded(runs(spark, sf).select("run_id", sg.dsr_gate("sharpe", "n_bars").alias("dsr")))


FOLDS = [*WFM, "fm AS (SELECT symbol, fold, max(CASE WHEN split = 'train' THEN round(sharpe_ratio, 9) END) AS is_sharpe, max(CASE WHEN split = 'test' THEN round(sharpe_ratio, 9) END) AS oos_sharpe FROM met GROUP BY symbol, fold)"]
_RK = "(rank() OVER (PARTITION BY symbol ORDER BY {0}) + (count(*) OVER (PARTITION BY symbol, {0}) - 1) / 2.0)"


def fold_pairs(spark, sf):
    m = wf_metrics(spark, sf)
    r = F.round("sharpe_ratio", 9)
    return m.groupBy("symbol", "fold").agg(F.max(F.when(C("split") == "train", r)).alias("is_sharpe"), F.max(F.when(C("split") == "test", r)).alias("oos_sharpe"))


@query("STAT-7", with_([*FOLDS, f"rk AS (SELECT symbol, {_RK.format('is_sharpe')} AS a, {_RK.format('oos_sharpe')} AS b FROM fm)", "cc AS (SELECT symbol, count(*) AS n_folds, CASE WHEN count(*) >= 3 THEN coalesce(corr(a, b), 0) ELSE 0 END AS c FROM rk GROUP BY symbol)"],
                       "SELECT symbol, n_folds, round(least(greatest(0.5 - c * 0.5, 0), 1), 4) + 0.0 AS pbo, round(c, 4) + 0.0 AS rank_correlation FROM cc"))
def stat7(spark, sf):
    d = sg.pbo(fold_pairs(spark, sf), ["symbol"])
    return d.select("symbol", "n_folds", (C("pbo") + 0.0).alias("pbo"), (C("rank_correlation") + 0.0).alias("rank_correlation"))


ISO = [*WFM, """io AS (SELECT symbol, avg(CASE WHEN split = 'train' THEN sharpe_ratio END) AS is_sharpe, avg(CASE WHEN split = 'test' THEN sharpe_ratio END) AS oos_sharpe, avg(CASE WHEN split = 'train' THEN cagr END) AS is_cagr, avg(CASE WHEN split = 'test' THEN cagr END) AS oos_cagr,
 avg(CASE WHEN split = 'train' THEN win_rate END) AS is_win_rate, avg(CASE WHEN split = 'test' THEN win_rate END) AS oos_win_rate, avg(CASE WHEN split = 'train' THEN max_drawdown END) AS is_max_drawdown, avg(CASE WHEN split = 'test' THEN max_drawdown END) AS oos_max_drawdown FROM met GROUP BY symbol)""",
 "gs AS (SELECT *, CASE WHEN is_sharpe <> 0 THEN (is_sharpe - oos_sharpe) / greatest(abs(is_sharpe), 0.3) ELSE 0 END AS sr, CASE WHEN is_cagr <> 0 THEN (is_cagr - oos_cagr) / greatest(abs(is_cagr), 1e-9) ELSE 0 END AS cg FROM io)",
 "gp AS (SELECT *, round(0.55 * least(greatest(sr, 0), 1) + 0.25 * least(greatest(cg, 0), 1) + 0.10 * least(greatest((is_win_rate - oos_win_rate) * 5, 0), 1) + 0.10 * least(greatest((abs(oos_max_drawdown) - abs(is_max_drawdown)) * 5, 0), 1), 4) + 0.0 AS gap_score, round(sr * 100, 2) + 0.0 AS sharpe_gap_pct FROM gs)"]


def is_oos(spark, sf):
    m = wf_metrics(spark, sf)
    out = []
    for tag, split in (("is", "train"), ("oos", "test")):
        out += [F.avg(F.when(C("split") == split, C(c))).alias(f"{tag}_{n}") for c, n in (("sharpe_ratio", "sharpe"), ("cagr", "cagr"), ("win_rate", "win_rate"), ("max_drawdown", "max_drawdown"))]
    return m.groupBy("symbol").agg(*out)


@query("STAT-8", with_(ISO, "SELECT symbol, gap_score, sharpe_gap_pct FROM gp"))
def stat8(spark, sf):
    d = sg.gap_score(is_oos(spark, sf))
    return d.select("symbol", (C("gap_score") + 0.0).alias("gap_score"), (C("sharpe_gap_pct") + 0.0).alias("sharpe_gap_pct"))


# importance of a feature in a year = |information coefficient| of that year
IMP = [*CAT, f"lng AS ({unpivoted('ts, fwd_return', where=' WHERE fwd_return IS NOT NULL')})", f"imp AS (SELECT year(ts) AS fold, feature, abs({IC}) AS importance FROM lng GROUP BY 1, 2)", "nf AS (SELECT count(DISTINCT fold) AS k FROM imp)",
       "fs AS (SELECT feature, coalesce(sum(importance), 0) / any_value(k) AS m, sqrt(greatest(coalesce(sum(importance * importance), 0) / any_value(k) - pow(coalesce(sum(importance), 0) / any_value(k), 2), 0)) AS s FROM imp, nf GROUP BY feature)",
       "fc AS (SELECT *, s / (m + 1e-9) AS cov, CASE WHEN m > (SELECT greatest(median(m), 1e-9) FROM fs) THEN 1 ELSE 0 END AS important FROM fs)"]


def importances(spark, sf):
    d = streamed(spark, sf).where("fwd_return IS NOT NULL").withColumn("fold", F.year("ts"))
    years = bars(spark, sf).select(F.year("ts")).distinct().collect()
    ic = mt.information_coefficient(d, COLUMNS, keys=("fold",), names=[tuple(r) for r in years])
    return ic.select("fold", "feature", F.coalesce(F.abs("ic"), F.lit(0.0)).alias("importance"))


@query("STAT-9", with_(IMP, f"SELECT feature, {rnd('m', 6, 'mean_importance')}, {rnd('s', 6, 'std_importance')}, {rnd('cov', 4, 'cov')}, important, CASE WHEN cov > 0.5 AND important = 1 THEN 1 ELSE 0 END AS unstable FROM fc"))
def stat9(spark, sf):
    d = sg.feature_stability(importances(spark, sf))
    return d.select("feature", rd("mean_importance", 6).alias("mean_importance"), rd("std_importance", 6).alias("std_importance"), rd("cov", 4).alias("cov"), "important", "unstable")


@query("STAT-10", with_([EXPLOG, "lt AS (SELECT id AS run_id, len(tags) AS n_features, row_number() OVER (PARTITION BY session ORDER BY id) AS n_trials FROM explog WHERE type = 'experiment')"],
  "SELECT run_id, round(least(1.0, least(greatest((n_features - 10) / 40.0, 0), 0.5) + least(0.5, ln(n_trials + 1.0) / ln(1000.0))), 4) + 0.0 AS penalty, round(0.05 / n_trials, 6) + 0.0 AS bonferroni FROM lt"))
def stat10(spark, sf):
    """Every experiment of the log with the trials its session had made by then and the features it named."""
    e = experiments(spark, sf).where("type = 'experiment'").select(C("id").alias("run_id"), F.size("tags").alias("n_features"), F.row_number().over(Window.partitionBy("session").orderBy("id")).alias("n_trials"))
    pen, bon = sg.multiple_testing("n_trials", "n_features")
    return e.select("run_id", (pen + 0.0).alias("penalty"), (bon + 0.0).alias("bonferroni"))


@query("STAT-11", with_([*RUNS, f"q AS (SELECT *, {s_ppf2('(1 - 0.05 / n_trials)')} AS z FROM runs)"], "SELECT run_id, CASE WHEN sharpe <= 0 THEN 'inf'::DOUBLE ELSE round(pow(z / sharpe, 2), 2) END AS min_years FROM q"))
def stat11(spark, sf):
    return runs(spark, sf).select("run_id", sg.minimum_years("sharpe", "n_trials").alias("min_years"))


@query("STAT-12")
def stat12(spark, sf):
    """Full report per symbol: walk-forward metrics, trial counts, moments, rank correlation, stability."""
    st = sg.stability_score(sg.feature_stability(importances(spark, sf)))
    d = is_oos(spark, sf).join(sg.pbo(fold_pairs(spark, sf), ["symbol"]).drop("n_folds"), "symbol")
    r = runs(spark, sf).select(C("run_id").alias("symbol"), C("n_trials").alias("n_tests"), C("n_bars").alias("oos_bars"), "skewness", (C("kurtosis") - 3).alias("excess_kurtosis"))
    d = with_row(d.join(r, "symbol"), st).withColumn("n_features", F.lit(len(COLUMNS)))
    o = sg.overfitting_report(d)
    return o.select("symbol", "overfitting_score", "severity", "gap_score", "dsr", "pbo", F.round("stability", 4).alias("stability"), F.concat_ws("; ", "warnings").alias("warnings"), F.concat_ws("; ", "recommendations").alias("recommendations"))


@query("STAT-13", with_([*REV, f"x AS (SELECT *, row_number() {SER} - 1 AS x FROM bt)"], f"SELECT symbol, {rnd('regr_r2(equity, x)', 6, 'equity_r2')} FROM x GROUP BY symbol"))
def stat13(spark, sf):
    return rounded(sg.equity_r2(reversal_run(spark, sf), ("symbol",)))


@query("STAT-14", with_([*REV, f"x AS (SELECT *, row_number() {SER} - 1 AS rn, count(*) {ALL} AS n FROM bt)", f"s AS (SELECT symbol, rn // (n // 5) AS sl, {sharpe('net_return')} AS sh FROM x WHERE rn // (n // 5) < 5 GROUP BY 1, 2)"], f"SELECT symbol, {rnd('avg(sh)', 6, 'cpcv_sharpe')} FROM s GROUP BY symbol"))
def stat14(spark, sf):
    return rounded(sg.slice_sharpe(reversal_run(spark, sf), ("symbol",)))


@query("STAT-15", with_(FOLDS, f"SELECT symbol, {rnd('CASE WHEN count(oos_sharpe) < 2 THEN 0 WHEN abs(avg(oos_sharpe)) < 1e-9 THEN 1 ELSE stddev_samp(oos_sharpe) / abs(avg(oos_sharpe)) END', 4, 'param_cv')} FROM fm GROUP BY symbol"))
def stat15(spark, sf):
    return rounded(sg.parameter_cv(fold_pairs(spark, sf), ("symbol",), "oos_sharpe"), 4)


@query("STAT-16", with_([*REV, f"x AS (SELECT *, CASE WHEN lag(net_return) {SER} * net_return < 0 THEN 1.0 ELSE 0.0 END AS fl FROM bt)", "y AS (SELECT symbol, m AS mult, net_return - fl * 0.0015 * m * 2 AS r FROM x CROSS JOIN (SELECT unnest([1, 2, 3]) AS m))"], f"SELECT symbol, CAST(mult AS INTEGER) AS mult, {rnd(sharpe('r'), 6, 'sharpe')} FROM y GROUP BY symbol, mult"))
def stat16(spark, sf):
    return rounded(sg.cost_scaling(reversal_run(spark, sf), ("symbol",)))


TTR = [*REV, f"tt AS (SELECT symbol, count(*) AS n, avg(net_return) AS mu, stddev_samp(net_return) AS sd, {sharpe('net_return')} AS sr, skewness(net_return) AS sk, kurtosis(net_return) AS ku FROM bt GROUP BY symbol)",
       f"t2 AS (SELECT *, mu * sqrt(252.0) / (sd + 1e-9) * sqrt(n / 252.0) AS t_stat, least(greatest(1 - sk * sr + (ku + 2) / 4 * sr * sr, 0.5), 5) AS cr, {s_ppf('0.95')} + {s_ppf('0.5')} AS z FROM tt)",
       "t3 AS (SELECT *, CASE WHEN abs(sr) < 1e-6 THEN 999 ELSE z * z * cr / (sr * sr) / 252 END AS trl FROM t2)"]


@query("STAT-17", with_(TTR, f"SELECT symbol, n, {rnd('sr', 6, 'sharpe')}, {rnd('t_stat', 6, 't_stat')}, {rnd('least(trl, 1e6)', 4, 'min_trl_years')} FROM t3"))
def stat17(spark, sf):
    d = sg.t_and_track_record(reversal_run(spark, sf), ("symbol",))
    return d.select("symbol", "n", rd("sharpe", 6).alias("sharpe"), rd("t_stat", 6).alias("t_stat"), rd(F.least("min_trl_years", F.lit(1e6)), 4).alias("min_trl_years"))


GATE8 = [*TTR, f"x AS (SELECT *, row_number() {SER} - 1 AS rn, count(*) {ALL} AS n, CASE WHEN lag(net_return) {SER} * net_return < 0 THEN 1.0 ELSE 0.0 END AS fl FROM bt)",
         f"sl AS (SELECT symbol, avg(sh) AS cp FROM (SELECT symbol, rn // (n // 5) AS k, {sharpe('net_return')} AS sh FROM x WHERE rn // (n // 5) < 5 GROUP BY 1, 2) GROUP BY symbol)",
         f"c3 AS (SELECT symbol, {sharpe('r')} AS s3 FROM (SELECT symbol, net_return - fl * 0.009 AS r FROM x) GROUP BY symbol)", "r2 AS (SELECT symbol, regr_r2(equity, rn) AS r2 FROM x GROUP BY symbol)",
         f"fs AS (SELECT symbol, (rn - 147) // 21 AS fold, {sharpe('net_return')} AS s FROM x WHERE rn >= 147 AND (rn - 147) // 21 <= (n - 168) // 21 AND (n - 168) // 21 >= 4 GROUP BY 1, 2)",
         "fa AS (SELECT symbol, avg(s) AS fm, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS fp, CASE WHEN count(s) < 2 THEN 0 WHEN abs(avg(s)) < 1e-9 THEN 1 ELSE stddev_samp(s) / abs(avg(s)) END AS cv FROM fs GROUP BY symbol)",
         f"gg AS (SELECT t3.symbol, CAST({s_cdf('(sr - sqrt(2 * ln(10.0)) / sqrt(n)) * sqrt(n - 1)')} >= 0.95 AS INT) + CAST(coalesce(fm, cp) > 0 AS INT) + CAST(coalesce(cv, 0) < 0.5 AS INT) + CAST(s3 >= 0.3 AS INT) + CAST(t_stat >= 3 AS INT) + CAST(n / 252.0 >= trl AS INT) + CAST(r2 >= 0.3 AS INT) + CAST(coalesce(fp, CASE WHEN sr > 0 THEN 1.0 ELSE 0.0 END) >= 0.6 AS INT) AS np FROM t3 LEFT JOIN fa USING (symbol) JOIN sl USING (symbol) JOIN c3 USING (symbol) JOIN r2 USING (symbol))"]


@query("STAT-18", with_(GATE8, "SELECT symbol, np AS n_passed, CASE WHEN np >= 5 THEN 1 ELSE 0 END AS overall_pass FROM gg"))
def stat18(spark, sf):
    """All eight gates; the fold gates read the run's Sharpe in the test part of every walk-forward fold."""
    r = reversal_run(spark, sf)
    parts = sp.assign_bar_folds(r, sp.bar_folds(r)).where("split = 'test'")
    return sg.robustness_gates(r, ("symbol",), parts.groupBy("symbol", "fold").agg(mt.sharpe("net_return").alias("sharpe"))).select("symbol", "n_passed", "overall_pass")


# risk ------------------------------------------------------------------------------------------
VOLS = [*SIG, *stack("sig", [{"r": pct("close")}, {"v": f"({std('r', 21)}) * sqrt(252.0)"}, {"vv": "coalesce(v, 0)", "edge": "signal * coalesce(v, 0)"}], "vs")]


def size_sql(edge="edge", conf="1.0", vol="vv", extra=""):
    a = f"CASE WHEN {vol} > 0 THEN 0.15 / ({vol} + 1e-9) ELSE 0 END"
    b = f"CASE WHEN {vol} > 0 THEN abs(0.25 * {edge} / ({vol} * {vol} + 1e-12)) ELSE 0 END"
    c = f"CASE WHEN {vol} > 0 THEN 0.01 / ({vol} + 1e-9) ELSE 0 END"
    med = f"list_sort([{a}, {b}, {c}])[2]"
    return f"CASE WHEN {conf} < 0.6 THEN 0 ELSE least(greatest(sign({edge}) * {med} * least(greatest(({conf} - 0.6) / (0.4 + 1e-9), 0), 1), -1), 1) END"


@query("RSK-1", with_([*VOLS, "c AS (SELECT *, 0.5 + 0.5 * volume / 151 AS conf FROM vs)"], f"SELECT symbol, ts, {rnd(size_sql(conf='conf'), 8, 'size')} FROM c"))
def rsk1(spark, sf):
    d = vol_frame(spark, sf).withColumn("conf", 0.5 + 0.5 * C("volume") / 151)
    return rounded(d.withColumn("size", rs.position_size("edge", "conf", "vol")).select(*KEYS, "size"), 8)


def vol_frame(spark, sf):
    p = Series()
    d = signals(spark, sf).withColumn("_r", p.pct("close"))
    d = d.withColumn("vol", F.coalesce(p.std("_r", 21) * math.sqrt(252.0), F.lit(0.0)))
    return d.withColumn("edge", C("signal") * C("vol")).drop("_r")


@query("RSK-2", with_(VOLS, "SELECT symbol, ts, CAST(CASE WHEN vv > 0 THEN sign(signal) * floor(least(0.15 / (vv + 1e-9), 1) * 100000.0 / close) ELSE 0 END AS INTEGER) AS qty FROM vs"))
def rsk2(spark, sf):
    return vol_frame(spark, sf).select(*KEYS, rs.share_quantity("signal", "vol", F.lit(100_000.0), "close").alias("qty"))


@query("BT-4", with_([*VOLS, f"mp AS (SELECT symbol, ts, close, sign(signal) * abs({size_sql()}) AS signal FROM vs)", *bt("mp", STOCK)], f"SELECT symbol, {rnd(sharpe('net_return'), 6, 'sharpe')}, {rnd('avg(abs(position))', 8, 'avg_position')} FROM bt GROUP BY symbol"))
def bt4(spark, sf):
    d = rs.managed_positions(signals(spark, sf))
    r = bk.run(d, bk.cost("stock"), signal="position_size")
    return r.groupBy("symbol").agg(rd(mt.sharpe("net_return"), 6).alias("sharpe"), rd(F.avg(F.abs("position")), 8).alias("avg_position"))


GATED = [*VOLS, f"q AS (SELECT symbol, ts, close, signal, sign(signal) * abs({size_sql()}) AS raw, row_number() {SER} AS rn, close / lag(close) {SER} - 1 AS r1 FROM vs)",
         "w AS (SELECT symbol, ts, rn, raw AS pos FROM q WHERE rn = 1 UNION ALL SELECT q.symbol, q.ts, q.rn, CASE WHEN w.pos * q.r1 <= -0.01 THEN 0 ELSE q.raw END FROM w JOIN q ON q.symbol = w.symbol AND q.rn = w.rn + 1)"]


@query("STF-3", "WITH RECURSIVE " + ",\n".join(GATED) + f" SELECT symbol, ts, {rnd('pos', 8, 'position_size')} FROM w")
def stf3(spark, sf):
    d = rs.managed_positions(signals(spark, sf), r=rs.RiskParams(daily_loss_limit=0.01), gate=True)
    return rounded(d.select(*KEYS, "position_size"), 8)


SIX = [*PROBA, f"eq AS (SELECT *, close / max(close) {PAST} - 1 AS dd, (stddev_samp(ret_1d) {last(21)}) * sqrt(252.0) AS v FROM prn)",
       "z0 AS (SELECT symbol, ts, sign(proba - 0.5) AS sg, 0.5 + abs(proba - 0.5) AS cf, greatest(coalesce(v, 0.2), 1e-4) AS v, abs(dd) AS dd, regime_name AS rg FROM eq WHERE proba IS NOT NULL)",
       "z1 AS (SELECT *, least(greatest(0.15 / (v + 1e-9) * sg, -0.25), 0.25) AS tv, least(greatest(0.25 * abs(sg) * cf / (v * v + 1e-12) * sg, -0.25), 0.25) AS ky, greatest(cf - 0.55, 0) / 0.45 AS eg, least(greatest(sg * 0.02 / (v + 1e-9), -0.25), 0.25) AS rb FROM z0)",
       "z2 AS (SELECT *, least(greatest(sg * eg, -0.25), 0.25) AS ce, CASE WHEN dd >= 0.2 THEN 0 WHEN dd >= 0.1 THEN 0.5 WHEN dd >= 0.05 THEN 0.75 ELSE 1 END AS dm FROM z1)",
       "z3 AS (SELECT *, least(greatest(CASE rg WHEN 'bull' THEN tv * least(greatest(0.5 + 0.5 * eg, 0.5), 1) WHEN 'bear' THEN ky WHEN 'high_vol' THEN ky ELSE ce END * CASE rg WHEN 'bull' THEN 1.0 WHEN 'bear' THEN 0.5 WHEN 'sideways' THEN 0.75 WHEN 'high_vol' THEN 0.6 ELSE 0.8 END, -0.25), 0.25) AS ra FROM z2)"]
_M6 = {"volatility_target": "tv", "fractional_kelly": "ky", "confidence_edge": "ce", "risk_budget": "rb", "regime_aware": "ra", "drawdown_derisked": "ra"}


@query("RSK-3", with_(SIX, "SELECT symbol, ts, " + ", ".join(rnd(f"CASE WHEN cf < 0.55 THEN 0 ELSE least(greatest({v} * dm, -0.25), 0.25) END", 7, k) for k, v in _M6.items()) + " FROM z3"))
def rsk3(spark, sf):
    p = Series()
    d = scored(spark, sf).withColumn("vol", p.std("ret_1d", 21, 2) * math.sqrt(252.0))
    d = d.withColumns({"drawdown": C("close") / F.max("close").over(p.past) - 1.0, "vol": F.coalesce("vol", F.lit(0.2))}).where("proba IS NOT NULL")
    d = d.withColumns({"signal": F.signum(C("proba") - 0.5), "confidence": 0.5 + F.abs(C("proba") - 0.5)})
    return rounded(d.select(*KEYS, *[rs.dynamic_size(m).alias(m) for m in rs.SIZING_METHODS]), 7)


@query("RSK-4", """WITH v AS (SELECT event_id, (['kelly_fraction', 'target_vol', 'max_position', 'dd_caution', 'dd_derisked', 'dd_halt', 'regime_bull_mult', 'other'])[event_id % 8 + 1] AS name, value / 200 AS value FROM events)
SELECT event_id, name, round(least(greatest(value, lo), hi) + 1.7e-9, 6) AS value FROM v JOIN (VALUES ('kelly_fraction', 0.05, 1.0), ('target_vol', 0.05, 0.5), ('max_position', 0.05, 1.0), ('dd_caution', 0.01, 0.15), ('dd_derisked', 0.05, 0.30), ('dd_halt', 0.10, 0.50), ('regime_bull_mult', 0.0, 2.0)) t(n, lo, hi) ON n = name""")
def rsk4(spark, sf):
    """Proposed parameter values taken from the event stream, clipped to their safe ranges."""
    names = F.array(*[F.lit(x) for x in ("kelly_fraction", "target_vol", "max_position", "dd_caution", "dd_derisked", "dd_halt", "regime_bull_mult", "other")])
    e = events(spark, sf).select("event_id", F.element_at(names, (C("event_id") % 8 + 1).cast("int")).alias("name"), (C("value") / 200).alias("value"))
    return rounded(rs.safe_parameters(e).select("event_id", "name", "value"))


@query("RSK-5", with_([*BT, f"x AS (SELECT *, max(equity) {PAST} AS pk FROM bt)"], "SELECT symbol, CASE WHEN abs(min((equity - pk) / pk)) >= 0.25 THEN 1 ELSE 0 END AS halt FROM x GROUP BY symbol"))
def rsk5(spark, sf):
    d = mt.drawdown(stock_run(spark, sf), ("symbol",))
    return d.select("symbol", flag(F.abs("max_drawdown") >= rs.RiskParams().max_drawdown).alias("halt"))


TAIL = [BARS, *stack("bars", [{"r": pct("close")}, {"n": f"count(r) {PAST}", "v": f"({std('r', 21)}) * sqrt(252.0)"}, {"vm": f"avg(v) {last(232)}", "vs": f"stddev_samp(v) {last(232)}", "sg": f"stddev_samp(r) {last(252)}", "a": f"list(r) {last(252)}"},
  {"vz": "CASE WHEN n < 26 OR n < 42 OR vs < 1e-9 OR vs IS NULL THEN 0 ELSE (v - vm) / vs END", "tp": "CASE WHEN n < 26 THEN 0.10 ELSE len(list_filter(a, lambda e: e < -2 * sg))::DOUBLE / len(list_filter(a, lambda e: e IS NOT NULL)) END"},
  {"scenario": "CASE WHEN n < 26 THEN 'normal' WHEN vz >= 3.5 AND tp <= 0.01 THEN 'black_swan' WHEN vz >= 3.5 THEN 'extreme' WHEN vz >= 2 OR tp <= 0.05 THEN 'caution' ELSE 'normal' END"}], "tl")]


@query("RSK-6", with_(TAIL, f"SELECT symbol, ts, {rnd('vz', 5, 'vol_zscore')}, {rnd('tp', 7, 'tail_prob')}, scenario, CASE scenario WHEN 'normal' THEN 1.0 WHEN 'caution' THEN 0.7 ELSE 0.25 END::DOUBLE AS exposure FROM tl"))
def rsk6(spark, sf):
    d = rs.tail_risk(bars(spark, sf))
    return d.select(*KEYS, rd("vol_zscore", 5).alias("vol_zscore"), rd("tail_prob", 7).alias("tail_prob"), "scenario", "exposure")


@query("RSK-7", with_([BARS, PV, "ip AS (SELECT bars.*, period FROM bars JOIN pv ON ts BETWEEN a AND b)", "ir AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol, period ORDER BY ts) - 1 AS r FROM ip)"],
                      "SELECT symbol, period, count(*) AS bars, CASE WHEN count(*) < 5 THEN 0 ELSE round((product(1 - 0.3 * coalesce(r, 0)) - 1) * 100, 2) + 0.0 END AS return_pct FROM ir GROUP BY symbol, period"))
def rsk7(spark, sf):
    d = rs.stress_book(bars(spark, sf), bk.period_table(spark, PERIODS), net_weight=-0.2, gross_weight=0.6, n_positions=2)
    return d.select("symbol", "period", "bars", (C("return_pct") + 0.0).alias("return_pct"))


ORD = [*CORR8, "r8 AS (SELECT symbol, ts, r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM rt)", "r9 AS (SELECT * FROM r8 WHERE k <= 252 AND r IS NOT NULL)",
       "rq AS (SELECT symbol, quantile_cont(r, 0.05) AS q FROM r9 GROUP BY symbol)", "st AS (SELECT r9.symbol, count(*) AS n_ret, -avg(CASE WHEN r <= q THEN r END) AS cvar, stddev_pop(CASE WHEN k <= 21 THEN r END) * sqrt(252.0) AS vol21 FROM r9 JOIN rq USING (symbol) GROUP BY r9.symbol)",
       """od AS (SELECT o_orderkey, st.*, coalesce(max_corr, 0) AS max_corr, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * (o_totalprice % 40) / 100 AS size, (o_orderkey % 45) / 100.0 AS sx, (o_custkey % 12) / 100.0 AS atr, 1.0 AS price, (o_custkey % 100) / 100.0 AS cash, (o_orderkey % 6) / 100.0 AS sl,
        (o_custkey % 30) / 100.0 AS gp, 0.5 + (o_orderkey % 50) / 100.0 AS cf, (o_orderkey % 21) / 10.0 AS lv, -(o_custkey % 40) / 1000.0 AS pnl, (o_orderkey % 25) / 100.0 AS dd, (o_custkey % 50)::DOUBLE AS vx
        FROM orders JOIN st ON st.symbol = 'S' || (o_custkey % (SELECT count(*) FROM supplier)) LEFT JOIN mc ON mc.candidate = st.symbol)""",
       "oe AS (SELECT *, abs(size) AS z, least(0.02 / greatest(atr * 2 / price, 0.001), 0.25) AS am, 0.15 / greatest(vol21, 0.01) * cf * 1.5 AS vm FROM od)",
       """oc AS (SELECT *, CAST(z > 0.25 AS INT) + CAST(sx + z > 0.4 AS INT) + CAST(cvar * z > 0.03 AS INT) + CAST(atr > 0 AND z > am AS INT) + CAST(cash - z < 0.05 AS INT) + CAST(sl < 0.02 AS INT) + CAST(gp + z > 0.25 AS INT) + CAST(z > vm AS INT)
         + CAST(max_corr > 0.85 AS INT) + CAST(z * vol21 > 0.02 AS INT) AS ns, CASE WHEN lv + z > 2 THEN 'max_leverage' WHEN NOT pnl > -0.03 THEN 'daily_loss_limit' WHEN dd > 0.2 THEN 'drawdown_gate' WHEN vx > 40 THEN 'vix_filter' END AS rej FROM oe)"""]


def orders_to_screen(spark, sf):
    """Orders with portfolio state derived from their own numbers, joined to return statistics of a symbol."""
    n = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("_ns"))
    o = with_row(table(spark, sf, "orders"), n)
    k, c = C("o_orderkey"), C("o_custkey")
    o = o.select("o_orderkey", F.concat(F.lit("S"), (c % C("_ns")).cast("string")).alias("symbol"), (F.when(k % 2 == 0, 1).otherwise(-1) * (C("o_totalprice") % 40) / 100).alias("size"), ((k % 45) / 100.0).alias("sector_exposure"),
                 ((c % 12) / 100.0).alias("atr"), F.lit(1.0).alias("price"), ((c % 100) / 100.0).alias("cash_pct"), ((k % 6) / 100.0).alias("stop_loss_pct"), ((c % 30) / 100.0).alias("gross_positions"), (0.5 + (k % 50) / 100.0).alias("confidence"),
                 ((k % 21) / 10.0).alias("leverage"), (-(c % 40) / 1000.0).alias("daily_pnl_pct"), ((k % 25) / 100.0).alias("drawdown"), (c % 50).cast("double").alias("vix"))
    b = bars(spark, sf)
    corr = rs.correlation_with_holdings(b.withColumn("ret", Series().pct("close")), current_book(spark, sf)).select(C("candidate").alias("symbol"), "max_corr")
    return o.join(rs.return_state(b), "symbol").join(corr, "symbol", "left").withColumn("max_corr", F.coalesce("max_corr", F.lit(0.0)))


@query("RSK-8", with_(ORD, f"SELECT o_orderkey, rej IS NULL AS approved, CAST(ns AS INTEGER) AS n_soft, rej AS rejected_by, {rnd('CASE WHEN rej IS NOT NULL THEN 0 ELSE least(greatest(CASE WHEN atr > 0 AND z > am THEN sign(size) * am ELSE size END * CASE WHEN ns > 0 THEN greatest(pow(0.5, ns), 0.1) ELSE 1 END, -0.25), 0.25) END', 7, 'final_size')} FROM oc"))
def rsk8(spark, sf):
    d = rs.screen_orders(orders_to_screen(spark, sf))
    return d.select("o_orderkey", "approved", "n_soft", "rejected_by", rd("final_size", 7).alias("final_size"))


CAP = [*REV, f"cp AS (SELECT symbol, abs({sharpe('net_return')}) AS sharpe, sum(turnover) / (count(*) / 252.0) / 40 AS t FROM bt GROUP BY symbol)", "ck AS (SELECT *, pow(t / 252.0 / 5e7, 0.6) * sqrt(252.0) * t AS k FROM cp)"]


def cap_solve(target, lo, hi):
    x = f"((1 - ({target}) / sharpe) / k)"
    return f"CASE WHEN {x} <= 0 THEN {lo} ELSE least(greatest(pow(greatest({x}, 0), 1 / 0.6), {lo}), {hi}) END"


@query("RSK-9", with_(CAP, "SELECT symbol, " + ", ".join([rnd(f"greatest(sharpe - sharpe * k * pow({c}, 0.6), 0)", 6, n) for n, c in (("sharpe_at_100k", "1e5"), ("sharpe_at_1m", "1e6"), ("sharpe_at_10m", "1e7"), ("sharpe_at_100m", "1e8"))])
  + f", {rnd(cap_solve('sharpe / 2', '1e5', '2.5e8'), 0, 'optimal_capacity_usd')}, {rnd(cap_solve('0.3', '1e5', '5e9'), 0, 'max_capacity_usd')}, {rnd('sharpe - 0.0015 * t * sqrt(252.0)', 6, 'sr_at_3x_slippage')}, CASE WHEN sharpe - 0.0015 * t * sqrt(252.0) >= 0.3 THEN 1 ELSE 0 END AS passes_slippage_gate FROM ck"))
def rsk9(spark, sf):
    a = reversal_run(spark, sf).groupBy("symbol").agg(F.abs(mt.sharpe("net_return")).alias("sharpe"), (F.sum("turnover") / (F.count(F.lit(1)) / 252.0) / 40).alias("turnover"))
    d = rs.capacity(a)
    return d.select("symbol", *[rd(c, 6).alias(c) for c in ("sharpe_at_100k", "sharpe_at_1m", "sharpe_at_10m", "sharpe_at_100m", "sr_at_3x_slippage")], *[rd(c, 0).alias(c) for c in ("optimal_capacity_usd", "max_capacity_usd")], "passes_slippage_gate")


EXITS = [*BT, f"a AS (SELECT *, CASE WHEN sign(position) <> coalesce(lag(sign(position)) {SER}, 0) THEN 1 ELSE 0 END AS nw FROM bt)", f"b AS (SELECT *, sum(nw) {PAST} AS trade_id FROM a)",
         "c AS (SELECT symbol, ts, close, CAST(trade_id AS BIGINT) AS trade_id, first_value(close) OVER w AS en, max(close) OVER w AS th FROM b WHERE position <> 0 WINDOW w AS (PARTITION BY symbol, trade_id ORDER BY ts ROWS UNBOUNDED PRECEDING))",
         "d AS (SELECT *, CASE WHEN (close - en) / (en + 1e-9) <= -0.02 THEN 'STOP_LOSS' WHEN (close - en) / (en + 1e-9) >= 0.01 AND close <= th * 0.985 THEN 'TRAIL_STOP' END AS why FROM c)",
         "e AS (SELECT symbol, trade_id, min(ts) AS entry_ts, max(ts) AS last_ts, max(th) AS high, min(CASE WHEN why IS NOT NULL THEN ts END) AS exit_ts FROM d GROUP BY 1, 2)"]


@query("RSK-10", with_(EXITS, "SELECT e.symbol, e.trade_id, entry_ts, last_ts, round(high + 1.7e-13, 10) + 0.0 AS high, exit_ts, why AS reason, round(d.close + 1.7e-13, 10) + 0.0 AS exit_price FROM e LEFT JOIN d ON d.symbol = e.symbol AND d.trade_id = e.trade_id AND d.ts = e.exit_ts"))
def rsk10(spark, sf):
    d = rs.exit_rules(open_trades(stock_run(spark, sf)), stop=0.02, activate=0.01, trail=0.015)
    return rounded(d, 10)


OC = [BARS, f"bv AS (SELECT *, stddev_samp(r) {last(21)} * sqrt(252.0) AS dv FROM (SELECT *, {pct('close')} AS r FROM bars))", "oj AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CASE WHEN l_linenumber % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CAST(l_quantity AS BIGINT) AS qty, bv.* FROM lineitem JOIN bv ON bv.symbol = 'S' || l_suppkey AND bv.ts = l_shipdate)",
      "ok AS (SELECT *, coalesce(dv, 0.2) AS v, greatest(coalesce(dv, 0.2) - 0.15, 0) AS ov, CASE side WHEN 'buy' THEN 1.0 ELSE -1.0 END AS sg, floor(volume * 0.1) AS cap FROM oj)",
      "om AS (SELECT *, 1 + 1.2 * ov AS mu, close - sg * close * 0.0004 * (1 + ov) AS lim FROM ok)"]


@query("RSK-11", with_(OC, f"""SELECT l_orderkey, l_linenumber, l_partkey, side, {rnd('mu', 7, 'slippage_mult')}, {rnd('lim', 7, 'limit_price')}, CASE WHEN (side = 'buy' AND low <= lim) OR (side = 'sell' AND high >= lim) THEN 1 ELSE 0 END AS limit_reached,
 {rnd('close + sg * (close * 0.0002 / 2 + close * 0.0005 * mu)', 7, 'fill_price')}, CAST(CASE WHEN cap <= 0 THEN 0 WHEN qty <= cap THEN qty WHEN cap < ceil(qty * 0.2) THEN 0 ELSE cap END AS BIGINT) AS fill_qty,
 CASE WHEN cap > 0 AND qty <= cap THEN '' WHEN cap <= 0 THEN 'no_day_volume' WHEN cap < ceil(qty * 0.2) THEN 'liquidity_too_thin' ELSE 'volume_capped_partial_fill' END AS fill_reason, {rnd('1 + sg * qty / greatest(volume, 1) * 100 / 10000', 8, 'impact_factor')} FROM om"""))
def rsk11(spark, sf):
    p = Series()
    b = bars(spark, sf).withColumn("_r", p.pct("close"))
    b = b.withColumn("day_vol", p.std("_r", 21, 2) * math.sqrt(252.0)).drop("_r")
    o = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat(F.lit("S"), C("l_suppkey").cast("string")).alias("symbol"), C("l_shipdate").alias("ts"),
                                            F.when(C("l_linenumber") % 2 == 0, "buy").otherwise("sell").alias("side"), C("l_quantity").cast("bigint").alias("qty"))
    d = rs.order_costs(o.join(b.withColumn("price", C("close")), ["symbol", "ts"]))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "side", rd("slippage_mult", 7).alias("slippage_mult"), rd("limit_price", 7).alias("limit_price"), "limit_reached", rd("fill_price", 7).alias("fill_price"), "fill_qty", "fill_reason", rd("impact_factor", 8).alias("impact_factor"))


SCH = ["oq AS (SELECT o_orderkey, round(o_totalprice / 100) AS qty, 0.5 + (o_custkey % 10) / 10.0 AS sigma, 1e-3 AS lam FROM orders)", "ok AS (SELECT *, sqrt(greatest(lam * sigma * sigma / (0.01 + 1e-12), 0)) AS k FROM oq)",
       "os AS (SELECT *, unnest(range(0, 11)) AS step FROM ok)", "ol AS (SELECT *, qty * (exp(k * (10 - step)) - exp(-k * (10 - step))) / (exp(k * 10) - exp(-k * 10)) AS remaining FROM os)",
       "od AS (SELECT *, lag(remaining) OVER (PARTITION BY o_orderkey ORDER BY step) - remaining AS sold FROM ol)"]


def liquidations(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(C("o_totalprice") / 100).alias("qty"), (0.5 + (C("o_custkey") % 10) / 10.0).alias("sigma"))


@query("RSK-12", with_(SCH, f"SELECT o_orderkey, CAST(step AS INTEGER) AS step, {rnd('remaining', 5, 'remaining')}, {rnd('sold', 5, 'sold')} FROM od"))
def rsk12(spark, sf):
    d = rs.execution_schedule(liquidations(spark, sf).withColumn("lam", F.lit(1e-3)))
    return rounded(d.select("o_orderkey", "step", "remaining", "sold"), 5)


@query("RSK-12b", with_(["oq AS (SELECT o_orderkey, round(o_totalprice / 100) AS qty, 0.5 + (o_custkey % 10) / 10.0 AS sigma, unnest(range(0, 20)) AS i FROM orders)", "oz AS (SELECT *, pow(10.0, -8 + 6 * i / 19.0) AS lam FROM oq)", SCH[1].replace("FROM oq", "FROM oz"), SCH[2], SCH[3],
  SCH[4].replace("PARTITION BY o_orderkey", "PARTITION BY o_orderkey, i"), "oc AS (SELECT o_orderkey, i, any_value(lam) AS lam, any_value(qty) AS q, any_value(sigma) AS s, sum(sold * sold) AS s2, sum(sold) AS s1, sum(CASE WHEN step < 10 THEN remaining * remaining END) AS x2 FROM od GROUP BY 1, 2)"],
  f"SELECT o_orderkey, {rnd('log10(lam)', 3, 'log_lam')}, {rnd('0.0005 * q * q + 0.01 * s2 + 0.0005 * s1', 3, 'expected_cost')}, {rnd('s * s * x2', 0, 'variance_cost')} FROM oc"))
def rsk12b(spark, sf):
    """Frontier over risk aversion: cost and variance of every order's schedule."""
    d = rs.frontier(liquidations(spark, sf), points=20, key="o_orderkey")
    c = rs.schedule_cost(rs.execution_schedule(d), ("o_orderkey", "lam"))
    return c.select("o_orderkey", rd(F.log10("lam"), 3).alias("log_lam"), rd("expected_cost", 3).alias("expected_cost"), rd("variance_cost", 0).alias("variance_cost"))


# six variants side by side ---------------------------------------------------------------------
@query("BT-17", with_([*VOLS, f"""vr AS (SELECT symbol, ts, close, variant, sg AS signal, sd FROM (SELECT symbol, ts, close, unnest([{{'n': 'baseline_theory', 's': signal::DOUBLE, 'c': 0.0::DOUBLE}}, {{'n': 'baseline_realistic', 's': signal::DOUBLE, 'c': 0.0008}}, {{'n': 'long_theory', 's': 1.0, 'c': 0.0}}, {{'n': 'long_realistic', 's': 1.0, 'c': 0.0008}},
  {{'n': 'risk_managed', 's': sign(signal) * abs({size_sql()}), 'c': 0.0008}}, {{'n': 'executed', 's': signal::DOUBLE, 'c': 0.0017}}]) AS x FROM vs), LATERAL (SELECT x.n AS variant, x.s AS sg, x.c AS sd))""", *bt("vr", "sd", "symbol, variant")],
  f"SELECT symbol, variant, {rnd(sharpe('net_return'), 6, 'sharpe')}, {rnd('sum(cost_drag)', 7, 'total_costs')} FROM bt GROUP BY symbol, variant"))
def bt17(spark, sf):
    d = rs.managed_positions(signals(spark, sf))
    st = bk.per_side("stock")
    v = {"baseline_theory": (C("signal"), 0.0), "baseline_realistic": (C("signal"), st), "long_theory": (F.lit(1), 0.0), "long_realistic": (F.lit(1), st), "risk_managed": (C("position_size"), st), "executed": (C("signal"), bk.per_side())}
    arr = F.array(*[F.struct(F.lit(k).alias("variant"), s.cast("double").alias("signal"), F.lit(c).alias("side")) for k, (s, c) in v.items()])
    d = d.select(*KEYS, "close", F.explode(arr).alias("_v")).select(*KEYS, "close", "_v.*")
    r = bk.run(d, C("side"), ("symbol", "variant"))
    return r.groupBy("symbol", "variant").agg(rd(mt.sharpe("net_return"), 6).alias("sharpe"), rd(F.sum("cost_drag"), 7).alias("total_costs"))


# drift -----------------------------------------------------------------------------------------
PSI = [*CAT, f"fn AS (SELECT *, CASE WHEN row_number() {SER} - 1 < floor(count(*) {ALL} * 0.7) THEN 'ref' ELSE 'cur' END AS part FROM cat)", f"lg AS ({unpivoted('part', 'fn')})",
       "ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [" + ", ".join(str(i / 10) for i in range(11)) + "]))) AS e FROM lg WHERE part = 'ref' GROUP BY feature)",
       "bn AS (SELECT lg.feature, least(len(list_filter(e, lambda x: x <= value)), len(e) - 1) AS b, count(CASE WHEN part = 'ref' THEN 1 END) AS r, count(CASE WHEN part = 'cur' THEN 1 END) AS c FROM lg JOIN ed ON lg.feature = ed.feature WHERE len(e) >= 3 AND value BETWEEN e[1] AND e[-1] GROUP BY 1, 2)",
       "bt2 AS (SELECT *, sum(r) OVER (PARTITION BY feature) AS tr, sum(c) OVER (PARTITION BY feature) AS tc FROM bn)", "bs AS (SELECT *, least(greatest(r / tr, 1e-6), 1) AS rp, least(greatest(c / tc, 1e-6), 1) AS cp FROM bt2)",
       "ps AS (SELECT feature, sum((cp - rp) * ln(cp / rp)) AS psi, CAST(max(tr) AS BIGINT) AS n_ref, CAST(max(tc) AS BIGINT) AS n_cur FROM bs GROUP BY feature)"]


@query("VAL-9", with_(PSI, f"SELECT feature, {rnd('psi', 8, 'psi')}, n_ref, n_cur FROM ps"))
def val9(spark, sf):
    return rounded(drift.psi(streamed(spark, sf, panel=drift.parted(bars(spark, sf))), COLUMNS), 8)


@query("VAL-10", with_(PSI, f"""SELECT {rnd('avg(psi)', 8, 'mean_psi')}, {rnd('max(psi)', 8, 'max_psi')}, count(CASE WHEN psi > 0.001 THEN 1 END) AS n_drifted, (SELECT string_agg(feature, ',' ORDER BY psi DESC, feature DESC) FROM (SELECT * FROM ps ORDER BY psi DESC, feature DESC LIMIT 5)) AS top_drifted,
 CASE WHEN count(CASE WHEN psi > 0.001 THEN 1 END) > 0 THEN 1 ELSE 0 END AS drift_alert, CASE WHEN max(psi) >= 15 THEN 'HALT' WHEN max(psi) >= 9 THEN 'RETRAIN' WHEN max(psi) >= 2.5 THEN 'WARN' WHEN max(psi) >= 1 THEN 'WATCH' ELSE 'NONE' END AS severity FROM ps"""))
def val10(spark, sf):
    return rounded(drift.drift_report(drift.psi(streamed(spark, sf, panel=drift.parted(bars(spark, sf))), COLUMNS), 0.001), 8)


# machine learning ------------------------------------------------------------------------------
MI = [*CAT, f"lg AS ({unpivoted('label', where=' WHERE label IS NOT NULL')})", "ed AS (SELECT feature, quantile_cont(value, [" + ", ".join(str(i / 10) for i in range(1, 10)) + "]) AS e FROM lg GROUP BY feature)",
      "cn AS (SELECT lg.feature, len(list_filter(e, lambda x: x < value)) AS b, label, count(*)::DOUBLE AS n FROM lg JOIN ed ON lg.feature = ed.feature GROUP BY 1, 2, 3)",
      "cw AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS nb, sum(n) OVER (PARTITION BY feature, label) AS ny FROM cn)", "mi AS (SELECT feature, sum(n / t * ln(n * t / (nb * ny))) AS mi FROM cw GROUP BY feature)"]


def model_frame(spark, sf):
    return catalogue(spark, sf)


@query("ML-1", with_(MI, f"SELECT feature, {rnd('mi', 8, 'mi')} FROM mi"))
def ml1(spark, sf):
    return rounded(ml.mutual_information(streamed(spark, sf), COLUMNS, "label"), 8)


@query("ML-1b", with_([*CAT, f"fb AS (SELECT *, least(floor((row_number() {SER} - 1) * 3 / count(*) {ALL}), 2) AS block FROM cat)", f"lg AS ({unpivoted('block, label', 'fb', ' WHERE label IS NOT NULL')})",
  "ed AS (SELECT block, feature, quantile_cont(value, [" + ", ".join(str(i / 10) for i in range(1, 10)) + "]) AS e FROM lg GROUP BY 1, 2)", "cn AS (SELECT lg.block, lg.feature, len(list_filter(e, lambda x: x < value)) AS b, label, count(*)::DOUBLE AS n FROM lg JOIN ed ON lg.feature = ed.feature AND lg.block = ed.block GROUP BY 1, 2, 3, 4)",
  "cw AS (SELECT *, sum(n) OVER (PARTITION BY block, feature) AS t, sum(n) OVER (PARTITION BY block, feature, b) AS nb, sum(n) OVER (PARTITION BY block, feature, label) AS ny FROM cn)", "mb AS (SELECT block, feature, sum(n / t * ln(n * t / (nb * ny))) AS mi FROM cw GROUP BY 1, 2)"],
  f"SELECT feature, {rnd('median(mi) / (1 + stddev_pop(mi) / (median(mi) + 1e-8))', 8, 'mi')} FROM mb GROUP BY feature"))
def ml1b(spark, sf):
    return rounded(ml.stable_mi(streamed(spark, sf, panel=ml.time_blocks(bars(spark, sf))), COLUMNS, "label"), 8)


@query("ML-2")
def ml2(spark, sf):
    d = model_frame(spark, sf)
    return ml.combined_rank(ml.mutual_information(d, COLUMNS, "label"), ml.tree_importance(d.where("label IS NOT NULL"), COLUMNS, "label"))


@query("ML-3")
def ml3(spark, sf):
    """Features by information with the label, greedily pruned where they correlate with a better one."""
    d = model_frame(spark, sf)
    order = [r["feature"] for r in ml.mutual_information(d, COLUMNS, "label").orderBy(F.desc(F.round("mi", 9)), "feature").collect()]     # one name per feature
    return rounded(d.select(*KEYS, *ml.prune_correlated(d, order, 0.80, 15)))


@query("ML-4")
def ml4(spark, sf):
    """Selection fitted on the first 70 % of each symbol's bars, applied to all of them."""
    p = Series()
    d = catalogue(spark, sf, panel=bars(spark, sf).withColumns({"_rn": p.row(), "_n": F.count(F.lit(1)).over(p.whole)}))
    train = d.where(C("_rn") < C("_n") * 0.7)
    return rounded(ml.FeatureSelector(n=15, max_corr=0.85).fit(train, COLUMNS, "label").transform(d))


QS5 = "[0.01, 0.25, 0.5, 0.75, 0.99]"
SCALE = [*CAT, f"lg AS ({unpivoted('symbol')})", f"qs AS (SELECT feature, quantile_cont(value, {QS5}) AS q FROM lg GROUP BY feature)"]
SCALED = f"count(*) AS n, {rnd('min(z)', 5, 'least')}, {rnd('avg(z)', 5, 'mean')}, {rnd('max(z)', 5, 'most')}"


def scaled_summary(d):
    """What scaling made of every value, by symbol and feature."""
    long = d.select("symbol", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), C(f).alias("z")) for f in COLUMNS])).alias("x")).select("symbol", "x.*").where("z IS NOT NULL")
    return rounded(long.groupBy("symbol", "feature").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("least"), F.avg("z").alias("mean"), F.max("z").alias("most")), 5)


@query("ML-5", with_([*SCALE, "sc AS (SELECT symbol, lg.feature, (least(greatest(value, q[1]), q[5]) - q[3]) / greatest(q[4] - q[2], 1e-8) AS z FROM lg JOIN qs ON lg.feature = qs.feature)"], f"SELECT symbol, feature, {SCALED} FROM sc GROUP BY 1, 2"))
def ml5(spark, sf):
    d = model_frame(spark, sf)
    return scaled_summary(ml.robust_scale(d, COLUMNS, ml.scaler_stats(d, COLUMNS)))


@query("ML-5b", with_([*CAT, *[c for c in PROBA if c != BARS], "cr AS (SELECT cat.*, prn.regime FROM cat JOIN (SELECT symbol, ts, regime FROM prn) prn USING (symbol, ts))", f"lg AS ({unpivoted('symbol, regime', 'cr')})",
  f"g AS (SELECT feature, quantile_cont(value, {QS5}) AS q FROM lg GROUP BY feature)", f"r AS (SELECT regime, feature, quantile_cont(value, {QS5}) AS q FROM lg GROUP BY regime, feature HAVING count(*) >= 50)",
  "sc AS (SELECT symbol, lg.feature, (least(greatest(value, coalesce(r.q, g.q)[1]), coalesce(r.q, g.q)[5]) - coalesce(r.q, g.q)[3]) / greatest(coalesce(r.q, g.q)[4] - coalesce(r.q, g.q)[2], 1e-8) AS z FROM lg JOIN g ON lg.feature = g.feature LEFT JOIN r ON r.feature = lg.feature AND r.regime = lg.regime)"],
  f"SELECT symbol, feature, {SCALED} FROM sc GROUP BY 1, 2"))
def ml5b(spark, sf):
    d = catalogue(spark, sf, panel=with_regime(bars(spark, sf)))
    return scaled_summary(ml.robust_scale(d, COLUMNS, ml.scaler_stats(d, COLUMNS), ml.scaler_stats(d, COLUMNS, "regime")))


@query("ML-6", with_([BARS, f"w AS (SELECT symbol, ts, exp(-least((count(*) {ALL} - row_number() {SER}) / 63.0, 4.6)) AS w FROM bars)"], f"SELECT symbol, ts, {rnd(f'w / avg(w) {ALL}', 7, 'recency_weight')} FROM w"))
def ml6(spark, sf):
    return rounded(ml.recency_weights(bars(spark, sf)).select(*KEYS, "recency_weight"), 7)


@query("ML-7", with_([*PROBA, "c AS (SELECT count(CASE WHEN label = 0 THEN 1 END)::DOUBLE / count(CASE WHEN label = 1 THEN 1 END) AS w FROM prn)"], "SELECT symbol, ts, CASE WHEN regime IN (0, 2) THEN 2.0 WHEN regime = 3 THEN 1.5 ELSE 1.0 END::DOUBLE AS regime_weight, " + rnd("CASE WHEN label = 1 THEN w ELSE 1 END", 7, "class_weight") + " FROM prn, c"))
def ml7(spark, sf):
    d = ml.class_weight(scored(spark, sf), "label")
    return d.select(*KEYS, ml.regime_weight().alias("regime_weight"), rd("class_weight", 7).alias("class_weight"))


def trained(spark, sf):
    """The training run over the whole catalogue, three folds of two years; weights favour bull and bear regimes."""
    def build():
        d = catalogue(spark, sf, panel=with_regime(bars(spark, sf))).withColumn("weight", ml.regime_weight())
        return tr.train(d, COLUMNS, sp.month_folds(d, 24, 12, 1, 18).collect())     # a handful of date ranges
    return once(spark, "trained", sf, build)


@query("ML-8")
def ml8(spark, sf):
    s = trained(spark, sf).scores
    return s.select(*KEYS, "fold", *[F.round(C("member_p")[i], 6).alias(f"p{i}") for i in range(3)])


@query("ML-8b")
def ml8b(spark, sf):
    """The final model saved, loaded again, applied to all bars, and its signal run through the backtest."""
    path = f"{scratch(spark)}/model"
    trained(spark, sf).save(path)
    d = tr.TrainedModel.load(spark, path).score(catalogue(spark, sf).where("label IS NOT NULL"))
    run = bk.run(d.select(*KEYS, "close", "signal"), bk.cost("stock"))
    return rounded(mt.all_metrics(run, ("symbol",)), 5)


# members trained in closed form on the same folds, so that scores and all that is done with them have an exact SQL answer
MEM = [*CAT, "sp AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM cat)", "fk AS (SELECT a, b, unnest(range(0, 60)) AS i FROM sp)",
       "f1 AS (SELECT b, i, CAST(a + to_months(CAST(18 * i AS INTEGER)) AS DATE) AS ts0 FROM fk)", "f2 AS (SELECT *, CAST(ts0 + INTERVAL 24 MONTH AS DATE) - 1 AS te FROM f1)",
       "f3 AS (SELECT *, CAST(te + INTERVAL 1 MONTH AS DATE) + 1 AS us FROM f2)", "f4 AS (SELECT *, CAST(us + INTERVAL 12 MONTH AS DATE) - 1 AS ue FROM f3)",
       "fo AS MATERIALIZED (SELECT CAST(i + 1 AS INTEGER) AS fold, ts0::TIMESTAMP AS ts0, te::TIMESTAMP AS te, us::TIMESTAMP AS us, ue::TIMESTAMP AS ue FROM f4 WHERE ue <= b)",
       f"lt AS ({unpivoted('ts, label', where=' WHERE label IS NOT NULL')})",
       "fc AS (SELECT fold, feature, corr(value, label) AS c, regr_slope(label, value) AS sl, regr_intercept(label, value) AS ic, count(*) AS n FROM lt JOIN fo ON ts BETWEEN ts0 AND te GROUP BY 1, 2)",
       "fm AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(abs(c), 9) DESC, feature) AS k FROM fc WHERE n >= 50 AND NOT isnan(c) QUALIFY k <= 3)",
       f"tv AS ({unpivoted('symbol, ts, label, fwd_return')})",
       "mb AS MATERIALIZED (SELECT symbol, ts, label, fwd_return, fold, list(least(greatest(ic + sl * value, 0.01), 0.99) ORDER BY k) AS p FROM tv JOIN fm USING (feature) JOIN fo USING (fold) WHERE ts BETWEEN us AND ue GROUP BY ALL HAVING count(*) = 3)",
       "ms AS (SELECT *, (p[1] + p[2] + p[3]) / 3 AS m, sqrt((p[1] * p[1] + p[2] * p[2] + p[3] * p[3]) / 3 - pow((p[1] + p[2] + p[3]) / 3, 2)) AS s, list_sort(p) AS o FROM mb)"]


def member_frame(spark, sf):
    """Out-of-sample scores of three members that each fold trained on its own two years."""
    folds = sp.month_folds(bars(spark, sf), 24, 12, 1, 18)
    rows = sp.assign_month_folds(streamed(spark, sf), folds)
    members = tr.linear_members(rows.where("split = 'train' AND label IS NOT NULL"), COLUMNS, folds=[(r["fold"],) for r in folds.collect()])
    return tr.linear_scores(rows.where("split = 'test'"), members, COLUMNS).select(*KEYS, "fold", "label", "fwd_return", "member_p")


@query("ML-9", with_(MEM, f"SELECT symbol, ts, fold, {rnd('m', 7, 'score_mean')}, {rnd('s', 6, 'score_std')}, {rnd('o[1] + 0.2 * (o[2] - o[1])', 7, 'score_lower')}, {rnd('o[2] + 0.8 * (o[3] - o[2])', 7, 'score_upper')}, {rnd('(2 * p[1] + p[2] + p[3]) / 4', 7, 'weighted')} FROM ms"))
def ml9(spark, sf):
    d = member_frame(spark, sf)
    w = ml.ensemble_score("member_p", F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0)))["score_mean"]
    s = ml.ensemble_score("member_p")
    return d.select(*KEYS, "fold", *[rd(e, 6 if k == "score_std" else 7).alias(k) for k, e in s.items()], rd(w, 7).alias("weighted"))


MW = [*MEM, "me AS (SELECT fold, fwd_return AS y, unnest([0, 1, 2]) AS member, unnest(p) AS pr FROM mb WHERE fwd_return IS NOT NULL)", "mf AS (SELECT fold, member, avg(y * sign(pr - 0.5)) / (stddev_samp(y * sign(pr - 0.5)) + 1e-12) * sqrt(252.0) AS s FROM me GROUP BY 1, 2)",
      "ma AS (SELECT member, avg(s) AS sharpe FROM mf GROUP BY member)", "mx AS (SELECT *, exp(greatest(sharpe - (SELECT max(sharpe) FROM ma), -10)) AS e FROM ma)"]


@query("ML-10", with_(MW, f"SELECT CAST(member AS INTEGER) AS member, {rnd('sharpe', 5, 'sharpe')}, {rnd('e / (SELECT sum(e) FROM mx)', 6, 'weight')} FROM mx"))
def ml10(spark, sf):
    d = ml.member_weights(member_frame(spark, sf).where("fwd_return IS NOT NULL"))
    return d.select("member", rd("sharpe", 5).alias("sharpe"), rd("weight", 6).alias("weight"))


@query("ML-11")
def ml11(spark, sf):
    """Calibration of the run, on the rows it was fitted on."""
    m = trained(spark, sf)
    return ml.calibrate(m.scores, m.calibrator).select(*KEYS, "fold", F.round("score_mean", 6).alias("score_mean"), F.round("calibrated", 6).alias("calibrated"))


@query("ML-12")
def ml12(spark, sf):
    """Meta model trained on the scores of all folds but the last, applied to the last."""
    s = trained(spark, sf).scores
    s = with_row(s, s.agg(F.max("fold").alias("_last")))
    names = ["score_mean", "score_std"]
    m = ml.meta_model(s.where("fold < _last").drop("_last"), names)
    return ml.meta_probability(s.where("fold = _last"), m, names).select(*KEYS, F.round("meta_p", 6).alias("meta_p"))


@query("ML-13", with_(MEM, f"SELECT symbol, ts, fold, {rnd('least(greatest(2 * abs(m - 0.5) * (1 - least(greatest(s / 0.5, 0), 1)), 0), 1)', 6, 'confidence')} FROM ms"))
def ml13(spark, sf):
    s = ml.ensemble_score("member_p")
    return member_frame(spark, sf).select(*KEYS, "fold", rd(ml.confidence(s["score_mean"], s["score_std"]), 6).alias("confidence"))


@query("ML-14", with_(MEM, "SELECT symbol, ts, fold, CAST(CASE WHEN round(least(greatest(2 * abs(m - 0.5) * (1 - least(greatest(s / 0.5, 0), 1)), 0), 1), 9) >= 0.1 THEN sign(m - 0.5) ELSE 0 END AS INTEGER) AS signal, CASE WHEN m > 0.55 THEN 1 WHEN m < 0.45 THEN -1 ELSE 0 END AS plain FROM ms"))
def ml14(spark, sf):
    s = ml.ensemble_score("member_p")
    d = member_frame(spark, sf).withColumn("m", s["score_mean"]).withColumn("conf", F.round(ml.confidence("m", s["score_std"]), 9))
    return d.select(*KEYS, "fold", ml.signal("m", "conf", 0.1).alias("signal"), ml.threshold_signal("m").alias("plain"))


def stack_sql(rounds: int = 10) -> list[str]:
    """Newton's steps for a logistic model of y on x1, x2, x3 (table va) per fold, ridge 1 on the weights: n0 .. n<rounds>."""
    out = ["n0 AS (SELECT fold, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3 FROM va GROUP BY fold HAVING min(y) < max(y))"]
    h = ", ".join(f"sum(v * {'x%d' % i if i else 1} * {'x%d' % j if j else 1}) + {int(i == j and i > 0)} AS h{i}{j}" for i in range(4) for j in range(i, 4))
    g = ", ".join(f"sum((y - q) * {'x%d' % i if i else 1}) - {'any_value(b%d)' % i if i else 0} AS g{i}" for i in range(4))
    for r in range(rounds):
        out.append(f"g{r} AS MATERIALIZED (SELECT fold, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, any_value(b3) AS b3, {g}, {h} FROM (SELECT *, q * (1 - q) AS v FROM (SELECT va.*, b0, b1, b2, b3, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2 + b3 * x3))) AS q FROM va JOIN n{r} USING (fold))) GROUP BY fold)")
        out.append(f"""n{r + 1} AS MATERIALIZED (SELECT fold, b0 + d0 AS b0, b1 + d1 AS b1, b2 + d2 AS b2, b3 + d3 AS b3 FROM (SELECT *, (c1 - a12 * d2 - a13 * d3) / a11 AS d1, (g0 - h01 * d1 - h02 * d2 - h03 * d3) / h00 AS d0
          FROM (SELECT *, (k3 - e23 / e22 * k2) / (e33 - e23 / e22 * e23) AS d3, (k2 - e23 * d3) / e22 AS d2
          FROM (SELECT *, a22 - a12 / a11 * a12 AS e22, a23 - a12 / a11 * a13 AS e23, a33 - a13 / a11 * a13 AS e33, c2 - a12 / a11 * c1 AS k2, c3 - a13 / a11 * c1 AS k3
          FROM (SELECT *, h11 - h01 / h00 * h01 AS a11, h12 - h01 / h00 * h02 AS a12, h13 - h01 / h00 * h03 AS a13, h22 - h02 / h00 * h02 AS a22, h23 - h02 / h00 * h03 AS a23, h33 - h03 / h00 * h03 AS a33,
            g1 - h01 / h00 * g0 AS c1, g2 - h02 / h00 * g0 AS c2, g3 - h03 / h00 * g0 AS c3 FROM g{r})))))""")
    return out


# the last fifth of a fold's training dates is kept from the members: weights and stacking are fitted on it
HELD = [c.replace("te::TIMESTAMP AS te,", "te::TIMESTAMP AS te, (ts0 + CAST(floor((date_diff('day', ts0, te) + 1) * 0.8) AS INTEGER))::TIMESTAMP AS vs,") if c.startswith("fo AS") else
        c.replace("ts BETWEEN ts0 AND te", "ts >= ts0 AND ts < vs") if c.startswith("fc AS") else
        c.replace("fwd_return, fold,", "fwd_return, fold, ts > te AS test,").replace("ts BETWEEN us AND ue", "(ts BETWEEN vs AND te OR ts BETWEEN us AND ue)") if c.startswith("mb AS") else c for c in MEM[:-1]]
HELD += ["va AS MATERIALIZED (SELECT fold, label::DOUBLE AS y, p[1] AS x1, p[2] AS x2, p[3] AS x3, p FROM mb WHERE NOT test AND label IS NOT NULL)",
         "ac AS (SELECT fold, member, greatest(avg(CASE WHEN (pr > 0.5)::INT = y THEN 1.0 ELSE 0.0 END) - 0.5, 0) AS e FROM (SELECT fold, y, unnest([0, 1, 2]) AS member, unnest(p) AS pr FROM va) GROUP BY 1, 2)",
         "aw AS MATERIALIZED (SELECT fold, list(CASE WHEN t > 1e-9 THEN e / t ELSE 1.0 / 3 END ORDER BY member) AS w FROM (SELECT *, sum(e) OVER (PARTITION BY fold) AS t FROM ac) GROUP BY fold)",
         *stack_sql(), f"en AS (SELECT symbol, ts, fold, CASE WHEN w IS NULL THEN (p[1] + p[2] + p[3]) / 3 ELSE (p[1] * w[1] + p[2] * w[2] + p[3] * w[3]) / (w[1] + w[2] + w[3]) END AS average, 1 / (1 + exp(-(b0 + b1 * p[1] + b2 * p[2] + b3 * p[3]))) AS stack, ((p[1] > 0.5)::INT + (p[2] > 0.5)::INT + (p[3] > 0.5)::INT) / 3.0 AS vote FROM mb LEFT JOIN aw USING (fold) LEFT JOIN n10 USING (fold) WHERE test)"]


def held_out_frame(rows, columns, folds=None):
    """Scores (symbol, ts, fold, split, label, member_p) of three members fitted on the rows of each fold before ``valid_from``, for the
    training rows from there on (split valid) and the test rows."""
    rows = rows.withColumn("split", F.when((C("split") == "train") & (C("ts") >= C("valid_from")), "valid").otherwise(C("split")))
    members = tr.linear_members(rows.where("split = 'train' AND label IS NOT NULL"), columns, folds=folds)
    return tr.linear_scores(rows.where("split <> 'train'"), members, columns).select(*KEYS, "fold", "split", "label", "member_p")


def blended(scores):
    """Average by the accuracy on the fold's held-out rows, stacking fitted on them, and vote, of the test rows."""
    held = cut_lineage(scores.where("split = 'valid' AND label IS NOT NULL").select("fold", "label", "member_p"))
    w = ml.accuracy_weights(held, keys=("fold",)).groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("member", "weight"))), lambda s: s["weight"]).alias("w"))
    coef = ml.stack_weights(held, 3)
    # one row a fold each
    d = scores.where("split = 'test'").join(F.broadcast(w), "fold", "left").join(F.broadcast(coef), "fold", "left")
    average = ml.ensemble_score("member_p", C("w"))["score_mean"]
    return d.select(*KEYS, "fold", average.alias("average"), F.coalesce(ml.stacked_score("coef"), average).alias("stack"), ml.vote("member_p").alias("vote"))


@query("ML-15", with_(HELD, f"SELECT symbol, ts, fold, {rnd('average', 6, 'average')}, {rnd('coalesce(stack, average)', 6, 'stack')}, {rnd('vote', 6, 'vote')} FROM en"))
def ml15(spark, sf):
    folds = sp.month_folds(bars(spark, sf), 24, 12, 1, 18)
    days = F.date_diff(C("train_end").cast("date"), C("train_start").cast("date")) + 1
    folds = folds.withColumn("valid_from", F.date_add(C("train_start").cast("date"), F.floor(days * 0.8).cast("int")).cast("timestamp_ntz"))
    return rounded(blended(held_out_frame(sp.assign_month_folds(streamed(spark, sf), folds), COLUMNS, [(r["fold"],) for r in folds.collect()])))


@query("ML-15b")
def ml15b(spark, sf):
    """Linear model on the members' scores of all folds but the last, applied to the last."""
    s = trained(spark, sf).scores
    s = with_row(s, s.agg(F.max("fold").alias("_last")))
    return ml.stacked(s.where("fold = _last"), ml.stack(s.where("fold < _last"), 3), 3).select(*KEYS, F.round("stacked", 6).alias("stacked"))


@query("ML-16")
def ml16(spark, sf):
    """One pooled model over all symbols, features selected and members fitted on the first 70 % of the dates, scored afterwards."""
    d = model_frame(spark, sf).where("label IS NOT NULL")
    a, b = d.agg(F.min("ts"), F.max("ts")).first()
    cut, val = a + (b - a) * 0.7, a + (b - a) * 0.6
    fitted = d.where(C("ts") < F.lit(cut))
    names = ml.FeatureSelector(15).fit(fitted, COLUMNS, "label").selected
    members = tr.fit(fitted.select(*KEYS, "label", *names), names, "label", 2, 42, val)
    s = ml.score_members(ml.assemble(d.where(C("ts") >= F.lit(cut)).select(*KEYS, "label", *names), names, "label"), members)
    return s.select(*KEYS, *[F.round(e, 6).alias(k) for k, e in ml.ensemble_score("member_p").items()])


_B = ", ".join(f"avg({f}) AS {f}" for f in COLUMNS)
ATT = [*CAT, *SIG[1:], "sg AS (SELECT cat.*, sig.signal FROM cat JOIN (SELECT symbol, ts, signal FROM sig) sig USING (symbol, ts))", f"b0 AS (SELECT 1 AS one, {_B} FROM sg)", f"bs AS ({unpivoted('one', 'b0')})", f"lg AS ({unpivoted('symbol, ts, signal', 'sg')})",
       "att AS MATERIALIZED (SELECT symbol, ts, lg.feature, round(abs(lg.value - bs.value) * sign((lg.value - bs.value) * signal + 1e-9), 9) AS imp FROM lg JOIN bs ON lg.feature = bs.feature)",
       "ar AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY abs(imp) DESC, feature) AS k FROM att WHERE abs(imp) >= 1e-10 QUALIFY k <= 3)"]


def attributions(spark, sf):
    return ml.attribution(streamed(spark, sf, panel=signals(spark, sf)), COLUMNS)


@query("ML-17", with_(ATT, "SELECT symbol, feature, count(*) AS n, count(CASE WHEN imp > 0 THEN 1 END) AS n_bullish, round(max(abs(imp)), 6) AS strongest FROM att WHERE abs(imp) >= 1e-10 GROUP BY 1, 2"))
def ml17(spark, sf):
    """Every contribution of every row, counted by symbol and feature."""
    d = ml.attribution_rows(attributions(spark, sf))
    return d.groupBy("symbol", "feature").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("direction") == "bullish").alias("n_bullish"), F.round(F.max(F.abs("importance")), 6).alias("strongest"))


@query("TOP-9", with_(ATT, "SELECT symbol, ts, string_agg(feature, ',' ORDER BY k) AS top FROM ar GROUP BY symbol, ts"))
def top9(spark, sf):
    t = ml.top_attributions(attributions(spark, sf), 3)
    return t.select(*KEYS, F.concat_ws(",", F.transform("top", lambda x: x["feature"])).alias("top"))


@query("AGG-27", with_([*ATT, "nw AS (SELECT symbol, ts FROM (SELECT DISTINCT symbol, ts FROM ar) ORDER BY ts DESC, symbol LIMIT 30)"],
  f"SELECT feature, {rnd('avg(abs(imp))', 5, 'mean_abs_importance')}, count(*) AS n_appearances FROM ar JOIN nw USING (symbol, ts) GROUP BY feature"))
def agg27(spark, sf):
    return rounded(ml.importance_summary(ml.top_attributions(attributions(spark, sf), 3), 30), 5)


@query("ML-18")
def ml18(spark, sf):
    """Train report: per fold dates, rows, features, score and strategy figures of the model and of the momentum baseline."""
    return rounded(tr.report(trained(spark, sf), signals(spark, sf)), 4)


# streams ---------------------------------------------------------------------------------------
WB = "date_trunc('hour', ts)"


@query("STF-7", f"""SELECT {WB} AS "start", {WB} + INTERVAL 1 HOUR AS "end", event_type, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, {rnd('sum(value)', 6, 'volume')}, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def stf7(spark, sf):
    """The stream function on the whole table as a batch frame."""
    return rounded(sb.window_bars(as_stream_rows(spark, sf)).withColumns({"start": C("start").cast("timestamp_ntz"), "end": C("end").cast("timestamp_ntz")}))


def as_stream_rows(spark, sf):
    return events(spark, sf).withColumn("ts", C("ts").cast("timestamp"))


@query("STF-7b", """WITH w AS (SELECT *, date_trunc('hour', ts) + INTERVAL 30 MINUTE * (minute(ts) // 30) AS last_start FROM events)
SELECT s AS "start", event_type, count(*) AS n, max(value) AS high FROM (SELECT *, unnest([last_start, last_start - INTERVAL 30 MINUTE]) AS s FROM w) GROUP BY 1, 2""")
def stf7b(spark, sf):
    """Sliding hourly windows every 30 minutes."""
    d = sb.window_bars(as_stream_rows(spark, sf), slide="30 minutes")
    return d.select(C("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "high")


@query("STF-8", """WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS nw FROM events),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value) + 1.7e-9, 6) + 0.0 AS value FROM s GROUP BY user_id, k""")
def stf8(spark, sf):
    d = sb.sessions(as_stream_rows(spark, sf))
    return rounded(d.withColumns({"start": C("start").cast("timestamp_ntz"), "end": C("end").cast("timestamp_ntz")}))


@query("STF-9", """WITH l AS (SELECT user_id, arg_max(event_type, row(ts, event_id)) AS latest FROM events GROUP BY user_id) SELECT event_id, events.user_id, value, latest FROM events LEFT JOIN l ON l.user_id = events.user_id""")
def stf9(spark, sf):
    e = events(spark, sf)
    latest = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    return sb.enrich(e, latest, "user_id").select("event_id", "user_id", "value", "latest")


@query("STF-10", f"WITH {BARS} SELECT symbol, ts, close FROM bars")
def stf10(spark, sf):
    b = bars(spark, sf).select(*KEYS, "close")
    return sb.drop_duplicate_bars(b.unionByName(b.where(F.day("ts") < 15)))


# user functions --------------------------------------------------------------------------------
@query("UDF-1", with_(WFM, f"SELECT symbol, CAST(fold AS INTEGER) AS fold, split, {rnd('sharpe_ratio', 6, 'sharpe_ratio')} FROM met"))
def udf1(spark, sf):
    b = bars(spark, sf)
    strategy = user.strategy(lambda d, p: sp.momentum_signal(d, p=p))
    return rounded(sp.walk_forward(b, sp.bar_folds(b), strategy).select("symbol", "fold", "split", "sharpe_ratio"))


@query("UDF-2", chain([BARS], "bars", [{"r5": pct("close", 5), "v20": mean("volume", 20)}], f"SELECT symbol, ts, {rnd('r5 * volume / v20', 7, 'flow')}, false AS looks_ahead FROM {{last}}"))
def udf2(spark, sf):
    """A registered factor with the verdict of the look-ahead check: whether any value up to the middle of the panel changes when the bars
    behind it are taken away."""
    @user.factor("flow")
    def flow(p):
        return [{"_r5": p.pct("close", 5), "_v20": p.mean("volume", 20)}, {"flow": C("_r5") * C("volume") / C("_v20")}]
    b = bars(spark, sf)
    middle = b.agg(F.timestamp_micros(((F.min(F.unix_micros(C("ts").cast("timestamp"))) + F.max(F.unix_micros(C("ts").cast("timestamp")))) / 2).cast("bigint")).cast("timestamp_ntz")).first()[0]
    moved = user.looks_ahead(b, "flow", middle).agg((F.count(F.lit(1)) > 0).alias("looks_ahead"))
    return with_row(rounded(user.compute(b, ["flow"]).select(*KEYS, "flow"), 7), moved)


@query("UDF-3", chain([BARS], "bars", [{"u": f"CASE WHEN close > {lag('close')} THEN 1.0 ELSE 0.0 END"}, {"f": f"CASE WHEN count(close) {last(10)} >= 10 THEN sum(u) {last(9)} / 9.0 END"}], f"SELECT symbol, ts, {rnd('f', 7, 'rises')} FROM {{last}}"))
def udf3(spark, sf):
    return rounded(user.rolling_apply(bars(spark, sf), "close", 10, user.share_of_rises, "rises").select(*KEYS, "rises"), 7)


@query("UDF-4", chain([BARS], "bars", [{"a": sflag(f"close > {lag('close', 1)}"), "b": sflag(f"close > {lag('close', 5)}"), "c": sflag(f"close > {lag('close', 21)}")}], f"SELECT symbol, ts, {rnd('greatest(a + b + c, 3 - a - b - c) / 3.0', 7, 'agree')} FROM {{last}}"))
def udf4(spark, sf):
    p = Series()
    d = bars(spark, sf).withColumn("v", F.array(*[flag(C("close") > p.lag("close", n)) for n in (1, 5, 21)]))
    up = F.aggregate("v", F.lit(0), lambda s, x: s + x)
    return rounded(d.select(*KEYS, (F.greatest(up, 3 - up) / 3.0).alias("agree")), 7)


@query("UDF-5", with_(BT, f"SELECT symbol, {rnd(annual('net_return'), 6, 'annualised_return')}, {rnd(sharpe('net_return'), 6, 'sharpe_ratio')} FROM bt GROUP BY symbol"))
def udf5(spark, sf):
    return rounded(stock_run(spark, sf).groupBy("symbol").agg(mt.annualised_return("net_return").alias("annualised_return"), mt.sharpe("net_return").alias("sharpe_ratio")))


@query("UDF-6", with_([BARS], "SELECT symbol, CAST(unnest(range(0, CAST(count(*) // 100 AS BIGINT))) AS INTEGER) AS part, count(*) AS n FROM bars GROUP BY symbol"))
def udf6(spark, sf):
    n = bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return n.select("symbol", F.explode(F.sequence(F.lit(0), (F.floor(C("n") / 100) - 1).cast("int"))).alias("part"), "n")
