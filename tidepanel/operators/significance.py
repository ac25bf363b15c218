"""Significance and overfitting statistics on tables of runs or folds."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.normal import EULER_MASCHERONI, let, norm_cdf, norm_cdf_unscaled, norm_ppf, norm_ppf_precise
from ..functions.scale import with_row
from ..functions.windows import Series, col, corr_agg, flag, nz
from . import metrics

C = F.col
G = EULER_MASCHERONI


def sharpe_tstat(df: DataFrame, sharpe="sharpe", n_bars="n_bars", year: int = 252) -> DataFrame:
    yrs = col(n_bars) / float(year)
    few = (yrs < 0.1) | (col(n_bars) < 2)
    t = F.when(few, 0.0).otherwise(col(sharpe) * F.sqrt(yrs))
    p = F.when(few, 1.0).otherwise(1.0 - norm_cdf_unscaled(t))
    return df.withColumns({"t_stat": F.round(t, 4), "p_value": F.round(p, 4), "n_years": F.round(yrs, 2), "significant_at_05": flag(p < 0.05)})


def _psr_z(sharpe, n, skew, kurt, bench, year=252) -> Column:
    r = math.sqrt(year)
    sd, sb = col(sharpe) / r, bench / r
    v = F.greatest(1.0 - col(skew) * sd + (col(kurt) - 3.0) / 4.0 * sd * sd, F.lit(1e-9))
    return (sd - sb) * F.sqrt(F.greatest(col(n) - 1, F.lit(0))) / F.sqrt(v)


def probabilistic_sharpe(df: DataFrame, sharpe="sharpe", n="n_bars", skew="skewness", kurt="kurtosis", benchmark: float = 0.0) -> DataFrame:
    z = _psr_z(sharpe, n, skew, kurt, F.lit(benchmark))
    psr = F.when(col(n) < 5, 0.0).otherwise(let(z, norm_cdf_unscaled))
    d = df.withColumn("_psr", psr).withColumns({"psr": F.round("_psr", 4), "z_score": F.round(z, 4)})
    lab = (F.when(col(n) < 5, "insufficient_data").when(C("_psr") >= 0.99, "very_high_confidence").when(C("_psr") >= 0.95, "statistically_significant")
           .when(C("_psr") >= 0.90, "suggestive").otherwise("not_significant"))
    return d.withColumn("interpretation", lab).drop("_psr")


def expected_max(n_trials: Column, ppf=norm_ppf) -> Column:
    """Expected maximum of n standard normals, two-quantile approximation."""
    n = F.greatest(n_trials, F.lit(2)).cast("double")
    return (1.0 - G) * ppf(1.0 - 1.0 / n) + G * ppf(1.0 - 1.0 / (n * math.e))


def _dsr_log(sharpe, n, trials, skew, kurt, year=252):
    sd = col(sharpe) / math.sqrt(year)
    var = (1.0 - sd * (col(kurt) - 1.0) / 4.0 + sd * sd * (col(kurt) - 3.0) / 8.0) / F.greatest(col(n) - 1, F.lit(1))
    star = F.sqrt(F.greatest(var, F.lit(1e-12))) * expected_max(col(trials)) * math.sqrt(year)
    single = (col(n) < 10) | (col(trials) < 1)
    star = F.when(single, 0.0).otherwise(star)
    dsr = F.when(col(n) < 5, 0.0).otherwise(let(_psr_z(sharpe, n, skew, kurt, star), norm_cdf_unscaled))
    return F.round(dsr, 4), star, single


def deflated_sharpe(df: DataFrame, sharpe="sharpe", n="n_bars", trials="n_trials", skew="skewness", kurt="kurtosis") -> DataFrame:
    """Experiment-log variant: PSR against the expected best of n trials."""
    dsr, star, single = _dsr_log(sharpe, n, trials, skew, kurt)
    d = df.withColumns({"dsr": dsr, "sr_star_ann": F.round(star, 4)})
    lab = (F.when(single, "single_trial_psr").when(C("dsr") >= 0.95, "passes_multiple_testing_correction").when(C("dsr") >= 0.90, "marginal_after_correction")
           .when(C("dsr") >= 0.50, "below_multiple_testing_threshold").otherwise("likely_false_positive"))
    return d.withColumn("interpretation", lab)


def minimum_backtest_length(df: DataFrame, key="run_id", sharpe="sharpe", trials="n_trials", target: float = 0.95) -> DataFrame:
    """Smallest number of bars (50..5990 by 10) whose deflated Sharpe reaches the target, else 6000."""
    g = df.select(key, sharpe, trials, F.lit(0.0).alias("_sk"), F.lit(3.0).alias("_ku"), F.explode(F.sequence(F.lit(50), F.lit(5990), F.lit(10))).alias("_n"))
    dsr, _, _ = _dsr_log(sharpe, "_n", trials, "_sk", "_ku")
    return g.withColumn("_d", dsr).groupBy(key).agg(F.coalesce(F.min(F.when(C("_d") >= target, C("_n"))), F.lit(6000)).alias("min_bars"))


def deflated_sharpe_overfit(sharpe, trials, n_obs, skew, excess_kurt, year: int = 252) -> Column:
    """Overfitting-report variant (per-bar variance of the estimator, exact-erf normal)."""
    sb = col(sharpe) / math.sqrt(year)
    n = col(n_obs)
    star = expected_max(col(trials), norm_ppf_precise) / F.sqrt(n.cast("double"))
    var = F.greatest((1.0 + sb * sb * (0.5 + col(excess_kurt) / 4.0) - col(skew) * sb) / n, F.lit(1e-12))
    return F.when(n < 5, 0.5).otherwise(let((sb - star) / F.sqrt(var), norm_cdf))


def dsr_gate(sharpe, n, star=0.0, min_trials: int = 10) -> Column:
    """Gate variant: benchmark raised by sqrt(2 ln trials) / sqrt(T)."""
    n = col(n).cast("double")
    star = star if isinstance(star, Column) else F.lit(star)
    bench = star + math.sqrt(2.0 * math.log(max(min_trials, 1))) / F.sqrt(F.greatest(n, F.lit(1.0)))
    return F.when(n < 2, 0.0).otherwise(norm_cdf((col(sharpe) - bench) * F.sqrt(F.greatest(n - 1, F.lit(0.0)))))


def pbo(folds: DataFrame, keys, is_col="is_sharpe", oos_col="oos_sharpe") -> DataFrame:
    """Overfitting probability from the rank correlation of in- and out-of-sample Sharpe over folds."""
    def ranked(x):
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, x)) - 1) / 2.0
    d = folds.withColumns({"_ri": ranked(is_col), "_ro": ranked(oos_col)})
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_folds"), corr_agg("_ri", "_ro").alias("_c"))
    c = F.when(C("n_folds") >= 3, F.coalesce(C("_c"), F.lit(0.0))).otherwise(0.0)
    return a.select(*keys, "n_folds", F.round(F.least(F.greatest(0.5 - c * 0.5, F.lit(0.0)), F.lit(1.0)), 4).alias("pbo"), F.round(c, 4).alias("rank_correlation"))


def _unit(x) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def gap_score(df: DataFrame) -> DataFrame:
    """Weighted degradation from is_* to oos_* (sharpe, cagr, win_rate, max_drawdown)."""
    i, o = C("is_sharpe"), C("oos_sharpe")
    sr = F.when(i != 0, (i - o) / F.greatest(F.abs(i), F.lit(0.30))).otherwise(0.0)
    cg = F.when(C("is_cagr") != 0, (C("is_cagr") - C("oos_cagr")) / F.greatest(F.abs("is_cagr"), F.lit(1e-9))).otherwise(0.0)
    wr = (C("is_win_rate") - C("oos_win_rate")) * 5
    dd = (F.abs("oos_max_drawdown") - F.abs("is_max_drawdown")) * 5
    return df.withColumns({"gap_score": F.round(0.55 * _unit(sr) + 0.25 * _unit(cg) + 0.10 * _unit(wr) + 0.10 * _unit(dd), 4),
                           "sharpe_gap_pct": F.round(sr * 100.0, 2)})


def feature_stability(imp: DataFrame, keys=(), fold="fold", feature="feature", value="importance") -> DataFrame:
    """Coefficient of variation over folds; the score averages features above the median importance.

    A feature missing from a fold counts as zero there.
    """
    folds = imp.groupBy(*keys).agg(F.countDistinct(fold).alias("_k")) if keys else imp.agg(F.countDistinct(fold).alias("_k"))
    s = imp.groupBy(*keys, feature).agg(F.sum(value).alias("_s"), F.sum(C(value) * C(value)).alias("_ss"))
    d = s.join(folds, list(keys)) if keys else with_row(s, folds)
    mean = C("_s") / C("_k")
    d = d.withColumns({"mean_importance": mean, "std_importance": F.sqrt(F.greatest(C("_ss") / C("_k") - mean * mean, F.lit(0.0)))})
    d = d.withColumn("cov", C("std_importance") / (C("mean_importance") + 1e-9))
    med = d.groupBy(*keys).agg(F.greatest(F.percentile("mean_importance", F.lit(0.5)), F.lit(1e-9)).alias("_med")) if keys else d.agg(F.greatest(F.percentile("mean_importance", F.lit(0.5)), F.lit(1e-9)).alias("_med"))
    d = d.join(med, list(keys)) if keys else with_row(d, med)
    d = d.withColumn("important", flag(C("mean_importance") > C("_med")))
    return d.withColumn("unstable", flag((C("cov") > 0.5) & (C("important") == 1))).select(*keys, feature, "mean_importance", "std_importance", "cov", "important", "unstable")


def stability_score(stab: DataFrame, keys=()) -> DataFrame:
    st = _unit(1.0 - C("cov"))
    return stab.groupBy(*keys).agg(F.coalesce(F.avg(F.when(C("important") == 1, st)), F.avg(st)).alias("stability"),
                                   F.sum("unstable").alias("n_unstable"))


def multiple_testing(n_tests, n_features, alpha: float = 0.05) -> tuple[Column, Column]:
    """(penalty 0..1, Bonferroni threshold)."""
    n = F.greatest(col(n_tests), F.lit(1)).cast("double")
    feat = F.least(F.greatest((col(n_features) - 10) / 40.0, F.lit(0.0)), F.lit(0.5))
    test = F.least(F.lit(0.5), F.ln(n + 1.0) / math.log(1000.0))
    return F.round(F.least(F.lit(1.0), feat + test), 4), F.round(alpha / n, 6)


def minimum_years(sharpe, n_trials, alpha: float = 0.05) -> Column:
    z = norm_ppf_precise(1.0 - alpha / F.greatest(col(n_trials), F.lit(1)).cast("double"))
    return F.when((col(sharpe) <= 0) | (col(n_trials) < 1), F.lit(float("inf"))).otherwise(F.round(F.pow(z / nz(col(sharpe)), 2), 2))


# Composite weights and severity bands.
COMPOSITE = {"gap_score": 0.40, "dsr_penalty": 0.25, "pbo": 0.20, "instability": 0.15}
SEVERITY = ((0.25, "LOW"), (0.50, "MODERATE"), (0.75, "HIGH"))


def overfitting_report(df: DataFrame, year: int = 252) -> DataFrame:
    """Composite score, severity, warnings and recommendations from one row per run with is_*/oos_* metrics,
    n_tests, n_features, oos_bars, skewness, excess_kurtosis, pbo, rank_correlation, stability."""
    d = gap_score(df)
    dsr = deflated_sharpe_overfit("is_sharpe", F.greatest(C("n_tests"), F.lit(1)), F.greatest(C("oos_bars"), F.lit(10)), "skewness", "excess_kurtosis", year)
    d = d.withColumn("dsr", F.round(dsr, 4))
    d = d.withColumns({"dsr_p_value": F.round(1.0 - C("dsr"), 4), "dsr_penalty": F.round(_unit(1.0 - C("dsr")), 4),
                       "min_years": minimum_years("is_sharpe", "n_tests"), "oos_years": F.round(C("oos_bars") / float(year), 2),
                       "instability": F.round(1.0 - C("stability"), 4), "testing_penalty": multiple_testing("n_tests", "n_features")[0],
                       "bonferroni": multiple_testing("n_tests", "n_features")[1]})
    score = sum(w * C(k) for k, w in COMPOSITE.items())
    d = d.withColumn("overfitting_score", F.round(_unit(score), 4))
    sev = F.lit("SEVERE")
    for bound, name in reversed(SEVERITY):
        sev = F.when(C("overfitting_score") < bound, name).otherwise(sev)
    d = d.withColumn("severity", sev)
    gap, p, short = C("sharpe_gap_pct"), C("dsr_p_value"), (C("min_years") < float("inf")) & (C("oos_years") < C("min_years"))
    drop = C("is_win_rate") - C("oos_win_rate")
    warn = [F.when(gap > 50, "strong sharpe degradation").when(gap > 25, "moderate sharpe degradation"), F.when(drop > 0.08, "win rate drops out of sample"),
            F.when(C("dsr") < 0.5, "sharpe not significant after trials").when(p > 0.30, "likely false positive"),
            F.when(C("pbo") > 0.45, "high overfitting probability").when(C("pbo") > 0.35, "moderate overfitting probability"),
            F.when(C("stability") < 0.40, "unstable feature importance"),
            F.when(C("n_tests") > 50, "severe multiple testing").when(C("n_tests") > 20, "elevated multiple testing"),
            F.when(short, "insufficient out-of-sample data"), F.when(C("n_features") > 25, "high feature count")]
    bad = C("severity").isin("HIGH", "SEVERE")
    rec = [F.when((C("n_features") > 20) | (gap > 40), "reduce features"), F.when((gap > 35) | (p > 0.5), "increase regularisation"),
           F.when((p > 0.35) | (C("gap_score") > 0.4), "raise signal threshold"), F.when(C("pbo") > 0.40, "extend embargo"),
           F.when((C("stability") < 0.50) & (C("n_unstable") > 0), "remove unstable features"), F.when(bad, "size conservatively"),
           F.when(bad, "reserve a final holdout"), F.when(short, "collect more data")]
    return d.withColumns({"warnings": F.array_compact(F.array(*warn)), "recommendations": F.array_compact(F.array(*rec))})


def equity_r2(df: DataFrame, keys, eq="equity", p: Series | None = None) -> DataFrame:
    """Straight-line fit of the equity curve; needs five bars."""
    p = p or Series(keys=tuple(keys))
    d = df.withColumn("_x", p.row().cast("double"))
    return d.groupBy(*keys).agg(F.when(F.count(eq) < 5, 0.0).otherwise(F.coalesce(F.regr_r2(C(eq), C("_x")), F.lit(0.0))).alias("equity_r2"))


def slice_sharpe(df: DataFrame, keys, ret="net_return", slices: int = 5) -> DataFrame:
    """Mean Sharpe of five equal consecutive slices (the remainder is left out); whole series below 50 bars."""
    p = Series(keys=tuple(keys))
    d = df.withColumns({"_rn": p.row(), "_n": F.count(F.lit(1)).over(p.whole)})
    size = F.floor(C("_n") / slices)
    d = d.withColumn("_s", F.when(C("_n") < 50, 0).otherwise(F.floor(C("_rn") / F.greatest(size, F.lit(1)))))
    d = d.where((C("_n") < 50) | (C("_s") < slices))
    s = d.groupBy(*keys, "_s").agg(metrics.sharpe(ret).alias("_sh"))
    return s.groupBy(*keys).agg(F.avg("_sh").alias("cpcv_sharpe"))


def parameter_cv(df: DataFrame, keys, x="sharpe") -> DataFrame:
    a = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"), F.count(x).alias("_n"))
    return a.select(*keys, F.when(C("_n") < 2, 0.0).when(F.abs("_m") < 1e-9, 1.0).otherwise(C("_s") / nz(F.abs("_m"))).alias("param_cv"))


def cost_scaling(df: DataFrame, keys, ret="net_return", base_cost: float = 0.0015, multiples=(1, 2, 3)) -> DataFrame:
    """Sharpe with a round-trip penalty of m x cost on every sign change of the return."""
    p = Series(keys=tuple(keys))
    flip = F.coalesce((p.lag(ret) * C(ret) < 0).cast("double"), F.lit(0.0))
    d = df.withColumn("_flip", flip).withColumn("mult", F.explode(F.array(*[F.lit(m) for m in multiples])))
    d = d.withColumn("_adj", C(ret) - C("_flip") * base_cost * C("mult") * 2.0)
    return d.groupBy(*keys, "mult").agg(metrics.sharpe("_adj").alias("sharpe"))


def t_and_track_record(df: DataFrame, keys, ret="net_return", confidence: float = 0.95) -> DataFrame:
    """t statistic of the mean and minimum track record in years, corrected for skew and kurtosis."""
    n = F.count(ret).cast("double")
    a = df.groupBy(*keys).agg(n.alias("n"), F.avg(ret).alias("_mu"), F.stddev_samp(ret).alias("_sd"), metrics.sharpe(ret).alias("sharpe"),
                              F.when(F.var_pop(ret) > 0, F.skewness(ret)).alias("_g1"), F.when(F.var_pop(ret) > 0, F.kurtosis(ret)).alias("_g2"))
    n = C("n")
    sk = F.when(n > 3, C("_g1") * F.sqrt(n * (n - 1)) / nz(n - 2)).otherwise(0.0)
    ku = F.when(n > 3, (n - 1) / nz((n - 2) * (n - 3)) * ((n + 1) * C("_g2") + 6)).otherwise(0.0) + 3.0
    sr = C("sharpe")
    corr = F.least(F.greatest(1.0 - F.coalesce(sk, F.lit(0.0)) * sr + (F.coalesce(ku, F.lit(3.0)) - 1.0) / 4.0 * sr * sr, F.lit(0.5)), F.lit(5.0))
    z = norm_ppf(F.lit(confidence)) + norm_ppf(F.lit(0.5))
    trl = F.when(F.abs(sr) < 1e-6, 999.0).otherwise(z * z * corr / nz(sr * sr) / 252.0)
    flat = (n < 2) | (F.coalesce(C("_sd"), F.lit(0.0)) < 1e-9)
    t = F.when(flat, 0.0).otherwise(C("_mu") * math.sqrt(252.0) / (C("_sd") + 1e-9) * F.sqrt(n / 252.0))
    return a.select(*keys, C("n").cast("bigint").alias("n"), "sharpe", t.alias("t_stat"), trl.alias("min_trl_years"))


def robustness_gates(bt: DataFrame, keys, fold_sharpes: DataFrame | None = None, require_all: bool = False, ret="net_return",
                     is_sharpe: float = 0.0) -> DataFrame:
    """Eight pass/fail gates per key and the overall verdict (five of eight, or all)."""
    keys = list(keys)
    t = t_and_track_record(bt, keys, ret)
    d = (t.join(slice_sharpe(bt, keys, ret), keys)
         .join(cost_scaling(bt, keys, ret).groupBy(*keys).agg(F.max(F.when(C("mult") == 3, C("sharpe"))).alias("sharpe_3x")), keys)
         .join(equity_r2(bt, keys), keys))
    if fold_sharpes is not None:
        f = fold_sharpes.groupBy(*keys).agg(F.avg("sharpe").alias("_fm"), F.avg((C("sharpe") > 0).cast("double")).alias("_fp"))
        d = d.join(f, keys, "left").join(parameter_cv(fold_sharpes, keys), keys, "left")
        d = d.withColumns({"cpcv_sharpe": F.coalesce("_fm", "cpcv_sharpe"), "param_cv": F.coalesce("param_cv", F.lit(0.0)),
                           "positive_folds": F.coalesce(C("_fp"), (C("sharpe") > 0).cast("double"))}).drop("_fm", "_fp")
    else:
        d = d.withColumns({"param_cv": F.lit(0.0), "positive_folds": (C("sharpe") > 0).cast("double")})
    d = d.withColumn("dsr", dsr_gate("sharpe", "n", is_sharpe))
    gates = F.array(C("dsr") >= 0.95, C("cpcv_sharpe") > 0, C("param_cv") < 0.5, C("sharpe_3x") >= 0.3, C("t_stat") >= 3.0,
                    C("n") / 252.0 >= C("min_trl_years"), C("equity_r2") >= 0.3, C("positive_folds") >= 0.6)
    d = d.withColumn("n_passed", F.size(F.filter(gates, lambda g: g)))
    return d.withColumn("overall_pass", flag(C("n_passed") >= (8 if require_all else 5)))
