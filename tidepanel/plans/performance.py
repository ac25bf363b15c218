"""AGG-*, BT-*, VAL-*: metrics, backtests, walk-forward evaluation."""
from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions.scale import repeat
from ..functions.windows import Series, flag
from ..operators import backtest as bk, drift, explog, features as feats, labels, metrics as mt, ml, ranking as rk, regime as rg, splits as sp
from ..sources.tables import bars, experiments, universe
from .catalogue import CAT, COLUMNS, streamed, unpivoted
from .common import signals, stock_run
from .registry import query, rd, rounded
from .sql import (BARS, METRICS, PAST, SER, SIG, rnd, STOCK, UNIVERSE, WHOLE, annual, bt, chain, flag as sflag, lag, mean, metrics, pct, rounds, sharpe, stack, std, vol, with_)

C = F.col
BT = [*SIG, *bt("sig", STOCK)]


def one(sel: str) -> str:
    return with_(BT, f"SELECT symbol, {sel} FROM bt GROUP BY symbol")


def agg(key, name, expr, sel):
    query(key, one(f"round({sel} + 1.7e-09, 6) + 0.0 AS {name}"))(
        lambda spark, sf: rounded(stock_run(spark, sf).groupBy("symbol").agg(expr().alias(name))))


agg("AGG-1", "annualised_return", lambda: mt.annualised_return("net_return"), annual("net_return"))
agg("AGG-2", "annualised_volatility", lambda: mt.annualised_volatility("net_return"), vol("net_return"))
agg("AGG-3", "sharpe_ratio", lambda: mt.sharpe("net_return"), sharpe("net_return"))


@query("AGG-4", one("round(avg(net_return) / (stddev_samp(net_return) + 1e-12) * sqrt(252.0) + 1.7e-09, 6) + 0.0 AS sharpe_like, "
                    "round(avg(net_return) + 1.7e-11, 8) + 0.0 AS mean_return, round(avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) + 1.7e-09, 6) AS hit_rate"))
def agg4(spark, sf):
    d = stock_run(spark, sf).groupBy("symbol").agg(mt.sharpe_like("net_return").alias("sharpe_like"), F.avg("net_return").alias("mean_return"),
                                                   mt.win_rate("net_return").alias("hit_rate"))
    return d.select("symbol", rd("sharpe_like", 6).alias("sharpe_like"), rd("mean_return", 8).alias("mean_return"), rd("hit_rate", 6).alias("hit_rate"))


DN = "coalesce(stddev_samp(CASE WHEN net_return < 0 THEN net_return END) * sqrt(252.0), 0)"
agg("AGG-5", "sortino_ratio", lambda: mt.sortino("net_return"), f"CASE WHEN {DN} = 0 THEN 0 ELSE {annual('net_return')} / ({DN}) END")

MET = [*BT, *metrics("bt")]


def met(key, cols):
    @query(key, with_(MET, f"SELECT symbol, {rounds(cols)} FROM met"))
    def run(spark, sf):
        return rounded(mt.all_metrics(stock_run(spark, sf), ("symbol",)).select("symbol", *cols))


@query("AGG-6", with_(MET, "SELECT symbol, round(max_drawdown + 1.7e-09, 6) + 0.0 AS max_drawdown FROM met"))
def agg6(spark, sf):
    return rounded(mt.drawdown(stock_run(spark, sf), ("symbol",)))


@query("AGG-7", with_(MET, "SELECT symbol, max_drawdown_duration_bars FROM met"))
def agg7(spark, sf):
    return mt.underwater_runs(stock_run(spark, sf), ("symbol",))


met("AGG-8", ["calmar_ratio"])
met("AGG-9", ["win_rate", "profit_factor"])
agg("AGG-10", "cagr", lambda: mt.cagr(), "CASE WHEN count(*) < 2 THEN 0 ELSE pow(arg_max(equity, ts) / arg_min(equity, ts), 252.0 / count(*)) - 1 END")
met("AGG-11", METRICS)


@query("AGG-12", with_([*BT, f"d AS (SELECT *, equity / lag(equity) {SER} - 1 AS r, max(equity) {PAST} AS peak FROM bt)"], """
SELECT symbol, round(arg_max(equity, ts) / arg_min(equity, ts) - 1 + 1.7e-09, 6) + 0.0 AS total_return,
 round(pow(arg_max(equity, ts) / arg_min(equity, ts), 1.0 / greatest(count(r) / 252.0, 1e-6)) - 1, 6) + 0.0 AS cagr,
 round(stddev_samp(r) * sqrt(252.0) + 1.7e-09, 6) + 0.0 AS volatility, round(CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(252.0) ELSE 0 END + 1.7e-09, 6) + 0.0 AS sharpe,
 round(min((equity - peak) / peak) + 1.7e-09, 6) + 0.0 AS max_drawdown, count(*) AS bars, min(ts) AS "start", max(ts) AS "end" FROM d GROUP BY symbol"""))
def agg12(spark, sf):
    return rounded(mt.nav_dashboard(stock_run(spark, sf), ("symbol",)))


@query("AGG-13", with_([*BT, f"d AS (SELECT *, coalesce(equity / lag(equity) {SER} - 1, 0) AS r, max(equity) {PAST} AS peak FROM bt)",
                        """a AS (SELECT symbol, arg_min(equity, ts) AS s, arg_max(equity, ts) AS e, count(CASE WHEN r > 1e-12 THEN 1 END) AS pos_days,
  count(CASE WHEN r < -1e-12 THEN 1 END) AS neg_days, min((equity - peak) / peak) * 100 AS max_dd, stddev_samp(r) AS sd, avg(r) AS mu, min(ts) AS period_start,
  max(ts) AS period_end, count(*) AS n_days, max(r) * 100 AS best, min(r) * 100 AS worst FROM d GROUP BY symbol)"""], """
SELECT a.symbol, round(s + 1.7e-05, 2) + 0.0 AS start_nav, round(e + 1.7e-05, 2) + 0.0 AS end_nav, round((e / s - 1) * 100 + 1.7e-07, 4) + 0.0 AS total_ret, round(e - s + 1.7e-05, 2) + 0.0 AS total_pnl,
 round(CASE WHEN pos_days + neg_days > 0 THEN pos_days / (pos_days + neg_days) * 100 ELSE 0 END + 1.7e-09, 6) + 0.0 AS win_rate, round(max_dd + 1.7e-07, 4) + 0.0 AS max_dd,
 round((pow(e / s, 365.25 / date_diff('day', period_start, period_end)) - 1) * 100 + 1.7e-07, 4) + 0.0 AS ann_ret,
 round(CASE WHEN sd > 0 THEN mu / sd * sqrt(252.0) ELSE 0 END + 1.7e-09, 6) + 0.0 AS sharpe, pos_days, neg_days, period_start, period_end, n_days,
 round(best + 1.7e-09, 6) + 0.0 AS best_day_pct, round(worst + 1.7e-09, 6) + 0.0 AS worst_day_pct,
 (SELECT min(ts) FROM d WHERE d.symbol = a.symbol AND d.r * 100 = a.best) AS best_day_dt,
 (SELECT min(ts) FROM d WHERE d.symbol = a.symbol AND d.r * 100 = a.worst) AS worst_day_dt FROM a"""))
def agg13(spark, sf):
    d = mt.nav_statistics(stock_run(spark, sf), ("symbol",))
    dig = {"start_nav": 2, "end_nav": 2, "total_pnl": 2, "total_ret": 4, "max_dd": 4, "ann_ret": 4}
    return rounded(d.withColumns({c: rd(c, n) for c, n in dig.items()}))


THRESH = [{"_r1": pct("close"), "_t252": pct("close", 252), "trail_ret_63": pct("close", 63)}, {"_v21": f"({std('_r1', 21)}) * sqrt(252.0)"},
          {"regime_bull": sflag("_t252 > 0.10"), "regime_bear": sflag("_t252 < -0.10"), "regime_hv": sflag("_v21 > 0.95")},
          {"regime": "CASE WHEN regime_hv = 1 THEN 3 WHEN regime_bear = 1 THEN 0 WHEN regime_bull = 1 THEN 2 ELSE 1 END"}]
HV = 0.95   # the synthetic bars are several times as volatile as an index


def with_regime(df):
    return rg.threshold_regime(df, vol_high=HV)


@query("AGG-14", with_([*SIG, *stack("sig", THRESH, "reg"), *bt("reg", STOCK, "symbol, regime"), *metrics("bt", "symbol, regime"),
                        "n AS (SELECT symbol, regime, count(*) AS n_bars FROM reg GROUP BY 1, 2)",
                        "names AS (SELECT * FROM (VALUES (0, 'bear'), (1, 'neutral'), (2, 'bull'), (3, 'high_vol')) t(regime, name))"], """
SELECT s.symbol, names.name, coalesce(n_bars, 0) AS n_bars, round(sharpe_ratio + 1.7e-06, 3) + 0.0 AS sharpe_ratio, round(cagr + 1.7e-07, 4) + 0.0 AS cagr, round(max_drawdown + 1.7e-07, 4) + 0.0 AS max_drawdown
FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN names LEFT JOIN n ON n.symbol = s.symbol AND n.regime = names.regime
LEFT JOIN met ON met.symbol = s.symbol AND met.regime = names.regime AND n.n_bars >= 30"""))
def agg14(spark, sf):
    d = with_regime(signals(spark, sf))
    m = mt.all_metrics(bk.run(d, bk.cost("stock"), ("symbol", "regime")), ("symbol", "regime"))
    n = d.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n_bars"))
    grid = repeat(d.select("symbol").distinct(), [{"regime": i, "name": n} for i, n in enumerate(("bear", "neutral", "bull", "high_vol"))])
    j = grid.join(n.join(m, ["symbol", "regime"]), ["symbol", "regime"], "left")
    ok = C("n_bars") >= 30
    return j.select("symbol", "name", F.coalesce("n_bars", F.lit(0)).alias("n_bars"), *[(F.when(ok, rd(c, k)) + 0.0).alias(c) for c, k in (("sharpe_ratio", 3), ("cagr", 4), ("max_drawdown", 4))])


def trades_sql(base="bt", keys="symbol", name="tr"):
    w = f"OVER (PARTITION BY {keys} ORDER BY ts)"
    return [
        f"{name}_a AS (SELECT {keys}, ts, close AS px, sign(position) AS dir, row_number() {w} AS rn, lead(ts) {w} AS nts, lead(close) {w} AS npx FROM {base})",
        f"{name}_b AS (SELECT *, CASE WHEN dir <> coalesce(lag(dir) {w}, 0) THEN 1 ELSE 0 END AS nw FROM {name}_a)",
        f"{name}_c AS (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_b)",
        f"""{name}_d AS (SELECT {keys}, isl, dir, min(ts) AS entry_date, arg_min(px, ts) AS ep, max(rn) - min(rn) AS span, arg_max(struct_pack(t := nts, p := npx), ts) AS nx,
            max(ts) AS lts, arg_max(px, ts) AS lpx FROM {name}_c WHERE dir <> 0 GROUP BY {keys}, isl, dir)""",
        f"""{name} AS (SELECT {keys}, entry_date, coalesce(nx.t, lts) AS exit_date, CASE WHEN dir = 1 THEN 'long' ELSE 'short' END AS direction,
            round(ep, 10) + 0.0 AS entry_price, round(coalesce(nx.p, lpx), 10) + 0.0 AS exit_price, round(dir * (coalesce(nx.p, lpx) / ep - 1) * 100, 4) + 0.0 AS return_pct,
            CAST(span + CASE WHEN nx.t IS NULL THEN 0 ELSE 1 END AS INTEGER) AS bars_held, nx.t IS NULL AS open_at_end FROM {name}_d)"""]


TR = [*BT, *trades_sql()]


@query("BT-6", with_(TR, "SELECT *, return_pct > 0 AS is_winner FROM tr"))
def bt6(spark, sf):
    return bk.trades(stock_run(spark, sf), price_digits=10)


TM = """SELECT symbol, round(avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0.0 END) + 1.7e-09, 6) AS win_rate,
 round(CASE WHEN coalesce(abs(sum(CASE WHEN return_pct < 0 THEN return_pct END)), 0) > 0 THEN coalesce(sum(CASE WHEN return_pct > 0 THEN return_pct END), 0) / abs(sum(CASE WHEN return_pct < 0 THEN return_pct END))
 ELSE 'inf'::DOUBLE END + 1.7e-12, 9) AS profit_factor, count(*) AS total_trades, round(avg(return_pct) + 1.7e-12, 9) + 0.0 AS avg_trade_return_pct, round(avg(bars_held) + 1.7e-12, 9) + 0.0 AS avg_bars_held FROM tr GROUP BY symbol"""


@query("AGG-15", with_(TR, TM))
def agg15(spark, sf):
    d = bk.trade_metrics(bk.trades(stock_run(spark, sf)))
    return d.select("symbol", rd("win_rate", 6).alias("win_rate"), "total_trades", *[(rd(c, 9) + 0.0).alias(c) for c in ("profit_factor", "avg_trade_return_pct", "avg_bars_held")])


@query("AGG-16", with_([*BT, "m AS (SELECT symbol, CAST(year(ts) AS INTEGER) AS year, month(ts) AS mo, product(1 + net_return) - 1 AS r FROM bt GROUP BY 1, 2, 3)"],
                       "SELECT symbol, year, " + ", ".join(f"round(max(CASE WHEN mo = {i} THEN r END) + 1.7e-09, 6) + 0.0 AS m{i:02d}" for i in range(1, 13)) + " FROM m GROUP BY symbol, year"))
def agg16(spark, sf):
    return rounded(mt.monthly_returns(stock_run(spark, sf), ("symbol",)))


# experiment log and arms -----------------------------------------------------------------------
EXPLOG = r"""explog AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 < 6 THEN 'experiment' ELSE (['experiment', 'finding', 'heuristic', 'failure', 'promotion'])[doc_id % 5 + 1] END AS type,
  text AS title, list_distinct(list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N} ]', ' ', 'g'), ' '), lambda w: length(w) >= 4)) AS tags,
  source AS session, (n_chars % 400 - 150) / 100.0 AS sharpe, (n_chars % 370 - 140) / 100.0 AS oos_sharpe, -(n_chars % 45)::DOUBLE AS max_dd, (n_chars % 30)::DOUBLE AS ann_return FROM documents)"""


def arm_history(spark, sf):
    """Archetype of each experiment by its source, reward its out-of-sample Sharpe, time its id."""
    return experiments(spark, sf).where("type = 'experiment'").select(C("session").alias("arm"), C("oos_sharpe").alias("reward"), C("id").alias("t"))


ARMS = "h AS (SELECT session AS arm, oos_sharpe AS reward, id AS t FROM explog WHERE type = 'experiment')"


@query("AGG-17", with_([EXPLOG, ARMS], """SELECT arm, count(*) AS n, round(sum(reward) + 1.7e-09, 6) + 0.0 AS sum_reward, round(sum(reward * reward) + 1.7e-09, 6) + 0.0 AS sum_sq_reward, max(reward) AS best, arg_max(reward, t) AS last,
 round(avg(reward) + 1.7e-09, 6) + 0.0 AS mean, round(sqrt(greatest(sum(reward * reward) / count(*) - pow(sum(reward) / count(*), 2), 1e-6) / count(*)) + 1.7e-09, 6) + 0.0 AS posterior_std FROM h GROUP BY arm"""))
def agg17(spark, sf):
    return rounded(explog.arm_statistics(arm_history(spark, sf)))


@query("AGG-18", with_([EXPLOG], "SELECT type, count(*) AS n FROM explog GROUP BY type"))
def agg18(spark, sf):
    return experiments(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("AGG-19", with_([*BT, f"a AS (SELECT *, CASE WHEN position <> 0 THEN 1 ELSE 0 END AS i FROM bt)", f"b AS (SELECT *, row_number() {SER} - row_number() OVER (PARTITION BY symbol, i ORDER BY ts) AS isl FROM a)",
                        "c AS (SELECT symbol, isl, count(*) AS n FROM b WHERE i = 1 GROUP BY symbol, isl)"], """SELECT c.symbol, round(avg(n) + 1.7e-09, 6) AS avg_hold_bars, count(*) AS n_holds,
  round(any_value(w) + 1.7e-11, 8) + 0.0 AS avg_win, round(any_value(l) + 1.7e-11, 8) + 0.0 AS avg_loss FROM c JOIN (SELECT symbol, avg(CASE WHEN net_return > 0 THEN net_return END) AS w, avg(CASE WHEN net_return < 0 THEN net_return END) AS l FROM bt GROUP BY symbol) x
  ON c.symbol = x.symbol GROUP BY c.symbol"""))
def agg19(spark, sf):
    d = stock_run(spark, sf)
    wl = d.groupBy("symbol").agg(rd(F.avg(F.when(C("net_return") > 0, C("net_return"))), 8).alias("avg_win"), rd(F.avg(F.when(C("net_return") < 0, C("net_return"))), 8).alias("avg_loss"))
    return mt.holding_runs(d, ("symbol",), C("position") != 0).withColumn("avg_hold_bars", rd("avg_hold_bars", 6)).join(wl, "symbol")


@query("AGG-20", with_([BARS, f"d AS (SELECT *, {pct('close')} AS r, max(close) {PAST} AS pk FROM bars)"], """SELECT symbol, min(ts) AS "start", max(ts) AS "end", count(*) AS n_bars,
 round((arg_max(close, ts) / arg_min(close, ts) - 1) * 100 + 1.7e-07, 4) + 0.0 AS total_return, round((pow(1 + avg(r), 252) - 1) * 100 + 1.7e-07, 4) + 0.0 AS ann_return,
 round(stddev_samp(r) * sqrt(252.0) * 100 + 1.7e-07, 4) + 0.0 AS ann_vol, round((pow(1 + avg(r), 252) - 1) / (stddev_samp(r) * sqrt(252.0)) + 1.7e-07, 4) + 0.0 AS sharpe_bnh,
 round(min((close - pk) / pk) * 100 + 1.7e-07, 4) + 0.0 AS max_dd, round(avg(volume) / 1e6 + 1.7e-13, 10) AS avg_volume_m FROM d GROUP BY symbol"""))
def agg20(spark, sf):
    d = mt.buy_and_hold(bars(spark, sf)).withColumn("avg_volume_m", rd("avg_volume_m", 10))
    return d.withColumns({c: rd(c, 4) + 0.0 for c in ("total_return", "ann_return", "ann_vol", "sharpe_bnh", "max_dd")})


def feature_frame(spark, sf, h: int = 5):
    d = feats.generate_features(bars(spark, sf), ["FEA-1", "FEA-3", "FEA-11", "FEA-13"])
    return labels.forward_label(d, h)


FSQL = [{"ret_1d": pct("close"), "ret_5d": pct("close", 5), "_s20": mean("close", 20), "_sd20": std("close", 20), "_mu": mean("volume", 20), "_sd": std("volume", 20),
         "fwd_return": f"lead(close, 5) {SER} / close - 1"},
        {"sma_20_dist": "(close - _s20) / (_s20 + 1e-9)", "bb_pct": "(close - (_s20 - 2 * _sd20)) / (4 * _sd20 + 1e-9)", "volume_ratio": "volume / (_mu + 1e-9)",
         "volume_zscore": "(volume - _mu) / (_sd + 1e-9)", "label": "CASE WHEN fwd_return IS NOT NULL THEN CASE WHEN fwd_return > 0 THEN 1 ELSE 0 END END"}]
FEAT = [BARS, *stack("bars", FSQL, "feat")]
IC = "CASE WHEN NOT isnan(corr(value, fwd_return)) THEN corr(value, fwd_return) END"
CATLONG = [*CAT, f"lng AS ({unpivoted('fwd_return')})", f"ic AS (SELECT feature, {IC} AS ic FROM lng GROUP BY feature)"]


@query("AGG-21", with_(CATLONG, f"SELECT feature, {rnd('ic', 6, 'ic')} FROM ic"))
def agg21(spark, sf):
    return rounded(mt.information_coefficient(streamed(spark, sf), COLUMNS))


@query("TOP-8", with_(CATLONG, f"SELECT feature, {rnd('ic', 6, 'ic')} FROM ic WHERE ic IS NOT NULL ORDER BY round(abs(ic), 9) DESC, feature LIMIT 10"))
def top8(spark, sf):
    ic = mt.information_coefficient(streamed(spark, sf), COLUMNS).where("ic IS NOT NULL")
    return rounded(ic.orderBy(F.desc(F.round(F.abs("ic"), 9)), "feature").limit(10))


# walk-forward ----------------------------------------------------------------------------------
WF = [BARS, f"num AS (SELECT *, row_number() {SER} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars)",
      "fl AS (SELECT DISTINCT symbol, unnest(range(0, CAST(floor((n - 168) / 21) + 1 AS BIGINT))) AS fold FROM num)",
      """asg0 AS (SELECT num.*, fold, CASE WHEN rn BETWEEN fold * 21 AND fold * 21 + 125 THEN 'train' ELSE 'test' END AS split FROM num JOIN fl USING (symbol)
       WHERE rn BETWEEN fold * 21 AND fold * 21 + 125 OR rn BETWEEN fold * 21 + 147 AND fold * 21 + 167)""",
      *[c.replace("PARTITION BY symbol ", "PARTITION BY symbol, fold ").replace("FROM bars", "FROM asg0").replace("sig", "asg", 1) if c.startswith("sig AS") else
        c.replace("PARTITION BY symbol ", "PARTITION BY symbol, fold ").replace("FROM bars", "FROM asg0") for c in SIG[1:]]]
K3 = "symbol, fold, split"
WFM = [*WF, *bt("asg", f"CASE WHEN split = 'test' THEN {STOCK} ELSE 0.0 END", K3), *metrics("bt", K3)]


@query("VAL-1", with_(WF[:3], "SELECT symbol, CAST(fold AS INTEGER) AS fold, fold * 21 AS train_start, fold * 21 + 125 AS train_end, fold * 21 + 147 AS test_start, fold * 21 + 167 AS test_end FROM fl"))
def val1(spark, sf):
    return sp.bar_folds(bars(spark, sf))


@query("VAL-2", with_([BARS, "s AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM bars)", "k AS (SELECT a, b, unnest(range(0, 200)) AS i FROM s)",
                       "t1 AS (SELECT b, i, CAST(a + to_months(CAST(i AS INTEGER)) AS DATE) AS ts0 FROM k)", "t2 AS (SELECT *, CAST(ts0 + INTERVAL 6 MONTH AS DATE) - 1 AS te FROM t1)",
                       "t3 AS (SELECT *, CAST(te + INTERVAL 1 MONTH AS DATE) + 1 AS us FROM t2)", "t4 AS (SELECT *, CAST(us + INTERVAL 1 MONTH AS DATE) - 1 AS ue FROM t3)"],
                      "SELECT CAST(i + 1 AS INTEGER) AS fold, ts0::TIMESTAMP AS train_start, te::TIMESTAMP AS train_end, us::TIMESTAMP AS test_start, ue::TIMESTAMP AS test_end FROM t4 WHERE ue <= b"))
def val2(spark, sf):
    return sp.month_folds(bars(spark, sf))


@query("VAL-3", with_([BARS, "n AS (SELECT symbol, count(*) AS n, count(*) // 6 AS sz FROM bars GROUP BY symbol)", "f AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS fold FROM n)",
                       "g AS (SELECT symbol, CAST(fold AS INTEGER) AS fold, n - (5 - fold) * sz AS fst, sz FROM f)"],
                      "SELECT symbol, fold, CAST(0 AS BIGINT) AS train_start, fst - 23 AS train_end, fst AS test_start, fst + sz - 1 AS test_end FROM g WHERE fst - 22 >= 50"))
def val3(spark, sf):
    return sp.expanding_folds(bars(spark, sf))


def wf_metrics(spark, sf):
    b = bars(spark, sf)
    return sp.walk_forward(b, sp.bar_folds(b), sp.momentum)


@query("VAL-4", with_(WFM, f"SELECT symbol, CAST(fold AS INTEGER) AS fold, split, {rounds(METRICS)} FROM met"))
def val4(spark, sf):
    return rounded(wf_metrics(spark, sf).select("symbol", "fold", "split", *METRICS))


@query("VAL-4b", with_([*WF, "oos AS (SELECT * FROM asg WHERE split = 'test')", *bt("oos", STOCK), *metrics("bt")], f"SELECT symbol, {rounds(METRICS)} FROM met"))
def val4b(spark, sf):
    b = bars(spark, sf)
    return rounded(sp.stitched(b, sp.bar_folds(b), sp.momentum).select("symbol", *METRICS))


SUMM = """sm AS (SELECT symbol, avg(CASE WHEN split = 'train' THEN sharpe_ratio END) AS mean_is_sharpe, avg(CASE WHEN split = 'test' THEN sharpe_ratio END) AS mean_oos_sharpe,
 avg(CASE WHEN split = 'train' THEN cagr END) AS mean_is_cagr, avg(CASE WHEN split = 'test' THEN cagr END) AS mean_oos_cagr, stddev_pop(CASE WHEN split = 'test' THEN sharpe_ratio END) AS std_oos_sharpe,
 count(CASE WHEN split = 'test' AND sharpe_ratio > 0 THEN 1 END) AS n_positive, count(CASE WHEN split = 'test' THEN 1 END) AS n_folds, max(CASE WHEN split = 'test' THEN sharpe_ratio END) AS best_oos_sharpe
 FROM met GROUP BY symbol), sc AS (SELECT *, CASE WHEN abs(mean_is_sharpe) > 1e-9 THEN greatest((mean_is_sharpe - mean_oos_sharpe) / abs(mean_is_sharpe), 0) ELSE 0 END AS overfitting_score FROM sm)"""
SCOLS = ["mean_is_sharpe", "mean_oos_sharpe", "mean_is_cagr", "mean_oos_cagr", "std_oos_sharpe", "best_oos_sharpe"]


@query("AGG-22", with_([*WFM, SUMM], f"SELECT symbol, n_positive, n_folds, {rounds(SCOLS, digits=5)} FROM sc"))
def agg22(spark, sf):
    return rounded(sp.fold_summary(wf_metrics(spark, sf)).select("symbol", "n_positive", "n_folds", *SCOLS), 5)


@query("VAL-5", with_([*WFM, SUMM], """SELECT symbol, round(overfitting_score + 1.7e-08, 5) + 0.0 AS overfitting_score, CASE WHEN mean_oos_sharpe >= 0.5 AND overfitting_score < 0.5 THEN 'PASS'
 WHEN mean_oos_sharpe > 0 AND overfitting_score < 0.8 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM sc"""))
def val5(spark, sf):
    return rounded(sp.fold_summary(wf_metrics(spark, sf)).select("symbol", "overfitting_score", "verdict"), 5)


@query("AGG-32", with_([*WFM, SUMM], """SELECT symbol, round(mean_is_sharpe + 1.7e-07, 4) + 0.0 AS mean_is_sharpe, round(mean_oos_sharpe + 1.7e-07, 4) + 0.0 AS mean_oos_sharpe, round(mean_is_sharpe - mean_oos_sharpe + 1.7e-07, 4) + 0.0 AS gap,
 CASE WHEN mean_is_sharpe - mean_oos_sharpe < 0.3 THEN 'low' WHEN mean_is_sharpe - mean_oos_sharpe < 0.7 THEN 'moderate' ELSE 'high' END AS gap_class FROM sc"""))
def agg32(spark, sf):
    d = sp.fold_summary(wf_metrics(spark, sf)).withColumn("gap", C("mean_is_sharpe") - C("mean_oos_sharpe"))
    d = d.withColumn("gap_class", F.when(C("gap") < 0.3, "low").when(C("gap") < 0.7, "moderate").otherwise("high"))
    return rounded(d.select("symbol", "mean_is_sharpe", "mean_oos_sharpe", "gap", "gap_class"), 4)


# theory and cost runs shared by several reports
COMP = [*SIG, *bt("sig", "0.0", name="th"), *bt("sig", STOCK, name="re"), *metrics("th", name="mth"), *metrics("re", name="mre")]


# whole-history signals next to the fold signals, under other names
SIGX = [c.replace("sig_", "sigx_").replace("sig AS", "sigx AS") for c in SIG[1:]]


@query("VAL-6", with_([*WFM, SUMM, *SIGX, *bt("sigx", "0.0", name="th"), *bt("sigx", STOCK, name="re"), 
  "bh0 AS (SELECT * REPLACE (1 AS signal) FROM sigx)", *bt("bh0", STOCK, name="bh"),
  f"j AS (SELECT sc.symbol, mean_oos_sharpe, t.s AS st, r.s AS sr, b.s AS sb FROM sc JOIN (SELECT symbol, {sharpe('net_return')} AS s FROM th GROUP BY symbol) t USING (symbol) JOIN (SELECT symbol, {sharpe('net_return')} AS s FROM re GROUP BY symbol) r USING (symbol) JOIN (SELECT symbol, {sharpe('net_return')} AS s FROM bh GROUP BY symbol) b USING (symbol))",
  "k AS (SELECT *, sr > 0.5 AS edge_survives, greatest((st - mean_oos_sharpe) / greatest(abs(st), 1e-9), 0) AS overfit, sr > sb + 0.1 AS beats_baseline FROM j)"], """SELECT symbol, round(overfit + 1.7e-08, 5) + 0.0 AS overfit, edge_survives, beats_baseline,
  CASE WHEN mean_oos_sharpe >= 0.8 AND edge_survives AND overfit < 0.3 THEN 'STRONG EDGE' WHEN mean_oos_sharpe >= 0.5 AND edge_survives AND overfit < 0.6 THEN 'MODERATE EDGE'
  WHEN mean_oos_sharpe > 0 AND overfit < 0.8 THEN 'WEAK EDGE' ELSE 'NO EDGE DETECTED' END AS edge FROM k"""))
def val6(spark, sf):
    s = signals(spark, sf)
    def sh(df, costs, name):
        return bk.sharpes(bk.run(df, costs), ("symbol",)).withColumnRenamed("sharpe", name)
    d = sp.fold_summary(wf_metrics(spark, sf)).select("symbol", "mean_oos_sharpe").join(sh(s, bk.cost("zero"), "sharpe_theory"), "symbol")
    d = d.join(sh(s, bk.cost("stock"), "sharpe_real"), "symbol").join(sh(s.withColumn("signal", F.lit(1)), bk.cost("stock"), "sharpe_base"), "symbol")
    return rounded(sp.edge_verdict(d).select("symbol", "overfit", "edge_survives", "beats_baseline", "edge"), 5)


@query("VAL-7", with_(SIG, "SELECT symbol, ts, signal FROM sig"))
def val7(spark, sf):
    return signals(spark, sf).select("symbol", "ts", "signal")


@query("VAL-8", with_([*WFM], """SELECT CAST(fold AS INTEGER) AS fold, split, count(*) AS n_runs, round(avg(sharpe_ratio) + 1.7e-08, 5) + 0.0 AS mean_sharpe, round(stddev_samp(sharpe_ratio) + 1.7e-08, 5) + 0.0 AS std_sharpe,
 round(max(sharpe_ratio) + 1.7e-08, 5) + 0.0 AS best FROM met GROUP BY fold, split"""))
def val8(spark, sf):
    m = wf_metrics(spark, sf)
    return rounded(m.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("sharpe_ratio").alias("mean_sharpe"),
                                                  F.stddev_samp("sharpe_ratio").alias("std_sharpe"), F.max("sharpe_ratio").alias("best")), 5)


REGM = """SELECT symbol, round(sqrt(avg(pow(y - p, 2))) + 1.7e-11, 8) AS rmse, round(avg(abs(y - p)) + 1.7e-11, 8) AS mae, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y)) + 1.7e-09, 6) + 0.0 AS r2,
 round(avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0.0 END) + 1.7e-09, 6) AS directional_accuracy FROM (SELECT symbol, fwd_return AS y, -sma_20_dist AS p FROM feat WHERE fwd_return IS NOT NULL AND sma_20_dist IS NOT NULL) GROUP BY symbol"""


@query("AGG-23", with_(FEAT, REGM))
def agg23(spark, sf):
    d = feature_frame(spark, sf).select("symbol", C("fwd_return").alias("y"), (-C("sma_20_dist")).alias("p")).dropna()
    m = mt.regression_metrics(d, ("symbol",), "y", "p")
    return m.select("symbol", rd("rmse", 8).alias("rmse"), rd("mae", 8).alias("mae"), rd("r2", 6).alias("r2"), rd("directional_accuracy", 6).alias("directional_accuracy"))


# backtest variants -----------------------------------------------------------------------------
SUMSEL = f"""SELECT met.*, total_costs_pct, total_return_gross, total_return_net, turnover_annualised, total_return_gross - total_return_net AS theory_vs_real_gap
FROM met JOIN (SELECT symbol, sum(cost_drag) AS total_costs_pct, product(1 + gross_return) - 1 AS total_return_gross, product(1 + net_return) - 1 AS total_return_net,
 sum(turnover) / (count(*) / 252.0) AS turnover_annualised FROM bt GROUP BY symbol) x USING (symbol)"""
TCOLS = ("profit_factor", "avg_trade_return_pct", "avg_bars_held")
XC = ["total_costs_pct", "total_return_gross", "total_return_net", "turnover_annualised", "theory_vs_real_gap"]


@query("BT-1", with_(BT, "SELECT symbol, ts, position, round(gross_return + 1.7e-11, 8) + 0.0 AS gross_return, round(cost_drag + 1.7e-11, 8) + 0.0 AS cost_drag, round(net_return + 1.7e-11, 8) + 0.0 AS net_return, round(equity + 1.7e-05, 2) + 0.0 AS equity FROM bt"))
def bt1(spark, sf):
    d = stock_run(spark, sf)
    return d.select("symbol", "ts", "position", *[(rd(c, 8) + 0.0).alias(c) for c in ("gross_return", "cost_drag", "net_return")], (rd("equity", 2) + 0.0).alias("equity"))


@query("BT-1b", with_([*MET, f"sx AS ({SUMSEL})", *trades_sql(), f"tm AS ({TM})"], f"SELECT sx.symbol, {rounds([c for c in METRICS if c not in ('win_rate', 'profit_factor', 'total_trades')] + XC)}, "
       "coalesce(tm.win_rate, 0) AS win_rate, tm.profit_factor, coalesce(tm.total_trades, 0) AS total_trades, coalesce(avg_trade_return_pct, 0) AS avg_trade_return_pct, coalesce(avg_bars_held, 0) AS avg_bars_held FROM sx LEFT JOIN tm USING (symbol)"))
def bt1b(spark, sf):
    d = bk.report(signals(spark, sf), bk.cost("stock"))
    return d.select(
        "symbol", "total_trades", *[(rd(c, 9 if c in TCOLS else 6) + 0.0).alias(c) if c != "max_drawdown_duration_bars" else C(c)
                                    for c in d.columns if c not in ("symbol", "total_trades")])


COSTS = {"default": (0.001, 0.0005, 0.0002), "stock": (0.0005, 0.0002, 0.0001), "crypto": (0.001, 0.0005, 0.0002), "zero": (0.0, 0.0, 0.0), "flat_2pm": (0.002, 0.0005, 0.0002)}
COSTV = ", ".join(f"('{k}', {sum(v)!r})" for k, v in COSTS.items())


@query("BT-2", with_([*SIG, f"cm AS (SELECT * FROM (VALUES {COSTV}) t(cost, per_side))", "sx AS (SELECT sig.*, cost, per_side FROM sig CROSS JOIN cm)", *bt("sx", "per_side", "symbol, cost")],
                     f"SELECT symbol, cost, round(any_value(per_side) * 2 + 1.7e-11, 8) AS round_trip, round(sum(cost_drag) + 1.7e-09, 6) + 0.0 AS total_costs_pct, round({sharpe('net_return')} + 1.7e-09, 6) + 0.0 AS sharpe FROM bt GROUP BY symbol, cost"))
def bt2(spark, sf):
    models = {"default": bk.cost(), "stock": bk.cost("stock"), "crypto": bk.cost("crypto"), "zero": bk.cost("zero"), "flat_2pm": bk.cost(0.002)}
    d = bk.with_costs(signals(spark, sf), models)
    r = bk.run(d, C("per_side"), ("symbol", "cost"))
    return r.groupBy("symbol", "cost").agg(rd(F.max("round_trip"), 8).alias("round_trip"), rd(F.sum("cost_drag"), 6).alias("total_costs_pct"), rd(mt.sharpe("net_return"), 6).alias("sharpe"))


PORT = [*BT, "na AS (SELECT count(DISTINCT symbol) AS n FROM bt)", "pf AS (SELECT ts, sum(net_return) / any_value(n) AS net_return, sum(gross_return) / any_value(n) AS gross_return, sum(cost_drag) / any_value(n) AS cost_drag FROM bt, na GROUP BY ts)"]


@query("AGG-25", with_(PORT, "SELECT ts, round(net_return + 1.7e-12, 9) + 0.0 AS net_return, round(gross_return + 1.7e-12, 9) + 0.0 AS gross_return, round(cost_drag + 1.7e-12, 9) + 0.0 AS cost_drag FROM pf"))
def agg25(spark, sf):
    return rounded(bk.portfolio(stock_run(spark, sf)).select("ts", "net_return", "gross_return", "cost_drag"), 9)


@query("BT-3", with_([*PORT, "pe AS (SELECT 'all' AS book, *, 100000.0 * product(1 + net_return) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM pf)", *metrics("pe", "book")], f"SELECT book, {rounds(METRICS)} FROM met"))
def bt3(spark, sf):
    p = bk.portfolio(stock_run(spark, sf)).withColumn("book", F.lit("all"))
    return rounded(mt.all_metrics(p, ("book",)).select("book", *METRICS))


@query("BT-5", with_([*MET, f"sx AS ({SUMSEL})"], f"SELECT symbol, {rounds(XC)} FROM sx"))
def bt5(spark, sf):
    return rounded(bk.summary(stock_run(spark, sf)).select("symbol", *XC))


# stress periods inside the years of the data
PERIODS = {"1996_first_half": ("1996-01-01", "1996-06-30"), "1998_summer": ("1998-07-01", "1998-10-15"), "dot_com_bust": ("2000-03-10", "2002-10-09"), "q4_2018_selloff": ("2018-10-01", "2018-12-24")}
PV = "pv AS (SELECT period, a::TIMESTAMP AS a, b::TIMESTAMP AS b FROM (VALUES " + ", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in PERIODS.items()) + ") t(period, a, b))"
INP = "inp AS (SELECT sig.*, period FROM sig JOIN pv ON ts BETWEEN a AND b)"


@query("JN-5", with_([*SIG, PV, INP], "SELECT symbol, ts, period, close FROM inp"))
def jn5(spark, sf):
    return bk.in_periods(bars(spark, sf), bk.period_table(spark, PERIODS)).select("symbol", "ts", "period", "close")


@query("BT-7", with_([*SIG, PV, INP, "inn AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol, period) AS n FROM inp) WHERE n >= 10)", *bt("inn", STOCK, "symbol, period"), *metrics("bt", "symbol, period")],
                     f"SELECT symbol, period, {rounds(METRICS)} FROM met"))
def bt7(spark, sf):
    r = bk.stress(signals(spark, sf), bk.period_table(spark, {**PERIODS, "gfc_2008": bk.STRESS_PERIODS["gfc_2008"]}), bk.cost("stock"))
    return rounded(mt.all_metrics(r, ("symbol", "period")).select("symbol", "period", *METRICS))


def lcg(x):
    return f"((({x}) * 48271 + 11) % 2147483647)"


NRES = 50
RN = f"nm AS (SELECT *, row_number() {SER} AS rn FROM sig)"
_x = [f"g0 AS (SELECT nm.*, resample, (rn * 1000003 + resample * 7919 + 42) % 2147483647 AS x0 FROM nm CROSS JOIN (SELECT unnest(range({NRES})) AS resample))"]
for _i in range(12):
    _x.append(f"g{_i + 1} AS (SELECT *, {lcg(f'x{_i}')} AS x{_i + 1} FROM g{_i})")
NOISE = [*SIG, RN, *_x, "nz AS (SELECT symbol, ts, close, resample, sign(signal + 0.05 * (" + " + ".join(f"x{i} / 2147483647.0" for i in range(1, 13)) + " - 6.0)) AS signal FROM g12)", *bt("nz", "0.0017", "symbol, resample", "nb")]
NS = f"ns AS (SELECT symbol, CAST(resample AS INTEGER) AS resample, {sharpe('net_return')} AS sharpe FROM nb GROUP BY symbol, resample)"


@query("BT-8", with_([*NOISE, NS], "SELECT symbol, resample, round(sharpe + 1.7e-09, 6) + 0.0 AS sharpe FROM ns"))
def bt8(spark, sf):
    return rounded(bk.signal_noise(signals(spark, sf), NRES))


BOOT = [f"bs0 AS (SELECT symbol, ts, signal, row_number() {SER} - 1 AS rn, coalesce(close / lag(close) {SER} - 1, 0) AS ret, count(*) OVER (PARTITION BY symbol) AS n, first_value(close) {WHOLE} AS c0 FROM sig)",
        f"bs1 AS (SELECT *, greatest(5, n // 20) AS blk FROM bs0 CROSS JOIN (SELECT unnest(range({NRES})) AS resample))",
        f"bs2 AS (SELECT *, {lcg('((rn // blk) * 69621 + resample * 1009 + 43) % 2147483647')} AS h FROM bs1)",
        "bs3 AS (SELECT *, ((h * 48271) % 2147483647 % n + rn % blk) % n AS src FROM bs2)",
        "bs4 AS (SELECT t.symbol, t.ts, t.signal, t.resample, t.c0 * product(1 + s.ret) OVER (PARTITION BY t.symbol, t.resample ORDER BY t.ts ROWS UNBOUNDED PRECEDING) AS close FROM bs3 t JOIN bs0 s ON t.symbol = s.symbol AND t.src = s.rn)",
        *bt("bs4", "0.0017", "symbol, resample", "bb"),
        f"bsh AS (SELECT symbol, CAST(resample AS INTEGER) AS resample, {sharpe('net_return')} AS sharpe FROM bb GROUP BY symbol, resample)"]


@query("BT-9", with_([*SIG, *BOOT], "SELECT symbol, resample, round(sharpe + 1.7e-09, 6) + 0.0 AS sharpe FROM bsh"))
def bt9(spark, sf):
    return rounded(bk.block_bootstrap(signals(spark, sf), NRES))


CRASH = [f"cr0 AS (SELECT symbol, ts, signal, close AS c, row_number() {SER} - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM sig)",
         "cr1 AS (SELECT symbol, ts, signal, crash, CASE WHEN rn >= floor(n * 0.5) THEN c * (1 + d) ELSE c END AS close FROM cr0 CROSS JOIN (VALUES ('crash_10pct', -0.10::DOUBLE), ('crash_20pct', -0.20::DOUBLE), ('crash_30pct', -0.30::DOUBLE)) t(crash, d))",
         *bt("cr1", "0.0017", "symbol, crash", "cb"), f"crs AS (SELECT symbol, crash, {sharpe('net_return')} AS sharpe FROM cb GROUP BY symbol, crash)"]


@query("BT-10", with_([*SIG, *CRASH], "SELECT symbol, crash, round(sharpe + 1.7e-09, 6) + 0.0 AS sharpe FROM crs"))
def bt10(spark, sf):
    return rounded(bk.crash_injection(signals(spark, sf)))


@query("BT-11", with_([*NOISE, NS, *BOOT, *CRASH, *bt("sig", "0.0017", name="b0"), f"base AS (SELECT symbol, {sharpe('net_return')} AS base_sharpe FROM b0 GROUP BY symbol)",
  "n1 AS (SELECT symbol, avg(sharpe) AS nm, stddev_pop(sharpe) AS nsd FROM ns GROUP BY symbol)", "b1 AS (SELECT symbol, quantile_cont(sharpe, 0.05) AS q5, quantile_cont(sharpe, 0.95) AS q95 FROM bsh GROUP BY symbol)",
  "c1 AS (SELECT symbol, min(sharpe) AS wc FROM crs GROUP BY symbol)"], """SELECT symbol, round(base_sharpe + 1.7e-07, 4) + 0.0 AS base_sharpe, round(nm + 1.7e-07, 4) + 0.0 AS noise_sharpe_mean, round(nsd + 1.7e-07, 4) + 0.0 AS noise_sharpe_std, round(q5 + 1.7e-07, 4) + 0.0 AS bootstrap_sharpe_5th,
  round(q95 + 1.7e-07, 4) + 0.0 AS bootstrap_sharpe_95th, round(wc + 1.7e-07, 4) + 0.0 AS worst_crash_sharpe,
  round(least(greatest((base_sharpe - least(nm - 2 * nsd, q5, wc)) / (abs(base_sharpe) + 1e-9), 0), 1) + 1.7e-07, 4) + 0.0 AS fragility_score FROM base JOIN n1 USING (symbol) JOIN b1 USING (symbol) JOIN c1 USING (symbol)"""))
def bt11(spark, sf):
    s = signals(spark, sf)
    return rounded(bk.fragility(bk.sharpes(bk.run(s), ("symbol",)), bk.signal_noise(s, NRES), bk.block_bootstrap(s, NRES), bk.crash_injection(s)), 4)


# a smooth probability from the position in the Bollinger band stands in for a model score
PROBA = [*FEAT, *stack("feat", [{"proba": "1.0 / (1.0 + exp(-(2 * bb_pct - 1)))"}], "prb"), *stack("prb", THRESH, "prg"),
         "prn AS (SELECT *, (['bear', 'sideways', 'bull', 'high_vol'])[regime + 1] AS regime_name FROM prg)"]


def scored(spark, sf):
    d = with_regime(feature_frame(spark, sf)).withColumn("proba", ml.sigmoid(2.0 * C("bb_pct") - 1.0))
    return d.withColumn("regime_name", F.element_at(F.array(*[F.lit(x) for x in ("bear", "sideways", "bull", "high_vol")]), C("regime") + 1))


TH = "(VALUES ('bull', 0.55, 0.82), ('sideways', 0.67, 0.40), ('bear', 0.75, 0.52), ('high_vol', 0.67, 0.50)) th(rn, lg, sh)"


@query("BT-12", with_([*PROBA, f"x AS (SELECT *, {mean('close', 200, 100)} AS s200 FROM prn)", f"y AS (SELECT *, CASE WHEN proba >= lg THEN 1 WHEN proba <= 1 - sh THEN -1 ELSE 0 END AS sg FROM x JOIN {TH} ON regime_name = rn)"],
                      "SELECT symbol, ts, regime_name, CASE WHEN sg = -1 AND close > s200 THEN 0 ELSE sg END AS signal FROM y"))
def bt12(spark, sf):
    return bk.regime_signals(scored(spark, sf), trend_filter=True).select("symbol", "ts", "regime_name", "signal")


@query("JN-12", with_([*PROBA, f"y AS (SELECT *, CASE WHEN proba >= lg THEN 1 WHEN proba <= 1 - sh THEN -1 ELSE 0 END AS signal FROM prn JOIN {TH} ON regime_name = rn)"], "SELECT symbol, ts, regime_name, signal FROM y"))
def jn12(spark, sf):
    return bk.regime_signals(scored(spark, sf)).select("symbol", "ts", "regime_name", "signal")


VARS = [*PROBA, f"v0 AS (SELECT symbol, ts, close, coalesce(proba, 0.5) AS p, CASE WHEN {mean('close', 50, 30)} > {mean('close', 200, 100)} THEN 1.0 ELSE 0.0 END AS g FROM prn)",
        "v1 AS (SELECT *, least(greatest(2 * p - 1, 0), 1) AS k, CASE WHEN p >= 0.75 THEN 1.0 WHEN p >= 0.65 THEN 0.8 WHEN p >= 0.55 THEN 0.5 WHEN p >= 0.50 THEN 0.25 ELSE 0.0 END AS py FROM v0)",
        "v2 AS (SELECT symbol, ts, close, unnest([{'v': 'kelly', 'p': k}, {'v': 'kelly_gated', 'p': k * g}, {'v': 'kelly_1_5x', 'p': least(1.5 * k, 1)}, {'v': 'kelly_2x', 'p': least(2.0 * k, 1)}, {'v': 'pyramid', 'p': py}, {'v': 'pyramid_gated', 'p': py * g}, {'v': 'buy_and_hold', 'p': 1.0}]) AS x FROM v1)",
        "v3 AS (SELECT symbol, ts, close, x.v AS variant, x.p::DOUBLE AS position, coalesce(close / lag(close) OVER (PARTITION BY symbol, x.v ORDER BY ts) - 1, 0) AS r FROM v2)",
        "v4 AS (SELECT *, position * r + (1 - position) * (0.045 / 252) AS dr FROM v3)",
        "v5 AS (SELECT *, product(1 + dr) OVER (PARTITION BY symbol, variant ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nav FROM v4)",
        "v6 AS (SELECT *, max(nav) OVER (PARTITION BY symbol, variant ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pk FROM v5)"]


def variants(spark, sf):
    p = Series()
    d = scored(spark, sf).withColumns({"proba": F.coalesce("proba", F.lit(0.5)), "_a": p.mean("close", 50, 30), "_b": p.mean("close", 200, 100)})
    d = d.withColumn("golden_cross", flag(C("_a") > C("_b"))).select("symbol", "ts", "close", "proba", "golden_cross")
    return bk.variant_navs(d, bk.variant_positions())


@query("BT-13", with_(VARS, "SELECT symbol, ts, variant, round(position + 1.7e-11, 8) + 0.0 AS position, round(dr + 1.7e-11, 8) + 0.0 AS daily_return, round(nav + 1.7e-09, 6) + 0.0 AS nav FROM v5"))
def bt13(spark, sf):
    d = variants(spark, sf)
    return d.select("symbol", "ts", "variant", *[(rd(c, n) + 0.0).alias(c) for c, n in (("position", 8), ("daily_return", 8), ("nav", 6))])


@query("BT-14", with_([*VARS, """ct AS (SELECT symbol, variant, product(1 + dr) - 1 AS total_return, CASE WHEN stddev_samp(dr) > 0 THEN (avg(dr) * 252 - 0.045) / (stddev_samp(dr) * sqrt(252.0)) ELSE 0 END AS sharpe,
 min((nav - pk) / pk) AS max_drawdown, avg(position) AS avg_position, avg(CASE WHEN position > 0.05 THEN 1.0 ELSE 0.0 END) AS invested FROM v6 GROUP BY symbol, variant)"""],
 """SELECT ct.symbol, ct.variant, round(ct.total_return + 1.7e-09, 6) + 0.0 AS total_return, round(ct.sharpe + 1.7e-09, 6) + 0.0 AS sharpe, round(ct.max_drawdown + 1.7e-09, 6) + 0.0 AS max_drawdown, round(ct.avg_position + 1.7e-09, 6) + 0.0 AS avg_position,
 round(ct.invested + 1.7e-09, 6) + 0.0 AS invested, round(ct.total_return - b.total_return + 1.7e-09, 6) + 0.0 AS alpha FROM ct JOIN ct b ON ct.symbol = b.symbol AND b.variant = 'buy_and_hold'"""))
def bt14(spark, sf):
    return rounded(bk.candidate_table(variants(spark, sf)))


@query("BT-16", with_([*COMP, "e AS (SELECT t.symbol, arg_max(t.equity, t.ts) AS a, arg_max(r.equity, r.ts) AS b FROM th t JOIN re r ON t.symbol = r.symbol AND t.ts = r.ts GROUP BY t.symbol)"],
  """SELECT e.symbol, round(a + 1.7e-05, 2) + 0.0 AS final_equity_ideal, round(b + 1.7e-05, 2) + 0.0 AS final_equity_cost, round(b - a + 1.7e-05, 2) + 0.0 AS final_equity_delta, round(mre.sharpe_ratio - mth.sharpe_ratio + 1.7e-09, 6) + 0.0 AS sharpe_delta
  FROM e JOIN mth ON mth.symbol = e.symbol JOIN mre ON mre.symbol = e.symbol"""))
def bt16(spark, sf):
    s = signals(spark, sf)
    def end(costs, tag):
        return bk.run(s, costs).groupBy("symbol").agg(F.max_by("equity", "ts").alias(f"e_{tag}"), mt.sharpe("net_return").alias(f"s_{tag}"))
    d = end(bk.cost("zero"), "i").join(end(bk.cost("stock"), "c"), "symbol")
    return d.select("symbol", *[(rd(x, n) + 0.0).alias(a) for x, n, a in ((C("e_i"), 2, "final_equity_ideal"), (C("e_c"), 2, "final_equity_cost"),
                                                                          (C("e_c") - C("e_i"), 2, "final_equity_delta"), (C("s_c") - C("s_i"), 6, "sharpe_delta"))])
