"""SRC-*, DQ-*, PRJ-*, JN-*, SET-*, TOP-* and the remaining AGG-*: sources, quality, joins, ranking, log."""
from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from ..functions.scale import repeat, with_row
from ..functions.windows import Series, clip, flag, nz, pct_rank
from ..operators import backtest as bk, explog, features as feats, metrics as mt, quality as dq, ranking as rk, regime as rg, risk as rs, splits as sp
from ..operators.features import calendar as cal, cross
from ..sources import panel as pn, segments as seg
from ..sources.tables import bars, events, experiments, macro, table, universe
from .common import scratch, signals, stock_run
from .catalogue import CAT, COLUMNS, streamed, unpivoted
from .performance import BT, EXPLOG, FEAT, SIG, PORT, arm_history, feature_frame
from .registry import query, rd, rounded
from .sql import (ALL, BARS, MACRO, PAST, SER, STOCK, UNIVERSE, WHOLE, bt, chain, flag as sflag, lag, last, macro_wide, mean, pct, pick, quant, rank, rank_of, rnd, sharpe, stack, std, with_)

C = F.col
KEYS = ("symbol", "ts")
O5 = ["open", "high", "low", "close", "volume"]
ROWS = "symbol, ts, open, high, low, close, volume"


def b_sql(where="", cols=ROWS):
    return f"WITH {BARS} SELECT {cols} FROM bars {where}"


# sources ---------------------------------------------------------------------------------------
@query("SRC-1", b_sql("WHERE symbol = 'S7' AND ts <= TIMESTAMP '1998-06-30 23:59:59'"))
def src1(spark, sf):
    root = scratch(spark)
    pn.write_panel(bars(spark, sf), root)
    return pn.read_panel(spark, root, "S7", as_of="1998-06-30").select(*KEYS, *O5)


@query("SRC-2", b_sql("WHERE ts <= TIMESTAMP '1999-12-31 23:59:59'"))
def src2(spark, sf):
    return pn.as_of_filter(bars(spark, sf), "1999-12-31").select(*KEYS, *O5)


@query("SRC-3", b_sql("WHERE ts <= TIMESTAMP '1999-12-31 23:59:59'"))
def src3(spark, sf):
    return pn.assert_no_future(pn.as_of_filter(bars(spark, sf), "1999-12-31"), "1999-12-31").select(*KEYS, *O5)


@query("SRC-4", b_sql("WHERE symbol IN ('S1', 'S2', 'S3', 'S5', 'S8') AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31 23:59:59'"))
def src4(spark, sf):
    root = scratch(spark)
    pn.write_panel(bars(spark, sf), root)
    return pn.read_panel(spark, root, ["S1", "S2", "S3", "S5", "S8"], as_of="2000-12-31", start="1996-01-01").select(*KEYS, *O5)


@query("SRC-5", f"""WITH {BARS} SELECT symbol, ts, open, high, low, CASE WHEN day(ts) = 13 THEN NULL ELSE close END AS close, volume FROM bars""")
def src5(spark, sf):
    """A raw feed with other names, text numbers, zone suffixes and a few unreadable prices."""
    b = bars(spark, sf)
    raw = b.select(C("symbol").alias("Ticker"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Date"), C("open").cast("string").alias("Open"), C("high").cast("string").alias("High"),
                   C("low").cast("string").alias("Low"), F.when(F.day("ts") == 13, "n/a").otherwise(C("close").cast("string")).alias("Adj Close"), C("volume").cast("string").alias("Volume"))
    return pn.normalize(raw).select(*KEYS, *O5)


@query("SRC-6", b_sql(cols="symbol, ts, close"))
def src6(spark, sf):
    b = bars(spark, sf).select("symbol", F.unix_millis(C("ts").cast("timestamp")).alias("ms"), "close")
    return pn.epoch_ms_bars(b).select(*KEYS, "close")


@query("SRC-7", with_([UNIVERSE], "SELECT symbol, sector FROM universe"))
def src7(spark, sf):
    root = scratch(spark)
    u = universe(spark, sf).select(F.concat(F.lit(" "), F.lower("symbol"), F.lit(" ")).alias("Ticker Code"), "sector")
    pn.write_csv(u, root)
    return pn.load_universe(spark, root).select("symbol", "sector")


@query("SRC-8", with_(PORT, "SELECT CAST(ts AS VARCHAR)[1:10] AS day, round(net_return + 1.7e-11, 8) + 0.0 AS net_return FROM pf"))
def src8(spark, sf):
    root = scratch(spark)
    d = bk.portfolio(stock_run(spark, sf)).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), rd("net_return", 8).alias("net_return"))
    pn.write_csv(d, root)
    return spark.read.csv(root, header=True, schema="day string, net_return double")


@query("SRC-9", b_sql())
def src9(spark, sf):
    root = scratch(spark)
    pn.write_versioned(bars(spark, sf), root, "1")
    return spark.read.parquet(f"{root}/latest").select(*KEYS, *O5)


@query("SRC-10", with_(BT, f"SELECT symbol, {rnd(sharpe('net_return'), 6, 'sharpe')}, count(*) AS n FROM bt GROUP BY symbol"))
def src10(spark, sf):
    root = scratch(spark)
    d = stock_run(spark, sf).groupBy("symbol").agg(rd(mt.sharpe("net_return"), 6).alias("sharpe"), F.count(F.lit(1)).alias("n"))
    pn.write_json(d, root)
    return spark.read.schema("symbol string, sharpe double, n bigint").json(root)


def written_log(spark, sf):
    """The log as JSON records, written and read with the declared schema."""
    root = scratch(spark)
    e = experiments(spark, sf)
    rec = e.select(C("id").cast("string").alias("id"), "type", "title", "tags", F.struct("sharpe", "ann_return", "max_dd", "oos_sharpe").alias("metrics"), "session",
                   F.struct(C("title").alias("hypothesis"), F.struct(C("session").alias("ticker"), C("tags").alias("features")).alias("config")).alias("body"))
    explog.append_log(rec, root)
    return explog.read_log(spark, root, multi_line=False)


@query("SRC-11", with_([EXPLOG], "SELECT CAST(id AS VARCHAR) AS id, type, sharpe, oos_sharpe, session AS ticker, len(tags)::INTEGER AS n_features FROM explog"))
def src11(spark, sf):
    return written_log(spark, sf).select("id", "type", "metrics.sharpe", "metrics.oos_sharpe", C("body.config.ticker").alias("ticker"), F.size("body.config.features").alias("n_features"))


@query("SRC-11b", with_(["entry AS (SELECT doc_id AS id, quality FROM labels)", "body AS (SELECT doc_id AS id, md5(text) AS digest FROM documents)"],
  "SELECT coalesce(e.id, b.id) AS id, coalesce(quality, -1) AS quality, digest, CASE WHEN b.id IS NULL THEN 'no_body' WHEN e.id IS NULL THEN 'no_entry' ELSE 'both' END AS state FROM entry e FULL JOIN body b ON e.id = b.id"))
def src11b(spark, sf):
    """The log's index (labels) joined to its bodies (JSON documents, each with the file it came from); orphans on either side are named."""
    root = scratch(spark)
    pn.write_json(table(spark, sf, "documents").select(C("doc_id").alias("id"), F.struct(C("text").alias("hypothesis")).alias("body")), root)
    bodies = explog.read_log(spark, root, multi_line=False, with_file=True).withColumn("id", C("id").cast("bigint"))
    d = explog.indexed(table(spark, sf, "labels").select(C("doc_id").alias("id"), "quality"), bodies)
    return d.select("id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.md5("body.hypothesis").alias("digest"), "state")


@query("SRC-12", with_([EXPLOG], "SELECT id, type, sharpe FROM explog ORDER BY id DESC LIMIT 2000"))
def src12(spark, sf):
    """The log appended in three parts, oldest first, with retention by whole segments; the newest 2,000 records."""
    e, root = experiments(spark, sf).select("id", "type", "sharpe"), scratch(spark)
    top = e.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    for k in range(3):
        part = F.floor((C("id") - top["lo"]) * 3 / (top["hi"] - top["lo"] + 1)) == k
        seg.append(e.where(part), root)
    return seg.newest(spark, root, "id")


@query("SRC-13", chain([BARS], "bars", [{"r": pct("close")}, {"v": f"({std('r', 21)}) * sqrt(252.0)"}], "SELECT symbol, ts, " + rnd("v", 6, "vol_21d") + " FROM {last}"))
def src13(spark, sf):
    root, b = scratch(spark), bars(spark, sf)
    make = lambda d: feats.generate_features(d, ["FEA-9"])
    pn.cached_features(b, make, root, ["FEA-9"])
    return rounded(pn.cached_features(b, make, root, ["FEA-9"]).select(*KEYS, "vol_21d"))


@query("SRC-14", f"""WITH {BARS}, n AS (SELECT symbol, ts, row_number() {SER} - 1 AS rn, greatest(count(*) {ALL} // 100, 1) AS st FROM bars)
SELECT symbol, ts FROM n WHERE rn % st = 0 AND rn // st < 100""")
def src14(spark, sf):
    return pn.every_nth(bars(spark, sf), 100).select(*KEYS)


@query("SRC-15", f"""WITH e AS (SELECT * FROM (VALUES {", ".join(str((i, x[2])) for i, x in enumerate(pn.ETFS))}) t(i, sector))
SELECT sector, count(*) AS n_parts, round(avg(p_retailprice) + 1.7e-9, 6) AS avg_price FROM part JOIN e ON p_size % 30 = i GROUP BY sector""")
def src15(spark, sf):
    """Parts grouped by the literal fund dimension (position in the list = size modulo 30), broadcast."""
    dim = spark.createDataFrame([(i, *x) for i, x in enumerate(pn.ETFS)], "i int, symbol string, name string, sector string")
    p = table(spark, sf, "part").join(F.broadcast(dim), C("p_size") % 30 == C("i"))
    return rounded(p.groupBy("sector").agg(F.count(F.lit(1)).alias("n_parts"), F.avg("p_retailprice").alias("avg_price")))


@query("SRC-16", with_([*SIG, "hs AS (SELECT symbol, ts, signal, high AS close FROM sig)", *bt("hs", STOCK)], f"SELECT symbol, {rnd(sharpe('net_return'), 6, 'sharpe')} FROM bt GROUP BY symbol"))
def src16(spark, sf):
    s = signals(spark, sf)
    return rounded(bk.sharpes(bk.run(s, bk.cost("stock"), price=bk.close_column(s, "high")), ("symbol",)))


@query("SRC-17", f"""WITH {BARS}, s AS (SELECT symbol, min(ts)::DATE AS a, max(ts)::DATE AS b FROM bars GROUP BY symbol),
c AS (SELECT symbol, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM s)
SELECT c.symbol, count(*) AS business_days, count(*) - count(bars.ts) AS missing FROM c LEFT JOIN bars ON bars.symbol = c.symbol AND bars.ts::DATE = c.day WHERE isodow(day) < 6 GROUP BY c.symbol""")
def src17(spark, sf):
    b = bars(spark, sf)
    span = b.agg(F.min("ts").cast("date").cast("string").alias("a"), F.max("ts").cast("date").cast("string").alias("z")).first()
    days = pn.business_days(spark, span["a"], span["z"])
    s = b.groupBy("symbol").agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("z"))
    grid = s.join(F.broadcast(days), C("day").between(C("a"), C("z"))).select("symbol", "day")
    have = b.select("symbol", C("ts").cast("date").alias("day"), F.lit(1).alias("x"))
    return grid.join(have, ["symbol", "day"], "left").groupBy("symbol").agg(F.count(F.lit(1)).alias("business_days"), F.count_if(C("x").isNull()).alias("missing"))


# quality: a deliberately dirty panel derived from the bars -------------------------------------
DIRTY = """dirty AS (SELECT symbol, ts, CASE WHEN day(ts) = 7 THEN NULL ELSE open END AS open, CASE WHEN day(ts) = 11 THEN low - 1 ELSE high END AS high, low,
 CASE WHEN day(ts) IN (13, 14, 15) THEN NULL WHEN day(ts) = 21 AND month(ts) = 2 THEN -1 ELSE close END AS close, CASE WHEN day(ts) = 25 THEN 0 ELSE volume END AS volume FROM bars)"""
D = [BARS, DIRTY]


def dirty(spark, sf):
    d = F.day("ts")
    return bars(spark, sf).select(*KEYS, F.when(d == 7, None).otherwise(C("open")).alias("open"), F.when(d == 11, C("low") - 1).otherwise(C("high")).alias("high"), "low",
                                  F.when(d.isin(13, 14, 15), None).when((d == 21) & (F.month("ts") == 2), -1.0).otherwise(C("close")).alias("close"), F.when(d == 25, 0.0).otherwise(C("volume")).alias("volume"))


@query("DQ-1", with_([*D, "dd AS (SELECT * FROM dirty UNION ALL SELECT * FROM dirty WHERE day(ts) = 28)"], """SELECT symbol, count(*) AS n_rows, count(*) - count(DISTINCT ts) AS duplicate_ts,
 count(CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 1 END) AS null_rows, count(CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 1 END) AS nonpositive_prices,
 count(CASE WHEN high < low THEN 1 END) AS high_below_low, 0 AS valid FROM dd GROUP BY symbol"""))
def dq1(spark, sf):
    d = dirty(spark, sf)
    return dq.hard_validation(d.unionByName(d.where(F.day("ts") == 28)))


FENCE = [*D, "fe AS (SELECT symbol, " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3, avg({c}) AS {c}_mu, stddev_samp({c}) AS {c}_sd" for c in O5) + " FROM dirty GROUP BY symbol)"]
LOHI = {c: (f"{c}_q1 - 3 * ({c}_q3 - {c}_q1)", f"{c}_q3 + 3 * ({c}_q3 - {c}_q1)") for c in O5}


@query("DQ-2", with_(FENCE, "SELECT dirty.symbol, ts, " + ", ".join(f"CASE WHEN ({c}_q3 > {c}_q1 AND ({c} < {LOHI[c][0]} OR {c} > {LOHI[c][1]})) OR abs(({c} - {c}_mu) / nullif({c}_sd, 0)) > 4 THEN 1 ELSE 0 END AS {c}_outlier" for c in O5) + " FROM dirty JOIN fe USING (symbol)"))
def dq2(spark, sf):
    return dq.outlier_flags(dirty(spark, sf)).select(*KEYS, *[f"{c}_outlier" for c in O5])


@query("DQ-3", with_(FENCE, "SELECT dirty.symbol, ts, " + ", ".join(rnd(f"CASE WHEN {c} IS NULL OR {c}_q3 <= {c}_q1 THEN {c} ELSE least(greatest({c}, {LOHI[c][0]}), {LOHI[c][1]}) END", 9, c) for c in O5) + " FROM dirty JOIN fe USING (symbol)"))
def dq3(spark, sf):
    return rounded(dq.winsorize(dirty(spark, sf)), 9)


def ffill_sql(c):
    return f"coalesce(last_value({c} IGNORE NULLS) {PAST}, first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("DQ-4", with_(D, "SELECT symbol, ts, " + ", ".join(f"{ffill_sql(c)} AS {c}" for c in O5) + " FROM dirty"))
def dq4(spark, sf):
    return dq.impute_ffill(dirty(spark, sf))


FUT = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
LIN = [*D, f"n0 AS (SELECT *, row_number() {SER} AS rn FROM dirty)"]
LIN.append("n1 AS (SELECT *, " + ", ".join(f"last_value({c} IGNORE NULLS) {PAST} AS {c}_p, first_value({c} IGNORE NULLS) {FUT} AS {c}_n, max(CASE WHEN {c} IS NOT NULL THEN rn END) {PAST} AS {c}_pr, min(CASE WHEN {c} IS NOT NULL THEN rn END) {FUT} AS {c}_nr" for c in O5) + " FROM n0)")
LIN.append("n2 AS (SELECT symbol, ts, " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN rn - {c}_pr <= 3 THEN coalesce({c}_p + ({c}_n - {c}_p) * (rn - {c}_pr) / ({c}_nr - {c}_pr), {c}_p) END AS {c}" for c in O5) + " FROM n1)")


@query("DQ-5", with_(LIN, "SELECT symbol, ts, " + ", ".join(rnd(ffill_sql(c), 9, c) for c in O5) + " FROM n2"))
def dq5(spark, sf):
    return rounded(dq.impute_linear(dirty(spark, sf)), 9)


@query("DQ-6", with_([*D, "md AS (SELECT symbol, " + ", ".join(f"median({c}) AS {c}_m" for c in O5) + " FROM dirty GROUP BY symbol)"], "SELECT dirty.symbol, ts, " + ", ".join(rnd(f"coalesce({c}, {c}_m)", 9, c) for c in O5) + " FROM dirty JOIN md USING (symbol)"))
def dq6(spark, sf):
    return rounded(dq.impute_median(dirty(spark, sf)), 9)


@query("DQ-7", with_([*D, """a AS (SELECT symbol, count(CASE WHEN close < 0 THEN 1 END) AS nc, count(CASE WHEN volume = 0 THEN 1 END) AS zv, count(CASE WHEN ts > TIMESTAMP '2000-01-01' THEN 1 END) AS fu, count(CASE WHEN high < low THEN 1 END) AS iv,
 count(CASE WHEN open < 0 THEN 1 END) AS no_, count(CASE WHEN high < 0 THEN 1 END) AS nh, count(CASE WHEN low < 0 THEN 1 END) AS nl FROM dirty GROUP BY symbol)"""],
 """SELECT symbol, array_to_string(list_filter([CASE WHEN no_ > 0 THEN symbol || ': ' || no_ || ' negative values in ''open'' column' END, CASE WHEN nh > 0 THEN symbol || ': ' || nh || ' negative values in ''high'' column' END,
 CASE WHEN nl > 0 THEN symbol || ': ' || nl || ' negative values in ''low'' column' END, CASE WHEN nc > 0 THEN symbol || ': ' || nc || ' negative values in ''close'' column' END, CASE WHEN zv > 0 THEN symbol || ': ' || zv || ' zero-volume bars' END,
 CASE WHEN fu > 0 THEN symbol || ': ' || fu || ' rows with future dates detected' END, CASE WHEN iv > 0 THEN symbol || ': ' || iv || ' bars where high < low' END], lambda m: m IS NOT NULL), '; ') AS issues FROM a"""))
def dq7(spark, sf):
    return dq.soft_validation(dirty(spark, sf), "2000-01-01").select("symbol", F.concat_ws("; ", "issues").alias("issues"))


@query("DQ-8", with_([*D, "lg AS (" + " UNION ALL ".join(f"SELECT symbol, '{c}' AS \"column\", {c} AS v FROM dirty" for c in O5) + ")"], f"SELECT symbol, \"column\", {rnd('avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END)', 8, 'missing')}, CASE WHEN avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) > 0.05 THEN 1 ELSE 0 END AS too_many FROM lg GROUP BY 1, 2"))
def dq8(spark, sf):
    return rounded(dq.missing_fraction(dirty(spark, sf)), 8)


@query("DQ-9", with_([BARS, "rh AS (SELECT symbol, md5(concat_ws('|', strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), " + ", ".join(f"coalesce(CAST(CAST(round({c} * 1e6) AS BIGINT) AS VARCHAR), 'null')" for c in O5) + ")) AS h FROM bars)"],
                     "SELECT symbol, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS content_hash FROM rh GROUP BY symbol"))
def dq9(spark, sf):
    return dq.content_hash(bars(spark, sf)).select("symbol", "n_rows", C("content_hash").cast("string").alias("content_hash"))


@query("DQ-10", with_([*FENCE, "fl AS (SELECT dirty.*, " + ", ".join(f"CASE WHEN ({c}_q3 > {c}_q1 AND ({c} < {LOHI[c][0]} OR {c} > {LOHI[c][1]})) OR abs(({c} - {c}_mu) / nullif({c}_sd, 0)) > 4 THEN 1 ELSE 0 END AS {c}_o" for c in O5) + " FROM dirty JOIN fe USING (symbol))"],
 f"SELECT symbol, count(*) AS rows_total, count(CASE WHEN greatest({', '.join(c + '_o' for c in O5)}) = 1 THEN 1 END) AS outliers_detected, CAST(sum({' + '.join(c + '_o' for c in O5)}) AS BIGINT) AS outliers_capped, CAST(sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in O5)}) AS BIGINT) AS missing_filled FROM fl GROUP BY symbol"))
def dq10(spark, sf):
    return dq.quality_report(dirty(spark, sf), "2002-01-01").select("symbol", "rows_total", "outliers_detected", "outliers_capped", "missing_filled")


@query("DQ-11", chain([BARS], "bars", [{"r20": pct("close", 20), "m200": mean("close", 200), "p252": pct("close", 252)}], "SELECT symbol, ts, " + ", ".join([rnd("r20", 8, "r20"), rnd("m200", 6, "m200")]) + " FROM {last} WHERE r20 IS NOT NULL AND m200 IS NOT NULL AND p252 IS NOT NULL"))
def dq11(spark, sf):
    p = Series()
    d = bars(spark, sf).withColumns({"r20": p.pct("close", 20), "m200": p.mean("close", 200), "p252": p.pct("close", 252), "p500": p.pct("close", 500)})
    d = dq.drop_warmup(d, ["r20", "m200", "p252", "p500"])
    return d.select(*KEYS, rd("r20", 8).alias("r20"), rd("m200", 6).alias("m200"))


@query("DQ-12", with_(D, f"SELECT symbol, ts, {rnd('CASE WHEN close IS NULL OR volume = 0 THEN 0 ELSE close / volume END', 8, 'x')}, {rnd('coalesce(open, 0)', 10, 'y')}, CASE WHEN close IS NULL OR volume = 0 OR open IS NULL THEN 0 ELSE 1 END AS finite_row FROM dirty"))
def dq12(spark, sf):
    inf = F.lit(float("inf"))
    d = dirty(spark, sf).select(*KEYS, F.when(C("volume") == 0, inf).otherwise(C("close") / nz("volume")).alias("x"), C("open").alias("y"))
    d = dq.finite(d, ["x", "y"])
    return d.select(*KEYS, rd("x", 8).alias("x"), rd("y", 10).alias("y"), "finite_row")


# projections -----------------------------------------------------------------------------------
@query("PRJ-1", with_([*CAT, f"lg AS ({unpivoted('symbol')})"], "SELECT f.feature, count(lg.feature) AS n FROM (SELECT unnest([" + ", ".join(repr(c) for c in COLUMNS) + "]) AS feature) f LEFT JOIN lg USING (feature) GROUP BY 1"))
def prj1(spark, sf):
    """What discovery by exclusion leaves of the catalogue's table, and how many values each column has."""
    from ..operators import labels as lb
    d = streamed(spark, sf)
    skip = {*lb.LABEL_COLUMNS, *lb.OHLCV, *lb.REGIME_COLUMNS, *KEYS}
    cols = [c for c in d.columns if c not in skip]
    n = d.agg(*[F.count(c).alias(c) for c in cols])
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), C(c).alias("n")) for c in cols])).alias("x")).select("x.*")


@query("PRJ-2", with_(FEAT, f"SELECT symbol, ts, {rnd('coalesce(ret_5d, 0)', 6, 'ret_5d')}, {rnd('coalesce(bb_pct, 0)', 6, 'bb_pct')}, 0.0::DOUBLE AS absent FROM feat"))
def prj2(spark, sf):
    d = feature_frame(spark, sf)
    want = ["ret_5d", "bb_pct", "absent"]
    return rounded(d.select(*KEYS, *[(F.coalesce(C(c), F.lit(0.0)) if c in d.columns else F.lit(0.0)).alias(c) for c in want]))


@query("PRJ-3", b_sql("WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-06-30'"))
def prj3(spark, sf):
    return bars(spark, sf).where(C("ts").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1999-06-30").cast("timestamp_ntz"))).select(*KEYS, *O5)


@query("PRJ-4", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^[A-Z]{1,5}$')")
def prj4(spark, sf):
    return table(spark, sf, "part").where(C("p_type").rlike("^[A-Z]{1,5}$")).select("p_partkey", "p_type")


@query("PRJ-5", b_sql("WHERE close * volume >= 3000", "symbol, ts, close, volume"))
def prj5(spark, sf):
    return bars(spark, sf).where(C("close") * C("volume") >= 3000).select(*KEYS, "close", "volume")


@query("PRJ-6", with_([EXPLOG], "SELECT id, type, sharpe FROM explog WHERE type = 'experiment' AND list_has_any(tags, ['that', 'with', 'from']) AND sharpe >= 0.5 AND contains(lower(title || ' ' || array_to_string(tags, ' ')), 'the') ORDER BY id DESC LIMIT 10"))
def prj6(spark, sf):
    return explog.search(experiments(spark, sf), "The", "experiment", ["that", "with", "from"], 0.5, 10).select("id", "type", "sharpe")


@query("PRJ-7", chain([BARS], "bars", [{"r": pct("close")}], f"SELECT symbol, ts, {rnd('CASE WHEN r IS NOT NULL THEN least(greatest(r, -0.01), 0.01) END', 9, 'clipped')}, CAST(sign(r) AS DOUBLE) AS s, CASE WHEN r > 0.01 THEN 'up' WHEN r < -0.01 THEN 'down' ELSE 'flat' END AS kind FROM {{last}}"))
def prj7(spark, sf):
    r = C("r")
    d = bars(spark, sf).withColumn("r", Series().pct("close"))
    return d.select(*KEYS, rd(clip(r, -0.01, 0.01), 9).alias("clipped"), F.signum(r).alias("s"), F.when(r > 0.01, "up").when(r < -0.01, "down").otherwise("flat").alias("kind"))


@query("PRJ-8", b_sql(cols="symbol, ts, CASE WHEN month(ts) IN (11, 12, 1, 2, 3, 4) THEN 1 ELSE 0 END AS favorable_season"))
def prj8(spark, sf):
    return bars(spark, sf).select(*KEYS, flag(F.month("ts").isin(11, 12, 1, 2, 3, 4)).alias("favorable_season"))


@query("PRJ-9", with_([*FEAT, "m AS (SELECT year(ts) AS fold, quantile_cont(abs(fwd_return), 0.5) AS md FROM feat WHERE fwd_return IS NOT NULL GROUP BY 1)"], f"SELECT symbol, ts, {rnd('fwd_return', 8, 'fwd_return')} FROM feat JOIN m ON year(ts) = fold WHERE abs(fwd_return) > 0.25 * md"))
def prj9(spark, sf):
    from ..operators import ml
    d = feature_frame(spark, sf).where("fwd_return IS NOT NULL").withColumn("fold", F.year("ts"))
    return rounded(ml.nontrivial(d).select(*KEYS, "fwd_return"), 8)


# joins -----------------------------------------------------------------------------------------
@query("JN-1", with_(SIG, "SELECT symbol, ts, signal, round(close + 1.7e-13, 10) + 0.0 AS close FROM sig JOIN bars USING (symbol, ts, close) WHERE signal <> 0"))
def jn1(spark, sf):
    s = signals(spark, sf).where("signal <> 0").select(*KEYS, "signal")
    return s.join(bars(spark, sf).select(*KEYS, "close"), ["symbol", "ts"]).select(*KEYS, "signal", rd("close", 10).alias("close"))


@query("JN-2", with_(SIG, "SELECT bars.symbol, bars.ts, coalesce(x.signal, 0) AS signal FROM bars LEFT JOIN (SELECT * FROM sig WHERE signal > 0) x ON x.symbol = bars.symbol AND x.ts = bars.ts"))
def jn2(spark, sf):
    s = signals(spark, sf).where("signal > 0").select(*KEYS, "signal")
    return bars(spark, sf).select(*KEYS).join(s, ["symbol", "ts"], "left").withColumn("signal", F.coalesce("signal", F.lit(0)))


@query("JN-3", with_(macro_wide(["vix", "tlt"]), "SELECT symbol, ts, round(_m_vix, 8) AS vix, round(_m_tlt, 8) AS tlt FROM mbars"))
def jn3(spark, sf):
    d = cross.attach_macro(bars(spark, sf), macro(spark, sf), {"^VIX": "vix", "TLT": "tlt"})
    return d.select(*KEYS, F.round("_m_vix", 8).alias("vix"), F.round("_m_tlt", 8).alias("tlt"))


@query("JN-3b", with_([BARS, MACRO], "SELECT bars.symbol, bars.ts, round(m.close, 8) AS vix FROM bars ASOF LEFT JOIN (SELECT * FROM macro WHERE tk = 0) m ON bars.ts >= m.ts"))
def jn3b(spark, sf):
    """Strict backward as-of: the last macro value at or before each bar, also from days without a bar.

    The macro series is spread over the calendar once (one row per day), so the bars meet it in an
    equi-join on the day instead of a range join.
    """
    m = macro(spark, sf).where("ticker = '^VIX'").select(C("ts").cast("date").alias("day"), "close")
    b = bars(spark, sf)
    span = b.select(C("ts").cast("date").alias("day")).unionByName(m.select("day")).agg(F.min("day").alias("a"), F.max("day").alias("z"))
    days = span.select(F.explode(F.sequence("a", "z")).alias("day"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)   # one row per calendar day
    known = days.join(m, "day", "left").select("day", F.last("close", ignorenulls=True).over(w).alias("vix"))
    return b.withColumn("day", C("ts").cast("date")).join(known, "day", "left").select(*KEYS, F.round("vix", 8).alias("vix"))


@query("JN-4", with_([BARS, "s AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM bars)", "k AS (SELECT a, b, unnest(range(0, 200)) AS i FROM s)",
                      "t1 AS (SELECT b, i, CAST(a + to_months(CAST(i AS INTEGER)) AS DATE) AS t0 FROM k)", "t2 AS (SELECT *, CAST(t0 + INTERVAL 6 MONTH AS DATE) - 1 AS te FROM t1)",
                      "t3 AS (SELECT *, CAST(te + INTERVAL 1 MONTH AS DATE) + 1 AS us FROM t2)", "t4 AS (SELECT *, CAST(us + INTERVAL 1 MONTH AS DATE) - 1 AS ue FROM t3)"],
                     "SELECT CAST(i + 1 AS INTEGER) AS fold, CASE WHEN ts <= te THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT symbol) AS symbols FROM bars JOIN t4 ON ue <= b AND (ts BETWEEN t0 AND te OR ts BETWEEN us AND ue) GROUP BY 1, 2"))
def jn4(spark, sf):
    b = bars(spark, sf)
    d = sp.assign_month_folds(b, sp.month_folds(b))
    return d.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("symbol").alias("symbols"))


@query("JN-6", f"""WITH {BARS}, ev AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 480000)
SELECT symbol, ts, max(5.0 - abs(date_diff('day', d, CAST(ts AS DATE)))) AS weight, count(*) AS n_events FROM bars JOIN ev ON date_diff('day', d, CAST(ts AS DATE)) BETWEEN -4 AND 4 GROUP BY symbol, ts""")
def jn6(spark, sf):
    ev = table(spark, sf, "orders").where("o_totalprice > 480000").select(C("o_orderdate").cast("date").alias("event")).distinct()
    w = {k: 5.0 - abs(k) for k in range(-4, 5)}
    hit = cal.event_proximity(bars(spark, sf), ev, w, "weight", F.max)
    cnt = cal.event_proximity(bars(spark, sf), ev, {k: 1.0 for k in w}, "n_events", F.sum)
    return hit.where("weight > 0").select(*KEYS, "weight").join(cnt.select(*KEYS, C("n_events").cast("bigint").alias("n_events")), ["symbol", "ts"])


@query("JN-7", with_([UNIVERSE, BARS], """SELECT symbol, sector, 'untrained' AS state FROM universe WHERE symbol IN (SELECT symbol FROM bars) AND symbol NOT IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 530)
UNION ALL SELECT symbol, sector, 'trained' FROM universe WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 530)"""))
def jn7(spark, sf):
    b, u = bars(spark, sf), universe(spark, sf)
    trained = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n >= 530").select("symbol")
    have = u.join(b.select("symbol").distinct(), "symbol", "left_semi")
    a = have.join(trained, "symbol", "left_anti").select("symbol", "sector", F.lit("untrained").alias("state"))
    return a.unionByName(u.join(trained, "symbol", "left_semi").select("symbol", "sector", F.lit("trained").alias("state")))


def current_book(spark, sf):
    """Holdings: the three most liquid names of each date of the last ten days."""
    b = bars(spark, sf)
    b = with_row(b, b.agg(F.max("ts").alias("_last"))).where(C("ts") > C("_last") - F.expr("INTERVAL 10 DAYS")).withColumn("score", rk.ranking_score("liquidity"))
    return rk.top_n(b, 3).select(C("symbol").alias("holding")).distinct()


CORR8 = [BARS, f"rt AS (SELECT symbol, ts, {pct('close')} AS r FROM bars)",
         "bk AS (SELECT DISTINCT symbol AS holding FROM (SELECT symbol, row_number() OVER (PARTITION BY ts ORDER BY close * volume DESC, symbol) AS k FROM bars WHERE ts > (SELECT max(ts) FROM bars) - INTERVAL 10 DAY) WHERE k <= 3)",
         "cp AS (SELECT x.symbol AS candidate, holding, count(*) AS n, corr(x.r, y.r) AS c FROM rt x JOIN rt y ON y.ts = x.ts JOIN bk ON y.symbol = holding WHERE x.symbol <> y.symbol AND x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2)",
         "mc AS (SELECT candidate, coalesce(max(CASE WHEN n >= 20 THEN abs(c) END), 0) AS max_corr, count(CASE WHEN n >= 20 THEN 1 END) AS n_compared FROM cp GROUP BY candidate)"]


# every symbol against all others of its nation
CORRN = [BARS, UNIVERSE, CORR8[1],
         """cp AS (SELECT a.symbol AS candidate, b.symbol AS holding, count(*) AS n, corr(x.r, y.r) AS c FROM universe a JOIN universe b ON a.universe = b.universe AND a.symbol <> b.symbol
          JOIN rt x ON x.symbol = a.symbol JOIN rt y ON y.symbol = b.symbol AND y.ts = x.ts WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2)""", CORR8[-1]]


@query("JN-8", with_(CORRN, f"SELECT candidate, {rnd('max_corr', 6, 'max_corr')}, n_compared FROM mc"))
def jn8(spark, sf):
    r = bars(spark, sf).withColumn("ret", Series().pct("close"))
    return rounded(rs.correlation_within(r, universe(spark, sf).select("symbol", "universe")))


def text_queries(spark, sf):
    """Queries of the similarity join: log entries of the other types."""
    return experiments(spark, sf).where("type <> 'experiment'").select(C("id").alias("qid"), C("title").alias("q_title"), C("tags").alias("q_tags"))


SIMSQL = [EXPLOG, "qq AS (SELECT id AS qid, title AS q_title, tags AS q_tags FROM explog WHERE type <> 'experiment')",
  "ex AS (SELECT id, title, tags FROM explog WHERE type = 'experiment')",
  r"dc AS (SELECT 'q' AS s, qid AS k, regexp_extract_all(lower(q_title), '([\p{L}\p{N}_]{2,})', 1) AS w FROM qq UNION ALL SELECT 'e', id, regexp_extract_all(lower(title), '([\p{L}\p{N}_]{2,})', 1) FROM ex)",
  "tf AS (SELECT s, k, term, 1 + ln(count(*)) AS f FROM (SELECT s, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM dc) GROUP BY 1, 2, 3)",
  "df AS (SELECT term, count(*) AS df FROM tf WHERE s = 'e' GROUP BY 1)",
  "wt AS MATERIALIZED (SELECT s, k, term, f * (ln((2.0 + (SELECT count(*) FROM ex)) / (1.0 + coalesce(df, 0))) + 1) AS b, f * (ln((2.0 + (SELECT count(*) FROM ex)) / (2.0 + coalesce(df, 0))) + 1) AS a FROM tf LEFT JOIN df USING (term))",
  "nm AS (SELECT s, k, sum(a * a) AS a2, sum(b * b) AS b2 FROM wt GROUP BY 1, 2)",
  "ds AS (SELECT x.k AS qid, y.k AS id, sum(x.a * y.a) AS d, sum(y.a * y.a - y.b * y.b) AS more FROM wt x JOIN wt y ON x.term = y.term AND x.s = 'q' AND y.s = 'e' GROUP BY 1, 2)",
  "cs AS (SELECT qid AS qk, id AS ek, d / sqrt(p.a2 * (r.b2 + more)) AS c FROM ds JOIN nm p ON p.s = 'q' AND p.k = qid JOIN nm r ON r.s = 'e' AND r.k = id)",
  "sh AS (SELECT qid, id, count(*) AS n FROM (SELECT qid, unnest(q_tags) AS tag FROM qq) JOIN (SELECT id, unnest(tags) AS tag FROM ex) USING (tag) GROUP BY 1, 2)",
  """jq AS (SELECT qq.qid, ex.id, trim(q_title) <> '' AS asked, CASE WHEN len(q_tags) > 0 AND len(tags) > 0 THEN coalesce(sh.n, 0)::DOUBLE / (len(q_tags) + len(tags) - coalesce(sh.n, 0)) ELSE 0 END AS j, coalesce(c, 0) AS c
   FROM qq CROSS JOIN ex LEFT JOIN cs ON qk = qid AND ek = ex.id LEFT JOIN sh ON sh.qid = qq.qid AND sh.id = ex.id)""",
  "al AS (SELECT qid, id, CASE WHEN asked THEN 0.6 * j + 0.4 * c ELSE j END AS score FROM jq)"]


@query("JN-9", with_(SIMSQL, f"SELECT qid, id, CAST(rk AS INTEGER) AS \"rank\", {rnd('score', 6, 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS rk FROM al WHERE score > 0.30) WHERE rk <= 3"))
def jn9(spark, sf):
    log = experiments(spark, sf).where("type = 'experiment'").select("id", "title", "tags")
    return rounded(explog.similar(text_queries(spark, sf), log))


def tagged(spark, sf):
    """Feature sets of experiments: five names picked from the catalogue by the document's numbers."""
    names = sorted({x for v in explog.ARCHETYPES.values() for x in v.split()})
    arr = F.array(*[F.lit(n) for n in names])
    k = len(names)
    picks = [F.element_at(arr, ((C("doc_id") * m + C("n_chars")) % k + 1).cast("int")) for m in (1, 3, 5, 7, 11)]
    return table(spark, sf, "documents").select(C("doc_id").alias("id"), F.array_distinct(F.array(*picks)).alias("tags"), ((C("n_chars") % 400 - 150) / 100.0).alias("sharpe"))


_NAMES = sorted({x for v in explog.ARCHETYPES.values() for x in v.split()})
TAGGED = ("tg AS (SELECT doc_id AS id, n_chars, list_distinct([" + ", ".join(f"([{', '.join(repr(n) for n in _NAMES)}])[(doc_id * {m} + n_chars) % {len(_NAMES)} + 1]" for m in (1, 3, 5, 7, 11)) + "]) AS tags FROM documents)")
ARMV = "am AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', [{', '.join(repr(x) for x in v.split())}])" for i, (k, v) in enumerate(explog.ARCHETYPES.items())) + ") t(pos, arm, f))"
NEAR = [TAGGED, ARMV, "jc AS (SELECT id, n_chars, pos, arm, len(list_intersect(tags, f))::DOUBLE / len(list_distinct(list_concat(tags, f))) AS s FROM tg CROSS JOIN am)",
        "nr AS (SELECT id, n_chars, arm, s FROM jc QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, pos) = 1)"]


@query("JN-10", with_(NEAR, f"SELECT id, CASE WHEN s > 0.15 THEN arm END AS arm, {rnd('s', 8, 'arm_score')} FROM nr"))
def jn10(spark, sf):
    d = explog.nearest_archetype(tagged(spark, sf), explog.archetypes(spark))
    return rounded(d.select("id", "arm", "arm_score"), 8)


@query("AGG-17b", with_(NEAR, f"SELECT arm, count(*) AS n, {rnd('avg((n_chars % 400 - 150) / 100.0)', 6, 'mean')}, max((n_chars % 400 - 150) / 100.0) AS best FROM nr WHERE s > 0.15 GROUP BY arm"))
def agg17b(spark, sf):
    """Arm statistics seeded from the log by nearest archetype."""
    d = explog.nearest_archetype(tagged(spark, sf), explog.archetypes(spark)).where("arm IS NOT NULL")
    s = explog.arm_statistics(d.select("arm", C("sharpe").alias("reward"), C("id").alias("t")))
    return rounded(s.select("arm", "n", "mean", "best"))


@query("JN-11", with_([*SIG, "pm AS (SELECT unnest([0.0, 0.0005, 0.001, 0.002]) AS side)", "px AS (SELECT sig.*, side FROM sig CROSS JOIN pm)", *bt("px", "side", "symbol, side")], f"SELECT symbol, side::DOUBLE AS side, {rnd(sharpe('net_return'), 6, 'sharpe')} FROM bt GROUP BY symbol, side"))
def jn11(spark, sf):
    d = repeat(signals(spark, sf), [{"side": x} for x in (0.0, 0.0005, 0.001, 0.002)])
    return rounded(bk.sharpes(bk.run(d, C("side"), ("symbol", "side")), ("symbol", "side")))


# set operations --------------------------------------------------------------------------------
@query("SET-1", f"WITH {BARS} SELECT symbol, ts, close, volume FROM bars WHERE ts < TIMESTAMP '1998-01-01' UNION ALL SELECT symbol, ts, close, NULL FROM bars WHERE ts >= TIMESTAMP '1998-01-01'")
def set1(spark, sf):
    b = bars(spark, sf)
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return b.where(C("ts") < cut).select(*KEYS, "close", "volume").unionByName(b.where(C("ts") >= cut).select(*KEYS, "close"), allowMissingColumns=True)


@query("SET-2", with_([UNIVERSE, BARS], "SELECT coalesce(u.symbol, b.symbol) AS symbol, coalesce(u.sector, 'unknown') AS sector FROM (SELECT * FROM universe WHERE sector <> 'ASIA') u FULL JOIN (SELECT DISTINCT symbol FROM bars) b ON u.symbol = b.symbol"))
def set2(spark, sf):
    u = universe(spark, sf).where("sector <> 'ASIA'").select("symbol", "sector")
    rest = bars(spark, sf).select("symbol", F.lit("unknown").alias("sector")).distinct()
    return pn.dedup_keep([u, rest], ["symbol"])


@query("SET-3", f"WITH {BARS} SELECT symbol, ts, close + CASE WHEN ts >= TIMESTAMP '1999-01-01' THEN 1 ELSE 0 END AS close FROM bars")
def set3(spark, sf):
    """History and target overlap; the later source wins."""
    b = bars(spark, sf).select(*KEYS, "close")
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    target = b.where(C("ts") >= cut).withColumn("close", C("close") + 1)
    return pn.dedup_keep([target, b.where(C("ts") < F.lit("2000-01-01").cast("timestamp_ntz"))], ["symbol", "ts"])


def _filled(t: str) -> str:
    return f"SELECT '{t}' AS source, name, n FROM (UNPIVOT (SELECT count(COLUMNS('(.*)')) AS '\\1' FROM {t}) ON COLUMNS(*) INTO NAME name VALUE n)"


@query("SET-4", with_([BARS, "need AS (SELECT unnest(['ts', 'symbol', 'open', 'high', 'low', 'close', 'volume']) AS name)", "have AS (" + " UNION ALL ".join(map(_filled, ("bars", "orders", "events"))) + ")",
  "src AS (SELECT DISTINCT source FROM have)"],
  """SELECT source, need.name, 'missing' AS verdict, 0::BIGINT AS n FROM src, need WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.source = src.source AND h.name = need.name)
  UNION ALL SELECT source, name, CASE WHEN name IN (SELECT name FROM need) THEN 'present' ELSE 'extra' END, n FROM have"""))
def set4(spark, sf):
    """What each input has and lacks of a bar's columns, what it has besides, and how many values are there."""
    given = {"bars": bars(spark, sf), "orders": table(spark, sf, "orders"), "events": events(spark, sf)}
    parts = [dq.column_differences(d, [*KEYS, *O5]).withColumn("source", F.lit(name)) for name, d in given.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SET-5", with_([EXPLOG], "SELECT a.id, b.id AS other, len(list_intersect(a.tags, b.tags))::INTEGER AS both_, len(list_distinct(list_concat(a.tags, b.tags)))::INTEGER AS either FROM explog a JOIN explog b ON b.id = a.id + 1"))
def set5(spark, sf):
    e = experiments(spark, sf).select("id", "tags")
    n = e.select((C("id") - 1).alias("id"), C("id").alias("other"), C("tags").alias("t2"))
    return e.join(n, "id").select("id", "other", F.size(F.array_intersect("tags", "t2")).alias("both_"), F.size(F.array_union("tags", "t2")).alias("either"))


# ranking ---------------------------------------------------------------------------------------
RANK = [BARS, *stack("bars", [{"mom": f"CASE WHEN lag(close, 63) {SER} IS NOT NULL THEN close / lag(close, 63) {SER} - 1 END", "_l50": mean("close", 50), "_l100": mean("close", 100), "r": pct("close"), "_ch": f"CASE WHEN count(high) {last(252)} >= 63 THEN (close - min(low) {last(252)}) / (max(high) {last(252)} - min(low) {last(252)} + 1e-9) END"},
  {"up": sflag("_l50 > _l100"), "vol_21d": f"({std('r', 21)}) * sqrt(252.0)", "conf": "0.5 + least(greatest(coalesce(mom, 0), -0.4), 0.4)", "_mr": rank("mom", 126, 0)[0]},
  {"mom_12_1_rank": rank_of("_mr", "mom", 63), "score": "close * volume"}], "rk")]


def rank_frame(spark, sf):
    """Bars with momentum, trend flag, volatility and a confidence derived from momentum."""
    p = Series()
    d = bars(spark, sf).withColumns({"mom": p.pct("close", 63), "_a": p.mean("close", 50), "_b": p.mean("close", 100), "r": p.pct("close"), "_hi": p.max("high", 252, 63), "_lo": p.min("low", 252, 63)})
    d = d.withColumns({"sma_50_above_200": flag(C("_a") > C("_b")), "vol_21d": p.std("r", 21) * math.sqrt(252.0), "confidence": 0.5 + clip(F.coalesce("mom", F.lit(0.0)), -0.4, 0.4),
                       "channel_pos_52w": (C("close") - C("_lo")) / (C("_hi") - C("_lo") + 1e-9), "_arr": p.sorted_frame("mom", 126)})
    d = d.withColumn("mom_12_1_rank", pct_rank("_arr", "mom", 63))
    return d.drop("_a", "_b", "_hi", "_lo", "_arr")


@query("TOP-1", with_(RANK, f"SELECT symbol, ts, CAST(k AS INTEGER) AS \"rank\", {rnd('score', 6, 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS k FROM rk) WHERE k <= 10"))
def top1(spark, sf):
    d = bars(spark, sf).withColumn("score", rk.ranking_score("liquidity"))
    return rounded(rk.top_n(d, 10).select(*KEYS, "rank", "score"))


@query("TOP-2", with_([*RANK, "x AS (SELECT *, CASE WHEN mom IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY mom NULLS LAST) + (count(*) OVER (PARTITION BY ts, mom) - 1) / 2.0) / count(mom) OVER (PARTITION BY ts) END AS cr FROM rk)"],
  "SELECT symbol, ts, " + ", ".join([rnd("coalesce(cr, 0.5)", 6, "cross_momentum"), rnd("close * volume", 6, "liquidity"), rnd("coalesce(mom_12_1_rank, 0.5)", 6, "momentum"), rnd("coalesce(_ch, 0.5)", 6, "channel"), rnd("0.5 * conf + 0.5 * coalesce(mom_12_1_rank, 0.5)", 6, "composite"),
   rnd("conf / greatest(vol_21d, 0.08)", 6, "vol_adjusted")]) + " FROM x"))
def top2(spark, sf):
    d = rk.cross_rank(rank_frame(spark, sf), "mom", "cross_mom_rank")
    modes = ("cross_momentum", "liquidity", "momentum", "channel", "composite")
    va = F.when(C("vol_21d").isNull(), C("confidence") / 0.08).otherwise(rk.ranking_score("model", vol_adjusted=True))
    return rounded(d.select(*KEYS, *[rk.ranking_score(m).alias(m) for m in modes], va.alias("vol_adjusted")))


ELIG = "el AS (SELECT *, CASE WHEN mom < -0.05 THEN 0 ELSE 1 END AS regime FROM rk)"


@query("TOP-3", with_([*RANK, ELIG], f"SELECT symbol, ts, {rnd('conf', 8, 'confidence')} FROM el WHERE close > 0 AND close * volume >= 1000 AND conf >= CASE WHEN regime = 0 THEN 0.45 ELSE 0.50 END AND up = 1"))
def top3(spark, sf):
    d = rank_frame(spark, sf).withColumn("regime", F.when(C("mom") < -0.05, 0).otherwise(1))
    return rounded(rk.eligible(d, 1000.0, 0.50, 0.45, True, regime="regime").select(*KEYS, "confidence"), 8)


GATE = [*RANK, "br AS (SELECT ts, avg(CASE WHEN up = 1 THEN 1.0 ELSE 0.0 END) AS breadth FROM rk GROUP BY ts)", "bn AS (SELECT ts, up AS bench_on FROM rk WHERE symbol = 'S1')",
        "gt AS (SELECT br.ts, breadth, bench_on, CAST(CASE WHEN bench_on = 0 THEN 0 WHEN breadth < 0.3 THEN 5 ELSE 10 END AS INTEGER) AS n_eff FROM br LEFT JOIN bn ON br.ts = bn.ts)"]


def gate_frame(d):
    bench = d.where("symbol = 'S1'").select("ts", C("sma_50_above_200").alias("bench_on"))
    return rk.exposure_gate(rk.breadth(d).join(bench, "ts", "left"), 10, 0.3)


@query("AGG-26", with_(GATE, f"SELECT ts, {rnd('breadth', 8, 'breadth')} FROM br"))
def agg26(spark, sf):
    return rounded(rk.breadth(rank_frame(spark, sf)), 8)


@query("TOP-4", with_(GATE, "SELECT ts, n_eff FROM gt"))
def top4(spark, sf):
    return gate_frame(rank_frame(spark, sf)).select("ts", "n_eff")


SEL = [*GATE, "sl AS (SELECT * FROM (SELECT rk.*, n_eff, row_number() OVER (PARTITION BY rk.ts ORDER BY score DESC, symbol) AS k FROM rk JOIN gt ON rk.ts = gt.ts) WHERE k <= n_eff)", "wt AS (SELECT symbol, ts, score / (sum(score) OVER (PARTITION BY ts) + 1e-9) AS weight, 1.0 / count(*) OVER (PARTITION BY ts) AS equal_weight FROM sl)"]


def selected(spark, sf):
    d = rank_frame(spark, sf).withColumn("score", rk.ranking_score("liquidity"))
    return rk.top_n(d, 10).join(gate_frame(d).select("ts", "n_eff"), "ts").where("rank <= n_eff")   # a book never exceeds ten names


@query("TOP-5", with_(SEL, f"SELECT symbol, ts, {rnd('weight', 8, 'weight')}, {rnd('equal_weight', 8, 'equal_weight')} FROM wt"))
def top5(spark, sf):
    s = selected(spark, sf)
    e = rk.weights(s, proportional=False).select(*KEYS, C("weight").alias("equal_weight"))
    return rounded(rk.weights(s).select(*KEYS, "weight").join(e, ["symbol", "ts"]), 8)


@query("TOP-6", with_(RANK, "SELECT ts, string_agg(symbol, ',' ORDER BY k) AS top FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS k FROM rk) WHERE k <= 5 GROUP BY ts"))
def top6(spark, sf):
    return rk.top_list(bars(spark, sf).withColumn("score", rk.ranking_score("liquidity")), 5)


@query("TOP-7", with_([EXPLOG], "SELECT id, oos_sharpe FROM explog WHERE type = 'experiment' ORDER BY oos_sharpe DESC, id DESC LIMIT 5"))
def top7(spark, sf):
    return experiments(spark, sf).where("type = 'experiment'").orderBy(F.desc("oos_sharpe"), F.desc("id")).limit(5).select("id", "oos_sharpe")


ARMSTAT = [*NEAR, "st AS (SELECT arm, count(*) AS n, avg((n_chars % 400 - 150) / 100.0) AS mean FROM nr WHERE s > 0.15 AND arm <> 'quality_growth' GROUP BY arm)"]


@query("TOP-10", with_(ARMSTAT, """SELECT am.arm, coalesce(n, 0) AS n, round(mean + 1.7e-9, 6) + 0.0 AS mean, CASE WHEN n IS NULL THEN 'untested' WHEN mean >= 0.6 THEN 'exploit' WHEN mean >= 0.3 THEN 'refine' ELSE 'explore' END AS guidance,
 CAST(row_number() OVER (ORDER BY CASE WHEN n IS NULL THEN 'inf'::DOUBLE ELSE mean + sqrt(ln((SELECT sum(n) FROM st)) / n) END DESC, pos) AS INTEGER) AS place FROM am LEFT JOIN st ON am.arm = st.arm"""))
def top10(spark, sf):
    arms = explog.archetypes(spark)
    d = explog.nearest_archetype(tagged(spark, sf), arms).where("arm <> 'quality_growth'")
    st = explog.arm_statistics(d.select("arm", C("sharpe").alias("reward"), C("id").alias("t")))
    return rounded(explog.leaderboard(st, arms).select("arm", "n", "mean", "guidance", "place"))


@query("TOP-10b")
def top10b(spark, sf):
    arms = explog.archetypes(spark)
    d = explog.nearest_archetype(tagged(spark, sf), arms).where("arm IS NOT NULL")
    return explog.thompson(explog.arm_statistics(d.select("arm", C("sharpe").alias("reward"), C("id").alias("t"))), arms)


@query("TOP-11", with_([BARS], f"SELECT {ROWS} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 3"))
def top11(spark, sf):
    return rk.last_rows(bars(spark, sf), 3).select(*KEYS, *O5)


# remaining aggregates --------------------------------------------------------------------------
@query("AGG-24", with_([*SEL, UNIVERSE, "se AS (SELECT ts, sector, sum(weight) AS exposure FROM wt JOIN universe USING (symbol) GROUP BY 1, 2)", "ef AS (SELECT ts, 1 / sum(weight * weight) AS effective_n FROM wt GROUP BY ts)"],
  f"SELECT se.ts, sector, {rnd('exposure', 8, 'exposure')}, {rnd('effective_n', 6, 'effective_n')}, exposure > 0.5 AS concentrated FROM se JOIN ef ON se.ts = ef.ts"))
def agg24(spark, sf):
    d = rk.sector_exposure(rk.weights(selected(spark, sf)), universe(spark, sf))
    return d.select("ts", "sector", rd("exposure", 8).alias("exposure"), rd("effective_n", 6).alias("effective_n"), "concentrated")


@query("BT-15", with_([*SEL, f"p0 AS (SELECT bars.symbol, bars.ts, coalesce(weight, 0) AS w, bars.close FROM bars LEFT JOIN wt ON wt.symbol = bars.symbol AND wt.ts = bars.ts)", f"p1 AS (SELECT *, coalesce(lag(w) {SER}, 0) AS held, coalesce(close / lag(close) {SER} - 1, 0) AS ret FROM p0)",
  f"p2 AS (SELECT *, abs(held - coalesce(lag(held) {SER}, 0)) AS turn FROM p1)"], f"SELECT ts, {rnd('sum(held * ret)', 9, 'gross_return')}, {rnd('sum(turn)', 8, 'turnover')}, count(CASE WHEN held <> 0 THEN 1 END) AS n_held, {rnd('sum(held * ret) - sum(turn) * 0.0015', 9, 'net_return')} FROM p2 GROUP BY ts"))
def bt15(spark, sf):
    d = rk.portfolio_return(rk.weights(selected(spark, sf)), bars(spark, sf))
    return d.select("ts", rd("gross_return", 9).alias("gross_return"), rd("turnover", 8).alias("turnover"), "n_held", rd("net_return", 9).alias("net_return"))


@query("AGG-28", with_([EXPLOG], "SELECT session, count(*) AS n, max(sharpe) AS best_sharpe, count(CASE WHEN type = 'promotion' THEN 1 END) AS promoted, count(CASE WHEN oos_sharpe >= 1.5 THEN 1 END) AS significant FROM explog GROUP BY session"))
def agg28(spark, sf):
    return experiments(spark, sf).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("sharpe").alias("best_sharpe"), F.count_if(C("type") == "promotion").alias("promoted"), F.count_if(C("oos_sharpe") >= 1.5).alias("significant"))


@query("AGG-29", with_([*BT, f"x AS (SELECT *, lag(position) {SER} AS pp, lag(net_return) {SER} AS pr, max(equity) {PAST} AS pk FROM bt)"], f"""SELECT symbol, count(CASE WHEN position <> 0 AND coalesce(pp, 0) = 0 THEN 1 END) AS entries, count(CASE WHEN position = 0 AND pp <> 0 THEN 1 END) AS exits,
 {rnd('avg(CASE WHEN position = 0 AND pp <> 0 THEN CASE WHEN coalesce(pr, 0) > 0 THEN 1.0 ELSE 0.0 END END)', 6, 'exit_win_rate')}, {rnd('min((equity - pk) / pk)', 6, 'peak_to_trough')} FROM x GROUP BY symbol"""))
def agg29(spark, sf):
    p = Series()
    d = mt.underwater(stock_run(spark, sf), ("symbol",)).withColumns({"pp": F.coalesce(p.lag("position"), F.lit(0.0)), "pr": p.lag("net_return")})
    out = (C("position") == 0) & (C("pp") != 0)
    return rounded(d.groupBy("symbol").agg(F.count_if((C("position") != 0) & (C("pp") == 0)).alias("entries"), F.count_if(out).alias("exits"),
                                           F.avg(F.when(out, (C("pr") > 0).cast("double"))).alias("exit_win_rate"), F.min("drawdown").alias("peak_to_trough")))


@query("AGG-30", with_([EXPLOG], "SELECT id, sharpe, max_dd + 0.0 AS max_dd, CASE WHEN sharpe >= 1.5 THEN 'STRONG' WHEN sharpe >= 0.8 THEN 'MODERATE' ELSE 'WEAK' END AS verdict FROM explog WHERE type = 'experiment' AND sharpe >= 0.8 AND abs(max_dd) <= 25"))
def agg30(spark, sf):
    e = experiments(spark, sf).where((C("type") == "experiment") & (C("sharpe") >= 0.8) & (F.abs("max_dd") <= 25))
    return e.select("id", "sharpe", (C("max_dd") + 0.0).alias("max_dd"), F.when(C("sharpe") >= 1.5, "STRONG").when(C("sharpe") >= 0.8, "MODERATE").otherwise("WEAK").alias("verdict"))


@query("AGG-31", with_([EXPLOG, "x AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY CASE WHEN type = 'experiment' THEN oos_sharpe ELSE id END DESC, id DESC) AS place FROM explog)"],
  "SELECT type, CAST(place AS INTEGER) AS place, id, sharpe, oos_sharpe FROM x WHERE place <= CASE type WHEN 'promotion' THEN 3 WHEN 'experiment' THEN 5 WHEN 'failure' THEN 5 WHEN 'heuristic' THEN 5 ELSE 0 END"))
def agg31(spark, sf):
    return explog.digest(experiments(spark, sf))
