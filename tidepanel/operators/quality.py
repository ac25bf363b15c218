"""Data quality: validation, outliers, imputation, reports, provenance."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.windows import Series, clip, flag, nz

C = F.col
PRICES = ("open", "high", "low", "close")
OHLCV = (*PRICES, "volume")


def hard_validation(df: DataFrame) -> DataFrame:
    """Per symbol: duplicate timestamps, nulls, non-positive prices, inverted bars, and the verdict.

    Duplicates are counted from (symbol, ts) groups, which spreads a large symbol over many tasks.
    """
    any_null = reduce(lambda a, b: a | b, [C(c).isNull() for c in OHLCV])
    bad_px = reduce(lambda a, b: a | b, [C(c) <= 0 for c in PRICES])
    per = df.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("n"), F.count_if(any_null).alias("nulls"),
                                         F.count_if(bad_px).alias("px"), F.count_if(C("high") < C("low")).alias("inv"))
    out = per.groupBy("symbol").agg(F.sum("n").alias("n_rows"), F.sum(C("n") - 1).alias("duplicate_ts"), F.sum("nulls").alias("null_rows"),
                                    F.sum("px").alias("nonpositive_prices"), F.sum("inv").alias("high_below_low"))
    bad = C("duplicate_ts") + C("null_rows") + C("nonpositive_prices") + C("high_below_low")
    return out.withColumn("valid", flag(bad == 0))


def fences(df: DataFrame, cols=OHLCV, iqr: float = 3.0, fit_end=None) -> DataFrame:
    """Quartile fences, mean and deviation per symbol and column (optionally of bars up to ``fit_end``)."""
    d = df if fit_end is None else df.where(C("ts") <= F.lit(fit_end).cast("timestamp_ntz"))
    aggs = []
    for c in cols:
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))
        aggs += [q[0].alias(f"{c}_q1"), q[1].alias(f"{c}_q3"), F.avg(c).alias(f"{c}_mu"), F.stddev_samp(c).alias(f"{c}_sd")]
    out = d.groupBy("symbol").agg(*aggs)
    for c in cols:
        w = C(f"{c}_q3") - C(f"{c}_q1")
        out = out.withColumns({f"{c}_lo": F.when(w > 0, C(f"{c}_q1") - iqr * w), f"{c}_hi": F.when(w > 0, C(f"{c}_q3") + iqr * w)})
    return out


def outlier_flags(df: DataFrame, cols=OHLCV, z: float = 4.0, iqr: float = 3.0, fit_end=None) -> DataFrame:
    """<col>_outlier = outside the fences or |z| above the limit."""
    f = fences(df, cols, iqr, fit_end)
    d = df.join(f, "symbol")
    out = {f"{c}_outlier": flag((C(c) < C(f"{c}_lo")) | (C(c) > C(f"{c}_hi")) | (F.abs((C(c) - C(f"{c}_mu")) / nz(f"{c}_sd")) > z)) for c in cols}
    return d.withColumns(out).select(*df.columns, *out)


def winsorize(df: DataFrame, cols=OHLCV, iqr: float = 3.0, fit_end=None) -> DataFrame:
    """Clip whole columns to their fences; a column without spread is left alone."""
    d = df.join(fences(df, cols, iqr, fit_end), "symbol")
    def cap(c):
        return F.when(C(f"{c}_lo").isNull(), C(c)).otherwise(clip(c, C(f"{c}_lo"), C(f"{c}_hi")))
    return d.withColumns({c: cap(c) for c in cols}).select(*df.columns)


def next_known(x, rn: str, p: Series) -> Column:
    """The first known value from this row on, as the last one in the reverse order of the row numbers: a frame to the end of the series
    would be walked again for every row."""
    back = Window.partitionBy(*p.keys).orderBy(F.desc(rn)).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(x, ignorenulls=True).over(back)


def impute_ffill(df: DataFrame, cols=OHLCV, p: Series = Series()) -> DataFrame:
    d = df.withColumn("_fn", p.row())
    return d.withColumns({c: F.coalesce(p.ffill(c), next_known(C(c), "_fn", p)) for c in cols}).drop("_fn")


def impute_linear(df: DataFrame, cols=OHLCV, limit: int = 3, p: Series = Series()) -> DataFrame:
    """Straight line by row distance for up to ``limit`` rows of a gap, then forward and backward fill.

    Trailing gaps hold the last value for ``limit`` rows, as the forward direction of the rule implies.
    """
    d = df.withColumn("_rn", p.row())
    step = {}
    for c in cols:
        known = F.when(C(c).isNotNull(), C("_rn"))
        step |= {f"_pv_{c}": p.ffill(c), f"_nv_{c}": next_known(C(c), "_rn", p), f"_pr_{c}": F.last(known, ignorenulls=True).over(p.past),
                 f"_nr_{c}": next_known(known, "_rn", p)}
    d = d.withColumns(step)
    filled = {}
    for c in cols:
        dist = C("_rn") - C(f"_pr_{c}")
        line = C(f"_pv_{c}") + (C(f"_nv_{c}") - C(f"_pv_{c}")) * dist / nz((C(f"_nr_{c}") - C(f"_pr_{c}")).cast("double"))
        filled[c] = F.when(C(c).isNotNull(), C(c)).when(dist <= limit, F.coalesce(line, C(f"_pv_{c}")))
    d = d.withColumns(filled).select(*df.columns)
    return impute_ffill(d, cols, p)


def impute_median(df: DataFrame, cols=OHLCV) -> DataFrame:
    med = df.groupBy("symbol").agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in cols])
    d = df.join(med, "symbol")
    return d.withColumns({c: F.coalesce(C(c), C(f"_m_{c}")) for c in cols}).select(*df.columns)


def soft_validation(df: DataFrame, as_of) -> DataFrame:
    """Messages per symbol about negative prices, zero volume, future dates and inverted bars."""
    cut = F.lit(as_of).cast("timestamp_ntz")
    a = df.groupBy("symbol").agg(*[F.count_if(C(c) < 0).alias(f"neg_{c}") for c in PRICES], F.count_if(C("volume") == 0).alias("zero_volume"),
                                 F.count_if(C("ts") > cut).alias("future"), F.count_if(C("high") < C("low")).alias("inverted"))
    def msg(col, text):
        return F.when(C(col) > 0, F.concat("symbol", F.lit(": "), C(col).cast("string"), F.lit(text)))
    msgs = [msg(f"neg_{c}", f" negative values in '{c}' column") for c in PRICES]
    msgs += [msg("zero_volume", " zero-volume bars"), msg("future", " rows with future dates detected"), msg("inverted", " bars where high < low")]
    return a.withColumn("issues", F.array_compact(F.array(*msgs)))


def missing_fraction(df: DataFrame, cols=OHLCV, limit: float = 0.05) -> DataFrame:
    long = df.select("symbol", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), C(c).alias("v")) for c in cols])).alias("x"))
    a = long.groupBy("symbol", "x.column").agg(F.avg(C("x.v").isNull().cast("double")).alias("missing"))
    return a.withColumn("too_many", flag(C("missing") > limit))


def content_hash(df: DataFrame, cols=OHLCV) -> DataFrame:
    """Order-free provenance hash per symbol: row count and exact sum of the first 60 bits of each row's MD5.

    A row is its time and its values in millionths, so any engine gives the same sum.
    """
    values = [F.coalesce(F.round(C(c) * 1e6).cast("bigint").cast("string"), F.lit("null")) for c in cols]
    row = F.md5(F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), *values))
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).alias("content_hash"))


def quality_report(df: DataFrame, as_of, imputation: str = "ffill") -> DataFrame:
    """One row per symbol: rows, outliers, missing before and after, issues, hash of the cleaned data."""
    flags = outlier_flags(df)
    names = [f"{c}_outlier" for c in OHLCV]
    nulls = sum(C(c).isNull().cast("int") for c in OHLCV)
    before = flags.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(F.greatest(*names) == 1).alias("outliers_detected"),
                                         F.sum(sum(C(n) for n in names)).alias("outliers_capped"), F.sum(nulls).alias("missing_before"))
    clean = winsorize(df)
    clean = {"ffill": impute_ffill, "linear": impute_linear, "median": impute_median}[imputation](clean)
    after = clean.groupBy("symbol").agg(F.sum(nulls).alias("missing_after"))
    issues = soft_validation(clean, as_of).select("symbol", "issues")
    rep = before.join(after, "symbol").join(issues, "symbol").join(content_hash(clean).drop("n_rows"), "symbol")
    return rep.withColumn("missing_filled", C("missing_before") - C("missing_after"))


def surviving_columns(df: DataFrame, cols: list[str], share: float = 0.5) -> list[str]:
    """Columns with more than ``share`` non-null values: one pass, one row back to the driver."""
    row = df.agg(*[F.avg(C(c).isNotNull().cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if (row[c] or 0.0) > share]


def drop_warmup(df: DataFrame, cols: list[str], share: float = 0.5) -> DataFrame:
    return df.dropna(subset=surviving_columns(df, cols, share))


def finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-finite numbers become 0; ``finite_row`` tells which rows were clean."""
    def bad(c):
        return C(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    ok = reduce(lambda a, b: a & b, [~bad(c) for c in cols])
    d = df.withColumn("finite_row", flag(ok))
    return d.withColumns({c: F.when(bad(c), 0.0).otherwise(C(c)) for c in cols})


def column_differences(df: DataFrame, wanted: list[str]) -> DataFrame:
    """name, verdict (missing, present, extra), n (values that are not null): the columns of df held against those wanted, in one aggregate."""
    rows = [F.struct(F.lit(c).alias("name"), F.lit("present" if c in wanted else "extra").alias("verdict"), F.count(C(f"`{c}`")).alias("n")) for c in df.columns]
    rows += [F.struct(F.lit(c).alias("name"), F.lit("missing").alias("verdict"), F.lit(0).cast("bigint").alias("n")) for c in wanted if c not in df.columns]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*")
