"""The whole feature catalogue as one table, and its SQL: what drift, selection, scaling and training queries read."""
from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.windows import Series, flag
from ..operators import features as feats, labels
from ..operators.features import series
from ..session import scratch_root
from ..sources.panel import cached_features
from ..sources.tables import bars, macro
from .features import DIGITS, M, SQL
from .registry import OFFSET
from .sql import BARS, MACRO, SER, TICKERS, PAST, stack

FAMILIES = list(feats.FAMILIES)
COLUMNS = feats.feature_columns(FAMILIES)
KEYS = ("symbol", "ts")


def quick_round(c: str, digits: int) -> Column:
    """``rd`` as one multiplication and division where the scaled value keeps at least twelve bits below the point: rounding a double through
    its decimal text costs more than most features."""
    x, unit = F.col(c).cast("double") + OFFSET * 10.0 ** -digits, 10.0 ** digits
    return F.when(F.abs(x) < 2.0 ** 40 / unit, F.rint(x * unit) / unit).otherwise(F.round(x, digits)) + F.lit(0.0)


@cache
def _program(horizon: int):
    return series.program(FAMILIES, {"fwd_return": labels.fwd_return(Series(), horizon), "label": F.when(F.col("fwd_return").isNotNull(), flag(F.col("fwd_return") > 0))})


def _all(panel: DataFrame, given: DataFrame, horizon: int) -> DataFrame:
    """All families and the label in one pass over the bars, at the digits at which both engines agree."""
    digits = {c: DIGITS.get(f, 6) for f in FAMILIES for c in feats.FAMILIES[f].columns}
    return series.series_features(panel, _program(horizon), digits, given, {"fwd_return": "double", "label": "int"}, OFFSET)


def streamed(spark: SparkSession, sf: str, horizon: int = 5, panel: DataFrame | None = None) -> DataFrame:
    """The catalogue made anew in each pass, for queries that take few: a thousand bytes a bar are neither shuffled nor written. ``panel`` are
    the bars with columns that are to come along."""
    return _all(bars(spark, sf) if panel is None else panel, macro(spark, sf), horizon)


def catalogue(spark: SparkSession, sf: str, horizon: int = 5, panel: DataFrame | None = None) -> DataFrame:
    """symbol, ts, OHLCV, every column of the catalogue, fwd_return and label. Computed once for the given bars and series, read afterwards.
    ``panel`` are the bars with columns that are to come along."""
    given = macro(spark, sf)
    return cached_features(bars(spark, sf) if panel is None else panel, lambda p: _all(p, given, horizon), f"{scratch_root(spark)}/features", [*FAMILIES, f"forward {horizon}"], given)


def _names() -> list[str]:
    return sorted({n for _, _, names in M.values() for n in names.split()}, key=TICKERS.index)


def _ctes() -> list[str]:
    """One common table per family over the bars with all series, joined on the keys."""
    wide = ", ".join(f"max(CASE WHEN tk = {TICKERS.index(n)} THEN close END) AS r_{n}" for n in _names())
    ff = ", ".join(f"last_value(r_{n} IGNORE NULLS) {PAST} AS _m_{n}" for n in _names())
    out = [BARS.replace("bars AS (", "bars AS MATERIALIZED (", 1), MACRO, f"wide AS (SELECT ts, {wide} FROM macro GROUP BY ts)", f"mbars AS MATERIALIZED (SELECT bars.*, {ff} FROM bars LEFT JOIN wide USING (ts))"]
    for i, f in enumerate(FAMILIES):
        layers, ints = SQL[f] if f in SQL else M[f][:2]
        out += stack("bars" if f in SQL else "mbars", layers, f"q{i}")
        digits = DIGITS.get(f, 6)
        cols = ", ".join(f"({c})::DOUBLE AS {c}" if c in ints.split() else f"round({c} + {1.7e-3 * 10.0 ** -digits!r}, {digits}) + 0.0 AS {c}" for c in feats.FAMILIES[f].columns)
        out.append(f"p{i} AS MATERIALIZED (SELECT symbol, ts, {cols} FROM q{i})")
    joined = "bars" + "".join(f" JOIN p{i} USING (symbol, ts)" for i in range(len(FAMILIES)))
    out.append(f"cat0 AS (SELECT *, lead(close, 5) {SER} / close - 1 AS fwd_return FROM {joined})")
    out.append("cat AS MATERIALIZED (SELECT *, CASE WHEN fwd_return IS NOT NULL THEN CASE WHEN fwd_return > 0 THEN 1 ELSE 0 END END AS label FROM cat0)")
    return out


CAT = _ctes()


def unpivoted(extra: str, source: str = "cat", where: str = "") -> str:
    """Long rows (extra.., feature, value) of the present values."""
    return f"SELECT {extra}, feature, value FROM (SELECT {extra}, {', '.join(COLUMNS)} FROM {source}{where}) UNPIVOT (value FOR feature IN ({', '.join(COLUMNS)}))"
