"""Feature catalogue."""
from pyspark.sql import DataFrame, functions as F

from . import calendar, cross, technical  # noqa: F401  (register families)
from .base import FAMILIES, build, closure, feature_columns, max_lookback, with_prior
from ...functions.scale import core_rows, overlapping_chunks
from ...functions.windows import Series, ewms

__all__ = ["FAMILIES", "build", "closure", "feature_columns", "generate_features", "max_lookback"]


def prepare(panel: DataFrame, ids, p: Series = Series(), macro: DataFrame | None = None) -> DataFrame:
    """Attach what the families need besides OHLCV: the MACD line and macro series."""
    fams = closure(ids)
    if any(e.startswith("_macd") for f in fams for e in f.emas):
        panel = ewms(panel, "close", {12: "_ema12_close", 26: "_ema26_close"}, p, {12: 12, 26: 26})
        panel = panel.withColumn("_macd", (F.col("_ema12_close") - F.col("_ema26_close")) / (F.col("close") + 1e-9))
    panel = with_prior(panel, fams, p)
    wanted = {n for f in fams for n in f.macro}
    if wanted:
        if macro is None:
            raise ValueError(f"families need macro series: {sorted(wanted)}")
        tickers = {t: n for t, n in cross.MACRO_TICKERS.items() if n in wanted}
        panel = cross.attach_macro(panel, macro, tickers, p)
    return panel


def generate_features(panel: DataFrame, ids=None, macro: DataFrame | None = None, as_of=None,
                      chunk_rows: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Panel -> (symbol, ts, OHLCV, the panel's columns named in ``carry``, feature columns).

    ``as_of`` filters before any window. ``chunk_rows`` splits each symbol's series into overlapping
    chunks so that a symbol with a very long history runs as many tasks; it is exact for families with
    a bounded look-back.
    """
    ids = list(ids) if ids is not None else [i for i, f in FAMILIES.items() if macro is not None or not f.macro]
    if macro is None:
        ids = [i for i in ids if not any(f.macro for f in closure([i]))]
    if as_of is not None:
        panel = panel.where(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))
    keep = ["symbol", "ts", "open", "high", "low", "close", "volume", *carry]
    p = Series()
    if chunk_rows:
        whole_past = [f.id for f in closure(ids) if f.lookback == 0 and f.id not in ("FEA-33", "FEA-34", "FEA-35", "FEA-57")]
        if whole_past:
            raise ValueError(f"families that depend on the whole past cannot be chunked: {whole_past}")
        panel = overlapping_chunks(panel, ["symbol"], chunk_rows, total_lookback(ids))
        p = Series(keys=("symbol", "_chunk"))
        keep += ["_chunk", "_core"]
    df = build(prepare(panel, ids, p, macro), ids, p, [*keep, *feature_columns(ids)])
    return core_rows(df) if chunk_rows else df


def total_lookback(ids) -> int:
    """Look-back of a family plus that of the families it builds on."""
    def depth(i):
        f = FAMILIES[i]
        return f.lookback + max((depth(d) for d in f.needs), default=0)
    return max(depth(i) for i in ids)
