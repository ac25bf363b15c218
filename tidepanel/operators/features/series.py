"""Feature families over whole series in one Arrow pass: their layers as a numpy program, with nothing but the bars shuffled."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ...functions.compiled import Program, Run, read, rounded, whole_series
from ...functions.trailing import Trailing
from ...functions.windows import Series, merge_layers
from ...sources.tables import MACRO_TICKERS
from .base import closure

DAY = 86_400_000_000


def program(ids, extra: dict[str, Column] = {}, p: Series = Series()) -> Program:
    """What ``prepare`` and ``build`` add to a panel, by name, and the extra columns."""
    fams, out = closure(ids), Program()
    if any(e.startswith("_macd") for f in fams for e in f.emas):
        out.made.update({f"_ema{s}_close": ("ewm", "close", s, s, (12, 26)) for s in (12, 26)})
        out.add("_macd", (F.col("_ema12_close") - F.col("_ema26_close")) / (F.col("close") + 1e-9))
    for f in fams:
        out.made.update({c: t for c, t in f.prior.items() if c not in out.made})
    out.made.update({f"_m_{n}": ("ffill", f"_raw_{n}") for f in fams for n in f.macro})
    emas: dict[str, dict[int, int]] = {}
    for src, span, least in (e.split(":") for f in fams for e in f.emas):
        if f"_ema{span}_{src}" not in out.made:
            emas.setdefault(src, {})[int(span)] = int(least)
    for src, least in emas.items():
        out.made.update({f"_ema{s}_{src}": ("ewm", src, s, n, tuple(least)) for s, n in least.items()})
    done: set[str] = set()
    pending = fams
    while pending:
        ready = [f for f in pending if set(f.needs) <= done]
        for layer in merge_layers([f.build(p) for f in ready]):
            for name, x in layer.items():
                out.add(name, x)
        done.update(f.id for f in ready)
        pending = [f for f in pending if f.id not in done]
    for name, x in extra.items():
        out.made[name] = read(x)
    return out


def macro_days(macro: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Days (ascending) and a row of the named series for each: one row per calendar day comes to the driver."""
    tickers = {n: t for t, n in MACRO_TICKERS.items()}
    wide = macro.where("ts is not null").groupBy("ts").agg(*[F.max(F.when(F.col("ticker") == tickers[n], F.col("close"))).cast("double").alias(n) for n in names])
    rows = wide.orderBy("ts").toArrow()
    days = rows.column(0).cast(pa.timestamp("us")).cast(pa.int64()).to_numpy() / DAY
    return days, np.column_stack([rows.column(n).to_numpy() for n in names]) if names else np.zeros((len(days), 0))


def series_features(panel: DataFrame, made: Program, columns: dict[str, int], macro: DataFrame, plain: dict[str, str], offset: float) -> DataFrame:
    """Panel (symbol, ts, OHLCV, others) -> the same with the named columns of the program: ``columns`` as doubles rounded to so many digits,
    ``plain`` as they are, with their type. A task holds whole series, which the calendar bounds; only the panel is shuffled."""
    names = sorted({x[1][5:] for x in made.made.values() if isinstance(x, tuple) and x[0] == "ffill"})
    days, values = macro_days(macro, names)
    d = panel.select("symbol", "ts", "open", "high", "low", "close", "volume", *[c for c in panel.columns if c not in ("symbol", "ts", "open", "high", "low", "close", "volume")])
    schema = T.StructType([*d.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns), *(T.StructField(c, T._parse_datatype_string(k)) for c, k in plain.items())])
    kinds = {"double": pa.float64(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, start in whole_series(batches):
            with np.errstate(all="ignore"):
                given = {c: b.column(b.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("open", "high", "low", "close", "volume")}
                ts = b.column(1).cast(pa.timestamp("us")).cast(pa.int64())
                ts = np.where(ts.is_null().to_numpy(zero_copy_only=False), np.nan, ts.fill_null(0).to_numpy(zero_copy_only=False) / DAY)
                if names:
                    at = np.minimum(np.searchsorted(days, ts), max(len(days) - 1, 0))
                    hit = days[at] == ts if len(days) else np.zeros(len(b), bool)
                    given |= {f"_raw_{n}": np.where(hit, values[at, i], np.nan) if len(days) else np.full(len(b), np.nan) for i, n in enumerate(names)}
                work = Run(made, given | {"ts": ts}, start)
                cells = [(rounded(work.col(c), k, offset), pa.float64()) for c, k in columns.items()] + [(work.col(c), kinds[k]) for c, k in plain.items()]
                out = []
                for y, kind in cells:
                    none = y != y
                    out.append(pa.array(np.where(none, 0.0, y), mask=none).cast(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=schema.names)

    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(parts, "symbol").sortWithinPartitions("symbol", "ts").mapInArrow(run, schema)
