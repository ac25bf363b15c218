"""Statistics of long trailing frames by numpy: one ordered pass over a panel, in place of one walk over the frame per row and value."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, types as T

from .windows import Layers, Series

#: values of one matrix of frames (rows x frame), few enough to stay in a core's cache
CELLS = 16_384


@dataclass(frozen=True)
class Trailing:
    """A column made by ``kernel`` from the last ``n`` rows of the named columns, the current one included.

    The kernel gets a matrix (rows, n) per column, missing values and places before the series as NaN, and gives one number per row, NaN
    for null. ``kind`` is double or int."""

    kernel: Callable[..., np.ndarray]
    sources: tuple[str, ...]
    n: int
    kind: str = "double"


@dataclass(frozen=True)
class Late:
    """A column of a layer that reads trailing columns: it is made after them."""

    column: Column

    def reads(self, columns: list[str]) -> set[str]:
        """Those of the columns whose names occur in the expression."""
        return set(re.findall(r"\w+", str(self.column))) & set(columns)


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """True where a row's key differs from that of the row before."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def _frames(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str], before: int) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray], np.ndarray]]:
    """Per batch: the padded values of every named column and the place of each row in them; ``before`` values (or NaN) lie ahead of each."""
    current, held = None, {}
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(b.schema.get_field_index(k)) for k in keys]
        new = _codes(cols)
        new[0] = tuple(c[0].as_py() for c in cols) != current
        current = tuple(c[len(b) - 1].as_py() for c in cols)
        runs = np.cumsum(new)
        at = np.arange(len(b)) + before * (runs + (not new[0]))
        values = {}
        for c in names:
            x = np.full(at[-1] + 1, np.nan)
            if not new[0]:
                x[:before] = held[c]
            x[at] = b.column(b.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False)
            values[c], held[c] = x, x[len(x) - before:].copy()
        yield b, values, at


def trailing(df: DataFrame, specs: dict[str, Trailing], p: Series = Series()) -> DataFrame:
    """Adds the columns. Rows of a key pass in order as Arrow batches; between batches only the last rows of one frame are kept, so the
    length of a series does not matter."""
    keys, names, before = list(p.keys), sorted({c for t in specs.values() for c in t.sources}), max(t.n for t in specs.values())
    kinds = {"double": (pa.float64(), T.DoubleType()), "int": (pa.int32(), T.IntegerType())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, values, at in _frames(batches, keys, names, before):
            made = []
            for t in specs.values():
                views = [np.lib.stride_tricks.sliding_window_view(values[c], t.n) for c in t.sources]
                step = max(1, CELLS // t.n)
                y = np.concatenate([t.kernel(*(v[at[i:i + step] - t.n + 1] for v in views)) for i in range(0, len(at), step)])
                none = y != y
                made.append(pa.array(np.where(none, 0, y), mask=none).cast(kinds[t.kind][0]))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *specs])

    d = df.drop(*specs).repartition(*keys).sortWithinPartitions(*keys, p.order)
    return d.mapInArrow(run, T.StructType([*d.schema.fields, *(T.StructField(name, kinds[t.kind][1]) for name, t in specs.items())]))


def split(layers: list[dict]) -> tuple[Layers, dict[str, Trailing], dict[str, Late]]:
    """The plain columns of layers, the trailing ones, and those that read them."""
    pick = lambda kind: {k: v for layer in layers for k, v in layer.items() if isinstance(v, kind)}
    plain = [{k: v for k, v in layer.items() if not isinstance(v, (Trailing, Late))} for layer in layers]
    return [x for x in plain if x], pick(Trailing), pick(Late)


# --- kernels -----------------------------------------------------------------------------------

def _centred(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of present values, and the values about their mean (0 where missing); equal values have no spread at all."""
    ok = x == x
    n = ok.sum(1)
    first = x[np.arange(len(x)), ok.argmax(1)]
    d = np.where(ok, x - first[:, None], 0.0)
    return n, np.where(ok, d - (d.sum(1) / np.maximum(n, 1))[:, None], 0.0)


def rank(mp: int):
    """Percentile rank of the last value among the present ones, ties averaged; null with fewer than ``mp``."""
    def run(x):
        last, n = x[:, -1], (x == x).sum(1)
        below, equal = (x < last[:, None]).sum(1), (x == last[:, None]).sum(1)
        return np.where((last == last) & (n >= mp), (below + (equal + 1) / 2.0) / np.maximum(n, 1), np.nan)
    return run


def quantile(q: float, mp: int):
    """Linear-interpolated quantile of the present values; null with fewer than ``mp``."""
    def run(x):
        n, s, rows = (x == x).sum(1), np.sort(x, axis=1), np.arange(len(x))
        pos = np.maximum(n - 1, 0) * q
        k = np.floor(pos).astype(int)
        low, high = s[rows, k], s[rows, np.minimum(k + 1, np.maximum(n - 1, 0))]
        return np.where(n >= mp, low + (pos - k) * (high - low), np.nan)
    return run


def std(mp: int = 2):
    """Sample deviation of the present values."""
    def run(x):
        n, d = _centred(x)
        return np.where(n >= max(mp, 2), np.sqrt((d * d).sum(1) / np.maximum(n - 1, 1)), np.nan)
    return run


def mean(mp: int = 1):
    """Mean of the present values; that of equal values is exact."""
    def run(x):
        ok = x == x
        n, first = ok.sum(1), x[np.arange(len(x)), ok.argmax(1)]
        return np.where(n >= max(mp, 1), first + np.where(ok, x - first[:, None], 0.0).sum(1) / np.maximum(n, 1), np.nan)
    return run


def most(mp: int, sign: int = 1):
    """Largest present value, the smallest with a sign of -1."""
    def run(x):
        ok = x == x
        return np.where(ok.sum(1) >= max(mp, 1), sign * np.where(ok, sign * x, -np.inf).max(1), np.nan)
    return run


def correlation(mp: int, skip: int = 0, first: bool = False):
    """Correlation of two columns over the rows that have both, null where one does not vary. The first ``skip`` rows of a frame are counted
    for ``mp``, not correlated; ``first``: what is counted is the first column alone."""
    def run(a, b):
        n = (a == a).sum(1) if first else ((a == a) & (b == b)).sum(1)
        ok = (a == a) & (b == b)
        da, db = _centred(np.where(ok, a, np.nan)[:, skip:])[1], _centred(np.where(ok, b, np.nan)[:, skip:])[1]
        spread = np.sqrt((da * da).sum(1) * (db * db).sum(1))
        some = (n >= mp) & (spread > 0)
        return np.where(some, (da * db).sum(1) / np.where(some, spread, 1.0), np.nan)
    return run


def skewness(mp: int):
    """Bias-corrected sample skewness."""
    def run(x):
        n, d = _centred(x)
        k, d2 = np.maximum(n, 3).astype(float), d * d
        m2, m3 = d2.sum(1), (d2 * d).sum(1)
        ok = (n >= max(mp, 3)) & (m2 > 0)
        return np.where(ok, np.sqrt(k) * m3 / np.where(ok, m2, 1.0) ** 1.5 * np.sqrt(k * (k - 1)) / (k - 2), np.nan)
    return run


def kurtosis(mp: int):
    """Bias-corrected sample excess kurtosis."""
    def run(x):
        n, d = _centred(x)
        k, d2 = np.maximum(n, 4).astype(float), d * d
        m2, m4 = d2.sum(1), (d2 * d2).sum(1)
        ok = (n >= max(mp, 4)) & (m2 > 0)
        g2 = k * m4 / np.where(ok, m2, 1.0) ** 2 - 3.0
        return np.where(ok, (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * g2 + 6), np.nan)
    return run


def share_below(times: float):
    """Share of the present values below ``times`` their sample deviation; none where no value is present."""
    def run(x):
        n = (x == x).sum(1)
        bound = times * std()(x)[:, None]
        return np.where(n > 0, (x < bound).sum(1) / np.maximum(n, 1), np.nan)
    return run


def dot(weights):
    """Sum of products with literal weights, oldest first; null over a missing value."""
    w = np.asarray(weights, float)

    def run(x):
        return x @ w
    return run


def of_returns(kernel: Callable[..., np.ndarray]):
    """The kernel over the returns between the values of a frame, one fewer than these; null after a zero."""
    def run(x):
        before = x[:, :-1]
        return kernel(x[:, 1:] / np.where(before == 0, np.nan, before) - 1.0)
    return run


def means(x: str, n: int, mp: int | None = None) -> Trailing:
    return Trailing(mean(n if mp is None else mp), (x,), n)


def deviations(x: str, n: int, mp: int | None = None) -> Trailing:
    return Trailing(std(n if mp is None else mp), (x,), n)
