"""Exact statistics of several hundred columns at once: a wide row stays one row, what is shuffled are counts, sums and a few order
statistics per column and task."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scale import from_brackets

C = F.col

#: rows of a batch that are held as one matrix of doubles
ROWS = 8192


def _matrix(b: pa.RecordBatch, first: int) -> np.ndarray:
    """Columns from ``first`` on as doubles, missing values as NaN."""
    return np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns[first:]])


def _by_key(batches: Iterator[pa.RecordBatch], index: dict[tuple, int], extra: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Per batch and key: number of the key, the extra columns, the matrix. The first columns are the keys, then the extra ones."""
    n = len(next(iter(index), ()))
    for whole in batches:
        for b in (whole.slice(i, ROWS) for i in range(0, len(whole), ROWS)):
            if not len(b):
                continue
            x, more = _matrix(b, n + extra), [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in b.columns[n:n + extra]]
            code = np.array([index.get(t, -1) for t in zip(*(c.to_pylist() for c in b.columns[:n]))]) if n else np.zeros(len(b), int)
            for k in np.unique(code[code >= 0]).tolist():
                at = code == k
                yield k, [m[at] for m in more], x[at]


def _named(df: DataFrame, columns: list[str], keys: list[str], rows: list[tuple]) -> DataFrame:
    """Numbers of column (c) and key (k) -> feature and the key columns."""
    d = df.withColumn("feature", F.get(F.lit(list(columns)), C("c")))
    if keys:
        at = {key: F.get(F.array(*[F.lit(r[j]) for r in rows]), C("k")) for j, key in enumerate(keys)}
        d = d.withColumns(at)
    return d.drop("k", "c")


def _keyed(df: DataFrame, columns: list[str], keys: list[str], extra: list[str] = ()) -> DataFrame:
    return df.select(*keys, *[C(e).cast("double").alias(e) for e in extra], *[C(c).cast("double").alias(c) for c in columns])


def quantiles(df: DataFrame, columns: list[str], qs: list[float], keys: list[str] = (), accuracy: int = 2000) -> DataFrame:
    """Linear-interpolated quantiles of every column: (keys.., feature, q, value), exact for any number of rows.

    One aggregate of mergeable sketches brackets the order statistics (one row per key comes back). A second pass counts what lies below
    each bracket and hands on only the values inside, equal ones once per batch: about 8 / accuracy of the values.
    """
    keys, m = list(keys), len(qs)
    d = _keyed(df, columns, keys)
    delta = 4.0 / accuracy
    at = F.lit([max(0.0, q - delta) for q in qs] + [min(1.0, q + delta) for q in qs])
    clean = {c: F.nanvl(C(c), F.lit(None).cast("double")) for c in columns}
    aggs = [e for c, x in clean.items() for e in (F.count(x).alias(f"n_{c}"), F.percentile_approx(x, at, accuracy).alias(f"q_{c}"))]
    got = (d.groupBy(*keys).agg(*aggs) if keys else d.agg(*aggs)).collect()
    names = [tuple(r[k] for k in keys) for r in got]
    index = {t: i for i, t in enumerate(names)}
    span = np.array([[r[f"q_{c}"] or [np.nan] * (2 * m) for c in columns] for r in got], float).reshape(len(got), len(columns), 2 * m)
    count = np.array([[r[f"n_{c}"] for c in columns] for r in got], np.int64).reshape(len(got), len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros((len(names), len(columns), m), np.int64)
        prev, after = np.full(below.shape, -np.inf), np.full(below.shape, np.inf)
        for k, _, x in _by_key(batches, index, 0):
            for i in range(m):
                lo, hi = span[k, :, i], span[k, :, m + i]
                less, more = x < lo, x > hi
                below[k, :, i] += less.sum(0)
                prev[k, :, i] = np.maximum(prev[k, :, i], np.where(less, x, -np.inf).max(0))
                after[k, :, i] = np.minimum(after[k, :, i], np.where(more, x, np.inf).min(0))
                r, c = np.nonzero((x >= lo) & (x <= hi))
                v = x[r, c]
                order = np.lexsort((v, c))
                c, v = c[order], v[order]
                first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (v[1:] != v[:-1])]) if len(c) else np.zeros(0, int)
                size = len(first)
                yield _cells(np.full(size, k), c[first], np.full(size, i), np.full(size, 0), v[first], np.diff(np.r_[first, len(c)]))
        k, c, i = np.indices(below.shape).reshape(3, -1)
        for kind, v, n in ((1, np.zeros(below.size), below.ravel()), (2, prev.ravel(), np.zeros(below.size, np.int64)), (3, after.ravel(), np.zeros(below.size, np.int64))):
            yield _cells(k, c, i, np.full(below.size, kind), v, n)

    cells = d.mapInArrow(run, "k int, c int, i int, kind int, v double, n bigint")
    group = ["k", "c"]
    cells = cells.groupBy(*group, "i", "kind", F.when(C("kind") == 0, C("v")).alias("v")).agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    total = F.get(F.get(F.lit(count.tolist()), C("k")), C("c")) if len(got) else F.lit(0)
    inf = F.lit(float("inf"))
    side = cells.where("kind > 0").groupBy(*group, "i").agg(F.sum(F.when(C("kind") == 1, C("n"))).alias("below"), F.max(F.when(C("kind") == 2, C("most"))).alias("prev"), F.min(F.when(C("kind") == 3, C("least"))).alias("next"))
    side = side.withColumns({"_n": total.cast("bigint"), "prev": F.nullif("prev", -inf), "next": F.nullif("next", inf)}).where("_n > 0")
    inside = cells.where("kind = 0").select(*group, "i", C("v").alias("_v"), C("n").alias("_c"))
    return _named(from_brackets(inside, side, group, qs), columns, keys, names).select(*keys, "feature", "q", "value")


def _cells(k, c, i, kind, v, n) -> pa.RecordBatch:
    cols = [pa.array(np.asarray(a), t) for a, t in ((k, pa.int32()), (c, pa.int32()), (i, pa.int32()), (kind, pa.int32()), (v, pa.float64()), (n, pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, names=["k", "c", "i", "kind", "v", "n"])


def edges_of(found: DataFrame, keys: list[str] = (), distinct: bool = False) -> dict[tuple, dict[str, np.ndarray]]:
    """Quantile rows -> ascending edges per key and feature; as many rows as features, quantiles and keys come to the driver."""
    out: dict[tuple, dict[str, list]] = {}
    for r in found.collect():
        out.setdefault(tuple(r[k] for k in keys), {}).setdefault(r["feature"], []).append(r["value"])
    return {k: {f: np.unique(v) if distinct else np.sort(v) for f, v in d.items()} for k, d in out.items()}


def contingency(df: DataFrame, columns: list[str], edges: dict, by: str, values: int, keys: list[str] = (), side: str = "left", closed: bool = False) -> DataFrame:
    """(keys.., feature, bin, by, n): how many values of every column fall into each bin for each whole number 0 .. values - 1 of ``by``.

    ``side`` as in searchsorted. ``closed``: like a histogram, values outside the outer edges are left out, the last bin holds its right
    edge, and columns with fewer than three edges give nothing. A task sends one table of counts."""
    keys, names = list(keys), list(edges)
    index = {t: i for i, t in enumerate(names)}
    cuts = [[edges[t].get(c, np.zeros(0)) for c in columns] for t in names]
    bins = max((len(e) for row in cuts for e in row), default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(columns), bins, values), np.int64)
        for k, (group,), x in _by_key(batches, index, 1):
            known = group == group
            for c, e in enumerate(cuts[k]):
                v = x[:, c]
                ok = known & (v == v)
                if closed:
                    ok &= len(e) >= 3
                    if len(e) >= 3:
                        ok &= (v >= e[0]) & (v <= e[-1])
                b = np.searchsorted(e, v[ok], side)
                if closed:
                    b = np.minimum(b, len(e) - 1)
                np.add.at(total[k, c], (b, group[ok].astype(int)), 1)
        k, c, b, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()) for a in (k, c, b, g)] + [pa.array(total[k, c, b, g])], names=["k", "c", "bin", by, "n"])

    d = _keyed(df, columns, keys, [by]).mapInArrow(run, f"k int, c int, bin int, {by} int, n bigint")
    return _named(d.groupBy("k", "c", "bin", by).agg(F.sum("n").alias("n")), columns, keys, names)


def correlations(df: DataFrame, columns: list[str], y: str, keys: list[str] = (), names: list[tuple] | None = None) -> DataFrame:
    """(keys.., feature, n, corr, slope, intercept): correlation of every column with y over the rows that have both, and the line of y on
    the column; null where one does not vary.

    A task sends centred sums per column and key; they are merged about the common mean, so no digits are lost. ``names``: the values that
    the keys can have, where they are known; else a pass over df finds them."""
    keys = list(keys)
    if names is None:
        names = [tuple(r) for r in df.select(*keys).distinct().collect()] if keys else [()]     # keys such as folds, few by nature
    index = {t: i for i, t in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (t,), x in _by_key(batches, index, 1):
            ok = (x == x) & (t == t)[:, None]
            n = ok.sum(0)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            ok, x, n = ok[:, some], x[:, some], n[some]
            row = ok.argmax(0)
            x0, y0 = x[row, np.arange(len(some))], t[row]            # relative to a value of the batch: a constant has no spread at all
            dx, dy = np.where(ok, x - x0, 0.0), np.where(ok, t[:, None] - y0, 0.0)
            mx, my = dx.sum(0) / n, dy.sum(0) / n
            dx, dy = np.where(ok, dx - mx, 0.0), np.where(ok, dy - my, 0.0)
            sums = (x0 + mx, y0 + my, (dx * dx).sum(0), (dy * dy).sum(0), (dx * dy).sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()), pa.array(n), *map(pa.array, sums)], names=["k", "c", "n", "mx", "my", "sxx", "syy", "sxy"])

    d = _keyed(df, columns, keys, [y]).mapInArrow(run, "k int, c int, n bigint, mx double, my double, sxx double, syy double, sxy double")
    w = Window.partitionBy("k", "c")
    share = C("n") / F.sum("n").over(w)
    # about the first mean, so that equal means give exactly none
    d = d.withColumns({"_x": F.min("mx").over(w), "_y": F.min("my").over(w)})
    d = d.withColumns({"_dx": C("mx") - C("_x"), "_dy": C("my") - C("_y")})
    d = d.withColumns({"_ax": F.sum(share * C("_dx")).over(w), "_ay": F.sum(share * C("_dy")).over(w)})
    d = d.withColumns({"_x": C("_x") + C("_ax"), "_y": C("_y") + C("_ay"), "_dx": C("_dx") - C("_ax"), "_dy": C("_dy") - C("_ay")})
    a = d.groupBy("k", "c").agg(F.sum("n").alias("n"), F.max("_x").alias("_x"), F.max("_y").alias("_y"), *[F.sum(C(f"s{p}{q}") + C("n") * C(f"_d{p}") * C(f"_d{q}")).alias(f"s{p}{q}") for p, q in ("xx", "yy", "xy")])
    a = a.withColumns({"corr": C("sxy") / F.nullif(F.sqrt(C("sxx") * C("syy")), F.lit(0.0)), "slope": C("sxy") / F.nullif("sxx", F.lit(0.0))})
    a = a.withColumn("intercept", C("_y") - C("slope") * C("_x"))
    return _named(a, columns, keys, names).select(*keys, "feature", "n", "corr", "slope", "intercept")
