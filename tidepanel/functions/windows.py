"""Window expressions over a panel. Every expression shares one (keys, order) spec, so Spark sorts once."""
from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """Comparison with a missing value is false, result is 0/1."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(x, lo=None, hi=None) -> Column:
    """Bounds that keep NULL as NULL (greatest/least alone would replace it)."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.greatest(out, col(lo) if isinstance(lo, (str, Column)) else F.lit(lo))
    if hi is not None:
        out = F.least(out, col(hi) if isinstance(hi, (str, Column)) else F.lit(hi))
    return F.when(x.isNotNull(), out)


def nz(x) -> Column:
    """Zero becomes NULL, for denominators."""
    return F.nullif(col(x), F.lit(0.0))


def corr_over(a, b, frame) -> Column:
    """Pairwise correlation that is NULL, not an error, where one side does not vary."""
    a, b = F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b))
    spread = F.sqrt(F.var_pop(a).over(frame) * F.var_pop(b).over(frame))
    return F.covar_pop(a, b).over(frame) / nz(spread)


def corr_agg(a, b) -> Column:
    """The same as a grouped aggregate."""
    a, b = F.when(col(b).isNotNull(), col(a)), F.when(col(a).isNotNull(), col(b))
    return F.covar_pop(a, b) / nz(F.sqrt(F.var_pop(a) * F.var_pop(b)))


@dataclass(frozen=True)
class Series:
    """Expressions for one ordered series per key.

    ``keys`` may hold an extra chunk or fold column; frames never cross keys.
    """

    keys: tuple[str, ...] = ("symbol",)
    order: str = "ts"

    @property
    def w(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    @property
    def past(self):
        return self.w.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def future(self):
        return self.w.rowsBetween(0, Window.unboundedFollowing)

    @property
    def whole(self):
        return Window.partitionBy(*self.keys)

    def last(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def count(self, x, n: int) -> Column:
        """Non-null values among the last n rows: two running counts, so a row costs the same whatever the frame."""
        x = col(x)
        return F.count(x).over(self.past) - F.count(x).over(self.w.rowsBetween(Window.unboundedPreceding, -n))

    def roll(self, agg, x, n: int, mp: int | None = None) -> Column:
        """Trailing aggregate that is NULL until ``mp`` non-null values are in the frame."""
        x = col(x)
        return F.when(self.count(x, n) >= (n if mp is None else mp), agg(x).over(self.last(n)))

    def mean(self, x, n, mp=None):
        return self.roll(F.avg, x, n, mp)

    def std(self, x, n, mp=None):
        return self.roll(F.stddev_samp, x, n, mp)

    def sum(self, x, n, mp=None):
        return self.roll(F.sum, x, n, mp)

    def max(self, x, n, mp=None):
        return self.roll(F.max, x, n, mp)

    def min(self, x, n, mp=None):
        return self.roll(F.min, x, n, mp)

    def corr(self, a, b, n, mp=None):
        a, b = col(a), col(b)
        f = self.last(n)
        return F.when(self.count(a + b, n) >= (n if mp is None else mp), corr_over(a, b, f))

    def skew(self, x, n, mp=None):
        """Bias-corrected sample skewness of the trailing frame."""
        x, f = col(x), self.last(n)
        k = self.count(x, n).cast("double")
        g1 = F.skewness(x).over(f)
        need = max(n if mp is None else mp, 3)
        return F.when(k >= need, g1 * F.sqrt(k * (k - 1)) / (k - 2))

    def kurt(self, x, n, mp=None):
        """Bias-corrected sample excess kurtosis of the trailing frame."""
        x, f = col(x), self.last(n)
        k = self.count(x, n).cast("double")
        g2 = F.kurtosis(x).over(f)
        need = max(n if mp is None else mp, 4)
        return F.when(k >= need, (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * g2 + 6))

    def sorted_frame(self, x, n) -> Column:
        """Sorted trailing values; keep it in its own layer so rank and quantiles share one array."""
        return F.sort_array(F.collect_list(col(x)).over(self.last(n)))

    def lag(self, x, n=1):
        return F.lag(col(x), n).over(self.w)

    def lead(self, x, n=1):
        return F.lead(col(x), n).over(self.w)

    def diff(self, x, n=1):
        return col(x) - self.lag(x, n)

    def pct(self, x, n=1):
        return col(x) / nz(self.lag(x, n)) - 1.0

    def ffill(self, x):
        return F.last(col(x), ignorenulls=True).over(self.past)

    def bfill(self, x):
        return F.first(col(x), ignorenulls=True).over(self.future)

    def row(self):
        """0-based position in the series."""
        return F.row_number().over(self.w) - 1


def pct_rank(arr, x, mp: int) -> Column:
    """Percentile rank of ``x`` in the sorted array of trailing values, ties averaged."""
    arr, x = col(arr), col(x)
    below = F.array_position(arr, x) - 1
    equal = F.size(arr) - F.size(F.array_remove(arr, x))
    return F.when(x.isNotNull() & (F.size(arr) >= mp), (below + (equal + 1) / 2.0) / F.size(arr))


def quantile_of(arr, q: float, mp: int) -> Column:
    """Linear-interpolated quantile of a sorted array of trailing values."""
    arr = col(arr)
    pos = (F.size(arr) - 1) * F.lit(q)
    k = F.floor(pos).cast("int")
    low, high = F.get(arr, k), F.get(arr, F.least(k + 1, F.size(arr) - 1))
    return F.when(F.size(arr) >= mp, low + (pos - k) * (high - low))


def above(a, b, tol: float = 1e-9) -> Column:
    """a > b by more than rounding noise, so a flat stretch is never above its own mean."""
    return col(a) - col(b) > tol * F.abs(col(b))


Layers = list[dict[str, Column]]


def apply_layers(df: DataFrame, layers: Layers) -> DataFrame:
    """One projection per layer, so all windows of a layer with the shared spec become one Window node."""
    for layer in layers:
        new = {k: v for k, v in layer.items() if k not in df.columns}
        if new:
            df = df.withColumns(new)
    return df


def merge_layers(stacks: list[Layers]) -> Layers:
    """Put several families side by side; a column defined by an earlier layer is not computed again."""
    depth = max((len(s) for s in stacks), default=0)
    seen: set[str] = set()
    out: Layers = []
    for i in range(depth):
        layer: dict[str, Column] = {}
        for s in stacks:
            if i < len(s):
                layer.update({k: v for k, v in s[i].items() if k not in seen and k not in layer})
        seen.update(layer)
        out.append(layer)
    return out


def nested_blocks(spans: list[int]) -> dict[int, int]:
    """Block length by span, longest span first: each length is the one before halved some times, so that short blocks lie in long ones.
    Within a block (1-a)**-i stays in range; the weight carried over from two blocks back is below double precision."""
    rate = {s: -math.log(1.0 - 2.0 / (s + 1.0)) for s in sorted(set(spans), reverse=True)}
    least = {s: max(2, math.ceil(42.0 / r)) for s, r in rate.items()}
    halved, at = {}, 0
    for s, n in least.items():
        while least[max(least)] >> (at + 1) >= n:
            at += 1
        halved[s] = at
    unit = math.ceil(least[max(least)] / 2 ** at)
    return {s: unit * 2 ** (at - k) for s, k in halved.items()}


def ewms(df: DataFrame, x: str, outs: dict[int, str], p: Series, min_periods: dict[int, int] = {}) -> DataFrame:
    """Exponential means of one column, output name by span (from 1 value on or as many as named), with the recurrence y = (1-a)y + a*x, y0 = first value, as running sums.

    The series is cut into blocks; a running sum per block plus the previous block's end value gives the recurrence without any per-row
    Python. Blocks are numbered in time order and nested, so one sort serves the windows of all spans.
    """
    lengths = nested_blocks(list(outs))
    block = {s: f"_{x}_b{s}" for s in lengths}
    order = [*block.values(), p.order]
    df = df.withColumn(f"_{x}_n", F.count(col(x)).over(p.past) - 1)
    df = df.withColumns({block[s]: F.floor(F.col(f"_{x}_n") / n) for s, n in lengths.items()})
    prev = Window.partitionBy(*p.keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = {s: F.when(col(x).isNotNull(), F.col(f"_{x}_n") % n).cast("double") for s, n in lengths.items()}
    sums, ends, means = {}, {}, {}
    for k, (s, n) in enumerate(lengths.items(), len(p.keys) + 1):
        a = 2.0 / (s + 1.0)
        q = F.lit(1.0 - a)
        term = F.when(F.col(f"_{x}_n") == 0, col(x)).otherwise(a * col(x)) * F.pow(q, -place[s])
        named = [*p.keys, *order]
        w = Window.partitionBy(*named[:k]).orderBy(*named[k:]).rowsBetween(Window.unboundedPreceding, 0)
        loc, end = f"_{outs[s]}_loc", f"_{outs[s]}_end"
        sums[loc] = F.sum(term).over(w) * F.pow(q, place[s])
        ends[end] = F.last(F.when(place[s] == n - 1, F.col(loc)), ignorenulls=True).over(prev)
        y = F.col(loc) + F.coalesce(F.col(end), F.lit(0.0)) * F.pow(q, place[s] + 1)
        means[outs[s]] = F.when(F.col(f"_{x}_n") + 1 >= min_periods.get(s, 1), y)
    return df.withColumns(sums).withColumns(ends).withColumns(means).drop(f"_{x}_n", *block.values(), *sums, *ends)


def ewm(df: DataFrame, x: str, span: int, out: str, p: Series, min_periods: int = 1) -> DataFrame:
    """One exponential mean (``ewms``)."""
    return ewms(df, x, {span: out}, p, {span: min_periods})


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda u, v: u & v, conds)
