"""Column expressions of an ordered series as a numpy program: read once, run over whole series of many keys in one Arrow pass.

The expressions of ``Series`` and plain arithmetic are covered; anything else raises where the program is made. Missing values are NaN, a truth
value is 1, 0 or NaN. Frames are summed oldest first like Spark's, so both give the same digits."""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

from .trailing import CELLS, Late, Trailing
from .windows import nested_blocks

_TOKEN = re.compile(r"\s*('[^']*'|-?\d+(?:\.\d+)?(?:E-?\d+)?|[A-Za-z_]\w*|[<>=!+\-*/%&|]+|[(),])")
#: rows of the series that are worked on together
ROWS = 4096


# --- reading -----------------------------------------------------------------------------------

def read(c: Column) -> tuple:
    """An expression as nested tuples."""
    text = c._jc.node().sql()
    toks, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:at + 40]!r}")
        toks.append(m[1])
        at = m.end()
    node, end = _expr(toks, 0)
    if end != len(toks):
        raise ValueError(f"cannot read the rest of {text!r}")
    return node


def _expr(t: list[str], i: int) -> tuple[tuple, int]:
    if t[i] == "CASE":
        i, parts = i + 1, []
        while t[i] == "WHEN":
            a, i = _expr(t, i + 1)
            b, i = _expr(t, i + 1)
            parts += [a, b]
        if t[i] == "ELSE":
            a, i = _expr(t, i + 1)
            parts.append(a)
        return ("case", *parts), i + 1
    if t[i] == "CAST":
        a, j = _expr(t, i + 2)
        return ("cast", a, ("lit", t[j + 1])), j + 3
    if i + 1 < len(t) and t[i + 1] == "(":
        name, args, i = t[i], [], i + 2
        while t[i] != ")":
            a, i = _expr(t, i)
            args.append(a)
            i += t[i] == ","
        node, i = (name.lower(), *args), i + 1
        if i < len(t) and t[i] == "OVER":
            j = t.index(")", i)
            words = t[i + 2:j]
            at = words.index("BETWEEN") if "BETWEEN" in words else None
            frame = "order" if "ORDER" in words else "whole"
            if at is not None:
                lo, hi = " ".join(words[at + 1:]).split(" AND ")
                frame = f"{lo} .. {hi}"
            return ("over", node, ("lit", frame)), j + 1
        return node, i
    if re.match(r"-?\d", t[i]):
        return ("num", float(t[i])), i + 1
    if t[i][0] == "'":
        return ("lit", t[i][1:-1]), i + 1
    if t[i] in ("NULL", "true", "false"):
        return ("num", {"NULL": np.nan, "true": 1.0, "false": 0.0}[t[i]]), i + 1
    return ("col", t[i]), i + 1


@dataclass
class Program:
    """Definitions by name: read expressions, trailing columns, exponential means (source, span, least number of values, all spans)."""
    made: dict[str, object] = field(default_factory=dict)

    def add(self, name: str, x) -> None:
        """The first definition of a name stays."""
        if name not in self.made:
            self.made[name] = read(x.column if isinstance(x, Late) else x) if isinstance(x, (Column, Late)) else x


# --- running -----------------------------------------------------------------------------------

_EPOCH = np.datetime64("1970-01-01")


def _day(x: np.ndarray) -> np.ndarray:
    return _EPOCH + np.floor(np.where(x == x, x, 0)).astype(np.int64).astype("m8[D]")


def _number(d: np.ndarray) -> np.ndarray:
    return (d.astype("M8[D]") - _EPOCH).astype(float)


def _kept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.where(x == x, y, np.nan)


def _compare(op):
    return lambda a, b: np.where((a == a) & (b == b), op(a, b), np.nan)


def _and(a, b):
    return np.where((a == 0) | (b == 0), 0.0, a * b)


def _or(a, b):
    return np.where((a == 1) | (b == 1), 1.0, a + b)


def _divide(a, b):
    return a / np.where(b == 0, np.nan, b)


def _in(x, *ys):
    return _kept(x, np.any([x == y for y in ys], axis=0))


def _coalesce(*xs):
    out = xs[0]
    for x in xs[1:]:
        out = np.where(out == out, out, x)
    return out


PLAIN = {
    "+": np.add, "-": np.subtract, "*": np.multiply, "/": _divide, "negative": np.negative, "abs": np.abs, "floor": np.floor, "sqrt": np.sqrt, "sin": np.sin, "cos": np.cos,
    "signum": np.sign, "sign": np.sign, "ln": lambda x: np.log(np.where(x > 0, x, np.nan)), "greatest": lambda *x: np.fmax.reduce(np.broadcast_arrays(*x)),
    "least": lambda *x: np.fmin.reduce(np.broadcast_arrays(*x)),
    ">": _compare(np.greater), ">=": _compare(np.greater_equal), "<": _compare(np.less), "<=": _compare(np.less_equal), "=": _compare(np.equal), "==": _compare(np.equal),
    "and": _and, "or": _or, "&&": _and, "||": _or, "!": lambda x: 1.0 - x, "not": lambda x: 1.0 - x, "in": _in, "coalesce": _coalesce, "isnotnull": lambda x: (x == x).astype(float),
    "isnull": lambda x: (x != x).astype(float), "nullif": lambda a, b: np.where(a == b, np.nan, a),
    "month": lambda x: _kept(x, _day(x).astype("M8[M]").astype(int) % 12 + 1), "day": lambda x: _kept(x, (_day(x) - _day(x).astype("M8[M]")).astype(int) + 1),
    "weekday": lambda x: _kept(x, (np.floor(x) + 3) % 7), "date_add": np.add, "date_sub": np.subtract,
    "last_day": lambda x: _kept(x, _number((_day(x).astype("M8[M]") + 1).astype("M8[D]")) - 1),
}
PLAIN["dayofmonth"] = PLAIN["day"]
_WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


class Run:
    """Values of one stretch of whole series; a part of an expression is worked out once, wherever it occurs."""

    def __init__(self, program: Program, columns: dict[str, np.ndarray], start: np.ndarray):
        self.made, self.columns, self.n = program.made, dict(columns), len(next(iter(columns.values())))
        self.start, self.stop = start, np.r_[start[1:], self.n]
        self.first = np.repeat(start, self.stop - start)
        self.place = np.arange(self.n) - self.first
        self.known: dict[tuple, np.ndarray] = {}
        self.wide: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def col(self, name: str) -> np.ndarray:
        if name not in self.columns:
            x = self.made[name]
            y = self.trailing(x) if isinstance(x, Trailing) else self.ewm(*x[1:]) if x[0] == "ewm" else self.last(self.col(x[1])) if x[0] == "ffill" else self.of(x)
            self.columns[name] = np.broadcast_to(np.asarray(y, float), (self.n,))
        return self.columns[name]

    def of(self, x: tuple):
        kind = x[0]
        if kind == "col":
            return self.col(x[1])
        if kind == "num":
            return x[1]
        if x not in self.known:
            self.known[x] = self.work(kind, x)
        return self.known[x]

    def work(self, kind: str, x: tuple):
        if kind == "case":
            out = self.of(x[-1]) if len(x) % 2 == 0 else np.nan
            for i in range((len(x) - 1) // 2 * 2 - 1, 0, -2):
                out = np.where(np.asarray(self.of(x[i])) == 1, self.of(x[i + 1]), out)
            return out
        if kind == "cast":
            y = self.of(x[1])
            return np.floor(y) if x[2][1] == "DATE" else np.trunc(y) if x[2][1] in ("INT", "BIGINT") else y
        if kind == "over":
            return self.window(x[1], x[2][1])
        if kind == "trunc":
            y = self.of(x[1])
            return _kept(y, _number(_day(y).astype("M8[M]")))
        if kind == "next_day":
            y = np.floor(self.of(x[1]))
            return y + 1 + (_WEEKDAYS.index(x[2][1][:3].lower()) - (y + 4)) % 7
        return PLAIN[kind](*(np.asarray(self.of(a), float) for a in x[1:]))

    # windows

    def shifted(self, y: np.ndarray, k: int) -> np.ndarray:
        """The value k rows before, NaN before the series (after it, for a negative k)."""
        out = np.full(self.n, np.nan)
        if k >= 0:
            out[k:] = y[:max(self.n - k, 0)]
            out[self.place < k] = np.nan
        else:
            out[:k] = y[-k:]
            out[np.repeat(self.stop, self.stop - self.start) - np.arange(self.n) <= -k] = np.nan
        return out

    def along(self, op, y: np.ndarray) -> np.ndarray:
        """A running operation within each series."""
        out = np.empty(self.n)
        for a, b in zip(self.start.tolist(), self.stop.tolist()):
            op(y[a:b], out=out[a:b])
        return out

    def counts(self, y: np.ndarray, before: int) -> np.ndarray:
        """Present values of the series up to ``before`` rows before the current one."""
        run = np.r_[0, np.cumsum(y == y)]
        return run[np.maximum(np.arange(self.n) + 1 - before, self.first)] - run[self.first]

    def last(self, y: np.ndarray) -> np.ndarray:
        at = np.maximum.accumulate(np.where(y == y, np.arange(self.n), -1))
        return np.where(at >= self.first, y[np.maximum(at, 0)], np.nan)

    def window(self, f: tuple, frame: str):
        name, args = f[0], f[1:]
        if name == "row_number":
            return self.place + 1.0
        y = np.broadcast_to(np.asarray(self.of(args[0]), float), (self.n,))
        if name in ("lag", "lead"):
            return self.shifted(y, int(args[1][1]) * (1 if name == "lag" else -1))
        if name == "count" and frame == "whole":
            run = np.r_[0, np.cumsum(y == y)]
            return np.repeat((run[self.stop] - run[self.start]).astype(float), self.stop - self.start)
        lo, hi = frame.split(" .. ")
        if lo == "UNBOUNDED PRECEDING":
            if name == "count":
                return self.counts(y, 0 if hi == "CURRENT ROW" else -int(hi)).astype(float)
            if hi == "CURRENT ROW":
                some = self.counts(y, 0) > 0
                if name == "last" and args[1][1] == 1.0:
                    return self.last(y)
                if name == "sum":
                    return np.where(some, self.along(np.cumsum, np.where(y == y, y, 0.0)), np.nan)
                if name == "max":
                    return np.where(some, self.along(np.maximum.accumulate, np.where(y == y, y, -np.inf)), np.nan)
        elif hi == "CURRENT ROW":
            return self.frame(name, y, 1 - int(lo))
        raise ValueError(f"no window {name} over {frame}")

    def frame(self, name: str, y: np.ndarray, n: int) -> np.ndarray:
        """Of the last n rows, one after the other as Spark does."""
        if name not in ("avg", "sum", "max", "min", "stddev_samp"):
            raise ValueError(f"no trailing {name}")
        k, a, m = np.zeros(self.n), np.zeros(self.n), np.zeros(self.n)
        if name in ("max", "min"):
            pick = np.fmax if name == "max" else np.fmin
            out = self.shifted(y, n - 1)
            for i in range(n - 2, -1, -1):
                out = pick(out, self.shifted(y, i))
            return out
        for i in range(n - 1, -1, -1):
            v = self.shifted(y, i)
            ok = v == v
            if name == "stddev_samp":
                k = k + ok
                d = np.where(ok, v - a, 0.0)
                step = d / np.maximum(k, 1)
                a, m = a + step, m + d * (d - step)
            else:
                a, k = a + np.where(ok, v, 0.0), k + ok
        if name == "stddev_samp":
            return np.where(k > 1, np.sqrt(m / np.maximum(k - 1, 1)), np.nan)
        return np.where(k > 0, a / np.maximum(k, 1) if name == "avg" else a, np.nan)

    def trailing(self, t: Trailing) -> np.ndarray:
        views = []
        for c in t.sources:
            if c not in self.wide or self.wide[c][2] < t.n:
                at = np.arange(self.n) + t.n * np.repeat(np.arange(1, len(self.start) + 1), self.stop - self.start)
                x = np.full(self.n + t.n * len(self.start), np.nan)
                x[at] = self.col(c)
                self.wide[c] = (x, at, t.n)
            views.append((np.lib.stride_tricks.sliding_window_view(self.wide[c][0], t.n), self.wide[c][1]))
        step = max(1, CELLS // t.n)
        return np.concatenate([t.kernel(*(v[at[i:i + step] - t.n + 1] for v, at in views)) for i in range(0, self.n, step)])

    def ewm(self, source: str, span: int, least: int, spans: tuple[int, ...]) -> np.ndarray:
        """As ``windows.ewms``: sums within blocks, and the end of the block before."""
        y = self.col(source)
        length, a = nested_blocks(list(spans))[span], 2.0 / (span + 1.0)
        n, ok = self.counts(y, 0) - 1, y == y
        place = (n % length).astype(float)
        term = np.where(n == 0, y, a * y) * np.power(1.0 - a, -place)
        block = np.where(n >= 0, n // length, -1)
        new = np.r_[True, (block[1:] != block[:-1]) | (self.place[1:] == 0)]
        cuts = np.r_[np.flatnonzero(new), self.n]
        some, out = np.where(ok, term, 0.0), np.empty(self.n)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            np.cumsum(some[i:j], out=out[i:j])
        loc = np.where(ok, out * np.power(1.0 - a, place), np.nan)
        end = self.shifted(self.last(np.where(ok & (place == length - 1), loc, np.nan)), 1)
        return np.where(ok & (n + 1 >= least), loc + np.where(end == end, end, 0.0) * np.power(1.0 - a, place + 1), np.nan)


def rounded(x: np.ndarray, digits: int, offset: float) -> np.ndarray:
    """As ``catalogue.quick_round``."""
    x, unit = x + offset * 10.0 ** -digits, 10.0 ** digits
    out = np.rint(x * unit) / unit
    for i in np.flatnonzero(~(np.abs(x) < 2.0 ** 40 / unit) & np.isfinite(x)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out + 0.0


def whole_series(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by a key as batches of whole series, and where each begins."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        if sum(map(len, held)) < ROWS:
            continue
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = _starts(t.column(key))
        if len(new) > 1:
            yield t.slice(0, new[-1]), new[:-1]
            t = t.slice(new[-1])
        held = [t]
    if held:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield t, _starts(t.column(key))


def _starts(c: pa.Array) -> np.ndarray:
    code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
