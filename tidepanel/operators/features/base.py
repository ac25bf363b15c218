"""Registry of feature families. A family returns layers of named columns; later layers use earlier ones."""
from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ...functions.trailing import Trailing, split, trailing
from ...functions.windows import Layers, Series, apply_layers, ewms, merge_layers


@dataclass
class Family:
    id: str
    columns: tuple[str, ...]
    build: Callable[[Series], Layers]
    lookback: int                      # bars a value can depend on; 0 = whole past
    emas: tuple[str, ...] = ()         # exponential means prepared before the layers
    macro: tuple[str, ...] = ()        # cross-asset series it reads
    needs: tuple[str, ...] = ()        # families merged in front of it
    prior: dict[str, Trailing] = field(default_factory=dict)   # trailing columns of the bars alone, made before the layers


FAMILIES: dict[str, Family] = {}


def family(id: str, columns: str, lookback: int, emas: Iterable[str] = (), macro: Iterable[str] = (),
           needs: Iterable[str] = (), prior: dict[str, Trailing] | None = None):
    def register(fn):
        FAMILIES[id] = Family(id, tuple(columns.split()), fn, lookback, tuple(emas), tuple(macro), tuple(needs), prior or {})
        return fn
    return register


def closure(ids: Iterable[str]) -> list[Family]:
    """Families in dependency order."""
    out: dict[str, Family] = {}

    def visit(i):
        if i in out:
            return
        for d in FAMILIES[i].needs:
            visit(d)
        out[i] = FAMILIES[i]
    for i in ids:
        visit(i)
    return list(out.values())


def with_prior(df: DataFrame, fams: list[Family], p: Series) -> DataFrame:
    """Adds what the families' layers read of trailing columns of the bars."""
    prior = {c: t for f in fams for c, t in f.prior.items() if c not in df.columns}
    return trailing(df, prior, p) if prior else df


def build(panel: DataFrame, ids: Iterable[str], p: Series = Series(), wanted: Iterable[str] | None = None) -> DataFrame:
    """Panel plus all columns of the families (helper columns start with an underscore), or those wanted.

    Trailing columns of all families share one pass after the windows; no family reads those of another."""
    fams = closure(ids)
    df = with_prior(panel, fams, p)
    emas: dict[str, dict[int, int]] = {}    # span and least number of values by source, but for those already there
    for src, span, mp in (e.split(":") for f in fams for e in f.emas):
        if f"_ema{span}_{src}" not in df.columns:
            emas.setdefault(src, {})[int(span)] = int(mp)
    for src, least in emas.items():
        df = ewms(df, src, {s: f"_ema{s}_{src}" for s in least}, p, least)
    # families without requirements run side by side, the others after what they need
    done: set[str] = set()
    ends: dict[str, Trailing] = {}
    late = {}
    pending = fams
    while pending:
        ready = [f for f in pending if set(f.needs) <= done]
        plain, more, after = split(merge_layers([f.build(p) for f in ready]))
        df = apply_layers(df, plain)
        ends.update(more)
        late.update(after)
        done.update(f.id for f in ready)
        pending = [f for f in pending if f.id not in done]
    if ends:
        if wanted is not None:      # helper columns do not pass through the tasks' Arrow batches
            kept = {*wanted, *(c for t in ends.values() for c in t.sources), *(c for x in late.values() for c in x.reads(df.columns))}
            df = df.select(*[c for c in df.columns if c in kept])
        df = trailing(df, ends, p).withColumns({c: x.column for c, x in late.items()})
    return df if wanted is None else df.select(*wanted)


def feature_columns(ids: Iterable[str]) -> list[str]:
    return [c for i in ids for c in FAMILIES[i].columns]


def max_lookback(ids: Iterable[str]) -> int:
    return max(f.lookback for f in closure(ids))
