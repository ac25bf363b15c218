"""Pieces of the independent SQL answers (DuckDB dialect)."""
from __future__ import annotations

BARS = """bars AS (
  SELECT symbol, ts, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, seq) AS close, sum(l_quantity) AS volume
  FROM (SELECT 'S' || l_suppkey AS symbol, l_shipdate AS ts, 100.0 + l_extendedprice / l_quantity / 5000.0 AS price, l_quantity,
               row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem)
  GROUP BY symbol, ts)"""

TICKERS = ("vix", "vvix", "tnx", "irx", "fvx", "vix9d", "vix3m", "dxy", "hyg", "tlt", "gld", "qqq", "skew", "lqd",
           "eem", "ief", "xlf", "xlk", "xlv", "xle", "iwm")

MACRO = """macro AS (
  SELECT c_nationkey % 21 AS tk, o_orderdate AS ts, max(o_totalprice) / 1000.0 AS close
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

UNIVERSE = """universe AS (
  SELECT 'S' || s_suppkey AS symbol, s_name AS name, r_name AS sector, n_name AS universe
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

PAST = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
WHOLE = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
SER = "OVER (PARTITION BY symbol ORDER BY ts)"
ALL = "OVER (PARTITION BY symbol)"


def last(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, mp: int | None = None) -> str:
    mp = n if mp is None else mp
    return f"CASE WHEN count({x}) {last(n)} >= {mp} THEN {agg}({x}) {last(n)} END"


def mean(x, n, mp=None):
    return roll("avg", x, n, mp)


def std(x, n, mp=None):
    return roll("stddev_samp", x, n, mp)


def hi(x, n, mp=None):
    return roll("max", x, n, mp)


def lo(x, n, mp=None):
    return roll("min", x, n, mp)


def quant(x, n, q, mp=None):
    mp = n if mp is None else mp
    return f"CASE WHEN count({x}) {last(n)} >= {mp} THEN quantile_cont({x}, {q}) {last(n)} END"


def lag(x, n=1):
    return f"lag({x}, {n}) {SER}"


def pct(x, n=1):
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def diff(x, n=1):
    return f"({x} - {lag(x, n)})"


def flag(c):
    return f"CASE WHEN {c} THEN 1 ELSE 0 END"


def above(a, b):
    return f"({a} - {b} > 1e-9 * abs({b}))"


def ratio(a, b):
    return f"(({a}) / (({b}) + 1e-9))"


def corr(a, b, n, mp=None):
    mp = n if mp is None else mp
    c = f"corr({a}, {b}) {last(n)}"
    return f"CASE WHEN count(({a}) + ({b})) {last(n)} >= {mp} AND NOT isnan({c}) THEN {c} END"


def rank(x, n, mp):
    """Percentile rank, two layers: see chain(); the list column is named _l_<x>_<n>."""
    a = f"list({x}) {last(n)}"
    return f"list_filter({a}, lambda v: v IS NOT NULL)", mp


def rank_of(arr, x, mp):
    return (f"CASE WHEN {x} IS NOT NULL AND len({arr}) >= {mp} THEN "
            f"(len(list_filter({arr}, lambda v: v < {x})) + (len(list_filter({arr}, lambda v: v = {x})) + 1) / 2.0) "
            f"/ len({arr}) END")


def ewm(x, span, mp):
    """Exact recurrence folded over the list of all values so far."""
    a = 2.0 / (span + 1)
    vals = f"list_filter(list({x}) {PAST}, lambda e: e IS NOT NULL)"
    return (f"CASE WHEN {x} IS NOT NULL AND count({x}) {PAST} >= {mp} THEN "
            f"list_reduce({vals}, lambda y, v: y * {1 - a!r} + v * {a!r}) END")


def chain(ctes: list[str], base: str, layers: list[dict[str, str]], final: str) -> str:
    """WITH ctes, l0 AS base, l1 AS layer over l0, ... and the final SELECT body over the last layer."""
    parts = list(ctes)
    prev = base
    for i, layer in enumerate(layers):
        cols = ", ".join(f"{v} AS {k}" for k, v in layer.items())
        parts.append(f"l{i} AS (SELECT *, {cols} FROM {prev})")
        prev = f"l{i}"
    return "WITH " + ",\n".join(parts) + "\n" + final.replace("{last}", prev)


def pick(cols: list[str], ints: set[str] = frozenset(), digits: int = 6, keys: str = "symbol, ts") -> str:
    out = [c if c in ints else f"round({c} + {1.7e-3 * 10.0 ** -digits!r}, {digits}) + 0.0 AS {c}" for c in cols]
    return f"SELECT {keys}, {', '.join(out)} FROM {{last}}"


def macro_wide(names) -> list[str]:
    """Bars with exact-date macro values carried forward along each symbol: columns _m_<name>."""
    cols = ", ".join(f"max(CASE WHEN tk = {TICKERS.index(n)} THEN close END) AS r_{n}" for n in names)
    ff = ", ".join(f"last_value(r_{n} IGNORE NULLS) {PAST} AS _m_{n}" for n in names)
    return [BARS, MACRO, f"wide AS (SELECT ts, {cols} FROM macro GROUP BY ts)",
            f"mbars AS (SELECT bars.*, {ff} FROM bars LEFT JOIN wide USING (ts))"]


def rsi(n: int) -> list[dict[str, str]]:
    return [{"_d1": diff("close")},
            {"_g": "CASE WHEN _d1 IS NOT NULL THEN greatest(_d1, 0) END", "_ls": "CASE WHEN _d1 IS NOT NULL THEN -least(_d1, 0) END"},
            {"_rsi": f"100.0 - 100.0 / (1.0 + ({mean('_g', n)}) / (({mean('_ls', n)}) + 1e-9))"}]


def stack(base: str, layers: list[dict[str, str]], name: str) -> list[str]:
    """CTEs over base, the last one called name."""
    out, prev = [], base
    for i, layer in enumerate(layers):
        nxt = name if i == len(layers) - 1 else f"{name}_{i}"
        out.append(f"{nxt} AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in layer.items()) + f" FROM {prev})")
        prev = nxt
    return out


SIG = [BARS, *stack("bars", [*rsi(14)[:2], {**rsi(14)[2], "_f": mean("close", 20), "_s": mean("close", 50)},
                             {"signal": "CASE WHEN _f > _s AND _rsi > 50 THEN 1 WHEN _f < _s AND _rsi < 50 THEN -1 ELSE 0 END"}], "sig")]


def bt(base: str, side: str, keys: str = "symbol", name: str = "bt", signal: str = "signal") -> list[str]:
    """Backtest CTEs over base (signal, close) with per-side cost expression."""
    w = f"OVER (PARTITION BY {keys} ORDER BY ts)"
    return stack(base, [
        {"position": f"coalesce(lag({signal}) {w}, 0)::DOUBLE", "raw_return": f"coalesce(close / lag(close) {w} - 1, 0)"},
        {"gross_return": "position * raw_return", "turnover": f"abs(position - coalesce(lag(position) {w}, 0))"},
        {"cost_drag": f"turnover * ({side})"}, {"net_return": "gross_return - cost_drag"},
        {"equity": f"100000.0 * product(1 + net_return) OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING)"}], name)


def annual(r: str) -> str:
    return f"(pow(product(1 + {r}), 252.0 / count({r})) - 1)"


def vol(r: str) -> str:
    return f"coalesce(CASE WHEN stddev_samp({r}) > 1e-14 * abs(avg({r})) THEN stddev_samp({r}) * sqrt(252.0) END, 0)"


def sharpe(r: str) -> str:
    return f"CASE WHEN {vol(r)} = 0 THEN 0 ELSE {annual(r)} / ({vol(r)}) END"


def metrics(base: str, keys: str = "symbol", ret: str = "net_return", eq: str = "equity", name: str = "met") -> list[str]:
    """All-metric bundle per key."""
    past = f"OVER (PARTITION BY {keys} ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    dn = f"coalesce(stddev_samp(CASE WHEN {ret} < 0 THEN {ret} END) * sqrt(252.0), 0)"
    gain, loss = f"coalesce(sum(CASE WHEN {ret} > 0 THEN {ret} END), 0)", f"abs(coalesce(sum(CASE WHEN {ret} < 0 THEN {ret} END), 0))"
    return [
        f"{name}_a AS (SELECT *, max({eq}) {past} AS peak FROM {base})",
        f"{name}_b AS (SELECT *, ({eq} - peak) / peak AS drawdown, sum(CASE WHEN {eq} >= peak * (1 - 1e-12) THEN 1 ELSE 0 END) {past} AS isl FROM {name}_a)",
        f"{name}_c AS (SELECT {keys}, max(len) AS dur FROM (SELECT {keys}, isl, sum(CASE WHEN {eq} >= peak * (1 - 1e-12) THEN 0 ELSE 1 END) AS len FROM {name}_b GROUP BY {keys}, isl) GROUP BY {keys})",
        f"""{name}_d AS (SELECT {keys}, CASE WHEN count(*) < 2 THEN 0 ELSE pow(arg_max({eq}, ts) / arg_min({eq}, ts), 252.0 / count(*)) - 1 END AS cagr,
          {annual(ret)} AS annualised_return, {vol(ret)} AS annualised_volatility, {sharpe(ret)} AS sharpe_ratio,
          CASE WHEN {dn} = 0 THEN 0 ELSE {annual(ret)} / ({dn}) END AS sortino_ratio, min(drawdown) AS max_drawdown,
          avg(CASE WHEN {ret} > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
          CASE WHEN {loss} = 0 THEN 'inf'::DOUBLE ELSE {gain} / {loss} END AS profit_factor,
          count(CASE WHEN {ret} <> 0 THEN 1 END) AS total_trades FROM {name}_b GROUP BY {keys})""",
        f"""{name} AS (SELECT {name}_d.*, CAST(dur AS BIGINT) AS max_drawdown_duration_bars,
          CASE WHEN max_drawdown = 0 THEN 0 ELSE annualised_return / abs(max_drawdown) END AS calmar_ratio
          FROM {name}_d JOIN {name}_c USING ({keys}))"""]


METRICS = ("cagr annualised_return annualised_volatility sharpe_ratio sortino_ratio max_drawdown max_drawdown_duration_bars win_rate "
           "profit_factor total_trades calmar_ratio").split()


def rounds(cols: list[str], ints=("max_drawdown_duration_bars", "total_trades"), digits: int = 6) -> str:
    return ", ".join(c if c in ints else f"round({c} + {1.7e-3 * 10.0 ** -digits!r}, {digits}) + 0.0 AS {c}" for c in cols)


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


STOCK = "0.0008"


def rnd(x: str, digits: int = 6, name: str | None = None) -> str:
    """Rounded like the Spark side: shifted off exact halves, no negative zero."""
    out = f"round(({x}) + {1.7e-3 * 10.0 ** -digits!r}, {digits}) + 0.0"
    return f"{out} AS {name}" if name else out
