"""A uniform shuffle into shards of exact sizes: a hypergeometric matrix says how many rows go from each part to each shard, parts are
permuted on their own, rows are exchanged, and shards are permuted on their own. DataFrame and SQL functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import keep, table

SEED = 20_240_607
#: parts of the input; the matrix has PARTS x shards cells whatever the input
PARTS = 256
#: rows that one task puts in order, about; the result does not depend on it
SORTED = 100_000


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(seats: str, mine: str, drawn: str, u: str) -> str:
    """SQL for one exact draw: of ``seats`` seats ``mine`` are of a kind and ``drawn`` are taken; how many of the kind, by inverting the
    distribution function at ``u``. Outcomes are walked outwards from the most likely one, up to twelve standard deviations, beyond
    which the probability is below the precision of a double."""
    ratio_up = "greatest(0D, (v.k - q) * (v.d - q) / ((q + 1) * (v.n - v.k - v.d + q + 1)))"
    ratio_down = "greatest(0D, q * (v.n - v.k - v.d + q) / ((v.k - q + 1) * (v.d - q + 1)))"

    def total(ratio, first, begin, sign, at):
        step = f"named_struct('w', a.w * {ratio}, 't', a.t + a.w, 'c', a.c + if(a.w > 0 and a.t + a.w <= {at}, 1L, 0L))"
        return (f"aggregate(sequence(0L, v.span), named_struct('w', {first}, 't', 0D, 'c', 0L), "
                f"(a, i) -> transform(array(cast({begin} {sign} i as double)), q -> {step})[0])")

    first_down = "transform(array(v.m), q -> " + ratio_down + ")[0]"
    high = lambda at: total(ratio_up, "1D", "v.m", "+", at)
    low = lambda at: total(ratio_down, first_down, "v.m - 1", "-", at)
    mode = f"least({mine}, {drawn}, floor(({drawn} + 1D) * ({mine} + 1D) / ({seats} + 2D)))"
    sd = f"sqrt(greatest(0D, {drawn} * ({mine} / greatest({seats}, 1D)) * (1 - {mine} / greatest({seats}, 1D))))"
    body = _let("h", f"named_struct('up', {high('-1D')}.t, 'down', {low('-1D')}.t)",
                _let("x", f"{u} * (h.up + h.down)",
                     f"cast(if(x < h.up, v.m + {high('x')}.c, v.m - 1 - {low('x - h.up')}.c) as bigint)"))
    return _let("v", f"named_struct('n', cast({seats} as double), 'k', cast({mine} as double), 'd', cast({drawn} as double), 'm', cast({mode} as double), "
                     f"'span', cast(12 * {sd} as bigint) + 20)", body)


def matrix(parts: DataFrame, shards: int) -> DataFrame:
    """parts (part, n) -> (part, ends): the running counts of the part's rows over shards 0, 1, ... The columns' sums are the exact
    shard sizes, n // shards or one more; the draw is uniform over all deals. One row of as many counts as there are parts is folded,
    each part drawing from the seats the earlier ones left."""
    u = f"(shiftrightunsigned(xxhash64({SEED}, p.part, s), 11) * {2.0 ** -53})"
    take = hypergeometric("b.seats", "acc.left[s]", "b.rest", u)
    inner = (f"aggregate(sequence(0, {shards - 1}), named_struct('seats', aggregate(acc.left, 0L, (t, y) -> t + y), 'rest', p.n, 'got', cast(array() as array<bigint>)), "
             f"(b, s) -> transform(array({take}), g -> named_struct('seats', b.seats - acc.left[s], 'rest', b.rest - g, 'got', array_append(b.got, g)))[0])")
    outer = (f"aggregate(parts, named_struct('left', transform(sequence(0, {shards - 1}), s -> cast(total div {shards} + if(s < total % {shards}, 1, 0) as bigint)), "
             f"'out', cast(array() as array<struct<part:bigint,got:array<bigint>>>)), "
             f"(acc, p) -> transform(array({inner}), z -> named_struct('left', zip_with(acc.left, z.got, (l, g) -> l - g), "
             f"'out', array_append(acc.out, named_struct('part', p.part, 'got', z.got))))[0])")
    one = parts.agg(F.array_sort(F.collect_list(F.struct(F.col("part").cast("bigint").alias("part"), F.col("n").cast("bigint").alias("n")))).alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    ends = "transform(sequence(1, size(o.got)), j -> aggregate(slice(o.got, 1, j), 0L, (t, y) -> t + y))"
    return one.select(F.explode(F.expr(f"{outer}.out")).alias("o")).select("o.part", F.expr(ends).alias("ends"))


def _slice(key: Column, slices: int) -> Column:
    """Which of equal ranges of hash values, from 0 to 2**63, a hash lies in; order is kept."""
    return (F.shiftright(key, 39) * slices / (1 << 24)).cast("int")


def _place(rows: DataFrame, group: str, key: str, ties: list[str], slices: int) -> DataFrame:
    """Adds ``place``: position within the group by key, from 0, without a task for a whole group."""
    rows = rows.withColumn("__cut", _slice(F.col(key), slices))
    sums = rows.groupBy(group, "__cut").agg(F.count("*").alias("__n"))
    sums = sums.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__cut")) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy(group, "__cut").orderBy(key, *ties))
    return rows.join(sums, [group, "__cut"]).withColumn("place", F.col("__before") + inside - 1).drop("__cut", "__before")


def assign(rows: DataFrame, shards: int = 8, parts: int = PARTS) -> DataFrame:
    """rows with unique or repeated ``doc_id`` and a ``mark`` (hash of the row) -> the same columns, shard and slot.

    Shard sizes differ by at most one and every deal is equally likely; slots are gapless from 0 in every shard. Rows equal in doc_id
    and mark change places only with each other. Null ids count as one value. Empty tables give none.
    """
    names = rows.columns
    h = lambda n: F.shiftrightunsigned(F.xxhash64(F.lit(SEED + n), "doc_id", "mark"), 1)  # noqa: E731  not negative, so order by value is order by range
    rows = keep(rows.withColumns({"part": F.pmod(F.xxhash64("doc_id", "mark"), F.lit(parts)), "__one": h(1), "__two": h(2)}))
    counts = keep(rows.groupBy("part").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    placed = _place(rows, "part", "__one", ["doc_id", "mark"], 1 + total // (parts * SORTED))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place")))
    dealt = keep(placed.join(keep(matrix(counts, shards)), "part").withColumn("shard", shard).drop("place", "ends", "part", "__one"))
    out = _place(dealt, "shard", "__two", ["doc_id", "mark"], 1 + total // (shards * SORTED))
    return out.select(*names, "shard", F.col("place").alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``. size: UTF-8 bytes plus 1; a null text counts as empty."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("mark"))
    out = assign(rows, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs with shard and slot. Places are drawn for small rows that stand for the documents and joined back: texts move once.
    Repeated rows get places of their own."""
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    places = assign(docs.select("doc_id", mark.alias("mark")), shards).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "shard", "slot")
    once = docs.distinct().withColumn("__m", mark)
    return once.join(places, once["doc_id"].eqNullSafe(places["__id"]) & (F.col("__m") == F.col("__mark"))).drop("__id", "__mark", "__m")
