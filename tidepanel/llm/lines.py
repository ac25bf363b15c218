"""Line dedup by deletion neighbourhoods: lines within one edit share a hashed variant, equal variants are joined, the edit distance is
verified, and the earliest line stays."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import keep, table

#: shorter lines must be equal to count as repeated; longer ones may differ by one inserted, deleted or changed character
SHORTEST = 16
#: candidate lines whose hashes are broadcast; more are joined by shuffles
BROADCAST_ROWS = 1_000_000
#: rows without doc_id come last
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def variants(line: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys of a line and their kinds: 0 the line itself, 1 the line less one character, 2 the same with the place, for changes.

    Two lines within one edit share a key of kinds 0 and 1, or of kind 2. Prefix sums give all hashes in time linear in the line.
    """
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(c)
    power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)]) if n else np.zeros(0, np.uint64)
    upto = np.r_[np.uint64(0), np.cumsum(_mix(c + np.uint64(1)) * power)]
    less = upto[:-1] + (upto[-1] - upto[1:]) * np.uint64(_INVERSE)
    sized = lambda h, m: _mix(h ^ np.uint64(m * 0xD6E8FEB86659FD93 % (1 << 64)))
    placed = _mix(_mix(less + np.uint64(n)) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    keys = np.concatenate([sized(upto[-1:], n), sized(less, n - 1), placed]).view(np.int64)
    kinds = np.concatenate([np.zeros(1, np.int8), np.ones(n, np.int8), np.full(n, 2, np.int8)])
    first = np.unique(np.stack([keys, kinds.astype(np.int64)]), axis=1, return_index=True)[1] if n else np.zeros(1, np.int64)
    return keys[first], kinds[first]


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), line_no, line (trimmed) of every line that is not blank. Null and empty texts have none."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("line", F.trim(F.col("line"), F.lit(" \t\r\f\v"))).where("line <> ''")


def _half_keys(line: Column) -> Column:
    """Hashes of halves under which any line within one edit meets: its own halves, and those it would share with a line one longer."""
    n = F.char_length(line)
    key = lambda m, own: F.array(
        F.struct(F.xxhash64(m, F.lit("head"), F.left(line, F.floor(m / 2).cast("int"))).alias("key"), F.lit(own).alias("own")),
        F.struct(F.xxhash64(m, F.lit("tail"), F.right(line, (m - F.floor(m / 2)).cast("int"))).alias("key"), F.lit(own).alias("own")))
    return F.concat(key(n, 1), key(n + 1, 0))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs more than once. One shuffle and no join: rows made in Python are sized by what they were made from, so that
    a join might send hundreds of variants of every line through the driver."""
    return rows.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("__n > 1").drop("__n")


def decide(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, mark, line_no, dropped, near for every line that is not blank: dropped if an equal line, or one within one edit, stands
    earlier, in order of doc_id, hash of the text and place. ``near``: dropped for a line that is not equal.

    Equal lines are counted once before anything is compared, so a line that a third of the rows hold is one line. A cheap filter (one
    half of two lines within one edit is equal) leaves few lines to make variants of; it loses none. Rows repeated in doc_id and text
    count as one document. Groups of equal variants are summed to their earliest line and never gathered.
    """
    order = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("d"), "mark", "line_no")
    long = F.char_length("line") >= shortest
    lines = split_lines(docs)
    here = keep(lines.select("doc_id", "mark", "line_no", F.xxhash64("line").alias("h"), F.when(long, _half_keys(F.col("line"))).alias("halves")))
    first = keep(here.groupBy("h").agg(F.min(order).alias("first"), F.first("halves").alias("halves")))
    halves = first.where("halves is not null").select("h", F.inline("halves"))
    met = halves.groupBy("key").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("n > 1 and own = 1").select("key")
    maybe = keep(halves.join(met, "key").select("h").distinct())
    few = maybe.count() <= BROADCAST_ROWS
    text = lines.where(long).select(F.xxhash64("line").alias("h"), "line")
    text = keep(text.join(F.broadcast(maybe) if few else maybe, "h", "left_semi").dropDuplicates(["h"]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                got = [variants(x.as_py()) for x in part.column(1)]
                rows = pa.array(np.repeat(np.arange(len(got)), [len(g[0]) for g in got]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))], names=["h", "key", "kind"])

    who = F.struct("first", F.col("h").alias("h"))
    rows = text.select("h", "line").mapInArrow(spread, "h bigint, key bigint, kind byte")
    # which keys several lines share: counted first, so that only those lines carry their order on
    rows = keep(repeated(rows, "key")).join(first.select("h", "first"), "h")
    best = rows.groupBy("key").agg(F.min(F.when(F.col("kind") == 0, who)).alias("whole"), F.min(F.when(F.col("kind") == 1, who)).alias("less"), F.min(F.when(F.col("kind") == 2, who)).alias("changed"))
    other = F.when(F.col("kind") == 0, F.col("less")).when(F.col("kind") == 1, F.col("whole")).otherwise(F.col("changed"))
    pairs = rows.join(best, "key").select("h", "first", other.alias("o")).where("o.first < first").select("h", F.col("o.h").alias("h2")).distinct()
    a, b = text.select("h", F.col("line").alias("line")), text.select(F.col("h").alias("h2"), F.col("line").alias("line2"))
    near = keep(pairs.join(a, "h").join(b, "h2").where(F.levenshtein("line", "line2", 1).isin(0, 1)).select("h").distinct().withColumn("near", F.lit(True)))
    verdict = first.select("h", "first").join(near, "h", "left")
    out = here.select("doc_id", "mark", "line_no", "h", order.alias("o")).join(verdict, "h")
    near = F.coalesce("near", F.lit(False))
    return out.select("doc_id", "mark", "line_no", (near | (F.col("o") != F.col("first"))).alias("dropped"), near.alias("near"))


def cleaned(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, text, n_lines, n_dropped, n_near of every row: the text without its dropped lines; blank lines stay. Null texts stay null."""
    gone = decide(docs, shortest).groupBy("doc_id", "mark").agg(
        F.count("*").alias("n"), F.sum(F.col("dropped").cast("bigint")).alias("k"), F.sum(F.col("near").cast("bigint")).alias("near"),
        F.collect_set(F.when(F.col("dropped"), F.col("line_no"))).alias("gone"))
    gone = keep(gone.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "n", "k", "near", "gone"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark"))
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    # a column of its own, so that the text is split once and not for every line
    both = both.withColumn("__lines", F.when(F.size("gone") > 0, F.split("text", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("gone"))
    text = F.when(F.size("gone") > 0, F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")).otherwise(F.col("text"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return both.select("doc_id", text.alias("text"), zero("n").alias("n_lines"), zero("k").alias("n_dropped"), zero("near").alias("n_near"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_near, kept_sha256 (of the text that stays) over the whole table."""
    return cleaned(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "n_near", F.sha2("text", 256).alias("kept_sha256"))
