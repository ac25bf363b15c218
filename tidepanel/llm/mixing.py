"""Mixing sources to target weights: capped water-filling over sources, then whole and fractional repetitions in a seeded order."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, keep, table

SEED = "mix-1"
#: the seeded order is cut at its first three hexadecimal digits; only one such bucket a source is ever sorted
BUCKET = 3


def light_columns() -> list[Column]:
    """doc_id, source, size (words) and place: where the row stands in the seeded order, a function of doc_id and text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    place = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    return [F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), size.alias("size"), place.alias("place")]


def cycling_weights(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... along the sources in code-point order."""
    return (rank - 1) % 3 + 1


def targets(rows: DataFrame, max_epochs: int = 3, weight=cycling_weights) -> DataFrame:
    """source, source_size, target: the sizes' total shared by weight, clamped at max_epochs times the source's own size, the excess
    passed on by weight until no source is above its clamp.

    Sources sorted by clamp per weight are clamped in that order, so the water level is the highest level found when all earlier
    ones are clamped. One row a source enters the sort; rows of documents are summed before.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("w", weight(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(whole))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / rest)
    per = per.withColumn("level", F.max("level").over(whole))
    return per.select("source", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def cuts(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """source, source_size, target, whole, cut: every document is taken ``whole`` times, and once more if its place is at most cut.

    The cut is the last place whose middle word lies within the fractional part of the target, so a source misses its target by at
    most half a document. Sums per bucket of places find the bucket that holds the cut; only its rows are put in order.
    """
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = keep(goal.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    bucket = F.substring("place", 1, BUCKET)
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
    g = goal.select("source", "part")
    hold = keep(sums.join(g, same(sums, g)).where("n > 0 and before < part and part <= before + n").select(sums["source"].alias("s"), "bucket", "before", "part"))
    inside = rows.join(hold, rows["source"].eqNullSafe(hold["s"]) & (bucket == hold["bucket"])).groupBy("source", "place", "before", "part").agg(F.sum("size").alias("n"))
    middle = F.col("before") + F.sum("n").over(Window.partitionBy("source").orderBy("place")) - F.col("n") / 2
    inside = inside.withColumn("middle", middle).groupBy("source").agg(F.max(F.when(F.col("middle") <= F.col("part"), F.col("place"))).alias("cut"))
    ends = inside.select(F.col("source").alias("s2"), "cut").alias("i")
    h = hold.select(F.col("s").alias("s3"), F.col("bucket"))
    out = goal.join(h, goal["source"].eqNullSafe(h["s3"]), "left").join(ends, goal["source"].eqNullSafe(F.col("s2")), "left")
    # no place of the bucket is within the part: everything before the bucket still is; no bucket at all: nothing is taken again
    return out.select(goal["source"], "source_size", "target", "whole", F.coalesce("cut", "bucket", F.lit("")).alias("cut"))


def mix(docs: DataFrame, max_epochs: int = 3, weight=cycling_weights) -> DataFrame:
    """doc_id, source, size, place, source_size, target, copies of every row of docs.

    Null texts have size 0; rows without a source form a source of their own, last in order. Rows equal in doc_id and text are taken
    alike. Empty tables give none. Sources without a word have target 0. Other columns are ignored.
    """
    rows = keep(docs.select(*light_columns()))
    # one row a source; written, so that the planner sees its size and broadcasts it only if it is small
    cut = keep(cuts(rows, targets(rows, max_epochs, weight)).withColumnRenamed("source", "__source"))
    copies = F.col("whole") + F.when((F.col("place") <= F.col("cut")) & (F.col("size") > 0), 1).otherwise(0)
    return rows.join(cut, F.col("source").eqNullSafe(F.col("__source"))).withColumn("copies", copies.cast("bigint")).select(
        "doc_id", "source", "size", "place", "source_size", "target", "copies")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, max_epochs: int = 3, weight=cycling_weights) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, columns unchanged. Texts are not shuffled: a row's own place and its
    source's cut decide. Rows without a word are kept once, as they weigh nothing."""
    rows = keep(docs.select(*light_columns()))
    cut = keep(cuts(rows, targets(rows, max_epochs, weight)).select(F.col("source").alias("__source"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut")))
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.struct(*light_columns()).alias("__light"))
    got = one.join(cut, F.col("__light.source").eqNullSafe(F.col("__source")))
    copies = F.when(F.col("__light.size") == 0, 1).otherwise(F.col("__whole") + F.when(F.col("__light.place") <= F.col("__cut"), 1).otherwise(0))
    return got.select("__row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("__k")).select("__row.*")


ORACLE = f"""
WITH r AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         md5(concat_ws('|', '{SEED}', COALESCE(doc_id::VARCHAR, ''), md5(COALESCE(text, '')))) AS place FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap,
             (SELECT SUM(source_size)::BIGINT FROM s) AS total FROM s),
l AS (SELECT *, (total - COALESCE(SUM(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / SUM(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, LEAST(cap, w * (SELECT MAX(lev) FROM l)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
o AS (SELECT source, place, SUM(size) AS n FROM r GROUP BY source, place),
m AS (SELECT source, place, SUM(n) OVER (PARTITION BY source ORDER BY place) - n / 2.0 AS middle FROM o)
SELECT r.doc_id, r.size, p.source_size, p.target,
       (r.size * (p.whole + CASE WHEN m.middle <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
JOIN m ON m.source IS NOT DISTINCT FROM r.source AND m.place = r.place
"""
