"""Event streams into bars and sessions; the same functions run on batch frames."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage

C = F.col


def window_bars(events: DataFrame, key: str = "event_type", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Open/high/low/close/volume/count per key and event-time window; later rows than the watermark are dropped."""
    d = events.withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    order = F.struct("ts", "event_id")
    a = d.groupBy(w.alias("w"), key).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
                                         F.max_by("value", order).alias("close"), F.sum("value").alias("volume"), F.count(F.lit(1)).alias("n"))
    return a.select(C("w.start").alias("start"), C("w.end").alias("end"), key, "open", "high", "low", "close", "volume", "n")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions per key separated by a gap."""
    a = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return a.select(key, C("w.start").alias("start"), C("w.end").alias("end"), "n", "value")


def drop_duplicate_bars(bars: DataFrame, keys=("symbol", "ts"), late: str = "1 day") -> DataFrame:
    """First arrival of each bar within the watermark (streams); plain de-duplication on batch frames."""
    if bars.isStreaming:
        return bars.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))
    return bars.dropDuplicates(list(keys))


def enrich(bars: DataFrame, static: DataFrame, on: str = "symbol") -> DataFrame:
    """Stream-static join with the latest regime or thresholds per key."""
    return bars.join(static, on, "left")


def _newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    first = [c for c in order if c in rest]
    one = rows.groupBy(*keys).agg(F.max(F.struct(*first, *[c for c in rest if c not in first])).alias("_r"))
    return one.select(*[C("_r")[c].alias(c) if c in rest else C(c) for c in rows.columns])


def upsert_parquet(path: str, keys: list[str], order: str):
    """foreachBatch sink: the row of a key with the greatest ``order``, one folder per batch id, so a replayed batch overwrites
    itself. ``read_upserted`` merges the batches; rows without a value in ``order`` give way to all others."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _newest(batch, keys, [order]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def read_upserted(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """One row a key over all batches of ``upsert_parquet``: the greatest ``order``, of equal ones the one of the latest batch."""
    return _newest(spark.read.parquet(path), keys, [order, "batch"]).drop("batch")


def merge_sink(path: str, keys: list[str], order: str, buckets: int = 16):
    """foreachBatch sink that keeps one row a key, the one with the greatest ``order``, in a table that readers need not merge.

    The table is cut into buckets by a hash of the keys. A batch rewrites the buckets it touches, one file each, under its own version and
    then commits a pointer (bucket, version) for all buckets; readers follow the newest pointer, so they see the table before or after a
    batch, never between. A batch that is replayed starts from the pointer before it and writes the same again. Rewriting a bucket compacts
    it. Older versions stay until ``path`` is cleaned.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = cut_lineage(_newest(batch, keys, [order]).withColumn("bucket", bucket))
        touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())        # at most ``buckets`` numbers
        if not touched:
            return
        before = pointer(spark, path, batch_id)
        old = _folders(spark, path, {b: v for b, v in before.items() if b in touched})
        rows = new if old is None else new.withColumn("_n", F.lit(1)).unionByName(old.withColumn("_n", F.lit(0)))
        if old is not None:
            rows = _newest(rows, [*keys, "bucket"], [order, "_n"]).drop("_n")       # of equal ones the later batch's
        rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={batch_id}")
        after = sorted({**before, **{b: batch_id for b in touched}}.items())
        spark.createDataFrame(after, "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/pointer/at={batch_id}")
    return write


def pointer(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """bucket -> version of the newest finished batch (of those below ``before``). One row a bucket."""
    try:
        p = spark.read.schema("bucket int, version bigint, at bigint").parquet(f"{path}/pointer")
    except AnalysisException:
        return {}
    p = p if before is None else p.where(C("at") < before)
    last = p.agg(F.max("at")).first()[0]
    return {} if last is None else {r["bucket"]: r["version"] for r in p.where(C("at") == last).collect()}


def _folders(spark: SparkSession, path: str, at: dict[int, int]) -> DataFrame | None:
    if not at:
        return None
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={v}/bucket={b}" for b, v in sorted(at.items())]).drop("version")


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``merge_sink`` as of its newest pointer."""
    rows = _folders(spark, path, pointer(spark, path))
    if rows is None:
        raise ValueError(f"nothing was merged into {path}")
    return rows.drop("bucket")
