"""Finished runs of stream operators: rows are delivered in arrivals, each arrival resumes the stream from its checkpoint and ends."""
from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scale import with_row

C = F.col
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY = 86_400_000_000


def arrivals(rows: DataFrame, n: int = 4, held=None, early: int = DAY) -> DataFrame:
    """Adds ``arrival``, the delivery (0 to n-1) of each row: the range of ``ts`` cut into n equal parts. Rows for which ``held`` is true come
    one delivery late if they lie at least ``early`` microseconds before the end of their part, so that a shorter watermark has passed them.
    Rows without a time come first."""
    us = F.unix_micros(C("ts").cast("timestamp"))
    d = with_row(rows.withColumn("_us", us), rows.agg(F.min(us).alias("_lo"), F.max(us).alias("_hi")))
    at = F.expr(f"coalesce(((_us - _lo) * {n}) div (_hi - _lo + 1), 0)")
    if held is not None:
        late = F.coalesce(held, F.lit(False)) & (at < n - 1) & (at == F.expr(f"((_us + {early} - _lo) * {n}) div (_hi - _lo + 1)"))
        at = F.when(late, at + 1).otherwise(at)
    return d.withColumn("arrival", at.cast("int")).drop("_us", "_lo", "_hi")


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that operators with several states need; the session's own setting comes back afterwards."""
    name, wanted = PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def deliver(rows: DataFrame, work: str, start: Callable[[DataFrame], object], n: int = 4) -> None:
    """Writes one arrival after the other below ``work`` and runs the stream that ``start`` makes of the folder to the end of what is there.

    ``start`` gets the streaming frame and returns a stream writer without checkpoint and trigger. Each run resumes state and watermark of
    the one before from the checkpoint, as after a lost driver."""
    spark = rows.sparkSession
    body = rows.drop("arrival")
    rows.write.mode("overwrite").partitionBy("arrival").parquet(f"{work}/landed")       # read once, then each arrival by its folder
    landed = spark.read.schema(rows.schema).parquet(f"{work}/landed")
    for k in range(n):
        landed.where(C("arrival") == k).select(*body.columns).write.mode("append").parquet(f"{work}/in")
        stream = spark.readStream.schema(body.schema).parquet(f"{work}/in")
        start(stream).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def streamed(rows: DataFrame, work: str, transform: Callable[[DataFrame], DataFrame], n: int = 4) -> DataFrame:
    """What ``transform`` has emitted once all arrivals of ``rows`` are through, read back from the sink's own log of finished files."""
    schema = []

    def start(stream: DataFrame):
        out = transform(stream)
        schema[:] = [out.schema]
        return out.writeStream.format("parquet").outputMode("append").option("path", f"{work}/out")

    with keyed_state(rows.sparkSession):
        deliver(rows, work, start, n)
    return rows.sparkSession.read.schema(schema[0]).parquet(f"{work}/out")
