"""An append-only log in segments with retention: a manifest names the segments that count, so readers never see half an append."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

C = F.col
MANIFEST = "segment bigint, n bigint, at bigint"


def manifest(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(segment, rows) of the newest finished manifest, newest segment first. A row a segment."""
    try:
        m = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        return []
    last = m.agg(F.max("at")).first()[0]
    return [] if last is None else [(r["segment"], r["n"]) for r in m.where(C("at") == last).orderBy(F.desc("segment")).collect()]


def append(rows: DataFrame, path: str, keep: int | None = 2000) -> int:
    """Writes ``rows`` as one more segment and then the manifest that names it; returns the segment's number.

    Segments are dropped from the manifest, whole, once the newer ones hold ``keep`` rows; their files stay until ``path`` is cleaned, so a
    reader that started before goes on. A writer that dies before the manifest leaves a segment that no one reads and the next append
    overwrites. One writer at a time. An empty append adds nothing.
    """
    spark = rows.sparkSession
    now = manifest(spark, path)
    k = now[0][0] + 1 if now else 0
    rows.write.mode("overwrite").parquet(f"{path}/data/segment={k}")
    n = spark.read.schema(rows.schema).parquet(f"{path}/data/segment={k}").count()
    if n == 0:
        return k
    stay, held = [], 0
    for segment, size in [(k, n), *now]:
        if keep is not None and held >= keep:
            break
        stay.append((segment, size))
        held += size
    spark.createDataFrame(stay, "segment bigint, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/at={k}")
    return k


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the segments that count, with ``segment``; older rows of the oldest one included."""
    now = manifest(spark, path)
    if not now:
        raise ValueError(f"no segment in {path}")
    return spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/segment={s}" for s, _ in now])


def newest(spark: SparkSession, path: str, order: str, n: int = 2000) -> DataFrame:
    """The n rows of latest append and, within one append, greatest ``order``: retention to the row. Only as many segments are read as hold
    n rows; whole ones come as they are and only the oldest of them is put in order."""
    now, held, whole = manifest(spark, path), 0, []
    for segment, size in now:
        if held + size > n:
            break
        whole.append(segment)
        held += size
    rows = read(spark, path)
    if len(whole) == len(now) or held == n:
        return rows.where(C("segment").isin(whole)).drop("segment")
    last = rows.where(C("segment") == now[len(whole)][0]).orderBy(F.desc(order)).limit(n - held)
    return rows.where(C("segment").isin(whole)).unionByName(last).drop("segment")
