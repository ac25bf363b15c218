"""Reading, lineage cuts in the shared folder, and small expressions that several operators use."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: a word is a run of anything but the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local session may go without one; it gets its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not (sc.master.startswith("local") and "cluster" not in sc.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidepanel-"))
    return named or sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """Write once below the shared folder and read back: for steps too dear to run again when a task is lost or a plan uses them twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidepanel-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; Spark's cleaner removes it once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the split into learning and held-out rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))
