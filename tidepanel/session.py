"""Session helpers: the settings the package relies on, and lineage cuts that survive executor loss."""
from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidepanel", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the session you already have."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # window-heavy stages are CPU bound: keep small partitions apart so all cores work
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.parquet.nanosAsLong", "false")
        .config("spark.driver.memory", os.environ.get("TIDEPANEL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is set only in a local session that names none; a cluster must name one that all its nodes share.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where driver and executors are one local process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[[\d*, ]+\])?", sc.master):
        raise ValueError("name a folder that all nodes share in spark.checkpoint.dir")
    return named or tempfile.mkdtemp(prefix="tidepanel-")


_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """One folder of this application below the shared one, the same at every call."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        _ROOTS[app] = f"{shared_folder(spark)}/tidepanel-{app}"
    return _ROOTS[app]
