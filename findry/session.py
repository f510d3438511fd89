"""Session set-up, shared scratch space and size probes used by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: str | None = None


def get_session(app: str = "findry", cores: int | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster the launcher's own settings win: only unset keys are given
    a value, and the master is set only for local use.
    """
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only on one machine (a ``local`` master) a local folder is made where none
    is named; on a cluster its tasks would not see each other's files.
    """
    global _LOCAL_SCRATCH
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master!r}")
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="findry-")
    return _LOCAL_SCRATCH


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder."""
    return os.path.join(scratch_root(spark), f"findry-{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage in a way that outlives lost executors, and keeps column
    pruning and filter pushdown for whatever reads the result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame, key: str) -> DataFrame:
    """Even out a table scan that has fewer splits than there are cores.

    A large table has many splits and is returned as it is; one small file
    would otherwise keep all work in one task. Meant for plain scans, where
    the number of splits is known without running anything.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, key)
