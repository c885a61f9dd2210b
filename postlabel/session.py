"""Session defaults and the shared folder for materialised tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Where a local session without that setting keeps its own.
LOCAL_CONF = "spark.postlabel.localDir"
# Tasks to deal small scans to before costly work on rows; unset on a cluster.
SPREAD_CONF = "spark.postlabel.spread"


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the session it gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postlabel")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config(SPREAD_CONF, str(cores) if str(cores).isdigit() else str(os.cpu_count()))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session without the setting gets a temporary folder of its own, which goes
    when the process ends.
    """
    named = (
        spark.conf.get(CHECKPOINT_CONF, None)
        or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
        or spark.conf.get(LOCAL_CONF, None)
    )
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="postlabel-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set(LOCAL_CONF, named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/postlabel/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """True if there is a file or folder at a path of any file system Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and is computed once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals a scan to as many tasks as the session's ``SPREAD_CONF`` says; as it is without.

    For costly work on rows of a table that has fewer splits than there are cores. Whoever
    sets up the session knows its tables and decides.
    """
    parts = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(parts), *keys) if parts else df
