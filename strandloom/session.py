"""Session building for local runs, and cutting of lineage that survives lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _with_checkpoint_folder(spark: SparkSession) -> SparkContext:
    """The context, its checkpoint folder set.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only in a local session, where all executors share this machine, a temporary
    folder is taken if that is unset; elsewhere it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = folder or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(folder)
    return sc


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    _with_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, suffix: str = "") -> str:
    """The name of a new folder within the checkpoint folder that all executors share."""
    return f"{_with_checkpoint_folder(spark).getCheckpointDir()}/files-{uuid.uuid4().hex}{suffix}"
