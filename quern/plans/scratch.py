"""Shared scratch space: the folder the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of this cluster, as spark.checkpoint.dir names it.

    Where it is unset, a session on one machine (tests) gets a temporary folder that is removed at the
    end; on a cluster it raises, as a folder of one machine would be lost or missing on the others.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured is None:
        master = sc.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        configured = tempfile.mkdtemp(prefix="quern-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there and survives a lost executor.

    Partitioning and order stay known. The files go with their DataFrame where the cluster sets
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what lies there is removed when the driver ends (`clean`)."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(clean)
    _MADE.append((spark, path))
    return path


def clean() -> None:
    """Remove every path that `scratch_path` gave out, with files of the same name and an extension; errors are passed over."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}*")
            fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for found in fs.globStatus(p) or []:
                fs.delete(found.getPath(), True)
        except Exception:  # the session may be gone already
            continue
