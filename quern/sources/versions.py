"""Tables by version: reads by content hash, cached diffs, frames of a commit."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.diff import TabularDiff, diff
from quern.operators.graph import data_type
from quern.sources.files import FormatError, extension, read_df


def stored_path(folder: str, digest: str, ext: str) -> str:
    """Where the content of a hash lies in a store: two characters, the rest, one file."""
    return f"{folder.rstrip('/')}/{digest[:2]}/{digest[2:]}/data.{ext}"


def read_version(spark: SparkSession, manifest: DataFrame, folder: str, commit_id: str, path: str) -> DataFrame:
    """The table that `path` was in a commit, read from the content store; an unknown version raises.

    `manifest` holds commit_id, path and hash. The lookup is a filter that reaches the scan; one row comes back.
    """
    found = manifest.where((F.col("commit_id") == commit_id) & (F.col("path") == path)).select("hash").distinct().take(2)
    if len(found) != 1 or found[0]["hash"] is None:
        raise FormatError(f"there is no single version of {path} in {commit_id}")
    return read_df(spark, stored_path(folder, found[0]["hash"], extension(path)))


def frames_of(manifest: DataFrame, commit_id: str) -> DataFrame:
    """path and hash of the tabular files of a commit, by path."""
    return manifest.where(F.col("commit_id") == commit_id).where(data_type(F.col("path")) == "tabular").select("path", "hash").distinct().orderBy("path")


def cached_diff(left: DataFrame, right: DataFrame, versions: tuple[str, str], folder: str, **options) -> tuple[DataFrame, TabularDiff | None]:
    """Contents of `diff(left, right, **options)`, from the folder if they were computed before for these versions and options.

    The name of the cached file is made of both versions and all options, so a change of either
    misses it. Gives the contents and, when they were computed now, the diff itself.
    """
    spark = left.sparkSession
    key = hashlib.sha256(json.dumps([*versions, sorted((k, list(v) if not isinstance(v, (str, bool)) else v) for k, v in options.items())]).encode()).hexdigest()[:32]
    path = f"{folder.rstrip('/')}/{key}.parquet"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.parquet(path), None
    made = diff(left, right, **options)
    made.contents.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), made
