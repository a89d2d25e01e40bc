"""Schemas with metadata: identity, set algebra, metadata by column name."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.functions.types import to_name

_OWN = "quern"


def fields_of(df: DataFrame) -> list[dict]:
    """name, dtype and metadata of each column."""
    return [{"name": f.name, "dtype": to_name(f.dataType, f.metadata), "metadata": f.metadata.get(_OWN)} for f in df.schema.fields]


def schema_hash(df: DataFrame) -> str:
    """Identity of a schema: names, types and metadata, in order, each set apart so that none can run into another."""
    return hashlib.sha256(json.dumps(fields_of(df), sort_keys=True).encode()).hexdigest()[:32]


def with_column_metadata(df: DataFrame, column: str, metadata: dict) -> DataFrame:
    """`column` carrying `metadata`, which survives projection and renaming."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    return df.withMetadata(column, {**df.schema[column].metadata, _OWN: metadata})


def inherit_metadata(df: DataFrame, source: T.StructType) -> DataFrame:
    """Each column with the metadata of the column of the same name in `source`."""
    known = {f.name: f.metadata for f in source.fields if f.metadata}
    for c in df.columns:
        if c in known:
            df = df.withMetadata(c, {**known[c], **df.schema[c].metadata})
    return df


def has_field(df: DataFrame, name: str) -> bool:
    """Exact name."""
    return name in df.columns


def has_column(df: DataFrame, name: str) -> bool:
    """Name in any letter case."""
    return name.lower() in {c.lower() for c in df.columns}


def render_hint(df: DataFrame, kind: str | None, column: str = "file_path") -> DataFrame:
    """`column` marked to be shown as image, video or audio (no mark for other kinds)."""
    if kind not in ("image", "video", "audio"):
        return df
    return with_column_metadata(df, column, {"render": {"func": kind}})
