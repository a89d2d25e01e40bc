"""Joins whose broadcast is decided by a measured size, not by a guess."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes (uncompressed, as counted by `measured_bytes`) that a broadcast side may have.
BROADCAST_LIMIT = 48 << 20

#: Bytes (uncompressed) that one partition of an exchange is meant to hold.
PARTITION_BYTES = 64 << 20
#: What a byte of a compressed columnar file becomes as a row of an exchange, before the exchange compresses it.
EXPANSION = 6

_VARIABLE = (T.StringType, T.BinaryType)


def measured_bytes(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of `df`, from one aggregate job: string lengths summed, 8 bytes for anything of fixed width.

    Nested columns are measured through their JSON text. An empty table gives (0, 0).
    """
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, _VARIABLE):
            width = width + F.coalesce(F.length(c), F.lit(0)) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            width = width + F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0)) + 16
        else:
            width = width + 8
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def sized_join(big: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Join `big` with `small`, broadcasting `small` only when its measured size is at most `limit` bytes.

    Beyond the bound the join is left to a shuffle, where adaptive execution splits a hot key's
    partition on the `big` side (inner, left, semi and anti joins all allow that), so neither a
    growing small side nor a key that holds a third of `big` ends up in one task.
    """
    _, size = measured_bytes(small)
    return big.join(F.broadcast(small) if size <= limit else small, on, how)


def partitions_for(df: DataFrame, times: float = 1.0) -> int:
    """Partitions for an exchange that moves `times` the rows of `df`, at least as many as the session's tasks run at once.

    Files tell their size without a job; it is compressed, so it counts EXPANSION times. Where the
    planner knows nothing the rows are measured.
    """
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = known * EXPANSION if known < 1 << 60 else measured_bytes(df)[1]
    return max(1, df.sparkSession.sparkContext.defaultParallelism, -int(-size * times // PARTITION_BYTES))
