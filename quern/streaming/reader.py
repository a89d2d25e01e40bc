"""Reading large tables row by row on the driver, and event-time streams over files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_rows(df: DataFrame, features: Sequence[str] | None = None) -> Iterator[dict]:
    """Rows as dicts, one partition at a time with the next one fetched ahead; only `features` are read."""
    picked = df.select(*features) if features else df
    for r in picked.toLocalIterator(prefetchPartitions=True):
        yield r.asDict(recursive=True)


def load_dataset(spark: SparkSession, source: str | Sequence[str], features: Sequence[str] | None = None) -> "StreamingDataset":
    """Files, or all tables of a folder, by path: csv, tsv, json, jsonl, parquet and arrow. A folder without tables, or paths that are none, raise."""
    from quern.sources.files import FormatError, _files_of, read_df

    if isinstance(source, str):
        found = [p for ext in (".csv", ".tsv", ".json", ".jsonl", ".ndjson", ".parquet", ".arrow") for p in _files_of(spark, source, ext)]
        paths = sorted(set(found))
    else:
        paths = list(source)
    if not paths:
        raise FormatError(f"there is no table in {source}")
    return StreamingDataset([read_df(spark, p) for p in paths], features)


class StreamingDataset:
    """Several tables of one schema as one sequence of rows, with its length and slices."""

    def __init__(self, frames: Sequence[DataFrame], features: Sequence[str] | None = None) -> None:
        if not frames:
            raise ValueError("no tables")
        first = frames[0]
        for f in frames[1:]:
            if f.dtypes != first.dtypes:
                raise ValueError("the tables differ in schema")
            first = first.union(f)
        self._df = first.select(*features) if features else first
        self._sizes: list[int] | None = None
        self._frames = list(frames)

    def sizes(self) -> list[int]:
        """Rows of each table, counted once."""
        if self._sizes is None:
            self._sizes = [f.count() for f in self._frames]
        return self._sizes

    def __len__(self) -> int:
        return sum(self.sizes())

    def __iter__(self) -> Iterator[dict]:
        return stream_rows(self._df)

    def slice(self, start: int, end: int) -> DataFrame:
        from quern.operators.pipeline import slice_rows

        return slice_rows(self._df, start, end)


def read_event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """A stream of the parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark; times without a zone read in the session zone there, as watermarks need an instant."""
    if not events.isStreaming:
        return events
    if isinstance(events.schema[time].dataType, T.TimestampNTZType):
        events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late)


def windowed_counts(events: DataFrame, time: str, width: str, group: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """window_start, `group`, n: events per window; on a stream, events later than `late` are dropped and old windows closed."""
    body = _timed(events, time, late)
    win = F.window(time, width, slide) if slide else F.window(time, width)
    return body.groupBy(win.alias("w"), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), group, "n")


def sessions(events: DataFrame, time: str, user: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """`user`, session_start, n: runs of events of a user with no longer pause than `gap`."""
    body = _timed(events, time, late)
    return body.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("session_start"), "n")


def joined_streams(left: DataFrame, right: DataFrame, key: str, time: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Rows of `left` with those of `right` of the same key whose time is not before theirs and at most `within` later; the right side's columns get `_right`.

    On streams both sides forget what is later than `late` and can no longer match.
    """
    a = _timed(left, time, late)
    b = _timed(right.select(*[F.col(f"`{c}`").alias(f"{c}_right") for c in right.columns]), f"{time}_right", late)
    near = (F.col(f"{time}_right") >= F.col(time)) & (F.col(f"{time}_right") <= F.col(time) + F.expr(f"interval {within}"))
    return a.join(b, (F.col(key) == F.col(f"{key}_right")) & near)


def first_events(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """One row per key, whichever comes first; on a stream keys are remembered for as long as `late` allows."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return _timed(events, time, late).dropDuplicatesWithinWatermark([key])


def run_to_files(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream until its input is used up and read its result, which stays in files: nothing is gathered in the driver.

    In complete mode every batch replaces the result.
    """
    spark = stream.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(folder)

    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    try:
        return spark.read.parquet(folder)
    except Exception:  # no batch ever came
        return spark.createDataFrame([], stream.schema)
