"""Reads by version, cached diffs, media facts, content-defined chunks, streams."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from quern.functions import media
from quern.sources import files, versions
from quern.streaming import reader


def test_read_version_and_cached_diff(spark, tmp_path, rows):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, s string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], "k long, s string")
    manifest = spark.createDataFrame([("c1", "t.csv", "aa11"), ("c2", "t.csv", "bb22"), ("c2", "i.png", "cc33"), ("c3", "t.csv", None)], "commit_id string, path string, hash string")
    for digest, df in (("aa11", a), ("bb22", b)):
        path = versions.stored_path(str(tmp_path), digest, "csv")
        os.makedirs(os.path.dirname(path))
        files.write_df(df, path)
    left, right = (versions.read_version(spark, manifest, str(tmp_path), c, "t.csv") for c in ("c1", "c2"))
    assert rows(left) == rows(a) and rows(right) == rows(b)
    assert rows(versions.frames_of(manifest, "c2")) == [("t.csv", "bb22")]
    for missing in ("c3", "c9"):
        with pytest.raises(files.FormatError):
            versions.read_version(spark, manifest, str(tmp_path), missing, "t.csv")
    first, made = versions.cached_diff(left, right, ("aa11", "bb22"), str(tmp_path / "cache"), keys=["k"])
    again, cached = versions.cached_diff(left, right, ("aa11", "bb22"), str(tmp_path / "cache"), keys=["k"])
    assert made is not None and cached is None and rows(first) == rows(again) and first.count() == 2
    assert versions.cached_diff(left, right, ("aa11", "bb22"), str(tmp_path / "cache"), keys=["k", "s"])[1] is not None


def test_media_facts(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\0" * 5)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 30, 40) + b"\0" * 20)
    (tmp_path / "c.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 64000))
    (tmp_path / "d.txt").write_bytes(b"nothing")
    (tmp_path / "e.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    got = {os.path.basename(r["path"]): r for r in media.media_facts(spark, str(tmp_path)).collect()}
    assert (got["a.png"]["width"], got["a.png"]["height"]) == (640, 480) and (got["b.jpg"]["width"], got["b.jpg"]["height"]) == (40, 30)
    assert (got["c.wav"]["seconds"], got["c.wav"]["sample_rate"], got["c.wav"]["channels"]) == (2.0, 8000, 2)
    assert got["d.txt"]["width"] is None and got["e.png"]["width"] is None


def test_content_chunks_survive_an_insertion(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(40_000))
    df = spark.createDataFrame([(1, text), (2, text[:500] + "INSERTED" + text[500:]), (3, None), (4, "")], "k long, t string")
    out = media.content_chunks(df, "k", "t")
    sums = {r["k"]: r["b"] for r in out.groupBy("k").agg(F.sum("bytes").alias("b")).collect()}
    assert sums == {1: 40_000, 2: 40_008}
    a, b = ({r["digest"] for r in out.where(F.col("k") == k).collect()} for k in (1, 2))
    assert len(a & b) >= 0.8 * len(a)
    assert out.agg(F.max("bytes")).first()[0] <= 4096


def test_event_stream_equals_batch(spark, tmp_path, rows):
    ev = spark.createDataFrame([(i, f"2024-01-01 0{i % 5}:30:00", "ab"[i % 2]) for i in range(40)], "id long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = reader.windowed_counts(reader.read_event_stream(spark, str(tmp_path / "ev"), ev.schema, 1), "ts", "1 hour", "kind")
    q = stream.writeStream.format("memory").queryName("ev_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("ev_counts")) == rows(reader.windowed_counts(ev, "ts", "1 hour", "kind"))
    assert reader.sessions(ev.withColumn("u", F.lit(1)), "ts", "u", "2 hours").first()["n"] == 40
