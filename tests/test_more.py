"""Views, predicates, searches, media facts, imports, long histories and long texts."""

import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import media
from quern.operators import diff as D
from quern.operators import graph as G
from quern.operators import options as O
from quern.operators import pipeline as P
from quern.operators import vectors
from quern.operators import views as V
from quern.sources import files
from quern.streaming import reader


def test_pages_of_lists():
    assert V.paginate(list(range(7)), 2, 3) == ([3, 4, 5], 3) and V.paginate([], 1, 5) == ([], 0) and V.paginate([1], 0, 5) == ([1], 1) and V.paginate([1], 9, 5) == ([], 1)
    assert V.paginate_dirs_first(["a", "b"], ["x", "y", "z"], 1, 3) == (["a", "b"], ["x"], 2)
    with pytest.raises(ValueError):
        V.paginate([1], 1, 0)


def test_tables_as_text(spark):
    df = spark.createDataFrame([(1, "x\ny"), (2, None), (3, "z" * 50)], "k long, s string")
    assert V.schema_table(df).splitlines()[3:5] == ["| k      | i64   |", "| s      | str   |"]
    shown = V.pretty(df, rows=2)
    assert "x\\ny" in shown and "null" in shown and shown.endswith("...")
    assert V.pretty(df.limit(1).select("s")) == "x\ny" and "…" in V.pretty(df)
    assert V.pretty(df.limit(0)).count("\n") == 4


def test_view_diff_and_files(spark, tmp_path, rows):
    a, b = spark.createDataFrame([(1, "x")], "k long, s string"), spark.createDataFrame([(1, 2.0), (3, 4.0)], "k long, y double")
    parts = V.view_diff(a, b)
    assert set(parts) == {"added_rows", "removed_rows", "added_cols", "removed_cols"} and rows(parts["added_rows"]) == [(3, 4.0)]
    assert set(V.view_diff(a, a)) == {"added_rows", "removed_rows"}
    p, q = files.write_df(a, str(tmp_path / "a.csv")), files.write_df(b, str(tmp_path / "b.jsonl"))
    assert V.diff_files(spark, p, q, ["k"]).row_counts().first().asDict() == {"added": 1, "removed": 0, "modified": 0}
    (tmp_path / "a.md").write_text("one\ntwo\n")
    (tmp_path / "b.md").write_text("one\nthree\n")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe\x00\x80" * 9)
    got = V.diff_files(spark, str(tmp_path / "a.md"), str(tmp_path / "b.md")).collect()
    assert [(r["change"], r["text"]) for r in got] == [("unchanged", "one"), ("removed", "two"), ("added", "three")]
    for x, y in ((p, str(tmp_path / "a.md")), (str(tmp_path / "a.md"), str(tmp_path / "c.bin"))):
        with pytest.raises(files.FormatError):
            V.diff_files(spark, x, y)
    d = V.diff_frame(D.diff(a, b, ["k"], ["y"]), O.Options(filter="_diff_status == added", columns="k"))
    assert rows(d) == [(3,)]


@pytest.mark.parametrize("bad", ["", "x = 1", "label = 1; drop table df", "label = 1 union select 1", "label in (select 1)", "label = cat", 'label = "cat"', "other.label = 1", "reflect('a', 'b') = 1", "(label = 1", "label = 1)", "label = 1 order by label", "1 = 1) or (select 1", "label = 1 -- x", "df.missing = 1"])
def test_predicates_are_checked(spark, bad):
    df = spark.createDataFrame([(1, [1.0, 0.0])], "label long, v array<double>")
    with pytest.raises(vectors.PredicateError):
        vectors.checked(df, bad)


def test_search(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, None)], "id long, v array<double>")
    assert vectors.checked(df, "df.id between 1 and 3 and ID <> 2").count() == 2
    got = [r["id"] for r in vectors.search(df, embedding=[1.0, 0.0], column="v", page_size=2, ties=["id"]).collect()]
    assert got == [5, 4] and [r["id"] for r in vectors.search(df, where="id = 0", column="v", page=2, page_size=3).collect()] == [3, 4, 5]
    assert vectors.search(df, sql="select id from df where id > 2").count() == 4
    for bad in (dict(), dict(sql="select 1", where="id = 1"), dict(where="id = 1")):
        with pytest.raises(ValueError):
            vectors.search(df, **bad)
    with pytest.raises(vectors.PredicateError):
        vectors.search(df, where="id = 77", column="v")
    states = {r["column"]: (r["length"], r["status"]) for r in vectors.index_states(df.withColumns({"w": F.lit(None).cast("array<float>"), "r": F.when(F.col("id") > 2, F.array(F.lit(1.0))).otherwise(F.col("v"))})).collect()}
    assert states == {"v": (2, "complete"), "w": (None, "not_indexed"), "r": (None, "failed")}


def test_long_history(spark):
    n = 1500
    edges = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, n)], "child string, parent string")
    heads = spark.createDataFrame([(f"c{n - 1}",), ("c10",), ("unknown",)], "head string")
    got = {(r["head"], r["commit_id"]): r["depth"] for r in G.ancestors(edges, heads).collect()}
    want = {(f"c{n - 1}", f"c{i}"): n - 1 - i for i in range(n)} | {("c10", f"c{i}"): 10 - i for i in range(11)} | {("unknown", "unknown"): 0}
    assert got == want


def test_hops_bounded_and_unbounded_agree(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    edges = spark.createDataFrame([(f"c{i}", f"c{rnd.randrange(max(0, i - 6), i)}") for i in range(1, 60) for _ in range(2)], "child string, parent string")
    heads = spark.createDataFrame([("c59",), ("c30",)], "head string")
    whole = {tuple(r) for r in G.ancestors(edges, heads).collect()}
    monkeypatch.setattr(G, "HOP_ROWS", 1)
    monkeypatch.setattr(G, "HOPS_AN_EDGE", 3)
    assert {tuple(r) for r in G.ancestors(edges, heads).collect()} == whole


def test_history_and_listing(spark, rows):
    commits = spark.createDataFrame([("a", [], None), ("b", ["a"], None), ("c", ["b"], None), ("d", ["b"], None)], "commit_id string, parent_ids array<string>, committed_at timestamp_ntz")
    heads = spark.createDataFrame([("c",)], "head string")
    assert rows(G.history(commits, G.edges_of(commits), heads)) == [("c", "a", 0), ("c", "b", 1), ("c", "c", 2)]
    stop = spark.createDataFrame([("c", "d")], "head string, base string")
    assert rows(G.history(commits, G.edges_of(commits), heads, stop)) == [("c", "c", 0)]
    reach = G.ancestors(G.edges_of(commits), heads.union(spark.createDataFrame([("d",)], "head string")))
    assert rows(G.symmetric(reach, "c", "d")) == [("c", "base"), ("d", "head")]
    f = spark.createDataFrame([("x", "b/1", 5), ("x", "a.txt", 9), ("x", "b/c/2", None), ("x", "z", 1)], "commit_id string, path string, num_bytes long")
    page = G.paged_listing(G.listing(f), 1, 2, "bytes", reverse=True).orderBy("position").collect()
    assert [(r["path"], r["is_dir"], r["pages"]) for r in page] == [("b", True, 2), ("a.txt", False, 2)]
    assert G.listing(f, "b", 5).count() == 3 and G.listing(f.limit(0)).count() == 0


def test_media_facts_of_every_kind(spark, tmp_path):
    def box(name, body):
        return struct.pack(">I4s", 8 + len(body), name) + body

    jpeg = b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", 60_000) + b"\0" * 59_998 for _ in range(9)) + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 333, 444, 3) + b"\0" * 9
    webp = b"RIFF" + struct.pack("<I", 22) + b"WEBPVP8X" + struct.pack("<I", 10) + b"\0" * 4 + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")
    flac = b"fLaC\0\0\0\x22" + b"\0" * 10 + ((44100 << 44) | (1 << 41) | (15 << 36) | 88200).to_bytes(8, "big") + b"\0" * 16
    mp3 = b"ID3\x04\0\0\0\0\0\x0a" + b"\0" * 10 + b"\xff\xfb\x90\x00" + b"\0" * 32 + b"Xing" + struct.pack(">II", 1, 100) + b"\0" * 200
    tkhd = box(b"tkhd", b"\0" * 76 + struct.pack(">II", 1280 << 16, 720 << 16))
    mp4 = box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", b"\0" * 300_000) + box(b"moov", box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 2500) + b"\0" * 80) + box(b"trak", tkhd))
    for name, body in (("a.jpg", jpeg), ("b.webp", webp), ("c.flac", flac), ("d.mp3", mp3), ("e.mp4", mp4), ("f.txt", b"plain"), ("g.jpg", jpeg[:70_000]), ("h.bin", b"")):
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: tuple(r)[2:] for r in media.media_facts(spark, str(tmp_path)).collect()}
    assert got["a.jpg"] == (444, 333, None, None, None) and got["b.webp"] == (640, 480, None, None, None)
    assert got["c.flac"] == (None, None, 2.0, 44100, 2) and got["e.mp4"] == (1280, 720, 2.5, None, None)
    assert got["d.mp3"][3:] == (44100, 2) and abs(got["d.mp3"][2] - 100 * 1152 / 44100) < 1e-9
    assert all(got[n] == (None,) * 5 for n in ("f.txt", "g.jpg"))


def test_imports(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("a/b.csv", "k\n1\n")
        z.writestr("__MACOSX/x", "no")
        z.writestr("c.txt", "t" * 100_000)
    assert files.import_zip(spark, str(tmp_path / "ok.zip"), str(tmp_path / "out")) == ["a/b.csv", "c.txt"]
    assert (tmp_path / "out/a/b.csv").read_text() == "k\n1\n" and len((tmp_path / "out/c.txt").read_text()) == 100_000
    for name in ("../up.txt", "/abs.txt", "a/../../b", "C:\\x"):
        with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
            z.writestr("fine.txt", "x")
            z.writestr(name, "x")
        with pytest.raises(files.FormatError):
            files.import_zip(spark, str(tmp_path / "bad.zip"), str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()


def test_views_and_cloud_settings(spark):
    fields = [("b", "str"), ("a", "i64")]
    assert [tuple(r) for r in files.frame_from_view(spark, [{"a": 1, "b": "x\u2028y", "c": 3}, {"b": None}], fields).collect()] == [("x\u2028y", 1), (None, None)]
    empty = files.frame_from_view(spark, [], fields)
    assert empty.dtypes == [("b", "string"), ("a", "string")] and empty.count() == 0
    got = files.cloud_settings("data", "eu-central-1", "http://127.0.0.1:9000")
    assert got == {"fs.s3a.bucket.data.endpoint.region": "eu-central-1", "fs.s3a.bucket.data.endpoint": "http://127.0.0.1:9000", "fs.s3a.bucket.data.connection.ssl.enabled": "false", "fs.s3a.bucket.data.path.style.access": "true"}
    assert files.cloud_settings("data") == {}
    with pytest.raises(files.FormatError):
        files.cloud_settings("a/b")


def test_loader(spark, tmp_path):
    files.write_df(spark.range(3), str(tmp_path / "a.csv"))
    files.write_df(spark.range(3, 5), str(tmp_path / "b.jsonl"))
    data = reader.load_dataset(spark, str(tmp_path))
    assert len(data) == 5 and sorted(r["id"] for r in data) == [0, 1, 2, 3, 4] and data.sizes() == [3, 2]
    assert len(reader.load_dataset(spark, [str(tmp_path / "b.jsonl")])) == 2
    (tmp_path / "empty").mkdir()
    with pytest.raises(files.FormatError):
        reader.load_dataset(spark, str(tmp_path / "empty"))


def test_deep_slices_and_takes(spark, monkeypatch):
    df = spark.range(0, 500, 1, 7)
    monkeypatch.setattr(P, "MOST_OFFSET", 100)
    assert [r["id"] for r in P.slice_rows(df.orderBy("id"), 400, 404).collect()] == [400, 401, 402, 403]
    assert P.slice_rows(df, 2**62, 2**62 + 5).count() == 0


def test_ordinals_of_what_changes_between_runs(spark):
    from quern.operators.ordinal import with_ordinal

    df = spark.range(0, 3000, 1, 5)
    for out in (with_ordinal(df.where(F.rand() < 0.5)), with_ordinal(df.selectExpr("id as SortKey")), with_ordinal(df.repartition(3))):
        got = sorted(r["_row_num"] for r in out.collect())
        assert got == list(range(len(got)))


def test_long_texts_are_compared_in_time(spark):
    import random
    import time

    rnd = random.Random(1)
    a = [f"line {i} {rnd.random()}" for i in range(30_000)]
    b = [x for i, x in enumerate(a) if i % 50] + ["end"]
    began = time.process_time()
    got = D.diff_lines("\n".join(a), "\n".join(b))
    assert time.process_time() - began < 5
    assert sum(c == "removed" for _, c, _ in got) == 600 and sum(c == "added" for _, c, _ in got) == 1
    steps = D._line_opcodes(a, b)
    assert [x for tag, i1, i2, j1, j2 in steps for x in (a[i1:i2] if tag in ("equal", "delete", "replace") else [])] == a
    assert [x for tag, i1, i2, j1, j2 in steps for x in (b[j1:j2] if tag in ("equal", "insert", "replace") else [])] == b


def test_scratch_wants_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from quern.plans.scratch import shared_dir

    unset = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(unset)


def test_joined_and_first_events(spark, rows):
    e = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-01 03:00:00'), (2, timestamp'2024-01-01 00:10:00') t(u, ts)")
    assert reader.joined_streams(e, e, "u", "ts", "1 hour").count() == 3 and reader.first_events(e, "u", "ts").count() == 2
