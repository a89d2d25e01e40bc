"""The engine's own operators on small tables: goldens, parsers and edge cases."""

import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import types as K
from quern.functions.filters import FilterError, apply_filter, parse_filter
from quern.operators import diff as D
from quern.operators import graph as G
from quern.operators import options as O
from quern.operators import pipeline as P
from quern.operators import schema as S
from quern.operators import sql as Q
from quern.operators import staged, vectors
from quern.operators import workspace as WS
from quern.operators.ordinal import with_ordinal
from quern.plans.sizing import measured_bytes, sized_join
from quern.sources import files
from quern.streaming import reader


@pytest.fixture(scope="module")
def images(spark):
    return spark.createDataFrame([("a.jpg", "dog", 0.0, True), ("b.jpg", "dog", 1.5, False), ("c.jpg", "unknown", 2.0, True), ("d.jpg", "dog", None, None)], "image string, label string, min_x double, ok boolean")


# --- types and filters


@pytest.mark.parametrize("name", ["bool", "i8", "i16", "i32", "i64", "f32", "f64", "str", "binary", "date", "datetime", "list[i64]", "list[list[str]]"])
def test_type_names_round_trip(name):
    assert K.to_name(K.from_name(name)) == name


def test_type_spellings():
    assert K.from_name("int64") == T.LongType() and K.from_name("u8") == T.ShortType() and K.from_name("u64") == T.DecimalType(20, 0)
    assert K.to_name(T.ArrayType(T.FloatType()), {"vector_length": 3}) == "embedding[3]"
    with pytest.raises(K.TypeNameError):
        K.from_name("wat")


def test_filter_reads_left_to_right(spark, rows):
    df = spark.createDataFrame([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], "a long, b long, c long")
    assert rows(apply_filter(df, "a == 1 || b == 1 && c == 1")) == rows(df.where("(a = 1 or b = 1) and c = 1"))
    assert rows(apply_filter(df, "a == 1 && b == 1 || c == 1")) == rows(df.where("(a = 1 and b = 1) or c = 1"))


@pytest.mark.parametrize("text", ["", "  ", "a", "a == 1 && b", "== 1", "a = 1"])
def test_filter_errors(text):
    with pytest.raises(FilterError):
        parse_filter(text)


def test_filter_types(images, rows):
    assert rows(apply_filter(images, "label == dog && min_x >= 1")) == [("b.jpg", "dog", 1.5, False)]
    assert apply_filter(images, "ok == true").count() == 2
    assert apply_filter(images, "min_x != 0").count() == 2  # null is not unequal
    with pytest.raises(FilterError):
        apply_filter(images, "nope == 1")
    with pytest.raises(ValueError):
        apply_filter(images, "min_x > abc")


def test_filter_on_dotted_and_spaced_names(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "`a.b` long, `c d` long")
    assert apply_filter(df, "a.b > 1 && c d == 4").count() == 1


# --- options


def test_option_parsers():
    assert O.parse_slice("0..10") == (0, 10) and O.page_slice(0, 10) == (0, 10) and O.page_slice(3, 10) == (20, 30)
    assert O.page_slice(2**62, 2**62) == (2**63 - 1, 2**63 - 1)
    assert O.parse_take("3,1,1") == [3, 1, 1] and O.parse_item("a:b:2") == ("a:b", 2)
    assert O.parse_rename("a:b") == ("a", "b") and O.parse_add_col("a:x:str") == ("a", "x", "str")
    for bad, f in (("5..5", O.parse_slice), ("-1..2", O.parse_slice), ("a", O.parse_slice), ("1,x", O.parse_take), ("4294967296", O.parse_take), ("a", O.parse_item), ("a:", O.parse_rename), ("a:b", O.parse_add_col)):
        with pytest.raises(O.OptionError):
            f(bad)
    o = O.Options(filter="a > 1", head=0, vstack=["x", "y"])
    assert o.applied() == [("vstack", ["x", "y"]), ("filter", "a > 1"), ("head", 0)] and o.query_string() == "vstack=x%2Cy&filter=a%20%3E%201&head=0"


# --- pipeline


def test_pipeline_goldens(images, rows):
    run = lambda **o: rows(P.run_pipeline(images, O.Options(**o)))
    assert run(unique_count="label") == [("dog", 3), ("unknown", 1)]
    assert run(unique="label", columns="image") == [("a.jpg",), ("c.jpg",)]
    assert run(columns="label,image", slice="1..2") == [("dog", "b.jpg")]
    with pytest.raises(ValueError):
        run(rename="label:kind", columns="kind")  # columns come before rename
    assert run(rename="label:kind", columns="label", head=1) == [("dog",)]
    assert P.run_pipeline(images, O.Options(rename="label:kind")).columns == ["image", "kind", "min_x", "ok"]
    assert run(add_col="n:5:i64", columns="n", head=1) == [(5,)]
    assert run(add_row="e.jpg,cat,3.5,true", filter="label == cat") == [("e.jpg", "cat", 3.5, True)]
    assert run(add_row='{"image": "z"}', filter="image == z") == [("z", None, None, None)]
    assert run(item="label:2") == [("unknown",)] and run(tail=1, columns="image") == [("d.jpg",)]
    assert [r[0] for r in P.run_pipeline(images, O.Options(sort="min_x", reverse=True)).collect()] == ["c.jpg", "b.jpg", "a.jpg", "d.jpg"]
    assert [r[0] for r in P.run_pipeline(images, O.Options(sort="min_x")).collect()][0] == "d.jpg"  # nulls first
    assert [r[0] for r in P.run_pipeline(images, O.Options(reverse=True)).collect()] == ["d.jpg", "c.jpg", "b.jpg", "a.jpg"]
    assert [r[0] for r in P.run_pipeline(images, O.Options(take="2,0,0")).collect()] == ["c.jpg", "a.jpg", "a.jpg"]
    assert run(sql="select label, count(*) as n from df group by label", sort="label") == [("dog", 3), ("unknown", 1)]
    assert run(randomize=True) == rows(images) and run(row=1, columns="image") == [("b.jpg",)]


def test_pipeline_errors(images):
    for o in ({"columns": "nope"}, {"rename": "nope:x"}, {"rename": "image:label"}, {"add_col": "image:x:str"}, {"take": "9"}, {"add_row": "1,2"}, {"add_row": '{"nope": 1}'}, {"vstack": ["x"]}, {"add_col": "n:x:i64"}):
        with pytest.raises(ValueError):
            P.run_pipeline(images, O.Options(**o)).count()
    with pytest.raises(O.OptionError):
        P.vstack(images, [images.drop("ok")])


def test_duplicates_and_hash(spark, rows):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, ""), ("", None), ("ab", "c")], "x string, y string")
    assert P.row_hash(df).select("_row_hash").distinct().count() == 4
    assert P.duplicated_rows(df, ["x", "y"]).first()[0] == 2 and P.duplicated_rows(df.limit(0), ["x"]).first()[0] == 0
    assert P.row_hash(df, []).first()["_row_hash"] is None


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 3)), max_size=30), st.integers(1, 5))
def test_ordinal_is_gapless(spark, data, parts):
    df = spark.createDataFrame(data, "a long, b long").repartition(parts)
    assert sorted(r["_row_num"] for r in with_ordinal(df).collect()) == list(range(len(data)))
    got = with_ordinal(df, "n", start=5, order=["b", "a"]).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(5, 5 + len(data)))
    assert [r["b"] for r in got] == sorted(b for _, b in data)


# --- sql


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.range(100).withColumnRenamed("id", "n")


@pytest.mark.parametrize(
    "text",
    ["drop table x", "create view v as select 1", "set a=b", "select * from csv.`/etc/passwd`", "select * from other", "insert into df values (1)", "select * from df where n in (select * from text.`/etc/hosts`)",
     "show tables", "with a as (select * from json.`/x`) select * from a", "select", "describe df", "use default", "cache table df", "refresh table df", "select reflect('java.lang.System', 'getProperty', 'user.dir') from df", "select java_method('java.lang.System', 'exit', 1)",
     "select n from df where n = (select try_reflect('a', 'b'))", "select n from df order by java_method('a', 'b')", "with a as (select reflect('a', 'b') as x) select * from a", "select transform(array(n), x -> reflect('a', 'b')) from df",
     "select transform(n) using 'cat' as (b) from df", "select current_user()", "select user from df", "select input_file_name() from df", "select version()", "select spark_partition_id() from df", "select raise_error('x')",
     "select * from sql_keywords()", "select system.builtin.reflect('a', 'b')", "select * from df; drop table df", "", ";", "select * from identifier('csv.`/x`')", "select * from df asof join df b", "select list_nothing(array(n)) from df"],
)
def test_sql_guard(numbers, text):
    with pytest.raises(Q.QueryError):
        Q.query(numbers, text)


def test_sql_hints(numbers):
    with pytest.raises(Q.QueryError, match="array functions"):
        Q.query(numbers, "select list_nothing(array(n)) from df")
    with pytest.raises(Q.QueryError, match="not allowed"):
        Q.query(numbers, "select java_method('java.lang.System', 'exit', 1)")


def test_sql_registered_functions_stay_out(spark, numbers):
    spark.udf.register("own_function", lambda x: x)
    with pytest.raises(Q.QueryError):
        Q.query(numbers, "select own_function(n) from df")


@pytest.mark.parametrize("text,want", [
    ("select * exclude (s) from df order by n", [(1, [3, 4], '{"k": {"z": 7}}'), (2, None, "x"), (2, [5], "{}")]),
    ("select * exclude s from df where n = 1", [(1, [3, 4], '{"k": {"z": 7}}')]),
    ("select n, s from df qualify row_number() over (partition by n order by s desc) = 1 order by n limit 5", [(1, "a"), (2, "c")]),
    ("select n, count(*) as c from df group by n qualify max(count(*)) over () = count(*)", [(2, 2)]),
    ("select distinct on (n) n, s from df order by n, s desc", [(1, "a"), (2, "c")]),
    ("select n, unnest(l) as x from df order by x", [(1, 3), (1, 4), (2, 5)]),
    ("select n, u.x from df, unnest(l) u(x) where x > 3 order by x", [(1, 4), (2, 5)]),
    ("select j->>'$.k.z' as z from df where n = 1", [("7",)]),
    ("select df.j->>'k' as z from df where n = 1", [('{"z":7}',)]),
    ("select list_transform(l, x -> x * 2) as t from df where n = 1", [([6, 8],)]),
    ('select s as "a ""b" from df where s = \'it\'\'s; -- qualify\'', []),
    ("select s from (select distinct on (n) n, s from df order by n, s) t union all select s from df qualify rank() over (order by n) = 1", [("a",), ("a",), ("b",)]),
    ("select n -- a comment; with exclude (x)\n from df where n = 1;", [(1,)]),
])
def test_sql_dialect(spark, text, want):
    df = spark.createDataFrame([(1, "a", [3, 4], '{"k": {"z": 7}}'), (2, "b", None, "x"), (2, "c", [5], "{}")], "n long, s string, l array<long>, j string")
    got = [tuple(r) for r in Q.query(df, text).collect()]
    assert got == want if "order by" in text.rsplit(")", 1)[-1] else sorted(got, key=repr) == sorted(want, key=repr)


def test_sql_pages(numbers, spark):
    inner = Q.query(numbers, "select n from df order by n desc limit 10 -- last\n;")
    assert [r[0] for r in Q.page(inner, 2, 4, ["n"]).collect()] == [95, 94, 93, 92]
    assert [r[0] for r in Q.page(Q.query(numbers, "select n from df where n % 2 = 0"), 2, 3, ["n"]).collect()] == [6, 8, 10]
    assert Q.total(inner).first()[0] == 10
    assert Q.query(numbers, "with a as (select n from df where n < :k) select count(*) as c from a", args={"k": 5}).first()[0] == 5
    assert Q.query(numbers, "select '{x}' as s from df limit 1").first()[0] == "{x}"
    assert not [t for t in spark.catalog.listTables() if t.name == "df"]
    with pytest.raises(Q.QueryError):
        Q.export_guard(numbers, 99)
    assert Q.export_guard(numbers, 100).count() == 100


def test_where_binds_values(spark):
    df = spark.createDataFrame([("o'x", 1), (None, 2)], "s string, n long")
    assert Q.where(df, {"s": "o'x"}).count() == 1 and Q.where(df, {"s": None}).count() == 1 and Q.where(df, {"s": "' or 1=1 --"}).count() == 0
    assert Q.where(df, {"s": "o'x", "n": 2}, "or").count() == 2 and Q.where(df, {}).count() == 2


# --- diff


def _t(spark, data, cols):
    return spark.createDataFrame(data, ", ".join(f"{c} long" for c in cols))


def _counts(d):
    r = d.row_counts().first()
    return r["added"], r["removed"], r["modified"]


def test_diff_goldens(spark):
    abc = list("abc")
    d = D.diff(_t(spark, [(1, 2, 3), (4, 5, 6)], abc), _t(spark, [(1, 2, 3), (4, 5, 2)], abc))
    assert _counts(d) == (1, 1, 0) and len(d.contents.columns) == 4
    left, right = _t(spark, [(1, 2, 1), (3, 4, 1), (5, 6, 1), (7, 8, 1)], abc), _t(spark, [(1, 2, 1), (3, 4, 1234), (9, 10, 1)], abc)
    d = D.diff(left, right, ["a", "b"], ["c"])
    assert _counts(d) == (1, 2, 1) and len(d.contents.columns) == 5
    assert _counts(D.diff(left, right, ["a", "b", "c"])) == (2, 3, 0)
    same = _t(spark, [(1, 2, 3, 4)], list("abcd"))
    d = D.diff(same, same, ["a", "b"], ["c", "d"])
    assert _counts(d) == (0, 0, 0) and len(d.contents.columns) == 7
    d = D.diff(_t(spark, [(1, 1), (2, 2), (3, 3)], "ab"), _t(spark, [(1, 1, 5), (2, 2, 5), (4, 4, 5)], "abe"))
    assert _counts(d) == (1, 1, 2)
    assert d.column_changes() == [{"name": "e", "dtype": "i64", "status": "added"}]


def test_diff_null_keys_dupes_and_errors(spark):
    a, b = _t(spark, [(None, 1), (None, 1), (2, 2)], "kv"), _t(spark, [(None, 9), (3, 3)], "kv")
    d = D.diff(a, b, ["k"], ["v"])
    assert _counts(d) == (1, 1, 2)
    r = d.duplicates().first()
    assert (r["left"], r["right"]) == (2, 0)
    for args in ((["x"],), ([], ["v"]), (["k"], ["zz"])):
        with pytest.raises(D.DiffError):
            D.diff(a, b, *args)
    assert _counts(D.diff(a.limit(0), b.limit(0), ["k"])) == (0, 0, 0)
    clash = spark.createDataFrame([(1, "x")], "k long, _diff_statusx string")
    assert D.diff(clash, clash.withColumnRenamed("_diff_statusx", "left"), ["k"]).contents.count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 8), st.integers(0, 2)), st.dictionaries(st.integers(0, 8), st.integers(0, 2)))
def test_applying_the_diff_gives_the_right_table(spark, a, b):
    d = D.diff(_t(spark, list(a.items()), "kv"), _t(spark, list(b.items()), "kv"), ["k"], ["v"])
    out = dict(a)
    for r in d.contents.collect():
        if r["_diff_status"] == "removed":
            del out[r["k"]]
        else:
            out[r["k"]] = r["v.right"]
    assert out == b


def test_row_sets_and_fields(spark, rows):
    a, b = _t(spark, [(1, 1), (1, 1), (None, 2)], "xy"), _t(spark, [(None, 2), (3, 3), (3, 3)], "xy")
    assert rows(D.rows_added(a, b)) == [(3, 3)] and rows(D.rows_removed(a, b)) == [(1, 1)]
    assert D.columns_added(a, b.withColumn("z", F.lit(1))).columns == ["z"]
    assert [c["status"] for c in D.field_changes(a, b.withColumn("x", F.col("x").cast("string")))] == ["modified"]
    assert tuple(D.size_diff(a, b.limit(1)).first()) == (0, 2, 0, 0)


def test_text_diff(spark, rows):
    old = "\n".join(f"line {i}" for i in range(20))
    new = old.replace("line 3\n", "line three\n").replace("line 15", "line fifteen")
    lines = D.diff_lines(old, new)
    assert ("removed", "line 3") in [x[1:] for x in lines] and ("unchanged", "...") in [x[1:] for x in lines]
    assert D.diff_lines(old, old) == [] and D.diff_lines(None, None) == []
    df = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, None, "x"), (3, "s", "s")], "id long, o string, n string")
    assert rows(D.text_diff(df, "id", "o", "n").where("change <> 'unchanged'").select("id", "change", "text")) == [(1, "added", "c"), (1, "removed", "b"), (2, "added", "x")]


# --- vectors, staged tables, schema


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, v array<double>")
    got = [(r["id"], r["similarity"]) for r in vectors.nearest(df, "v", [1.0, 0.0], 4, ties=["id"]).collect()]
    assert [i for i, _ in got] == [1, 3, 2, 4] and got[3][1] is None
    assert vectors.mean_vector(df, "v", "id < 3") == [0.5, 1.0] and vectors.mean_vector(df, "v", "id > 9") is None
    ok = df.where("id < 4")
    assert vectors.vector_length(ok, "v") == 2 and S.fields_of(vectors.index_column(ok, "v"))[1]["dtype"] == "embedding[2]"
    with pytest.raises(ValueError):
        vectors.vector_length(df.where("id > 4"), "v")


def test_staged_table(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "k long, s string").orderBy("k")
    t = staged.StagedTable.index(df, str(tmp_path / "t"))
    assert t.is_indexed() and [tuple(r) for r in t.ordered().collect()] == [(i, f"n{i}") for i in range(5)]
    ids = [r["_row_id"] for r in t.rows().orderBy("_row_ord").collect()]
    assert t.append({"k": 9, "_row_id": "mine"}).first()["k"] == 9
    t.update(ids[0], {"s": "first"})
    t.update(ids[0], {"k": None})
    t.update_many([(ids[1], {"s": "one"}), (ids[2], {"s": "two"})])
    assert t.delete(ids[4])[0]["k"] == 4
    assert [tuple(r) for r in t.ordered().collect()] == [(None, "first"), (1, "one"), (2, "two"), (3, "n3"), (9, None)]
    assert sorted(r["status"] for r in t.changes().collect()) == ["added", "modified", "modified", "modified", "removed"]
    for bad in (lambda: t.update("nope", {"k": 1}), lambda: t.append({"zz": 1}), lambda: t.update_many([(ids[1], {"s": "x"}), ("nope", {"s": "y"})]), lambda: t.delete(ids[4])):
        with pytest.raises(staged.StagedError):
            bad()
    assert t.get(ids[1]).first()["s"] == "one"  # a failed batch writes nothing
    t.rename_column("s", "name")
    t.add_column("extra", "f64")
    t.retype_column("k", "str")
    assert t.ordered().columns == ["k", "name", "extra"] and t.ordered().first()["k"] is None
    out = t.export(str(tmp_path / "out.jsonl"))
    assert [json.loads(x)["name"] for x in open(out)] == ["first", "one", "two", "n3", None]
    t.drop_column("extra")
    t.restore()
    assert t.ordered().count() == 5
    t.unindex()
    assert not t.is_indexed()


def test_batch_update_is_checked_first(spark, rows):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, s string, n long")
    assert rows(staged.batch_update(base, spark.createDataFrame([(2, "z")], "k long, s string"), "k")) == [(1, "a", 1), (2, "z", 2)]
    for u in ([(3, "z")], [(2, "y"), (2, "z")]):
        with pytest.raises(staged.StagedError):
            staged.batch_update(base, spark.createDataFrame(u, "k long, s string"), "k")


def test_batch_update_can_set_null(spark, rows):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, s string, n long")
    u = spark.createDataFrame([(2, None)], "k long, s string")
    assert rows(staged.batch_update(base, u, "k")) == [(1, "a", 1), (2, None, 2)]
    assert rows(staged.batch_update(base, u, "k", keep_on_null=True)) == [(1, "a", 1), (2, "b", 2)]


def test_staged_table_survives_a_broken_column_edit(spark, tmp_path):
    t = staged.StagedTable.index(spark.range(3).withColumnRenamed("id", "k"), str(tmp_path / "t"))
    t.append({"k": 7})
    with pytest.raises(Exception):  # the cast fails while the new base is written
        t._rewrite(t.rows().withColumn("k", F.raise_error(F.lit("no")).cast("long")))
    assert sorted(r["k"] for r in t.ordered().collect()) == [0, 1, 2, 7]
    t.reindex()
    assert [r["k"] for r in t.ordered().collect()] == [0, 1, 2, 7] and t.changes().count() == 0


def test_two_writers_get_different_numbers(spark, tmp_path):
    t = staged.StagedTable.index(spark.range(2), str(tmp_path / "t"))
    u = staged.StagedTable(spark, str(tmp_path / "t"))
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda x: x._claim(), [t, u] * 8))
    assert len(set(got)) == 16


def test_workspace(spark, tmp_path, rows):
    manifest = spark.createDataFrame([("c1", "a.csv", "h1"), ("c1", "b.txt", "h2"), ("c1", "d.parquet", "h3")], "commit_id string, path string, hash string")
    w = WS.Workspace(spark, str(tmp_path / "w"), "c1")
    assert w.paths() == [] and w.find("a.csv") is None
    t = w.stage("a.csv", spark.createDataFrame([(1, "x"), (2, "y")], "k long, s string").orderBy("k"))
    t.append({"k": 3, "s": "z"})
    assert w.stage("a.csv", spark.range(1)).ordered().count() == 3  # edits stay
    assert w.find("a.csv", "c1") is not None and w.find("a.csv", "c0") is None
    assert rows(w.listed(manifest, "c1").select("path", "is_indexed")) == [("a.csv", True), ("d.parquet", False)]
    assert w.insert("new.jsonl", {"n": 1, "_row_id": "mine"}).count() == 1 and w.insert("new.jsonl", {"n": 2}).count() == 1
    w.rename("new.jsonl", "newer.jsonl")
    for bad in (lambda: w.rename("gone", "x.csv"), lambda: w.rename("a.csv", "newer.jsonl"), lambda: w.table("new.jsonl"), lambda: w.insert("empty.csv", {})):
        with pytest.raises(staged.StagedError):
            bad()
    store = str(tmp_path / "store")
    made = w.commit(manifest, "c1", "c2", store)
    by_path = {r["path"]: r["hash"] for r in made.collect()}
    assert set(by_path) == {"a.csv", "b.txt", "d.parquet", "newer.jsonl"} and by_path["b.txt"] == "h2" and by_path["a.csv"] != "h1"
    from quern.sources.versions import read_version

    assert [tuple(r) for r in read_version(spark, made, store, "c2", "a.csv").collect()] == [(1, "x"), (2, "y"), (3, "z")]
    other = manifest.where("path = 'a.csv'").withColumns({"commit_id": F.lit("c3"), "hash": F.lit("theirs")})
    with pytest.raises(WS.CommitConflict):
        w.commit(made.unionByName(other), "c3", "c4", store)
    w.unstage("newer.jsonl")
    assert w.paths() == ["a.csv"]


def test_frame_digest_and_export(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, 'say "x"\n'), (3, None), (3, None)], "k long, j string")
    assert WS.frame_digest(df) == WS.frame_digest(df.repartition(3)) != WS.frame_digest(df.distinct())
    assert WS.frame_digest(df.limit(0)) != WS.frame_digest(df)
    assert [r["j"] for r in WS.exported(df.withColumn("_row_id", F.lit("r")), json_columns=["j"]).orderBy("k").collect()] == ['{"a": 1}', '"say \\"x\\"\\n"', None, None]
    assert WS.exported(df.withColumn("_row_id", F.lit("r")), ["J"]).columns == ["j"]


def test_schema(spark):
    a = spark.createDataFrame([(1, "x")], "ab long, c string")
    b = spark.createDataFrame([(1, "x")], "a long, bc string")
    assert S.schema_hash(a) != S.schema_hash(b) and S.schema_hash(a) == S.schema_hash(a.select("*"))
    m = S.with_column_metadata(a, "c", {"kind": "text"})
    assert S.schema_hash(m) != S.schema_hash(a) and S.fields_of(m.select("c"))[0]["metadata"] == {"kind": "text"}
    assert S.fields_of(S.inherit_metadata(a, m.schema))[1]["metadata"] == {"kind": "text"}
    assert S.has_column(a, "AB") and not S.has_field(a, "AB")
    assert S.fields_of(S.render_hint(a.withColumnRenamed("c", "file_path"), "image"))[1]["metadata"] == {"render": {"func": "image"}}


# --- graph


def test_graph_against_brute_force(spark):
    import random

    rnd = random.Random(2)
    parents = {f"c{i}": ([f"c{rnd.randrange(i)}"] + ([f"c{rnd.randrange(i)}"] if rnd.random() < 0.4 else []) if i else []) for i in range(16)}
    commits = spark.createDataFrame([(c, p, None) for c, p in parents.items()], "commit_id string, parent_ids array<string>, committed_at timestamp_ntz")

    def reach(c):
        seen, todo = {c: 0}, [c]
        for x in todo:
            for p in parents[x]:
                if p not in seen:
                    seen[p] = seen[x] + 1
                    todo.append(p)
        return seen

    got = {}
    everything = G.ancestors(G.edges_of(commits), commits.select(F.col("commit_id").alias("head")))
    for r in everything.collect():
        got.setdefault(r["head"], {})[r["commit_id"]] = r["depth"]
    assert got == {c: reach(c) for c in parents}
    for a, b in (("c15", "c14"), ("c9", "c3"), ("c7", "c7")):
        both = [x for x in reach(a) if x in reach(b)]
        want = min(both, key=lambda x: (reach(a)[x], x))
        assert G.common_ancestor(everything, commits, a, b).first()["commit_id"] == want
        assert {r[0] for r in G.exclusive(everything, a, b).collect()} == set(reach(b)) - set(reach(a))
        assert G.is_fast_forward(everything, a, b).first()[0] == (a in reach(b))


def test_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "b")], "child string, parent string")
    assert G.ancestors(e, spark.createDataFrame([("a",)], "head string")).count() == 2


def test_merge_classes(spark, rows):
    f = lambda d: spark.createDataFrame(list(d.items()) or [], "path string, hash string")
    o = {"same": "1", "ours": "1", "theirs": "1", "both": "1", "gone_ours": "1", "gone_theirs": "1", "gone_both": "1", "del_mod": "1", "null": None}
    b = {"same": "1", "ours": "2", "theirs": "1", "both": "2", "gone_theirs": "1", "new_ours": "5", "new_both": "6", "null": None}
    m = {"same": "1", "ours": "1", "theirs": "3", "both": "3", "gone_ours": "1", "new_theirs": "7", "new_both": "8", "del_mod": "9", "null": None}
    got = dict(rows(G.merge_classes(f(o), f(b), f(m))))
    assert got == {"same": "keep", "ours": "keep", "theirs": "take", "both": "conflict", "gone_theirs": "delete", "new_ours": "keep", "new_theirs": "take", "new_both": "conflict", "del_mod": "conflict", "null": "keep"}


def test_manifests(spark, rows):
    f = spark.createDataFrame([("c", "a/b/x.csv", 5), ("c", "a/y.png", None), ("c", "z", 2)], "commit_id string, path string, num_bytes long")
    got = {(r["dir"], r["data_type"]): (r["files"], r["bytes"]) for r in G.dir_rollup(f).collect()}
    assert got == {("", "tabular"): (1, 5), ("", "image"): (1, 0), ("", "binary"): (1, 2), ("a", "tabular"): (1, 5), ("a", "image"): (1, 0), ("a/b", "tabular"): (1, 5)}
    assert rows(G.children(f, "a").select("name", "is_dir")) == [("b", True), ("y.png", False)]
    assert rows(G.match_paths(f, "a/**/*.{csv,png}").select("path")) == [("a/b/x.csv",), ("a/y.png",)]
    assert rows(G.match_paths(f, "*").select("path")) == [("z",)]
    assert G.chunks(spark.createDataFrame([(1, "abcde"), (2, ""), (3, None)], "k long, t string"), "k", "t", 2).count() == 3


# --- files


CSV = {
    "mixed.csv": ("prompt,ok,score,n\nhi,true,1.5,3\nyo,false,,4\n", 2, "prompt:str,ok:bool,score:f64,n:i64"),
    "tabs.csv": ("file\tlabel\tx\ty\nimages/a.jpg\tdog\t1\t2\n", 1, "file:str,label:str,x:i64,y:i64"),
    "quoted.csv": ('name,description,value\na,"x, ""y""\nz",1\nb,c,2\n', 2, "name:str,description:str,value:i64"),
    "emoji.csv": ("🐂,🚜\n1,2\n", 1, "🐂:i64,🚜:i64"),
    "semi.csv": ("a;b\n1;x\n2;y\n", 2, "a:i64,b:str"),
    "spam.tsv": ('category\ttext\nham\tsay "hi\nspam\tbuy now\n', 2, "category:str,text:str"),
    "ragged.csv": ("a,b\n1,2,3\n4\n", 2, "a:i64,b:i64"),
    "empty.csv": ("a,b\n", 0, "a:str,b:str"),
}


@pytest.mark.parametrize("name", CSV)
def test_hostile_csv(spark, tmp_path, name):
    text, n, schema = CSV[name]
    (tmp_path / name).write_text(text, encoding="utf-8")
    df = files.read_df(spark, str(tmp_path / name))
    assert (df.count(), files.schema_text(df)) == (n, schema)


def test_late_bad_cell_becomes_null(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "INFER_ROWS", 5)
    (tmp_path / "late.csv").write_text("a\n" + "\n".join(map(str, range(8))) + "\nword\n")
    df = files.read_df(spark, str(tmp_path / "late.csv"))
    assert df.schema["a"].dataType == T.LongType() and df.where("a is null").count() == 1


@pytest.mark.parametrize("ext", ["csv", "tsv", "json", "jsonl", "ndjson", "parquet", "arrow"])
def test_round_trip(spark, tmp_path, rows, ext):
    df = spark.createDataFrame([(1, 'a, "b"\tc\n', 1.5, True), (2, None, None, None), (3, "ünïcode", -2.25, False)], "k long, s string, x double, b boolean")
    path = files.write_df(df, str(tmp_path / f"t.{ext}"))
    assert os.path.isfile(path)
    assert rows(files.read_df(spark, path).select("k", "s", "x", "b")) == rows(df)
    files.write_df(df.limit(1), path)  # an existing file is replaced
    assert files.read_df(spark, path).count() == 1
    assert files.read_df(spark, files.write_df(df, str(tmp_path / f"t2.{ext}")), rows=2).count() == 2
    assert sorted(os.listdir(tmp_path))[:2] in ([f".t.{ext}.crc", f".t2.{ext}.crc"], [f"t.{ext}", f"t2.{ext}"])  # nothing is left behind
    if ext not in ("json", "arrow"):
        folder = files.write_df(df.repartition(3), str(tmp_path / f"many.{ext}"), single=False)
        files.write_df(df.repartition(2), folder, single=False)
        assert os.path.isdir(folder) and files.read_df(spark, folder).count() == 3


def test_empty_tables_can_be_written(spark, tmp_path):
    df = spark.createDataFrame([], "k long, s string")
    for ext in ("json", "arrow", "parquet", "csv"):
        assert files.read_df(spark, files.write_df(df, str(tmp_path / f"e.{ext}"))).count() == 0


def test_a_reader_keeps_the_old_file(spark, tmp_path):
    path = files.write_df(spark.range(3).coalesce(1), str(tmp_path / "x.jsonl"))
    with open(path) as old:
        files.write_df(spark.range(5), path)
        assert len(old.read().splitlines()) == 3 and len(open(path).read().splitlines()) == 5


def test_inference_looks_at_every_row(spark, tmp_path):
    n = 10_050
    (tmp_path / "late.csv").write_text("a,b\n" + "".join(f"{i},{i}\n" for i in range(n)) + "word,1\n")
    df = files.read_df(spark, str(tmp_path / "late.csv"))
    assert files.schema_text(df) == "a:str,b:i64" and df.where("a = 'word'").count() == 1
    (tmp_path / "late.jsonl").write_text('{"a": 1}\n' * n + '{"a": 1, "late": "x"}\n')
    assert files.read_df(spark, str(tmp_path / "late.jsonl")).where("late = 'x'").count() == 1


def test_quotes_beyond_the_head(spark, tmp_path):
    # the first quotes of a file stand after its first 64 KiB
    (tmp_path / "q.csv").write_text("a,b\n" + "plain,text\n" * 8000 + '"x, ""y""\nz",1\n')
    df = files.read_df(spark, str(tmp_path / "q.csv"))
    assert df.count() == 8001 and df.where(F.col("a") == 'x, "y"\nz').count() == 1
    (tmp_path / "lone.csv").write_text("a,b\n" + "plain,text\n" * 8000 + '5" pipe,1\nend,2\n')
    df = files.read_df(spark, str(tmp_path / "lone.csv"))
    assert df.count() == 8002 and df.where(F.col("a") == '5" pipe').count() == 1


def test_files_without_spanning_cells_are_split(spark, tmp_path):
    (tmp_path / "big.csv").write_text("a,b\n" + '"x, y",1\n' * 300_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 19)
    try:
        df = files.read_df(spark, str(tmp_path / "big.csv"))
        assert df.rdd.getNumPartitions() > 2 and df.count() == 300_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_errors(spark, tmp_path):
    for bad in ("noext", "x.xyz"):
        with pytest.raises(files.FormatError):
            files.read_df(spark, str(tmp_path / bad))
        with pytest.raises(files.FormatError):
            files.write_df(spark.range(1), str(tmp_path / bad))
    with pytest.raises(files.FormatError):
        files.read_df(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(files.FormatError):
        files.sniff("a,b", ",,")
    with pytest.raises(files.FormatError):
        files.sniff("a,b", None, "")


def test_nested_and_binary_views(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok"), [1, 2]), (2, bytearray(b"\xff\xfe"), None)], "k long, b binary, l array<long>")
    got = [json.loads(r[0]) for r in files.json_view(df).collect()]
    assert got == [{"k": 1, "b": "[binary]", "l": [1, 2]}, {"k": 2, "b": "[binary]", "l": None}]
    assert json.loads(files.json_view(df.limit(1)).first()[0])["b"] == "ok"


def test_listing_and_json_rows(spark, tmp_path, rows):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/a.txt").write_text("x")
    (tmp_path / "d/e/b.txt").write_text("y")
    assert rows(files.listing(spark, str(tmp_path / "d"), extra=[("label", "str")])) == [("a.txt", None), ("e/b.txt", None)]
    assert rows(files.listing(spark, str(tmp_path / "d"), recursive=False)) == [("a.txt",)]
    assert files.parse_json_rows(spark, "{}").count() == 0
    assert rows(files.parse_json_rows(spark, '{"a": 1}\n{"a": 2}')) == [(1,), (2,)]


# --- streaming, joins


def test_streaming_dataset(spark):
    parts = [spark.createDataFrame([(f"p_{k}_{i}", i) for i in range(33)], "path string, x long").coalesce(1) for k in range(3)]
    ds = reader.StreamingDataset(parts, ["path"])
    assert len(ds) == 99 and [r["path"] for r in ds] == [f"p_{k}_{i}" for k in range(3) for i in range(33)]
    assert ds.slice(30, 35).count() == 5
    with pytest.raises(ValueError):
        reader.StreamingDataset([])


def test_sized_join_beyond_its_bound_shuffles(spark, rows):
    big = spark.createDataFrame([(i % 3, i) for i in range(60)], "k long, v long")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, s string")
    wide, narrow = sized_join(big, small, "k"), sized_join(big, small, "k", limit=0)
    assert rows(wide) == rows(narrow) and len(rows(wide)) == 40
    assert measured_bytes(small.limit(0)) == (0, 0)


def test_library_needs_no_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent / "quern"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"quern\.llm|from quern import llm", p.read_text()), p
