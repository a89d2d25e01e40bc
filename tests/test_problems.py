"""The general data-pipeline operators against brute force on small hostile inputs."""

import datetime as dt
import json
import math
import random
import re
import unittest.mock

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import copies, drift, rejects, snapshots

NAN = float("nan")
BOX = "filename string, file string, label string, min_x double, min_y double, width long, height long, contributor string, added_at timestamp_ntz, diff_id string"
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
KEYS, FIELDS = ["file", "label"], ["min_x", "min_y", "width", "height", "contributor", "added_at"]


def box(filename, file, label, x=1.0, y=1.0, w=1, h=1, c="a", t=T0):
    # diff_id clashes with a column of the pairs on purpose: columns outside keys and fields are ignored
    return (filename, file, label, x, y, w, h, c, t, "clash")


def test_copies(spark, rows):
    pairs = spark.createDataFrame([(1, "f", "f"), (1, "f", "f"), (2, "f", None), (3, None, "g"), (4, "gone", "gone"), (5, "f", "g")], "diff_id long, filename1 string, filename2 string")
    left = spark.createDataFrame(
        [box("f", "a", "x"), box("f", "a", "x"), box("f", "b", None), box("f", "c", ""), box("f", "d", "x", NAN, None), box("f", "e", "x", 1.0, 2.0, None, 2, None, None), box("f", "g", "x", 1.0)], BOX
    )
    right = spark.createDataFrame(
        [box("f", "a", "x", 1.0 + 1e-7), box("f", "b", None, w=2), box("f", "d", "x", NAN, None), box("f", "e", "x", NAN, None, 3, 2, "a", T1), box("f", "h", "X"), box("f", "g", "x", 1.00001), box("g", "a", "x"), box("g", "a", "x")], BOX
    )
    got = rows(copies.diff_pairs(pairs, left, right, KEYS, FIELDS))
    one = [r[1:] for r in got if r[0] == 1]
    want = [("b", None, "modified", "width"), ("c", "", "removed", "*"), ("g", "x", "modified", "min_x"), ("h", "X", "added", "*")]
    want += [("e", "x", "modified", f) for f in ("min_x", "min_y", "width", "contributor", "added_at")]
    assert sorted(one, key=repr) == sorted(want, key=repr)
    assert {r[3] for r in got if r[0] == 2} == {"removed"} and len([r for r in got if r[0] == 2]) == 6
    assert [r for r in got if r[0] == 3] == [(3, "a", "x", "added", "*")]
    assert not [r for r in got if r[0] == 4]
    assert len([r for r in got if r[0] == 5]) == 5  # (a, x) is the same in both
    recorded = pairs.withColumn("row_counts", F.when(F.col("diff_id") == 1, F.struct(F.lit(1).alias("added"), F.lit(1).alias("removed"), F.lit(3).alias("modified"))))
    counts = {r["diff_id"]: r for r in copies.pair_row_counts(recorded, copies.diff_pairs(pairs, left, right, KEYS, FIELDS)).collect()}
    assert (counts[1]["added"], counts[1]["removed"], counts[1]["modified"], counts[1]["recorded_ok"]) == (1, 1, 3, True)
    assert (counts[4]["added"], counts[4]["recorded_ok"]) == (0, False)


def test_cells_cancel_behind_one_exchange(spark):
    left = spark.createDataFrame([(1, "a", 1.0), (2, "b", NAN), (3, None, None)], "k long, s string, x double")
    right = spark.createDataFrame([(1, "a", 1.0), (2, "c", NAN), (4, None, 0.0)], "k long, s string, x double")
    cells = copies.signed_cells(left, right, ["k"], ["s", "x"])
    assert sorted((r["k"], r["field"], r["n"]) for r in cells.collect()) == sorted([(2, "s", -1), (2, "s", 1), (3, "*", -1), (3, "s", -1), (3, "x", -1), (4, "*", 1), (4, "s", 1), (4, "x", 1)])
    plan = copies.diff_copies(left, right, ["k"], ["s", "x"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_cells_of_every_type(spark):
    make = lambda i: spark.sql(f"select 1 k, cast({i} as tinyint) a, {i}L b, cast({i} as decimal(9,3)) c, date'2024-01-0{i}' d, timestamp_ntz'2024-01-0{i} 00:00:00.00000{i}' e, {i} = 1 f, array({i}, null) g, struct({i} as x, null as y) h, map('k', {i}) i, cast('{i}' as binary) j, cast({i} as float) l")
    fields = list("abcdefghijl")
    assert copies.diff_copies(make(1), make(1), ["k"], [f for f in fields if f != "i"]).count() == 0
    plain = [f for f in fields if f != "i"]  # maps have no order, so rows that hold one cannot be ranked
    assert {r["field"] for r in copies.diff_copies(make(1), make(2), ["k"], plain).collect()} == set(plain)
    nulls = make(1).select("k", *[F.lit(None).cast(make(1).schema[f].dataType).alias(f) for f in plain])
    assert {r["field"] for r in copies.diff_copies(make(1), nulls, ["k"], plain).collect()} == set(plain)
    assert [tuple(r) for r in copies.diff_copies(make(1), make(1).limit(0), ["k"], []).collect()] == [(1, "removed", "*")]


def test_copies_of_empty_tables(spark):
    pairs = spark.createDataFrame([], "diff_id long, filename1 string, filename2 string")
    none = spark.createDataFrame([], BOX)
    assert copies.diff_pairs(pairs, none, none, KEYS, FIELDS).count() == 0
    some = spark.createDataFrame([(1, "f", "f")], pairs.schema)
    assert copies.diff_pairs(some, none, none, KEYS, FIELDS).count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.floats(0, 2)))), st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.floats(0, 2)))))
def test_copies_property(spark, a, b):
    a, b = {r[0]: r for r in a}, {r[0]: r for r in b}
    schema = "k long, v long, x double"
    got = {tuple(r) for r in copies.diff_copies(spark.createDataFrame(list(a.values()), schema), spark.createDataFrame(list(b.values()), schema), ["k"], ["v", "x"]).collect()}
    want = {(k, "removed", "*") for k in a.keys() - b.keys()} | {(k, "added", "*") for k in b.keys() - a.keys()}
    for k in a.keys() & b.keys():
        if a[k][1] != b[k][1]:
            want.add((k, "modified", "v"))
        x, y = a[k][2], b[k][2]
        if (x is None) != (y is None) or (x is not None and abs(x - y) > 1e-6):
            want.add((k, "modified", "x"))
    assert got == want


def test_snapshots_against_brute_force(spark):
    rnd = random.Random(5)
    ids = [f"c{i}" for i in range(12)]
    commits = [(c, [] if i == 0 else None if i == 7 else [ids[rnd.randrange(i)], "zz"][: rnd.choice([1, 2])]) for i, c in enumerate(ids)]
    commits += [("orphan", ["unknown"]), ("hollow", ["c0"]), commits[3]]
    entries = []
    for c in [*ids, "orphan", "stray"]:
        for p in rnd.sample(["a", "b", "A", None, "d/e", ""], 4):
            for _ in range(rnd.choice([1, 1, 2])):
                entries.append((c, p, rnd.choice([None, "aa", "AA", "bb"]), T0 + dt.timedelta(hours=rnd.randrange(3)), "x"))
    entries += entries[:5]
    e = spark.createDataFrame(entries, "commit_id string, path string, hash string, received_at timestamp_ntz, status string")
    k = spark.createDataFrame(commits, "commit_id string, parent_ids array<string>")
    state: dict = {}
    for c, p, h, t, _ in entries:
        h = h.lower() if h is not None else None
        cur = state.setdefault(c, {}).get(p)
        if cur is None or (t, h or "") > (cur[0], cur[1] or ""):
            state[c][p] = (t, h)
    want = set()
    for c, ps in commits:
        if ps:
            new, old = state.get(c, {}), state.get(ps[0], {})
            want |= {(c, p, "added") for p in new.keys() - old.keys()} | {(c, p, "removed") for p in old.keys() - new.keys()}
            want |= {(c, p, "modified") for p in new.keys() & old.keys() if new[p][1] != old[p][1]}
    got = [tuple(r) for r in snapshots.commit_changes(e, k).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(c == "hollow" for c, _, _ in got) and any(c == "orphan" for c, _, _ in got)
    assert snapshots.commit_changes(e.limit(0), k).count() == 0
    assert snapshots.commit_changes(e, k.limit(0)).count() == 0


def test_snapshots_are_kept_in_sorted_ranges_and_merged_without_an_exchange(spark):
    e = spark.createDataFrame([(f"c{i % 7}", f"p{i * 37 % 101:03}", "h", T0) for i in range(700)], "commit_id string, path string, hash string, received_at timestamp_ntz")
    k = spark.createDataFrame([(f"c{i}", [f"c{i - 1}"]) for i in range(1, 7)], "commit_id string, parent_ids array<string>")
    kept = snapshots.kept_snapshots(e, snapshots.first_parents(k), "path", F.lower("hash"), F.col("received_at"))
    parts = {}
    for r in kept.withColumn("part", F.spark_partition_id()).collect():
        parts.setdefault(r["part"], []).append((r["__at"], r["path"], r["__new"]))
    assert len(parts) > 1 and all(x == sorted(x) for x in parts.values())
    ranges = sorted((x[0][:2], x[-1][:2]) for x in parts.values())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    merge = snapshots.commit_changes(e, k)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in merge and "Aggregate" not in merge and "Sort" not in merge


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_snapshot_merge_over_batches(monkeypatch, step):
    monkeypatch.setattr(snapshots, "MERGE_ROWS", step)
    rows = [("s", "a", False, "1"), ("s", "a", True, "1"), ("s", "b", False, "1"), ("s", "c", True, None), ("s", "d", False, None), ("s", "d", True, None), ("s", None, False, "x"), ("s", None, True, None)]
    rows += [("t", "a", False, str(i)) for i in range(150)] + [("t", "a", True, str(i)) for i in range(149)] + [("t", "b", False, None), ("t", "b", True, "z")]
    rows += [("u", "h", True, "q")] * 200
    t = pa.table([[r[i] for r in rows] for i in range(4)], names=["at", "k", "new", "x"], schema=None)
    got = [tuple(r.values()) for b in snapshots._stream(iter(t.to_batches(max_chunksize=5)), ["c", "k", "s"]) for r in b.to_pylist()]
    assert sorted(got, key=repr) == sorted([("s", "b", "removed"), ("s", "c", "added"), ("s", None, "modified"), ("t", "a", "modified"), ("t", "b", "modified"), ("u", "h", "added")], key=repr)


def _field(path, v, name, kind, no=1):
    return (path, v, no, name, kind, None, T0)


FIELD = "path string, file_version int, field_no int, name string, dtype string, changes string, committed_at timestamp_ntz"
RECORD = "path string, file_version int, row_key long, record string"


def test_schema_changes(spark, rows):
    fields = [_field("p", 1, n, t) for n, t in (("a", "i64"), ("b", "str"), ("c", "f64"), ("d", "bool"), ("e", "i64"))]
    fields += [_field("p", 4, n, t) for n, t in (("a", "int64"), ("b2", "string"), ("c", "str"), ("f", "boolean"), ("A", "i64"))]
    fields += [_field("q", 1, "only", "str"), *fields[:2]]
    rec = []
    for k in range(4):
        rec.append(("p", 1, k, json.dumps({"a": k, "b": f"x{k}", "c": 1.5, "d": k % 2 == 0, "e": 7 + k})))
        new = {"a": k, "b2": f"x{k}", "c": "1.5", "f": k % 2 == 1}
        if k != 2:
            new["A"] = k
        rec.append(("p", 4, k, json.dumps(new)))
    rec.append(("p", 4, 99, json.dumps({"b2": "other"})))
    rec.append(("p", 1, 77, "not json"))
    rec += rec[:3]
    got = rows(drift.schema_changes(spark.createDataFrame(fields, FIELD), spark.createDataFrame(rec, RECORD)).select("path", "file_version", "name", "change"))
    assert got == sorted([("p", 4, "b2", "renamed"), ("p", 4, "c", "retyped"), ("p", 4, "d", "removed"), ("p", 4, "e", "removed"), ("p", 4, "f", "added"), ("p", 4, "A", "added")], key=repr)


def test_schema_changes_prefers_the_alike_name_and_stays_one_to_one(spark, rows):
    fields = [_field("p", 1, n, "i64") for n in ("size_left", "size_right")] + [_field("p", 2, n, "i64") for n in ("right_size", "left_size", "third")]
    rec = [("p", v, k, json.dumps({n: 1 for n in names})) for v, names in ((1, ("size_left", "size_right")), (2, ("right_size", "left_size", "third"))) for k in range(3)]
    out = drift.schema_changes(spark.createDataFrame(fields, FIELD), spark.createDataFrame(rec, RECORD))
    renamed = {(r["old_name"], r["name"]) for r in out.where("change = 'renamed'").collect()}
    assert len(renamed) == 2 and {n for _, n in renamed} == {"left_size", "right_size"}
    assert rows(out.where("change = 'added'").select("name")) == [("third",)]


def test_null_columns_and_absent_nulls_are_equal(spark, rows):
    fields = [_field("p", 1, "old", "str"), _field("p", 2, "new", "str")]
    rec = [("p", 1, 1, '{"old": null}'), ("p", 2, 1, "{}"), ("p", 1, 2, '{"old": "v"}'), ("p", 2, 2, '{"new": "v"}')]
    got = rows(drift.schema_changes(spark.createDataFrame(fields, FIELD), spark.createDataFrame(rec, RECORD)).select("name", "change"))
    assert got == [("new", "renamed")]


def test_one_table(spark):
    fields = [_field("p", 1, "n", "i64"), _field("p", 2, "n", "f64"), _field("p", 3, "num", "f64"), _field("p", 3, "extra", "str")]
    rec = [("p", 1, 1, '{"n": 3}'), ("p", 2, 1, '{"n": 3.5}'), ("p", 3, 1, '{"num": 3.5, "extra": "x"}'), ("p", 1, 1, '{"n": 3}')]
    f, r = spark.createDataFrame(fields, FIELD), spark.createDataFrame(rec, RECORD)
    got = {x["file_version"]: x["row"] for x in drift.one_table(r, drift.column_map(f, drift.schema_changes(f, r))).collect()}
    assert got == {1: {"num": "3.0"}, 2: {"num": "3.5"}, 3: {"num": "3.5", "extra": "x"}}


def test_long_chains_of_renames(spark):
    n = 21
    fields = [_field("f", v, f"n{v}", "i64") for v in range(n)] + [_field("f", v, "same", "i32" if v < 9 else "i64") for v in range(n) if v != 5]
    records = [("f", v, k, json.dumps({f"n{v}": k * 7, "same": 1})) for v in range(n) for k in range(3)]
    f, r = spark.createDataFrame(fields, FIELD), spark.createDataFrame(records, RECORD)
    changes = drift.schema_changes(f, r)
    assert changes.where("change = 'renamed'").count() == n - 1
    got = {(x["file_version"], x["name"]): (x["column"], x["column_type"]) for x in drift.column_map(f, changes).collect()}
    assert all(got[(v, f"n{v}")] == (f"n{n - 1}", "i64") for v in range(n)) and got[(3, "same")] == got[(20, "same")] == ("same", "i64")


def test_drift_of_empty_tables(spark):
    f, r = spark.createDataFrame([], FIELD), spark.createDataFrame([], RECORD)
    assert drift.schema_changes(f, r).count() == 0
    assert drift.one_table(r, drift.column_map(f, drift.schema_changes(f, r))).count() == 0


def test_flooding_settles():
    old = [{"name": f"col_{i}", "type": "str", "no": i, "print": str(i)} for i in range(30)]
    new = [{"name": f"column_{i}", "type": "str", "no": i, "print": str(i)} for i in range(30)]
    score = drift.flood(old, new)
    assert max(score.values()) <= 1.0 and all(math.isfinite(v) for v in score.values())
    assert {(a, b) for a, b in drift.select_renames(old, new)} == {(f"col_{i}", f"column_{i}") for i in range(30)}


def brute(raw, delimiter, quote, width, numbers):
    """Reason by a plain character scan."""
    s = raw[:-1] if raw.endswith("\r") else raw
    cells, i = [], 0
    while True:
        if s[i : i + 1] == quote:
            j, cur = i + 1, ""
            while True:
                if j >= len(s):
                    return "quoting"
                if s[j] == quote:
                    if s[j + 1 : j + 2] == quote:
                        cur += quote
                        j += 2
                        continue
                    break
                cur += s[j]
                j += 1
            cells.append(cur)
            i = j + 1
            if i == len(s):
                break
            if s[i] != delimiter:
                return "quoting"
            i += 1
        else:
            j = s.find(delimiter, i)
            c = s[i:] if j < 0 else s[i:j]
            if quote in c:
                return "quoting"
            cells.append(c)
            if j < 0:
                break
            i = j + 1
    if len(cells) != width:
        return "column_count"
    for k in numbers:
        c = cells[k]
        digits = c[1:] if c[:1] in ("+", "-") else c
        if c and not (digits.isascii() and digits.isdigit() and -(2**63) <= int(c) < 2**63):
            return "value"
    return None


CSV_FILES = "file_id long, path string, layout string, delimiter string, quote_char string, raw string"
CSV_RECORDS = "file_id long, line_no int, raw string"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1,;\"'\n\r\\+- \t", max_size=14), min_size=1, max_size=40))
def test_rejects_property(spark, raws):
    spec = [(1, "quoted_fields", ",", '"', 3, [2], "name,description,value"), (2, "tabs", ";", "'", 4, [2, 3], "﻿file;label;x;y\r"), (3, "tabs", "\t", '"', 5, [2, 3], "file\tlabel\tx\ty\textra")]
    files = spark.createDataFrame([(i, "p", lay, None, q, "clash") for i, lay, d, q, w, n, h in spec], CSV_FILES)
    rec, want = [], set()
    for i, lay, d, q, w, n, head in spec:
        rec.append((i, 1, head))
        for k, r in enumerate(raws, 2):
            rec.append((i, k, r))
            if reason := brute(r, d, q, w, n):
                want.add((i, k, reason))
    # with the patterns in the plan, and as columns
    for most in (rejects.MOST_LITERALS, 0):
        with unittest.mock.patch.object(rejects, "MOST_LITERALS", most):
            got = [tuple(r) for r in rejects.rejected(spark.createDataFrame(rec + rec[-2:], CSV_RECORDS), files).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.integers(-(2**64), 2**64), st.integers(-2, 2).map(lambda i: 2**63 + i), st.integers(-2, 2).map(lambda i: -(2**63) + i)), st.sampled_from(["", "+", "-"]), st.integers(0, 30))
def test_whole_number_pattern(n, sign, zeros):
    text = sign + "0" * zeros + str(abs(n))
    fits = -(2**63) <= int(text) < 2**63
    assert (re.fullmatch(rejects.whole_number_pattern(), text) is not None) == fits


def test_whole_number_pattern_wants_digits():
    assert not any(re.fullmatch(rejects.whole_number_pattern(), x) for x in ("", "+", "-", " 1", "1 ", "1.0", "++1", "１", "1e3"))


@pytest.mark.parametrize("most", [512, 0])
def test_rejects_edges(spark, rows, monkeypatch, most):
    monkeypatch.setattr(rejects, "MOST_LITERALS", most)
    files = spark.createDataFrame([(1, "p", "quoted_fields", ";", '"', ""), (2, "p", "tabs", None, None, ""), (3, "p", "other", ",", '"', "")], CSV_FILES)
    long = "x" * 300_000
    rec = [
        (1, 1, "name,description,value"), (1, 2, "a,b,9223372036854775807"), (1, 3, "a,b,9223372036854775808"), (1, 4, "a,b,-9223372036854775808"), (1, 5, "a,b,+000000000000000000000000007"),
        (1, 6, "a,b,+"), (1, 7, "a,b, 1"), (1, 8, 'a,"b,1'), (1, 9, ""), (1, 10, None), (1, 11, f'a,"{long}""{long}",1'), (1, 12, f'a,"{long}""{long},1'), (1, 13, 'a,"' + '""' * 50_000 + '",2'), (1, 14, "a,b,١"), (1, 15, 'a,"b\nc","5"\r'), (1, 16, "a,b,1\r\r"),
        (2, 2, "f,l,1,2"), (3, 1, "h1,h2"), (3, 2, "x,y"), (3, 3, "x"), (9, 2, "q"),
    ]
    got = rows(rejects.rejected(spark.createDataFrame(rec, CSV_RECORDS), files))
    assert got == sorted([(1, 3, "value"), (1, 6, "value"), (1, 7, "value"), (1, 8, "quoting"), (1, 9, "column_count"), (1, 10, "column_count"), (1, 12, "quoting"), (1, 14, "value"), (1, 16, "value"), (3, 3, "column_count"), (9, 2, "column_count")], key=repr)
    good = {(r["file_id"], r["line_no"]): r for r in rejects.loaded(spark.createDataFrame(rec, CSV_RECORDS), files).collect()}
    assert good[(1, 15)]["text_2"] == "b\nc" and good[(1, 15)]["number_1"] == 5 and good[(1, 5)]["number_1"] == 7
    assert good[(1, 13)]["text_2"] == '"' * 50_000 and good[(2, 2)]["number_2"] == 2
    broken = {(r["file_id"], r["line_no"]): r["field_no"] for r in rejects.first_broken(spark.createDataFrame(rec, CSV_RECORDS), files).collect()}
    assert broken[(1, 3)] == 3 and broken[(1, 8)] == 2 and broken[(3, 3)] == 2
    assert rejects.rejected(spark.createDataFrame([], CSV_RECORDS), files).count() == 0
