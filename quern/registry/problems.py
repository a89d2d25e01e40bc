"""Queries of the general data-pipeline operators (problems 1, 2, 4 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import copies, drift, rejects, snapshots

BOX_KEYS = ("file", "label")
BOX_FIELDS = ("min_x", "min_y", "width", "height", "contributor", "added_at")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pair_diff(spark: SparkSession, d: str) -> DataFrame:
    return copies.diff_pairs(table(spark, d, "tabular_diffs"), table(spark, d, "boxes_left"), table(spark, d, "boxes_right"), BOX_KEYS, BOX_FIELDS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pair_diff(spark, d).withColumn("label", F.coalesce("label", F.lit("")))


def p1_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return copies.pair_row_counts(table(spark, d, "tabular_diffs"), _pair_diff(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "schema_fields"), table(spark, d, "frame_records")).select("path", "file_version", "name", "change")


def p2_columns(spark: SparkSession, d: str) -> DataFrame:
    fields = table(spark, d, "schema_fields")
    return drift.column_map(fields, drift.schema_changes(fields, table(spark, d, "frame_records")))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    out = drift.one_table(table(spark, d, "frame_records"), p2_columns(spark, d))
    return out.withColumn("row", F.to_json("row", {"ignoreNullFields": "false"}))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.rejected(table(spark, d, "csv_records"), table(spark, d, "csv_files"))


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.loaded(table(spark, d, "csv_records"), table(spark, d, "csv_files"))


def p4_broken_field(spark: SparkSession, d: str) -> DataFrame:
    return rejects.first_broken(table(spark, d, "csv_records"), table(spark, d, "csv_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.commit_changes(table(spark, d, "commit_entries"), table(spark, d, "commits"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p5_found(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_row_counts, p2_found, p2_columns, p2_table, p4_found, p4_loaded, p4_broken_field, p5_found, p5_counts)}

_P1 = """
with pairs as (select distinct diff_id, filename1, filename2 from tabular_diffs),
l as (select distinct p.diff_id, b.file, b.label, b.min_x, b.min_y, b.width, b.height, b.contributor, b.added_at from pairs p join boxes_left b on b.filename = p.filename1),
r as (select distinct p.diff_id, b.file, b.label, b.min_x, b.min_y, b.width, b.height, b.contributor, b.added_at from pairs p join boxes_right b on b.filename = p.filename2),
j as (select coalesce(l.diff_id, r.diff_id) diff_id, case when l.diff_id is null then r.file else l.file end file, case when l.diff_id is null then r.label else l.label end label,
  l.diff_id is null as only_r, r.diff_id is null as only_l,
  {fields}
  from l full join r on l.diff_id = r.diff_id and l.file is not distinct from r.file and l.label is not distinct from r.label),
found as (
  select diff_id, file, label, 'added' status, '*' field from j where only_r
  union all select diff_id, file, label, 'removed', '*' from j where only_l
  {cells})
"""


def _p1(tail: str) -> str:
    def differs(f: str) -> str:
        if f in ("min_x", "min_y"):
            return f"(l.{f} is distinct from r.{f} and not coalesce(case when isnan(l.{f}) or isnan(r.{f}) then false else abs(l.{f} - r.{f}) <= 1e-6 end, false))"
        return f"(l.{f} is distinct from r.{f})"

    fields = ", ".join(f"{differs(f)} as d_{f}" for f in BOX_FIELDS)
    cells = " ".join(f"union all select diff_id, file, label, 'modified', '{f}' from j where not only_l and not only_r and d_{f}" for f in BOX_FIELDS)
    return _P1.format(fields=fields, cells=cells) + tail


_P5 = """
with e as (select commit_id, path, lower(hash) h from (
    select commit_id, path, hash, row_number() over (partition by commit_id, path order by received_at desc nulls last, lower(hash) desc nulls last) k from commit_entries where commit_id is not null) where k = 1),
p as (select distinct commit_id, parent_ids[1] parent from commits where parent_ids[1] is not null),
n as (select p.commit_id, e.path, e.h from p join e on e.commit_id = p.commit_id),
o as (select p.commit_id, e.path, e.h from p join e on e.commit_id = p.parent),
found as (select coalesce(n.commit_id, o.commit_id) commit_id, coalesce(n.path, o.path) path,
  case when o.commit_id is null then 'added' when n.commit_id is null then 'removed' else 'modified' end status
  from n full join o on n.commit_id = o.commit_id and n.path is not distinct from o.path
  where o.commit_id is null or n.commit_id is null or n.h is distinct from o.h)
"""

_P2 = """
with f as (select path, file_version as v, name, case dtype when 'int64' then 'i64' when 'int32' then 'i32' when 'float64' then 'f64' when 'string' then 'str' when 'boolean' then 'bool' else coalesce(dtype, '?') end as t
  from (select *, row_number() over (partition by path, file_version, name order by committed_at desc nulls last, field_no desc nulls last, dtype desc nulls last) as k from schema_fields where path is not null and file_version is not null and name is not null) where k = 1),
st as (select path, v, lag(v) over (partition by path order by v) as ov from (select distinct path, v from f)),
n as (select st.path, st.v, f.name, f.t from st join f on f.path = st.path and f.v = st.v where ov is not null),
o as (select st.path, st.v, f.name, f.t from st join f on f.path = st.path and f.v = st.ov),
j as (select coalesce(n.path, o.path) as path, coalesce(n.v, o.v) as v, coalesce(n.name, o.name) as name, o.t as ot, n.t as nt from n full join o on n.path = o.path and n.v = o.v and n.name = o.name),
r as (select distinct path, file_version as v, row_key, record from frame_records),
c as (select st.path, st.v, a.record as nr, b.record as orr from st join r a on a.path = st.path and a.v = st.v join r b on b.path = st.path and b.v = st.ov and b.row_key = a.row_key),
same as (select g.path, g.v, g.name as old, h.name as new from j g join j h on g.path = h.path and g.v = h.v and g.nt is null and h.ot is null and g.ot = h.nt
  where not exists (select 1 from c where c.path = g.path and c.v = g.v and json_extract_string(c.orr, '$."' || g.name || '"') is distinct from json_extract_string(c.nr, '$."' || h.name || '"'))),
found as (select path, v, new as name, 'renamed' as change from same
  union all select path, v, name, 'added' from j where ot is null and not exists (select 1 from same s where s.path = j.path and s.v = j.v and s.new = j.name)
  union all select path, v, name, 'removed' from j where nt is null and not exists (select 1 from same s where s.path = j.path and s.v = j.v and s.old = j.name)
  union all select path, v, name, 'retyped' from j where ot <> nt)
"""

# each field of each version follows its renames to the last version that has it
_P2_COLUMNS = _P2.replace("with f as", "with recursive f as", 1).rstrip() + """,
walk(path, v0, n0, v, n) as (select path, v, name, v, name from f
  union all select w.path, w.v0, w.n0, s.v, coalesce(r.new, w.n) from walk w join st s on s.path = w.path and s.ov = w.v left join same r on r.path = w.path and r.v = s.v and r.old = w.n left join f g on g.path = w.path and g.v = s.v and g.name = w.n where r.new is not null or g.name is not null),
ends as (select path, v0, n0, arg_max(n, v) as col from walk group by path, v0, n0),
typed as (select e.path, v0, n0, col, t, coalesce(nullif(list_position(['bool', 'i32', 'i64', 'f64', 'str'], t), 0), 5) as k from ends e join f on f.path = e.path and f.v = v0 and f.name = n0),
kinds as (select path, col, max(k) as hi, bool_or(t = 'bool') as b from typed group by path, col)
select t.path, v0 as file_version, n0 as name, t.col as "column", case when b and hi > 1 then 'str' else ['bool', 'i32', 'i64', 'f64', 'str'][hi] end as column_type from typed t join kinds on kinds.path = t.path and kinds.col = t.col"""

_P4 = r"""
with h as (select file_id, max(raw) as raw from csv_records where line_no = 1 group by file_id),
a as (select f.file_id, layout, coalesce(nullif(quote_char, '')[1], '"') as q, delimiter, case layout when 'quoted_fields' then 'name' when 'tabs' then 'file' end as first, case when starts_with(raw, chr(65279)) then raw[2:] else raw end as head from csv_files f left join h on h.file_id = f.file_id),
b as (select *, replace(case when ends_with(head, chr(13)) then head[:-2] else head end, q, '') as bare from a),
d as (select *, coalesce(case when starts_with(bare, first) then nullif(substring(bare, length(first) + 1, 1), '') end, nullif(delimiter, '')[1], ',') as d from b),
e as (select file_id, layout, q, case when bare <> '' then length(bare) - length(replace(bare, d, '')) + 1 when layout = 'quoted_fields' then 3 when layout = 'tabs' then 4 else 1 end as w,
  '\x{' || printf('%x', unicode(d)) || '}' as de, '\x{' || printf('%x', unicode(q)) || '}' as qe from d),
p as (select *, '(?:' || qe || '[^' || qe || ']*(?:' || qe || qe || '[^' || qe || ']*)*' || qe || '|[^' || de || qe || ']*)' as cell, case layout when 'quoted_fields' then [2] when 'tabs' then [2, 3] else []::int[] end as numbers from e),
x as (select distinct r.file_id, r.line_no, r.raw, case when ends_with(r.raw, chr(13)) then r.raw[:-2] else r.raw end as body from csv_records r where r.line_no > 1),
y as (select x.*, p.* exclude (file_id), body is null or p.file_id is null as gone,
  regexp_full_match(body, '(?s)' || cell || '(?:' || de || cell || ')*') as whole, regexp_full_match(body, '(?s)' || cell || '(?:' || de || cell || '){' || (w - 1) || '}') as fits from x left join p on p.file_id = x.file_id),
t as (select *, case when fits then list_transform(range(w), lambda i: regexp_extract(body, '^(?s)(?:' || cell || de || '){' || i || '}(' || cell || ')', 1)) end as cells from y),
u as (select *, list_transform(cells, lambda c: case when starts_with(c, q) then replace(c[2:-2], q || q, q) else c end) as texts from t),
z as (select *, [i for i in numbers if i < w and not (texts[i + 1] = '' or (regexp_full_match(texts[i + 1], '[+-]?[0-9]+') and try_cast(texts[i + 1] as bigint) is not null))] as wrong from u),
told as (select *, case when gone then 'column_count' when not whole then 'quoting' when not fits then 'column_count' when len(wrong) > 0 then 'value' end as reason from z)
"""

ORACLE = {
    "p2_found": _P2 + "select path, v as file_version, name, change from found",
    "p2_columns": _P2_COLUMNS,
    "p4_found": _P4 + "select file_id, line_no, reason from told where reason is not null",
    "p4_loaded": _P4 + "select file_id, line_no, texts[1] as text_1, case when w > 1 then texts[2] else '' end as text_2, case when w > 2 then try_cast(nullif(texts[3], '') as bigint) end as number_1, case when w > 3 then try_cast(nullif(texts[4], '') as bigint) end as number_2 from told where reason is null",
    "p4_broken_field": _P4 + "select file_id, line_no, reason, cast(case when reason = 'value' then wrong[1] + 1 when gone then 1 else 1 + coalesce((select max(k) from unnest(range(1, w + 1)) k(k) where regexp_matches(body, '^(?s)' || cell || '(?:' || de || cell || '){' || (k - 1) || '}(?:' || de || '|\\z)')), 0) end as int) as field_no from told where reason is not null",
    "p1_found": _p1("select diff_id, file, coalesce(label, '') as label, status, field from found"),
    "p1_row_counts": _p1(
        """, k as (select distinct diff_id, file, label, status from found),
        c as (select diff_id, count(*) filter (status = 'added') a, count(*) filter (status = 'removed') r, count(*) filter (status = 'modified') m from k group by diff_id),
        t as (select diff_id, max(row_counts) x from tabular_diffs group by diff_id)
        select t.diff_id, coalesce(a, 0) as added, coalesce(r, 0) as removed, coalesce(m, 0) as modified,
          coalesce(x.added = coalesce(a, 0) and x.removed = coalesce(r, 0) and x.modified = coalesce(m, 0), false) as recorded_ok
        from t left join c on c.diff_id = t.diff_id"""
    ),
    "p5_found": _P5 + "select commit_id, path, status from found",
    "p5_counts": _P5 + "select commit_id, count(*) filter (status = 'added') as added, count(*) filter (status = 'removed') as removed, count(*) filter (status = 'modified') as modified from found group by commit_id",
}
