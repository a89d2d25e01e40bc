"""Further queries of the engine's own operators, over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.media import content_chunks
from quern.operators import diff as D
from quern.operators import graph as G
from quern.operators import options as O
from quern.operators import pipeline as P
from quern.operators import schema as S
from quern.operators import sql as Q
from quern.operators import staged, vectors
from quern.operators import views as V
from quern.operators import workspace as WS
from quern.plans.scratch import cut, scratch_path
from quern.registry.problems import table
from quern.registry.reference import _B, _EDGES, _KEYS, _LATEST, _MEAN, _MERGES, _REACH, _TIPS, _VALUES, _kind_sql, _l, _merges, _r, _SAME
from quern.sources import files, versions
from quern.streaming import reader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def _sql(name: str, text: str, tables: list[str], oracle: str | None = None) -> None:
    """A query over view `df`, the first table, and the others by name; the same text is its own SQL unless another is given."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        first, *rest = (table(spark, d, t) for t in tables)
        return Q.query(first, text, dict(zip(tables[1:], rest)))

    _add(name, run, oracle or f"with df as (select * from {tables[0]}) {text}")


# --- SQL: the analytic dialect, joins, windows, aggregates -----------------------------------------------

_sql("sql_exclude", "select * exclude (o_orderdate, o_orderpriority) from df", ["orders"])
_sql("sql_exclude_bare", "select * exclude o_totalprice from df where o_orderstatus = 'F'", ["orders"])
_sql("sql_qualify", "select o_custkey, o_orderkey, o_totalprice from df qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 2", ["orders"])
_sql("sql_qualify_grouped", "select o_custkey, o_orderstatus, count(*) as n from df where o_totalprice > 50000 group by o_custkey, o_orderstatus having count(*) > 1 qualify rank() over (partition by o_custkey order by count(*) desc, o_orderstatus) = 1", ["orders"])
_sql("sql_distinct_on", "select distinct on (o_custkey) o_custkey, o_orderkey, o_orderdate from df order by o_custkey, o_orderdate desc, o_orderkey", ["orders"])
_sql("sql_unnest", "select commit_id, unnest(parent_ids) as parent from df", ["commits"])
_sql("sql_unnest_lateral", "select df.commit_id, p.parent from df, unnest(parent_ids) p(parent)", ["commits"])
_sql("sql_json_arrow", "select event_id, props->>'$.k' as k, props->>'k' as k2 from df where cast(props->>'$.k' as int) > 40", ["events"])
_sql("sql_list_functions", "select commit_id, list_contains(parent_ids, commit_id) as own, list_distinct(parent_ids) is null as none, list_position(parent_ids, 'x') as at from df", ["commits"],
     "select commit_id, list_contains(parent_ids, commit_id) as own, list_distinct(parent_ids) is null as none, cast(case when parent_ids is not null then coalesce(list_position(parent_ids, 'x'), 0) end as bigint) as at from commits")
_sql("sql_quoted_names", 'select o_orderkey as "the key", "o_orderstatus" as "a ""status""" from df where "o_custkey" < 500', ["orders"])
_sql("sql_join_right", "select s_suppkey, c_custkey, c_name from df right join customer on s_suppkey = c_custkey and s_nationkey = c_nationkey", ["supplier", "customer"])
_sql("sql_join_cross", "select o_orderkey, o_totalprice / m.top as part from df cross join (select max(o_totalprice) as top from df) m", ["orders"], "select o_orderkey, o_totalprice / m.top as part from orders cross join (select max(o_totalprice) as top from orders) m")
_sql("sql_window_ranks", "select o_orderkey, ntile(4) over w as quarter, percent_rank() over w as pr, cume_dist() over w as cd, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) as second from df window w as (partition by o_custkey order by o_totalprice, o_orderkey)", ["orders"],
     "select o_orderkey, cast(ntile(4) over w as int) as quarter, percent_rank() over w as pr, cume_dist() over w as cd, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and unbounded following) as second from orders window w as (partition by o_custkey order by o_totalprice, o_orderkey)")
_sql("sql_window_range", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderdate range between interval 30 days preceding and current row) as month from df", ["orders"])
_sql("sql_window_first_last", "select event_id, first_value(value) over w as f, last_value(value) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as l, round(avg(value) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 following), 6) as a from df window w as (partition by user_id order by ts, event_id)", ["events"])
_sql("sql_approx_distinct", "select o_orderstatus, abs(approx_count_distinct(o_custkey) - count(distinct o_custkey)) <= 0.15 * count(distinct o_custkey) as near from df group by o_orderstatus", ["orders"])
_sql("sql_describe_count", "select count(*) as n, count(distinct o_orderstatus) as kinds, min(o_orderdate) as first, max(o_orderdate) as last from df", ["orders"])
_sql("sql_normalised", "select /* all ; of it */ o_orderkey -- the key ;\n from df where o_orderstatus = 'P' and o_orderpriority <> 'a;b' ; -- end\n ;", ["orders"], "select o_orderkey from orders where o_orderstatus = 'P' and o_orderpriority <> 'a;b'")
_add("preview", lambda s, d: V.preview(Q.query(table(s, d, "orders"), "select o_orderkey, o_orderdate from df order by o_orderkey")), "select o_orderkey, o_orderdate from orders order by o_orderkey limit 10")

# --- predicates and similarity -----------------------------------------------------------------------------

_PREDICATE = "label = 3 and df.vec_id % 2 = 0 and not (vec_id in (4, 8))"
_e = lambda s, d: table(s, d, "embeddings")
_add("where_checked", lambda s, d: vectors.checked(_e(s, d), _PREDICATE).select("vec_id", "label"), "select vec_id, label from embeddings where label = 3 and vec_id % 2 = 0 and not (vec_id in (4, 8))")
_SIMILAR = "select vec_id, label, round(list_cosine_similarity(embedding::double[], v), 4) as similarity from embeddings, m"
_top = lambda df: df.select("vec_id", "label", F.round("similarity", 4).alias("similarity"))
_add("search_by_predicate", lambda s, d: _top(vectors.search(_e(s, d), where=_PREDICATE, column="embedding", page=2, page_size=15, ties=["vec_id"])),
     f"with {_MEAN.format(w='label = 3 and vec_id % 2 = 0 and not (vec_id in (4, 8))')} {_SIMILAR} order by list_cosine_similarity(embedding::double[], v) desc, vec_id limit 15 offset 15")
_add("search_by_sql", lambda s, d: vectors.search(_e(s, d), sql="select vec_id, label from df where label > 2 order by vec_id", page=3, page_size=20), "select vec_id, label from embeddings where label > 2 order by vec_id limit 20 offset 40")


def _export(s: SparkSession, df: DataFrame, ext: str, **shown) -> DataFrame:
    """What an export wrote, read again."""
    return files.read_df(s, files.write_df(WS.exported(df, **shown), scratch_path(s, "export") + f".{ext}"))


_add("export_similarity", lambda s, d: _export(s, _top(vectors.similarity_to(_e(s, d), "embedding", vectors.mean_vector(_e(s, d), "embedding", "label = 1") or [])).withColumn("_row_id", F.lit("x")), "parquet"), f"with {_MEAN.format(w='label = 1')} {_SIMILAR}")
_add("export_sql", lambda s, d: _export(s, Q.export_guard(Q.query(table(s, d, "orders").withColumn("_row_ord", F.lit(1)), "select * from df where o_orderstatus <> 'P'")), "jsonl").select("o_orderkey", "o_totalprice", "o_orderstatus"), "select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus <> 'P'")
_add("export_table", lambda s, d: _export(s, table(s, d, "customer").withColumn("_row_id", F.lit(1)), "csv", columns=["c_custkey", "C_NAME", "c_acctbal"]), "select c_custkey, c_name, c_acctbal from customer")
_add("export_json_tolerant", lambda s, d: WS.exported(table(s, d, "events").withColumn("props", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('say "'), F.col("event_type"))).otherwise(F.col("props"))), ["event_id", "props"], ["props"]),
     "select event_id, case when event_id % 3 = 0 then cast(to_json('say \"' || event_type) as varchar) else props end as props from events")
_add("embedding_states", lambda s, d: vectors.index_states(table(s, d, "embeddings")), "select 'embedding' as column, cast(max(len(embedding)) as int) as length, case when max(len(embedding)) = min(len(embedding)) then 'complete' else 'failed' end as status from embeddings")
_add("embedding_states_ragged", lambda s, d: vectors.index_states(table(s, d, "prompt_embeddings")), "select 'embedding' as column, case when max(len(embedding)) = min(len(embedding)) then cast(max(len(embedding)) as int) end as length, case when max(len(embedding)) = min(len(embedding)) then 'complete' else 'failed' end as status from prompt_embeddings")

# --- columns, rows, options ----------------------------------------------------------------------------------

_add("strip_reserved", lambda s, d: P.strip_reserved(table(s, d, "orders").withColumns({"_row_id": F.lit("x"), "_row_num": F.lit(1), "_row_hash": F.lit(2)})), "select * from orders")
_add("canonical_columns", lambda s, d: P.project(table(s, d, "orders"), ["O_ORDERKEY", "o_TotalPrice"]), "select o_orderkey, o_totalprice from orders")
_add("options_echo", lambda s, d: s.createDataFrame([(n, str(v)) for n, v in O.Options(filter="a == 1", sort="b", reverse=True, page=2, page_size=5).applied()], "name string, value string"), "select * from (values ('filter', 'a == 1'), ('sort', 'b'), ('reverse', 'True'), ('page', '2'), ('page_size', '5')) t(name, value)")
_add("literal_types", lambda s, d: P.run_pipeline(table(s, d, "lineitem"), O.Options(filter="l_shipdate >= 1995-06-01 && l_linenumber == 3 && l_discount <= 0.05 && l_returnflag != R")), "select * from lineitem where l_shipdate >= timestamp '1995-06-01' and l_linenumber = 3 and l_discount <= 0.05 and l_returnflag <> 'R'")
_add("copy_numbered", lambda s, d: V.copy_table(table(s, d, "part").orderBy("p_partkey"), numbered=True), "select *, row_number() over (order by p_partkey) - 1 as _row_num from part")
_add("deep_slice", lambda s, d: P._between(table(s, d, "lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), 3000, 3040), "select * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice limit 40 offset 3000")
_add("render_hints", lambda s, d: s.createDataFrame([(k, str(S.fields_of(S.render_hint(table(s, d, "commit_entries").select(F.col("path").alias("file_path")), k))[0]["metadata"])) for k in ("image", "video", "audio", "tabular")], "kind string, hint string"),
     "select kind, case when kind = 'tabular' then 'None' else replace('{~render~: {~func~: ~' || kind || '~}}', '~', chr(39)) end as hint from (values ('image'), ('video'), ('audio'), ('tabular')) t(kind)")

# --- diffs ------------------------------------------------------------------------------------------------------


def _view(s: SparkSession, d: str) -> DataFrame:
    parts = V.view_diff(_l(s, d).drop("contributor"), _r(s, d).drop("added_at"))
    counts = [df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns")) for name, df in sorted(parts.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


_COMMON = ", ".join(c for c in [*_KEYS, *_VALUES] if c not in ("contributor", "added_at"))
_NOT_IN = lambda a, b: f"select count(*) from (select distinct {_B.replace(', added_at', '') if a == 'boxes_right' else _B.replace(', contributor', '')} from {a} x where not exists (select 1 from {b} y where " + " and ".join(f"x.{c} is not distinct from y.{c}" for c in _COMMON.split(", ")) + "))"
_add("view_diff", _view, f"select 'added_cols' as part, count(*) as rows, cast(1 as bigint) as columns from boxes_right union all select 'added_rows', ({_NOT_IN('boxes_right', 'boxes_left')}), 8 union all select 'removed_cols', (select count(*) from boxes_left), 1 union all select 'removed_rows', ({_NOT_IN('boxes_left', 'boxes_right')}), 8")
_FULL_DIFF = lambda s, d: D.diff(_l(s, d).distinct(), _r(s, d).distinct(), _KEYS, ["width", "height"], None, ordered=False)
_KEYED = f"with l as (select distinct {_B}, true as inl from boxes_left), r as (select distinct {_B}, true as inr from boxes_right), j as (select inl, inr, {', '.join(f'l.{c} as l_{c}, r.{c} as r_{c}' for c in _VALUES)}, {', '.join(f'case when r.inr then r.{k} else l.{k} end as k_{k}' for k in _KEYS)} from l full join r on {_SAME}), x as (select *, case when inl is null then 'added' when inr is null then 'removed' when l_width is distinct from r_width or l_height is distinct from r_height then 'modified' else 'unchanged' end as st from j)"
_add("diff_display_all", lambda s, d: _FULL_DIFF(s, d).contents, _KEYED + f" select {', '.join(f'k_{k} as {k}' for k in _KEYS)}, " + ", ".join(f'l_{c} as "{c}.left", r_{c} as "{c}.right"' for c in _VALUES) + ", st as _diff_status from x where st <> 'unchanged'")
_add("diff_pipeline", lambda s, d: V.diff_frame(D.diff(_l(s, d).distinct(), _r(s, d).distinct(), _KEYS, ["width", "height"]), O.Options(filter="_diff_status == modified", unique_count="filename", sort="filename")), _KEYED + " select k_filename as filename, count(*) as count from x where st = 'modified' group by 1")
_add("diff_schemas", lambda s, d: s.createDataFrame([(side, f["name"], f["dtype"]) for side, fs in _FULL_DIFF(s, d).schemas().items() if side != "diff" for f in fs], "side string, name string, dtype string"),
     "with k as (select column_name as name, case column_type when 'BIGINT' then 'i64' when 'DOUBLE' then 'f64' when 'VARCHAR' then 'str' else 'datetime' end as dtype from (describe boxes_left)) select 'left' as side, * from k union all select 'right', * from k")


def _cached(s: SparkSession, d: str) -> DataFrame:
    """A diff by its versions, the second time from the cache."""
    folder = scratch_path(s, "diffs")
    run = lambda: versions.cached_diff(_l(s, d).distinct(), _r(s, d).distinct(), ("v1", "v2"), folder, keys=tuple(_KEYS), targets=("width",))
    run()
    again, made = run()
    assert made is None
    return again


_add("diff_cached", _cached, _KEYED.replace(" or l_height is distinct from r_height", "") + f""" select {', '.join(f'k_{k} as {k}' for k in _KEYS)}, l_width as "width.left", r_width as "width.right", st as _diff_status from x where st <> 'unchanged'""")
_add("text_diff_changes", lambda s, d: D.text_diff(table(s, d, "llm_fine_tune").where(~F.coalesce(F.col("context"), F.lit("")).rlike("[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]") & ~F.coalesce(F.col("response"), F.lit("")).rlike("[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]")).select("pair_id", "context", "response").distinct(), "pair_id", "context", "response"),
     "with t as (select distinct pair_id, coalesce(context, '') as a, coalesce(response, '') as b from llm_fine_tune where not regexp_matches(coalesce(context, ''), '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') and not regexp_matches(coalesce(response, ''), '[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')), "
     "u as (select * from t where a <> b) select pair_id, cast(0 as int) as line_no, 'removed' as change, a as text from u where a <> '' union all select pair_id, cast(case when a <> '' then 1 else 0 end as int), 'added', b from u where b <> ''")  # fmt: skip

# --- version graph -----------------------------------------------------------------------------------------------

_c = lambda s, d: table(s, d, "commits")
_heads = lambda s, d: G.tips(_c(s, d)).select(F.col("commit_id").alias("head"))
_WHEN = "tm as (select commit_id, max(committed_at) as t from commits group by 1)"
_WALK = f"with recursive {_EDGES}, {_TIPS}, {_MERGES}, heads as (select commit_id as h from tips union select base from mg union select head from mg), {_REACH}, {_WHEN}"
_add("history", lambda s, d: G.history(_c(s, d), G.edges_of(_c(s, d)), _heads(s, d)), f"{_WALK} select head, commit_id, cast(row_number() over (partition by head order by t desc nulls last, commit_id) - 1 as int) as position from reach left join tm using (commit_id) where head in (select commit_id from tips)")
_add("history_stop_at_base", lambda s, d: G.history(_c(s, d), G.edges_of(_c(s, d)), _merges(s, d).select("head"), _merges(s, d).select("head", "base").distinct()),
     f"{_WALK} select head, commit_id, cast(row_number() over (partition by head order by t desc nulls last, commit_id) - 1 as int) as position from reach r left join tm using (commit_id) where head in (select head from mg) and not exists (select 1 from mg join reach b on b.head = mg.base where mg.head = r.head and b.commit_id = r.commit_id)")
_add("first_parent_page", lambda s, d: G.first_parent_page(_c(s, d), _heads(s, d), 1, 3),
     f"with recursive {_EDGES}, {_TIPS}, fp as (select distinct commit_id as child, parent_ids[1] as parent from commits where parent_ids[1] is not null), walk(head, commit_id, depth) as (select commit_id, commit_id, 0 from tips union select w.head, f.parent, w.depth + 1 from walk w join fp f on f.child = w.commit_id) select head, commit_id, cast(depth as int) as depth from walk where depth between 1 and 3")


def _reach(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = _merges(s, d).select("base", "head").distinct()
    return cut(G.ancestors(G.edges_of(_c(s, d)), pairs.select(F.col("base").alias("head")).union(pairs.select("head")))), pairs


_add("symmetric_commits", lambda s, d: G.symmetric_many(*_reach(s, d)),
     f"{_WALK}, p as (select distinct base, head from mg) select p.base, p.head, r.commit_id, 'base' as side from p join reach r on r.head = p.base where not exists (select 1 from reach q where q.head = p.head and q.commit_id = r.commit_id) union all select p.base, p.head, r.commit_id, 'head' from p join reach r on r.head = p.head where not exists (select 1 from reach q where q.head = p.base and q.commit_id = r.commit_id)")
_add("fast_forwards", lambda s, d: G.fast_forwards(*_reach(s, d)), f"{_WALK} select distinct base, head, exists (select 1 from reach r where r.head = mg.head and r.commit_id = mg.base) as fast_forward from mg")
_latest = lambda s, d: G.latest_entries(table(s, d, "commit_entries"))
_LIST = f"with {_LATEST}, p as (select commit_id, num_bytes, string_split(path, '/') as a from e), x as (select commit_id, array_to_string(a[1:i], '/') as path, i < len(a) as is_dir, i as depth, num_bytes from p, unnest(range(1, least(len(a), 2) + 1)) t(i)), g as (select commit_id, path, is_dir, cast(depth as int) as depth, count(*) as files, cast(coalesce(sum(num_bytes), 0) as bigint) as bytes from x group by all)"
_add("listing_depth", lambda s, d: G.listing(_latest(s, d), "", 2), f"{_LIST} select * from g")
_add("listing_page", lambda s, d: G.paged_listing(G.listing(_latest(s, d)), 2, 5, "bytes", True),
     f"{_LIST}, o as (select commit_id, path, is_dir, depth, files, bytes, cast(row_number() over (partition by commit_id order by is_dir desc, bytes desc nulls last, path) - 1 as int) as position, cast(ceil(count(*) over (partition by commit_id) / 5.0) as int) as pages from g where depth = 1) select * from o where position >= 5 and position < 10")


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Manifests of the first parents and of their children, both under the child's id."""
    e = cut(_latest(s, d).select("commit_id", "path", "hash"))
    links = G.first_parent_edges(_c(s, d)).select(F.col("child").alias("commit_id"), F.col("parent").alias("__of"))
    old = e.withColumnRenamed("commit_id", "__of").join(links, "__of").select("commit_id", "path", "hash")
    return old, e.join(links, "commit_id", "left_semi")


_add("dir_diff", lambda s, d: G.dir_diff(*_sides(s, d)),
     f"with {_LATEST}, fp as (select distinct commit_id, parent_ids[1] as par from commits where parent_ids[1] is not null), n as (select commit_id, path, hash from e where commit_id in (select commit_id from fp)), o as (select fp.commit_id, e.path, e.hash from fp join e on e.commit_id = fp.par), "
     "u as (select 1 as side, * from n union all select 0, * from o), x as (select side, commit_id, path, hash, array_to_string(a[1:i], '/') as dir from (select *, string_split(path, '/') as a from u), unnest(range(0, len(a))) t(i)), "
     "g as (select commit_id, dir, list(row(path, hash) order by path, hash) filter (side = 0) as a, list(row(path, hash) order by path, hash) filter (side = 1) as b from x group by all) select commit_id, dir, case when a is null then 'added' when b is null then 'removed' else 'modified' end as status from g where a is distinct from b")  # fmt: skip
_add("schemas_of_versions", lambda s, d: G.schemas_of(table(s, d, "schema_fields"), table(s, d, "schema_fields").groupBy("path").agg(F.max("file_version").alias("file_version"))),
     "with f as (select path, file_version, name, field_no, case dtype when 'int64' then 'i64' when 'int32' then 'i32' when 'float64' then 'f64' when 'string' then 'str' when 'boolean' then 'bool' else coalesce(dtype, '?') end as t from (select *, row_number() over (partition by path, file_version, name order by committed_at desc nulls last, field_no desc nulls last, dtype desc nulls last) as k from schema_fields where name is not null) where k = 1) "
     "select path, file_version, string_agg(name || ':' || t, ',' order by field_no nulls first, name, t) as schema from f where (path, file_version) in (select path, max(file_version) from schema_fields group by path) group by all")  # fmt: skip
_add("tabular_files", lambda s, d: _latest(s, d).where(G.data_type(F.col("path")) == "tabular").select("commit_id", "path"), f"with {_LATEST} select commit_id, path from e where {_kind_sql('path')} = 'tabular'")
_add("content_chunks_cover", lambda s, d: content_chunks(table(s, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.sum("bytes").cast("long").alias("bytes"), (F.max("no") + 1 == F.count(F.lit(1))).alias("gapless")), "select doc_id, cast(octet_length(encode(text)) as bigint) as bytes, true as gapless from documents where text <> ''")

# --- staged tables and workspaces -----------------------------------------------------------------------------------


def _edited(s: SparkSession, d: str) -> DataFrame:
    """Many updates at once, columns added, renamed, retyped and dropped, edits folded in."""
    t = staged.StagedTable.index(table(s, d, "customer").orderBy("c_custkey"), scratch_path(s, "staged"))
    ids = [r["_row_id"] for r in t.rows().where("c_custkey in (1, 2, 3)").orderBy("c_custkey").select("_row_id").collect()]
    t.update_many([(ids[0], {"c_name": None}), (ids[1], {"c_acctbal": 0.5, "c_name": "two"})])
    t.delete(ids[2])
    t.append({"c_custkey": -5, "c_name": "last"})
    t.add_column("extra", "i32")
    t.rename_column("c_mktsegment", "segment")
    t.retype_column("c_custkey", "str")
    t.drop_column("c_nationkey")
    t.reindex()
    return t.ordered()


_add("staged_columns_cycle", _edited, "select cast(c_custkey as varchar) as c_custkey, case c_custkey when 1 then null when 2 then 'two' else c_name end as c_name, case when c_custkey = 2 then 0.5 else c_acctbal end as c_acctbal, c_mktsegment as segment, cast(null as int) as extra from customer where c_custkey <> 3 union all select '-5', 'last', null, null, null")


def _manifest(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("c1", "orders.parquet", "h1"), ("c1", "notes.txt", "h2"), ("c1", "part.csv", "h3")], "commit_id string, path string, hash string")


def _committed(s: SparkSession, d: str) -> DataFrame:
    """A table staged, edited, renamed and committed, read again by its version."""
    w = WS.Workspace(s, scratch_path(s, "workspace"), "c1")
    t = w.stage("orders.parquet", table(s, d, "orders").orderBy("o_orderkey"))
    t.append({"o_orderkey": -1, "o_orderstatus": "N"})
    w.rename("orders.parquet", "all/orders.jsonl")
    store = scratch_path(s, "store")
    made = w.commit(_manifest(s), "c1", "c2", store)
    return versions.read_version(s, made, store, "c2", "all/orders.jsonl").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


_add("workspace_commit", _committed, "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders union all select -1, null, 'N', null")


def _manifest_after(s: SparkSession, d: str) -> DataFrame:
    w = WS.Workspace(s, scratch_path(s, "workspace"), "c1")
    w.insert("new/rows.csv", {"k": 1})
    w.stage("part.csv", table(s, d, "part"))
    listed = w.listed(_manifest(s), "c1").select("path", F.lit("c1").alias("commit_id"), "is_indexed")
    made = w.commit(_manifest(s), "c1", "c2", scratch_path(s, "store"))
    return listed.union(made.select("path", "commit_id", F.length("hash") > 2))


_add("workspace_manifest", _manifest_after, "select * from (values ('orders.parquet', 'c1', false), ('part.csv', 'c1', true), ('orders.parquet', 'c2', false), ('notes.txt', 'c2', false), ('part.csv', 'c2', true), ('new/rows.csv', 'c2', true)) t(path, commit_id, is_indexed)")

# --- sources and sinks ------------------------------------------------------------------------------------------------

_DOCS = ["doc_id", "text", "lang", "source", "n_chars", "repo"]


def _trip(ext: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        df = table(s, d, "documents").select(*_DOCS)
        return files.read_df(s, files.write_df(df, scratch_path(s, "trip") + f".{ext}")).select(*_DOCS)

    return run


# whole texts with quotes, line breaks, odd characters and nulls, through every format
for _ext in ("csv", "tsv", "json", "jsonl", "parquet", "arrow"):
    _add(f"documents_roundtrip_{_ext}", _trip(_ext), f"select {', '.join(_DOCS)} from documents")


def _sniffed(s: SparkSession, d: str) -> DataFrame:
    """Text with another delimiter, quotes where needed, read by its looks."""
    path = scratch_path(s, "sniff") + ".csv"
    table(s, d, "part").coalesce(1).write.options(header=True, sep=";").csv(path)
    return files.read_df(s, path)


_add("csv_sniffed", _sniffed, "select p_partkey, p_name, p_brand, p_type, cast(p_size as bigint) as p_size, p_retailprice from part")


def _capped(s: SparkSession, d: str) -> DataFrame:
    path = files.write_df(table(s, d, "customer").orderBy("c_custkey"), scratch_path(s, "capped") + ".csv")
    return files.read_df(s, path, rows=50)


_add("scan_capped", _capped, "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer order by c_custkey limit 50")


def _folder(s: SparkSession, d: str) -> DataFrame:
    """A folder of files of several formats as one data set, by its listing and through the loader."""
    folder = scratch_path(s, "folder")
    df = table(s, d, "events").select("event_id", "value")
    for name, part in (("a.csv", "event_id % 3 = 0"), ("b.jsonl", "event_id % 3 = 1"), ("c.parquet", "event_id % 3 = 2")):
        files.write_df(df.where(part), f"{folder}/{name}")
    data = reader.load_dataset(s, folder, ["event_id", "value"])
    assert sorted(r["file_path"] for r in files.listing(s, folder).collect() if not r["file_path"].startswith(".")) == ["a.csv", "b.jsonl", "c.parquet"]
    return data.slice(0, len(data))


_add("dataset_folder", _folder, "select event_id, value from events")
_add("parsed_json_rows", lambda s, d: files.parse_json_rows(s, "\n".join(r[0] for r in files.json_view(table(s, d, "supplier")).collect()), table(s, d, "supplier").schema), "select * from supplier")

# --- streams ----------------------------------------------------------------------------------------------------------


def _events(s: SparkSession, d: str) -> DataFrame:
    return s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)


_HOP = "unnest(range(0, 4)) k(k)"
_add("event_windows_sliding", lambda s, d: reader.windowed_counts(table(s, d, "events"), "ts", "1 hour", "event_type", slide="15 minutes"),
     f"select time_bucket(interval 15 minutes, ts) - k.k * interval 15 minutes as window_start, event_type, count(*) as n from events, {_HOP} group by 1, 2")


def _stream_join(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    clicks, buys = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = reader.joined_streams(clicks, buys, "user_id", "ts", "2 hours").select("event_id", "event_id_right", "user_id")
    return reader.run_to_files(out, scratch_path(s, "join-out"), scratch_path(s, "join"))


_add("stream_join", _stream_join, "select a.event_id, b.event_id as event_id_right, a.user_id from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 2 hours")
_add("stream_first_events", lambda s, d: reader.run_to_files(reader.first_events(_events(s, d).select("user_id", "ts"), "user_id", "ts", "400 days").select("user_id"), scratch_path(s, "first-out"), scratch_path(s, "first")), "select distinct user_id from events")
