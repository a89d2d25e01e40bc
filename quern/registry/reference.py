"""Queries of the engine's own operators, over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.filters import apply_filter
from quern.operators import diff as D
from quern.operators import graph as G
from quern.operators import pipeline as P
from quern.operators import schema as S
from quern.operators import sql as Q
from quern.operators import staged, vectors
from quern.operators import views as V
from quern.operators.options import Options
from quern.operators.ordinal import with_ordinal
from quern.registry.problems import table
from quern.sources import files
from quern.streaming import reader

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def _pipe(name: str, of: str, opts: dict, sql: str | None, columns: list[str] | None = None) -> None:
    """A pipeline over one table (or some columns of it)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, of)
        return P.run_pipeline(df.select(*columns) if columns else df, Options(**opts), lambda s, p: table(s, d, p))

    _add(name, run, sql)


def _sql(name: str, text: str, tables: list[str], oracle: str | None = None) -> None:
    """A query over view `df`, the first table, and the others by name."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        first, *rest = (table(spark, d, t) for t in tables)
        return Q.query(first, text, dict(zip(tables[1:], rest)))

    _add(name, run, oracle or f"with df as (select * from {tables[0]}) {text}")


# --- projection, columns, rows --------------------------------------------------------------------

_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_pipe("project_columns", "orders", {"columns": "o_totalprice,o_orderkey"}, "select o_totalprice, o_orderkey from orders")
_pipe("rename_column", "orders", {"rename": "o_orderstatus:status"}, f"select {', '.join(_ORDERS).replace('o_orderstatus', 'o_orderstatus as status')} from orders", _ORDERS)
_pipe("add_constant_column", "orders", {"add_col": "batch:7:i64", "add_col_at": 1}, f"select {', '.join(_ORDERS)}, cast(7 as bigint) as batch from orders", _ORDERS)
_pipe("add_row", "customer", {"add_row": "-1,Nobody,0,1.5,NONE"}, "select * from customer union all select -1, 'Nobody', 0, 1.5, 'NONE'")
_pipe("add_row_json", "region", {"add_row": '{"r_name": "NOWHERE"}'}, "select r_regionkey, r_name from region union all select null, 'NOWHERE'")
_pipe("vstack", "orders", {"vstack": ["orders"]}, "select * from orders union all select * from orders")
_pipe("pipeline_order", "orders", {"sort": "o_orderkey", "reverse": True, "columns": "o_orderkey,o_totalprice", "rename": "o_totalprice:price", "filter": "o_orderstatus == F", "add_col": "src:a:str", "head": 25},
      "select o_orderkey, o_totalprice as price from orders where o_orderstatus = 'F' order by o_orderkey desc limit 25")
_add("row_number_column", lambda s, d: with_ordinal(table(s, d, "orders"), order=["o_orderkey"]), "select *, row_number() over (order by o_orderkey) - 1 as _row_num from orders")
_add("row_hash_dupes", lambda s, d: P.row_hash(table(s, d, "documents"), ["text"]).groupBy("_row_hash").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups")), "select n, count(*) as groups from (select count(*) as n from documents group by text) group by n")
_add("item_cell", lambda s, d: P.item(table(s, d, "part").orderBy("p_partkey"), "p_name", 12), "select p_name from part order by p_partkey offset 12 limit 1")
_add("row_by_index", lambda s, d: P.run_pipeline(table(s, d, "part"), Options(sort="p_partkey", row=17)), "select * from part order by p_partkey offset 17 limit 1")
_add("text_metadata", lambda s, d: V.text_metadata(table(s, d, "documents"), "doc_id", "text"),
     "select doc_id, cast(len(string_split(text, chr(10))) as bigint) as lines, cast(length(text) as bigint) as chars from documents where text is not null")
_add("table_size", lambda s, d: V.table_size(table(s, d, "lineitem")), "select (select count(*) from pragma_table_info('lineitem')) as width, count(*) as height from lineitem")

# --- filters ----------------------------------------------------------------------------------------

_pipe("filter_eq", "orders", {"filter": "o_orderstatus == F"}, f"select {', '.join(_ORDERS)} from orders where o_orderstatus = 'F'", _ORDERS)
_pipe("filter_and_or_left_assoc", "orders", {"filter": "o_orderstatus == F || o_totalprice > 250000 && o_custkey < 500"}, f"select {', '.join(_ORDERS)} from orders where (o_orderstatus = 'F' or o_totalprice > 250000) and o_custkey < 500", _ORDERS)
_pipe("filter_or_after_and", "orders", {"filter": "o_orderstatus == F && o_custkey >= 100 || o_orderpriority == 5-LOW"}, f"select {', '.join(_ORDERS)} from orders where (o_orderstatus = 'F' and o_custkey >= 100) or o_orderpriority = '5-LOW'", _ORDERS)
_pipe("filter_neq_null", "documents", {"filter": "lang != en", "columns": "doc_id,lang,source"}, "select doc_id, lang, source from documents where lang <> 'en'")
_pipe("event_counts", "events", {"filter": "value > 10.0 && event_type != error", "unique_count": "event_type", "sort": "event_type"}, "select event_type, count(*) as count from events where value > 10.0 and event_type <> 'error' group by event_type")
_add("where_dict", lambda s, d: Q.where(table(s, d, "orders").select(*_ORDERS), {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}), f"select {', '.join(_ORDERS)} from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT'")
_add("count_where", lambda s, d: Q.total(Q.where(table(s, d, "orders"), {"o_orderstatus": "O", "o_custkey": 5}, "or")), "select count(*) as count from orders where o_orderstatus = 'O' or o_custkey = 5")
_add("glob_paths", lambda s, d: G.match_paths(table(s, d, "commit_entries"), "{images,masks}/**/*_[0-9]*.p?g").select("path").distinct(), r"select distinct path from commit_entries where regexp_full_match(path, '(images|masks)/([^/]+/)*[^/]*_[0-9][^/]*\.p[^/]g')")

# --- order, pages, samples --------------------------------------------------------------------------

_pipe("sort_page", "orders", {"sort": "o_orderkey", "page": 3, "page_size": 40}, f"select {', '.join(_ORDERS)} from orders order by o_orderkey offset 80 limit 40", _ORDERS)
_pipe("slice_rows", "orders", {"sort": "o_orderkey", "slice": "100..130"}, f"select {', '.join(_ORDERS)} from orders order by o_orderkey offset 100 limit 30", _ORDERS)
_pipe("reverse_page", "orders", {"sort": "o_orderkey", "reverse": True, "page": 1, "page_size": 20}, f"select {', '.join(_ORDERS)} from orders order by o_orderkey desc limit 20", _ORDERS)
_pipe("head", "events", {"sort": "event_id", "head": 15}, "select * from events order by event_id limit 15")
_add("tail", lambda s, d: P.tail_rows(table(s, d, "orders").select(*_ORDERS).orderBy("o_orderkey"), 12), f"select {', '.join(_ORDERS)} from orders order by o_orderkey desc limit 12")
_add("reverse_rows", lambda s, d: with_ordinal(P.reverse_rows(table(s, d, "orders").orderBy("o_orderkey"))), "select *, row_number() over (order by o_orderkey desc) - 1 as _row_num from orders")
_add("take_rows", lambda s, d: P.take_rows(table(s, d, "part"), [5, 3, 3, 70], order=["p_partkey"]),
     "with n as (select *, row_number() over (order by p_partkey) - 1 as i from part) select n.* exclude (i) from n join (values (5), (3), (3), (70)) t(i) on n.i = t.i")
# all rows are there, and their order is another one than before
_add("randomize", lambda s, d: with_ordinal(P.randomize(table(s, d, "orders").orderBy("o_orderkey"), seed=4)).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys"), F.sum("o_orderkey").alias("sum"), (F.count_if(F.col("o_orderkey") == F.col("_row_num") + 1) < F.count(F.lit(1)) / 2).alias("moved")), "select count(*) as rows, count(distinct o_orderkey) as keys, cast(sum(o_orderkey) as bigint) as sum, count(*) > 0 as moved from orders")
_add("newest_first", lambda s, d: G.newest_first(table(s, d, "commits")),
     "select repo, branch, commit_id, cast(row_number() over (partition by repo, branch order by committed_at desc nulls last, commit_id) as int) as position from (select commit_id, max(repo) repo, max(branch) branch, max(committed_at) committed_at from commits group by commit_id)")

# --- distinct, counts, roll-ups -----------------------------------------------------------------------

_add("unique_keep_first", lambda s, d: P.unique(table(s, d, "events"), ["event_type"], order=["event_id"]), "select * exclude (k) from (select *, row_number() over (partition by event_type order by event_id) k from events) where k = 1")
_add("unique_multi", lambda s, d: P.unique(table(s, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], order=["doc_id"]), "select doc_id, lang, source from (select doc_id, lang, source, row_number() over (partition by lang, source order by doc_id) k from documents) where k = 1")
_pipe("unique_count", "events", {"unique_count": "event_type"}, "select event_type, count(*) as count from events group by event_type")
_pipe("unique_count_multi", "documents", {"unique_count": "lang,source"}, "select lang, source, count(*) as count from documents group by lang, source")
_add("n_duped_rows", lambda s, d: P.duplicated_rows(table(s, d, "documents"), ["text"]), "select cast(coalesce(sum(n), 0) as bigint) as n_duped_rows from (select count(*) n from documents group by text) where n > 1")
_add("uniform_media_type", lambda s, d: G.uniform_type(table(s, d, "commit_entries")).groupBy("uniform").agg(F.count(F.lit(1)).alias("n")), None)


def _kind_sql(path: str) -> str:
    ext = f"lower(regexp_extract({path}, '\\.([^./]+)$', 1))"
    return "case " + " ".join(f"when {ext} in ({', '.join(repr(x) for x in exts)}) then '{kind}'" for kind, exts in G.KINDS.items()) + " else 'binary' end"


_LATEST = "e as (select commit_id, path, hash, num_bytes from (select commit_id, path, lower(hash) hash, num_bytes, row_number() over (partition by commit_id, path order by received_at desc nulls last, lower(hash) desc nulls last, num_bytes desc nulls last) k from commit_entries) where k = 1)"
ORACLE["uniform_media_type"] = f"select uniform, count(*) as n from (select commit_id, count(distinct {_kind_sql('path')}) = 1 as uniform from commit_entries group by commit_id) group by uniform"
_add("dir_rollup", lambda s, d: G.dir_rollup(G.latest_entries(table(s, d, "commit_entries"))),
     f"with {_LATEST}, p as (select commit_id, path, num_bytes, string_split(path, '/') a from e), x as (select commit_id, path, num_bytes, array_to_string(a[1:i], '/') as dir from p, unnest(range(0, len(a))) t(i)) select commit_id, dir, {_kind_sql('path')} as data_type, count(*) as files, cast(coalesce(sum(num_bytes), 0) as bigint) as bytes from x group by all")
_add("dir_children", lambda s, d: G.children(G.latest_entries(table(s, d, "commit_entries")), ""),
     f"with {_LATEST} select commit_id, split_part(path, '/', 1) as name, contains(path, '/') as is_dir, count(*) as files, cast(coalesce(sum(num_bytes), 0) as bigint) as bytes from e group by all")
_add("repo_stats", lambda s, d: G.type_totals(table(s, d, "commit_entries").dropDuplicates(), "repo"),
     f"select repo, {_kind_sql('path')} as data_type, count(*) as files, cast(coalesce(sum(num_bytes), 0) as bigint) as bytes from (select distinct * from commit_entries) group by all")
_add("bucket_sizes", lambda s, d: G.bucketed(G.latest_entries(table(s, d, "commit_entries")), 16).groupBy("commit_id").agg(F.count(F.lit(1)).alias("files"), (F.max("bucket") < F.ceil(F.count(F.lit(1)) / 16)).alias("in_range")),
     f"with {_LATEST} select commit_id, count(*) as files, count(*) > 0 as in_range from e group by commit_id")
_add("missing_hashes", lambda s, d: G.unreachable(G.latest_entries(table(s, d, "commit_entries")), G.latest_entries(table(s, d, "commit_entries")), G.tips(table(s, d, "commits"))),
     f"with {_LATEST}, par as (select distinct unnest(parent_ids) p from commits), tips as (select distinct commit_id from commits where commit_id not in (select p from par where p is not null)), used as (select hash from e where commit_id in (select commit_id from tips)) select distinct hash from e where hash is not null and hash not in (select hash from used where hash is not null)")
_add("text_chunks", lambda s, d: G.chunks(table(s, d, "documents"), "doc_id", "text", 256).groupBy("digest").agg(F.count(F.lit(1)).alias("n")),
     "select sha256(substring(text, cast(i * 256 + 1 as bigint), 256)) as digest, count(*) as n from documents, unnest(range(0, cast(ceil(length(text) / 256.0) as bigint))) t(i) where text is not null group by 1")

# --- set operations and diffs ---------------------------------------------------------------------------

_BOX = ["filename", "file", "label", "min_x", "min_y", "width", "height", "contributor", "added_at"]
_l = lambda s, d: table(s, d, "boxes_left").select(*_BOX)
_r = lambda s, d: table(s, d, "boxes_right").select(*_BOX)
_B = ", ".join(_BOX)
_add("rows_added", lambda s, d: D.rows_added(_l(s, d), _r(s, d)), f"select {_B} from boxes_right except select {_B} from boxes_left")
_add("rows_removed", lambda s, d: D.rows_removed(_l(s, d), _r(s, d)), f"select {_B} from boxes_left except select {_B} from boxes_right")
_add("rows_added_common_cols", lambda s, d: D.rows_added(_l(s, d).drop("contributor"), _r(s, d)),
     f"select distinct {_B} from boxes_right r where not exists (select 1 from boxes_left l where l.filename is not distinct from r.filename and l.file is not distinct from r.file and l.label is not distinct from r.label and l.min_x is not distinct from r.min_x and l.min_y is not distinct from r.min_y and l.width is not distinct from r.width and l.height is not distinct from r.height and l.added_at is not distinct from r.added_at)")
_add("columns_added", lambda s, d: D.columns_added(_l(s, d).drop("contributor"), _r(s, d)), "select contributor from boxes_right")
_add("schema_diff_columns", lambda s, d: s.createDataFrame(D.field_changes(_l(s, d).drop("height"), _r(s, d).withColumn("width", F.col("width").cast("double"))), "name string, status string, dtype string, previous string"),
     "with k as (select column_name as name, case column_type when 'BIGINT' then 'i64' when 'DOUBLE' then 'f64' when 'VARCHAR' then 'str' else 'datetime' end as t from (describe boxes_right)), l as (select * from k where name <> 'height'), r as (select name, case name when 'width' then 'f64' else t end as t from k) "
     "select coalesce(r.name, l.name) as name, case when l.name is null then 'added' when r.name is null then 'removed' else 'modified' end as status, r.t as dtype, l.t as previous from l full join r on l.name = r.name where l.t is distinct from r.t")  # fmt: skip
_add("size_diff", lambda s, d: D.size_diff(_l(s, d), _r(s, d).drop("height")),
     "select greatest((select count(*) from boxes_right) - (select count(*) from boxes_left), 0) as rows_added, greatest((select count(*) from boxes_left) - (select count(*) from boxes_right), 0) as rows_removed, cast(0 as bigint) as columns_added, cast(1 as bigint) as columns_removed")
_KEYS = ["filename", "file", "label"]
_SAME = " and ".join(f"l.{k} is not distinct from r.{k}" for k in _KEYS)
_VALUES = [c for c in _BOX if c not in _KEYS]
_FULL = (
    f"with l as (select distinct {_B}, true as inl from boxes_left), r as (select distinct {_B}, true as inr from boxes_right), j as (select inl, inr, {', '.join(f'l.{c} as l_{c}, r.{c} as r_{c}' for c in _VALUES)}, {', '.join(f'case when r.inr then r.{k} else l.{k} end as k_{k}' for k in _KEYS)} from l full join r on {_SAME}), "
    f"x as (select *, case when inl is null then 'added' when inr is null then 'removed' when {' or '.join(f'l_{c} is distinct from r_{c}' for c in _VALUES)} then 'modified' else 'unchanged' end as st from j)"
)


def _keyed(s: SparkSession, d: str) -> D.TabularDiff:
    return D.diff(_l(s, d).distinct(), _r(s, d).distinct(), _KEYS)


_add("diff_keyed", lambda s, d: _keyed(s, d).contents, _FULL + f" select {', '.join(f'k_{k} as {k}' for k in _KEYS)}, " + ", ".join(f'l_{c} as "{c}.left", r_{c} as "{c}.right"' for c in _VALUES) + ", st as _diff_status from x where st <> 'unchanged'")
_add("diff_keyed_summary", lambda s, d: _keyed(s, d).row_counts(), _FULL + " select count(*) filter (st = 'added') as added, count(*) filter (st = 'removed') as removed, count(*) filter (st = 'modified') as modified from x")
_add("diff_no_keys", lambda s, d: D.diff(_l(s, d).distinct(), _r(s, d).distinct()).row_counts(),
     f"select (select count(*) from (select {_B} from boxes_right except select {_B} from boxes_left)) as added, (select count(*) from (select {_B} from boxes_left except select {_B} from boxes_right)) as removed, cast(0 as bigint) as modified")
_add("diff_added_column", lambda s, d: D.diff(_l(s, d).drop("contributor").distinct(), _r(s, d).distinct(), _KEYS, ["contributor"]).row_counts(),
     f"with l as (select distinct {', '.join(c for c in _BOX if c != 'contributor')}, true as inl from boxes_left), r as (select distinct {_B}, true as inr from boxes_right), j as (select inl, inr from l full join r on {_SAME}) select count(*) filter (inl is null) as added, count(*) filter (inr is null) as removed, count(*) filter (inl and inr) as modified from j")
_add("diff_dupes", lambda s, d: D.diff(_l(s, d), _r(s, d), _KEYS).duplicates(),
     'select (select cast(coalesce(sum(n), 0) as bigint) from (select count(*) n from boxes_left group by filename, file, label) where n > 1) as "left", (select cast(coalesce(sum(n), 0) as bigint) from (select count(*) n from boxes_right group by filename, file, label) where n > 1) as "right"')
_add("text_diff", lambda s, d: D.text_diff(table(s, d, "llm_fine_tune").select("pair_id", "context", "response"), "pair_id", "context", "response"))

# --- vectors --------------------------------------------------------------------------------------------

_e = lambda s, d: table(s, d, "embeddings")
_top = lambda df: df.select("vec_id", "label", F.round("similarity", 4).alias("similarity"))


def _by_predicate(s: SparkSession, d: str) -> DataFrame:
    df = _e(s, d)
    return vectors.nearest(df, "embedding", vectors.mean_vector(df, "embedding", "label = 3") or [], 10, ties=["vec_id"])


_MEAN = "m as (select list(a order by i) v from (select i, avg(x) a from (select unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings where {w}) group by i))"
_SIM = "select vec_id, label, round(list_cosine_similarity(embedding::double[], v), 4) as similarity from embeddings, m order by list_cosine_similarity(embedding::double[], v) desc, vec_id"
_add("similarity_topk", lambda s, d: _top(vectors.nearest(_e(s, d), "embedding", vectors.mean_vector(_e(s, d), "embedding", "vec_id = 0") or [], 10, ties=["vec_id"])), f"with {_MEAN.format(w='vec_id = 0')} {_SIM} limit 10")
_add("similarity_by_predicate_mean", lambda s, d: _top(_by_predicate(s, d)), f"with {_MEAN.format(w='label = 3')} {_SIM} limit 10")
_add("similarity_page2", lambda s, d: _top(vectors.nearest(_e(s, d), "embedding", vectors.mean_vector(_e(s, d), "embedding", "vec_id = 0") or [], 10, 10, ties=["vec_id"])), f"with {_MEAN.format(w='vec_id = 0')} {_SIM} limit 10 offset 10")
_add("similarity_all", lambda s, d: _top(vectors.similarity_to(_e(s, d), "embedding", vectors.mean_vector(_e(s, d), "embedding") or [])), f"with {_MEAN.format(w='true')} {_SIM}")
_add("average_embedding", lambda s, d: vectors.average_embedding(_e(s, d), "embedding", 6), "select cast(i - 1 as int) as i, round(avg(x), 6) as mean from (select unnest(embedding)::double x, generate_subscripts(embedding, 1) i from embeddings) group by i")
_add("embedding_index", lambda s, d: vectors.index_column(_e(s, d), "embedding").groupBy(F.size("embedding").alias("length")).agg(F.count(F.lit(1)).alias("n")), "select cast(len(embedding) as int) as length, count(*) as n from embeddings group by 1")

# --- SQL over view df ---------------------------------------------------------------------------------

_add("sql_page_inside_limit", lambda s, d: Q.page(Q.query(table(s, d, "orders"), "select o_orderkey, o_totalprice from df order by o_orderkey limit 50"), 2, 20), "select o_orderkey, o_totalprice from orders order by o_orderkey limit 20 offset 20")
_add("sql_page_ordered", lambda s, d: Q.page(Q.query(table(s, d, "orders"), "select o_orderkey, o_custkey from df where o_orderstatus = 'F'"), 2, 30, ["o_orderkey"]), "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' order by o_orderkey limit 30 offset 30")
_add("sql_count_wrapper", lambda s, d: Q.total(Q.query(table(s, d, "orders"), "select o_custkey from df where o_totalprice > 100000 ;")), "select count(*) as count from orders where o_totalprice > 100000")
_sql("sql_distinct", "select distinct o_orderstatus, o_orderpriority from df", ["orders"])
_sql("sql_group_having", "select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from df group by o_custkey having count(*) > 3", ["orders"])
_sql("sql_where_forms", "select o_orderkey from df where o_totalprice between 1000 and 150000 and o_orderstatus in ('O', 'F') and o_orderpriority like '%E%' and o_custkey is not null", ["orders"])
_sql("sql_cte", "with big as (select * from df where o_totalprice > 200000) select o_orderstatus, count(*) as n from big group by o_orderstatus", ["orders"], "with big as (select * from orders where o_totalprice > 200000) select o_orderstatus, count(*) as n from big group by o_orderstatus")
_sql("sql_subquery", "select c_custkey, c_name from df where c_custkey in (select o_custkey from orders where o_totalprice > 300000)", ["customer", "orders"])
_sql("sql_join_inner", "select o_orderkey, c_name, n_name from df join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey", ["orders", "customer", "nation"])
_sql("sql_join_left", "select c_custkey, o_orderkey from df left join orders on c_custkey = o_custkey", ["customer", "orders"])
_sql("sql_join_full", "select s_suppkey, c_custkey from df full join customer on s_suppkey = c_custkey and s_nationkey = c_nationkey", ["supplier", "customer"])
_sql("sql_join_semi", "select c_custkey from df where exists (select 1 from orders where o_custkey = c_custkey)", ["customer", "orders"])
_sql("sql_join_anti", "select c_custkey from df where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)", ["customer", "orders"])
_sql("sql_join_theta", "select a.c_custkey as a, b.c_custkey as b from df a join df b on a.c_nationkey = b.c_nationkey and a.c_acctbal < b.c_acctbal - 9000", ["customer"])
_sql("sql_join_self", "select a.o_orderkey as a, b.o_orderkey as b from df a join df b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey", ["orders"])
_sql("sql_union", "select c_nationkey as k from df union select s_nationkey from supplier", ["customer", "supplier"])
_sql("sql_union_all", "select c_nationkey as k from df union all select s_nationkey from supplier", ["customer", "supplier"])
_sql("sql_intersect", "select c_nationkey as k from df intersect select s_nationkey from supplier", ["customer", "supplier"])
_sql("sql_intersect_all", "select c_nationkey as k from df intersect all select s_nationkey from supplier", ["customer", "supplier"])
_sql("sql_except", "select c_custkey as k from df except select o_custkey from orders where o_orderstatus = 'P'", ["customer", "orders"])
_sql("sql_except_all", "select c_nationkey as k from df except all select s_nationkey from supplier", ["customer", "supplier"])
_sql("sql_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus) as g from df group by grouping sets ((o_orderstatus), (o_orderpriority), ())", ["orders"], "select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderstatus) as tinyint) as g from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
_sql("sql_cube", "select l_returnflag, l_linestatus, count(*) as n from df group by cube (l_returnflag, l_linestatus)", ["lineitem"])
_sql("sql_rollup", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as q from df group by rollup (l_returnflag, l_linestatus)", ["lineitem"])
_sql("sql_agg_filter", "select o_orderstatus, count(*) filter (where o_totalprice > 100000) as big, count(distinct o_custkey) as customers from df group by o_orderstatus", ["orders"])
_sql("sql_group_all", "select o_orderstatus, o_orderpriority, max(o_totalprice) as top from df group by all", ["orders"])
_sql("sql_window_rank", "select o_orderkey, rank() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as r, dense_rank() over (partition by o_orderstatus order by o_orderpriority) as dr from df", ["orders"],
     "select o_orderkey, cast(rank() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey) as int) as r, cast(dense_rank() over (partition by o_orderstatus order by o_orderpriority) as int) as dr from orders")
_sql("sql_window_lag", "select o_orderkey, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as prev, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nxt from df", ["orders"])
_sql("sql_window_frame", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), 2) as s, first_value(o_orderkey) over (partition by o_custkey order by o_orderkey) as f from df", ["orders"])
_sql("sql_window_filtered", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from df) where k = 1", ["orders"])
_sql("sql_pricing_summary", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(avg(l_discount), 4) as disc from df group by l_returnflag, l_linestatus", ["lineitem"])
_add("json_extract_props", lambda s, d: Q.query(table(s, d, "events"), "select event_id, cast(get_json_object(props, '$.k') as bigint) as k from df"), "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
_add("json_tolerant", lambda s, d: V.json_valid(table(s, d, "frame_records"), "record").groupBy("valid").agg(F.count(F.lit(1)).alias("n")), "select json_valid(record) as valid, count(*) as n from frame_records group by 1")
_add("export_guard", lambda s, d: Q.export_guard(Q.query(table(s, d, "orders"), "select * from df")), "select * from orders")

# --- staged edits ---------------------------------------------------------------------------------------

_LOG = "row_id string, row_ord long, op string, body string, seq long"


def _overlay(s: SparkSession, d: str) -> DataFrame:
    base = table(s, d, "supplier").withColumns({"_row_id": F.col("s_suppkey").cast("string"), "_row_ord": F.col("s_suppkey")})
    log = s.createDataFrame([("new", 10**9, "insert", '{"s_suppkey": -1, "s_name": "new", "s_acctbal": 1.5}', 1), ("3", None, "update", '{"s_name": "third"}', 2), ("3", None, "update", '{"s_acctbal": null}', 3), ("4", None, "delete", "{}", 4)], _LOG)
    return staged.overlay(base, log).drop("_row_id", "_row_ord")


_add("append_delete_overlay", _overlay,
     "select s_suppkey, case when s_suppkey = 3 then 'third' else s_name end as s_name, s_nationkey, case when s_suppkey = 3 then null else s_acctbal end as s_acctbal from supplier where s_suppkey <> 4 union all select -1, 'new', null, 1.5")
_add("batch_update_merge", lambda s, d: staged.batch_update(table(s, d, "orders").select(*_ORDERS), table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit("X").alias("o_orderstatus")).join(table(s, d, "orders"), "o_orderkey", "left_semi"), "o_orderkey"),
     "select o_orderkey, o_custkey, case when o_orderkey in (select l_orderkey from lineitem) then 'X' else o_orderstatus end as o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
_add("column_retype", lambda s, d: V.retype_column(table(s, d, "supplier"), "s_suppkey", "str"), "select cast(s_suppkey as varchar) as s_suppkey, s_name, s_nationkey, s_acctbal from supplier")


def _staged_cycle(s: SparkSession, d: str) -> DataFrame:
    """Index, edit, restore nothing, read in order: the whole life of a staged table in the shared folder."""
    from quern.plans.scratch import scratch_path

    t = staged.StagedTable.index(table(s, d, "nation").orderBy("n_nationkey"), scratch_path(s, "staged"))
    t.append({"n_nationkey": 99, "n_name": "LAST", "n_regionkey": 1})
    first = t.get_by_index(0).first()["_row_id"]
    t.update(first, {"n_name": "FIRST"})
    t.delete(t.get_by_index(1).first()["_row_id"])
    return t.ordered()


_add("staged_edit_cycle", _staged_cycle, "select n_nationkey, case when n_nationkey = (select min(n_nationkey) from nation) then 'FIRST' else n_name end as n_name, n_regionkey from nation where n_nationkey <> (select n_nationkey from nation order by n_nationkey offset 1 limit 1) union all select 99, 'LAST', 1")

# --- version graph --------------------------------------------------------------------------------------

_EDGES = "ed as (select distinct commit_id as child, unnest(parent_ids) as parent from commits), edges as (select * from ed where parent is not null)"
_TIPS = "tips as (select distinct commit_id from commits where commit_id not in (select parent from edges))"
_MERGES = "mg as (select distinct commit_id, parent_ids[1] as base, parent_ids[2] as head from commits where len(parent_ids) > 1)"


def _merges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "commits").where(F.size("parent_ids") > 1).select("commit_id", F.col("parent_ids")[0].alias("base"), F.col("parent_ids")[1].alias("head")).distinct()


def _lca(s: SparkSession, d: str) -> DataFrame:
    commits, m = table(s, d, "commits"), _merges(s, d)
    heads = m.select(F.col("base").alias("head")).union(m.select("head"))
    return G.common_ancestors(G.ancestors(G.edges_of(commits), heads), commits, m.select("base", "head").distinct())


_REACH = "walk(head, commit_id, depth) as (select distinct h, h, 0 from heads union select w.head, e.parent, w.depth + 1 from walk w join edges e on e.child = w.commit_id), reach as (select head, commit_id, min(depth) as depth from walk group by all)"
_LCA = f"{_EDGES}, {_MERGES}, heads as (select base as h from mg union select head from mg), {_REACH}, tm as (select commit_id, max(committed_at) as t from commits group by 1), lca as (select base, head, commit_id, depth from (select p.base, p.head, a.commit_id, a.depth, row_number() over (partition by p.base, p.head order by a.depth, tm.t desc nulls last, a.commit_id) k from (select distinct base, head from mg) p join reach a on a.head = p.base join reach b on b.head = p.head and b.commit_id = a.commit_id left join tm on tm.commit_id = a.commit_id) where k = 1)"
_add("ancestors", lambda s, d: G.ancestors(G.edges_of(table(s, d, "commits")), G.tips(table(s, d, "commits")).select(F.col("commit_id").alias("head"))), f"with recursive {_EDGES}, {_TIPS}, heads as (select commit_id as h from tips), {_REACH} select head, commit_id, cast(depth as int) as depth from reach")
_add("first_parent_history", lambda s, d: G.ancestors(G.first_parent_edges(table(s, d, "commits")), G.tips(table(s, d, "commits")).select(F.col("commit_id").alias("head"))).groupBy("head").agg(F.count(F.lit(1)).alias("length")),
     f"with recursive {_EDGES}, {_TIPS}, fp as (select distinct commit_id as child, parent_ids[1] as parent from commits where parent_ids[1] is not null), walk(head, commit_id) as (select commit_id, commit_id from tips union select w.head, f.parent from walk w join fp f on f.child = w.commit_id) select head, count(*) as length from walk group by head")
_add("count_ancestors", lambda s, d: G.ancestors(G.edges_of(table(s, d, "commits")), G.tips(table(s, d, "commits")).select(F.col("commit_id").alias("head"))).groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest")), f"with recursive {_EDGES}, {_TIPS}, heads as (select commit_id as h from tips), {_REACH} select head, count(*) as n, cast(max(depth) as int) as deepest from reach group by head")
_add("graph_roots", lambda s, d: G.roots(table(s, d, "commits")), "select distinct commit_id from commits where coalesce(len(parent_ids), 0) = 0")
_add("graph_tips", lambda s, d: G.tips(table(s, d, "commits")), f"with {_EDGES}, {_TIPS} select commit_id from tips")
_add("lca", _lca, f"with recursive {_LCA} select base, head, commit_id, cast(depth as int) as depth from lca")


def _merge_decisions(s: SparkSession, d: str) -> DataFrame:
    from quern.plans.scratch import cut

    m, e = _merges(s, d), cut(G.latest_entries(table(s, d, "commit_entries")).select("commit_id", "path", "hash"))
    found = cut(m.join(_lca(s, d).select("base", "head", F.col("commit_id").alias("lca")), ["base", "head"]))
    side = lambda c: found.select(F.col("commit_id").alias("merge_id"), F.col(c).alias("commit_id")).join(e, "commit_id").select("merge_id", "path", "hash")
    return G.merge_classes(side("lca"), side("base"), side("head"), "merge_id")


_add("merge_classify", _merge_decisions,
     f"with recursive {_LCA}, {_LATEST}, f as (select mg.commit_id as merge_id, mg.base, mg.head, lca.commit_id as lca from mg join lca on lca.base = mg.base and lca.head = mg.head), "
     "o as (select merge_id, path, hash as oh, true as i from f join e on e.commit_id = f.lca), b as (select merge_id, path, hash as bh, true as i from f join e on e.commit_id = f.base), m as (select merge_id, path, hash as mh, true as i from f join e on e.commit_id = f.head), "
     "j as (select merge_id, path, coalesce(o.i, false) as io, coalesce(b.i, false) as ib, coalesce(m.i, false) as im, oh, bh, mh from o full join b using (merge_id, path) full join m using (merge_id, path)), "
     "x as (select merge_id, path, case when ib = im and bh is not distinct from mh then (case when ib then 'keep' end) when io = ib and oh is not distinct from bh then (case when im then 'take' else 'delete' end) when io = im and oh is not distinct from mh then (case when ib then 'keep' end) else 'conflict' end as decision from j) select * from x where decision is not null")  # fmt: skip
_add("path_history", lambda s, d: G.path_history(G.latest_entries(table(s, d, "commit_entries")), G.edges_of(table(s, d, "commits")), table(s, d, "commits")),
     f"with {_EDGES}, {_LATEST} select distinct e.commit_id, e.path from e join edges x on x.child = e.commit_id left join e o on o.commit_id = x.parent and o.path = e.path where o.commit_id is null or o.hash is distinct from e.hash union select e.commit_id, e.path from e where e.commit_id in (select commit_id from commits where coalesce(len(parent_ids), 0) = 0)")


def _files(s: SparkSession, d: str, name: str) -> DataFrame:
    """Each file name with a hash of its content: the distinct rows under it, in any order."""
    rows = table(s, d, name).where(F.col("filename").isNotNull()).distinct()
    marked = P.row_hash(rows, [c for c in rows.columns if c != "filename"], "a")
    marked = marked.withColumn("b", F.xxhash64(F.lit("second"), *[F.to_json(F.struct(*[c for c in rows.columns if c != "filename"]), {"ignoreNullFields": "false"})]))
    sums = [F.sum(F.shiftright(c, 32)).cast("string") for c in ("a", "b")] + [F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))).cast("string") for c in ("a", "b")]
    return marked.groupBy(F.col("filename").alias("path")).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("hash"))


_SET = lambda t: f"select filename as path, list(distinct row(file, label, min_x, min_y, width, height, contributor, added_at) order by row(file, label, min_x, min_y, width, height, contributor, added_at)) as hash from {t} where filename is not null group by 1"
_add("tree_diff_copies", lambda s, d: G.tree_diff(_files(s, d, "boxes_left"), _files(s, d, "boxes_right")),
     f"with l as ({_SET('boxes_left')}), r as ({_SET('boxes_right')}) select coalesce(r.path, l.path) as path, case when l.path is null then 'added' when r.path is null then 'removed' else 'modified' end as status from l full join r on l.path = r.path where l.path is null or r.path is null or l.hash is distinct from r.hash")

# --- sources, sinks, streams ------------------------------------------------------------------------------


def _round_trip(ext: str, of: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        from quern.plans.scratch import scratch_path

        path = scratch_path(s, "trip") + f".{ext}"
        df = table(s, d, of)
        return files.read_df(s, files.write_df(df, path)).select(*df.columns)

    return run


for _ext in ("csv", "tsv", "json", "jsonl", "parquet", "arrow"):
    _add(f"write_read_roundtrip_{_ext}", _round_trip(_ext, "supplier"), "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier" if _ext in ("parquet", "arrow") else "select s_suppkey, s_name, cast(s_nationkey as bigint) as s_nationkey, s_acctbal from supplier")
_add("json_view", lambda s, d: files.json_view(table(s, d, "documents").select("doc_id", "text", "lang", "n_chars")).select(F.get_json_object("row", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("row", "$.text").alias("text"), F.get_json_object("row", "$.lang").alias("lang"), F.json_object_keys("row").alias("keys")), "select doc_id, text, lang, ['doc_id', 'text', 'lang', 'n_chars'] as keys from documents")
_add("schema_fields_of", lambda s, d: s.createDataFrame([(f["name"], f["dtype"]) for f in S.fields_of(table(s, d, "lineitem"))], "name string, dtype string"),
     "select name, case type when 'BIGINT' then 'i64' when 'INTEGER' then 'i32' when 'DOUBLE' then 'f64' when 'VARCHAR' then 'str' else 'datetime' end as dtype from pragma_table_info('lineitem')")
_add("event_windows", lambda s, d: reader.windowed_counts(table(s, d, "events"), "ts", "1 hour", "event_type"), "select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
_add("event_sessions", lambda s, d: reader.sessions(table(s, d, "events"), "ts", "user_id", "30 minutes"),
     "with g as (select user_id, ts, sum(case when prev is null or ts - prev >= interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts, event_id) as k from (select user_id, ts, event_id, lag(ts) over (partition by user_id order by ts, event_id) as prev from events)) select user_id, min(ts) as session_start, count(*) as n from g group by user_id, k")


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The event windows again, from a stream that runs until its files are used up; the result lies in files."""
    from quern.plans.scratch import scratch_path

    schema = s.read.parquet(f"{d}/events.parquet").schema
    events = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = reader.run_to_files(reader.windowed_counts(events, "ts", "1 hour", "event_type"), scratch_path(s, "stream-out"), scratch_path(s, "stream"), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_add("event_windows_streamed", _stream, "select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
_add("filter_mini_language", lambda s, d: apply_filter(table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), "l_quantity >= 30 && l_linenumber != 1"), "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity from lineitem where l_quantity >= 30 and l_linenumber <> 1")
