"""SQL over one table, seen as view `df`: queries only, composed ordering and paging, counts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import dialect
from quern.plans.heavy import split_heavy_joins

#: Rows that a query's export may have at most; beyond them it is refused, not cut.
EXPORT_ROWS = 5_000_000

#: Constructs of other dialects that have no counterpart here, with what to write instead (fixed values).
HINTS = {
    r"\bfetch\s+first\b": "write LIMIT instead of FETCH FIRST",
    r"\blist_\w+\s*\(": "there is no such list function; the array functions are there (transform, filter, array_sort, ...)",
    r"\basof\s+join\b": "there is no ASOF JOIN",
    r"\browid\b": "there is no rowid",
}

# Kinds of plan nodes that a query may be made of.
NODES = frozenset(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join Union Intersect Except SubqueryAlias UnresolvedWith UnresolvedRelation UnresolvedInlineTable
    UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedHint OneRowRelation$ OneRowRelation Generate LateralJoin AsOfJoin Pivot Unpivot
    WithWindowDefinition LocalRelation Window Sample Range Expand NamedParametersQuery NameParameterizedQuery PosParameterizedQuery WithCTE Subquery GroupingSets Cube Rollup""".split()
)
# Groups of built-in functions that only compute on their arguments, and those of the mixed group that do.
FUNCTION_GROUPS = frozenset("agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs predicate_funcs st_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs xml_funcs".split())
OTHER_FUNCTIONS = frozenset("typeof bitmap_bit_position bitmap_bucket_number bitmap_count hll_sketch_estimate hll_union approx_top_k_estimate uuid".split())
TABLE_FUNCTIONS = frozenset("range explode posexplode inline stack explode_outer posexplode_outer inline_outer json_tuple variant_explode variant_explode_outer".split())
#: Words that give away the session without brackets.
SESSION_WORDS = frozenset("current_user user session_user current_catalog current_database current_schema current_path".split())
#: Names that the parser turns into calls of its own.
_SYNTAX = frozenset("struct array map named_struct in exists".split())


class QueryError(ValueError):
    """SQL that is no plain query over the given tables."""


def _strip(text: str) -> str:
    """The statement without the semicolons, blanks and comments behind it; a second statement raises."""
    parts = dialect.tokens(text)
    while parts and (parts[-1].kind == "space" or parts[-1].text == ";"):
        parts.pop()
    if any(t.text == ";" for t in parts):
        raise QueryError("only one statement is allowed")
    if not parts:
        raise QueryError("the query is empty")
    return "".join(t.text for t in parts).strip()


def query(df: DataFrame, text: str, tables: Mapping[str, DataFrame] | None = None, args: Mapping | None = None) -> DataFrame:
    """The result of a query over view `df` and the views of `tables`.

    The tables are bound as named parts of the one query, so the session keeps no views. The text may
    use the analytic dialect of `dialect.translate`. Everything is decided on the parsed plan: only
    kinds of nodes that make up queries, only the given tables, and only built-in functions that
    compute on their arguments pass. Commands (DDL, SET, INSERT, ...), files, catalog tables, functions
    that reach the JVM, the session, the files or the user, and registered functions raise QueryError;
    so does text that does not parse, with a hint where a construct is known. Joins on equal keys and
    comparisons are measured and, where heavy, split (`split_heavy_joins`).
    """
    said = _strip(text)
    words = [t.low for t in dialect.tokens(said) if t.kind != "space"]
    if ("asof", "join") in zip(words, words[1:]):
        raise QueryError("there is no ASOF JOIN")  # it would parse as a table of that name
    spark = df.sparkSession
    names = {"df": df, **(tables or {})}
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        try:
            text, parsed = said, parser.parsePlan(said)
            if (moved := dialect.translate(said)) != said:
                text, parsed = moved, parser.parsePlan(moved)
        except Exception:
            text = dialect.translate(said)
            parsed = parser.parsePlan(text)
    except Exception as e:
        raise QueryError(_hint(said) or str(e).strip().split("\n")[0]) from None
    _Guard(spark, names).plan(parsed, frozenset())
    # placeholders keep the caller's session free of views
    fills = {f"__q_{n}": t for n, t in names.items()}
    body = "WITH " + ", ".join(f"`{n}` AS (SELECT * FROM {{__q_{n}}})" for n in names)
    try:
        found = spark.sql(_merge_with(body, text), args=dict(args) if args else None, **fills)
    except Exception as e:
        raise QueryError(_hint(said) or str(e).strip().split("\n")[0]) from None
    return split_heavy_joins(found)


def _hint(text: str) -> str | None:
    return next((h for p, h in HINTS.items() if re.search(p, text, re.I)), None)


class _Guard:
    """Walks a parsed plan and raises at the first thing that is not allowed."""

    def __init__(self, spark, names: Mapping[str, DataFrame]) -> None:
        self.names = names
        self.known = {n.lower() for n in names}
        self.columns = {c.lower() for t in names.values() for c in t.columns}
        self.registry = spark._jsparkSession.sessionState().functionRegistry()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self.good: set[str] = set(_SYNTAX)

    def plan(self, node, ctes: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in NODES:
            raise QueryError(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedWith":
            relations = node.cteRelations()
            own = [relations.apply(i) for i in range(relations.size())]
            # a part sees those before it, and in a recursive list itself
            for r in own:
                ctes = ctes | {r._1().lower()}
                self.plan(r._2(), ctes)
        elif kind == "UnresolvedRelation":
            parts = node.multipartIdentifier()
            name = ".".join(parts.apply(i) for i in range(parts.size()))
            if parts.size() != 1 or name.lower() not in self.known | ctes:
                raise QueryError(f"no table {name}; there are {', '.join(sorted(self.names))}")
        elif kind == "UnresolvedTableValuedFunction":
            self.function(node.name(), TABLE_FUNCTIONS)
        elif kind == "LateralJoin":
            self.expression(node.right(), ctes)
        expressions = node.expressions()
        for i in range(expressions.size()):
            self.expression(expressions.apply(i), ctes)
        children = node.children()
        for i in range(children.size()):
            self.plan(children.apply(i), ctes)

    def expression(self, e, ctes: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self.function(e.nameParts(), None)
        elif kind == "CallMethodViaReflection" or kind.startswith("Invoke") or kind == "StaticInvoke":
            raise QueryError("calls of methods are not allowed")
        elif kind == "UnresolvedAttribute":
            parts = e.nameParts()
            # bare words that stand for a function unless a column has the name
            if parts.size() == 1 and parts.apply(0).lower() in SESSION_WORDS - self.columns:
                raise QueryError(f"{parts.apply(0)} is not allowed")
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            self.plan(e.plan(), ctes)
        children = e.children()
        for i in range(children.size()):
            self.expression(children.apply(i), ctes)

    def function(self, parts, allowed: frozenset[str] | None) -> None:
        path = [parts.apply(i).lower() for i in range(parts.size())]
        name = path[-1]
        if allowed is not None:
            if len(path) != 1 or name not in allowed:
                raise QueryError(f"no table function {'.'.join(path)}")
            return
        if name in self.good and len(path) == 1:
            return
        found = self.registry.lookupFunction(self.identifier(name)) if len(path) == 1 else None
        if found is None or not found.isDefined():
            # what does not exist, or lives in a catalog
            raise QueryError(_hint(f"{name}(") or f"no function {'.'.join(path)}")
        info = found.get()
        if info.getSource() != "built-in" or not (info.getGroup() in FUNCTION_GROUPS or name in OTHER_FUNCTIONS):
            raise QueryError(f"function {name} is not allowed")
        self.good.add(name)


def _merge_with(head: str, text: str) -> str:
    """`head` (a WITH list) in front of a query that may have a WITH list of its own."""
    escaped = text.replace("{", "{{").replace("}", "}}")
    m = re.match(r"(?:\s|--[^\n]*\n|/\*.*?\*/)*with\s+(recursive\s+)?", escaped, re.I | re.S)
    if not m:
        return f"{head} {escaped}"
    lead = "WITH RECURSIVE " if m.group(1) else "WITH "
    return lead + head[len("WITH ") :] + ", " + escaped[m.end() :]


def orders_itself(df: DataFrame) -> bool:
    """Whether the query's outermost steps sort or bound its rows already."""
    plan = df._jdf.queryExecution().analyzed()
    while True:
        name = plan.getClass().getSimpleName()
        if name in ("Sort", "GlobalLimit", "LocalLimit", "Offset"):
            return True
        if name not in ("Project", "SubqueryAlias", "WithCTE", "View") or plan.children().size() < 1:
            return False
        plan = plan.children().apply(plan.children().size() - 1)


def page(df: DataFrame, number: int, size: int, order: Sequence[Column | str] | None = None) -> DataFrame:
    """Rows of a 1-based page of a query's result, ordered by `order` (nulls last) unless the query orders or bounds itself."""
    from quern.operators.options import page_slice
    from quern.operators.pipeline import slice_rows

    if order and not orders_itself(df):
        df = df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() if isinstance(c, str) else c for c in order])
    return slice_rows(df, *page_slice(number, size))


def total(df: DataFrame) -> DataFrame:
    """One row: `count`, the rows of a query's result."""
    return df.agg(F.count(F.lit(1)).alias("count"))


def export_guard(df: DataFrame, most: int = EXPORT_ROWS) -> DataFrame:
    """`df` if it has at most `most` rows, else QueryError; counts no more rows than needed to know."""
    if df.limit(most + 1).count() > most:
        raise QueryError(f"the result has more than {most} rows")
    return df


def where(df: DataFrame, conditions: Mapping[str, object], joined: str = "and") -> DataFrame:
    """Rows whose columns equal the given values, all of them or (`or`) any; values are bound, never pasted into text."""
    from functools import reduce

    from quern.functions.filters import column_of

    tests = [F.col(f"`{column_of(df, k)}`").eqNullSafe(F.lit(v)) if v is None else F.col(f"`{column_of(df, k)}`") == F.lit(v) for k, v in conditions.items()]
    if not tests:
        return df
    return df.where(reduce((lambda a, b: a & b) if joined == "and" else (lambda a, b: a | b), tests))
