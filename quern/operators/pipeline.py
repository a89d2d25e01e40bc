"""The transform pipeline: many operators, one fixed order, one lazy plan.

vstack, add column, add row, filter, sql, randomize, unique, unique count, sort, reverse, columns,
rename, take, slice or row, head, tail, item. Only operators that speak of row numbers (take,
reverse without a sort, tail, item, keep-first distinct without an order) need the ordinal's small
counting job; everything else stays a plan until the caller acts on it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.filters import apply_filter, column_of
from quern.functions.types import from_name, typed_literal
from quern.operators import options as O
from quern.operators.ordinal import ORDINAL, with_ordinal
from quern.plans.sizing import sized_join

#: Names of the engine's own columns, never part of a result.
RESERVED = ("_row_id", "_row_ord", "_row_status", "_row_hash", ORDINAL)
#: Rows that a slice may skip by OFFSET, which brings all of them to one task; deeper slices go by row number.
MOST_OFFSET = 100_000
_ORD = "__pipeline_ord"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def strip_reserved(df: DataFrame) -> DataFrame:
    """Without the engine's own columns."""
    return df.drop(*RESERVED)


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in the given order; no names change nothing, unknown ones raise."""
    return df.select(*[_c(column_of(df, n)) for n in names]) if names else df


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename one column; an unknown old or an existing new name raises."""
    old = column_of(df, old)
    if new in df.columns and new != old:
        raise O.OptionError(f"there is a column {new!r} already")
    return df.select(*[_c(c).alias(new) if c == old else _c(c) for c in df.columns])


def add_column(df: DataFrame, name: str, value: str, dtype: str, at: int | None = None) -> DataFrame:
    """A constant column at the end or at place `at`."""
    if name in df.columns:
        raise O.OptionError(f"there is a column {name!r} already")
    new = typed_literal(value, from_name(dtype)).alias(name)
    cols = [_c(c) for c in df.columns]
    place = len(cols) if at is None else at
    if not 0 <= place <= len(cols):
        raise O.OptionError(f"there is no place {at} among {len(cols)} columns")
    return df.select(*cols[:place], new, *cols[place:])


def add_row(df: DataFrame, row: str) -> DataFrame:
    """One row more, given as a JSON object (missing names are null, unknown ones raise) or a comma list."""
    parsed = O.parse_row(row, len(df.columns))
    spark = df.sparkSession
    if isinstance(parsed, dict):
        if unknown := set(parsed) - set(df.columns):
            raise O.OptionError(f"no such columns: {', '.join(sorted(unknown))}")
        import json

        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        one = spark.createDataFrame([(json.dumps(parsed),)], "j string").select(F.from_json("j", schema).alias("r")).select(*[F.col(f"r.`{c}`") for c in df.columns])
    else:
        one = spark.range(1).select(*[typed_literal(v, f.dataType).alias(f.name) for v, f in zip(parsed, df.schema.fields)])
    return df.unionByName(one)


def vstack(df: DataFrame, others: Sequence[DataFrame]) -> DataFrame:
    """Tables below each other, all rows kept; names and types must agree column by column."""
    shape = [(f.name, f.dataType) for f in df.schema.fields]
    for o in others:
        if [(f.name, f.dataType) for f in o.schema.fields] != shape:
            raise O.OptionError(f"cannot stack {o.schema.simpleString()} below {df.schema.simpleString()}")
        df = df.union(o)
    return df


def randomize(df: DataFrame, seed: int | None = None) -> DataFrame:
    """All rows in random order."""
    return df.orderBy(F.rand(seed) if seed is not None else F.rand())


def unique(df: DataFrame, names: Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """The first row of each distinct combination of `names`, all columns kept.

    First by `order` if given, else by the rows' present order. Nulls are equal to each other. Each
    partition keeps only its own firsts before the exchange (window group limit).
    """
    keys = [_c(column_of(df, n)) for n in names]
    body = df if order else df.withColumn(_ORD, F.monotonically_increasing_id())
    w = Window.partitionBy(*keys).orderBy(*(order or [_ORD]))
    return body.withColumn("__first", F.row_number().over(w)).where(F.col("__first") == 1).drop("__first", _ORD)


def unique_count(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct combinations of `names` with `count`, their rows (nulls counted)."""
    return df.groupBy(*[_c(column_of(df, n)) for n in names]).agg(F.count(F.lit(1)).alias("count"))


def duplicated_rows(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: `n_duped_rows`, all members of groups of more than one row."""
    per = df.groupBy(*[_c(column_of(df, n)) for n in names]).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("n_duped_rows"))


def sort_rows(df: DataFrame, name: str, reverse: bool = False) -> DataFrame:
    """By one column, ascending with nulls first; reversed: descending with nulls last."""
    c = _c(column_of(df, name))
    return df.orderBy(c.desc_nulls_last() if reverse else c.asc_nulls_first())


def reverse_rows(df: DataFrame) -> DataFrame:
    """The present order turned round."""
    return df.withColumn(_ORD, F.monotonically_increasing_id()).orderBy(F.col(_ORD).desc()).drop(_ORD)


def slice_rows(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows `start` to before `end` of the present order."""
    n = min(end - start, 2**31 - 1)
    if start > MOST_OFFSET:
        return df.limit(0) if start >= 2**62 else _between(df, start, end)
    return df.offset(start).limit(n) if start else df.limit(n)


def _between(df: DataFrame, start: int, end: int) -> DataFrame:
    return with_ordinal(df, _ORD).where((F.col(_ORD) >= start) & (F.col(_ORD) < end)).drop(_ORD)


def tail_rows(df: DataFrame, n: int) -> DataFrame:
    """The last `n` rows in the present order."""
    numbered = with_ordinal(df, _ORD)
    total = df.count()
    return numbered.where(F.col(_ORD) >= total - n).orderBy(_ORD).drop(_ORD)


def take_rows(df: DataFrame, rows: Sequence[int], order: Sequence[Column | str] | None = None) -> DataFrame:
    """The rows of the given numbers, order and repeats kept; a number beyond the table raises."""
    numbered = with_ordinal(df, _ORD, order=order)
    total = df.count()
    if wrong := [r for r in rows if r >= total]:
        raise O.OptionError(f"row {wrong[0]} of {total}")
    want = df.sparkSession.createDataFrame([(i, r) for i, r in enumerate(rows)], f"__pos long, {_ORD} long")
    picked = numbered.where(F.col(_ORD).isin(sorted(set(rows)))) if len(rows) <= 1000 else numbered
    return sized_join(picked, want, _ORD).orderBy("__pos").drop(_ORD, "__pos")


def item(df: DataFrame, name: str, row: int) -> DataFrame:
    """One cell as a table of one row and one column."""
    return _between(df, row, row + 1).select(_c(column_of(df, name)).alias(name))


def row_hash(df: DataFrame, names: Sequence[str] | None = None, out: str = "_row_hash") -> DataFrame:
    """A 64-bit hash of the whole row, or of `names`: unequal values, and null against empty, differ."""
    cols = [_c(c) for c in (names if names is not None else df.columns)]
    if not cols:
        return df.withColumn(out, F.lit(None).cast("long"))
    return df.withColumn(out, F.xxhash64(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})))


def run_pipeline(df: DataFrame, opts: O.Options, read: Callable[[SparkSession, str], DataFrame] | None = None) -> DataFrame:
    """`df` after all options of `opts`, in the fixed order. `read` opens the files of `vstack`.

    Options that contradict the table raise; nothing is skipped silently. `sql` sees the table so
    far as view `df`. Of slice, page and row the first that is set counts.
    """
    if opts.vstack:
        if read is None:
            raise O.OptionError("vstack needs a reader")
        df = vstack(df, [read(df.sparkSession, p) for p in opts.vstack])
    if opts.add_col:
        df = add_column(df, *O.parse_add_col(opts.add_col), at=opts.add_col_at)
    if opts.add_row:
        df = add_row(df, opts.add_row)
    if opts.filter:
        df = apply_filter(df, opts.filter)
    if opts.sql:
        from quern.operators.sql import query

        df = query(df, opts.sql)
    if opts.randomize:
        df = randomize(df, opts.seed)
    if opts.unique:
        df = unique(df, O.name_list(opts.unique))
    if opts.unique_count:
        df = unique_count(df, O.name_list(opts.unique_count))
    if opts.sort:
        df = sort_rows(df, opts.sort, opts.reverse)
    elif opts.reverse:
        df = reverse_rows(df)
    if opts.columns:
        df = project(df, O.name_list(opts.columns))
    if opts.rename:
        df = rename_column(df, *O.parse_rename(opts.rename))
    if opts.take:
        df = take_rows(df, O.parse_take(opts.take))
    if opts.slice:
        df = slice_rows(df, *O.parse_slice(opts.slice))
    elif opts.page is not None or opts.page_size is not None:
        df = slice_rows(df, *O.page_slice(opts.page, opts.page_size))
    elif opts.row is not None:
        df = slice_rows(df, opts.row, opts.row + 1)
    if opts.head is not None:
        df = df.limit(opts.head)
    if opts.tail is not None:
        df = tail_rows(df, opts.tail)
    if opts.item:
        df = item(df, *O.parse_item(opts.item))
    return strip_reserved(df)
