"""Differences of two tables: keyed row diff, set-style row and column diffs, schema diff, duplicates, text diff."""

from __future__ import annotations

import bisect
import difflib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.types import to_name

STATUS = "_diff_status"
ADDED, REMOVED, MODIFIED, UNCHANGED = "added", "removed", "modified", "unchanged"


class DiffError(ValueError):
    """Keys or targets that the tables lack."""


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class SchemaDiff:
    """Column names only in the right table, only in the left, and in both, each in schema order."""

    added: list[str]
    removed: list[str]
    common: list[str]


def schema_diff(left: DataFrame, right: DataFrame) -> SchemaDiff:
    a, b = left.columns, right.columns
    return SchemaDiff([c for c in b if c not in a], [c for c in a if c not in b], [c for c in b if c in a])


@dataclass
class TabularDiff:
    """`contents` stays a plan; `row_counts` and `duplicates` run when asked."""

    contents: DataFrame
    schema: SchemaDiff
    keys: list[str]
    targets: list[str]
    left: DataFrame = field(repr=False)
    right: DataFrame = field(repr=False)

    def row_counts(self) -> DataFrame:
        """One row: added, removed, modified."""
        return self.contents.agg(*[F.count_if(_c(STATUS) == s).alias(s) for s in (ADDED, REMOVED, MODIFIED)])

    def duplicates(self) -> DataFrame:
        """One row: left and right, the rows of each side whose key occurs more than once."""
        from quern.operators.pipeline import duplicated_rows

        a = duplicated_rows(self.left, self.keys).withColumnRenamed("n_duped_rows", "left")
        b = duplicated_rows(self.right, self.keys).withColumnRenamed("n_duped_rows", "right")
        return a.withColumn("__k", F.lit(1)).join(b.withColumn("__k", F.lit(1)), "__k").select("left", "right")

    def schemas(self) -> dict[str, list[dict]]:
        """left, right and diff: names and type names of the columns of both tables and of the contents."""
        of = lambda df: [{"name": f.name, "dtype": to_name(f.dataType, f.metadata)} for f in df.schema.fields]
        return {"left": of(self.left), "right": of(self.right), "diff": of(self.contents)}

    def column_changes(self) -> list[dict]:
        """Added and removed columns with their type names."""
        return [{"name": c, "dtype": to_name(self.right.schema[c].dataType), "status": ADDED} for c in self.schema.added] + [
            {"name": c, "dtype": to_name(self.left.schema[c].dataType), "status": REMOVED} for c in self.schema.removed
        ]


def diff(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), targets: Sequence[str] = (), display: Sequence[str] | None = (), include_removed: bool = False, ordered: bool = True) -> TabularDiff:
    """Keyed diff: rows that are only in `right` (added), only in `left` (removed) or differ in a target (modified).

    Without keys all common columns are the key and added and removed columns the targets; keys
    without targets compare all other common columns; targets without keys raise. Keys and values
    compare null-safe: null equals null. The result has the keys, each target that `right` has as
    `name.left` and `name.right` (only the side that exists), with `include_removed` also targets
    that only `left` has, `display` columns of both sides (None: all other columns), and the status. Rows
    of repeated keys meet as in a join, all with all: n and m rows of one key give n * m (tables whose
    keys may repeat are made distinct first, or compared by `copies.diff_copies`, which takes one row a
    key). Rows are ordered by the keys that can be ordered, unless `ordered` is false: a result that is
    only counted or written needs no order.
    """
    s = schema_diff(left, right)
    if targets and not keys:
        raise DiffError("targets need keys")
    for k in keys:
        if k not in s.common:
            raise DiffError(f"key {k!r} is not in both tables")
    for t in targets:
        if t not in left.columns and t not in right.columns:
            raise DiffError(f"target {t!r} is in neither table")
    if not keys:
        keys, targets = s.common, [*s.added, *s.removed]
    elif not targets:
        targets = [c for c in s.common if c not in keys]
    keys, targets = list(keys), list(targets)
    if display is None:
        display = [c for c in [*left.columns, *s.added] if c not in keys and c not in targets]
    if not keys:
        raise DiffError("the tables have no column in common")
    a = left.select(*[_c(c).alias(f"__l{i}") for i, c in enumerate(left.columns)], F.lit(True).alias("__in_l"))
    b = right.select(*[_c(c).alias(f"__r{i}") for i, c in enumerate(right.columns)], F.lit(True).alias("__in_r"))
    li, ri = {c: i for i, c in enumerate(left.columns)}, {c: i for i, c in enumerate(right.columns)}
    on = None
    for k in keys:
        same = F.col(f"__l{li[k]}").eqNullSafe(F.col(f"__r{ri[k]}"))
        on = same if on is None else on & same
    j = a.join(b, on, "full_outer")
    differ = F.lit(False)
    for t in targets:
        if t in li and t in ri:
            differ = differ | ~F.col(f"__l{li[t]}").eqNullSafe(F.col(f"__r{ri[t]}"))
        else:
            differ = F.lit(True)  # a column that one side lacks always differs
    status = F.when(F.col("__in_l").isNull(), ADDED).when(F.col("__in_r").isNull(), REMOVED)
    status = status.when(differ, MODIFIED).otherwise(UNCHANGED) if targets else status.otherwise(UNCHANGED)
    # a null key is a value like any other, so the side decides which key is shown
    cols = [F.when(F.col("__in_r").isNotNull(), F.col(f"__r{ri[k]}")).otherwise(F.col(f"__l{li[k]}")).alias(k) for k in keys]
    shown = [t for t in targets if t in ri or include_removed]
    for t in [*shown, *[d for d in display if d not in shown and d not in keys]]:
        if t in li:
            cols.append(F.col(f"__l{li[t]}").alias(f"{t}.left"))
        if t in ri:
            cols.append(F.col(f"__r{ri[t]}").alias(f"{t}.right"))
    out = j.select(*cols, status.alias(STATUS)).where(_c(STATUS) != UNCHANGED)
    nested = (T.ArrayType, T.StructType, T.MapType)
    orderable = [_c(k) for k in keys if not isinstance(out.schema[k].dataType, nested)]
    return TabularDiff(out.orderBy(*orderable) if orderable and ordered else out, s, keys, targets, left, right)


def _missing(rows: DataFrame, other: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows of `rows` whose `names` occur nowhere in `other` (null equals null), repeated rows once."""
    b = other.select(*[_c(c).alias(f"__o{i}") for i, c in enumerate(names)]).distinct()
    on = None
    for i, c in enumerate(names):
        same = _c(c).eqNullSafe(F.col(f"__o{i}"))
        on = same if on is None else on & same
    return rows.join(b, on, "left_anti").distinct()


def rows_added(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of `right` that `left` lacks, compared on the common columns, all columns of `right` shown."""
    common = schema_diff(left, right).common
    return _missing(right, left, common) if common else right.distinct()


def rows_removed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of `left` that `right` lacks."""
    return rows_added(right, left)


def columns_added(left: DataFrame, right: DataFrame) -> DataFrame:
    """The columns that only `right` has (an empty selection if none)."""
    return right.select(*[_c(c) for c in schema_diff(left, right).added])


def columns_removed(left: DataFrame, right: DataFrame) -> DataFrame:
    return columns_added(right, left)


def size_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Added and removed rows and columns by the tables' sizes alone, never below zero."""
    n = left.agg(F.count(F.lit(1)).alias("a")).withColumn("__k", F.lit(1)).join(right.agg(F.count(F.lit(1)).alias("b")).withColumn("__k", F.lit(1)), "__k")
    wa, wb = len(left.columns), len(right.columns)
    return n.select(
        F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("rows_added"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("rows_removed"),
        F.lit(max(wb - wa, 0)).cast("long").alias("columns_added"), F.lit(max(wa - wb, 0)).cast("long").alias("columns_removed"),
    )


def field_changes(left: DataFrame, right: DataFrame) -> list[dict]:
    """Schema diff by whole fields: added, removed and retyped with type names."""
    s = schema_diff(left, right)
    name = lambda df, c: to_name(df.schema[c].dataType, df.schema[c].metadata)
    out = [{"name": c, "status": ADDED, "dtype": name(right, c), "previous": None} for c in s.added]
    out += [{"name": c, "status": REMOVED, "dtype": None, "previous": name(left, c)} for c in s.removed]
    return out + [{"name": c, "status": MODIFIED, "dtype": name(right, c), "previous": name(left, c)} for c in s.common if name(left, c) != name(right, c)]


#: Unchanged lines shown before and after a change.
CONTEXT_BEFORE, CONTEXT_AFTER = 3, 2


#: Lines of both texts together up to which all lines are matched; in longer ones, lines that are there once on either side are anchors and only the gaps between them are matched.
MATCHED_LINES = 4000


def _line_opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Edit steps as of a sequence matcher; cost grows with the lines, not with their square, as long as gaps between anchors are short."""
    if len(a) + len(b) <= MATCHED_LINES:
        return difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    counts_a, counts_b = Counter(a), Counter(b)
    at_b = {x: j for j, x in enumerate(b) if counts_b[x] == 1 and counts_a[x] == 1}
    pairs = [(i, at_b[x]) for i, x in enumerate(a) if x in at_b]
    # the longest rising row of anchors, by patience sorting
    tops: list[int] = []
    top_of: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tops, j)
        tops[k : k + 1] = [j]
        top_of[k : k + 1] = [n]
        before.append(top_of[k - 1] if k else -1)
    chain, n = [], top_of[-1] if top_of else -1
    while n >= 0:
        chain.append(pairs[n])
        n = before[n]
    steps, i, j = [], 0, 0
    for ai, bj in [*reversed(chain), (len(a), len(b))]:
        gap_a, gap_b = a[i:ai], b[j:bj]
        if len(gap_a) + len(gap_b) <= MATCHED_LINES:
            part = difflib.SequenceMatcher(None, gap_a, gap_b, autojunk=False).get_opcodes()
        elif not gap_a or not gap_b:
            part = [("replace", 0, len(gap_a), 0, len(gap_b))]
        else:
            # a long gap without anchors: lines that repeat often are no starting points
            part = difflib.SequenceMatcher(None, gap_a, gap_b, autojunk=True).get_opcodes()
        steps += [(tag, i + x, i + y, j + u, j + v) for tag, x, y, u, v in part]
        if ai < len(a):
            steps.append(("equal", ai, ai + 1, bj, bj + 1))
        i, j = ai + 1, bj + 1
    return steps


def diff_lines(old: str | None, new: str | None) -> list[tuple[int, str, str]]:
    """(number, change, text) of the lines of a text diff; `...` stands between hunks. Null reads as empty."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    marked: list[tuple[str, str]] = []
    for tag, i1, i2, j1, j2 in _line_opcodes(a, b):
        if tag == "equal":
            marked += [(UNCHANGED, x) for x in a[i1:i2]]
        else:
            marked += [(REMOVED, x) for x in a[i1:i2]] + [(ADDED, x) for x in b[j1:j2]]
    changed = [i for i, (m, _) in enumerate(marked) if m != UNCHANGED]
    keep = sorted({k for i in changed for k in range(max(0, i - CONTEXT_BEFORE), min(len(marked), i + CONTEXT_AFTER + 1))})
    out, last = [], None
    for k in keep:
        if last is not None and k != last + 1:
            out.append((UNCHANGED, "..."))
        out.append(marked[k])
        last = k
    return [(i, m, t) for i, (m, t) in enumerate(out)]


def text_diff(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Line diff of two text columns of each row: `key`, line_no, change, text. Equal texts give no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, no, change, text = [], [], [], []
            for i, (x, y) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for n, m, t in diff_lines(x, y):
                    keys.append(i)
                    no.append(n)
                    change.append(m)
                    text.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(no, pa.int32()), pa.array(change, pa.string()), pa.array(text, pa.string())], [key, "line_no", "change", "text"])

    kind = pairs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("line_no", T.IntegerType()), T.StructField("change", T.StringType()), T.StructField("text", T.StringType())])
    return pairs.select(key, old, new).mapInArrow(run, schema)
