"""Differences between two copies of a dataset, cell by cell.

Both copies become rows of key, field, value and a signed count (-1 left, +1 right); grouped by key,
field and value, equal cells cancel, and what is left over is a difference. One exchange by key
brings the copies together. Before it a key's repeated rows become one row per side, and behind it
rows that are equal as a whole cancel as a whole, so only rows that differ somewhere are unpivoted:
the cells are grouped where they are, without a further exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.sizing import sized_join

ADDED, REMOVED, MODIFIED, WHOLE_ROW = "added", "removed", "modified", "*"


def cell_value(c: Column, kind: T.DataType) -> Column:
    """A value of any type in the one type that cells have: `num` for floating numbers, `text` for all else, null for null.

    Values are equal exactly where their cells are: the texts of whole numbers, times and booleans
    are unique, bytes are written in hexadecimal digits and nested values as JSON.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.struct(c.cast("double").alias("num"), F.lit(None).cast("string").alias("text"))
    if isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        text = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        text = F.when(c.isNotNull(), text)
    else:
        text = c.cast("string")
    return F.struct(F.lit(None).cast("double").alias("num"), text.alias("text"))


def signed_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """`keys`, field, value and n, the signed count of every cell that does not cancel.

    The key itself is a cell of field `*`, so a key of one side only is left over with its sign.
    """
    kinds = {f.name: f.dataType for f in left.schema.fields}
    named = [F.col(f"`{k}`") for k in keys]

    def side(df: DataFrame, sign: int) -> DataFrame:
        # a row without fields still is a row
        row = F.struct(F.lit(True).alias("there"), *[F.col(f"`{f}`").alias(f"c{i}") for i, f in enumerate(fields)])
        return df.select(*named, F.lit(sign).alias("__sign"), row.alias("__row"))

    # one row per key and side; partial sums before the exchange keep a key delivered any number of times small
    both = side(left, -1).unionByName(side(right, 1)).groupBy(*named).agg(
        F.max(F.when(F.col("__sign") < 0, F.col("__row"))).alias("__l"),
        F.max(F.when(F.col("__sign") > 0, F.col("__row"))).alias("__r"),
    )
    differing = both.where(~F.col("__l").eqNullSafe(F.col("__r")))

    def cells(row: str, sign: int) -> Column:
        own = [F.struct(F.lit(WHOLE_ROW).alias("field"), F.struct(F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("text")).alias("value"), F.lit(sign).alias("n"))]
        own += [F.struct(F.lit(f).alias("field"), cell_value(F.col(f"{row}.c{i}"), kinds[f]).alias("value"), F.lit(sign).alias("n")) for i, f in enumerate(fields)]
        return F.when(F.col(row).isNotNull(), F.array(*own)).otherwise(F.array().cast("array<struct<field:string,value:struct<num:double,text:string>,n:int>>"))

    unpivoted = differing.select(*named, F.inline(F.concat(cells("__l", -1), cells("__r", 1))))
    counted = unpivoted.groupBy(*named, "field", "value").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") != 0)


def diff_copies(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows missing on either side and fields that differ: the keys, `status` and `field`.

    `status` is added (key only in `right`, field `*`), removed (only in `left`, field `*`) or
    modified (one row per differing field). Null equals only null, in keys too, NaN equals NaN, and
    floating numbers within `tolerance` are equal: of the two cells left over for a field that are so
    close, each takes the other's count away (closeness is no grouping, so this step follows the
    cancelling). Rows delivered more than once in full count once; should one copy hold several
    different rows for a key, the greatest of them (fields compared in order, null lowest) stands
    for the key. Empty inputs give the other side's rows as added or removed; columns outside `keys`
    and `fields` are ignored.
    """
    named = [F.col(f"`{k}`") for k in keys]
    left_over = signed_cells(left, right, keys, fields)
    num = lambda sign: F.max(F.when(F.col("n") * sign > 0, F.col("value.num")))
    per_field = left_over.groupBy(*named, "field").agg(F.sum("n").alias("net"), num(-1).alias("a"), num(1).alias("b"))
    # a null or NaN on either side leaves the difference no number at most `tolerance`
    close = F.coalesce(F.abs(F.col("a") - F.col("b")) <= F.lit(tolerance), F.lit(False))
    found = per_field.where((F.col("net") != 0) | ~close)
    # a missing row is told by its key's cell; its other cells only repeat that
    status = F.when(F.col("field") != WHOLE_ROW, F.when(F.col("net") == 0, MODIFIED)).when(F.col("net") > 0, ADDED).otherwise(REMOVED)
    return found.select(*named, status.alias("status"), "field").where(F.col("status").isNotNull())


def rows_of_pairs(pairs: DataFrame, rows: DataFrame, pair_file: str, columns: Sequence[str]) -> DataFrame:
    """The rows of one copy that each pair names: `diff_id` and `columns`. A null name has no rows."""
    named = pairs.select("diff_id", F.col(pair_file).alias("__file")).where(F.col("__file").isNotNull()).distinct()
    body = rows.select(F.col("filename").alias("__file"), *columns).where(F.col("__file").isNotNull())
    return sized_join(body, named, "__file").drop("__file")


def diff_pairs(pairs: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """`diff_copies` for many pairs of files at once; keys are found per `diff_id`.

    `pairs` holds diff_id, filename1 (in `left`) and filename2 (in `right`); either name may be
    null (that side has no rows). A pair delivered twice counts once.
    """
    columns = [*keys, *fields]
    a = rows_of_pairs(pairs, left, "filename1", columns)
    b = rows_of_pairs(pairs, right, "filename2", columns)
    return diff_copies(a, b, ["diff_id", *keys], fields, tolerance)


def pair_row_counts(pairs: DataFrame, differences: DataFrame) -> DataFrame:
    """The right row counts of each pair beside the recorded ones: added, removed, modified (keys), recorded_ok.

    `differences` holds diff_id, key columns, status and field as `diff_pairs` gives them. A pair
    without differences gets zeros; `recorded_ok` is false where the recorded counts are null.
    """
    keys = [c for c in differences.columns if c not in ("status", "field")]
    per_key = differences.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))
    counted = per_key.groupBy("diff_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in (ADDED, REMOVED, MODIFIED)])
    recorded = pairs.groupBy("diff_id").agg(F.max("row_counts").alias("recorded"))
    out = recorded.join(counted, "diff_id", "left")
    n = {s: F.coalesce(F.col(s), F.lit(0)).cast("long") for s in (ADDED, REMOVED, MODIFIED)}
    right = F.lit(True)
    for s, c in n.items():
        right = right & F.coalesce(F.col(f"recorded.{s}") == c, F.lit(False))
    return out.select("diff_id", *[c.alias(s) for s, c in n.items()], right.alias("recorded_ok"))
