"""What is shown of tables: sizes, previews, pages, schemas and tables as text, differences of views and files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.types import to_name
from quern.operators import diff as D
from quern.operators.options import Options
from quern.operators.pipeline import run_pipeline

#: Rows of a preview.
PREVIEW_ROWS = 10


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows."""
    return df.limit(rows)


def table_size(df: DataFrame) -> DataFrame:
    """One row: width (columns) and height (rows)."""
    return df.agg(F.lit(len(df.columns)).cast("long").alias("width"), F.count(F.lit(1)).alias("height"))


def text_metadata(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, lines and chars (code points) of every text; a null text has none and is left out."""
    return df.where(F.col(text).isNotNull()).select(key, F.size(F.split(text, "\n")).cast("long").alias("lines"), F.char_length(text).cast("long").alias("chars"))


def json_valid(df: DataFrame, column: str, out: str = "valid") -> DataFrame:
    """All columns and whether the text of `column` is JSON; null is not."""
    return df.withColumn(out, F.col(column).isNotNull() & F.try_parse_json(column).isNotNull())


def retype_column(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """`column` cast to a type by its name; a value that does not fit raises when the plan runs."""
    from quern.functions.filters import column_of
    from quern.functions.types import from_name

    name = column_of(df, column)
    return df.withColumn(name, F.col(f"`{name}`").cast(from_name(dtype)))


def copy_table(df: DataFrame, numbered: bool = False) -> DataFrame:
    """The table as it is, with a row number from 0 if `numbered`."""
    from quern.operators.ordinal import with_ordinal

    return with_ordinal(df) if numbered else df.select("*")


def paginate(items: Sequence, number: int, size: int) -> tuple[list, int]:
    """(items of a 1-based page, pages in all) of a list; page 0 reads as the first, a size below 1 raises."""
    if size < 1:
        raise ValueError("a page holds at least one item")
    first = (max(1, number) - 1) * size
    return list(items[first : first + size]), -(-len(items) // size)


def paginate_dirs_first(dirs: Sequence, files: Sequence, number: int, size: int) -> tuple[list, list, int]:
    """(folders, files, pages) of a page over folders followed by files."""
    both, pages = paginate([(True, d) for d in dirs] + [(False, f) for f in files], number, size)
    return [x for is_dir, x in both if is_dir], [x for is_dir, x in both if not is_dir], pages


def schema_table(df: DataFrame) -> str:
    """The schema as a table of text: column and dtype."""
    rows = [("column", "dtype"), *((f.name, to_name(f.dataType, f.metadata)) for f in df.schema.fields)]
    wide = [max(len(r[i]) for r in rows) for i in (0, 1)]
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, wide)) + " |"
    return "\n".join([rule, line(rows[0]), rule, *map(line, rows[1:]), rule])


def pretty(df: DataFrame, rows: int = PREVIEW_ROWS, width: int = 40) -> str:
    """The first rows as a table of text, long cells cut at `width`; a table of one cell is that cell's plain text."""
    head = df.limit(rows + 1).collect()
    if len(df.columns) == 1 and len(head) == 1:
        return str(head[0][0])
    cell = lambda v: "null" if v is None else (s if len(s := str(v).replace("\n", "\\n")) <= width else s[: width - 1] + "…")
    body = [list(df.columns), [to_name(f.dataType, f.metadata) for f in df.schema.fields], *([cell(v) for v in r] for r in head[:rows])]
    wide = [max(len(r[i]) for r in body) for i in range(len(df.columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, wide)) + " |"
    out = [rule, line(body[0]), line(body[1]), rule, *map(line, body[2:]), rule]
    return "\n".join(out + (["..."] if len(head) > rows else []))


def view_diff(left: DataFrame, right: DataFrame) -> dict[str, DataFrame]:
    """Differences as a view shows them: added_rows and removed_rows, and where the columns differ also added_cols and removed_cols (rows then compare on the common columns)."""
    out = {"added_rows": D.rows_added(left, right), "removed_rows": D.rows_removed(left, right)}
    s = D.schema_diff(left, right)
    if s.added:
        out["added_cols"] = D.columns_added(left, right)
    if s.removed:
        out["removed_cols"] = D.columns_removed(left, right)
    return out


def diff_frame(diff: D.TabularDiff, options: Options) -> DataFrame:
    """A diff's contents through the transform pipeline (filter, sort, columns, pages, ...)."""
    return run_pipeline(diff.contents, options)


TABULAR = ("csv", "data", "tsv", "json", "jsonl", "ndjson", "parquet", "arrow")


def diff_files(spark: SparkSession, left: str, right: str, keys: Sequence[str] = (), targets: Sequence[str] = (), read: Callable[[SparkSession, str], DataFrame] | None = None) -> D.TabularDiff | DataFrame:
    """The diff of two files by what they are: tables by rows and cells, UTF-8 texts by lines; a mixture, or bytes that are no text, raises."""
    from quern.sources.files import FormatError, _head, extension, read_df

    kinds = [extension(p) in TABULAR for p in (left, right)]
    if all(kinds):
        a, b = ((read or read_df)(spark, p) for p in (left, right))
        return D.diff(a, b, keys, targets)
    if any(kinds):
        raise FormatError(f"cannot compare {left} with {right}")
    for p in (left, right):
        try:
            _head(spark, p).decode("utf-8", "strict")
        except UnicodeDecodeError as e:
            # a character may be cut at the end of the head
            if e.end < e.start + 1 or len(e.object) - e.start > 3:
                raise FormatError(f"{p} is no text") from None
    one = lambda p, name: spark.read.text(p, wholetext=True).select(F.lit(1).alias("file"), F.col("value").alias(name))
    return D.text_diff(one(left, "old").join(one(right, "new"), "file"), "file", "old", "new").drop("file")
