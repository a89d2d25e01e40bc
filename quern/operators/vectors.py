"""Exact similarity search over an embedding column, in built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIMILARITY = "similarity"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for null, empty, all-zero or unequally long vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def vector_length(df: DataFrame, column: str) -> int:
    """The one length of all vectors of a column; none, or several, raise."""
    r = df.agg(F.min(F.size(column)).alias("a"), F.max(F.size(column)).alias("b")).first()
    if r["a"] is None or r["a"] != r["b"] or r["a"] < 1:
        raise ValueError(f"{column!r} has no single vector length ({r['a']}..{r['b']})")
    return int(r["a"])


def index_column(df: DataFrame, column: str) -> DataFrame:
    """The column as array<float> with its length in its metadata, after checking every row."""
    n = vector_length(df, column)
    return df.withColumn(column, F.col(column).cast("array<float>")).withMetadata(column, {"vector_length": n})


class PredicateError(ValueError):
    """A predicate that is no plain condition on the table's columns."""


def checked(df: DataFrame, predicate: str) -> DataFrame:
    """The rows of `df` that meet a predicate in SQL, after it was read as nothing but one.

    It may name the columns bare or as `df.column`; unknown names, words without quotes, other tables,
    subqueries, further clauses and functions that do more than compute raise PredicateError.
    """
    from quern.operators import dialect
    from quern.operators.sql import QueryError, query

    parts = [t for t in dialect.tokens(predicate) if t.kind != "space"]
    depth = 0
    for t in parts:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == ";" or depth < 0 or t.low in ("select", "with", "from", "union", "order", "group", "limit", "window", "qualify", "having") or "--" in t.text and t.kind != "text":
            raise PredicateError(f"{t.text!r} cannot be part of a condition")
    if not parts or depth:
        raise PredicateError("there is no condition" if not parts else "a bracket is not closed")
    names = {c.lower() for c in df.columns}
    for i, t in enumerate(parts):
        if t.kind == "text" and t.text[0] == '"' and t.text[1:-1].lower() not in names:
            raise PredicateError(f"no column {t.text}")
        if t.text == "." and not (i and parts[i - 1].low == "df"):
            raise PredicateError("a column is named bare or as df.column")
    try:
        out = query(df, f"select * from df where ({predicate})")
        out.schema  # noqa: B018 - names are resolved here
        return out
    except QueryError as e:
        raise PredicateError(str(e)) from None


def average_embedding(df: DataFrame, column: str, decimals: int | None = None) -> DataFrame:
    """i and mean: the element-wise mean of all vectors, null ones left out; `decimals` rounds it."""
    mean = F.avg(F.col("x").cast("double"))
    return df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg((mean if decimals is None else F.round(mean, decimals)).alias("mean"))


def mean_vector(df: DataFrame, column: str, condition: Column | str | None = None) -> list[float] | None:
    """Element-wise mean over all rows that meet the condition (null vectors left out); None if there are none. A text is `checked`."""
    rows = df if condition is None else checked(df, condition) if isinstance(condition, str) else df.where(condition)
    got = sorted((r["i"], r["mean"]) for r in average_embedding(rows, column).collect())
    return [m for _, m in got] or None


def similarity_to(df: DataFrame, column: str, vector: Sequence[float], out: str = SIMILARITY) -> DataFrame:
    """All columns and the cosine similarity to `vector`."""
    fixed = F.array(*[F.lit(float(x)) for x in vector])
    return df.withColumn(out, cosine(F.col(column), fixed))


def nearest(df: DataFrame, column: str, vector: Sequence[float], k: int, offset: int = 0, ties: Sequence[str] = (), out: str = SIMILARITY) -> DataFrame:
    """Rows `offset` to `offset + k` by falling similarity, equal ones by `ties`; rows without a similarity come last."""
    ranked = similarity_to(df, column, vector, out).orderBy(F.col(out).desc_nulls_last(), *ties)
    return ranked.offset(offset).limit(k) if offset else ranked.limit(k)


def search(df: DataFrame, sql: str | None = None, where: str | None = None, embedding: Sequence[float] | None = None, column: str | None = None, page: int = 1, page_size: int = 10, ties: Sequence[str] = (), out: str = SIMILARITY) -> DataFrame:
    """One way in for all queries: SQL over view `df`, or rows by similarity to a vector, or to the mean of the rows that meet a predicate.

    Exactly one of `sql`, `where` and `embedding` is given; the last two need the embedding `column`. A
    predicate that no row meets raises.
    """
    from quern.operators.options import page_slice
    from quern.operators.sql import page as paged
    from quern.operators.sql import query

    if sum(x is not None for x in (sql, where, embedding)) != 1:
        raise ValueError("give one of sql, where and embedding")
    if sql is not None:
        return paged(query(df, sql), page, page_size)
    if column is None:
        raise ValueError("similarity needs the embedding column")
    vector = embedding if embedding is not None else mean_vector(df, column, where)
    if vector is None:
        raise PredicateError("no row meets the condition")
    first, end = page_slice(page, page_size)
    return nearest(df, column, vector, end - first, first, ties, out)


def index_states(df: DataFrame, asked: Mapping[str, str] | None = None) -> DataFrame:
    """column, length, status of every column that could be an embedding: complete (all its vectors have one length), failed (they differ) or not_indexed (no vectors).

    `asked` overrides the status of columns whose indexing is under way.
    """
    from pyspark.sql import types as T

    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType))]
    row = df.agg(*[x for i, n in enumerate(names) for x in (F.min(F.size(F.col(f"`{n}`"))).alias(f"a{i}"), F.max(F.size(F.col(f"`{n}`"))).alias(f"b{i}"))]).first() if names else None
    rows = []
    for i, n in enumerate(names):
        a, b = row[f"a{i}"], row[f"b{i}"]
        state = "not_indexed" if b is None or b < 1 else "complete" if a == b else "failed"
        rows.append((n, b if state == "complete" else None, (asked or {}).get(n, state)))
    return df.sparkSession.createDataFrame(rows, "column string, length int, status string")
