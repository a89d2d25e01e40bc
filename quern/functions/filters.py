"""The filter mini-language: `field op value` clauses joined by && and ||, read strictly left to right.

`a && b || c` is (a and b) or c, and `a || b && c` is (a or b) and c: the connectives have one rank.
There are no quotes or parentheses; names and values are trimmed. Operators: != >= <= == > <.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.types import typed_literal

_CONNECTIVE = re.compile(r"&&|\|\|")
#: Looked for in this order, so ">=" is not read as ">".
OPERATORS = ("!=", ">=", "<=", "==", ">", "<")


class FilterError(ValueError):
    """A filter text that cannot be read."""


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    value: str


@dataclass(frozen=True)
class Filter:
    """Clauses and, between each two of them, "and" or "or"."""

    clauses: tuple[Clause, ...]
    links: tuple[str, ...]


def parse_filter(text: str) -> Filter:
    """Read a filter; an empty text, or a clause without operator or field, raises FilterError."""
    if not text or not text.strip():
        raise FilterError("the filter is empty")
    links = tuple("and" if m == "&&" else "or" for m in _CONNECTIVE.findall(text))
    clauses = []
    for part in _CONNECTIVE.split(text):
        op = next((o for o in OPERATORS if o in part), None)
        if op is None:
            raise FilterError(f"no operator in {part.strip()!r}")
        field, value = (x.strip() for x in part.split(op, 1))
        if not field:
            raise FilterError(f"no field in {part.strip()!r}")
        clauses.append(Clause(field, op, value))
    return Filter(tuple(clauses), links)


def column_of(df: DataFrame, name: str) -> str:
    """The schema's spelling of a column name (exact first, then without letter case); unknown names raise FilterError."""
    if name in df.columns:
        return name
    near = [c for c in df.columns if c.lower() == name.lower()]
    if len(near) != 1:
        raise FilterError(f"no column {name!r}; there are {', '.join(df.columns)}")
    return near[0]


def filter_column(df: DataFrame, parsed: Filter) -> Column:
    """The predicate on `df`, each value typed by its column."""

    def one(c: Clause) -> Column:
        name = column_of(df, c.field)
        left, right = F.col(f"`{name}`"), typed_literal(c.value, df.schema[name].dataType)
        return {"!=": left != right, ">=": left >= right, "<=": left <= right, "==": left == right, ">": left > right, "<": left < right}[c.op]

    first, *rest = (one(c) for c in parsed.clauses)
    return reduce(lambda acc, x: acc & x[1] if x[0] == "and" else acc | x[1], zip(parsed.links, rest), first)


def apply_filter(df: DataFrame, text: str) -> DataFrame:
    """Rows for which the filter is true; a comparison with null is not true."""
    return df.where(filter_column(df, parse_filter(text)))
