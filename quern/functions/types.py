"""Type names and their Spark types, and literals typed by a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Canonical name of each scalar type. Unsigned types read as the next wider signed one.
NAMES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "i8": T.ByteType(),
    "i16": T.ShortType(),
    "i32": T.IntegerType(),
    "i64": T.LongType(),
    "u8": T.ShortType(),
    "u16": T.IntegerType(),
    "u32": T.LongType(),
    "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(),
    "f64": T.DoubleType(),
    "str": T.StringType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "duration": T.DayTimeIntervalType(),
    "null": T.NullType(),
}
#: Other spellings of them.
SPELLINGS = {"boolean": "bool", "int": "i32", "int8": "i8", "int16": "i16", "int32": "i32", "int64": "i64", "uint8": "u8", "uint16": "u16", "uint32": "u32", "uint64": "u64", "float": "f32", "float32": "f32", "double": "f64", "float64": "f64", "string": "str", "utf8": "str", "timestamp": "datetime", "blob": "binary"}
_LIST, _EMBEDDING = re.compile(r"list\[(.+)\]"), re.compile(r"embedding\[(\d+)\]")


class TypeNameError(ValueError):
    """A type name that stands for no type."""


def from_name(name: str) -> T.DataType:
    """Spark type of a type name such as `i64`, `list[str]`, `embedding[64]`; raises TypeNameError."""
    key = name.strip().lower()
    key = SPELLINGS.get(key, key)
    if key in NAMES:
        return NAMES[key]
    if m := _EMBEDDING.fullmatch(key):
        return T.ArrayType(T.FloatType())
    if m := _LIST.fullmatch(key):
        return T.ArrayType(from_name(m.group(1)))
    raise TypeNameError(f"unknown type name: {name!r}")


def to_name(kind: T.DataType, metadata: dict | None = None) -> str:
    """Canonical name of a Spark type; arrays whose metadata holds `vector_length` are embeddings."""
    if isinstance(kind, T.ArrayType):
        n = (metadata or {}).get("vector_length")
        return f"embedding[{n}]" if n else f"list[{to_name(kind.elementType)}]"
    if isinstance(kind, T.StructType):
        return "struct"
    if isinstance(kind, T.MapType):
        return "map"
    if isinstance(kind, T.DecimalType):
        return "u64" if kind == T.DecimalType(20, 0) else f"decimal({kind.precision},{kind.scale})"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    for name in ("bool", "i8", "i16", "i32", "i64", "f32", "f64", "str", "binary", "date", "null"):
        if isinstance(kind, type(NAMES[name])):
            return name
    if isinstance(kind, T.DayTimeIntervalType):
        return "duration"
    return "?"


def typed_literal(text: str | None, kind: T.DataType) -> Column:
    """`text` as a literal of `kind`; text that is no value of it raises ValueError. None is a typed null."""
    if text is None or isinstance(kind, T.NullType):
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit(text)
    if isinstance(kind, T.BooleanType):
        if text.strip().lower() not in ("true", "false"):
            raise ValueError(f"{text!r} is no bool")
        return F.lit(text.strip().lower() == "true")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(kind)]
        try:
            value = int(text)
        except ValueError:
            raise ValueError(f"{text!r} is no whole number") from None
        if not -(2 ** (bits - 1)) <= value < 2 ** (bits - 1):
            raise ValueError(f"{text!r} does not fit {bits} bits")
        return F.lit(value).cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        try:
            return F.lit(float(text)).cast(kind)
        except ValueError:
            raise ValueError(f"{text!r} is no number") from None
    # dates, times and decimals: the cast itself judges when it runs (it raises under ANSI rules)
    return F.lit(text).cast(kind)
