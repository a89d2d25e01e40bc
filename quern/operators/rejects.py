"""Raw delimited records: load the valid ones, set the others aside with the reason.

One anchored pattern per schema (columns, delimiter, quote) accepts a whole valid record. A record
that it refuses goes through incremental prefix patterns, one field longer each: the longest that
matches tells the first broken field, and what follows it tells the reason. All patterns use
possessive quantifiers: a record is read once without backtracking or recursion, so cells of any
length are safe. Files of one dialect share their patterns, which are literals in the plan and so
compiled once, not for every record; everything is a built-in expression, no Python sees a record.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.scratch import cut
from quern.plans.sizing import sized_join

#: Columns of each layout, and which of them hold whole numbers of 64 bits.
LAYOUTS: Mapping[str, Sequence[tuple[str, bool]]] = {
    "quoted_fields": (("name", False), ("description", False), ("value", True)),
    "tabs": (("file", False), ("label", False), ("x", True), ("y", True)),
}
BOM = "\ufeff"
#: Patterns that may stand in the plan as literals; with more dialects or wider ones the same patterns are columns, compiled for every record.
MOST_LITERALS = 512


def _escaped(c: str) -> str:
    """A character as a pattern that matches just it."""
    return f"\\x{{{ord(c):x}}}"


def whole_number_pattern(bits: int = 64) -> str:
    """Pattern of an optional sign and ASCII digits whose value fits: leading zeros do not count, and the longest numbers are compared digit by digit."""

    def up_to(top: str) -> str:
        # shorter numbers, then those of the same length that are smaller at some digit, then the top itself
        parts = [f"[0-9]{{1,{len(top) - 1}}}"]
        for i, digit in enumerate(top):
            low = 1 if i == 0 else 0
            if int(digit) > low:
                parts.append(f"{top[:i]}[{low}-{int(digit) - 1}][0-9]{{{len(top) - i - 1}}}")
        return f"(?:{'|'.join([*parts[1:], top, parts[0]])})(?![0-9])"

    most = 1 << (bits - 1)
    return f"(?:\\+?0*+{up_to(str(most - 1))}|-0*+{up_to(str(most))}|[+-]?0++(?![0-9]))"


class Dialect:
    """The patterns of one dialect: delimiter, quote, number of cells and which of them hold numbers. Their length does not grow with the number of cells."""

    def __init__(self, delim: str, quote: str, width: int, numbers: Sequence[int]) -> None:
        self.width, self.numbers = width, sorted(i for i in numbers if i < width)
        d, q = _escaped(delim), _escaped(quote)
        cell = f"(?:{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}|[^{d}{q}]*+)"
        n = whole_number_pattern()
        # a number cell: quoted or bare, empty or a whole number, with nothing around it
        number = f"(?:{q}{n}{q}|{q}{q}|{n}|)"
        known = [number if i in self.numbers else cell for i in range(self.numbers[-1] + 1)] if self.numbers else [cell]
        rest = width - len(known)
        end = f"(?:{d}|\\z)"
        #: A whole valid record; well-formed cells and nothing else.
        self.valid = f"\\A{d.join(known)}{f'(?:{d}{cell}){{{rest}}}' if rest else ''}\\z"
        self.cells = f"\\A{cell}(?:{d}{cell})*+\\z"
        #: In front of a number of further cells: the first n + 1 fields, each ended by a delimiter or the end, if `behind` follows it; with nothing behind them, if `\\z` does.
        self.start, self.behind = f"\\A{cell}(?:{d}{cell}){{", f"}}{end}"
        #: Up to each number field, numbers looked at.
        self.typed = ["\\A" + d.join(known[: i + 1]) + end for i in self.numbers]
        #: Around a number of cells: the cell after them, in group 1.
        self.before, self.one = f"\\A(?:{cell}{d}){{", f"}}({cell})"

    def prefix(self, n: int) -> str:
        return f"{self.start}{n - 1}{self.behind}"

    def whole(self, n: int) -> str:
        return f"{self.start}{n - 1}}}\\z"

    def cell(self, i: int) -> str:
        return f"{self.before}{i}{self.one}"


def dialects(records: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, layout, delim, quote, width, numbers per file; delimiter and cell count are read off the header.

    The header (line_no 1, byte order mark and one trailing carriage return dropped) shows the real
    delimiter: the character after the first column's name. Without a usable header the recorded
    delimiter counts, or else a comma; the cell count is then that of the layout. A null quote
    character reads as the double quote; files of unknown layout get no number columns.
    """
    header = records.where(F.col("line_no") == 1).groupBy("file_id").agg(F.max("raw").alias("__head"))
    f = files.groupBy("file_id").agg(F.max(F.struct("layout", "delimiter", "quote_char")).alias("f")).select("file_id", "f.*")
    j = f.join(header, "file_id", "left")
    first, names, numbers = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.array().cast("array<int>")
    for layout, columns in LAYOUTS.items():
        here = F.col("layout") == layout
        first = F.when(here, F.lit(columns[0][0])).otherwise(first)
        names = F.when(here, F.array(*[F.lit(n) for n, _ in columns])).otherwise(names)
        numbers = F.when(here, F.array(*[F.lit(i) for i, (_, number) in enumerate(columns) if number])).otherwise(numbers)
    head = F.regexp_replace(F.regexp_replace("__head", f"^{BOM}", ""), "\\r\\z", "")
    quote = F.coalesce(F.when(F.col("quote_char") != "", F.substring("quote_char", 1, 1)), F.lit('"'))
    bare = F.replace(head, quote, F.lit(""))
    j = j.select("file_id", "layout", "delimiter", names.alias("names"), numbers.alias("numbers"), quote.alias("quote"), bare.alias("__bare"), first.alias("__first"))
    shown = F.when(F.startswith(F.col("__bare"), F.col("__first")), F.expr("substring(__bare, length(__first) + 1, 1)"))
    d = F.coalesce(F.when(shown != "", shown), F.when(F.col("delimiter") != "", F.substring("delimiter", 1, 1)), F.lit(","))
    j = j.withColumn("delim", d)
    counted = F.length("__bare") - F.length(F.replace("__bare", F.col("delim"), F.lit(""))) + 1
    width = F.coalesce(F.when(F.col("__bare").isNotNull() & (F.col("__bare") != ""), counted), F.when(F.col("names").isNotNull(), F.size("names")), F.lit(1))
    return j.select("file_id", "layout", "delim", "quote", width.cast("int").alias("width"), "numbers")


def unquoted(cell: Column, quote: Column) -> Column:
    """A well-formed cell without its quotes."""
    return F.when(F.startswith(cell, quote), F.replace(F.substr(cell, F.lit(2), F.length(cell) - 2), F.concat(quote, quote), quote)).otherwise(cell)


def _matches(pattern: str | Column) -> Column:
    return F.regexp_like(F.col("__body"), F.lit(pattern) if isinstance(pattern, str) else pattern)


class _Literal:
    """What is asked of a record, with the patterns of every dialect as literals."""

    def __init__(self, known: Sequence[tuple[int, Dialect]]) -> None:
        self._known = known

    def _choose(self, of) -> Column:
        out = None
        for number, dialect in self._known:
            test, value = F.col("__dialect") == number, of(dialect)
            out = F.when(test, value) if out is None else out.when(test, value)
        return F.lit(None) if out is None else out

    def valid(self) -> Column:
        return self._choose(lambda x: _matches(x.valid)).cast("boolean")

    def cells(self) -> Column:
        return self._choose(lambda x: _matches(x.cells)).cast("boolean")

    def longest(self) -> Column:
        """How many leading fields are well formed, asked from the longest prefix down."""

        def of(x: Dialect) -> Column:
            out = F.lit(0)
            for n in range(1, x.width + 1):
                out = F.when(_matches(x.prefix(n)), n).otherwise(out)
            return out

        return self._choose(of).cast("int")

    def ends_behind(self, n: Column) -> Column:
        """Whether the record is `n` well-formed cells and nothing else."""

        def of(x: Dialect) -> Column:
            out = F.lit(False)
            for k in range(1, x.width + 1):
                out = F.when(n == k, _matches(x.whole(k))).otherwise(out)
            return out

        return self._choose(of).cast("boolean")

    def wrong_number(self) -> Column:
        """0-based place of the first number field up to which the typed prefix does not match."""

        def of(x: Dialect) -> Column:
            out = F.lit(None).cast("int")
            for i, pattern in reversed(list(zip(x.numbers, x.typed))):
                out = F.when(~_matches(pattern), i).otherwise(out)
            return out

        return self._choose(of).cast("int")

    def cell(self, i: int) -> Column:
        return self._choose(lambda x: F.regexp_extract("__body", x.cell(i), 1) if i < x.width else F.lit("")).cast("string")


class _Joined:
    """The same questions with the patterns as columns, for any number of dialects and cells."""

    def valid(self) -> Column:
        return _matches(F.col("p_valid"))

    def cells(self) -> Column:
        return _matches(F.col("p_cells"))

    def longest(self) -> Column:
        prefix = lambda n: F.concat(F.col("p_start"), (n - 1).cast("string"), F.col("p_behind"))
        held = F.transform(F.sequence(F.lit(1), F.col("width")), lambda n: F.when(_matches(prefix(n)), n))
        return F.coalesce(F.array_max(held), F.lit(0))

    def ends_behind(self, n: Column) -> Column:
        return (n > 0) & _matches(F.concat(F.col("p_start"), (F.greatest(n, F.lit(1)) - 1).cast("string"), F.lit("}\\z")))

    def wrong_number(self) -> Column:
        return F.array_min(F.transform(F.arrays_zip("p_numbers", "p_typed"), lambda x: F.when(~_matches(x["p_typed"]), x["p_numbers"])))

    def cell(self, i: int) -> Column:
        pattern = F.concat(F.col("p_before"), F.lit(str(i)), F.col("p_one"))
        return F.when(F.col("width") > i, F.call_function("regexp_extract", F.col("__body"), pattern, F.lit(1))).otherwise("")


_COLUMNS = "p_valid string, p_cells string, p_start string, p_behind string, p_before string, p_one string, p_numbers array<int>, p_typed array<string>"


def _with_patterns(shapes: DataFrame) -> DataFrame:
    """Each dialect with its patterns as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [Dialect(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            cols = [pa.array([getattr(x, n) for x in known], pa.string()) for n in ("valid", "cells", "start", "behind", "before", "one")]
            cols += [pa.array([x.numbers for x in known], pa.list_(pa.int32())), pa.array([x.typed for x in known], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *(c.split()[0] for c in _COLUMNS.split(", "))])

    return shapes.mapInArrow(run, f"delim string, quote string, width int, numbers array<int>, {_COLUMNS}")


def classify(records: DataFrame, files: DataFrame) -> tuple[DataFrame, _Literal | _Joined]:
    """Every record after the header with `__body`, `__whole` (leading well-formed fields, null where valid) and `reason` (null where valid), and the patterns.

    reason: quoting (a quoted cell is not closed or is followed by anything but a delimiter or the
    end, or a bare cell holds the quote character), else column_count (not as many cells as the
    header), else value (a number column is neither empty nor sign and digits within 64 bits). One
    trailing carriage return is dropped first. A null record, and a record of an unknown file, has
    no cells that could be counted: column_count. Records delivered twice count once.
    """
    # the headers are read once; what is kept has a row per file
    d = cut(dialects(records, files))
    shapes = d.select("delim", "quote", "width", "numbers").distinct()
    # only as many dialects reach the driver as fit the plan
    rows = shapes.limit(MOST_LITERALS // 8 + 1).collect()
    if sum(2 * r["width"] + 6 for r in rows) <= MOST_LITERALS:
        rows.sort(key=lambda r: (r["delim"], r["quote"], r["width"], r["numbers"]))
        number = F.lit(None).cast("int")
        for i, r in enumerate(rows):
            test = (F.col("delim") == r["delim"]) & (F.col("quote") == r["quote"]) & (F.col("width") == r["width"]) & (F.col("numbers") == F.lit(r["numbers"]).cast("array<int>"))
            number = F.when(test, i).otherwise(number)
        tagged = d.select("file_id", "quote", "width", number.alias("__dialect"))
        p: _Literal | _Joined = _Literal([(i, Dialect(r["delim"], r["quote"], r["width"], r["numbers"])) for i, r in enumerate(rows)])
    else:
        on = ["delim", "quote", "width", "numbers"]
        tagged = sized_join(d, cut(_with_patterns(shapes)), on).select("file_id", "quote", "width", F.lit(0).alias("__dialect"), *(c.split()[0] for c in _COLUMNS.split(", ")))
    body = records.select("file_id", "line_no", "raw").where(F.col("line_no") > 1).distinct()
    j = sized_join(body, tagged, "file_id", "left").withColumn("__body", F.regexp_replace("raw", "\\r\\z", ""))
    if "p_valid" in tagged.columns:
        p = _Joined()
    there = F.col("__body").isNotNull() & F.col("__dialect").isNotNull()
    j = j.withColumn("__whole", F.when(there & ~p.valid(), p.longest()))
    whole = F.col("__whole")
    # all fields are there: the record ends behind them (then a number is wrong), or more cells follow, well formed or not;
    # fewer are there: the record ends behind them, or the next cell is broken
    ends = p.ends_behind(whole)
    told = F.when(whole == F.col("width"), F.when(ends, "value").when(p.cells(), "column_count").otherwise("quoting")).when(ends, "column_count").otherwise("quoting")
    return j.withColumn("reason", F.when(~there, "column_count").when(whole.isNotNull(), told)), p


def rejected(records: DataFrame, files: DataFrame) -> DataFrame:
    """file_id, line_no, reason of the records that do not fit their file."""
    return classify(records, files)[0].where(F.col("reason").isNotNull()).select("file_id", "line_no", "reason")


def first_broken(records: DataFrame, files: DataFrame) -> DataFrame:
    """Rejected records with `field_no`, the 1-based field at which the growing prefix patterns stop matching.

    For a record whose cells are all well formed it is the first field too many or missing, or the
    first number field with a wrong value. A record without a known file breaks at its first field.
    """
    c, p = classify(records, files)
    c = c.where(F.col("reason").isNotNull())
    field = F.when(F.col("reason") == "value", p.wrong_number()).otherwise(F.coalesce("__whole", F.lit(0))) + 1
    return c.select("file_id", "line_no", "reason", field.cast("int").alias("field_no"))


def loaded(records: DataFrame, files: DataFrame) -> DataFrame:
    """The valid records: file_id, line_no, `text_1`, `text_2` and `number_1`, `number_2` (null where empty or absent).

    Both layouts hold two text columns followed by one or two numbers.
    """
    c, p = classify(records, files)
    c = c.where(F.col("reason").isNull())
    text = lambda i: unquoted(p.cell(i), F.col("quote"))
    number = lambda i: F.when(F.col("width") > i, text(i).try_cast("long"))
    return c.select("file_id", "line_no", text(0).alias("text_1"), text(1).alias("text_2"), number(2).alias("number_1"), number(3).alias("number_2"))
