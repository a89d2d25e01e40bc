"""Options of the transform pipeline, read from the short texts that a command line or a query string carries."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from urllib.parse import quote


class OptionError(ValueError):
    """An option text that cannot be read."""


@dataclass
class Options:
    """All options of the pipeline; unset ones do nothing. The pipeline's order is fixed, whatever the order here."""

    vstack: list[str] = field(default_factory=list)
    add_col: str | None = None
    add_col_at: int | None = None
    add_row: str | None = None
    filter: str | None = None
    sql: str | None = None
    randomize: bool = False
    seed: int | None = None
    unique: str | None = None
    unique_count: str | None = None
    sort: str | None = None
    reverse: bool = False
    columns: str | None = None
    rename: str | None = None
    take: str | None = None
    slice: str | None = None
    row: int | None = None
    page: int | None = None
    page_size: int | None = None
    head: int | None = None
    tail: int | None = None
    item: str | None = None
    output: str | None = None

    def applied(self) -> list[tuple[str, object]]:
        """The options that are set, in order."""
        return [(f.name, v) for f in fields(self) if (v := getattr(self, f.name)) is not None and v is not False and v != [] and v != ""]

    def any_transform(self) -> bool:
        return any(name not in ("output", "seed", "add_col_at") for name, _ in self.applied())

    def query_string(self) -> str:
        """The set options as URL parameters; lists are joined by commas."""
        text = lambda v: ",".join(v) if isinstance(v, list) else str(v).lower() if isinstance(v, bool) else str(v)
        return "&".join(f"{k}={quote(text(v), safe='')}" for k, v in self.applied())


def name_list(text: str) -> list[str]:
    """Names of a comma list, untrimmed; empty parts are left out."""
    return [x for x in text.split(",") if x]


def parse_slice(text: str) -> tuple[int, int]:
    """`a..b`: half-open, 0 <= a < b."""
    try:
        a, b = (int(x) for x in text.split(".."))
    except ValueError:
        raise OptionError(f"a slice is start..end, not {text!r}") from None
    if not 0 <= a < b:
        raise OptionError(f"a slice needs 0 <= start < end, not {text!r}")
    return a, b


def page_slice(page: int | None, size: int | None, default_size: int = 100) -> tuple[int, int]:
    """Rows of a 1-based page; page 0 reads as the first, and numbers stop at 64 bits."""
    n, k = max(1, page or 1), default_size if size is None else max(0, size)
    top = 2**63 - 1
    a = min(top, (n - 1) * k)
    return a, min(top, a + k)


def parse_take(text: str) -> list[int]:
    """Row numbers of a comma list, order and repeats kept; each is a whole number of 32 bits."""
    out = []
    for x in text.split(","):
        if not x.strip().isdigit() or int(x) >= 2**32:
            raise OptionError(f"{x!r} is no row number")
        out.append(int(x))
    return out


def parse_item(text: str) -> tuple[str, int]:
    """`column:row`."""
    name, sep, row = text.rpartition(":")
    if not sep or not name or not row.isdigit():
        raise OptionError(f"an item is column:row, not {text!r}")
    return name, int(row)


def parse_rename(text: str) -> tuple[str, str]:
    """`old:new`, neither empty."""
    old, sep, new = text.partition(":")
    if not sep or not old or not new or ":" in new:
        raise OptionError(f"a rename is old:new, not {text!r}")
    return old, new


def parse_add_col(text: str) -> tuple[str, str, str]:
    """`name:value:dtype`, exactly three parts."""
    parts = text.split(":")
    if len(parts) != 3 or not parts[0] or not parts[2]:
        raise OptionError(f"a column is name:value:dtype, not {text!r}")
    return parts[0], parts[1], parts[2]


def parse_row(text: str, width: int) -> dict[str, object] | list[str]:
    """A JSON object, or else a comma list of exactly `width` values."""
    try:
        obj = json.loads(text)
        if isinstance(obj, dict):
            return obj
    except ValueError:
        pass
    values = text.split(",")
    if len(values) != width:
        raise OptionError(f"the row has {len(values)} values, the table {width} columns")
    return values
