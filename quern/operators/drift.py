"""Schemas that drift between versions of a file.

All fields of two consecutive versions form two schema graphs: field nodes joined to their type,
their name parts, their neighbours and the field that they are nested in. Match scores start from
names, types and agreement of values and flood along the graphs' common edges until they settle
(similarity flooding); a greedy one-to-one selection on the settled scores gives the correspondences.
Each row's values never leave the executors: a field's column of values is summed into an order-free
fingerprint first, so the flooding only ever sees schema-sized input. Versions in which no field
vanishes or none appears have no correspondence to find and are told by names alone.
"""

from __future__ import annotations

import re
import warnings
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.scratch import cut
from quern.plans.sizing import sized_join

_TEXT = T.StringType()
_CHANGES = T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in ("name", "change", "old_name", "old_type", "type")]))

#: Spellings of one type.
TYPE_SPELLINGS = {"int64": "i64", "int32": "i32", "float64": "f64", "string": "str", "boolean": "bool"}
#: Types that a column of several types is read as, the later the wider.
WIDENING = ["bool", "i32", "i64", "f64", "str"]

#: Rounds after which flooding that has not settled is reported; the change below which it has settled.
FLOOD_ROUNDS = 1000
FLOOD_EPSILON = 1e-4


def type_name(c: Column) -> Column:
    """One spelling per type; unknown spellings stay as they are."""
    out = c
    for spelled, name in TYPE_SPELLINGS.items():
        out = F.when(c == spelled, name).otherwise(out)
    return out


def _parts(name: str) -> set[str]:
    return {p for p in re.split(r"[^0-9a-z]+|(?<=[a-z])(?=[0-9])", name.lower()) if p}


def _trigrams(name: str) -> set[str]:
    s = f"  {name.lower()} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def flood(old: list[dict], new: list[dict]) -> dict[tuple[int, int], float]:
    """Settled match scores of pairs (index in `old`, index in `new`) of fields.

    A field is a dict with name, type, no (its place) and print (fingerprint of its values, or
    None). Only pairs with something in common (a name part, a trigram-alike name or equal values
    of one type) become nodes; they are found through inverted lists, so no pair of unrelated
    fields is ever built. Each node's score flows to pairs that share its edges: equal types,
    shared name parts, neighbours by place, and fields nested in the same two fields (`a.b` lies in `a`).
    """
    by_print, by_part = defaultdict(list), defaultdict(list)
    for j, f in enumerate(new):
        if f["print"] is not None:
            by_print[(f["type"], f["print"])].append(j)
        for p in _parts(f["name"]):
            by_part[p].append(j)
    start: dict[tuple[int, int], float] = {}
    for i, f in enumerate(old):
        near = set(by_print[(f["type"], f["print"])]) if f["print"] is not None else set()
        same_values = set(near)
        for p in _parts(f["name"]):
            near.update(by_part[p])
        a = _trigrams(f["name"])
        for j in near:
            g = new[j]
            b = _trigrams(g["name"])
            start[(i, j)] = 0.4 * len(a & b) / len(a | b) + 0.2 * (f["type"] == g["type"]) + (1.0 if j in same_values else 0.0)
    if not start:
        return start
    edges: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for i, j in start:
        f, g = old[i], new[j]
        if f["type"] == g["type"]:
            edges[("type", f["type"])].append((i, j))
        for p in _parts(f["name"]) & _parts(g["name"]):
            edges[("part", p)].append((i, j))
        edges[("place", f["no"] - g["no"])].append((i, j))
        inside = (f["name"].rpartition(".")[0], g["name"].rpartition(".")[0])
        if all(inside):
            edges[("nested", *inside)].append((i, j))
    for i, j in start:
        # the pair of enclosing fields takes part in the flow among what they enclose
        if (key := ("nested", old[i]["name"], new[j]["name"])) in edges:
            edges[key].append((i, j))
    score = dict(start)
    for _ in range(FLOOD_ROUNDS):
        flow: dict[tuple[int, int], float] = defaultdict(float)
        for members in edges.values():
            share = sum(score[m] for m in members) / len(members) ** 2
            for m in members:
                flow[m] += share
        raised = {k: start[k] + score[k] + flow[k] for k in start}
        top = max(raised.values())
        raised = {k: v / top for k, v in raised.items()}
        moved = max(abs(raised[k] - score[k]) for k in raised)
        score = raised
        if moved < FLOOD_EPSILON:
            break
    else:
        warnings.warn(f"match scores of {len(old)} and {len(new)} fields have not settled", stacklevel=2)
    return score


def select_renames(old: list[dict], new: list[dict]) -> list[tuple[str, str]]:
    """One-to-one (old name, new name), best settled score first; then only those of one type with equal values stay.

    The exact check comes before a pair is taken, so a look-alike name cannot use up a field whose
    true partner scores lower. Equal scores go by names. A name that is in both corresponds to itself.
    """
    score = flood(old, new)
    both = {f["name"] for f in old} & {f["name"] for f in new}
    ranked = sorted(score, key=lambda k: (-score[k], old[k[0]]["name"], new[k[1]]["name"]))
    used_old, used_new, out = set(), set(), []
    for i, j in ranked:
        f, g = old[i], new[j]
        if f["name"] in both or g["name"] in both or i in used_old or j in used_new or f["type"] != g["type"] or f["print"] is None or f["print"] != g["print"]:
            continue
        used_old.add(i)
        used_new.add(j)
        out.append((f["name"], g["name"]))
    return out


@F.pandas_udf(_CHANGES)
def _changes(entries: pd.Series, prints: pd.Series) -> pd.Series:
    """All changes of a transition from its fields and the fingerprints of those that vanish or appear."""

    def of(fields, marks):
        by = {(m["name"], m["is_new"]): m["print"] for m in (marks if marks is not None else ())}
        sides = {False: [], True: []}
        for x in sorted(fields, key=lambda x: x["name"]):
            for is_new, side in ((False, x["o"]), (True, x["n"])):
                if side is not None:
                    moved = x["o"] is None or x["n"] is None
                    sides[is_new].append({"name": x["name"], "type": side["type"], "no": side["no"] or 0, "print": by.get((x["name"], is_new), "none") if moved else None})
        partner = {new: old for old, new in select_renames(sides[False], sides[True])}
        types = {is_new: {f["name"]: f["type"] for f in side} for is_new, side in sides.items()}
        renamed_away = set(partner.values())
        out = []
        for x in fields:
            name, was, now = x["name"], types[False].get(x["name"]), types[True].get(x["name"])
            if was is None:
                old = partner.get(name)
                out.append({"name": name, "change": "added" if old is None else "renamed", "old_name": old, "old_type": None if old is None else types[False][old], "type": now})
            elif now is None:
                if name not in renamed_away:
                    out.append({"name": name, "change": "removed", "old_name": name, "old_type": was, "type": None})
            elif was != now:
                out.append({"name": name, "change": "retyped", "old_name": name, "old_type": was, "type": now})
        return out

    return pd.Series([of(f, m) for f, m in zip(entries, prints)], dtype=object)


def clean_fields(fields: DataFrame) -> DataFrame:
    """One row per path, file_version and name with `type` in one spelling; rows without path, version or name are left out."""
    return (
        fields.where(F.col("path").isNotNull() & F.col("file_version").isNotNull() & F.col("name").isNotNull())
        .groupBy("path", "file_version", "name")
        .agg(F.max(F.struct("committed_at", "field_no", "dtype")).alias("f"))
        .select("path", "file_version", "name", F.col("f.field_no").alias("no"), F.coalesce(type_name(F.col("f.dtype")), F.lit("?")).alias("type"))
    )


def transitions(fields: DataFrame) -> DataFrame:
    """path, file_version, old_version, next_version: each existing version with its neighbours (null where there is none)."""
    w = Window.partitionBy("path").orderBy("file_version")
    return fields.select("path", "file_version").distinct().withColumns({"old_version": F.lag("file_version").over(w), "next_version": F.lead("file_version").over(w)})


def compared_fields(fields: DataFrame) -> DataFrame:
    """path, file_version, old_version and `fields` of each transition: name, o and n, the field (type, no) in the older and the later version, null where it is not there.

    Rows without path, version or name are left out; of several rows of a field the latest counts. A
    transition's list is bounded by the columns of its two versions.
    """
    known = fields.where(F.col("path").isNotNull() & F.col("file_version").isNotNull() & F.col("name").isNotNull())
    steps = cut(transitions(known))
    field = F.struct("committed_at", "field_no", "dtype")
    # every field plays in the transition to its version and in the one from it; repeated rows meet in the same sums
    roles = F.array(F.struct(F.col("old_version").alias("a"), F.col("file_version").alias("b"), F.lit(True).alias("is_new")), F.struct(F.col("file_version").alias("a"), F.col("next_version").alias("b"), F.lit(False).alias("is_new")))
    played = sized_join(known.select("path", "file_version", "name", field.alias("f")), steps, ["path", "file_version"]).select("path", "name", "f", F.inline(roles)).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    per = played.groupBy("path", F.col("b").alias("file_version"), "name").agg(F.max("a").alias("old_version"), F.max(F.when(~F.col("is_new"), F.col("f"))).alias("o"), F.max(F.when(F.col("is_new"), F.col("f"))).alias("n"))
    side = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.coalesce(type_name(F.col(f"{c}.dtype")), F.lit("?")).alias("type"), F.col(f"{c}.field_no").alias("no"))).alias(c)
    return per.groupBy("path", "file_version").agg(F.max("old_version").alias("old_version"), F.collect_list(F.struct("name", side("o"), side("n"))).alias("fields"))


def value_prints(records: DataFrame, moved: DataFrame) -> DataFrame:
    """path, file_version and `prints` (name, is_new, print): fingerprints of the values of fields that vanish or appear, over the rows present in both versions.

    `moved` holds path, file_version, old_version, gone (names) and come (names) of the transitions to look at.
    The print is a sum over rows of two independent 64-bit hashes of (row, value), with the row
    count: equal columns have equal prints whatever the order, and unequal ones collide with a
    chance near 2^-128. Rows are hashed where they are read; the one wide exchange brings the two
    versions of a row together by its key.
    """
    roles = moved.select("path", F.col("file_version").alias("at"), "file_version", F.col("come").alias("names"), F.lit(True).alias("is_new")).union(
        moved.select("path", "old_version", "file_version", "gone", F.lit(False))
    )
    rows = records.select("path", F.col("file_version").alias("at"), "row_key", "record")
    wide = sized_join(rows, roles, ["path", "at"]).withColumn("__m", F.from_json("record", "map<string,string>"))
    # a value is reduced to its two hashes before it is moved; an absent value is a null one
    valued = lambda n: F.coalesce(F.concat(F.lit("v"), F.try_element_at("__m", n)), F.lit("n"))
    hashes = F.transform("names", lambda n: F.struct(n.alias("name"), F.xxhash64("row_key", valued(n)).alias("h1"), F.xxhash64(F.lit("second"), valued(n), "row_key").alias("h2")))
    wide = wide.select("path", "file_version", "row_key", "is_new", hashes.alias("v"))
    both = wide.groupBy("path", "file_version", "row_key").agg(
        F.max(F.when(~F.col("is_new"), F.col("v"))).alias("o"), F.max(F.when(F.col("is_new"), F.col("v"))).alias("n")
    )
    both = both.where(F.col("o").isNotNull() & F.col("n").isNotNull())
    side = lambda c, is_new: F.transform(c, lambda x: F.struct(x["name"].alias("name"), F.lit(is_new).alias("is_new"), x["h1"].alias("h1"), x["h2"].alias("h2")))
    long = both.select("path", "file_version", F.inline(F.concat(side("o", False), side("n", True))))
    high = lambda h: F.sum(F.shiftright(h, 32)).cast("string")
    low = lambda h: F.sum(F.col(h).bitwiseAND(F.lit(0xFFFFFFFF))).cast("string")
    summed = long.groupBy("path", "file_version", "name", "is_new").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), high("h1"), low("h1"), high("h2"), low("h2")).alias("print"))
    return summed.groupBy("path", "file_version").agg(F.collect_list(F.struct("name", "is_new", "print")).alias("prints"))


def schema_changes(fields: DataFrame, records: DataFrame) -> DataFrame:
    """Each change between a version and the next existing one: path, file_version (the later), name, change, old_name, old_type, type.

    renamed: a field vanishes and another appears with the same type and the same value in every row
    present in both versions (null equals null; without common rows that holds of any values).
    Else added, removed (`name` is the old name) or retyped. Two fields that are each other's
    possible partners in several ways are matched one to one by their settled scores. A version
    that is only in `records` is no version. Empty tables give no changes.
    """
    # kept in the shared folder: three steps read it, and it is of the size of the schemas
    steps = cut(compared_fields(fields))
    names = lambda side: F.transform(F.filter("fields", lambda x: x[side].isNull()), lambda x: x["name"])
    moves = F.exists("fields", lambda x: x["o"].isNull()) & F.exists("fields", lambda x: x["n"].isNull())
    moved = steps.where(moves)
    prints = value_prints(records, moved.select("path", "file_version", "old_version", names("n").alias("gone"), names("o").alias("come")))
    at = ["path", "file_version"]
    flooded = moved.join(prints, at, "left").select(*at, F.inline(_changes("fields", "prints")))
    plain = steps.where(~moves).select(*at, F.inline("fields")).select(
        *at,
        "name",
        F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o.type") != F.col("n.type"), "retyped").alias("change"),
        F.when(F.col("o").isNotNull(), F.col("name")).alias("old_name"),
        F.col("o.type").alias("old_type"),
        F.col("n.type").alias("type"),
    )
    return flooded.unionByName(plain.where(F.col("change").isNotNull()))


def _last_names(clean: DataFrame, changes: DataFrame) -> DataFrame:
    """path, name, file_version, type, column: each field of each version with the last name in its chain of renames.

    A field under one name in versions without a gap is a life; a rename leads from one life to the
    next. Chains of lives are followed by pointers that double their length each round, so no file's
    history is ever brought together, and a chain of n renames takes about log n rounds.
    """
    w = Window.partitionBy("path", "name").orderBy("file_version")
    placed = sized_join(clean.select("path", "file_version", "name", "type"), cut(transitions(clean)), ["path", "file_version"])
    begins = F.when(F.lag("file_version").over(w).isNull() | ~F.lag("file_version").over(w).eqNullSafe(F.col("old_version")), F.col("file_version"))
    lived = cut(placed.withColumn("__b", begins).withColumn("born", F.max("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b"))
    ends = lived.groupBy("path", "name", "born").agg(F.max(F.struct("file_version", "next_version")).alias("e")).select("path", "name", "born", F.col("e.next_version").alias("at"))
    renames = changes.where(F.col("change") == "renamed").select("path", F.col("old_name").alias("name"), F.col("file_version").alias("at"), F.col("name").alias("to_name"), F.col("file_version").alias("to_born"))
    links = cut(ends.join(renames, ["path", "name", "at"]).select("path", "name", "born", "to_name", "to_born"))
    while True:
        far = links.select("path", F.col("name").alias("to_name"), F.col("born").alias("to_born"), F.col("to_name").alias("__n"), F.col("to_born").alias("__b"))
        longer = cut(links.join(far, ["path", "to_name", "to_born"], "left"))
        if longer.where(F.col("__n").isNotNull()).isEmpty():
            break
        links = longer.select("path", "name", "born", F.coalesce("__n", "to_name").alias("to_name"), F.coalesce("__b", "to_born").alias("to_born"))
    return sized_join(lived, links, ["path", "name", "born"], "left").select("path", "name", "file_version", "type", F.coalesce("to_name", "name").alias("column"))


def column_map(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """path, file_version, name, column, column_type: where each field of each version goes in the file's one table.

    `column` is the last name in the field's chain of renames, `column_type` the narrowest type that
    holds every type the column ever had.
    """
    typed = _last_names(clean_fields(fields), changes)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in WIDENING]), F.col("type")).cast("int"), F.lit(0))
    rank = F.when(rank == 0, len(WIDENING)).otherwise(rank)
    kinds = typed.groupBy("path", "column").agg(F.max(rank).alias("hi"), F.max(F.when(F.col("type") == "bool", 1).otherwise(0)).alias("b"))
    # a boolean beside a number has no common number type
    kind = F.when((F.col("b") == 1) & (F.col("hi") > 1), "str").otherwise(F.element_at(F.array(*[F.lit(t) for t in WIDENING]), F.col("hi")))
    return typed.join(kinds.select("path", "column", kind.alias("column_type")), ["path", "column"]).select("path", "file_version", "name", "column", "column_type")


def one_table(records: DataFrame, columns: DataFrame) -> DataFrame:
    """All records of a file as one consistent table: path, file_version, row_key, row (map of column to text in the column's type).

    Every record is renamed and cast by `column_map`; a value that its column's type cannot hold
    becomes null. Columns a version lacks are absent from its maps and read as null. Records
    delivered twice count once; records of versions without fields are left out.
    """
    maps = columns.groupBy("path", "file_version").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("column", "column_type")))).alias("cols"))
    rows = records.select("path", "file_version", "row_key", "record").distinct()
    j = sized_join(rows, maps, ["path", "file_version"]).withColumn("__m", F.from_json("record", "map<string,string>"))

    def cast(kind: Column, v: Column) -> Column:
        return (
            F.when(kind == "str", v)
            .when(kind == "i64", F.coalesce(v.try_cast("long"), v.try_cast("double").try_cast("long")).cast("string"))
            .when(kind == "i32", F.coalesce(v.try_cast("int"), v.try_cast("double").try_cast("int")).cast("string"))
            .when(kind == "f64", v.try_cast("double").cast("string"))
            .when(kind == "bool", v.try_cast("boolean").cast("string"))
        )

    entry = F.transform(F.map_entries("cols"), lambda e: F.struct(e["value"]["column"].alias("key"), cast(e["value"]["column_type"], F.try_element_at("__m", e["key"])).alias("value")))
    return j.select("path", "file_version", "row_key", F.map_from_entries(F.array_distinct(entry)).alias("row"))
