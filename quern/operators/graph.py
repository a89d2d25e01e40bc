"""The version graph as tables: ancestry, common ancestors, tree differences, merges, roll-ups.

An edge table (child, parent) and a manifest (commit_id, path, hash, ...) are all there is; walks
double the length of their hops, everything else is a join or an aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.scratch import cut

#: Rows that the table of long hops may have at least, and for each edge; with more, walks go on hop by hop.
HOP_ROWS, HOPS_AN_EDGE = 1 << 20, 8


def edges_of(commits: DataFrame) -> DataFrame:
    """(child, parent) of every parent of every commit, repeated rows once."""
    return commits.select(F.col("commit_id").alias("child"), F.explode("parent_ids").alias("parent")).where(F.col("parent").isNotNull()).distinct()


def first_parent_edges(commits: DataFrame) -> DataFrame:
    """(child, parent) of first parents only."""
    p = F.get(F.col("parent_ids"), F.lit(0))
    return commits.select(F.col("commit_id").alias("child"), p.alias("parent")).where(F.col("parent").isNotNull()).distinct()


def hops(edges: DataFrame) -> tuple[DataFrame, int, bool]:
    """(a, b, d): all pairs at distance d up to a reach, the reach, and whether there are no farther ones.

    Each round doubles the reach: what lies farther than r is r steps away from something that is at
    most r away again. Rounds end when nothing new comes or the next one would exceed the bound
    (HOP_ROWS, or HOPS_AN_EDGE rows an edge), so a history of depth D takes about log D of them.
    """
    known = cut(edges.select(F.col("child").alias("a"), F.col("parent").alias("b"), F.lit(1).alias("d")).where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct())
    total = known.count()
    most, reach = max(HOP_ROWS, HOPS_AN_EDGE * total), 1
    while total * 2 <= most:
        far = known.where(F.col("d") == reach).select("a", F.col("b").alias("__m"))
        further = far.join(known.select(F.col("a").alias("__m"), "b", "d"), "__m").groupBy("a", "b").agg((F.min("d") + reach).cast("int").alias("d"))
        fresh = cut(further.join(known.select("a", "b"), ["a", "b"], "left_anti"))
        n = fresh.count()
        if not n:
            return known, reach, True
        known, reach, total = known.unionByName(fresh), 2 * reach, total + n
    return known, reach, False


def ancestors(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """head, commit_id, depth: every commit reachable from each head (itself at depth 0), least depth.

    `heads` holds `head`. The walk takes the longest hops that `hops` has: one join where they reach the
    end of the history, otherwise one for each reach of depth, from the commits at exactly that depth.
    What was seen is dropped, so cycles end and a commit reached twice counts once, at its least depth.
    No history is too long: the walk ends only when nothing new comes.
    """
    table, reach, complete = hops(edges)
    seen = cut(heads.select("head", F.col("head").alias("commit_id"), F.lit(0).alias("depth")).distinct())
    frontier, base = seen, 0
    while True:
        step = frontier.join(table, F.col("commit_id") == F.col("a")).groupBy("head", F.col("b").alias("commit_id")).agg((F.min("d") + base).cast("int").alias("depth"))
        step = step.join(seen.select("head", "commit_id"), ["head", "commit_id"], "left_anti")
        if complete:
            return seen.unionByName(step)
        step = cut(step)
        if step.isEmpty():
            return seen
        # a long walk's parts are put together, so that the plan does not grow
        seen, base = cut(seen.unionByName(step)), base + reach
        frontier = step.where(F.col("depth") == base)


def roots(commits: DataFrame) -> DataFrame:
    """commit_id of commits without a parent."""
    return commits.where(F.coalesce(F.size("parent_ids"), F.lit(0)) <= 0).select("commit_id").distinct()


def tips(commits: DataFrame) -> DataFrame:
    """commit_id of commits that are nobody's parent."""
    return commits.select("commit_id").distinct().join(edges_of(commits).select(F.col("parent").alias("commit_id")), "commit_id", "left_anti")


def exclusive(reach: DataFrame, base: str, head: str) -> DataFrame:
    """commit_id reachable from `head` and not from `base`; `reach` is `ancestors` of both."""
    a = reach.where(F.col("head") == head).select("commit_id")
    return a.join(reach.where(F.col("head") == base).select("commit_id"), "commit_id", "left_anti")


def symmetric(reach: DataFrame, base: str, head: str) -> DataFrame:
    """commit_id and side (base or head) of commits reachable from one of two commits only; `reach` is `ancestors` of both."""
    side = lambda a, b, name: exclusive(reach, b, a).select("commit_id", F.lit(name).alias("side"))
    return side(base, head, "base").union(side(head, base, "head"))


def symmetric_many(reach: DataFrame, pairs: DataFrame) -> DataFrame:
    """`symmetric` of many pairs at once: base, head, commit_id, side."""
    both = pairs.select("base", "head").distinct()
    sides = [both.join(reach.select(F.col("head").alias(of), "commit_id"), of).select("base", "head", "commit_id", F.lit(of == "base").alias("b")) for of in ("base", "head")]
    per = sides[0].union(sides[1]).groupBy("base", "head", "commit_id").agg(F.count(F.lit(1)).alias("n"), F.max("b").alias("b"))
    return per.where(F.col("n") == 1).select("base", "head", "commit_id", F.when(F.col("b"), "base").otherwise("head").alias("side"))


def history(commits: DataFrame, edges: DataFrame, heads: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """head, commit_id, position (from 0): all commits of each head's history, newest first, ids breaking ties.

    `stop` holds head and base: commits that are reachable from a head's base are left out, the base too.
    """
    walked = heads.select("head").distinct()
    if stop is not None:
        walked = walked.union(stop.select(F.col("base").alias("head"))).distinct()
    reach = ancestors(edges, walked)
    own = reach.join(heads.select("head").distinct(), "head", "left_semi").select("head", "commit_id")
    if stop is not None:
        reach = cut(reach)
        own = reach.join(heads.select("head").distinct(), "head", "left_semi").select("head", "commit_id")
        past = stop.join(reach.select(F.col("head").alias("base"), "commit_id"), "base").select("head", "commit_id")
        own = own.join(past, ["head", "commit_id"], "left_anti")
    when = commits.groupBy("commit_id").agg(F.max("committed_at").alias("committed_at"))
    w = Window.partitionBy("head").orderBy(F.desc_nulls_last("committed_at"), "commit_id")
    return own.join(when, "commit_id", "left").select("head", "commit_id", (F.row_number().over(w) - 1).alias("position"))


def first_parent_page(commits: DataFrame, heads: DataFrame, offset: int, limit: int) -> DataFrame:
    """head, commit_id, depth: commits `offset` to `offset + limit` of each head's line of first parents, the head itself first."""
    line = ancestors(first_parent_edges(commits), heads)
    return line.where((F.col("depth") >= offset) & (F.col("depth") < offset + limit))


def fast_forwards(reach: DataFrame, pairs: DataFrame) -> DataFrame:
    """base, head, fast_forward: whether each base is an ancestor of its head; `reach` holds the heads' ancestors."""
    found = reach.select("head", F.col("commit_id").alias("base"), F.lit(True).alias("__there"))
    return pairs.select("base", "head").distinct().join(found, ["base", "head"], "left").select("base", "head", F.coalesce("__there", F.lit(False)).alias("fast_forward"))


def common_ancestor(reach: DataFrame, commits: DataFrame, base: str, head: str) -> DataFrame:
    """One row at most: the common ancestor of least depth from `base`; ties go to the newest, then the lowest id."""
    a = reach.where(F.col("head") == base).select("commit_id", "depth")
    b = reach.where(F.col("head") == head).select("commit_id")
    when = commits.groupBy("commit_id").agg(F.max("committed_at").alias("committed_at"))
    return a.join(b, "commit_id", "left_semi").join(when, "commit_id", "left").orderBy("depth", F.desc_nulls_last("committed_at"), "commit_id").limit(1).select("commit_id", "depth")


def tree_diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """`key` and status of what differs between two manifests."""
    a, b = old.select(F.col(key).alias("__a"), F.col(value).alias("__x"), F.lit(True).alias("__l")), new.select(F.col(key).alias("__b"), F.col(value).alias("__y"), F.lit(True).alias("__r"))
    j = a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full_outer")
    status = F.when(F.col("__l").isNull(), "added").when(F.col("__r").isNull(), "removed").when(~F.col("__x").eqNullSafe(F.col("__y")), "modified")
    return j.select(F.when(F.col("__r").isNotNull(), F.col("__b")).otherwise(F.col("__a")).alias(key), status.alias("status")).where(F.col("status").isNotNull())


def common_ancestors(reach: DataFrame, commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """`common_ancestor` of many pairs at once: base, head, commit_id, depth. `pairs` holds base and head, `reach` the ancestors of all of them."""
    a = pairs.join(reach.select(F.col("head").alias("base"), "commit_id", "depth"), "base")
    both = a.join(reach.select("head", "commit_id"), ["head", "commit_id"], "left_semi")
    when = commits.groupBy("commit_id").agg(F.max("committed_at").alias("committed_at"))
    w = Window.partitionBy("base", "head").orderBy("depth", F.desc_nulls_last("committed_at"), "commit_id")
    return both.join(when, "commit_id", "left").withColumn("r", F.row_number().over(w)).where(F.col("r") == 1).select("base", "head", "commit_id", "depth")


def merge_classes(lca: DataFrame, base: DataFrame, merge: DataFrame, group: str | None = None) -> DataFrame:
    """path and decision of a three-way merge: keep, take, delete, or conflict; with `group`, of many merges at once.

    Inputs are manifests (`group`, path, hash) of the common ancestor, the base and the merged branch. What
    only the merged branch changed is taken (or deleted), what only the base changed stays, equal
    changes stay, different changes of one path are a conflict.
    """
    on = [group, "path"] if group else ["path"]
    side = lambda df, n: df.groupBy(*on).agg(F.max("hash").alias(n), F.lit(True).alias(f"in_{n}"))
    j = side(lca, "o").join(side(base, "b"), on, "full_outer").join(side(merge, "m"), on, "full_outer")
    has = {n: F.coalesce(F.col(f"in_{n}"), F.lit(False)) for n in "obm"}

    def same(x: str, y: str) -> Column:
        return (has[x] == has[y]) & F.col(x).eqNullSafe(F.col(y))

    decision = (
        F.when(same("b", "m"), F.when(has["b"], "keep"))
        .when(same("o", "b"), F.when(has["m"], "take").otherwise("delete"))
        .when(same("o", "m"), F.when(has["b"], "keep"))
        .otherwise("conflict")
    )
    return j.select(*on, decision.alias("decision")).where(F.col("decision").isNotNull())


def is_fast_forward(reach: DataFrame, base: str, head: str) -> DataFrame:
    """One row: whether `base` is an ancestor of `head`."""
    return reach.where((F.col("head") == head) & (F.col("commit_id") == base)).agg((F.count(F.lit(1)) > 0).alias("fast_forward"))


def path_history(entries: DataFrame, edges: DataFrame, commits: DataFrame) -> DataFrame:
    """commit_id, path of commits where a path's hash differs from its hash in some parent, or that have no parent.

    `entries` holds commit_id, path and hash, one row each.
    """
    e = entries.select("commit_id", "path", "hash")
    linked = edges.select(F.col("child").alias("commit_id"), "parent")
    old = e.select(F.col("commit_id").alias("parent"), "path", F.col("hash").alias("old"), F.lit(True).alias("there"))
    cmp = e.join(linked, "commit_id").join(old, ["parent", "path"], "left")
    changed = cmp.where(F.col("there").isNull() | ~F.col("hash").eqNullSafe(F.col("old"))).select("commit_id", "path")
    first = e.join(roots(commits), "commit_id", "left_semi").select("commit_id", "path")
    return changed.union(first).distinct()


#: Kind of a file by its extension.
KINDS = {
    "tabular": ("csv", "tsv", "parquet", "arrow", "json", "jsonl", "ndjson"),
    "text": ("txt", "md", "rst", "html", "xml", "yaml", "yml", "toml", "py"),
    "image": ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tiff"),
    "video": ("mp4", "avi", "mov", "mkv", "webm"),
    "audio": ("wav", "mp3", "flac", "ogg", "m4a"),
}


def data_type(path: Column) -> Column:
    """Kind of a file: tabular, text, image, video, audio or binary."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("binary")
    for kind, exts in KINDS.items():
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return out


def dir_rollup(files: DataFrame, group: str = "commit_id") -> DataFrame:
    """`group`, dir, data_type, files, bytes: every file counted in each folder above it ('' is the root).

    Partial sums are made before the exchange, so a folder that holds a third of all files is a few rows per task.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.call_function("array_join", F.slice(parts, 1, i), F.lit("/")))
    return files.select(group, F.explode(folders).alias("dir"), data_type(F.col("path")).alias("data_type"), "num_bytes").groupBy(group, "dir", "data_type").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("num_bytes"), F.lit(0)).alias("bytes"))


def children(files: DataFrame, folder: str, group: str = "commit_id") -> DataFrame:
    """`group`, name, is_dir, files, bytes: what lies directly in a folder."""
    prefix = f"{folder.strip('/')}/" if folder.strip("/") else ""
    inside = files.where(F.startswith("path", F.lit(prefix))) if prefix else files
    rest = F.substring("path", len(prefix) + 1, 2**31 - 1)
    name = F.substring_index(rest, "/", 1)
    return inside.select(group, name.alias("name"), (F.instr(rest, "/") > 0).alias("is_dir"), "num_bytes").groupBy(group, "name", "is_dir").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("num_bytes"), F.lit(0)).alias("bytes"))


def listing(files: DataFrame, folder: str = "", depth: int = 1, group: str = "commit_id") -> DataFrame:
    """`group`, path, is_dir, depth, files, bytes: files and folders up to `depth` levels below a folder, depth 1 being directly in it."""
    prefix = f"{folder.strip('/')}/" if folder.strip("/") else ""
    inside = files.where(F.startswith("path", F.lit(prefix))) if prefix else files
    parts = F.split(F.substring("path", len(prefix) + 1, 2**31 - 1), "/")
    levels = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))
    at = F.transform(levels, lambda i: F.struct(F.concat(F.lit(prefix), F.call_function("array_join", F.slice(parts, 1, i), F.lit("/"))).alias("path"), (i < F.size(parts)).alias("is_dir"), i.alias("depth")))
    long = inside.select(group, F.inline(at), "num_bytes")
    return long.groupBy(group, "path", "is_dir", "depth").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("num_bytes"), F.lit(0)).alias("bytes"))


def entry_order(by: str = "path", reverse: bool = False) -> list[Column]:
    """Order of a listing: folders first, then by a column (turned round with `reverse`), then by path."""
    return [F.col("is_dir").desc(), F.col(by).desc_nulls_last() if reverse else F.col(by).asc_nulls_first(), F.col("path").asc()]


def paged_listing(entries: DataFrame, number: int, size: int, by: str = "path", reverse: bool = False, group: str = "commit_id") -> DataFrame:
    """Page `number` (1-based) of each group's listing in `entry_order`, with position (from 0) and pages, how many there are."""
    w = Window.partitionBy(group).orderBy(*entry_order(by, reverse))
    placed = entries.withColumns({"position": F.row_number().over(w) - 1, "pages": F.ceil(F.count(F.lit(1)).over(Window.partitionBy(group)) / size).cast("int")})
    first = (max(1, number) - 1) * size
    return placed.where((F.col("position") >= first) & (F.col("position") < first + size))


def dir_diff(old: DataFrame, new: DataFrame, group: str = "commit_id") -> DataFrame:
    """`group`, dir, status of folders ('' is the root) whose files differ between two manifests (`group`, path, hash), nested ones included.

    A folder's content is a 128-bit sum over the paths and hashes below it, so no folder's files are ever brought together.
    """

    def folders(df: DataFrame) -> DataFrame:
        parts = F.split("path", "/")
        at = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.call_function("array_join", F.slice(parts, 1, i), F.lit("/")))
        sums = [F.sum(part).alias(f"s{i}") for i, part in enumerate([half for salt in ("a", "b") for h in [F.xxhash64(F.lit(salt), "path", F.coalesce("hash", F.lit("")), F.col("hash").isNull())] for half in (F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))])]
        return df.withColumn("dir", F.explode(at)).groupBy(group, "dir").agg(F.count(F.lit(1)).alias("n"), *sums).select(group, "dir", F.struct("n", "s0", "s1", "s2", "s3").alias("mark"))

    a, b = folders(old).withColumnRenamed("mark", "a"), folders(new).withColumnRenamed("mark", "b")
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return a.join(b, [group, "dir"], "full_outer").select(group, "dir", status.alias("status")).where(F.col("status").isNotNull())


def uniform_type(files: DataFrame, group: str = "commit_id") -> DataFrame:
    """`group`, uniform: whether all files are of one kind."""
    return files.groupBy(group).agg((F.count_distinct(data_type(F.col("path"))) == 1).alias("uniform"))


def type_totals(files: DataFrame, group: str) -> DataFrame:
    """`group`, data_type, files, bytes."""
    return files.groupBy(group, data_type(F.col("path")).alias("data_type")).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("num_bytes"), F.lit(0)).alias("bytes"))


def schemas_of(fields: DataFrame, versions: DataFrame) -> DataFrame:
    """path, file_version, schema: the flat schema (`a:str,b:i64`, by place and name) of each file version asked for.

    `fields` holds path, file_version, field_no, name and dtype; `versions` path and file_version. Of several rows of a field the latest counts.
    """
    from quern.operators.drift import type_name

    one = fields.where(F.col("name").isNotNull()).groupBy("path", "file_version", "name").agg(F.max(F.struct("committed_at", "field_no", "dtype")).alias("f"))
    own = one.join(versions.select("path", "file_version").distinct(), ["path", "file_version"], "left_semi")
    entry = F.struct(F.col("f.field_no").alias("no"), "name", F.coalesce(type_name(F.col("f.dtype")), F.lit("?")).alias("type"))
    # a list is bounded by the columns of one version
    listed = own.groupBy("path", "file_version").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    return listed.select("path", "file_version", F.call_function("array_join", F.transform("x", lambda e: F.concat(e["name"], F.lit(":"), e["type"])), F.lit(",")).alias("schema"))


def unreachable(stored: DataFrame, entries: DataFrame, live: DataFrame) -> DataFrame:
    """hash of `stored` that no entry of a live commit uses (mark and sweep)."""
    used = entries.join(live.select("commit_id").distinct(), "commit_id", "left_semi").select("hash")
    return stored.select("hash").where(F.col("hash").isNotNull()).distinct().join(used, "hash", "left_anti")


def glob_pattern(glob: str) -> str:
    """A path glob as an anchored regular expression: * and ? within a folder, ** across folders, [..] and {a,b}."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i:]:
            j = glob.index("]", i)
            inner = glob[i + 1 : j]
            out += "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]"
            i = j
        elif c == "{" and "}" in glob[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in ".^$+()|\\{}[]" else c
        i += 1
    return f"\\A{out}\\z"


def match_paths(files: DataFrame, glob: str) -> DataFrame:
    return files.where(F.regexp_like("path", F.lit(glob_pattern(glob))))


def bucketed(files: DataFrame, size: int = 10_000, group: str = "commit_id") -> DataFrame:
    """Files with `bucket`, a hash bucket of their group such that buckets hold about `size` paths."""
    n = files.groupBy(group).agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).alias("__n"))
    return files.join(n, group).withColumn("bucket", F.pmod(F.xxhash64("path"), F.col("__n"))).drop("__n")


def chunks(texts: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """`key`, no, digest: fixed-size chunks of a text with their hashes, for finding stored blocks again."""
    n = F.ceil(F.length(text) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return texts.where(F.col(text).isNotNull()).select(key, text, F.explode(at).alias("no")).select(key, "no", F.sha2(F.substr(F.col(text), F.col("no") * size + 1, F.lit(size)), 256).alias("digest"))


def latest_entries(entries: DataFrame) -> DataFrame:
    """commit_id, path, hash (lower case), num_bytes: of repeated records of one path in one snapshot the latest received."""
    body = F.struct("received_at", F.lower("hash").alias("hash"), "num_bytes")
    return entries.groupBy("commit_id", "path").agg(F.max(body).alias("b")).select("commit_id", "path", "b.hash", "b.num_bytes")


def newest_first(commits: DataFrame) -> DataFrame:
    """commit_id, position per repo and branch, newest first, ids breaking ties."""
    one = commits.groupBy("commit_id").agg(F.max("repo").alias("repo"), F.max("branch").alias("branch"), F.max("committed_at").alias("committed_at"))
    w = Window.partitionBy("repo", "branch").orderBy(F.desc_nulls_last("committed_at"), "commit_id")
    return one.select("repo", "branch", "commit_id", F.row_number().over(w).alias("position"))
