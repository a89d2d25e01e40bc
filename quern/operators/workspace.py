"""Staged tables by path: opening, listing, renaming and committing them against a manifest.

A manifest is a table of commit_id, path and hash. Committing writes the staged tables into a content
store and gives the new commit's manifest; a path that somebody else changed meanwhile is a conflict.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.filters import column_of
from quern.operators.graph import data_type
from quern.operators.pipeline import RESERVED, strip_reserved
from quern.operators.staged import ORD, StagedError, StagedTable
from quern.sources.files import _fs, extension, write_df


class CommitConflict(StagedError):
    """Paths that changed on the branch since they were staged."""


def frame_digest(df: DataFrame, order: str | None = None) -> str:
    """128 bits over a table's schema and rows, the same however the rows are partitioned; with `order` the place of each row counts too.

    Two independent 64-bit hashes of each row are summed, so copies count and no row is moved.
    """
    cols = [c for c in df.columns if c not in RESERVED]
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"}) if cols else F.lit("{}")
    place = F.col(order) if order else F.lit(0)
    parts = []
    for salt in ("a", "b"):
        h = F.xxhash64(F.lit(salt), place, body)
        parts += [F.coalesce(F.sum(F.shiftright(h, 32)), F.lit(0)).alias(f"{salt}h"), F.coalesce(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)).alias(f"{salt}l")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *parts).first()
    import hashlib

    shape = [(f.name, f.dataType.simpleString()) for f in df.schema.fields if f.name in cols]
    return hashlib.sha256(json.dumps([shape, [int(x) for x in row]]).encode()).hexdigest()[:32]


class Workspace:
    """Staged tables in a folder, each known by the path it will be committed under."""

    def __init__(self, spark: SparkSession, folder: str, base_commit: str | None = None) -> None:
        self.spark, self.folder, self.base_commit = spark, folder.rstrip("/"), base_commit

    def _index(self) -> dict[str, str]:
        p, fs = _fs(self.spark, f"{self.folder}/paths.json")
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _keep(self, index: Mapping[str, str]) -> None:
        from quern.sources.files import _replace

        name = f"{self.folder}/paths-{uuid.uuid4().hex}.tmp"
        p, fs = _fs(self.spark, name)
        fs.mkdirs(p.getParent())
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(dict(index)).encode()))
        finally:
            out.close()
        _replace(self.spark, name, f"{self.folder}/paths.json")

    def paths(self) -> list[str]:
        return sorted(self._index())

    def table(self, path: str) -> StagedTable:
        """The staged table of a path; one that is not staged raises."""
        found = self._index().get(path)
        if found is None:
            raise StagedError(f"{path} is not staged")
        return StagedTable(self.spark, f"{self.folder}/{found}")

    def find(self, path: str, commit: str | None = None) -> StagedTable | None:
        """The ready staged table of a path, if there is one and the workspace is pinned to `commit` (any where None)."""
        if commit is not None and commit != self.base_commit or path not in self._index():
            return None
        t = self.table(path)
        return t if t.is_indexed() else None

    def stage(self, path: str, df: DataFrame) -> StagedTable:
        """Index a table under a path; a path that is staged already keeps its edits."""
        if (t := self.find(path)) is not None:
            return t
        name = uuid.uuid4().hex
        t = StagedTable.index(df, f"{self.folder}/{name}")
        self._keep({**self._index(), path: name})
        return t

    def insert(self, path: str, values: Mapping[str, object]) -> DataFrame:
        """Append a row; a path that is not staged is created with this row as its first."""
        if path in self._index():
            return self.table(path).append(values)
        own = {k: v for k, v in values.items() if k not in RESERVED}
        if not own:
            raise StagedError("a new table needs a row with columns")
        extension(path)
        t = self.stage(path, self.spark.createDataFrame([tuple(own.values())], list(own)))
        return t.rows()

    def rename(self, path: str, new: str) -> None:
        """Move a staged table to another path; edits and row ids stay."""
        index = self._index()
        if path not in index or new in index:
            raise StagedError(f"cannot move {path} to {new}")
        extension(new)
        self._keep({(new if k == path else k): v for k, v in index.items()})

    def unstage(self, path: str) -> None:
        t = self.table(path)
        self._keep({k: v for k, v in self._index().items() if k != path})
        t.unindex()

    def listed(self, manifest: DataFrame, commit: str) -> DataFrame:
        """path, hash and is_indexed of the tabular files of a commit, by path."""
        own = manifest.where((F.col("commit_id") == commit) & (data_type(F.col("path")) == "tabular")).select("path", "hash").distinct()
        return own.withColumn("is_indexed", F.col("path").isin(self.paths())).orderBy("path")

    def commit(self, manifest: DataFrame, head: str, new_commit: str, store: str) -> DataFrame:
        """The manifest of `new_commit` (commit_id, path, hash): that of `head` with the staged tables in their place.

        A staged path whose hash in `head` is not its hash in the commit that the workspace is pinned
        to raises CommitConflict, before anything is written. Files already in the store are not
        written again. The workspace is then pinned to the new commit.
        """
        from quern.sources.versions import stored_path

        paths = self.paths()
        at = lambda c: {r["path"]: r["hash"] for r in manifest.where((F.col("commit_id") == c) & F.col("path").isin(paths)).select("path", "hash").distinct().collect()} if c and paths else {}
        then, now = at(self.base_commit), at(head)
        if clash := [p for p in paths if then.get(p) != now.get(p)]:
            raise CommitConflict(f"changed meanwhile: {', '.join(clash)}")
        made = []
        for p in paths:
            rows = self.table(p).rows()
            digest = frame_digest(rows, ORD)
            target = stored_path(store, digest, extension(p))
            q, fs = _fs(self.spark, target)
            if not fs.exists(q):
                fs.mkdirs(q.getParent())
                write_df(strip_reserved(rows.orderBy(ORD)), target)
            made.append((new_commit, p, digest))
        kept = manifest.where((F.col("commit_id") == head) & ~F.col("path").isin(paths)).select(F.lit(new_commit).alias("commit_id"), "path", "hash").distinct()
        self.base_commit = new_commit
        return kept.unionByName(self.spark.createDataFrame(made, "commit_id string, path string, hash string"))


def exported(df: DataFrame, columns: list[str] | None = None, json_columns: list[str] = ()) -> DataFrame:
    """What an export shows of a table: the named columns (all by default) without the engine's own; text in `json_columns` that is no JSON becomes a JSON string."""
    out = strip_reserved(df)
    wanted = [column_of(out, c) for c in columns] if columns else out.columns
    body = []
    for c in wanted:
        col = F.col(f"`{c}`")
        if c in json_columns:
            # a text is quoted by writing it as the one element of a list
            quoted = F.regexp_extract(F.to_json(F.array(col)), r"(?s)\A\[(.*)\]\z", 1)
            col = F.when(col.isNull() | F.try_parse_json(col).isNotNull(), col).otherwise(quoted).alias(c)
        body.append(col)
    return out.select(*body)
