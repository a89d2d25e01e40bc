"""An editable table over immutable files: a snapshot plus a log of row edits, read as one DataFrame.

The base is never rewritten. Edits are appended as small files (row id, order, operation, values as
JSON, sequence number); reading joins the latest edits to the base by row id. The log is bounded by
the edits made, so it is broadcast when its measured size allows and shuffled otherwise. A small
pointer file names the base and the log in force; whatever replaces one of them is written beside it
first and comes into force by one atomic rename of the pointer. Sequence numbers are claimed by
creating a file that must not exist, so two writers never get the same one.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.types import from_name
from quern.operators.ordinal import with_ordinal
from quern.operators.pipeline import RESERVED
from quern.plans.sizing import sized_join

ID, ORD = "_row_id", "_row_ord"
INSERT, UPDATE, DELETE = "insert", "update", "delete"
#: Order number from which appended rows count on, and sequence numbers that one claim covers.
_APPENDED, _BATCH = 1 << 48, 1 << 20
_LOG = "row_id string, row_ord long, op string, body string, seq long"


class StagedError(ValueError):
    """An edit that the table does not allow."""


def overlay(base: DataFrame, log: DataFrame) -> DataFrame:
    """`base` (with its id and order columns) after the edits of `log`, in no particular order.

    Of several updates of one row the later ones win column by column; a deleted row is gone
    whatever else the log says of it; an inserted row may be updated. JSON null sets null, and a
    column that an update does not name stays as it is.
    """
    data = [f for f in base.schema.fields if f.name not in (ID, ORD)]
    shape = T.StructType([T.StructField(f.name, f.dataType, True) for f in data])
    dead = log.where(F.col("op") == DELETE).select(F.col("row_id").alias(ID)).distinct()
    edits = log.where(F.col("op") == UPDATE).select("row_id", "seq", F.from_json("body", shape).alias("v"), F.json_object_keys("body").alias("named"))
    last = [F.max(F.when(F.array_contains("named", f.name), F.struct("seq", F.col(f"v.`{f.name}`").alias("x")))).alias(f"u{i}") for i, f in enumerate(data)]
    changed = edits.groupBy(F.col("row_id").alias(ID)).agg(*last) if data else edits.select(F.col("row_id").alias(ID)).distinct()
    fresh = log.where(F.col("op") == INSERT).select(F.col("row_id").alias(ID), F.col("row_ord").alias(ORD), F.from_json("body", shape).alias("v")).select(ID, ORD, *[F.col(f"v.`{f.name}`").alias(f.name) for f in data])
    rows = base.select(ID, ORD, *[F.col(f"`{f.name}`") for f in data]).unionByName(fresh)
    rows = sized_join(rows, dead, ID, "left_anti")
    j = sized_join(rows, changed, ID, "left")
    return j.select(ID, ORD, *[F.when(F.col(f"u{i}").isNotNull(), F.col(f"u{i}.x")).otherwise(F.col(f"`{f.name}`")).alias(f.name) for i, f in enumerate(data)])


def batch_update(base: DataFrame, updates: DataFrame, key: str, keep_on_null: bool = False) -> DataFrame:
    """`base` with the columns of `updates` set where `key` matches; a key that `base` lacks, or that repeats, raises before anything is built.

    A null in `updates` sets null; with `keep_on_null` it leaves the value as it is. Null keys match nothing and raise.
    """
    bad = updates.groupBy(key).count().where("count > 1").limit(1).count()
    missing = updates.join(base.select(key), key, "left_anti").limit(1).count()
    if bad or missing:
        raise StagedError("an update names a row twice or a row that is not there")
    cols = [c for c in updates.columns if c != key]
    if unknown := [c for c in cols if c not in base.columns]:
        raise StagedError(f"no such columns: {', '.join(unknown)}")
    u = updates.select(key, F.lit(True).alias("__hit"), *[F.col(f"`{c}`").alias(f"__u_{c}") for c in cols])
    j = sized_join(base, u, key, "left")
    new = lambda c: F.coalesce(F.col(f"__u_{c}"), F.col(f"`{c}`")) if keep_on_null else F.when(F.col("__hit"), F.col(f"__u_{c}")).otherwise(F.col(f"`{c}`"))
    return j.select(*[new(c).alias(c) if c in cols else F.col(f"`{c}`") for c in base.columns])


class StagedTable:
    """A table under edit in a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    # --- life cycle

    @classmethod
    def index(cls, df: DataFrame, folder: str) -> StagedTable:
        """Take a snapshot of `df` with a stable id and order for every row; present reserved columns are replaced."""
        t = cls(df.sparkSession, folder)
        t._switch(base=t._written(with_ordinal(df.drop(*RESERVED), ORD).withColumn(ID, F.expr("uuid()"))), log=t._empty_log())
        return t

    def _path(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, name: str) -> None:
        p, fs = self._path(name)
        fs.delete(p, True)

    def _written(self, df: DataFrame) -> str:
        name = f"base-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def _empty_log(self) -> str:
        name = f"log-{uuid.uuid4().hex}"
        self.spark.createDataFrame([], _LOG).write.parquet(f"{self.folder}/{name}")
        return name

    def _pointer(self) -> dict:
        p, fs = self._path("current.json")
        if not fs.exists(p):
            raise StagedError(f"nothing is staged in {self.folder}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _switch(self, **new: str) -> None:
        """Put a base, a log or both into force. What they replace is removed at the switch after this one, so readers that began before it can end."""
        from quern.sources.files import _replace

        old = self._pointer() if self._path("current.json")[1].exists(self._path("current.json")[0]) else {"base": None, "log": None, "left": []}
        state = {**{k: old[k] for k in ("base", "log")}, **new, "left": [old[k] for k in new if old[k]]}
        name = f"current-{uuid.uuid4().hex}.tmp"
        p, fs = self._path(name)
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(state).encode()))
        finally:
            out.close()
        _replace(self.spark, f"{self.folder}/{name}", f"{self.folder}/current.json")
        for gone in old["left"]:
            self._delete(gone)

    def is_indexed(self) -> bool:
        p, fs = self._path("current.json")
        return fs.exists(p)

    def unindex(self) -> None:
        self._delete("")

    def restore(self) -> None:
        """Forget all edits of rows."""
        self._switch(log=self._empty_log())

    def reindex(self) -> None:
        """Fold the edits into a new base: rows keep their ids and order, deleted rows are gone for good."""
        self._rewrite(self.rows())

    # --- reading

    def _base(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self._pointer()['base']}")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).parquet(f"{self.folder}/{self._pointer()['log']}")

    def rows(self) -> DataFrame:
        """The table as it stands, with its id and order columns, unordered."""
        return overlay(self._base(), self._log())

    def ordered(self) -> DataFrame:
        """The table as it stands in its stable order, without the engine's columns."""
        return self.rows().orderBy(ORD).drop(ID, ORD)

    def get(self, row_id: str) -> DataFrame:
        return self.rows().where(F.col(ID) == row_id)

    def get_by_index(self, n: int) -> DataFrame:
        return self.rows().orderBy(ORD).offset(n).limit(1)

    # --- edits

    def _checked(self, values: Mapping[str, object]) -> dict:
        own = {k: v for k, v in values.items() if k not in RESERVED}
        known = set(self._base().columns)
        if unknown := [k for k in own if k not in known]:
            raise StagedError(f"no such columns: {', '.join(unknown)}")
        return own

    def _append(self, entries: Sequence[tuple]) -> None:
        self.spark.createDataFrame(list(entries), _LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/{self._pointer()['log']}")

    def _claim(self) -> int:
        """The next number that no writer has: a file of its name is created, which only one of several writers can do."""
        folder, fs = self._path("claims")
        fs.mkdirs(folder)
        taken = [int(name) for s in fs.listStatus(folder) if (name := s.getPath().getName()).isdigit()]
        n = max(taken, default=0) + 1
        while not self._created(f"claims/{n}"):
            n += 1
        # the highest number stays, so it is never given out again
        for old in sorted(taken)[:-64]:
            self._delete(f"claims/{old}")
        return n

    def _created(self, name: str) -> bool:
        """Make a file that must not be there yet; false if somebody else made it."""
        p, fs = self._path(name)
        if fs.getScheme() == "file":
            # the local file system looks first and creates then, which two writers can do at once
            try:
                os.close(os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                return False
            return True
        try:
            return fs.createNewFile(p)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise

    def append(self, values: Mapping[str, object]) -> DataFrame:
        """Add a row at the end (missing columns null); returns it."""
        row_id, n = str(uuid.uuid4()), self._claim()
        # behind every row of the base, in the order of the claims
        self._append([(row_id, _APPENDED + n, INSERT, json.dumps(self._checked(values), default=str), n * _BATCH)])
        return self.get(row_id)

    def _require(self, ids: Sequence[str]) -> None:
        want = self.spark.createDataFrame([(i,) for i in set(ids)], f"{ID} string")
        if want.join(self.rows().select(ID), ID, "left_anti").limit(1).count():
            raise StagedError("there is no such row")

    def update(self, row_id: str, values: Mapping[str, object]) -> DataFrame:
        """Set some columns of a row; only reserved columns change nothing; returns the row."""
        own = self._checked(values)
        self._require([row_id])
        if own:
            self._append([(row_id, None, UPDATE, json.dumps(own, default=str), self._claim() * _BATCH)])
        return self.get(row_id)

    def update_many(self, updates: Sequence[tuple[str, Mapping[str, object]]]) -> None:
        """Set columns of many rows; every id and column is checked before the first is written, and all are written at once."""
        checked = [(i, self._checked(v)) for i, v in updates]
        self._require([i for i, _ in checked])
        if len(checked) > _BATCH:
            raise StagedError(f"at most {_BATCH} updates at once; more go through batch_update")
        seq = self._claim() * _BATCH
        entries = [(i, None, UPDATE, json.dumps(v, default=str), seq + k) for k, (i, v) in enumerate(checked) if v]
        if entries:
            self._append(entries)

    def delete(self, row_id: str) -> list:
        """Remove a row; returns what it was."""
        self._require([row_id])
        gone = self.get(row_id).collect()
        self._append([(row_id, None, DELETE, "{}", self._claim() * _BATCH)])
        return gone

    # --- columns: a new snapshot, row ids and order kept

    def _rewrite(self, df: DataFrame) -> None:
        """A new base with an empty log; both come into force in one step."""
        self._switch(base=self._written(df), log=self._empty_log())

    def _has(self, name: str) -> bool:
        return name.lower() in {c.lower() for c in self._base().columns}

    def add_column(self, name: str, dtype: str) -> None:
        if self._has(name) or name.lower() in RESERVED:
            raise StagedError(f"there is a column {name!r} already")
        self._rewrite(self.rows().withColumn(name, F.lit(None).cast(from_name(dtype))))

    def drop_column(self, name: str) -> None:
        if not self._has(name) or name in RESERVED:
            raise StagedError(f"no column {name!r}")
        self._rewrite(self.rows().drop(name))

    def rename_column(self, old: str, new: str) -> None:
        if not self._has(old) or self._has(new):
            raise StagedError(f"cannot rename {old!r} to {new!r}")
        self._rewrite(self.rows().withColumnRenamed(old, new))

    def retype_column(self, name: str, dtype: str) -> None:
        """Cast a column; a value that does not fit raises."""
        if not self._has(name):
            raise StagedError(f"no column {name!r}")
        self._rewrite(self.rows().withColumn(name, F.col(f"`{name}`").cast(from_name(dtype))))

    # --- out

    def export(self, path: str, columns: Sequence[str] | None = None) -> str:
        """Write the table as it stands, in order, to a file of any kind."""
        from quern.sources.files import write_df

        out = self.ordered()
        return write_df(out.select(*columns) if columns else out, path)

    def changes(self) -> DataFrame:
        """`row_id` and status (added, modified, removed) of every row the log touches."""
        w = Window.partitionBy("row_id")
        log = self._log().withColumns({"ins": F.max((F.col("op") == INSERT).cast("int")).over(w), "del": F.max((F.col("op") == DELETE).cast("int")).over(w)})
        status: Column = F.when((F.col("ins") == 1) & (F.col("del") == 0), "added").when((F.col("ins") == 0) & (F.col("del") == 1), "removed").when(F.col("ins") == 0, "modified")
        return log.select("row_id", status.alias("status")).where(F.col("status").isNotNull()).distinct()
