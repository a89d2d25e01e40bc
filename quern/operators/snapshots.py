"""What changed between consecutive full snapshots.

Snapshots are kept as one data set in the shared folder, range-partitioned and sorted by (snapshot,
key): every record stands at its own snapshot (new) and at each snapshot that follows it (old), so the
two sides of a comparison lie in the same range in the same order. A pass then streams over each range
with one pointer on the old and one on the new side, a batch at a time, compares what meets and emits
typed changes. Number of ranges: from the size of the data, not from the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.plans.scratch import cut
from quern.plans.sizing import partitions_for, sized_join

#: Rows that one step of the merge looks at.
MERGE_ROWS = 65_536


def first_parents(commits: DataFrame) -> DataFrame:
    """(commit_id, parent) of every snapshot that has one; null or empty `parent_ids` have none."""
    parent = F.get(F.col("parent_ids"), F.lit(0))
    return commits.select("commit_id", parent.alias("parent")).where(F.col("parent").isNotNull() & F.col("commit_id").isNotNull()).distinct()


def kept_snapshots(entries: DataFrame, parents: DataFrame, key: str, value: Column, version: Column) -> DataFrame:
    """__at, `key`, __new, v, x: records by the snapshot they are compared for, range-partitioned and sorted, in the shared folder.

    Within a snapshot, key and side the record that counts comes last.
    """
    parts = parents.select(F.col("commit_id").alias("__of"), F.col("commit_id").alias("__at"), F.lit(True).alias("__new")).union(
        parents.select(F.col("parent"), F.col("commit_id"), F.lit(False))
    )
    body = entries.select(F.col("commit_id").alias("__of"), F.col(key), version.alias("v"), value.alias("x"))
    played = sized_join(body, parts, "__of").drop("__of")
    # each record is moved about twice, once for either side
    return cut(played.repartitionByRange(partitions_for(entries, 2.0), "__at", key).sortWithinPartitions("__at", key, "__new", "v", "x"))


def _merged(at: pa.Array, key: pa.Array, new: np.ndarray, value: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, status) of the changes among sorted records that begin with a whole group: 0 added, 1 removed, 2 modified."""
    n = len(at)
    # where the (snapshot, key) begins, and where one side of it begins
    step = np.ones(n, bool)
    if n > 1:
        same = lambda c: pc.fill_null(pc.equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False) | (c.is_null().to_numpy(zero_copy_only=False)[1:] & c.is_null().to_numpy(zero_copy_only=False)[:-1])
        step[1:] = ~(same(at) & same(key))
    last = np.ones(n, bool)
    last[:-1] = step[1:] | (new[1:] != new[:-1])
    # the record that counts for a side is the last of it
    rows = np.flatnonzero(last)
    group = np.cumsum(step)[rows]
    alone = np.ones(len(rows), bool)
    meets = group[1:] == group[:-1]
    alone[1:] &= ~meets
    alone[:-1] &= ~meets
    old, young = rows[:-1][meets], rows[1:][meets]
    a, b = value.take(pa.array(old)), value.take(pa.array(young))
    equal = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
    changed = young[~equal]
    single = rows[alone]
    return np.concatenate([single, changed]), np.concatenate([np.where(new[single], 0, 1), np.full(len(changed), 2)]).astype(np.int64)


_STATUS = ("added", "removed", "modified")


def _stream(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Changes of one sorted range. The records of the last snapshot and key of a batch wait for the next, as more of them may follow."""
    held: pa.Table | None = None

    def told(t: pa.Table) -> pa.RecordBatch:
        at, key, value = (t.column(i).combine_chunks() for i in (0, 1, 3))
        row, status = _merged(at, key, t.column(2).to_numpy(), value)
        return pa.RecordBatch.from_arrays([at.take(pa.array(row)), key.take(pa.array(row)), pa.array(_STATUS).take(pa.array(status))], names)

    for whole in batches:
        for i in range(0, whole.num_rows, MERGE_ROWS):
            t = pa.Table.from_batches([whole.slice(i, MERGE_ROWS)])
            t = t if held is None else pa.concat_tables([held, t])
            n = t.num_rows
            end = [t.column(c)[n - 1].as_py() for c in (0, 1)]
            k = n - 1
            while k > 0 and [t.column(c)[k - 1].as_py() for c in (0, 1)] == end:
                k -= 1
            if n - k > 64:
                # of a key repeated very often only the last record of either side counts
                new = t.column(2).to_numpy()[k:]
                keep = [k + int(np.flatnonzero(new == side)[-1]) for side in (False, True) if (new == side).any()]
                held = t.take(pa.array(sorted(keep)))
            else:
                held = t.slice(k)
            if k:
                yield told(t.slice(0, k))
    if held is not None and held.num_rows:
        yield told(held)


def snapshot_changes(entries: DataFrame, parents: DataFrame, key: str, value: Column, version: Column) -> DataFrame:
    """Typed differences of each snapshot against the one before it: commit_id, `key`, status.

    `entries` holds commit_id, `key` and the columns behind `value` (what is compared, a text or a number; null equals
    only null) and `version` (of several records of one key in one snapshot the greatest version
    counts, null lowest; at equal versions the greater value, so the result is defined). `parents`
    holds commit_id and parent. status: added, removed or modified. Snapshots without records
    compare as empty; records of unknown snapshots are ignored.
    """
    kept = kept_snapshots(entries, parents, key, value, version)
    kind = {f.name: f.dataType for f in kept.schema.fields}
    names = ["commit_id", key, "status"]
    out = T.StructType([T.StructField("commit_id", kind["__at"]), T.StructField(key, kind[key]), T.StructField("status", T.StringType())])
    return kept.select("__at", key, "__new", "x").mapInArrow(lambda batches: _stream(batches, names), out)


def commit_changes(entries: DataFrame, commits: DataFrame) -> DataFrame:
    """`snapshot_changes` of commit entries: paths compare exactly, hashes without letter case, the latest `received_at` counts."""
    return snapshot_changes(entries, first_parents(commits), "path", F.lower(F.col("hash")), F.col("received_at"))


def change_counts(changes: DataFrame) -> DataFrame:
    """Changes per snapshot: commit_id, added, removed, modified."""
    return changes.groupBy("commit_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified")])
