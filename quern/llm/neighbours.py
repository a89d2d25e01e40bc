"""The most similar vectors of every vector.

Vectors of one direction (equal, or exactly scaled) are one point of the index, so a direction that a
third of the rows share is indexed and searched once. Points whose similarity only rounds to 1 (scaled
copies rounded to float32) are paired apart from the index, cell by cell. The points go to shards by the nearest of a set of trained centres; each shard builds
a robust-pruned directed graph (`graph_index`) over its points, and each point is searched for by
beam search in its nearest shards. Per point the few candidates of all shards are merged, ranked in
double precision, and widened to rows again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.graph_index import ShardGraph
from quern.plans.scratch import cut
from quern.plans.sizing import sized_join

#: Points per shard aimed at, and most shards; beyond them shards grow (a graph search grows with the logarithm).
SHARD_POINTS, MOST_SHARDS = 8_192, 2048
#: Points and queries that one group of a shard holds at most, as far as the sample foretells; a shard with more is split.
GROUP_POINTS, GROUP_QUERIES = 65_536, 524_288
#: Sample per shard on which centres are trained (at most 1.1 * SHARD_SAMPLE * MOST_SHARDS points reach the driver, 37 MB of 64 numbers), and what a step of the training holds.
SHARD_SAMPLE, TRAIN_ROUNDS, TRAIN_ROWS = 64, 8, 4096
#: A centre with more than so many times its part of the sample is split in two.
CROWDED = 1.5
#: Shards searched per point, and width of the beam.
PROBES, BEAM = 4, 128
#: Similarities that agree in so many decimals are equal.
DECIMALS = 12
#: More than float32 can be off in an inner product of unit vectors (64 numbers): what lies so far below a similarity is less.
FLOAT_SLACK = 2e-5
#: Unit vectors farther apart have a similarity that does not round to 1; width of a cell, and projections that make one up.
TIE_REACH = 1.1 * 10 ** (-DECIMALS / 2)
TIE_CELL, TIE_AXES = 64 * TIE_REACH, 4


def clean_vectors(df: DataFrame, key: str, vector: str, length: int) -> DataFrame:
    """`key` and `vec` of the rows that take part, one per key: right length, finite numbers, not all zero."""
    v = F.col(vector).cast("array<float>")
    good = F.col(key).isNotNull() & (F.size(v) == length) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(good, F.lit(False))).groupBy(key).agg(F.max(v).alias("vec"))


def _unit(blobs: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(raw, unit) vectors in double precision."""
    raw = np.frombuffer(b"".join(blobs), dtype="<f4").reshape(-1, length).astype(np.float64)
    return raw, raw / np.linalg.norm(raw, axis=1, keepdims=True) if len(raw) else raw


def _nearest_centre(sample: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the most similar centre of each row, some rows at a time: the matrix of all similarities is never there as a whole."""
    return np.concatenate([(sample[i : i + TRAIN_ROWS] @ centres.T).argmax(1) for i in range(0, len(sample), TRAIN_ROWS)])


def train_centres(sample: np.ndarray, count: int, seed: int = 11) -> np.ndarray:
    """Unit centres of `sample` by spherical k-means; a centre that holds more than CROWDED times its part is split in two."""
    rng = np.random.default_rng(seed)
    if len(sample) <= count:
        return sample.copy()
    centres = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(TRAIN_ROUNDS):
        near = _nearest_centre(sample, centres)
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.diff(near[order], prepend=-1))
        sums = np.zeros_like(centres)
        sums[near[order][first]] = np.add.reduceat(sample[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1)
        empty = norm < 1e-12
        sums[~empty] /= norm[~empty, None]
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centres = sums
    most = CROWDED * len(sample) / count
    for _ in range(12):
        near = _nearest_centre(sample, centres)
        size = np.bincount(near, minlength=len(centres))
        crowded = np.flatnonzero(size > most)
        if not len(crowded):
            break
        extra = []
        for c in crowded:
            members = sample[near == c]
            two = members[rng.choice(len(members), 2, replace=False)].copy()
            for _ in range(4):
                side = (members @ two.T).argmax(1)
                for s in (0, 1):
                    if (side == s).any():
                        m = members[side == s].sum(0)
                        two[s] = m / max(np.linalg.norm(m), 1e-12)
            centres[c] = two[0]
            extra.append(two[1])
        centres = np.vstack([centres, extra])
    return centres.astype(np.float32)


class Layout:
    """Shards and how each of them is split: by points into parts, all of which a query visits, and by queries into shifts, each with all the points."""

    def __init__(self, centres: np.ndarray, points: np.ndarray | None = None, queries: np.ndarray | None = None) -> None:
        """`points` and `queries` are the numbers expected in each shard."""
        one = np.ones(len(centres), np.int64)
        self.centres = centres
        self.parts = one if points is None else np.maximum(one, -(-points.astype(np.int64) // GROUP_POINTS))
        self.shifts = one if queries is None else np.maximum(one, -(-queries.astype(np.int64) // GROUP_QUERIES))
        sizes = self.parts * self.shifts
        self.start = np.cumsum(sizes) - sizes
        self.groups = int(sizes.sum())

    def route(self, points: np.ndarray, unit: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, group, home, query): where each point lies and where it is searched for."""
        m = min(probes, len(self.centres))
        s = unit.astype(np.float32) @ self.centres.T
        near = np.argpartition(-s, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        row, shard = np.repeat(np.arange(len(points)), m), near.ravel()
        first = np.tile(np.arange(m) == 0, len(points))
        # two independent draws of the point's number
        mixed = points[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part, shift = (mixed >> np.uint64(33)).astype(np.int64) % self.parts[shard], ((mixed >> np.uint64(12)) & np.uint64(0xFFFFF)).astype(np.int64) % self.shifts[shard]
        if self.groups == len(self.centres):
            return row, self.start[shard], first, np.ones(len(row), bool)
        split = self.parts[shard] * self.shifts[shard]
        copy = np.repeat(np.arange(len(row)), split)
        number = np.arange(len(copy)) - np.repeat(np.cumsum(split) - split, split)
        in_part, in_shift = number // self.shifts[shard[copy]], number % self.shifts[shard[copy]]
        home, query = first[copy] & (in_part == part[copy]), in_shift == shift[copy]
        keep = home | query
        return row[copy][keep], (self.start[shard[copy]] + number)[keep], home[keep], query[keep]


def _routes(points: DataFrame, layout: Layout, length: int, probes: int) -> DataFrame:
    """shard, point, vec, home, query: each point in its home shard and as a query in its nearest shards."""
    shared = points.sparkSession.sparkContext.broadcast(layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # a slice at a time: one similarity matrix is slice x centres
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                row, group, home, query = shared.value.route(b.column(0).to_numpy(), _unit(b.column(1).to_pylist(), length)[1], probes)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), b.column(0).take(take), b.column(1).take(take), pa.array(home), pa.array(query)], ["shard", "point", "vec", "home", "query"])

    return points.select("point", "vec").mapInArrow(run, "shard int, point long, vec binary, home boolean, query boolean")


def _floats(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    """float32 view of a binary column without nulls, straight on its buffer."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = whole.chunks if isinstance(whole, pa.ChunkedArray) else [whole]
    out = [np.frombuffer(p.buffers()[2], dtype="<f4")[p.offset * length : (p.offset + len(p)) * length].reshape(-1, length) for p in parts if len(p)]
    return out[0] if len(out) == 1 else np.vstack(out) if out else np.empty((0, length), "<f4")


def _cosines(a: np.ndarray, a_norm: np.ndarray, b: np.ndarray, b_norm: np.ndarray) -> np.ndarray:
    """Rounded similarity of each row of `a` with the same row of `b`."""
    return np.round(np.clip(np.einsum("ij,ij->i", a, b) / (a_norm * b_norm), -1.0, 1.0), DECIMALS)


#: Queries of a shard that are searched and ranked at a time.
SEARCH_ROWS = 4096


def _searcher(length: int, k: int, beam: int):
    def search(table: pa.Table) -> pa.Table:
        """All queries of one shard against its graph: point, other, sim. Queries are taken slice by slice, so a shard that many look into needs no more memory."""
        vectors, home, point = _floats(table["vec"], length), table["home"].to_numpy(), table["point"].to_numpy()
        base = np.flatnonzero(home)
        base = base[np.argsort(point[base])]
        out_q, out_o, out_s = [], [], []
        if len(base):
            raw = vectors[base].astype(np.float64)
            norms = np.linalg.norm(raw, axis=1)
            graph = ShardGraph((raw / norms[:, None]).astype(np.float32))
            names = point[base]
            own = np.full(len(point), graph.none, np.int64)
            own[base] = np.arange(len(base))
            width = min(max(beam, 2 * k), len(base))
            asked = np.flatnonzero(table["query"].to_numpy())
            for i in range(0, len(asked), SEARCH_ROWS):
                rows = asked[i : i + SEARCH_ROWS]
                q = vectors[rows].astype(np.float64)
                q_norm = np.linalg.norm(q, axis=1)
                found, rough = graph.search_scored((q / q_norm[:, None]).astype(np.float32), width, own[rows])
                empty = found == graph.none
                found = np.where(empty, 0, found)
                # all of the beam that may be among the k closest besides the point itself is ranked again in double precision
                least = rough[:, min(k, width - 1)] - FLOAT_SLACK
                sims = np.full(found.shape, -9.0)
                for c in range(width):
                    r = np.flatnonzero(~empty[:, c] & (rough[:, c] >= least))
                    if not len(r):
                        break
                    sims[r, c] = _cosines(q[r], q_norm[r], raw[found[r, c]], norms[found[r, c]])
                others = names[found]
                sims[others == point[rows][:, None]] = -9.0
                order = np.lexsort((others, -sims), axis=1)[:, :k]
                best, others = np.take_along_axis(sims, order, 1), np.take_along_axis(others, order, 1)
                r, c = np.nonzero(best > -9.0)
                out_q.append(point[rows][r])
                out_o.append(others[r, c])
                out_s.append(best[r, c])
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), type=t)
        return pa.table({"point": cat(out_q, pa.int64()), "other": cat(out_o, pa.int64()), "sim": cat(out_s, pa.float64())})

    return search


def _compared(length: int, k: int):
    def search(table: pa.Table) -> pa.Table:
        """The `k` most similar points of one block for each query of another, by comparing all: point, other, sim."""
        vectors, home, point = _floats(table["vec"], length).astype(np.float64), table["home"].to_numpy(), table["point"].to_numpy()
        norms = np.linalg.norm(vectors, axis=1)
        base = np.flatnonzero(home)
        base = base[np.argsort(point[base])]
        asked = np.flatnonzero(table["query"].to_numpy())
        out_q, out_o, out_s = [], [], []
        for i in range(0, len(asked) if len(base) else 0, 512):
            q = asked[i : i + 512]
            rough = (vectors[q] / norms[q, None]) @ (vectors[base] / norms[base, None]).T
            rough[point[q][:, None] == point[base][None, :]] = -9.0
            # rounding makes equals of what differs by less; those at the k-th place are all ranked again
            width = min(k, len(base))
            least = np.partition(rough, len(base) - width, axis=1)[:, len(base) - width] - 10.0 ** (1 - DECIMALS)
            r, c = np.nonzero(rough >= np.maximum(least, -2.0)[:, None])
            sim = _cosines(vectors[q[r]], norms[q[r]], vectors[base[c]], norms[base[c]])
            order = np.lexsort((point[base[c]], -sim, r))
            r, c, sim = r[order], c[order], sim[order]
            first = np.flatnonzero(np.diff(r, prepend=-1))
            best = np.arange(len(r)) - np.repeat(first, np.diff(first, append=len(r))) < k
            out_q.append(point[q[r[best]]])
            out_o.append(point[base[c[best]]])
            out_s.append(sim[best])
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0), type=t)
        return pa.table({"point": cat(out_q, pa.int64()), "other": cat(out_o, pa.int64()), "sim": cat(out_s, pa.float64())})

    return search


#: Points per block where all are compared with all.
BLOCK_POINTS = 8192


def compared_points(points: DataFrame, length: int, k: int) -> DataFrame:
    """point, other, sim of the `k` most similar others in each block, all points compared with all, block by block.

    Exact, for measuring recall and for tables small enough: the work grows with the square of the points.
    """
    blocks = max(1, math.ceil(points.count() / BLOCK_POINTS))
    own = F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    tagged = points.select("point", "vec", own.alias("own"), F.explode(every).alias("other"))
    # group (a, b): the points of block a, searched for those of block b
    laid = tagged.select((F.col("own") * blocks + F.col("other")).alias("shard"), "point", "vec", F.lit(True).alias("home"), (F.col("own") == F.col("other")).alias("query"))
    asked = tagged.where(F.col("own") != F.col("other")).select((F.col("other") * blocks + F.col("own")).alias("shard"), "point", "vec", F.lit(False).alias("home"), F.lit(True).alias("query"))
    return laid.unionByName(asked).repartition(blocks * blocks, "shard").groupBy("shard").applyInArrow(_compared(length, k), "point long, other long, sim double")


def _tie_cells(points: DataFrame, length: int) -> DataFrame:
    """cell, point, vec, home: each point in the cell of its direction (home) and in every further cell that holds directions within TIE_REACH."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = np.linalg.qr(np.random.default_rng(5).normal(size=(length, min(TIE_AXES, length))))[0]
        for b in batches:
            if not b.num_rows:
                continue
            along = _unit(b.column(1).to_pylist(), length)[1] @ axes
            cell = np.floor(along / TIE_CELL).astype(np.int64)
            inside = along - cell * TIE_CELL
            step = np.where(inside < TIE_REACH, -1, np.where(inside > TIE_CELL - TIE_REACH, 1, 0))
            for some in range(1 << axes.shape[1]):
                moved = (some >> np.arange(axes.shape[1])) & 1
                r = np.flatnonzero((step[:, moved == 1] != 0).all(1))
                if len(r):
                    # 16 bits an axis: the numbers of cells lie within +-1 / TIE_CELL
                    number = ((cell[r] + step[r] * moved + (1 << 15)).astype(np.uint64) << (16 * np.arange(axes.shape[1])).astype(np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays([pa.array(number), b.column(0).take(take), b.column(1).take(take), pa.array(np.full(len(r), some == 0))], ["cell", "point", "vec", "home"])

    return points.select("point", "vec").mapInArrow(run, "cell long, point long, vec binary, home boolean")


def _tied(length: int, k: int):
    def search(table: pa.Table) -> pa.Table:
        """Of one cell, per point the `k` smallest others whose similarity rounds to 1: point, other, sim."""
        raw, home, point = _floats(table["vec"], length).astype(np.float64), table["home"].to_numpy(), table["point"].to_numpy()
        norms = np.linalg.norm(raw, axis=1)
        base = np.flatnonzero(home)
        base = base[np.argsort(point[base])]
        out_q, out_o = [], []
        for i in range(0, len(point), 1024):
            open_ = np.arange(i, min(i + 1024, len(point)))
            missing = np.full(len(open_), k)
            # the smallest first, until each has its k
            for j in range(0, len(base), 64):
                some = base[j : j + 64]
                r, c = np.nonzero(np.ones((len(open_), len(some)), bool))
                q, o = open_[r], some[c]
                tie = (_cosines(raw[q], norms[q], raw[o], norms[o]) >= 1.0) & (point[q] != point[o])
                tie = tie.reshape(len(open_), len(some))
                tie &= np.cumsum(tie, 1) <= missing[:, None]
                r, c = np.nonzero(tie)
                out_q.append(point[open_[r]])
                out_o.append(point[some[c]])
                missing = missing - tie.sum(1)
                open_, missing = open_[missing > 0], missing[missing > 0]
                if not len(open_):
                    break
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return pa.table({"point": pa.array(cat(out_q), pa.int64()), "other": pa.array(cat(out_o), pa.int64()), "sim": pa.array(np.ones(len(cat(out_q))), pa.float64())})

    return search


def tied_points(points: DataFrame, length: int, k: int) -> DataFrame:
    """point, other, sim (1): at least the `k` smallest other points whose similarity rounds to 1, however many there are."""
    cells = _tie_cells(points, length).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell")))
    # few cells hold more than one point
    return cells.where(F.col("n") > 1).groupBy("cell").applyInArrow(_tied(length, k), "point long, other long, sim double")


def searched_points(points: DataFrame, length: int, k: int, probes: int = PROBES, beam: int = BEAM) -> DataFrame:
    """point, other, sim: what the graphs of the nearest shards give for each point, and those at similarity 1."""
    n = points.count()
    count = max(1, min(MOST_SHARDS, math.ceil(n / SHARD_POINTS)))
    part = min(1.0, SHARD_SAMPLE * count * 1.1 / max(n, 1))
    sampled = points.where(F.pmod(F.xxhash64("point"), F.lit(1 << 20)) < int(part * (1 << 20))) if part < 1 else points
    rows = sampled.select("point", "vec").limit(2 * SHARD_SAMPLE * MOST_SHARDS).toArrow().sort_by("point")
    if not rows.num_rows:
        layout = Layout(np.zeros((1, length), np.float32))
    else:
        sample = _floats(rows["vec"], length)
        sample = sample / np.linalg.norm(sample.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
        centres = train_centres(sample, count)
        # what the sample foretells for all points
        here = np.zeros((2, len(centres)))
        for i in range(0, len(sample), TRAIN_ROWS):
            s = sample[i : i + TRAIN_ROWS] @ centres.T
            m = min(probes, len(centres))
            here[0] += np.bincount(s.argmax(1), minlength=len(centres))
            here[1] += np.bincount(np.argpartition(-s, m - 1, axis=1)[:, :m].ravel(), minlength=len(centres))
        layout = Layout(centres, *np.ceil(here * n / len(sample)))
    routed = _routes(points, layout, length, probes)
    # one group is a task's work, so the exchange gets a partition per group; small ones are not merged
    found = routed.repartition(max(layout.groups, 1), "shard").groupBy("shard").applyInArrow(_searcher(length, k, beam), "point long, other long, sim double")
    # those at similarity 1 go by their number alone, so they are not left to the beam, which holds any of them
    return found.unionByName(tied_points(points, length, k))


def point_neighbours(points: DataFrame, length: int, k: int, probes: int = PROBES, beam: int = BEAM, exact: bool = False) -> DataFrame:
    """point, near: array of (sim, other), the up to `k` most similar other points, by similarity and then the smaller number.

    `points` holds point (a number) and vec (little-endian float32 bytes), distinct in both, no two of one direction.
    """
    found = compared_points(points, length, k) if exact else searched_points(points, length, k, probes, beam)
    # at most k candidates per point of each group it was searched in, and k of each of its few cells
    best = F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("sim")).alias("away"), F.col("other"))))), 1, k)
    return found.groupBy("point").agg(best.alias("b")).select("point", F.transform("b", lambda x: F.struct((-x["away"]).alias("sim"), x["other"].alias("other"))).alias("near"))


def neighbour_pairs(df: DataFrame, key: str = "pair_id", vector: str = "embedding", k: int = 5, length: int = 64, probes: int = PROBES, beam: int = BEAM, exact: bool = False) -> DataFrame:
    """(`key`_1, `key`_2), smaller first: at least one is among the `k` most similar of the other by cosine.

    Equal similarities go to the smaller key. Rows whose vector is null, of another length, all zero
    or not finite take no part; a row delivered twice counts once. Vectors of exactly one direction form
    one class: its members are each other's nearest and equally similar to all others, so of any class only
    the `k` + 1 smallest keys can ever be neighbours, and a hot class costs no more than its rows.
    Approximate: see the README for recall. With `exact` all directions are compared with all instead.
    """
    rows = _classed(clean_vectors(df, key, vector, length), key, length)
    # ranks beyond k + 1 are cut before the exchange (window group limit), so a hot class does not pile up
    w = Window.partitionBy("c1", "c2").orderBy(key)
    low = cut(rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select(key, "c1", "c2", "r", F.when(F.col("r") == 1, F.col("vec")).alias("vec")))
    packed = low.where(F.col("r") == 1).select(F.col(key).cast("long").alias("point"), "vec")
    # the search's result (k numbers a point) is kept in the shared folder: measuring and joining it must not search again
    near = cut(point_neighbours(packed, length, k, probes, beam, exact))
    # the smallest members of each class, under the number of its point (the smallest of all)
    members = low.groupBy("c1", "c2").agg(F.array_sort(F.collect_list(key)).alias("ids")).withColumn("point", F.col("ids")[0])
    flat = near.select("point", F.inline("near"))
    others = flat.join(members.select(F.col("point").alias("other"), "ids"), "other").select("point", F.explode(F.transform("ids", lambda i: F.struct((-F.col("sim")).alias("away"), i.alias("id")))).alias("x"))
    own = members.select("point", F.explode(F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("away"), i.alias("id")))).alias("x"))
    listed = others.unionByName(own).groupBy("point").agg(F.slice(F.array_sort(F.collect_list("x")), 1, k + 1).alias("xs"))
    # kept, as it is measured and joined
    by_class = cut(listed.join(members.select("point", "c1", "c2"), "point").select("c1", "c2", "xs"))
    each = sized_join(rows.select(key, "c1", "c2"), by_class, ["c1", "c2"])
    nearest = F.slice(F.filter("xs", lambda x: x["id"] != F.col(key)), 1, k)
    pairs = each.select(key, F.explode(nearest).alias("x")).select(F.col(key).alias("a"), F.col("x.id").alias("b"))
    return pairs.select(F.least("a", "b").alias(f"{key}_1"), F.greatest("a", "b").alias(f"{key}_2")).distinct()


def directions(vectors: np.ndarray) -> np.ndarray:
    """Each row over its largest magnitude, in double precision: rows are equal exactly where one vector is a positive multiple of the other.

    Quotients of the same value round alike, and two different quotients of float32 numbers (24 bits each)
    are at least 2**-48 apart, so they stay apart in 53 bits.
    """
    x = vectors.astype(np.float64)
    return x / np.abs(x).max(axis=1, keepdims=True) + 0.0


def _classed(rows: DataFrame, key: str, length: int) -> DataFrame:
    """`key`, vec as the bytes of its float32 numbers, c1 and c2: 128 bits of a hash of its direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, length)
            marks = [hashlib.blake2b(d.tobytes(), digest_size=16).digest() for d in directions(x)] if len(x) else []
            c = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(c[:, 0]), pa.array(c[:, 1])], [key, "vec", "c1", "c2"])

    return rows.select(key, "vec").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, vec binary, c1 long, c2 long")
