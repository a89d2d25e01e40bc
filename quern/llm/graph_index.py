"""A robust-pruned directed graph over the vectors of one shard, built and searched in batches.

Points are inserted in batches of growing size. Each batch is searched greedily on the graph so
far; the candidates met are pruned with a relaxed distance rule that keeps close but diverse
neighbours, and the edges are also added backwards, pruning any list that grows too long. Points that hardly any
edge leads to get edges from their nearest in spare places, and searches enter at several points
far apart, so sparse regions stay reachable. All steps work on whole batches of points at once (numpy), a beam search moves its batch in lockstep.
"""

from __future__ import annotations

import numpy as np

#: Neighbours per point, beam width while building, relaxation of the pruning distance.
DEGREE, BUILD_BEAM, ALPHA = 32, 64, 1.1
#: Points that a search enters at, spare places per point, and edges that should lead to each point.
ENTRIES, SPARE, LEAD = 16, 8, 3
#: Points of a beam that are expanded in one step.
STEP = 8
#: Marks of seen points that one chunk of queries may take, in bytes.
SEEN_BYTES = 32 << 20


class ShardGraph:
    """Index over unit vectors (float32, one row each); similarities are inner products."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> None:
        self.n, self.dim = vectors.shape
        self.none = self.n  # stands for "no point"
        self.vectors = np.vstack([vectors.astype(np.float32, copy=False), np.zeros((1, self.dim), np.float32)])
        self.degree, self.alpha = degree, alpha
        self.edges = np.full((self.n + 1, degree), self.none, np.int32)
        self.entries = self._far_apart(ENTRIES) if self.n else np.empty(0, np.int32)
        if self.n:
            self._build(beam, np.random.default_rng(seed))
            self._lead_to_all()

    def _far_apart(self, count: int) -> np.ndarray:
        """The point nearest to the middle, then each time the point farthest from those taken."""
        v = self.vectors[: self.n]
        picked = [int(np.argmax(v @ v.mean(0)))]
        near = v @ v[picked[0]]
        while len(picked) < min(count, self.n):
            nxt = int(np.argmin(near))
            if near[nxt] >= 1.0 - 1e-6:
                break
            picked.append(nxt)
            near = np.maximum(near, v @ v[nxt])
        return np.asarray(picked, np.int32)

    def _build(self, beam: int, rng: np.random.Generator) -> None:
        order = rng.permutation(self.n).astype(np.int32)
        order = order[~np.isin(order, self.entries)]
        at, most = 0, max(32, self.n // 16)
        while at < len(order):
            size = min(most, max(1, at), len(order) - at)
            batch = order[at : at + size]
            ids, sims = self.beam(self.vectors[batch], beam)
            out = self._prune(ids, sims)
            self.edges[batch] = out
            self._back(batch, out)
            at += size

    def _prune(self, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Up to `degree` of each row's candidates (closest first): the closest stays and rules out those closer to it than to the point, by alpha."""
        rows, width = ids.shape
        near = self.vectors[ids]
        among = near @ near.transpose(0, 2, 1)
        far = 1.0 - sims
        alive = ids != self.none
        valid = alive.copy()
        out = np.full((rows, self.degree), self.none, np.int32)
        taken = np.zeros(rows, np.int64)
        kept = np.zeros_like(alive)
        every = np.arange(rows)
        for _ in range(min(self.degree, width)):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            r = every[some]
            f = first[some]
            out[r, taken[r]] = ids[r, f]
            taken[r] += 1
            kept[r, f] = True
            ruled = self.alpha * (1.0 - among[r, f]) <= far[r]
            alive[r] &= ~ruled
            alive[r, f] = False
        # a list left short is filled up to half with the closest that were ruled out
        spare = valid & ~kept
        half = self.degree // 2
        short = np.flatnonzero((taken < half) & spare.any(1))
        if len(short):
            place = taken[short, None] + np.cumsum(spare[short], 1) - 1
            use = spare[short] & (place < half)
            r, c = np.nonzero(use)
            out[short[r], place[r, c]] = ids[short[r], c]
        return out

    def _back(self, batch: np.ndarray, out: np.ndarray) -> None:
        """Adds each new edge backwards; a list that would be too long is pruned again."""
        src = np.repeat(batch, out.shape[1])
        dst = out.ravel()
        ok = dst != self.none
        src, dst = src[ok], dst[ok]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        points, start, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(start, count)
        extra = np.full((len(points), int(count.max())), self.none, np.int32)
        extra[np.repeat(np.arange(len(points)), count), place] = src
        ids = np.sort(np.hstack([self.edges[points], extra]), axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = self.none
        ids[ids == points[:, None]] = self.none
        sims = np.einsum("ij,ikj->ik", self.vectors[points], self.vectors[ids])
        sims[ids == self.none] = -np.inf
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        full = (ids != self.none).sum(1) > self.degree
        width = self.degree
        easy = ids[~full, :width]
        if easy.shape[1] < width:
            easy = np.pad(easy, ((0, 0), (0, width - easy.shape[1])), constant_values=self.none)
        self.edges[points[~full]] = easy
        if full.any():
            # the closest 2 x degree of a crowded list take part in its pruning
            reach = min(ids.shape[1], 2 * self.degree)
            self.edges[points[full]] = self._prune(ids[full, :reach], sims[full, :reach])

    def _lead_to_all(self) -> None:
        """Spare places are given to points that fewer than LEAD edges lead to: their nearest point to them."""
        self.edges = np.hstack([self.edges, np.full((self.n + 1, SPARE), self.none, np.int32)])
        lead = np.bincount(self.edges[: self.n].ravel(), minlength=self.n + 1)[: self.n]
        used = np.zeros(self.n, np.int64)
        for p in np.flatnonzero(lead < LEAD):
            for q in self.edges[p, : self.degree]:
                if lead[p] >= LEAD:
                    break
                if q != self.none and used[q] < SPARE and p not in self.edges[q]:
                    self.edges[q, self.degree + used[q]] = p
                    used[q] += 1
                    lead[p] += 1

    def beam(self, queries: np.ndarray, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The `width` most similar points met from the entries for each query, most similar first (padded with `none`).

        `own` is the number of a query that is a point itself (else `none`): it is an entry too.
        """
        n_q = len(queries)
        ids = np.full((n_q, width), self.none, np.int32)
        sims = np.full((n_q, width), -np.inf, np.float32)
        done = np.zeros((n_q, width), bool)
        if not self.n or not n_q:
            return ids, sims
        start = np.broadcast_to(self.entries[None, :], (n_q, len(self.entries)))
        if own is not None:
            start = np.hstack([np.where(np.isin(own, self.entries), self.none, own)[:, None].astype(np.int32), start])
        s = np.einsum("ij,ikj->ik", queries, self.vectors[start])
        s[start == self.none] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :width]
        k = order.shape[1]
        ids[:, :k], sims[:, :k] = np.take_along_axis(start, order, 1), np.take_along_axis(s, order, 1)
        seen = np.zeros((n_q, self.n + 1), bool)
        seen[np.arange(n_q)[:, None], start] = True
        seen[:, self.none] = True
        marks, stride = seen.ravel(), self.n + 1
        while True:
            open_ = ~done & (ids != self.none)
            row, col = np.nonzero(open_ & (np.cumsum(open_, 1) <= STEP))
            if not len(row):
                return ids, sims
            done[row, col] = True
            # query and point in one number: fresh ones are those not marked, each once
            reached = ((row * stride)[:, None] + self.edges[ids[row, col]]).ravel()
            reached = reached[~marks[reached]]
            reached.sort()
            reached = reached[np.flatnonzero(np.diff(reached, prepend=-1))]
            marks[reached] = True
            row, found = np.divmod(reached, stride)
            met = np.einsum("ij,ij->i", queries[row], self.vectors[found])
            # what is no better than the last of a full beam cannot enter it
            better = met > sims[row, -1]
            row, found, met = row[better], found[better], met[better]
            if not len(row):
                continue
            first = np.flatnonzero(np.diff(row, prepend=-1))
            at, count = row[first], np.diff(first, append=len(row))
            place, line = np.arange(len(row)) - np.repeat(first, count), np.repeat(np.arange(len(at)), count)
            new_ids = np.full((len(at), int(count.max())), self.none, np.int32)
            new_sims = np.full(new_ids.shape, -np.inf, np.float32)
            new_ids[line, place], new_sims[line, place] = found, met
            all_ids = np.hstack([ids[at], new_ids])
            all_sims = np.hstack([sims[at], new_sims])
            all_done = np.hstack([done[at], np.zeros(new_ids.shape, bool)])
            best = np.argsort(-all_sims, axis=1)[:, :width]
            best += (np.arange(len(at)) * all_ids.shape[1])[:, None]
            ids[at], sims[at], done[at] = all_ids.ravel()[best], all_sims.ravel()[best], all_done.ravel()[best]

    def search(self, queries: np.ndarray, width: int, own: np.ndarray | None = None) -> np.ndarray:
        """Point numbers of `search_scored`."""
        return self.search_scored(queries, width, own)[0]

    def search_scored(self, queries: np.ndarray, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """`beam`, chunked so that the marks of seen points stay within SEEN_BYTES."""
        chunk = int(max(1, min(1024, SEEN_BYTES // (self.n + 1))))
        parts = [self.beam(queries[i : i + chunk], width, None if own is None else own[i : i + chunk]) for i in range(0, len(queries), chunk)]
        if not parts:
            return np.empty((0, width), np.int32), np.empty((0, width), np.float32)
        return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])
