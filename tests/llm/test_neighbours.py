"""Graph search against brute force."""

import numpy as np
import pytest

from quern.llm import neighbours as N
from quern.llm.graph_index import ShardGraph


def clustered(n, seed=0, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    return (centres[rng.integers(20, size=n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.3, 1.0], size=(n, 1))).astype(np.float32)


def brute(ids, x, k=5):
    x = x.astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(ids)):
        order = np.lexsort((ids, -s[i]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order if s[i, j] > -9}
    return {(int(a), int(b)) for a, b in out}


def test_graph_recall():
    x = clustered(1500)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    g = ShardGraph(u)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1)[:, :5]
    got = g.search(u, 40)
    hit = sum(len({j for j in got[i] if j not in (i, g.none)} & set(want[i])) for i in range(len(u)))
    assert hit / want.size > 0.97
    assert ((g.edges[:-1] != g.none).sum(1) <= g.degree).all()


def test_pairs_recall_and_dirt(spark):
    x = clustered(2500, 1)
    data = [(int(i), [float(v) for v in x[i]]) for i in range(len(x))]
    dirt = [(9001, None), (9002, [1.0] * 63), (9003, [0.0] * 64), (9004, [float("nan")] + [1.0] * 63), (9005, [float("inf")] + [1.0] * 63), (9006, [None] + [1.0] * 63), (9007, [])]
    df = spark.createDataFrame([(*r, "clash") for r in data + data[:50] + dirt], "pair_id long, embedding array<float>, point string")
    got = [tuple(r) for r in N.neighbour_pairs(df).collect()]
    want = brute(np.arange(len(x)), x)
    assert len(got) == len(set(got)) and all(a < b < 9000 for a, b in got)
    assert len(want & set(got)) / len(want) > 0.95


def test_equal_vectors_and_ties(spark):
    base = clustered(30, 2)
    rows = [(i, base[0]) for i in range(40)] + [(100 + i, base[i]) for i in range(1, 30)] + [(200, base[3] * 2)]
    df = spark.createDataFrame([(int(i), [float(v) for v in x]) for i, x in rows], "pair_id long, embedding array<float>")
    got = {tuple(r) for r in N.neighbour_pairs(df).collect()}
    assert got == brute(np.array([i for i, _ in rows]), np.array([x for _, x in rows]))


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_vectors(spark, n):
    x = clustered(4, 3)[:n]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "pair_id long, embedding array<float>")
    assert N.neighbour_pairs(df).count() == n * (n - 1) // 2


def test_centres_split_crowded_regions():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(100, 64)), np.ones((900, 64)) + rng.normal(size=(900, 64)) * 1e-3]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = N.train_centres(x, 10)
    assert np.bincount((x @ c.T).argmax(1), minlength=len(c)).max() <= 500


def copies_of(v, n, scales, seed):
    """`n` copies of `v` under shuffled ids, multiplied by `scales`."""
    rng = np.random.default_rng(seed)
    return list(zip(5000 + rng.permutation(n), (v[None, :] * scales(rng, n)[:, None]).astype(np.float32)))


def pairs_of(spark, rows):
    df = spark.createDataFrame([(int(i), [float(v) for v in x]) for i, x in rows], "pair_id long, embedding array<float>")
    return {tuple(r) for r in N.neighbour_pairs(df).collect()}, brute(np.array([i for i, _ in rows]), np.array([x for _, x in rows]))


def test_many_exactly_scaled_copies(spark):
    """More copies of one direction than a beam holds, looked for from inside and from nearby."""
    x = np.round(clustered(40, 5) * 64) / np.float32(64)
    near = (x[0] + np.random.default_rng(6).normal(size=(10, 64)) * 0.01).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x[1:])] + [(1000 + i, v) for i, v in enumerate(near)]
    got, want = pairs_of(spark, rows + copies_of(x[0], 400, lambda r, n: 1.0 + r.permutation(n), 7))
    assert got == want


def test_many_rounded_scaled_copies(spark):
    """Copies whose direction float32 rounds: similarity 1 goes to the smallest ids, of hundreds."""
    x = clustered(300, 8)
    rows = [(i, v) for i, v in enumerate(x[1:])] + copies_of(x[0] + 5, 400, lambda r, n: r.uniform(0.1, 10, n), 9)
    got, want = pairs_of(spark, rows)
    hot = lambda pairs: {p for p in pairs if p[0] >= 5000}
    assert hot(got) == hot(want)
    assert len(got & want) / len(want) > 0.99 and len(got - want) <= 0.01 * len(got)


def test_directions_tell_multiples():
    v = clustered(50, 10)
    w = np.nextafter(v, np.float32(np.inf))
    d = N.directions(v)
    assert (d == N.directions(v * np.float32(2.0**-9))).all()
    assert not (d == N.directions(w)).all(1).any() and not (d == N.directions(-v)).all(1).any()
    small = np.array([[3, -6, 1, 0.0]], np.float32)
    assert (N.directions(small) == N.directions(small * 7)).all()


def test_training_holds_only_a_slice_of_all_similarities(monkeypatch):
    seen = []
    real = N._nearest_centre

    def watched(sample, centres):
        seen.append(min(len(sample), N.TRAIN_ROWS) * len(centres) * 4)
        return real(sample, centres)

    monkeypatch.setattr(N, "_nearest_centre", watched)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20_000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(N.train_centres(x, 150)) >= 150 and max(seen) <= N.TRAIN_ROWS * 4 * 300
    # by calculation, at the most shards that there can be: the sample, its sums and one slice of similarities
    points = 1.1 * N.SHARD_SAMPLE * N.MOST_SHARDS
    assert points * 64 * 4 * 3 + N.TRAIN_ROWS * 2 * N.MOST_SHARDS * 4 * 2 < 300e6


def test_split_shards_lose_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(500, 8))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    monkeypatch.setattr(N, "GROUP_POINTS", 60)
    monkeypatch.setattr(N, "GROUP_QUERIES", 90)
    layout = N.Layout(unit[:4].astype(np.float32), np.array([200, 30, 150, 100]), np.array([300, 100, 20, 200]))
    assert layout.groups == 4 * 4 + 1 * 2 + 3 * 1 + 2 * 3
    points = np.arange(500) * 7
    row, group, home, query = layout.route(points, unit, 2)
    s = unit.astype(np.float32) @ layout.centres.T
    near = np.argsort(-s, axis=1)[:, :2]
    for i in range(500):
        mine = row == i
        # as a point in every shift of one part of its home, as a query in one shift of every part of both shards
        assert home[mine].sum() == layout.shifts[near[i, 0]] and query[mine].sum() == layout.parts[near[i]].sum()
    plain = N.Layout(unit[:4].astype(np.float32)).route(points, unit, 2)
    assert len(plain[0]) == 1000 and plain[2].sum() == 500 and plain[3].all()


def test_split_shards_and_exact_mode_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.round(rng.normal(size=(400, 64)), 2))] + [(1000 + i, [float(2 * x) for x in np.eye(64)[3]]) for i in range(9)]
    df = spark.createDataFrame(rows, "pair_id long, embedding array<float>")
    want = {tuple(r) for r in N.neighbour_pairs(df, exact=True).collect()}
    x = {k: np.asarray(v, np.float32).astype(float) for k, v in rows}
    brute = set()
    for a, v in x.items():
        sims = sorted((-round(float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), 12), b) for b, w in x.items() if b != a)[:5]
        brute |= {(min(a, b), max(a, b)) for _, b in sims}
    assert want == brute
    monkeypatch.setattr(N, "BLOCK_POINTS", 150)
    assert {tuple(r) for r in N.neighbour_pairs(df, exact=True).collect()} == brute
    monkeypatch.setattr(N, "GROUP_POINTS", 150)
    monkeypatch.setattr(N, "GROUP_QUERIES", 100)
    got = {tuple(r) for r in N.neighbour_pairs(df).collect()}
    assert len(got & brute) >= 0.99 * len(brute)
