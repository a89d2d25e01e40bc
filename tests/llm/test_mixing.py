"""Mixing: shares, limits and edge cases."""

import random

import numpy as np
import pytest

from quern.llm import mixing as M

SIZED = "doc_id long, source string, lang string, topic string, n_tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def corpus(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    src = rng.choice(["a", "b", "c", "d"], n, p=[0.7, 0.2, 0.09, 0.01])
    return [(i, str(src[i]), str(rng.choice(["en", "de"])), str(rng.choice(["x", "y", "z"])), int(rng.integers(1, 200))) for i in range(n)]


def test_shares_and_limits(spark):
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("d", 0.1, 8)], TARGETS)
    mixed = M.mix(spark.createDataFrame(corpus(), SIZED), targets)
    got = {r["source"]: r for r in M.shares(mixed, targets).collect()}
    for s, want, most in (("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("d", 0.1, 8)):
        assert got[s]["share"] == pytest.approx(want, rel=0.03) and got[s]["most_copies"] <= most
    # the scarcest source is used to its limit, so no larger mix would do
    assert any(r["tokens_drawn"] > 0.97 * r["tokens"] * r["max_repeats"] for r in got.values())
    again = M.mix(spark.createDataFrame(corpus(), SIZED), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))


def test_edges(spark, rows):
    data = [(1, None, "en", "x", 5), (2, "a", None, None, 5), (3, "a", "en", "x", 0), (4, "a", "en", "x", None), (5, "untargeted", "en", "x", 9), (6, "b", "en", "x", 5)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 1), ("b", 0.25, 2), ("missing", 0.25, 3), (None, 0.3, 1), ("zero", 0.0, 1), ("bad", None, None)], TARGETS)
    mixed = M.mix(spark.createDataFrame(data, SIZED), targets)
    got = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    assert got[1] == got[3] == got[4] == got[5] == 0 and got[2] == 1 and got[6] in (0, 1)
    report = {r["source"]: r for r in M.shares(mixed, targets).collect()}
    assert report["missing"]["tokens"] == 0 and report["untargeted"]["target_share"] is None
    empty = spark.createDataFrame([], SIZED)
    assert M.mix(empty, targets).count() == 0 and M.shares(M.mix(empty, targets), targets).count() == 6
    assert M.mix(spark.createDataFrame(data, SIZED), targets.limit(0)).where("copies > 0").count() == 0


def test_rake_meets_feasible_marginals():
    tokens = np.array([10.0, 30.0, 20.0, 40.0])
    source, lang = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    fit = M.rake(tokens, source, np.array([0.5, 0.5]), np.array([4.0, 4.0]), [lang])
    mass = fit.weights * tokens / (fit.weights * tokens).sum()
    assert np.bincount(source, mass) == pytest.approx([0.5, 0.5])
    assert np.bincount(lang, mass) == pytest.approx([0.3, 0.7], abs=0.02)
    assert fit.weights.max() <= 4.0 + 1e-9


def test_limits_hold_when_marginals_push():
    tokens = np.array([1.0, 99.0])
    fit = M.rake(tokens, np.array([0, 0]), np.array([1.0]), np.array([1.0]), [np.array([0, 1])])
    assert fit.weights == pytest.approx([1.0, 1.0])


def test_rare_values_keep_their_marginals(spark):
    """Eighty languages in both sources, in opposite amounts: each is raked, the rarest too."""
    sized = [(100 * i + j, s, f"l{i:02}", "x", t) for i in range(80) for j, (s, t) in enumerate([("a", 200 + i), ("b", 400 - 4 * i)])]
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 3)], TARGETS)
    got = {(r["source"], r["doc_id"] // 100): r["weight"] for r in M.mix(spark.createDataFrame(sized, SIZED), targets).collect()}
    cells = sorted((s, l, t) for _, s, l, _, t in sized)
    lang = np.array([int(l[1:]) for _, l, _ in cells])
    fit = M.rake(np.array([float(t) for *_, t in cells]), np.array(["ab".index(s) for s, *_ in cells]), np.array([0.7, 0.3]), np.array([3.0, 3.0]), [lang, np.zeros(160, int)])
    assert [got[s, i] for (s, *_), i in zip(cells, lang)] == pytest.approx(list(fit.weights))
    assert len({round(got["b", i], 6) for i in range(80)}) > 64


@pytest.mark.parametrize("n,seed", [(60, 1), (700, 2), (5000, 3)])
def test_every_source_comes_within_one_mean_document(spark, n, seed):
    rnd = random.Random(seed)
    docs = [(i, rnd.choice("aaaabbcd"), rnd.choice(["en", "de", None]), rnd.choice("xyz"), int(rnd.paretovariate(1.1) * 20)) for i in range(n)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, lang string, topic string, n_tokens int")
    shares = {"a": 0.3, "b": 0.3, "c": 0.25, "d": 0.15}
    limits = {"a": 1, "b": 2, "c": 3, "d": 5}
    targets = spark.createDataFrame([(s, x, limits[s]) for s, x in shares.items()], "source string, target_share double, max_repeats int")
    mixed = M.mix(sized, targets)
    rows = mixed.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(n))
    assert all(0 <= r["copies"] <= limits[r["source"]] for r in rows)
    total = sum(r["n_tokens"] * r["copies"] for r in rows)
    for s, share in shares.items():
        own = [r for r in rows if r["source"] == s]
        mean = sum(r["n_tokens"] for r in own) / len(own)
        assert abs(sum(r["n_tokens"] * r["copies"] for r in own) - share * total) <= mean + 1
        # the weights themselves meet the target exactly
        weighted = sum(r["n_tokens"] * r["weight"] for r in rows)
        assert abs(sum(r["n_tokens"] * r["weight"] for r in own) / weighted - share) < 1e-6
    report = {r["source"]: r for r in M.shares(mixed, targets).collect()}
    assert sum(r["limiting"] for r in report.values()) == 1
    tight = min(shares, key=lambda s: sum(d[4] for d in docs if d[1] == s) * limits[s] / shares[s])
    assert report[tight]["limiting"]
    seen = M.marginals(mixed).collect()
    for kind in ("lang", "topic"):
        assert all(abs(sum(r[c] for r in seen if r["marginal"] == kind) - 1) < 1e-9 for c in ("target_share", "raked_share", "share"))
    assert {tuple(r) for r in M.mix(sized.repartition(5), targets).collect()} == {tuple(r) for r in rows}  # the same draw however it is laid out


def test_corrections():
    assert M.corrections(0.0, [(5, 1)], [(5, 1)]) == []
    assert M.corrections(17.0, [(5, 9), (2, 9)], []) == [(2, 1, 1), (5, 1, 3)]
    assert M.corrections(-9.0, [(1, 3)], [(10, 1)]) == [(1, 1, 1), (10, -1, 1)]
    assert M.corrections(3.0, [(100, 4)], []) == []


def test_contradicting_marginals_are_told():
    with pytest.warns(UserWarning, match="contradict"):
        old = M.ROUNDS
        try:
            M.ROUNDS = 2
            M.rake(np.array([9.0, 1.0, 2.0, 8.0]), np.array([0, 0, 1, 1]), np.array([0.9, 0.1]), np.array([5.0, 5.0]), [np.array([0, 1, 0, 1])])
        finally:
            M.ROUNDS = old
