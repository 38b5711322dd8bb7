"""Kernels and greedy steps against plain enumerations."""

import itertools
import random

import numpy as np
import pytest

from ribolens.kernels import strings as ks
from ribolens.operators import clustering, intervals, kernels


def structures(n):
    """All balanced dot-bracket strings of length n."""
    for s in itertools.product("(.)", repeat=n):
        depth = 0
        for c in s:
            depth += (c == "(") - (c == ")")
            if depth < 0:
                break
        if depth == 0:
            yield "".join(s)


def test_pair_table():
    assert ks.pair_table("(<.>)") == [4, 3, -1, 1, 0]
    for bad in ("(", ")", "(()", "<("):
        with pytest.raises(ValueError):
            ks.pair_table(bad)


def affine(a, b):
    """Score of aligning all of a and b, by trying every gap run."""
    if not a or not b:
        n = len(a) + len(b)
        return -(3 + (n - 1)) if n else 0
    options = [affine(a[1:], b[1:]) + (2 if a[0] == b[0] else -1)]
    options += [affine(a[k:], b) - (3 + k - 1) for k in range(1, len(a) + 1)]
    options += [affine(a, b[k:]) - (3 + k - 1) for k in range(1, len(b) + 1)]
    return max(options)


def test_local_alignment():
    rng = random.Random(3)
    for _ in range(12):
        a, b = ("".join(rng.choice("ACGU") for _ in range(rng.randint(0, 5))) for _ in range(2))
        parts = [(a[i:j], b[k:m]) for i in range(len(a)) for j in range(i + 1, len(a) + 1) for k in range(len(b)) for m in range(k + 1, len(b) + 1)]
        score, i, j, k, m = ks.local_alignment(a, b)
        assert score == max([0, *(affine(x, y) for x, y in parts)])
        if score:
            assert affine(a[i - 1 : j], b[k - 1 : m]) == score


@pytest.mark.parametrize("how", ["average", "weighted", "single", "complete"])
def test_linkage_as_by_the_least_pair(how):
    """Heights and clusters as if the nearest two of all were merged each time."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 9, 25):
        d = rng.random((n, n))
        d = d + d.T
        clusters, gaps, expected = {i: frozenset([i]) for i in range(n)}, {(i, j): d[i, j] for i in range(n) for j in range(i)}, []
        while len(clusters) > 1:
            (i, j), gap = min(gaps.items(), key=lambda x: x[1])
            expected.append((gap / 2, clusters[i] | clusters[j]))
            for k in clusters:
                if k not in (i, j):
                    a, b = gaps[max(i, k), min(i, k)], gaps[max(j, k), min(j, k)]
                    x, y = len(clusters[i]), len(clusters[j])
                    gaps[max(i, k), min(i, k)] = {"average": (a * x + b * y) / (x + y), "weighted": (a + b) / 2, "single": min(a, b), "complete": max(a, b)}[how]
            clusters[i] = clusters[i] | clusters.pop(j)
            gaps = {p: x for p, x in gaps.items() if j not in p}
        held = [frozenset([i]) for i in range(n)]
        got = []
        for a, b, height in ks.linkage(d, how):
            held.append(held[a] | held[b])
            got.append((height, held[-1]))
        assert [c for _, c in got] == [c for _, c in expected] and [h for h, _ in got] == pytest.approx([h for h, _ in expected])


@pytest.mark.parametrize("n", [2, 3, 4, 7, 20])
def test_neighbour_joining_recovers_additive_trees(n):
    """Distances along a random tree come back along the joined one."""
    rng = np.random.default_rng(n)
    nodes, edges = list(range(n)), []
    new = n
    while len(nodes) > 1:
        i, j = (nodes.pop(rng.integers(len(nodes))) for _ in range(2))
        edges += [(i, new, rng.uniform(0.1, 2)), (j, new, rng.uniform(0.1, 2))]
        nodes.append(new)
        new += 1

    def paths(edges):
        size = max(max(a, b) for a, b, _ in edges) + 1
        out = np.full((size, size), np.inf)
        np.fill_diagonal(out, 0)
        for a, b, x in edges:
            out[a, b] = out[b, a] = x
        for k in range(size):
            out = np.minimum(out, out[:, k : k + 1] + out[k : k + 1])
        return out[:n, :n]

    d = paths(edges)
    joined = ks.neighbour_joining(d)
    assert np.allclose(paths(joined), d) and min(x for *_, x in joined) > -1e-9
    assert ks.neighbour_joining(np.zeros((1, 1))) == []


def test_gsc_weights():
    assert ks.gsc_weights(np.zeros((1, 1))).tolist() == [1]
    assert ks.gsc_weights(np.zeros((3, 3))) == pytest.approx([1, 1, 1])
    d = np.array([[0, 0, 1], [0, 0, 1], [1, 1, 0.0]])
    assert ks.gsc_weights(d) == pytest.approx([0.75, 0.75, 1.5])


def random_hits(spark, n=120, seed=5):
    rng = random.Random(seed)
    rows = [(k, rng.randint(0, 3), s := rng.randint(0, 400), s + rng.randint(3, 60), float(rng.randint(0, 30))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "hit_id long, seq_id long, start long, stop long, score double")


def test_greedy_hits(spark):
    rows, frame = random_hits(spark)
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        if not any(k[1] == r[1] and k[2] <= r[3] and r[2] <= k[3] for k in kept):
            kept.append(r)
    assert sorted(x[0] for x in kernels.greedy_hits(frame).collect()) == sorted(k[0] for k in kept)


def test_neighbour_graph_components(spark):
    rows, frame = random_hits(spark, 60)
    found = dict(clustering.single_linkage(frame.selectExpr("hit_id AS node"), intervals.neighbour_graph(frame, 5)).collect())
    label = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in itertools.product(rows, rows):
            if a[1] == b[1] and a[2] <= b[3] + 5 and b[2] <= a[3] + 5:
                label[a[0]] = label[b[0]] = min(label[a[0]], label[b[0]])
    assert found == label


def test_shuffled_keeps_residues(spark):
    frame = spark.createDataFrame([(1, "ACGUACGUAA"), (2, "A"), (3, "")], "seq_id long, seq string")
    got = {r.seq_id: r.seq for r in kernels.shuffled(frame).collect()}
    assert {k: sorted(s) for k, s in got.items()} == {1: sorted("ACGUACGUAA"), 2: ["A"]}
