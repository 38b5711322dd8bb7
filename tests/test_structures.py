"""Structures, relations and special functions against brute force."""

import random
from math import erf, exp, lgamma, log

import numpy as np
import pytest

from ribolens.functions import special
from ribolens.operators import alignment as al
from ribolens.operators import relations as rl
from ribolens.operators import structures as sx


def brackets(rng, n):
    """A random balanced structure."""
    if n < 4:
        return "." * n
    kind, k = rng.choice(["()", "<>", "[]", "{}"]), rng.randint(2, n)
    return kind[0] + brackets(rng, k - 2) + kind[1] + brackets(rng, n - k) if rng.random() < 0.8 else "." + brackets(rng, n - 1)


def pairs_of(ss):
    stack, out = [], []
    for n, c in enumerate(ss, 1):
        if c in "(<[{":
            stack.append(n)
        elif c in ")>]}":
            if not stack:
                return None
            out.append((stack.pop(), n))
    return None if stack else sorted(out)


def test_pair_rows(spark):
    rng = random.Random(1)
    texts = [brackets(rng, rng.randint(0, 40)) for _ in range(60)] + ["", "((.)", ")(", "(A.a)", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, ss string")
    got = {}
    for r in sx.pair_rows(frame, "id").collect():
        got.setdefault(r.id, []).append((r.i, r.j))
    assert {k: sorted(x) for k, x in got.items()} == {n: p for n, t in enumerate(texts) if (p := pairs_of(t or ""))}
    flags = {r.id: r.b for r in frame.select("id", sx.balanced(frame["ss"]).alias("b")).collect()}
    assert all(flags[n] == (pairs_of(t) is not None) for n, t in enumerate(texts) if t is not None) and flags[len(texts) - 1] is None
    helix = {(r.id, r.i, r.j): (r.outer, r.inner) for r in sx.helices(sx.pair_rows(frame, "id"), "id").collect()}
    for (k, i, j), (outer, inner) in helix.items():
        own = set(pairs_of(texts[k]))
        assert all((i - d, j + d) in own for d in range(1, outer + 1)) and (i - outer - 1, j + outer + 1) not in own
        assert all((i + d, j - d) in own for d in range(1, inner + 1)) and (i + inner + 1, j - inner - 1) not in own


def test_kept_columns(spark):
    rng = random.Random(2)
    texts = [brackets(rng, rng.randint(1, 30)) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, ss string")
    got = {r.id: r.ss for r in sx.kept_columns(frame, "id", lambda at: at % 3 != 0).collect()}
    for n, t in enumerate(texts):
        whole = {x: c for i, j in pairs_of(t) if i % 3 and j % 3 for x, c in ((i, "("), (j, ")"))}
        expected = "".join(whole.get(x, ".") for x in range(1, len(t) + 1) if x % 3)
        assert got.get(n, "") == expected


def test_weighted_identity(spark):
    """Pairs by hand: gaps in both left out, weights multiplied, pairs under ten columns left out, one sequence alone 1."""
    rng = random.Random(3)
    rows = [("m", n, "".join(rng.choice("ACGU--") for _ in range(24)), rng.choice([0.5, 1.0, 2.0])) for n in range(25)]
    rows += [("m", 100, rows[0][2], 1.0), ("one", 1, "A" * 24, 1.0), ("few", 1, "ACGU" + "-" * 20, 1.0), ("few", 2, "ACG-" + "-" * 20, 1.0)]
    frame = spark.createDataFrame(rows, "msa_id string, seq_id long, aseq string, weight double")
    same = pairs = 0.0
    own = [r for r in rows if r[0] == "m"]
    for n, a in enumerate(own):
        for b in own[:n]:
            cols = [(x, y) for x, y in zip(a[2], b[2], strict=True) if (x, y) != ("-", "-")]
            if len(cols) >= 10:
                same += a[3] * b[3] * sum(x == y for x, y in cols) / len(cols)
                pairs += a[3] * b[3]
    got = {r.msa_id: r.mean_identity for r in al.weighted_identity(frame, 24).collect()}
    assert got == {"m": pytest.approx(same / pairs), "one": 1.0, "few": None}


def test_row_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(al, "BLOCK_ROWS", 4)
    frame = spark.createDataFrame([("m", n, n * n) for n in range(23)], "msa_id string, seq_id long, v long")
    got = [tuple(r) for r in al.row_pairs(frame, ["v"]).collect()]
    assert sorted(got) == [("m", a, b, a * a, b * b) for a in range(23) for b in range(a + 1, 23)]


def test_special_functions():
    a, x = np.array([0.5, 0.5, 1, 3, 3, 20, 20, 7]), np.array([0.3, 4, 2, 0.1, 9, 5, 60, 0])
    steps = np.linspace(0, 1, 400001)[1:]
    for k, z, got in zip(a, x, special.gamma_tails(a, x)[0], strict=True):
        if k == 0.5:
            assert got == pytest.approx(erf(z**0.5), rel=1e-12)
        elif z:
            t = steps * z
            assert got == pytest.approx(np.sum(np.exp((k - 1) * np.log(t) - t - lgamma(k))) * z / 400000, rel=2e-4)
        else:
            assert got == 0
    p = special.substitution_probabilities([[-0.9, 0.4, 0.3, 0.2], [0.4, -1.1, 0.3, 0.4], [0.3, 0.3, -0.8, 0.2], [0.2, 0.4, 0.2, -0.8]], np.array([0.0, 0.3, 0.6, 50.0]))
    assert p[0] == pytest.approx(np.eye(4), abs=1e-12) and p[1] @ p[1] == pytest.approx(p[2]) and p[3] == pytest.approx(np.full((4, 4), 0.25), abs=1e-6)
    with pytest.raises(ValueError):
        special.substitution_probabilities([[1.0, -1.0], [1.0, -1.0]], np.array([1.0]))


def test_evalue_weights(spark):
    rows = [(1, 10.0), (1, 60.0), (2, 100.0)]
    frame = spark.createDataFrame(rows, "seq_id long, score double")
    raw = [exp(-3 * (1 - exp(-exp(-0.05 * (s - 20))))) for _, s in rows]
    total = {1: raw[0] + raw[1], 2: raw[2]}
    got = {(r.seq_id, r.score): r.weight for r in rl.evalue_weights(frame, 20.0, 0.05, 3).collect()}
    assert got == {(k, s): pytest.approx(min(1, w * 3 / total[k])) for (k, s), w in zip(rows, raw, strict=True)}
    assert log(raw[2]) < 0


def structures(n):
    """All nested sets of pairs on n places."""
    if n == 0:
        yield []
        return
    for rest in structures(n - 1):
        yield [(i + 1, j + 1) for i, j in rest]
    for j in range(1, n):
        for inner in structures(j - 1):
            for outer in structures(n - j - 1):
                yield [(0, j), *((a + 1, b + 1) for a, b in inner), *((a + j + 1, b + j + 1) for a, b in outer)]


def test_best_structure():
    """Against all structures: evidence, less a cost for each helix, helices of two pairs at least, in which pairs stack."""
    from ribolens.kernels.consensus import best_structure

    rng = np.random.default_rng(4)
    for turn in range(25):
        n = int(rng.integers(0, 9))
        place = np.cumsum(rng.integers(1, 3, n))
        xy = np.round(rng.normal(0.3, 1, (n, n)), 3)
        cost, hairpin = float(rng.choice([0.2, 1.0])), int(rng.integers(1, 3))
        best = 0.0
        for pairs in structures(n):
            own = set(pairs)
            if any(xy[p] <= 0 or place[p[1]] - place[p[0]] <= hairpin for p in own):
                continue
            if any((i - 1, j + 1) not in own and (i + 1, j - 1) not in own for i, j in own):
                continue
            best = max(best, sum(xy[p] for p in own) - cost * sum((i + 1, j - 1) not in own for i, j in own))
        score, pairs = best_structure(xy, place, cost, hairpin)
        assert score == pytest.approx(best), turn
        own = set(pairs)
        assert sum(xy[p] for p in own) - cost * sum((i + 1, j - 1) not in own for i, j in own) == pytest.approx(best)
