"""Greedy selection against the sequential rule, and shuffles that keep neighbours against all walks."""

import random
from collections import Counter
from itertools import pairwise, permutations

import numpy as np
import pytest

from ribolens.kernels import walks
from ribolens.operators.kernels import neighbour_shuffled
from ribolens.operators.selection import greedy_selection


@pytest.mark.parametrize("most", [None, 3])
def test_greedy_selection(spark, most):
    """One group holds most items; conflicts against the order, with itself and between groups don't count."""
    rng = random.Random(5)
    items = [("hot" if n % 4 else f"g{n % 3}", n, rng.choice([1.0, 2.0, 3.0, rng.random()])) for n in range(120)]
    conflicts = {(rng.randrange(120), rng.randrange(120)) for _ in range(500)} | {(3, 3)} | {(n + 1, n) for n in range(20)}
    expected = []
    for group in {g for g, *_ in items}:
        chosen = []
        for order, n in sorted((o, n) for g, n, o in items if g == group):
            if (most is None or len(chosen) < most) and not any((n, s) in conflicts for s in chosen):
                chosen.append(n)
        expected += [(group, n) for n in chosen]
    frames = spark.createDataFrame(items, "group string, item long, order double"), spark.createDataFrame(sorted(conflicts), "worse long, better long")
    assert sorted((r.group, r.item) for r in greedy_selection(*frames, most).collect()) == sorted(expected)
    assert greedy_selection(frames[0].limit(0), frames[1]).count() == 0 and greedy_selection(frames[0], frames[1].limit(0)).count() == 120


def test_walks_keep_pairs_and_reach_all():
    """Every sequence with the same pairs of neighbours and the same first residue comes up, about equally often."""
    seq = "AACAGACG"
    same = {x for x in set(permutations(seq)) if Counter(pairwise(x)) == Counter(pairwise(seq)) and x[0] == seq[0]}
    seen = Counter(tuple(walks.walked(seq, np.random.default_rng(n))) for n in range(4000))
    assert set(seen) == same and len(same) > 5
    assert max(seen.values()) < 1.35 * min(seen.values())
    for text in ("", "A", "AC", "AAAA", "ACAC", "GATTACA" * 50):
        new = walks.walked(text, np.random.default_rng(3))
        assert Counter(pairwise(new)) == Counter(pairwise(text)) and new[:1] == text[:1] and new[-1:] == text[-1:]
    assert walks.walked("GATTACA" * 50, np.random.default_rng(3)) != "GATTACA" * 50


def test_markov_sequences():
    text = "AC" * 200 + "AG"
    new = walks.markov(text, np.random.default_rng(1))
    assert len(new) == len(text) and set(pairwise(new)) <= set(pairwise(text)) | {("G", x) for x in "ACG"} and walks.markov("", np.random.default_rng(1)) == ""


def test_shuffles_repeat(spark):
    rows = spark.createDataFrame([(n, "GATTACA" * 9) for n in range(5)] + [(-1, None), (7, "")], "seq_id long, seq string")
    one, two = ({r.seq_id: r.seq for r in neighbour_shuffled(rows.repartition(k)).collect()} for k in (1, 3))
    assert one == two and one[-1] is None and one[7] == "" and len({one[n] for n in range(5)}) > 1
    other = {r.seq_id: r.seq for r in neighbour_shuffled(rows, seed=2).collect()}
    assert other != one and all(len(x or "") in (0, 63) for x in {r.seq for r in neighbour_shuffled(rows, "markov").collect()})
