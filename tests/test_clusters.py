"""Identity clusters against connected components of all pairs, in one block and over several."""

import random

import pytest

from ribolens.operators import clustering as cl


@pytest.mark.parametrize("block", [8000, 7])
def test_identity_clusters_without_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cl, "CLUSTER_ROWS", block)
    rng = random.Random(block)
    rows = [(f"m{k % 3}", f"n{k:03}", "".join(rng.choice("ACGU" + "-" * 4 * (k % 3)) for _ in range(12))) for k in range(120)]
    rows += [("m0", f"x{k}", "------------") for k in range(3)] + [("one", "y", "A-----------")] + [("m1", f"z{k}", "ACGUACGUACGU") for k in range(9)]
    cluster = {n: n for _, n, _ in rows}
    close = lambda s, t, n: n and sum(a == b != "-" for a, b in zip(s, t, strict=True)) / n >= 0.6
    size = lambda s: len(s) - s.count("-")
    links = [(n, p) for m, n, s in rows for o, p, t in rows if m == o and n < p and close(s, t, min(size(s), size(t)))]
    while moved := [(n, p) for n, p in links if cluster[n] != cluster[p]]:
        for n, p in moved:
            cluster[n] = cluster[p] = min(cluster[n], cluster[p])
    found = cl.identity_clusters(spark.createDataFrame(rows, "msa_id string, node string, aseq string"), 12, 0.6)
    assert {r.node: r.cluster for r in found.collect()} == cluster
    assert 3 < len(set(cluster.values())) < len(cluster)
