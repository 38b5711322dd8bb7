"""Weights of residues at pairs of columns: against loops over rows, and with one exchange by alignment."""

import random
from collections import Counter

import pytest

from ribolens.operators import alignment as al


def test_joint_profiles_stream_by_alignment(spark):
    rng = random.Random(5)
    rows = [(f"m{k % 3}", k, "".join(rng.choice("ACGU--") for _ in range(7 + k % 2)), rng.choice([0.0, 0.5, 1.0])) for k in range(200)]
    rows += [("copies", k, "GC-A", 0.5) for k in range(2500)] + [("empty", 1, "", 1.0), ("gaps", 1, "---", 1.0), ("none", 1, None, 1.0)]
    given = spark.createDataFrame(rows, "msa_id string, seq_id long, aseq string, weight double")
    joint, single, n = Counter(), Counter(), Counter()
    for m, _, s, w in rows:
        n[m] += 1
        at = [(i, c) for i, c in enumerate(s or "", 1) if c in "ACGU"]
        for i, c in at:
            single[m, i, c] += w
        for i, x in at:
            for j, y in at:
                if i < j:
                    joint[m, i, j, x + y] += w
    whole = Counter()
    for (m, i, j, _), w in joint.items():
        whole[m, i, j] += w
    found = al.joint_profiles(given)
    got = found.collect()
    assert {(r.msa_id, r.i, r.j): r.both for r in got} == pytest.approx({k: w for k, w in whole.items() if w > 0})
    for r in got:
        for x in "ACGU":
            assert r[f"i_{x}"] == pytest.approx(single[r.msa_id, r.i, x]) and r[f"j_{x}"] == pytest.approx(single[r.msa_id, r.j, x])
            assert all(r[x + y] == pytest.approx(joint[r.msa_id, r.i, r.j, x + y]) for y in "ACGU")
    information = al.expected_information(given, 8)
    assert {(r.msa_id, r.i, r.j) for r in information.collect()} == {k for k, w in whole.items() if w > 0}
    assert information.where("msa_id = 'copies' AND abs(mi) > 1e-9").count() == 0
    for df in (found, information):  # alignments are sent to tasks once; nothing is paired or joined outside of them
        assert df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
