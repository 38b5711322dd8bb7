"""Steps whose work or memory grew faster than their input (findings of round 3)."""

import pytest

from ribolens.catalog import motifs as mo
from ribolens.operators import intervals as iv


def test_most_overlap_aggregates_pairs_where_they_are_made(spark):
    """Ties go to the smaller id, with the least and largest 64-bit integers too; no pairs are sorted or numbered in a window."""
    far = 2**63 - 1
    rows = [(1, 5, 3), (1, -far, 3), (1, far, 3), (1, 0, 2), (2, far, far), (2, far - 1, far), (3, 7, 0)]
    best = iv.most_overlap(spark.createDataFrame(rows, "hit_id long, r_hit_id long, overlap long"), "hit_id", "r_hit_id")
    assert sorted(map(tuple, best.collect())) == [(1, -far, 3), (2, far - 1, far), (3, 7, 0)]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_motifs_of_odd_lines(spark, tmp_path, monkeypatch):
    """Lines without supplier, quantity or discount, an order given twice, and orders in as many partitions as lines need."""
    monkeypatch.setattr(mo, "TASK_LINES", 1)
    line = [(1, 5, 2.0, 0.1), (1, 5, 4.0, None), (1, 6, None, 0.3), (1, None, 6.0, 0.2), (2, 7, 3.0, 0.0), (3, None, None, None), (9, 1, 1.0, 0.0)]
    spark.createDataFrame(line, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 20), (2, 20), (3, 30)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.motif: r for r in mo.motifs(spark, str(tmp_path)).collect()}
    assert {k: (r.family, r.num, r.species, r.conserved, r.pairs, r.len) for k, r in got.items()} == {1: (10, 4.0, 2.0, 1.2, 12.0, 4.0), 2: (20, 2.0, 1.0, 0.6, 6.0, 3.0), 3: (30, 1.0, 0.0, None, None, None)}
    assert got[1].identity == pytest.approx(0.5 + 0.2 * 4) and got[3].identity is None
    assert mo.motifs(spark, str(tmp_path)).rdd.getNumPartitions() == 8  # a line a task and one more


def test_average_probabilities_over_batches(spark):
    """An alignment whose rows come in several batches has the means of one batch; rows are exchanged once, and no pairs are."""
    import random

    from ribolens.operators.folding import average_probabilities

    rng = random.Random(4)
    rows = [(m, "".join(rng.choice("ACGU-") for _ in range(24)), rng.choice([0.5, 1.0])) for m in "aaaaaaaabbbcdddd"] + [("e", "-" * 24, 1.0), ("f", "ACGU", 1.0)]
    frame = spark.createDataFrame(rows, "msa_id string, aseq string, weight double")
    for fragments in (False, True):
        whole = average_probabilities(frame, fragments)
        assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        expected = {(r.msa_id, r.i, r.j): r.p for r in whole.collect()}
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        try:
            got = {(r.msa_id, r.i, r.j): r.p for r in average_probabilities(frame, fragments).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == pytest.approx(expected) and {k[0] for k in got} >= set("abd")


@pytest.mark.parametrize("form", ["phylip", "phylips"])
def test_phylip_lines_carry_their_name_alone(spark, form):
    """Rows whose names are alike in ten characters stay rows of their own: lines are put together by where they stand, and
    no line is given all lines of its text to find its name."""
    from ribolens.sources import msaformats

    rows = [("m", n, f"alignment-{n}", "ACGU" * 6 + "AC-"[: n % 3 + 1] + "-" * (2 - n % 3)) for n in range(5)]
    texts = msaformats.write_msa(spark.createDataFrame(rows, "msa_id string, ordinal long, name string, aseq string"), form, 10)
    got = msaformats.read_msa(texts, form)
    assert sorted(r.aseq for r in got.collect()) == sorted(r[3] for r in rows) and {r.name for r in got.collect()} == {"alignment-"}


@pytest.mark.parametrize("block", [10_000, 5])
def test_weighted_identity_makes_no_pairs(spark, monkeypatch, block):
    """Strings are compared in blocks inside tasks: the means are those of all pairs, and rows aren't joined to rows."""
    import random

    from ribolens.operators import alignment as al

    monkeypatch.setattr(al, "LARGE_BLOCK", block)
    rng = random.Random(block)
    rows = [(f"m{k % 3}", k, "".join(rng.choice("ACGU" + "-" * 4 * (k % 3)) for _ in range(14)), rng.choice([0.5, 1.0])) for k in range(60)]
    rows += [("m1", 100 + k, "ACGUACGUACGUAC", 0.5) for k in range(4)] + [("m2", 200, "-" * 14, 1.0), ("one", 1, "-" * 14, 1.0), ("two", 1, "A" + "-" * 13, 1.0), ("two", 2, "C" + "-" * 13, 1.0)]
    expected = {"one": 1.0, "two": None}
    for m in ("m0", "m1", "m2"):
        same = pairs = 0.0
        own = [r for r in rows if r[0] == m]
        for n, (_, _, a, u) in enumerate(own):
            for _, _, b, w in own[n + 1 :]:
                columns = sum(x != "-" or y != "-" for x, y in zip(a, b, strict=True))
                if columns >= 10:
                    same += u * w * sum(x == y != "-" for x, y in zip(a, b, strict=True)) / columns
                    pairs += u * w
        expected[m] = same / pairs
    got = al.weighted_identity(spark.createDataFrame(rows, "msa_id string, seq_id long, aseq string, weight double"), 14)
    assert {r.msa_id: r.mean_identity for r in got.collect()} == pytest.approx(expected)
    assert "bit_count((a_m" not in got._jdf.queryExecution().toString()


def test_log_odds_are_taken_where_means_are_made(spark):
    """As by joins of means to their columns; rows are exchanged once, and with least only what can be evidence comes back."""
    import random

    from ribolens.operators import alignment as al
    from ribolens.operators import folding as fo

    rng = random.Random(9)
    rows = [(m, k, "".join(rng.choice("ACGU-") for _ in range(26)), rng.choice([0.5, 1.0])) for k, m in enumerate("aaaaabbbccd")]
    rows += [("strong", 100, "GGGGGCAAAAGCCCCC", 1.0), ("none", 101, "-----", 1.0)]
    frame = spark.createDataFrame(rows, "msa_id string, seq_id long, aseq string, weight double")
    key = lambda t: {(r.msa_id, r.i, r.j): r[3] for r in t.collect()}
    expected = key(al.pair_log_odds(fo.average_probabilities(frame)))
    whole = fo.fold_log_odds(frame)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    assert key(whole) == pytest.approx(expected) and len(expected) > 100
    some = key(fo.fold_log_odds(frame, least=0.0))
    assert some == pytest.approx({k: x for k, x in expected.items() if x is not None and x >= 0}) and 0 < len(some) < len(expected)
    information = al.expected_information(frame, 26)
    every = {k: x for k, x in key(al.merged_evidence(information, al.pair_log_odds(fo.average_probabilities(frame)))).items() if x and x > 0}
    assert {k: x for k, x in key(al.merged_evidence(information, fo.fold_log_odds(frame, least=0.0), known=True)).items() if x > 0} == pytest.approx(every)
