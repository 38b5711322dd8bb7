"""Pairs of an alignment's rows against enumeration, and how many rows they shuffle."""

import itertools
import random

import pytest

from ribolens.kernels import strings as ks
from ribolens.operators import alignment as al
from ribolens.operators import kernels as kn


def shuffled_rows(spark, job):
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    return job(), total() - before


@pytest.mark.parametrize("parts", [1, 3])
def test_rows_of_many_blocks_are_shuffled_once_for_each_part(spark, monkeypatch, parts):
    monkeypatch.setattr(al, "BLOCK_ROWS", 10)
    monkeypatch.setattr(al, "PART_BLOCKS", -(-40 // parts))
    rows = [("a", k * 7 % 401, f"x{k * 7 % 401}") for k in range(400)] + [("b", 1, "x1"), ("c", 5, "x5"), ("c", 3, "x3")]
    at = spark.createDataFrame(rows, "msa_id string, seq_id long, text string")
    got, moved = shuffled_rows(spark, lambda: al.row_pairs(at, ("text",)).collect())
    expected = [(m, x, y) for m in "abc" for x, y in itertools.combinations(sorted(s for n, s, _ in rows if n == m), 2)]
    assert sorted((r.msa_id, r.s1, r.s2) for r in got) == sorted(expected)
    assert all((r.a_text, r.b_text) == (f"x{r.s1}", f"x{r.s2}") for r in got)
    assert moved < len(rows) * (6 + parts)  # 40 blocks would meet 41 times


def test_columns_for_which_sides_do_not_matter(spark):
    at = spark.createDataFrame([("a", k, k * k) for k in range(9)], "msa_id string, seq_id long, square long")
    got = al.row_pairs(at.withColumn("again", at["square"]), ("square",), ("again",)).collect()
    assert len(got) == 36 and all((r.a_square, r.b_square) == (r.s1**2, r.s2**2) and {r.a_again, r.b_again} == {r.s1**2, r.s2**2} for r in got)


def test_local_alignments_at_once_equal_those_one_by_one():
    """Ties of ways, strings of no or too many characters, and such as aren't ASCII."""
    rng = random.Random(1)
    text = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    a = [text(rng.choice([0, 1, 2, 9, 20, 63, 64]), rng.choice(["A", "AC", "ACGU"])) for _ in range(300)]
    b = [text(rng.choice([0, 1, 7, 30, 63, 70]), "AC") if k % 3 else x[: len(x) // 2] + text(3, "ACGU") + x[len(x) // 3 :] for k, x in enumerate(a)]
    a, b = [*a, "é", "ACG", "A\x80C"], [*b, "éA", "acG", "\x81A\x80"]
    assert ks.local_alignments(a, b).tolist() == [list(map(int, ks.local_alignment(x, y))) for x, y in zip(a, b, strict=True)]
    assert ks.local_alignments([], []).shape == (0, 5)


def test_aligned_pairs_stay_where_they_are_made(spark):
    rows = spark.createDataFrame([("m", 1, 2, "ACGU", "CG"), ("m", 1, 3, "ACGU", "CG"), ("m", 2, 3, "", "A"), ("n", 1, 2, None, "A")], "msa_id string, s1 long, s2 long, a string, b string")
    got = kn.locally_aligned(rows)
    assert sorted(tuple(r) for r in got.collect()) == [("m", 1, 2, 4.0, 2, 3, 1, 2), ("m", 1, 3, 4.0, 2, 3, 1, 2), ("m", 2, 3, 0.0, 0, 0, 0, 0)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
