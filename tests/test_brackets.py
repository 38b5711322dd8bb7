"""Operators on structures' rows, each row by itself, against the relational forms and a stack."""

import random

import pytest

from ribolens.kernels import brackets
from ribolens.operators import candidates as cd
from ribolens.operators import structures as sx


def drawn(n=300, kinds="()<>..aA", seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(kinds) for _ in range(rng.randrange(0, 14))) for _ in range(n)] + ["", "(((...)))", "(()())", "((..)(..))..()", "é(\U0001f9ec)"]


def stacked(text):
    stack, pairs, alone = [], [], set()
    for n, c in enumerate(text):
        if c in "(<[{":
            stack.append(n)
        elif c in ")>]}":
            if stack:
                pairs.append((stack.pop() + 1, n + 1))
            else:
                alone.add(n)
    return sorted(pairs), alone | set(stack)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(drawn(), drawn(seed=4), strict=True))] + [(-1, None, "()")], "key long, ss string, other string").repartition(3)


def local(df):
    """The rows, of a plan without any exchange but the input's own."""
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    return sorted(tuple(r) for r in df.collect())


def test_alone_and_pairs_are_those_of_a_stack():
    texts = drawn(2000)
    chars, of, first = brackets.characters(texts)
    found = brackets.alone(brackets.steps(chars, "(<", ")>"), of, first)
    for n, text in enumerate(texts):
        assert set((found[first[n] : first[n + 1]]).nonzero()[0].tolist()) == stacked(text)[1], text


def test_rows_need_no_shuffle_and_equal_the_relational_forms(spark, rows):
    pairs = sx.pair_rows(rows, "key")
    expected = sorted((k, *p) for k, text in enumerate(drawn()) if not stacked(text)[1] for p in stacked(text)[0])
    assert local(pairs) == expected
    assert local(sx.helix_rows(rows, "key")) == sorted(tuple(r) for r in sx.helices(pairs, "key").collect())
    texts = dict(enumerate(drawn()))
    plain = lambda x: "".join("(" if c in "(<" else ")" if c in ")>" else "" for c in x)
    inside = {(k, i, j): plain(texts[k][i : j - 1]) for k, i, j in expected}
    assert local(sx.loop_kinds(rows, "key")) == sorted((*at, x == "", ")(" in x) for at, x in inside.items())
    other = sx.pair_rows(rows, "key", "other")
    assert local(sx.compared_structures(rows.where("key >= 0"), "key", "ss", "other")) == sorted(tuple(r) for r in sx.compared(pairs, other.where("key >= 0"), "key").collect())
    assert local(cd.structure_agreement(rows.where("key >= 0"), "key", "ss", "other")) == sorted(tuple(r) for r in cd.pair_agreement(pairs, other.where("key >= 0"), ["key", "i", "j"]).collect())


def test_kept_columns_and_connectivity_need_no_shuffle(spark, rows):
    held = dict(enumerate(drawn()))
    got = dict(local(sx.kept_columns(rows, "key", lambda place: place % 3 != 2)))
    keep = lambda n: n % 3 != 2
    for k, text in held.items():
        pairs, alone = stacked(text)
        if alone or not text:
            assert k not in got
            continue
        marks = {i: "(" for i, j in pairs if keep(i) and keep(j)} | {j: ")" for i, j in pairs if keep(i) and keep(j)}
        assert got[k] == "".join(marks.get(n, ".") for n in range(1, len(text) + 1) if keep(n)), text
    lines = local(sx.ct_lines(rows.withColumn("seq", rows["ss"]), "key").select("key", "place", "partner"))
    assert [(k, i, j) for k, i, j in lines if j > i] == sorted((k, *p) for k, t in held.items() if not stacked(t)[1] for p in stacked(t)[0])
