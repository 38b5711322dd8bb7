"""Sums over streamed rows against brute force over each alignment."""

import random

import pytest

from ribolens.operators import streamed as sm

ROWS = "msa_id string, seq_id long, aseq string, weight double"


def _rows(width, seed=3):
    rng = random.Random(seed)
    rows = [(f"m{k % 7}", k, "".join(rng.choice("ACGU" + "-" * (k % 9)) for _ in range(width)), rng.choice([0.5, 1.0])) for k in range(120)]
    return [*rows, ("gaps", 1, "-" * width, 1.0), ("gaps", 2, "-" * width, 1.0), ("one", 1, "A" * width, 1.0)]


@pytest.fixture(params=["3", "10000"])
def batched(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_mapped_columns_without_cells(batched, monkeypatch):
    monkeypatch.setattr(sm, "GIVEN", 50)
    rows, kept, want = _rows(20), [1, 2, 5, 6, 7, 11, 12, 20], {}
    for msa, _, text, _ in rows:
        whole = [c for c in range(1, 21) if text[c - 1] != "-"]
        fewer = [n for n, c in enumerate(kept, 1) if text[c - 1] != "-"]
        for pair in zip(whole, fewer, strict=False):
            want[msa, *pair] = want.get((msa, *pair), 0) + 1
    found = sm.mapped_columns(batched.createDataFrame([*rows, ("m1", None, "A" * 20, 1.0)], ROWS), 20, kept)
    assert {(r.msa_id, r.col1, r.col2): r.n for r in found.collect()} == want


def test_mapped_columns_query_shuffles_rows_alone(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["J23_mapped_columns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate") == 1


def test_identity_sums_of_one_block_and_of_two(monkeypatch):
    import numpy as np

    monkeypatch.setattr(sm, "NEAR", 40)
    texts = [r[2] for r in _rows(14)]
    weight = np.array([r[3] for r in _rows(14)])
    bits = sm.bit_masks(sm._NUMBER[np.array([list(t.encode()) for t in texts])])
    share = {}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            columns = sum(x != "-" or y != "-" for x, y in zip(a, b, strict=True))
            counted = weight[i] * weight[j] * (columns >= 10)
            share[i, j] = counted * sum(x == y != "-" for x, y in zip(a, b, strict=True)) / max(columns, 1), counted
    for got, pairs in (
        (sm.identity_sums((bits, weight), None, 10), [(i, j) for i, j in share if i < j]),
        (sm.identity_sums((bits[:50], weight[:50]), (bits[50:], weight[50:]), 10), [(i, j) for i, j in share if i < 50 <= j]),
    ):
        assert got == pytest.approx(tuple(sum(share[p][k] for p in pairs) for k in range(2)))


@pytest.mark.parametrize("limit", [10_000, 5])
def test_summary_passes_rows_once(batched, monkeypatch, limit):
    """As by cells and pairs of columns, but from one stream of rows; none of those is made."""
    from ribolens.operators import alignment as al
    from ribolens.plans.summary import summary

    monkeypatch.setattr(al, "LARGE_BLOCK", limit)
    frame, pairs = batched.createDataFrame([*_rows(24), ("light", 1, "A" * 24, 0.0), *[("same", k, "ACGU" * 6, 1.0) for k in range(9)]], ROWS), [(1, 24), (3, 20), (5, 6)]
    found = summary(frame, pairs, 24)
    assert "posexplode" not in found._jdf.queryExecution().toString()
    got = {r.msa_id: (r.num, r.entropy, r.conserved, r.mi, r.mean_identity) for r in found.collect()}
    by_cells = {r.msa_id: (r.entropy, r.conserved) for r in al.column_statistics(al.cells(frame)).collect()}
    mi = {}
    for r in al.mutual_information(al.pair_cells(frame, pairs)).collect():
        mi[r.msa_id] = mi.get(r.msa_id, 0.0) + r.mi
    identity = {r.msa_id: r.mean_identity for r in al.weighted_identity(frame, 24).collect()}
    assert got["light"][1:] == (None, None, None, 1.0) and got["same"][2] == 24 and len(got) == 11
    for msa, (_, entropy, conserved, m, mean) in got.items():
        assert (entropy, conserved) == pytest.approx(by_cells.get(msa, (None, None))) and m == pytest.approx(mi.get(msa)) and mean == pytest.approx(identity[msa])


@pytest.mark.parametrize("first", [500, 3])
def test_mean_differences_make_no_pairs(batched, monkeypatch, first):
    from ribolens.operators import alignment as al

    monkeypatch.setattr(sm, "FIRST", first)
    monkeypatch.setattr(al, "LARGE_BLOCK", 4)
    rows = [*_rows(16), *[("alike", k, "ACGU" * 3 + "ACG"[k % 3] + "---", 1.0) for k in range(9)], ("alike", 20, "ACGU" + "-" * 12, 1.0), ("alike", None, "-" * 16, 1.0)]
    rows += [("m1", rows[1][1], "ACGU" * 4, 1.0), ("m1", rows[1][1], "-" * 16, 1.0), ("m2", rows[107][1], "ACGU" * 4, 1.0), ("twin", 1, "A" * 16, 1.0), ("twin", 1, "C" * 16, 1.0)]
    want = {}
    for m in {r[0] for r in rows}:
        own, each = [r for r in rows if r[0] == m and r[1] is not None], []
        for n, a in enumerate(own):
            for b in own[n + 1 :]:
                if a[1] != b[1]:
                    least = min(16 - a[2].count("-"), 16 - b[2].count("-"))
                    each.append(sum(x == y != "-" for x, y in zip(a[2], b[2], strict=True)) / least if least else 0.0)
        if each:
            want[m] = sum(each) / len(each), 1 - sum(each) / len(each), 1 - min(each)
    found = sm.mean_differences(batched.createDataFrame(rows, ROWS), 16)
    assert "bit_count((a_m" not in found._jdf.queryExecution().toString()
    got = {r.msa_id: (r.identity, r.difference, r.largest) for r in found.collect()}
    assert got.keys() == want.keys() and "twin" not in got and 0 < want["alike"][2] < 1
    for m, x in want.items():
        assert got[m] == pytest.approx(x)
