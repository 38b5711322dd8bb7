"""Folding kernels against enumeration of all structures."""

import random

import numpy as np
import pytest

from ribolens.kernels import folding, loops
from ribolens.kernels.strings import pair_table

MODEL = loops.default_model()
#: Small loops by random tables, helices in multiloops that pay, and pairs of all kinds.
RNG = np.random.default_rng(5)
ROUGH = MODEL.with_tables(
    int11=RNG.integers(-200, 200, (8, 8, 5, 5)), int21=RNG.integers(-200, 200, (8, 8, 5, 5, 5)), int22=RNG.integers(-200, 200, (8, 8, 5, 5, 5, 5)),
    mismatch_interior=RNG.integers(-90, 90, (8, 5, 5)), stack=np.where(MODEL.stack < 9999, RNG.integers(-300, 100, (8, 8)), MODEL.stack), ml_closing=-300, ml_intern=-70, ml_base=-13,
    hairpin=np.where(MODEL.hairpin < 9999, MODEL.hairpin - 400, MODEL.hairpin), triloops={"GAAAC": -150, "CUUUG": 70},
)


def structures(seq):
    """Partners of all structures of canonical pairs with three residues at least in each hairpin."""
    s, n = loops.codes(seq), len(seq)

    def grow(i, j):
        if j - i < 4:
            yield ()
            return
        yield from grow(i + 1, j)
        for k in range(i + 4, j + 1):
            if loops.KINDS[s[i], s[k]]:
                for a in grow(i + 1, k - 1):
                    for b in grow(k + 1, j):
                        yield ((i, k), *a, *b)

    for pairs in grow(0, n - 1):
        partner = [-1] * n
        for i, j in pairs:
            partner[i], partner[j] = j, i
        yield pairs, partner


def some_sequences(rng, count, least, most):
    return ["".join(rng.choice("GGCCAUN") for _ in range(rng.randint(least, most))) for _ in range(count)] + ["GGGAAACGAAACCC", "GCGAAAGCGAAAGC"]


@pytest.mark.parametrize("model", [MODEL, ROUGH], ids=["published", "rough"])
def test_all_structures(model):
    """The least energy, the ensemble and the probability of each pair, of sequences of different lengths at a time."""
    seqs = some_sequences(random.Random(1), 12, 0, 15)
    energies, probabilities = folding.partition(seqs, model)
    for seq, (ss, energy), ensemble, p in zip(seqs, folding.best(seqs, model), energies, probabilities, strict=True):
        own = loops.Loops(model, seq)
        every = [(pairs, own.structure(partner)) for pairs, partner in structures(seq)]
        assert energy == pytest.approx(min(e for _, e in every) / 100)
        assert own.structure(pair_table(ss)) / 100 == pytest.approx(energy)
        factor = np.exp([-e / (100 * loops.KT) for _, e in every])
        assert ensemble == pytest.approx(-loops.KT * np.log(factor.sum()), abs=1e-9)
        expected = np.zeros_like(p)
        for (pairs, _), x in zip(every, factor / factor.sum(), strict=True):
            for i, j in pairs:
                expected[i, j] += x
        assert np.allclose(p, expected, atol=1e-9)


def test_multiloops_are_reached():
    """Structures with a loop of three helices count in the rough model."""
    seq = "GGAAACGAAACC"[:2] + "GAAAC" + "GAAAC" + "CC"
    every = {tuple(sorted(pairs)) for pairs, _ in structures(seq)}
    assert any(sum(1 for p in pairs if any(q[0] < p[0] and p[1] < q[1] for q in pairs)) >= 2 for pairs in every)
    ss, energy = folding.best([seq], ROUGH)[0]
    assert energy * 100 == min(loops.Loops(ROUGH, seq).structure(partner) for _, partner in structures(seq))


def test_known_hairpin():
    """Stacks GC-GC -3.4 and GC-CG -3.3... by hand: three G-C stacks, a tetraloop with its bonus and mismatch."""
    own = loops.Loops(MODEL, "GGGGAAACCC")
    e = own.structure(pair_table("(((....)))"))
    assert e == 2 * -330 + 560 + int(MODEL.mismatch_hairpin[2, 3, 1]) + MODEL.tetraloops.get("GGAAAC", 0)
    assert own.structure([-1] * 10) == 0


def test_padding_changes_nothing():
    alone = [folding.partition([s], MODEL) for s in ("GGGAAACCC", "GGGAAACCCAAGGGAAACCC")]
    energies, p = folding.partition(["GGGAAACCC", "GGGAAACCCAAGGGAAACCC"], MODEL)
    assert energies.tolist() == pytest.approx([alone[0][0][0], alone[1][0][0]])
    assert np.allclose(p[0, :9, :9], alone[0][1][0]) and not p[0, 9:].any() and not p[0, :, 9:].any()
    assert folding.partition([], MODEL)[0].size == 0 and folding.best(["", ""], MODEL) == [("", 0.0)] * 2


def test_parameter_files():
    """Written models are read back; kept, extrapolated and named numbers; comments; what isn't a file."""
    from ribolens.sources import energies

    text = energies.energies_text(ROUGH)
    back = energies.parse_energies(text)
    for table, at in energies.SHAPES.values():
        assert (getattr(back, table)[at] == getattr(ROUGH, table)[at]).all()
    assert back.triloops == ROUGH.triloops and back.ml_closing == -300
    short = energies.parse_energies("## RNAfold parameter file\n\n# hairpin /* by length */\nINF INF INF * 444 x " + "* " * 25 + "\n# ML_params\n1 2 3 4\n# Triloops\nGAAAC -7\n# unknown_part\n1 2\n")
    assert short.hairpin[:6].tolist() == [loops.NEVER] * 3 + [570, 444, 444 + round(107.856 * float(np.log(5 / 4)))] and short.hairpin[6] == 540
    assert (short.ml_base, short.ml_closing, short.ml_intern, short.terminal_au, short.triloops) == (1, 2, 3, 4, {"GAAAC": -7})
    for bad in ("nothing", "## RNAfold parameter file\n# bulge\n1 2 3\n", "## RNAfold parameter file\n# hairpin\nx " + "1 " * 30):
        with pytest.raises(ValueError):
            energies.parse_energies(bad)


ALIGNED = [("m", 1, "GGGA-AACCC", 1.0), ("m", 2, "GGGA-AACCC", 0.5), ("m", 3, "-GCAUAAGC-", 1.0), ("m", 4, "----------", 2.0), ("m", 5, "GG-AAAA-CC", 0.7), ("n", 6, "A-G-C-U-A-", 1.0)]


@pytest.fixture(scope="module")
def aligned(spark):
    return spark.createDataFrame(ALIGNED, "msa_id string, seq_id long, aseq string, weight double")


@pytest.fixture(scope="module")
def exact():
    """(i, j) to the summed weight times probability, by enumeration, with each row's bounds."""
    out = {}
    for msa, _, aseq, w in ALIGNED:
        at = [n for n, c in enumerate(aseq, 1) if c != "-"]
        own = loops.Loops(MODEL, aseq.replace("-", ""))
        every = [(pairs, np.exp(-own.structure(partner) / (100 * loops.KT))) for pairs, partner in structures(own.seq)]
        z = sum(x for _, x in every)
        for pairs, x in every:
            for i, j in pairs:
                out[msa, at[i], at[j]] = out.get((msa, at[i], at[j]), 0) + w * x / z
    return out


def test_average_probabilities(aligned, exact):
    from ribolens.operators.folding import average_probabilities

    total = {"m": 5.2, "n": 1.0}
    got = {(r.msa_id, r.i, r.j): r.p for r in average_probabilities(aligned).collect()}
    assert got == {k: pytest.approx(x / total[k[0]]) for k, x in exact.items()}
    ends = [(m, min(at), max(at), w) for m, _, aseq, w in ALIGNED if (at := [n for n, c in enumerate(aseq, 1) if c != "-"])]
    got = {(r.msa_id, r.i, r.j): r.p for r in average_probabilities(aligned, fragments=True).collect()}
    assert got == {(m, i, j): pytest.approx(x / sum(w for n, a, b, w in ends if n == m and a <= i and j <= b)) for (m, i, j), x in exact.items()}
    assert average_probabilities(aligned.limit(0)).count() == 0


def test_column_log_odds(aligned):
    from ribolens.operators.folding import column_log_odds, standard_log_odds

    number, expected = {"A": (0,), "C": (1,), "G": (2,), "U": (3,), "-": (0, 1, 2, 3)}, {}
    for msa in "mn":
        rows = [(a, w) for m, _, a, w in ALIGNED if m == msa]
        for i in range(1, 11):
            for j in range(i + 1, 11):
                met = [(a[i - 1], a[j - 1], w) for a, w in rows if a[i - 1] != "-" or a[j - 1] != "-"]
                if any("-" not in (x, y) for x, y, _ in met):
                    expected[msa, i, j] = max(-400, 0.5 * 144.269504 * sum(w * standard_log_odds(number[x], number[y]) for x, y, w in met) / sum(w for *_, w in met))
    got = {(r.msa_id, r.i, r.j): r.log_odds for r in column_log_odds(aligned).collect()}
    assert got == {k: pytest.approx(x) for k, x in expected.items()}
    assert standard_log_odds((1,), (2,)) == pytest.approx(np.log(0.2315 / (0.235 * 0.261)))


def test_structure_measures(spark, aligned, exact):
    """Counts, probabilities, conflicts and energies of a structure, row by row."""
    from ribolens.operators.folding import average_probabilities, structure_measures

    ss = {"m": "<<<....>>>", "n": "<........>"}
    given = spark.createDataFrame(list(ss.items()), "msa_id string, ss string")
    got = {r.msa_id: r for r in structure_measures(aligned, given, average_probabilities(aligned)).collect()}
    for msa, total in (("m", 5.2), ("n", 1.0)):
        partner = pair_table(ss[msa])
        pairs = [(i, j) for i, j in enumerate(partner) if j > i]
        p = {(i, j): exact.get((msa, i + 1, j + 1), 0) / total for i, j in pairs}
        conflict = deleted = energy = 0.0
        for m, _, a, w in ALIGNED:
            if m != msa:
                continue
            for i, j in pairs:
                if a[i] == a[j] == "-":
                    deleted += w * p[i, j]
                elif a[i] + a[j] not in ("AU", "UA", "CG", "GC", "GU", "UG"):
                    conflict += w * p[i, j]
            opened = {x for i, j in pairs if "-" in (a[i], a[j]) for x in (i, j)}
            own = "".join("." if n in opened else c for n, c in enumerate(ss[msa]) if a[n] != "-")
            energy += w * min(10, loops.Loops(MODEL, a.replace("-", "")).structure(pair_table(own)) / 100)
        assert tuple(got[msa])[1:] == (len(pairs), pytest.approx(sum(p.values())), pytest.approx(conflict), pytest.approx(deleted), pytest.approx(energy / total))


def test_folding_operators(spark):
    """Repeated, empty and null sequences; runs of very different lengths; structures that don't fit."""
    from ribolens.operators import folding as fo

    seqs = ["GGGAAACCC", "", None, "GGGAAACCC", "A", "GGGGAAAACCCC" * 12, "GC" * 30, "NNNN"]
    rows = spark.createDataFrame([(s, 1) for s in seqs], "seq string, structure int")
    got = {r.seq: (r.structure, r.energy) for r in fo.best_structures(rows).collect()}
    assert got == {s: x for s, x in zip(sorted({x for x in seqs if x is not None}), folding.best(sorted({x for x in seqs if x is not None}), MODEL), strict=True)}
    found = {r.seq: r for r in fo.pair_probabilities(rows).collect()}
    assert set(found) == set(got) and found["A"].pairs == [] and all(0 < x.p <= 1 + 1e-9 for r in found.values() for x in r.pairs)
    for s, r in found.items():
        assert r.ensemble <= got[s][1] + 1e-9
    given = spark.createDataFrame([("GGGAAACCC", "(((...)))"), ("GGGAAACCC", "[[[...>>>"), ("GGGAAACCC", "(((...))"), ("GGGAAACCC", "((((..)))"), ("", ""), (None, "")], "seq string, ss string")
    energy = {(r.seq, r.ss): r.energy for r in fo.structure_energies(given).collect()}
    whole = loops.Loops(MODEL, "GGGAAACCC").structure(pair_table("(((...)))")) / 100
    assert energy == {("GGGAAACCC", "(((...)))"): whole, ("GGGAAACCC", "[[[...>>>"): whole, ("GGGAAACCC", "(((...))"): None, ("GGGAAACCC", "((((..)))"): None, ("", ""): 0.0}
