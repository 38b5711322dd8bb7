"""Nearest-neighbour loop energies of RNA structures, in hundredths of a kcal/mol at 37 degrees."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

#: Residues: 0 anything else, then A, C, G, U. Pairs: 0 none, 1 to 6 in the order of PAIRS, 7 any other two residues.
LETTERS, PAIRS, OTHER_PAIR = "ACGU", ("CG", "GC", "GU", "UG", "AU", "UA"), 7
TURN, LONGEST, NEVER = 3, 30, 1_000_000
#: kcal/mol at 37 degrees.
KT = 1.98717e-3 * 310.15

# Published nearest-neighbour parameters (Mathews, Sabina, Zuker and Turner 1999).
STACK = """
-240 -330 -210 -140 -210 -210
-330 -340 -250 -150 -220 -240
-210 -250  130  -50 -140 -130
-140 -150  -50   30  -60 -100
-210 -220 -140  -60 -110  -90
-210 -240 -130 -100  -90 -130
"""
HAIRPIN = "570 560 560 540 590 560 640 650 660 670 678 686 694 701 707 713 719 725 730 735 740 744 749 753 757 761 765 769"
BULGE = "380 280 320 360 400 440 459 470 480 490 500 510 519 527 534 541 548 554 560 565 571 576 580 585 589 594 598 602 605 609"
INTERNAL = "410 510 170 180 200 220 230 240 250 260 270 278 286 294 301 307 313 319 325 330 335 340 345 349 353 357 361 365 369"
MISMATCH_HAIRPIN = """
-150 -150 -140 -180 -100  -90 -290  -80 -220 -200 -160 -110 -170 -140 -180 -200
-110 -150 -130 -210 -110  -70 -240  -50 -240 -290 -140 -120 -190 -100 -220 -150
  20  -50  -30  -30  -10  -20 -150  -20  -90 -110  -30    0  -30  -30  -40 -110
 -50  -30  -60  -50  -20  -10 -170    0  -80 -120  -30  -70  -60  -10  -60  -80
 -30  -50  -30  -30  -10  -20 -150  -20 -110 -120  -20   20  -30  -30  -60 -110
 -50  -30  -60  -50  -20  -10 -120    0 -140 -120  -70  -20  -30  -10  -50  -80
"""
DANGLE_5 = """
-50 -30 -20 -10
-20 -30   0   0
-30 -30 -40 -20
-30 -10 -20 -20
-30 -30 -40 -20
-30 -10 -20 -20
"""
DANGLE_3 = """
-110 -40 -130  -60
-170 -80 -170 -120
 -70 -10  -70  -10
 -80 -50  -80  -60
 -70 -10  -70  -10
 -80 -50  -80  -60
"""
TETRALOOPS = """
GGGGAC -300 GGUGAC -300 CGAAAG -300 GGAGAC -300 CGCAAG -300 GGAAAC -300 CGGAAG -300 CUUCGG -300 CGUGAG -300 CGAAGG -250
CUACGG -250 GGCAAC -250 CGCGAG -250 UGAGAG -250 CGAGAG -200 AGAAAU -200 CGUAAG -200 CUAACG -200 UGAAAG -200 GGAAGC -150
GGGAAC -150 UGAAAA -150 AGCAAU -150 AGUAAU -150 CGGGAG -150 AGUGAU -150 GGCGAC -150 GGGAGC -150 GUGAAC -150 UGGAAA -150
"""
TERMINAL_AU, ML_BASE, ML_CLOSING, ML_INTERN, NINIO, MOST_NINIO, EXTRAPOLATE = 50, 0, 340, 40, 50, 300, 107.856
MISMATCH_BASE = {"CG": 0, "GC": 0, "other": 70, "unpaired": 90}
MISMATCH_BONUS = {"AG": -110, "GA": -110, "UU": -70}
UNKNOWN_MISMATCH = {"CG": -90, "GC": -70}


@dataclass(frozen=True)
class LoopModel:
    """Tables by pair kind (0 to 7) and residue (0 to 4); loops by their number of unpaired residues (0 to 30)."""

    stack: np.ndarray
    hairpin: np.ndarray
    bulge: np.ndarray
    internal: np.ndarray
    mismatch_hairpin: np.ndarray
    mismatch_interior: np.ndarray
    dangle5: np.ndarray
    dangle3: np.ndarray
    int11: np.ndarray
    int21: np.ndarray
    int22: np.ndarray
    tetraloops: dict
    triloops: dict
    terminal_au: int = TERMINAL_AU
    ml_base: int = ML_BASE
    ml_closing: int = ML_CLOSING
    ml_intern: int = ML_INTERN
    ninio: int = NINIO
    most_ninio: int = MOST_NINIO
    extrapolate: float = EXTRAPOLATE

    def with_tables(self, **tables) -> LoopModel:
        return replace(self, **tables)

    def length(self, table: np.ndarray, n: int) -> int:
        """A loop's initiation, extrapolated by the logarithm of its size beyond LONGEST."""
        return int(table[n]) if n <= LONGEST else int(table[LONGEST]) + int(self.extrapolate * np.log(n / LONGEST))


def _numbers(text: str) -> np.ndarray:
    return np.array(text.split(), np.int64)


def _loops(text: str, first: int) -> np.ndarray:
    return np.concatenate([np.full(first, NEVER), _numbers(text)])


def default_model() -> LoopModel:
    """The published tables. Interior loops of one to two residues a side have tables too large to state here: they follow
    rules fitted to them, by the number of closing AU or GU pairs, unless a parameter file gives them."""
    stack = np.zeros((8, 8), np.int64)
    stack[0, :], stack[:, 0] = NEVER, NEVER
    stack[1:7, 1:7] = _numbers(STACK).reshape(6, 6)
    hairpin_mm, interior_mm, d5, d3 = np.zeros((8, 5, 5), np.int64), np.zeros((8, 5, 5), np.int64), np.zeros((8, 5), np.int64), np.zeros((8, 5), np.int64)
    hairpin_mm[1:7, 1:, 1:] = _numbers(MISMATCH_HAIRPIN).reshape(6, 4, 4)
    d5[1:7, 1:], d3[1:7, 1:] = _numbers(DANGLE_5).reshape(6, 4), _numbers(DANGLE_3).reshape(6, 4)
    for n, pair in enumerate(PAIRS, 1):
        hairpin_mm[n, 1:, 0] = UNKNOWN_MISMATCH.get(pair, 0)
    for n in range(1, 8):
        base = MISMATCH_BASE["unpaired"] if n == OTHER_PAIR else MISMATCH_BASE.get(PAIRS[n - 1], MISMATCH_BASE["other"])
        interior_mm[n, 1:, 1:] = base
        for (a, b), bonus in MISMATCH_BONUS.items():
            interior_mm[n, LETTERS.index(a) + 1, LETTERS.index(b) + 1] += bonus
    weak = (np.arange(8) > 2).astype(np.int64)
    closing = weak[:, None] + weak[None, :]
    int11 = np.array([40, 110, 170])[closing][:, :, None, None] + np.zeros((8, 8, 5, 5), np.int64)
    g = LETTERS.index("G") + 1
    int11[:, :, g, g] -= np.array([180, 210, 210])[closing]
    int21 = np.array([230, 300, 370])[closing][:, :, None, None, None] + np.zeros((8, 8, 5, 5, 5), np.int64)
    int22 = 170 + interior_mm[:, None, :, None, None, :] + interior_mm.transpose(0, 2, 1)[None, :, None, :, :, None]  # (outer, inner, i+1, k-1, l+1, j-1)
    tetra = TETRALOOPS.split()
    bonus = {loop: int(e) for loop, e in zip(tetra[::2], tetra[1::2], strict=True)}
    return LoopModel(stack, _loops(HAIRPIN, 3), _loops(BULGE, 1), _loops(INTERNAL, 2), hairpin_mm, interior_mm, d5, d3, int11, int21, int22, bonus, {})


KINDS = np.zeros((5, 5), np.int64)
for _n, (_a, _b) in enumerate(PAIRS, 1):
    KINDS[LETTERS.index(_a) + 1, LETTERS.index(_b) + 1] = _n
#: The kind of a pair read from its other end.
TURNED = np.array([0, 2, 1, 4, 3, 6, 5, 7])
_CODES = np.zeros(256, np.int8)
for _n, _a in enumerate(LETTERS, 1):
    _CODES[[ord(_a), ord(_a.lower())]] = _n
_CODES[[ord("T"), ord("t")]] = 4


def codes(seq: str) -> np.ndarray:
    """Residues of a sequence, T as U."""
    return _CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


class Loops:
    """Energies of single loops of one sequence; places from 0."""

    def __init__(self, model: LoopModel, seq: str):
        self.m, self.s, self.seq, self.n = model, codes(seq).astype(int).tolist(), seq.upper().replace("T", "U"), len(seq)

    def kind(self, i: int, j: int) -> int:
        return int(KINDS[self.s[i], self.s[j]]) or OTHER_PAIR

    def au(self, kind: int) -> int:
        return self.m.terminal_au if kind > 2 else 0

    def hairpin(self, i: int, j: int) -> int:
        m, s, kind, u = self.m, self.s, self.kind(i, j), j - i - 1
        e = m.length(m.hairpin, u)
        if u == 3:
            return e + self.au(kind) + m.triloops.get(self.seq[i : j + 1], 0)
        if u == 4:
            e += m.tetraloops.get(self.seq[i : j + 1], 0)
        return e + int(m.mismatch_hairpin[kind, s[i + 1], s[j - 1]]) if u else e

    def interior(self, i: int, j: int, k: int, l: int) -> int:  # noqa: E741
        """The loop closed by the pair (i, j) and the pair (k, l) inside it."""
        m, s, one, two = self.m, self.s, self.kind(i, j), int(TURNED[self.kind(k, l)])
        u1, u2 = k - i - 1, j - l - 1
        many, few = max(u1, u2), min(u1, u2)
        if not many:
            return int(m.stack[one, two])
        if not few:
            return m.length(m.bulge, many) + (int(m.stack[one, two]) if many == 1 else self.au(one) + self.au(two))
        if (u1, u2) == (1, 1):
            return int(m.int11[one, two, s[i + 1], s[j - 1]])
        if (u1, u2) == (1, 2):
            return int(m.int21[one, two, s[i + 1], s[l + 1], s[j - 1]])
        if (u1, u2) == (2, 1):
            return int(m.int21[two, one, s[l + 1], s[i + 1], s[k - 1]])
        if (u1, u2) == (2, 2):
            return int(m.int22[one, two, s[i + 1], s[k - 1], s[l + 1], s[j - 1]])
        ends = int(m.mismatch_interior[one, s[i + 1], s[j - 1]]) + int(m.mismatch_interior[two, s[l + 1], s[k - 1]])
        return m.length(m.internal, u1 + u2) + min(m.most_ninio, (many - few) * m.ninio) + ends

    def stem(self, i: int, j: int) -> int:
        """What a helix that ends in (i, j) pays towards the loop around it: dangling neighbours on both sides, paired or
        not, and the penalty of AU and GU ends."""
        kind = self.kind(i, j)
        five = int(self.m.dangle5[kind, self.s[i - 1]]) if i else 0
        three = int(self.m.dangle3[kind, self.s[j + 1]]) if j + 1 < self.n else 0
        return five + three + self.au(kind)

    def closing(self, i: int, j: int) -> int:
        """What closing a multiloop costs the pair (i, j), seen from inside."""
        kind = int(TURNED[self.kind(i, j)])
        return self.m.ml_closing + self.m.ml_intern + self.au(kind) + int(self.m.dangle3[kind, self.s[i + 1]]) + int(self.m.dangle5[kind, self.s[j - 1]])

    def structure(self, partner: list[int]) -> int:
        """The energy of a whole structure, given each place's partner or -1: the sum over its loops."""
        total, i, todo = 0, 0, []
        while i < self.n:
            if partner[i] > i:
                total += self.stem(i, partner[i])
                todo.append((i, partner[i]))
                i = partner[i]
            i += 1
        while todo:
            i, j = todo.pop()
            inside, k = [], i + 1
            while k < j:
                if partner[k] > k:
                    inside.append((k, partner[k]))
                    k = partner[k]
                k += 1
            if not inside:
                total += self.hairpin(i, j)
            elif len(inside) == 1:
                total += self.interior(i, j, *inside[0])
            else:
                free = j - i - 1 - sum(y - x + 1 for x, y in inside)
                total += self.closing(i, j) + free * self.m.ml_base + sum(self.stem(x, y) + self.m.ml_intern for x, y in inside)
            todo += inside
        return total
