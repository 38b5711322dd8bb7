"""Best structures, partition functions and pair probabilities of many short sequences at a time.

Intervals are filled by their length: entry [d][b, i] is about places i to i + d of sequence b, so a step is one array
operation over all sequences and all intervals of a length. The recursion is written once, over two pairs of operations:
(minimum, +) on energies gives best energies, (+, x) on Boltzmann factors gives partition functions. Probabilities are the
derivatives of the logarithm of the partition function, by the same steps backwards.
"""

from __future__ import annotations

import numpy as np

from ribolens.kernels.loops import KINDS, KT, LONGEST, NEVER, TURN, TURNED, LoopModel, Loops, codes


class _Energies:
    """Minimum and sum."""

    zero, one = float("inf"), 0.0
    join, meet = staticmethod(np.minimum), staticmethod(np.add)

    @staticmethod
    def of(energy: np.ndarray) -> np.ndarray:
        return np.asarray(energy, float)

    @staticmethod
    def total(x: np.ndarray, axis: int) -> np.ndarray:
        return x.min(axis=axis, initial=float("inf"))


class _Factors:
    """Sum and product."""

    zero, one = 0.0, 1.0
    join, meet = staticmethod(np.add), staticmethod(np.multiply)

    @staticmethod
    def of(energy: np.ndarray) -> np.ndarray:
        return np.exp(-np.asarray(energy, float) / (100 * KT))

    @staticmethod
    def total(x: np.ndarray, axis: int) -> np.ndarray:
        return x.sum(axis=axis)


class Tables:
    """The filled intervals of sequences of one length, shorter ones padded with unknown residues (which never pair and
    have no dangling energy). paired: places i and j pair; many: one helix at least inside a multiloop; last: exactly one,
    which begins at i."""

    def __init__(self, s: np.ndarray, model: LoopModel, kind: type):
        self.s, self.m, self.k = s.astype(np.int64), model, kind
        self.b, self.n = s.shape
        self.kinds = [KINDS[self.s[:, : self.n - d], self.s[:, d:]] * (d > TURN) for d in range(self.n)]
        self.around = np.pad(self.s, ((0, 0), (1, 1)))  # residue i stands at i + 1
        self._hairpins()
        self._ends()
        self._fill()

    def _masked(self, value: np.ndarray, d: int) -> np.ndarray:
        return np.where(self.kinds[d] > 0, value, self.k.zero)

    def _hairpins(self) -> None:
        m, s = self.m, self.s
        bonus = {4: m.tetraloops, 3: m.triloops}
        place = 5 ** np.arange(6)[::-1]
        self.hairpin = []
        for d in range(self.n):
            t, u = self.kinds[d], d - 1
            e = np.full(t.shape, NEVER, np.int64)
            if d > TURN:
                e[:] = m.length(m.hairpin, u)
                e += np.where(t > 2, m.terminal_au, 0) if u == 3 else m.mismatch_hairpin[t, s[:, 1 : self.n - d + 1], s[:, d - 1 : -1]]
                if bonus.get(u):
                    extra = np.zeros(5 ** (u + 2), np.int64)
                    for loop, x in bonus[u].items():
                        extra[int((codes(loop).astype(np.int64) * place[-u - 2 :]).sum())] = x
                    e += extra[sum(s[:, x : self.n - d + x] * place[-u - 2 :][x] for x in range(u + 2))]
            self.hairpin.append(self._masked(self.k.of(e), d))

    def _ends(self) -> None:
        """Factors of each pair towards loops that know only one of their pairs."""
        m, f = self.m, self.k.of
        self.stem, self.inner, self.outer, self.bulged, self.close = [], [], [], [], []
        for d in range(self.n):
            t, turned = self.kinds[d], TURNED[self.kinds[d]]
            before, after = self.around[:, : self.n - d], self.around[:, d + 2 :]
            first, last = self.around[:, 2 : self.n - d + 2], self.around[:, d : self.n]  # i + 1 and j - 1
            au = np.where(t > 2, m.terminal_au, 0)
            self.stem.append(f(m.dangle5[t, before] + m.dangle3[t, after] + au))
            self.inner.append(f(m.mismatch_interior[turned, after, before]))
            self.outer.append(f(m.mismatch_interior[t, first, last]))
            self.bulged.append(f(au))
            self.close.append(f(m.ml_closing + m.ml_intern + au + m.dangle3[turned, first] + m.dangle5[turned, last]))
        self.intern, self.free = f(m.ml_intern), f(m.ml_base)

    def _special(self, d: int, u1: int, u2: int) -> np.ndarray | None:
        """Factors of loops that depend on both pairs, for the intervals of length d; None for others."""
        if u1 + u2 > 1 and (max(u1, u2) > 2 or not min(u1, u2)):
            return None
        m, w = self.m, self.n - d
        one, two = self.kinds[d], TURNED[self.kinds[d - 2 - u1 - u2][:, 1 + u1 : 1 + u1 + w]]
        at = lambda x: self.s[:, x : x + w]
        si, sj, sk, sl = at(1), at(d - 1), at(u1), at(d - u2)  # i + 1, j - 1, k - 1, l + 1
        if u1 + u2 < 2:
            e = m.stack[one, two] + (m.length(m.bulge, 1) if u1 + u2 else 0)
        elif (u1, u2) == (1, 1):
            e = m.int11[one, two, si, sj]
        elif (u1, u2) == (1, 2):
            e = m.int21[one, two, si, sl, sj]
        elif (u1, u2) == (2, 1):
            e = m.int21[two, one, sl, si, sk]
        else:
            e = m.int22[one, two, si, sk, sl, sj]
        return self.k.of(e)

    def _loops(self, d: int):
        """(u1, u2, factor, generic) of all interior loops of an interval of length d; factor by place if it is special."""
        m = self.m
        for u in range(min(LONGEST, d - 2 - TURN - 1) + 1):
            for u1 in range(u + 1):
                u2 = u - u1
                special = self._special(d, u1, u2)
                if special is not None:
                    yield u1, u2, special, None
                elif not u1 or not u2:
                    yield u1, u2, self.k.of(m.length(m.bulge, u)), False
                else:
                    yield u1, u2, self.k.of(m.length(m.internal, u) + min(m.most_ninio, abs(u1 - u2) * m.ninio)), True

    def _bands(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each number u of unpaired residues the factors of all loops that don't depend on both pairs, generic ones and bulges:
        entry [i + 1 + u1, i] is the factor of u1 residues on the left side. Factors only: a sum over loops is then a product
        of matrices."""
        m, n, out = self.m, self.n, []
        at = np.arange(n)
        for u in range(min(LONGEST, max(n - TURN - 3, 0)) + 1):
            generic, bulges = np.zeros((n + u + 2, n)), np.zeros((n + u + 2, n))
            for u1 in range(u + 1):
                u2 = u - u1
                if u > 1 and not min(u1, u2):
                    bulges[at + 1 + u1, at] = self.k.of(m.length(m.bulge, u))
                elif max(u1, u2) > 2:
                    generic[at + 1 + u1, at] = self.k.of(m.length(m.internal, u) + min(m.most_ninio, abs(u1 - u2) * m.ninio))
            out.append((generic, bulges))
        return out

    def _special_loops(self, d: int):
        """(u1, u2, factor) of the loops of an interval of length d that depend on both pairs, kept for the way back."""
        if d not in self.specials:
            kinds = ((0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2))
            self.specials[d] = [(u1, u2, self._special(d, u1, u2)) for u1, u2 in kinds if u1 + u2 <= d - 2 - TURN - 1]
        return self.specials[d]

    def _fill(self) -> None:
        k, n = self.k, self.n
        sums = k is _Factors
        if sums:
            self.bands, self.specials = self._bands(), {}
        join, meet = k.join, k.meet
        self.paired, self.many, self.last, self.to_inner, self.to_bulge = [], [], [], [], []
        run = [np.asarray(k.one)]
        for _ in range(n):
            run.append(meet(run[-1], self.free))
        self.run = run
        for d in range(n):
            w = n - d
            best = self.hairpin[d]
            if d > TURN and (self.kinds[d] > 0).any():
                generic, bulges = np.full((self.b, w), k.zero), np.full((self.b, w), k.zero)
                if sums:
                    for u1, u2, factor in self._special_loops(d):
                        best = best + factor * self.paired[d - 2 - u1 - u2][:, 1 + u1 : 1 + u1 + w]
                    for u in range(2, min(LONGEST, d - 2 - TURN - 1) + 1):
                        inside, (one, other) = d - 2 - u, self.bands[u]
                        if u > 2:
                            generic += self.to_inner[inside] @ one[: w + u + 2, :w]
                        bulges += self.to_bulge[inside] @ other[: w + u + 2, :w]
                for u1, u2, factor, whole in () if sums else self._loops(d):
                    at, inside = slice(1 + u1, 1 + u1 + w), d - 2 - u1 - u2
                    if whole is None:
                        best = join(best, meet(factor, self.paired[inside][:, at]))
                    elif whole:
                        generic = join(generic, meet(factor, self.to_inner[inside][:, at]))
                    else:
                        bulges = join(bulges, meet(factor, self.to_bulge[inside][:, at]))
                best = join(best, join(meet(self.outer[d], generic), meet(self.bulged[d], bulges)))
                split = np.full((self.b, w), k.zero)
                for t in range(TURN + 2, d - 2 - TURN):
                    split = join(split, meet(self.many[t - 1][:, 1 : 1 + w], self.last[d - 2 - t][:, 1 + t : 1 + t + w]))
                best = self._masked(join(best, meet(self.close[d], split)), d)
            self.paired.append(best)
            self.to_inner.append(meet(best, self.inner[d]))
            self.to_bulge.append(meet(best, self.bulged[d]))
            own = meet(meet(best, self.stem[d]), self.intern)
            self.last.append(own if not d else join(own, meet(self.last[d - 1][:, :w], self.free)))
            many = self.last[d]
            for t in range(1, d - TURN):
                many = join(many, meet(join(run[t], self.many[t - 1][:, :w]), self.last[d - t][:, t : t + w]))
            self.many.append(many)
        self.outside = np.full((self.b, n, n), k.zero)  # pairs as helices of the outermost loop
        for d in range(TURN + 1, n):
            at = np.arange(n - d)
            self.outside[:, at, at + d] = meet(self.paired[d], self.stem[d])
        self.upto = np.full((self.b, n + 1), k.one)
        for j in range(n):
            self.upto[:, j + 1] = join(self.upto[:, j], k.total(meet(self.upto[:, : j + 1], self.outside[:, : j + 1, j]), 1))

    def probabilities(self) -> np.ndarray:
        """[b, i, j]: how probable it is that i and j pair. Factors only."""
        n, w_all = self.n, [self.n - d for d in range(self.n)]
        after = np.ones((self.b, n + 1))
        for i in range(n - 1, -1, -1):
            after[:, i] = after[:, i + 1] + (self.outside[:, i, i:] * after[:, i + 1 :]).sum(axis=1)
        whole = self.upto[:, n]
        blank = lambda: [np.zeros((self.b, w)) for w in w_all]
        pair, last, many, inner, bulge = (blank() for _ in range(5))
        result = np.zeros((self.b, n, n))
        for d in range(n - 1, TURN, -1):
            w, at = w_all[d], np.arange(w_all[d])
            for t in range(1, d - TURN):  # many
                last[d - t][:, t : t + w] += many[d] * (self.run[t] + self.many[t - 1][:, :w])
                many[t - 1][:, :w] += many[d] * self.last[d - t][:, t : t + w]
            last[d] += many[d]
            last[d - 1][:, :w] += last[d] * self.free
            out = pair[d]
            out += last[d] * self.stem[d] * self.intern + inner[d] * self.inner[d] + bulge[d] * self.bulged[d]
            out += self.upto[:, at] * self.stem[d] * after[:, at + d + 1]
            out[self.kinds[d] == 0] = 0
            result[:, at, at + d] = out * self.paired[d] / whole[:, None]
            if not out.any():
                continue
            for u1, u2, factor in self._special_loops(d):
                pair[d - 2 - u1 - u2][:, 1 + u1 : 1 + u1 + w] += out * factor
            outer, bulged = out * self.outer[d], out * self.bulged[d]
            for u in range(2, min(LONGEST, d - 2 - TURN - 1) + 1):
                inside, (one, other) = d - 2 - u, self.bands[u]
                if u > 2:
                    inner[inside] += outer @ one[: w + u + 2, :w].T
                bulge[inside] += bulged @ other[: w + u + 2, :w].T
            closed = out * self.close[d]
            for t in range(TURN + 2, d - 2 - TURN):
                many[t - 1][:, 1 : 1 + w] += closed * self.last[d - 2 - t][:, 1 + t : 1 + t + w]
                last[d - 2 - t][:, 1 + t : 1 + t + w] += closed * self.many[t - 1][:, 1 : 1 + w]
        return result


def stacked(seqs: list[str]) -> np.ndarray:
    """Residues of sequences, one a row, padded to the longest."""
    out = np.zeros((len(seqs), max(map(len, seqs), default=0)), np.int8)
    for row, seq in zip(out, seqs, strict=True):
        row[: len(seq)] = codes(seq)
    return out


def partition(seqs: list[str], model: LoopModel) -> tuple[np.ndarray, np.ndarray]:
    """Each sequence's ensemble energy (kcal/mol) and [b, i, j] pair probabilities. A sequence whose partition function
    leaves the range of doubles (over a thousand residues, about) is an error."""
    if not seqs or not max(map(len, seqs)):
        return np.zeros(len(seqs)), np.zeros((len(seqs), 0, 0))
    tables = Tables(stacked(seqs), model, _Factors)
    whole = tables.upto[:, -1]
    if not np.isfinite(whole).all():
        raise ValueError("a sequence is too long for its partition function")
    return -KT * np.log(whole), tables.probabilities()


def best(seqs: list[str], model: LoopModel) -> list[tuple[str, float]]:
    """Each sequence's structure of least energy, and that energy (kcal/mol)."""
    if not seqs or not max(map(len, seqs)):
        return [("." * len(s), 0.0) for s in seqs]
    tables = Tables(stacked(seqs), model, _Energies)
    return [_traced(tables, b, seq, Loops(model, seq)) for b, seq in enumerate(seqs)]


def _traced(tables: Tables, b: int, seq: str, loops: Loops) -> tuple[str, float]:
    """Follows the choices that gave the best energy; of equal ones the first."""
    out, m = ["."] * len(seq), tables.m
    paired = lambda i, j: float(tables.paired[j - i][b, i]) if j - i > TURN else float("inf")
    many = lambda i, j: float(tables.many[j - i][b, i]) if j >= i else float("inf")
    last = lambda i, j: float(tables.last[j - i][b, i]) if j >= i else float("inf")
    upto = tables.upto[b]
    todo = [("outer", 0, len(seq) - 1)]
    while todo:
        state, i, j = todo.pop()
        if state == "outer":
            while j >= 0 and upto[j + 1] == upto[j]:
                j -= 1
            if j >= 0:
                k = next(k for k in range(j) if upto[k] + tables.outside[b, k, j] == upto[j + 1])
                todo += [("outer", 0, k - 1), ("pair", k, j)]
        elif state == "many":  # one helix after free places, or after others
            x = many(i, j)
            k = next(k for k in range(i, j) if x in ((k - i) * m.ml_base + last(k, j), many(i, k - 1) + last(k, j)))
            todo.append(("last", k, j))
            if x != (k - i) * m.ml_base + last(k, j):
                todo.append(("many", i, k - 1))
        elif state == "last":
            while last(i, j) != paired(i, j) + (loops.stem(i, j) if paired(i, j) < float("inf") else 0) + m.ml_intern:
                j -= 1
            todo.append(("pair", i, j))
        else:
            out[i], out[j] = "(", ")"
            x = paired(i, j)
            if x == loops.hairpin(i, j):
                continue
            inside = ((i + 1 + u1, j - 1 - u + u1) for u in range(min(LONGEST, j - i - TURN - 3) + 1) for u1 in range(u + 1))
            found = next(((k, l) for k, l in inside if paired(k, l) < float("inf") and x == paired(k, l) + loops.interior(i, j, k, l)), None)
            if found:
                todo.append(("pair", *found))
                continue
            rest = x - loops.closing(i, j)
            k = next(k for k in range(i + 2, j) if many(i + 1, k - 1) + last(k, j - 1) == rest)
            todo += [("many", i + 1, k - 1), ("last", k, j - 1)]
    return "".join(out), float(upto[len(seq)]) / 100
