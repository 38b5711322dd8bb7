"""Random sequences that keep how often residues follow each other."""

from __future__ import annotations

import numpy as np


def walked(seq: str, rng: np.random.Generator) -> str:
    """A sequence with the pairs of neighbours of seq, drawn evenly from all such sequences: the same ends and residues.

    A walk over the graph of residues uses each neighbour pair once. Each residue's last step is drawn until these steps
    lead from every residue to the last one; the other steps go in any order.
    """
    if len(seq) < 3:
        return seq
    letters, code = np.unique(np.frombuffer(seq.encode("utf-32-le"), np.uint32), return_inverse=True)
    steps = [code[1:][code[:-1] == x] for x in range(len(letters))]
    end = int(code[-1])
    others = [x for x in range(len(letters)) if x != end and len(steps[x])]
    while True:
        last = {x: int(rng.integers(len(steps[x]))) for x in others}
        goes_to = {x: int(steps[x][n]) for x, n in last.items()}
        good = True
        for x in others:
            seen = 0
            while x != end and seen <= len(others):
                x, seen = goes_to[x], seen + 1
            good &= x == end
        if good:
            break
    queues = []
    for x, own in enumerate(steps):
        if x in last:
            own = np.append(rng.permutation(np.delete(own, last[x])), own[last[x]])
        else:
            own = rng.permutation(own)
        queues.append(iter(own.tolist()))
    at, out = int(code[0]), [int(code[0])]
    for _ in range(len(code) - 1):
        at = next(queues[at])
        out.append(at)
    return letters[out].astype("<u4").tobytes().decode("utf-32-le")


def markov(seq: str, rng: np.random.Generator) -> str:
    """A sequence of the same length whose residues follow each other as often on average: the first drawn by frequency, each
    other by what follows its neighbour in seq, and by frequency where nothing does."""
    if not seq:
        return seq
    letters, code = np.unique(np.frombuffer(seq.encode("utf-32-le"), np.uint32), return_inverse=True)
    steps = [code[1:][code[:-1] == x] for x in range(len(letters))]
    out = [int(rng.choice(code))]
    for draw in rng.random(len(code) - 1).tolist():
        own = steps[out[-1]] if len(steps[out[-1]]) else code
        out.append(int(own[int(draw * len(own))]))
    return letters[out].astype("<u4").tobytes().decode("utf-32-le")
