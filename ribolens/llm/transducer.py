"""Token counts by a deterministic transducer compiled from a BPE piece vocabulary.

The state after a prefix of a unit (a run of characters that no piece leaves) holds, for every suffix of the prefix that
could still grow into a piece, the piece that ends before the suffix and how many pieces fewer there are up to it. That
decides the segmentation of each longer prefix: two neighbouring pieces u, v are right exactly if segmenting uv gives
u, v. A transition is annotated with the change of the piece count. Transitions are compiled when first met.

Long inputs are cut into chunks of equal length that run in lockstep. A chunk with a resetting character leaves in a state
that what comes before doesn't change. Of the others the maps from the states that can enter to those that leave are
found in rounds, all chunks at once, until every leaving state is among the next chunk's entering ones (most often two
rounds: after some characters the state no longer depends on where it began). A parallel prefix scan composes the maps.
"""

from __future__ import annotations

from functools import cache, lru_cache

import numpy as np

BLANK = "▁"
#: Characters of a chunk.
CHUNK_CHARS = 256
#: Cells of the transition table at which it starts anew: bounds a worker's memory.
MAX_CELLS = 24_000_000
#: Classes: no character; lone characters that take 1 to 4 tokens; a blank that starts a unit; then single characters.
NOTHING, FRESH, FIRST_CLASS = 0, 5, 6
_START = (("", None, 0),)


class PieceCounter:
    """Counts the pieces that a BPE vocabulary (piece -> score, higher merges first) with byte fallback gives a text."""

    def __init__(self, scores: dict[str, float], dummy_prefix: bool = True):
        if any(BLANK in p.lstrip(BLANK) for p in scores):
            raise ValueError("a piece holds a blank after another character: words aren't independent")
        self.scores, self.dummy_prefix = scores, dummy_prefix
        joined = {c for p in scores if len(p) > 1 for c in p} | {BLANK}
        size = np.arange(0x110000)
        self.base = (1 + (size > 0x7F) + (size > 0x7FF) + (size > 0xFFFF)).astype(np.int16)
        self.base[[ord(p) for p in scores if len(p) == 1]] = 1
        self.pending = np.zeros(0x110000, bool)
        self.pending[[ord(c) for c in joined]] = True
        self.longer: dict[str, list[str]] = {}
        for p in sorted(scores, key=len):
            for n in range(1, len(p)):
                self.longer.setdefault(p[:n], []).append(p)
        self.fits = lru_cache(1 << 16)(self._fits)
        self.edges = lru_cache(1 << 16)(self._edges)
        self.hopeful = lru_cache(1 << 18)(self._hopeful)
        self._forget()

    @classmethod
    def load(cls, path: str) -> PieceCounter:
        """From a sentencepiece BPE model file without text normalisation."""
        from sentencepiece import sentencepiece_model_pb2 as form

        model = form.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        how = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or {p.type for p in model.pieces} - {1, 2, 3, 6}:
            raise ValueError("only BPE models with identity normalisation and plain pieces are compiled")
        return cls({p.piece: p.score for p in model.pieces if p.type == 1}, how.add_dummy_prefix)

    def _forget(self) -> None:
        self.states, self.number = [_START], {_START: 0}
        self.classes, self.chars = self.base.copy(), [""] * FIRST_CLASS
        self.width = 32
        self.next = np.full((1 << 10) * self.width, -1, np.int32)
        self.emit = np.zeros(len(self.next), np.int8)
        self._fill(0)

    def _fill(self, state: int) -> None:
        """The transitions that are alike in every state; a fresh blank acts on the start state."""
        row = state * self.width
        self.next[row], self.emit[row] = state, 0
        self.next[row + 1 : row + FRESH], self.emit[row + 1 : row + FRESH] = 0, range(1, FRESH)
        blank, count = self.step(_START, BLANK)
        self.next[row + FRESH], self.emit[row + FRESH] = self._numbered(blank, state), count

    def _numbered(self, key: tuple, filling: int = -1) -> int:
        if key in self.number:
            return self.number[key]
        n = self.number[key] = len(self.states)
        self.states.append(key)
        if (n + 1) * self.width > len(self.next):
            more = (len(self.next) // self.width // 4 + 1) * self.width
            self.next = np.concatenate([self.next, np.full(more, -1, np.int32)])
            self.emit = np.concatenate([self.emit, np.zeros(more, np.int8)])
        self._fill(n)
        return n

    def merges(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """The pieces of a short text, by merging the best-scored pair (the leftmost of equals) until none is left; and the merges."""
        parts, done = list(text), []
        while True:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                return parts, done
            i = -best[1]
            done.append((parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """The pieces that stand at its right and left edge while it is merged, each with the score of the merge that
        takes it in; None for a piece that merging never makes."""
        parts, done = self.merges(piece)
        if parts != [piece]:
            return None
        made = {a + b: (a, b) for a, b in done}
        edges = []
        for side in (1, 0):
            chain, at, until = [], piece, float("-inf")
            while True:
                chain.append((at, until))
                if len(at) == 1:
                    break
                until, at = self.scores[at], made[at][side]
            edges.append(chain)
        return edges[0], edges[1]

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging left + right ends with the pieces left, right: no pair across the border merges while it lasts."""
        if BLANK * 2 in left or BLANK * 2 in right or left[-1] == right[0] == BLANK:
            return self.merges(left + right)[0] == [left, right]
        ours, theirs = self.edges(left), self.edges(right)
        if ours is None or theirs is None:
            return False
        for a, until_a in ours[0]:
            for b, until_b in theirs[1]:
                score = self.scores.get(a + b)
                if score is not None and score > until_a and score >= until_b:
                    return False
        return True

    def _hopeful(self, suffix: str, last: str) -> bool:
        """Whether some piece that begins with suffix, and is longer, can follow the piece last."""
        return any(self.fits(last, p) for p in self.longer.get(suffix, ()))

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """The state after one more character, and the change of the count."""
        found = None
        for suffix, last, count in state:
            piece = suffix + char
            if found is None and piece in self.scores and (self.edges(piece) if last is None else self.fits(last, piece)):
                found = piece, count + 1
        if found is None:
            return _START, len(char.encode())
        last, change = found
        grown = [(s + char, before, count - change) for s, before, count in state if s + char in self.longer and (before is None or self.hopeful(s + char, before))]
        return (*grown, ("", last, 0)), change

    def _widen(self) -> None:
        rows = len(self.next) // self.width
        for name in ("next", "emit"):
            old = getattr(self, name).reshape(rows, self.width)
            fresh = np.full((rows, self.width), -1 if name == "next" else 0, old.dtype)
            setattr(self, name, np.concatenate([old, fresh], axis=1).reshape(-1))
        self.width *= 2

    def _classes_of(self, points: np.ndarray) -> np.ndarray:
        if self.pending[points].any():
            for p in np.unique(points[self.pending[points]]).tolist():
                while len(self.chars) >= self.width:
                    self._widen()
                self.classes[p] = len(self.chars)
                self.chars.append(chr(p))
                self.pending[p] = False
        return self.classes[points]

    def _run(self, grid: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs all rows of a grid of classes at once; the changes at each place, and the last states."""
        changes = np.zeros(grid.shape, np.int16)
        steps = np.ascontiguousarray(grid.T).astype(np.int64)
        for t, column in enumerate(steps):
            cell = states * self.width + column
            new = self.next[cell]
            if (new < 0).any():
                for c in np.unique(cell[new < 0]).tolist():
                    key, change = self.step(self.states[c // self.width], self.chars[c % self.width])
                    to = self._numbered(key)
                    self.next[c], self.emit[c] = to, change
                new = self.next[cell]
            changes[:, t] = self.emit[cell]
            states = new.astype(np.int64)
        return changes, states

    def _through(self, grid: np.ndarray, through: np.ndarray, fixed: np.ndarray, leaving: np.ndarray) -> np.ndarray:
        """The leaving states of the chunks ``through``, that have no reset: by their maps, composed by a prefix scan."""
        at = {int(i): n for n, i in enumerate(through)}
        first = np.array([i == 0 or fixed[i - 1] for i in through])  # a known state enters
        entering = [[int(leaving[i - 1]) if f and i else 0] for i, f in zip(through.tolist(), first.tolist(), strict=True)]
        maps: list[dict[int, int]] = [{} for _ in through]
        pending = [(n, e[0]) for n, e in enumerate(entering)]
        while pending:
            rows, states = (np.array(x, np.int64) for x in zip(*pending, strict=True))
            _, out = self._run(grid[through[rows]], states)
            pending = []
            for n, state, left in zip(rows.tolist(), states.tolist(), out.tolist(), strict=True):
                maps[n][state] = left
                after = at.get(int(through[n]) + 1)
                if after is not None and left not in entering[after]:
                    entering[after].append(left)
                    pending.append((after, left))
        # place of each leaving state among the next chunk's entering ones; the first chunk of a run has one entering state,
        # so its row is constant and composing with what comes before it changes nothing
        composed = np.zeros((len(through), max(map(len, entering))), np.int64)
        for n, states in enumerate(entering):
            after = at.get(int(through[n]) + 1)
            if after is not None:
                place = {s: k for k, s in enumerate(entering[after])}
                to = [place[maps[n][s]] for s in states]
                composed[n] = to[0] if first[n] else [*to, *[0] * (composed.shape[1] - len(to))]
        step = 1
        while step < len(through):
            composed[step:] = np.take_along_axis(composed[step:], composed[:-step], axis=1)
            step *= 2
        came = [0 if f else int(composed[n - 1, 0]) for n, f in enumerate(first.tolist())]
        return np.array([maps[n][entering[n][c]] for n, c in enumerate(came)])

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of pieces of each text; an empty text has none."""
        if len(self.states) * self.width > MAX_CELLS:
            self.pending[[ord(c) for c in self.chars[FIRST_CLASS:]]] = True
            self._forget()
        lead = BLANK if self.dummy_prefix else ""
        whole = "".join([lead + t if t else "" for t in texts]).replace(" ", BLANK)
        if not whole:
            return np.zeros(len(texts), np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        borders = np.cumsum([len(t) + len(lead) if t else 0 for t in texts])
        kinds = self._classes_of(points)
        first = np.concatenate([[0], borders[:-1]])
        first = first[first < len(points)]
        blank = points == ord(BLANK)
        fresh = blank.copy()
        fresh[1:] &= ~blank[:-1]
        fresh[first] = blank[first]
        kinds[fresh] = FRESH
        resets = (kinds > NOTHING) & (kinds < FIRST_CLASS)
        if not self.dummy_prefix:
            raise ValueError("models without a dummy prefix aren't compiled")
        lanes = -(-len(points) // CHUNK_CHARS)
        grid = np.zeros(lanes * CHUNK_CHARS, np.int16)
        grid[: len(kinds)] = kinds
        grid = grid.reshape(lanes, CHUNK_CHARS)
        reset = np.zeros(lanes * CHUNK_CHARS, bool)
        reset[: len(kinds)] = resets
        reset = reset.reshape(lanes, CHUNK_CHARS)
        fixed = reset.any(axis=1)
        head = np.where(fixed, reset.argmax(axis=1), CHUNK_CHARS)
        place = np.arange(CHUNK_CHARS)
        tail = np.where(place >= head[:, None], grid, NOTHING)
        changes, leaving = self._run(tail, np.zeros(lanes, np.int64))
        through = np.flatnonzero(~fixed)
        if len(through):
            leaving[through] = self._through(grid, through, fixed, leaving)
        open_head = np.flatnonzero(head > 0)
        if len(open_head):
            width = int(head[open_head].max())
            part = np.where(place[:width] < head[open_head][:, None], grid[open_head, :width], NOTHING)
            entering = np.where(open_head > 0, leaving[open_head - 1], 0)
            changes[open_head, :width] += self._run(part, entering)[0]
        total = np.concatenate([[0], np.cumsum(changes.reshape(-1), dtype=np.int64)])
        upto = total[borders]
        return np.diff(upto, prepend=0)


@cache
def counter(path: str) -> PieceCounter:
    """The worker's compiled counter for a model file; it keeps its transitions from task to task."""
    return PieceCounter.load(path)
