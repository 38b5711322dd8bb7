"""Byte-level BPE in two tiers: whole pre-tokens by a minimal perfect hash, the rest by a heap of merges over linked bytes."""

from __future__ import annotations

import base64
from array import array
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np

from ribolens.llm.bytetext import CHUNK, mix, spans_hash

# Fixed value: the pattern of the rank files; starts() cuts by it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Different pre-tokens outside the vocabulary, and their ids, that a worker remembers; beyond, the memory starts anew.
MEMORY_PIECES, MEMORY_IDS, MEMORY_BYTES = 400_000, 4_000_000, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def ranks_of(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(n) for token, n in map(bytes.split, lines)}


@cache
def library_classes() -> tuple[bytes, bytes]:
    """Where runs of code points of one class begin (little-endian 32-bit), and their classes.

    The library has its own Unicode tables, so it is asked: with a rank for a prefix joined to each first byte, prefix and
    character merge only where the pattern keeps them together.
    """
    import tiktoken

    own = {bytes([b]): b for b in range(256)}
    kinds = np.full(0x110000, SPACE, np.uint8)
    left = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 10])
    for kind, prefix in ((OTHER, "!"), (LETTER, "a"), (NUMBER, "1")):
        joined = {prefix.encode() + bytes([b]): 256 + b for b in range(256) if b != 10}
        library = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=own | joined, special_tokens={})
        ids = np.array(library.encode_ordinary("".join([f"{prefix}{chr(c)}\n" for c in left.tolist()])), np.int64)
        found = np.zeros(len(left), bool)
        found[np.cumsum(ids == 10)[ids >= 256]] = True
        kinds[left[found]] = kind
        left = left[~found]
    begin = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1])
    return begin.astype("<u4").tobytes(), kinds[begin].tobytes()


def starts(points: np.ndarray, kinds: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the code points of joined texts; borders are the texts' first places (and the end).

    A run of one class begins a pre-token. Of white space before something else the last character stands apart; a blank
    goes with what follows. An apostrophe that begins a pre-token takes s, t, re, ve, m, ll or d from the letters after it.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    new, edge = np.ones(n, bool), np.zeros(n + 1, bool)
    edge[borders], edge[n] = True, True
    new[1:] = (kinds[1:] != kinds[:-1]) | edge[1:n]
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~edge[1:n])
    new[last] = True
    blank = last[points[last] == 32] + 1
    new[blank] = False
    quote = np.flatnonzero(new & (points == 39))
    quote = quote[quote + 1 < n]
    quote = quote[(kinds[quote + 1] == LETTER) & ~edge[quote + 1]]
    if len(quote):
        first, second = points[quote + 1], np.append(points, 0)[quote + 2] * ~edge[np.minimum(quote + 2, n)]
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = ((second == ord("e")) & ((first == ord("r")) | (first == ord("v")))) | ((first == ord("l")) & (second == ord("l")))
        after = quote + np.where(one, 2, 3)
        held = one | two
        new[quote[held] + 1] = False
        after = after[held]
        new[after[after < n]] = True
    return np.flatnonzero(new)


class PerfectHash:
    """Slots 0 to n - 1, one for each of n different 64-bit keys; any other key gets some slot.

    Keys are dealt to buckets. From the fullest bucket on, a bucket gets the first seed that sends its keys to free slots;
    a bucket of one key is given a free slot by name, as a negative seed.
    """

    def __init__(self, keys: np.ndarray, per_bucket: int = 3):
        n = len(keys)
        if len(np.unique(keys)) < n:
            raise ValueError("keys repeat")
        self.n, self.buckets = np.uint64(max(1, n)), np.uint64(max(1, n // per_bucket))
        bucket = (keys % self.buckets).astype(np.int64)
        count = np.bincount(bucket, minlength=int(self.buckets))
        self.seed = np.zeros(int(self.buckets), np.int64)
        free = np.ones(n, bool)
        order = np.argsort(bucket, kind="stable")
        at = np.cumsum(count) - count
        alone = []
        for b in np.argsort(-count, kind="stable").tolist():
            held = keys[order[at[b] : at[b] + count[b]]]
            if len(held) < 2:
                alone += [b] * len(held)
                continue
            low, many = 0, 16
            while True:
                seeds = np.arange(low, low + many, dtype=np.uint64)
                slots = self._slots(held[None, :], seeds[:, None])
                good = free[slots].all(axis=1)
                good[good] = [len(set(s)) == len(s) for s in slots[good].tolist()]
                if good.any():
                    k = int(np.argmax(good))
                    self.seed[b] = low + k
                    free[slots[k]] = False
                    break
                low, many = low + many, min(4096, many * 2)
        self.seed[alone] = -1 - np.flatnonzero(free)

    def _slots(self, keys: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (mix(keys ^ (seeds + np.uint64(1)) * _STEP) % self.n).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        seed = self.seed[(keys % self.buckets).astype(np.int64)]
        return np.where(seed < 0, -1 - seed, self._slots(keys, np.maximum(seed, 0).astype(np.uint64)))


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number, zeros beyond the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", padded.tobytes(), strides=(1,))


class Codec:
    """Ids of texts and texts of ids under one rank file."""

    def __init__(self, path: str, classes: tuple[bytes, bytes]):
        self.ranks = ranks_of(path)
        begin, kinds = np.frombuffer(classes[0], "<u4").astype(np.int64), np.frombuffer(classes[1], np.uint8)
        self.kinds = np.repeat(kinds, np.diff(np.append(begin, 0x110000)))
        tokens = sorted(self.ranks, key=self.ranks.get)
        size = np.array([len(t) for t in tokens], np.int64)
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        at = np.cumsum(size) - size
        keys = spans_hash(flat, at, at + size)
        self.perfect = PerfectHash(keys)
        order = np.argsort(self.perfect.slots(keys))  # tokens by slot
        self.slot_at, self.slot_size, self.slot_id = at[order], size[order], np.array([self.ranks[t] for t in tokens], np.int64)[order]
        self.flat, self.flat_words, self.longest = flat, words_at(flat), int(size.max(initial=0))
        ids = np.array([self.ranks[t] for t in tokens], np.int64)
        self.id_at, self.id_size = np.zeros(ids.max(initial=-1) + 1, np.int64), np.full(ids.max(initial=-1) + 1, -1, np.int64)
        self.id_at[ids], self.id_size[ids] = at, size
        self._forget()

    def _forget(self) -> None:
        self.memo, self.memo_at, self.memo_size, self.memo_ids = {}, array("q"), array("q"), array("i")

    def whole(self, buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First tier: the id of each span that is a token, else -1. The hash names the one token that a span can be; all of
        their bytes are compared, eight at a time."""
        size = end - begin
        slot = self.perfect.slots(spans_hash(buf, begin, end))
        same = self.slot_size[slot] == size
        words = words_at(buf)
        for done in range(0, self.longest, 8):
            some = np.flatnonzero(same & (size > done))
            if not len(some):
                break
            differ = words[begin[some] + done] ^ self.flat_words[self.slot_at[slot[some]] + done]
            unread = (8 * np.maximum(0, 8 - (size[some] - done))).astype(np.uint64)
            same[some] = differ << unread == 0
        return np.where(same, self.slot_id[slot], -1)

    def merged(self, piece: bytes) -> list[int]:
        """Second tier: ids of one pre-token. Of all neighbours that together are a token the lowest rank is joined, the
        first of equal ones; a heap holds them as (rank, first byte, last), and entries that no longer hold are skipped."""
        ranks, n = self.ranks, len(piece)
        end, before, live = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            middle = end[i]
            if not live[i] or middle == n or end[middle] != stop:
                continue
            end[i], live[middle], before[stop] = stop, 0, i
            if stop < n and (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
            left = before[i]
            if left >= 0 and (r := ranks.get(piece[left:stop])) is not None:
                heappush(heap, (r, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _pieces(self, data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers in the memory of pre-tokens that aren't tokens; unknown ones are merged. Long ones are never found again."""
        if len(self.memo) > MEMORY_PIECES or len(self.memo_ids) > MEMORY_IDS:
            self._forget()
        got = []
        for x, y in zip(begin.tolist(), end.tolist(), strict=True):
            piece = data[x:y]
            number = self.memo.get(piece)
            if number is None:
                number, ids = len(self.memo_at), self.merged(piece)
                self.memo_at.append(len(self.memo_ids))
                self.memo_size.append(len(ids))
                self.memo_ids.extend(ids)
                if len(piece) <= MEMORY_BYTES:
                    self.memo[piece] = number
            got.append(number)
        return np.array(got, np.int64)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, the bytes between neighbouring offsets of buf: all ids in a row, and the offsets of each text's."""
        data = buf.tobytes()
        text = data.decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.concatenate([[0], np.cumsum(width)])
        begin = place[starts(points, self.kinds[points], np.searchsorted(place, offsets))]
        end = np.append(begin[1:], len(buf))[: len(begin)]
        if not len(begin):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        ids = self.whole(buf, begin, end)
        missed = np.flatnonzero(ids < 0)
        size = np.ones(len(begin), np.int64)
        number = self._pieces(data, begin[missed], end[missed])
        at, sizes, flat = (np.frombuffer(x, t) if len(x) else np.zeros(0, t) for x, t in ((self.memo_at, np.int64), (self.memo_size, np.int64), (self.memo_ids, np.int32)))
        size[missed] = sizes[number]
        upto = np.cumsum(size)
        out = np.empty(upto[-1], np.int32)
        found = ids >= 0
        out[upto[found] - 1] = ids[found]
        many = size[missed]
        along = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(upto[missed] - many, many) + along] = flat[np.repeat(at[number], many) + along]
        return out, np.concatenate([[0], upto])[np.searchsorted(begin, offsets)]

    def encode_long(self, buf: np.ndarray, limit: int = CHUNK // 2) -> np.ndarray:
        """Ids of one text of any length. It is cut before blanks that follow a visible ASCII character: no pre-token holds
        such a place and none looks across it."""
        data, low, got = buf.tobytes(), 0, []
        while low < len(data):
            high = data.find(b" ", low + limit)
            while high > 0 and not 0x21 <= data[high - 1] <= 0x7E:
                high = data.find(b" ", high + 1)
            high = len(data) if high < 0 else high
            got.append(self.encode(buf[low:high], np.array([0, high - low]))[0])
            low = high
        return np.concatenate(got) if got else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray, limit: int = 1 << 17) -> np.ndarray:
        """The bytes of ids. An id that the rank file lacks is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.id_size) or (self.id_size[ids] < 0).any()):
            raise ValueError("an id outside the vocabulary")
        got = []
        for low in range(0, len(ids), limit):
            part = ids[low : low + limit]
            size = self.id_size[part]
            got.append(self.flat[np.repeat(self.id_at[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
        return np.concatenate(got) if got else np.zeros(0, np.uint8)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """The number of bytes of each id."""
        return self.id_size[ids]


@cache
def codec(path: str, classes: tuple[bytes, bytes]) -> Codec:
    """The worker's codec for a rank file."""
    return Codec(path, classes)
