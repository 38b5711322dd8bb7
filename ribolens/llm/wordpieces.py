"""Token ids of whole texts with a word-level BPE tokenizer file: every distinct word goes to the library's model once."""

from __future__ import annotations

import json
from functools import cache

import numpy as np

from ribolens.llm.bytetext import spans_hash

#: Distinct words kept per Python worker; beyond it the memory starts anew.
MEMORY_WORDS = 1_500_000
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onward."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


def char_classes() -> np.ndarray:
    """Per code point: space, letter, number or other."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            low, high = ord(m[0][0]), ord(m[0][-1])
            if high - low + 1 == len(m[0]):
                table[low : high + 1] = kind
            else:
                table[[ord(c) for c in m[0]]] = kind
    return table


class WordEncoder:
    """Encodes texts as Tokenizer.encode(text, add_special_tokens=False) does, for tokenizers of this form: NFC, white
    space to blanks, lower case; words by contraction, letters, single numbers, others; byte-level BPE with word ends."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        form = json.load(open(path, encoding="utf-8"))
        kinds = [x["type"] for x in form["normalizer"]["normalizers"]], [x["type"] for x in form["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"not a word-level tokenizer of the expected form: {kinds}")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.classes = self.tokenizer.model, byte_letters(), char_classes()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.simple = regex.compile(r"[\x00-\x7fÀ-į]*")
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at, self.size, self.flat = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.uint32))

    def _plain(self, text: str) -> str:
        return text.lower() if self.simple.fullmatch(text) else self.tokenizer.normalizer.normalize_str(text)

    def _starts(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words in code points that end with two blanks."""
        kind = self.classes[points]
        new = np.ones(len(points), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        quote = np.flatnonzero((points == 39) & new)
        if len(quote):
            quote = quote[kind[quote + 1] == _LETTER]
            first, second = points[quote + 1], points[quote + 2]
            one = np.isin(first, [ord(c) for c in "stmd"])
            two = ((first == ord("r")) & (second == ord("e"))) | ((first == ord("v")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
            quote, after = quote[one | two], (quote + np.where(one, 2, 3))[one | two]
            new[quote + 1] = False
            new[after] = True
        at = np.flatnonzero(new)
        ends = np.append(at[1:], len(points))
        word = kind[at] != _SPACE
        return at[word], ends[word]

    def _learn(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > MEMORY_WORDS:
            self._forget()
        got = []
        for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
            word = points[low:high].astype("<u4").tobytes().decode("utf-32-le")
            got.append([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))])
        size = np.array([len(x) for x in got], np.int64)
        at = np.cumsum(size) - size + len(self.flat)
        self.flat = np.concatenate([self.flat, np.array([i for x in got for i in x], np.uint32)])
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes, self.at, self.size = every[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        special = {n: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") for n, t in enumerate(texts) if self.special.search(t)}
        plain = ["" if n in special else self._plain(t) for n, t in enumerate(texts)]
        points = np.frombuffer(("\n".join(plain) + "  ").encode("utf-32-le"), np.uint32)
        borders = np.cumsum([len(t) + 1 for t in plain])
        starts, ends = self._starts(points)
        hashes = spans_hash(points, starts, ends)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(unique) > MEMORY_WORDS:
            self._forget()
        at = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == unique
        if not known.all():
            new = first[~known]
            self._learn(points, starts[new], ends[new], unique[~known])
            at = np.searchsorted(self.hashes, unique)
        if not len(starts):
            return [special.get(n, np.zeros(0, "<u4")) for n in range(len(texts))]
        which = at[back]
        size = self.size[which]
        upto = np.cumsum(size)
        ids = self.flat[np.repeat(self.at[which] - (upto - size), size) + np.arange(upto[-1])].astype("<u4")
        cut = np.concatenate([[0], upto])[np.searchsorted(starts, borders, "left")]
        return [special[n] if n in special else x for n, x in enumerate(np.split(ids, cut[:-1]))]


@cache
def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    return WordEncoder(path)
