"""Small helpers against plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ribolens.llm import bytetext, context_tree, near_dedup, packing, quality, transducer, wordpieces

public_tokenizers = pytest.importorskip("public_tokenizers")

HARD = ["", " ", "a", "Hello  world\n\n a  b <s> </s> <unk>", "▁a ▁", "ﬁ½ é \x00 x", " " * 40 + "a", "x" * 700, "日本語テキスト", "abc" * 300 + " " * 17 + "the  of", "it's 123 don't’s <|endoftext|> İx ſ ǅ", "I'VE'S ''s K", "'", "a'", "x 'r 're'", "é İ'll'd", "\t\t foo(){}\n    return;"]


def texts(n=150, seed=1):
    rng = random.Random(seed)
    return HARD + ["".join(rng.choice("abcdeé ▁\n.'0Z日") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_spans_and_hashes():
    rows = ["ab  cd", None, "", "cd", "é!x ab"]
    ((low, high, buf, offsets),) = bytetext.chunks(pa.array(rows))
    starts, ends, row = bytetext.spans(bytetext.WORD[buf], offsets)
    h = bytetext.spans_hash(buf, starts, ends)
    data = buf.tobytes()
    words = [data[s:e].decode() for s, e in zip(starts, ends, strict=True)]
    assert (low, high, words, row.tolist()) == (0, 5, ["ab", "cd", "cd", "é", "x", "ab"], [0, 0, 3, 4, 4, 4])
    assert h[0] == h[5] and h[1] == h[2] and len(set(h.tolist())) == 4
    assert list(bytetext.chunks(pa.array([], pa.string()))) == []
    assert [x[:2] for x in bytetext.chunks(pa.array(["aaaa", "bb", "c"]), 3)] == [(0, 1), (1, 3)]


def test_pieces_as_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), transducer.PieceCounter.load(path)
    many = texts()
    assert ours.count(many).tolist() == [len(x) for x in library.encode(many)]
    assert ours.count(many[::-1]).tolist() == [len(x) for x in library.encode(many[::-1])]


@pytest.mark.parametrize("chars", [256, 3])
def test_pieces_of_texts_without_resets(monkeypatch, chars):
    """Long runs without blanks: maps of chunks are composed."""
    import sentencepiece

    monkeypatch.setattr(transducer, "CHUNK_CHARS", chars)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, ours = sentencepiece.SentencePieceProcessor(model_file=path), transducer.PieceCounter.load(path)
    rng = random.Random(9)
    many = ["".join(rng.choice("abcdeinrst") for _ in range(5000)), "the" * 2000, "a" * 3001, "x", "", "in the " + "end" * 700 + " of it", "=" * 2000 + "ab" * 900, "é" * 700 + "ε" * 3]
    assert ours.count(many).tolist() == [len(x) for x in library.encode(many)]


def test_pieces_after_forgetting(monkeypatch):
    monkeypatch.setattr(transducer, "MAX_CELLS", 100)
    path = public_tokenizers.path("piece_bpe_32k.model")
    ours = transducer.PieceCounter.load(path)
    first = ours.count(HARD)
    assert (ours.count(HARD) == first).all()


def test_words_as_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), wordpieces.WordEncoder(path)
    many = texts(seed=2)
    expected = [x.ids for x in library.encode_batch(many, add_special_tokens=False)]
    assert [x.tolist() for x in ours.encode(many)] == expected
    assert [x.tolist() for x in ours.encode(many)] == expected


def least_bins(lengths, capacity):
    """By trying all ways."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                place(i + 1, [*bins[:b], bins[b] + lengths[i], *bins[b + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_bounds_and_best_fit():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([7, 10, 16])
        lengths = np.array([rng.randint(1, capacity) for _ in range(rng.randint(0, 8))], np.int64)
        bin_of, offset, bins = packing.best_fit(lengths, capacity)
        least = least_bins(lengths.tolist(), capacity)
        assert packing.lower_bound(lengths, capacity) <= least <= bins
        for b in range(bins):
            own = sorted((int(offset[i]), int(lengths[i])) for i in np.flatnonzero(bin_of == b))
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3


def test_keys_and_plain_bytes():
    texts = ["A b\tC", "", "  ", "\u00e9x  y\n", "end"]
    data = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])])
    flat, begin = context_tree.plain_bytes(buf, offsets)
    plain = ["a b c ", "", "", "\u00e9x y ", "end "]
    assert [flat[x:y].tobytes().decode() for x, y in zip(begin, begin[1:], strict=False)] == plain
    keys, number, at = context_tree.keyed(flat, begin, 3)
    expected = []
    for t in plain:
        own = b"\xff" * 3 + t.encode() + b"\xff"
        expected.append([own[i] | own[i - 1] << 8 | own[i - 2] << 16 | own[i - 3] << 24 for i in range(3, len(own))])
    assert [keys[number[x:y]].tolist() for x, y in zip(at, at[1:], strict=False)] == expected and len(set(keys.tolist())) == len(keys)


def test_log_gamma():
    from math import lgamma

    xs = [0.5, 1, 1.5, 3, 9.99, 10, 1e3, 1e8]
    assert context_tree.log_gamma(np.array(xs)) == pytest.approx([lgamma(x) for x in xs], rel=1e-10, abs=1e-10)


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    value = bytetext.mix(np.arange(1, 61, dtype=np.uint64))
    a, b = rng.integers(0, 4, 60), rng.integers(0, 4, 60)
    row = np.concatenate([np.zeros((a > 0).sum(), np.int64), np.ones((b > 0).sum(), np.int64)])
    sig = near_dedup.prob_minhash(row, np.concatenate([value[a > 0], value[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4000)
    both = (a > 0) & (b > 0)
    exact = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero(both))
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.03)


def test_shingles():
    rows = ["a b c d e f", "x y", "", "a b c d e a b c d e a b c d e"]
    ((_, _, buf, offsets),) = bytetext.chunks(pa.array(rows))
    row, value, count = near_dedup.shingles(buf, offsets)
    assert Counter(row.tolist()) == {0: 2, 1: 1, 3: 5} and sorted(count[row == 3].tolist()) == [2, 2, 2, 2, 3]
    each, element = near_dedup.elements(row, value, count)
    assert len(set(zip(each.tolist(), element.tolist(), strict=True))) == 2 + 1 + 11


def test_best_cut_and_order():
    assert quality.best_cut(np.array([1.0, 2, 3, 4]), np.array([False, False, True, True])) == 2.5
    assert quality.best_cut(np.array([1.0]), np.array([True])) == -np.inf
    xs = np.array([-5.0, -0.0, 0.0, 1e-300, 3.5])
    assert np.diff(quality.sortable(xs)).tolist() and (np.diff(quality.sortable(xs)) >= 0).all()


def test_squeezed():
    x = np.array([1, -2, 3 << 40], "<i8")
    assert context_tree.unsqueezed(context_tree.squeezed(x), "<i8").tolist() == x.tolist()
    assert context_tree.unsqueezed(context_tree.squeezed(x[:0]), "<i8").tolist() == []
    assert zlib.crc32(b"") == 0
