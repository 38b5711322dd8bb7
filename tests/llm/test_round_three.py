"""Merkle manifests, byte-level BPE and filter audits against definitions, libraries and brute force."""

import random
import re
from hashlib import sha256
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from ribolens.llm import bpe, bytepairs, filter_audit, merkle
from ribolens.llm.bytetext import chunks

public_tokenizers = pytest.importorskip("public_tokenizers")

ROWS = "doc_id long, text string, lang string, source string, n_chars long, mask int, part string, digest string, n int"


def random_docs(rng, n):
    words = ["alpha", "Beta", "GAMMA", "d", "e1", "ümlaut"]
    texts = [None, "", " \n", "A", *[" ".join(rng.choice(words) for _ in range(rng.choice([3, 150, 199, 200, 260]))) + rng.choice(["", " #", "\tX", "\x0b|"]) for _ in range(8)]]
    texts += [" ".join(f"w{i}" for i in range(210)), " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 99}" for i in range(200))]
    rows = [(k, rng.choice(texts), rng.choice(["en", "de", None, ""]), rng.choice(["s", None]), rng.choice([1, 2, None]), 0, "x", "y", 1) for k in rng.sample(range(10 * n), n)]
    return rows + [rows[0], rows[1], (None, texts[5], "en", None, None, 0, "x", "y", 1), (None, texts[5], "en", None, None, 0, "x", "y", 1), (rows[2][0], rows[3][1], *rows[2][2:])]


def audit_by_hand(rows, labels):
    """Every count from the sets of documents that each order leaves."""
    good, toxic = ({d for d, *v in labels if v[k] == 1} for k in (0, 1))
    smallest = {}
    for d, t, *_ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))

    def failed(d, t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and smallest[t] < d)
        return {x for x, y in zip("ABCDE", tests, strict=True) if y}

    out, shapley = [], {}
    for part in {r[2] or "" for r in rows}:
        own = [(d, failed(d, t)) for d, t, lang, *_ in rows if (lang or "") == part]
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, x in enumerate(order, 1):
                lost, kept = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                shapley[part, x] = shapley.get((part, x), 0) + len(lost)
                out.append((part, "".join(order), step, x, len(kept), len(lost), sum(x in r[1] for r in gone), sum(r[1] == {x} for r in own), sum(r[0] in good for r in lost), sum(r[0] in toxic for r in lost)))
                left, gone = kept, gone + lost
    return sorted((*r, shapley[r[0], r[3]]) for r in out)


def test_filter_audit(spark):
    """Nulls, repeated rows and doc_ids, columns named like the operator's own, several labels of one document."""
    rng = random.Random(3)
    rows = random_docs(rng, 120)
    ids = [r[0] for r in rows if r[0] is not None]
    labels = [(rng.choice([*ids, -5, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    docs, known = spark.createDataFrame(rows, ROWS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.failure_cells(docs, known))
    labels = [x for x in labels if x[0] is not None]
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(rows, labels)
    assert filter_audit.audit(filter_audit.failure_cells(docs.limit(0), known)).count() == 0
    assert filter_audit.audit(filter_audit.failure_cells(docs, known.limit(0))).agg({"good_lost": "sum"}).first()[0] == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_gray_walk(k):
    cells = np.random.default_rng(k).integers(0, 9, (1 << k, 3))
    states = filter_audit.gray_walk(cells)
    for subset in range(1 << k):
        assert states[subset].tolist() == cells[[m for m in range(1 << k) if not m & subset]].sum(axis=0).tolist()
    shapley = {(r[2]): r[-1] for r in filter_audit.step_rows(states, "ABCDE"[:k])}
    assert sum(shapley.values()) == len(list(permutations(range(k)))) * (states[0, 0] - states[-1, 0])


@pytest.fixture(scope="module")
def byte_codec():
    return bytepairs.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), bytepairs.library_classes())


@pytest.fixture(scope="module")
def library(byte_codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_codec.ranks, special_tokens={})


QUOTES = ["'", "'s", "a's", " 's", "  's", "\n's", "a'", "'r", "'re", "'rest", "''s", "x'll y've z'd 'm", "'s's't", "'S 'ſ"]
BLANKS = ["a  b", "a \n b", "a\n\nb", "  ", "a ", " ", "　 x", "\x1c\x1d a", "\x85b", "", "\ta\x0b b "]
OTHERS = ["1'2", "12 ab3", "’s", "٣x ¼²", "é", "e\u0301", "a" * 3000, "ab" * 1500 + " " * 100 + "c", "日本語テキスト", "👍🏽'd", "<|endoftext|>", "\x00\ufeff"]


def test_codec_as_library(byte_codec, library):
    """Hard texts, and a sample of all characters beside letters, numbers, blanks and apostrophes."""
    rng = random.Random(1)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = QUOTES + BLANKS + OTHERS + ["".join(rng.choice("aslrevdmt' \n1.é日 ") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [f"a{x}b 1{x}2 !{x}!  {x}{x} \n{x}'s{x}'s" for x in rng.sample(every, 5000) + every[:1500] + list("\u0558\u088f\U00010940")]
    for limit in (2 << 20, 60):
        got = []
        for _, _, buf, offsets in chunks(pa.array(texts), limit):
            ids, at = byte_codec.encode(buf, offsets)
            got += [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)]
            assert byte_codec.decode(ids).tobytes() == buf.tobytes()
        assert got == library.encode_ordinary_batch(texts)


def test_codec_cuts_and_forgets(byte_codec, library, monkeypatch):
    rng = random.Random(2)
    text = " ".join(rng.choice(["word", "é", "x'll", "zzyzx" * 9, "\n", "'s", "  ", "qwertz"]) + rng.choice(["", "1", "ab"]) for _ in range(3000))
    monkeypatch.setattr(bytepairs, "MEMORY_PIECES", 2)
    for limit in (1, 50, 1 << 20):
        assert byte_codec.encode_long(np.frombuffer(text.encode(), np.uint8), limit).tolist() == library.encode_ordinary(text)
    with pytest.raises(ValueError, match="outside"):
        byte_codec.decode(np.array([50256]))


def test_merges_and_perfect_hash(byte_codec, library):
    rng = random.Random(3)
    for n in (1, 2, 3, 9, 40, 400):
        piece = bytes(rng.choice(b"aeinst") for _ in range(n))
        assert byte_codec.merged(piece) == library._core_bpe.encode_single_piece(piece) or piece in byte_codec.ranks
    for n in (0, 1, 2, 1000):
        keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64))
        assert sorted(bytepairs.PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))
    assert bytepairs.PerfectHash(np.array([5], np.uint64)).slots(np.arange(9, dtype=np.uint64)).tolist() == [0] * 9


def test_op12_by_library(spark, tmp_path, library):
    """The query's columns, with nulls, repeated rows and clashing columns; an empty table; null ids."""
    rows = [(n, t, [7], "x") for n, t in enumerate([None, *QUOTES, *BLANKS, *OTHERS])] + [(1, "again", None, None), (1, "again", None, None), (None, "Nobody's", None, None), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, decoded string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda b: sha256(b).hexdigest()
    expected = [(d, len(ids := library.encode_ordinary(t or "")), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())) for d, t, *_ in rows]
    assert sorted(map(tuple, bpe.op12_byte_bpe(spark, str(tmp_path)).collect()), key=str) == sorted(expected, key=str)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert bpe.encode(docs.limit(0), ranks).count() == 0
    got = bpe.decode(spark.createDataFrame([(1, None), (2, []), (3, [64, 65])], "doc_id long, ids array<int>"), ranks, out="bytes").collect()
    assert [(r.doc_id, r.bytes) for r in got] == [(1, None), (2, b""), (3, b"ab")]
    with pytest.raises(ValueError, match="pattern"):
        bpe.encode(docs, ranks, r"\w+")


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def tree(leaves):
    """The root, and each leaf's siblings as (left, right) of each level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    path = lambda k: [(x[(k >> n) - 1] if k >> n & 1 else None, x[(k >> n) + 1] if not k >> n & 1 and (k >> n) + 1 < len(x) else None) for n, x in enumerate(levels[:-1])]
    return levels[-1][0], [path(k) for k in range(len(leaves))]


def manifest_by_hand(rows):
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    parts = {}
    for d, t, lang, source, n, *_ in rows:
        struck = d is not None and crc32(str(d).encode()) % 7 == 0
        leaf, other = (h(*map(value, (d, source, lang, m, t))) for m in (n, n if n is None or not struck else n + 1))
        parts.setdefault(lang, []).append((d is not None, d or 0, leaf, other, d))
    keys = sorted(parts, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([r[2] for r in sorted(parts[k])]) for k in keys}
    root, above = tree([trees[k][0] for k in keys])
    out = []
    for k, up in zip(keys, above, strict=True):
        for (_, _, leaf, other, d), own in zip(sorted(parts[k]), trees[k][1], strict=True):
            path, now = own + up, other
            for left, right in path:
                now = h(left or "", now, right or "")
            out.append((d, leaf, trees[k][0], root, h(*[x for p in path for x in p if x]), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 3, merkle.HEIGHT])
def test_op11_by_hand(spark, tmp_path, monkeypatch, height):
    """Trees of many sizes in blocks of two leaves on, with nulls, repeated rows and clashing columns."""
    rng = random.Random(height)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 13)
    monkeypatch.setattr(merkle.Manifest.__init__, "__defaults__", (height,))
    sizes = {"en": 37, "de": 1, "é": 2, None: 3, "zz": 8, "z": 5}
    rows = [(rng.choice([k, None]) if rng.random() < 0.1 else 100 * n + k, rng.choice(["a", None, "", "ü 1"]), lang, rng.choice(["s", None]), rng.choice([k, None]), 0, "x", "y", 1) for n, (lang, size) in enumerate(sizes.items()) for k in range(size)]
    rows += [rows[0]] * 5 + [(None, None, None, None, None, 0, None, None, 1)] * 2
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == manifest_by_hand(rows)
    assert any(not r[-1] for r in got)


@pytest.mark.parametrize("rows", [[], [(7, "x", "en", "s", 1, 0, "x", "y", 1)], [(n, "x", "en", "s", 1, 0, "x", "y", 1) for n in range(2)]])
def test_small_manifests(spark, tmp_path, rows):
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == (manifest_by_hand(rows) if rows else [])


@pytest.mark.parametrize("height", range(12))
def test_addresses(height):
    """Every place is used once, and each subtree of the recursive halving is a run of places."""
    at = merkle.addresses(height)
    assert sorted(np.concatenate(at).tolist()) == list(range((1 << height + 1) - 1))

    def check(depth, number, levels):
        places = sorted(int(at[depth + k][(number << k) + x]) for k in range(levels) for x in range(1 << k))
        assert places == list(range(places[0], places[0] + len(places))) and places[0] == at[depth][number]
        if levels > 1:
            check(depth, number, levels // 2)
            for x in range(1 << levels // 2):
                check(depth + levels // 2, (number << levels // 2) + x, levels - levels // 2)

    check(0, 0, height + 1)
