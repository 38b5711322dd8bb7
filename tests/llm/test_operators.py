"""Operators and stages on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import io
import random
import re
import struct
import zipfile
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

import corpus_pipeline
from ribolens.llm import context_tree, decontamination, line_dedup, near_dedup, neighbours, packing, quality, sharding, token_counts, warc, ziparchive

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "io", "u", "an", "or")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """doc_id, text, lang, source, n_chars, and columns named like the operators' own."""
    rng = random.Random(9)
    long = "\n".join(sentence(rng, 40) for _ in range(120))
    base = [sentence(rng, 80) for _ in range(12)]
    near = " ".join(base[0].split()[:-1] + ["other"])
    texts = [*base, near, base[1], base[1], long, long + " end", "", None, " \n ", "a", "two words", base[2] + "\n" + base[3]]
    rows = [(n, t, "en" if n % 3 else None, f"s{n % 2}", None if t is None else len(t), n, "x", -1) for n, t in enumerate(texts)]
    rows += [rows[4], (None, base[5], None, None, None, None, None, None), (None, base[5], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard long, node string, n_dropped int")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_sharding(docs, empty):
    got = sharding.shard_records(docs, "doc_id", [1, 0, 2, 1], [1, 0, 2, 1, 3]).collect()
    assert len(got) == docs.count() and all(r.shard != 1 and r.grown_shard in (r.shard, 4) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.shard_records(empty, "doc_id", [1.0]).count() == 0
    many = docs.sparkSession.range(60_000).withColumnRenamed("id", "doc_id")
    shares = dict(sharding.shard_records(many, "doc_id", [1, 3]).groupBy("shard").count().collect())
    assert shares[1] / 60_000 == pytest.approx(0.75, abs=0.01)


def test_op7_by_brute_force(spark, tmp_path):
    """Every column of the query, from MD5 and CRC-32 of the standard library."""
    from hashlib import md5
    from math import log

    rng = random.Random(13)
    rows = [(n, sentence(rng, rng.randint(0, 30)) + rng.choice(["", "é", "\n"])) for n in range(150)] + [(200, None), (201, ""), (None, "x"), (None, "x"), (None, "other"), (5, "again")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in sharding.op7_sharding(spark, str(tmp_path)).collect()]

    def draw(key, shard):
        return (int(md5(f"{'null' if key is None else key}:{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    def best(key, n):
        return max(range(n), key=lambda s: (1 / -log(draw(key, s)), s))

    placed = [(k, len((t or "").encode()) + 8, crc32((t or "").encode()), "key", best(k, 24), best(k, 25)) for k, t in rows]
    assert Counter((r[0], *r[1:5], r[6]) for r in got) == Counter(placed)
    for s in range(24):
        assert sorted(r[5] for r in got if r[4] == s) == list(range(sum(p[4] == s for p in placed)))
    assert any(p[4] != p[5] for p in placed) and all(p[5] in (p[4], 24) for p in placed)


def test_slots_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    got = sharding.shard_records(spark.range(500), "id", [1.0] * 3).collect()
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_token_counts(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter(map(tuple, token_counts.token_counts(docs, path, limit=100).collect()))
    expected = Counter((k, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for k, t in rows_of(docs))
    assert got == expected and token_counts.token_counts(empty, path).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, capacity = Tokenizer.from_file(path), 300
    pieces = packing.pieces(docs, path, capacity=capacity)
    expected = Counter()
    for k, t in rows_of(docs):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            expected[k, n, at, len(part := ids[at : at + capacity]), crc32(part.tobytes())] += 1
    got = packing.pack(pieces, capacity=capacity, part_pieces=6).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
    least = packing.lower_bound(np.array([r.length for r in got]), capacity)
    assert least <= len(bins) <= 1.1 * least + 2
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_pack_repacks_partitions_with_gaps(spark):
    rng = random.Random(1)
    items = spark.createDataFrame([(n, 0, rng.choice([26, 27, 50, 51, 23, 49, 74])) for n in range(400)], "doc_id long, piece int, length long")
    few = {r: packing.pack(items, capacity=100, rounds=r, part_pieces=40).select("sequence_id").distinct().count() for r in (0, 3)}
    assert few[3] <= few[0]


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def grams(words):
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def test_decontamination(spark, docs, empty):
    rng = random.Random(2)
    items = [sentence(rng, n) for n in (16, 30, 3, 1, 60)] + ["", None]
    edited = items[4].split()
    edited[1] = "other"
    texts = [f"{sentence(rng, 30)}. {items[0].upper()}! {sentence(rng, 9)}", items[2], f"{sentence(rng, 5)} {' '.join(edited)} {sentence(rng, 5)}", items[1][: len(items[1]) // 2], f"{sentence(rng, 20)}\n{items[2]}", items[0] + " " + items[0]]
    more = spark.createDataFrame([(100 + n, t) for n, t in enumerate(texts)] + [(100, texts[0]), (None, items[0])], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, "a b c")], "item_id long, text string").selectExpr("item_id", "text", "1 AS doc_id")
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in decontamination.contaminated(both, bench).collect()}
    expected = {}
    for key, text in rows_of(both):
        w = words_of(text)
        for i, item in enumerate(items):
            own = words_of(item)
            for s in range(len(w) - len(own) + 1 if own else 0):
                x = jaccard(grams(w[s : s + len(own)]), grams(own))
                if x >= 0.8 and x > expected.get((key, i), (0, 0, 0))[2]:
                    expected[key, i] = (s, len(own), x)
    assert {k: (*v[:2], pytest.approx(v[2])) for k, v in expected.items()} == got and (102, 4) in got and (103, 1) not in got and (None, 0) in got
    assert decontamination.contaminated(empty, bench).count() == 0 == decontamination.contaminated(docs, bench.limit(0)).count()


def test_documents_shorter_than_the_item(spark):
    """A document that is an item less some words is one window of its own length."""
    rng = random.Random(21)
    item = sentence(rng, 59).split()
    texts = [item[:57], item[3:], item[:49], item[:48], item[:30], item[:4]]
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[:6]))], "item_id long, text string")
    got = {r.doc_id: (r.start, r.n_words, r.similarity) for r in decontamination.contaminated(docs, bench).where("item_id = 7").collect()}
    expected = {n: (0, len(t), x) for n, t in enumerate(texts) if (x := jaccard(grams(t), grams(item))) >= 0.8}
    assert {n: (*v[:2], pytest.approx(v[2])) for n, v in expected.items()} == got and set(got) == {0, 1, 2, 3}


def test_decontamination_stage_keeps_clean_texts_of_a_key(spark, tmp_path):
    """Rows with one doc_id, or none, are judged by their own text."""
    rng = random.Random(22)
    passage, clean, other = sentence(rng, 30), sentence(rng, 40), sentence(rng, 40)
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, passage), (None, clean), (None, None), (5, f"{other} {passage}"), (5, other), (6, clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(rows_of(corpus_pipeline.decontamination(spark, docs, str(tmp_path))))
    assert got == Counter([(None, clean), (None, None), (5, other), (6, clean)])


def test_near_prints_finds_all(spark):
    rng = random.Random(6)
    items = [rng.getrandbits(64) for _ in range(8)]
    near = [x ^ sum(1 << b for b in rng.sample(range(64), d)) for x in items for d in (0, 10, decontamination.RADIUS, decontamination.RADIUS + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    windows = spark.createDataFrame([(n, signed(x), 9, 4) for n, x in enumerate(near)], "w long, print long, n int, total long")
    filed = spark.createDataFrame([(n, signed(x), 9, 4) for n, x in enumerate(items)], "item_id long, print long, n int, total long")
    met = decontamination.near_prints(windows, filed).join(windows, ["n", "print"]).join(filed.withColumnRenamed("print", "item_print").drop("total"), ["n", "item_print"])
    got = {(r.w, r.item_id) for r in met.collect()}
    assert got == {(a, b) for a, x in enumerate(near) for b, y in enumerate(items) if (x ^ y).bit_count() <= decontamination.RADIUS}


def test_near_classes(docs, empty):
    got = Counter(((r.doc_id, r.version), (r.class_id, r.class_version)) for r in near_dedup.near_classes(docs).collect())
    rows = rows_of(docs)
    keys = {(r.doc_id, r.text or ""): r.version for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS version").collect()}
    label = list(range(len(rows)))
    sets = [grams(words_of(t)) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            same = jaccard(sets[a], sets[b]) >= 0.8 or (not sets[a] and not sets[b] and (rows[a][1] or "") == (rows[b][1] or ""))
            if same and label[a] != label[b]:
                label = [label[b] if x == label[a] else x for x in label]
    place = [(k, keys[k, t or ""]) for k, t in rows]
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    expected = Counter((place[n], min((place[m] for m in range(len(rows)) if label[m] == label[n]), key=order)) for n in range(len(rows)))
    assert got == expected
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert near_dedup.near_classes(empty).count() == 0 == near_dedup.keep_one(empty).count()


def classes_by_brute_force(texts, similarity=0.8):
    """The least key of each text's class, by comparing all pairs."""
    sets, label = {k: grams(words_of(t)) for k, t in texts.items()}, {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and label[a] != label[b] and jaccard(sets[a], sets[b]) >= similarity:
                low, high = sorted((label[a], label[b]))
                label = {k: low if x == high else x for k, x in label.items()}
    return label


@pytest.mark.parametrize(("nodes", "paired"), [(1024, 16), (40, 4)])
def test_near_copies_about_the_threshold(spark, monkeypatch, nodes, paired):
    """300 copies of one text, each with other words changed, so that only some pairs are links; in one block or in several."""
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", nodes)
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    rng = random.Random(8)
    base = [rng.choice(WORDS) + str(n) for n in range(120)]
    texts = {}
    for n in range(300):
        own = list(base)
        for place in rng.sample(range(120), rng.randint(0, 6)):
            own[place] = f"x{rng.randint(0, 3)}" if n % 3 else f"y{n}"
        texts[n] = " ".join(own)
    texts[900] = " ".join(base[:60])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(rows).collect()} == classes_by_brute_force(texts)


def test_overlaps_and_forest():
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(rng.choice(pool[:60] if n % 2 else pool, rng.integers(0, 50))) for n in range(150)]
    got = near_dedup.overlaps(sets[:70], sets[50:])
    assert (got == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[50:]] for x in sets[:70]]).all()
    links = rng.random((60, 80)) < 0.012
    rows, columns = near_dedup.forest(links)
    assert links[rows, columns].all()

    def parts(pairs):
        label = list(range(140))
        for r, c in pairs:
            label = [min(label[r], label[60 + c]) if x in (label[r], label[60 + c]) else x for x in label]
        return label

    assert parts(zip(rows.tolist(), columns.tolist(), strict=True)) == parts(np.argwhere(links).tolist())


def test_line_dedup(spark, empty):
    rows = [
        (1, "the first line here\nOrder 17 of 2024 was sent\n\nkeep me"), (2, "Order 99 of 1999 was sent\nthe first line here\nmine"), (3, None), (4, ""), (5, "keep me not\n  \nown line\nown line"), (6, "the first line here"), (None, "mine\nthe end"),
        (7, "dear reader of the north wind please write to anna at home soon"), (8, "dear reader of the north wind please write to bert at home soon"), (8, "dear reader of the north wind please write to bert at home soon"),
    ]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, line string")
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped, r.line) for r in line_dedup.drop_recurring_lines(frame).collect())
    assert got == Counter(
        [
            (1, "the first line here\nOrder 17 of 2024 was sent\n\nkeep me", 4, 0, "z"), (2, "", 3, 3, "z"), (3, None, 0, 0, "z"), (4, "", 1, 0, "z"), (5, "keep me not\n  \nown line\nown line", 4, 0, "z"), (6, "", 1, 1, "z"), (None, "mine\nthe end", 2, 0, "z"),
            (7, rows[7][1], 1, 0, "z"), (8, "", 1, 1, "z"), (8, "", 1, 1, "z"),
        ]
    )
    assert line_dedup.drop_recurring_lines(empty.select("doc_id", "text")).count() == 0


def test_short_lines_differ_by_a_word(spark):
    """One other word makes a short line another sentence; a number doesn't, nor a name in a longer line."""
    lines = ["I want to sleep", "I want to run", "I want to run 5", "I want to run 6", "please write to our anna today", "please write to our bert today"]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.drop_recurring_lines(frame).where("n_dropped = 1").collect()} == {3, 5}


def test_lines_of_wildcards_alone(spark):
    """Lines whose tokens all hold a digit recur only if they are equal."""
    rows = [(1, "17\n1 2 3\nhttp://a/1\nOrder 5"), (2, "18\n4 5 6\nhttp://b/2\nOrder 6"), (3, "17\nown")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_recurring_lines(frame).collect()}
    assert got == {1: rows[0][1], 2: "18\n4 5 6\nhttp://b/2", 3: "own"}


def test_quality_rejects_toxic(spark):
    """Toxic labelled documents are learnt as what to reject, whatever their quality; marked as toxic, at least as well as
    if they were of low quality alone, without more clean ones."""
    rng = random.Random(23)
    good = [(n, sentence(rng, rng.randint(20, 80))) for n in range(300)]
    toxic = [(1000 + n, " ".join(w + rng.choice(("", "zzq")) for w in sentence(rng, 50).split())) for n in range(100)]
    frame = spark.createDataFrame(good + toxic, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good[::2]] + [(k, 1, 1) for k, _ in toxic[::2]], "doc_id long, quality int, toxic int")
    rejected = labels.selectExpr("doc_id", "IF(toxic = 1, 0, quality) AS quality", "0 AS toxic")
    kept, expected = ({r.doc_id for r in quality.resample(frame, quality.fit(frame, x)).where("selected").collect()} for x in (labels, rejected))
    assert {k for k in kept if k >= 1000} <= {k for k in expected if k >= 1000}
    assert sum(k in kept for k, _ in good) >= sum(k in expected for k, _ in good) - 0.01 * len(good)
    assert sum(k in kept for k, _ in good) / len(good) > 3 * sum(k in kept for k, _ in toxic) / len(toxic)


def test_quality(spark, empty):
    rng = random.Random(3)
    good = [(n, sentence(rng, rng.randint(3, 120))) for n in range(300)]
    bad = [(1000 + n, " ".join(w + "!!" for w in sentence(rng, rng.randint(6, 80)).upper().split())) for n in range(60)]
    frame = spark.createDataFrame([(*r, 1.5) for r in good + bad] + [(5000, None, 0.0), (5001, "", 0.0), (None, good[0][1], 0.0), good[1] + (0.0,)], "doc_id long, text string, log_weight double")
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good[::2]] + [(k, 0, 0) for k, _ in bad[::2]] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(frame, labels)
    got = [(r.doc_id, r.selected) for r in quality.resample(frame, model).collect()]
    assert len(got) == 364 and sum(s for _, s in got) >= model.count
    kept = {k for k, s in got if s}
    assert sum(k in kept for k, _ in good) >= 0.97 * len(good) and sum(k in kept for k, _ in bad) <= 0.03 * len(bad) + 1
    none = quality.fit(frame, labels.limit(0))
    assert all(r.selected for r in quality.resample(frame, none).collect())
    assert quality.resample(empty.select("doc_id", "text"), quality.fit(empty, labels)).count() == 0


def test_quality_finds_a_few_toxic_words(spark):
    """Long texts are toxic for two words that clean ones lack; marked and unmarked ones go, clean ones stay."""
    rng = random.Random(29)
    insults = ["zzidiot", "zzscum", "zztrash", "zzclown"]

    def toxic(n):
        words = sentence(rng, n).split()
        for w in rng.sample(insults, 2):
            words.insert(rng.randrange(n), w)
        return " ".join(words)

    rows = [(n, sentence(rng, rng.randint(30, 300))) for n in range(400)] + [(1000 + n, toxic(rng.randint(30, 300))) for n in range(120)]
    labels = spark.createDataFrame([(n, 1, 0) for n in range(0, 400, 2)] + [(1000 + n, 1, 1) for n in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, toxicity double")
    model = quality.fit(frame, labels)
    out = quality.resample(frame, model)
    kept = {r.doc_id for r in out.where("selected").collect()}
    assert out.columns == ["doc_id", "text", "toxicity", "log_weight", "selected"]
    assert sum(k >= 1000 for k in kept) <= 6 and len({k for k in kept if k < 1000}) >= 0.9 * 400
    found = {r.doc_id for r in frame.collect()} - kept
    assert {r.doc_id for r in quality.resample(frame, quality.fit(frame, labels.where("toxic = 0 OR doc_id = 1000"))).where("NOT selected").collect()} <= found | set(range(400)) | {1000}


def test_toxicity_by_hand():
    """The largest ratios of a text's kept features, each counted once."""
    model = quality.Model(np.zeros(quality.BUCKETS), 1, np.array([5, 9, 11, 40]), np.array([1.0, 2.0, 4.0, 8.0]))
    hashes = np.array([5, 9, 9, 11, 40, 9 + quality.FINE_BUCKETS, 7, 5], np.uint64)
    assert model.toxicity(hashes, np.array([0, 0, 0, 0, 0, 1, 2, 3]), 5).tolist() == [14.0, 2.0, 0.0, 1.0, 0.0]
    assert quality.Model(np.zeros(quality.BUCKETS), 1, np.zeros(0, np.int64), np.zeros(0)).toxicity(hashes, np.zeros(8, int), 2).tolist() == [0.0, 0.0]


def hashed(data):
    """The 64-bit hash of a token: a polynomial of its bytes, then mixed with its length."""
    base, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    return mixed((sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(data)) + len(data) * base) & mask)


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ (x >> 31)


def test_quality_by_brute_force(spark):
    """Ratio, weights and draw, from token lists and plain sums."""
    rng = random.Random(17)
    rows = [(n, sentence(rng, rng.randint(0, 60)) + rng.choice(["", " 7!", "?? é"])) for n in range(120)]
    rows += [(500 + n, "!! " + sentence(rng, 9).upper() + " $$") for n in range(40)] + [(900, None), (901, ""), (3, rows[3][1])]
    rows.append((902, "so lang " * 30_000))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(n, 1, 0) for n in range(0, 120, 2)] + [(500 + n, 0, 0) for n in range(0, 40, 2)] + [(7, 1, 1), (9, 1, None)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(frame, marked)
    half = {r.doc_id for r in frame.where(f"pmod(xxhash64(doc_id, {quality.SEED}), 2) = 0").collect()}
    good = {k: q == 1 and t != 1 for k, q, t in labels}
    found = []
    for _, text in rows:
        tokens = [hashed(x.encode()) for x in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff\s]+", text or "")]
        found.append([x % quality.BUCKETS for x in tokens] + [mixed((3 * x + y) & (1 << 64) - 1) % quality.BUCKETS for x, y in zip(tokens, tokens[1:], strict=False)])
    raw, target = np.ones(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for (k, _), own in zip(rows, found, strict=True):
        np.add.at(raw, own, 1)
        if good.get(k) and k in half:
            np.add.at(target, own, 1)
    raw /= raw.sum()
    target = (target + quality.PRIOR * quality.BUCKETS * raw) / (target.sum() + quality.PRIOR * quality.BUCKETS)
    ratio = np.log(target / raw)
    assert model.ratio == pytest.approx(ratio)
    weight = [ratio[own].sum() * quality.SPREAD / (len(own) + quality.EASED) for own in found]
    known = [(w, good[k]) for (k, _), w in dict(zip(rows, weight, strict=True)).items() if k in good and not (good[k] and k in half)]
    cut = max([(sum(w > c for w, g in known if g) / sum(g for _, g in known) - sum(w > c for w, g in known if not g) / sum(not g for _, g in known)) for c in [w for w, _ in known]])
    took = [(sum(w >= model.cut for w, g in known if g) / sum(g for _, g in known) - sum(w >= model.cut for w, g in known if not g) / sum(not g for _, g in known))]
    assert took[0] >= cut and model.count == sum(w >= model.cut for w in weight)
    seed = mixed(quality.SEED)
    drawn = [-np.log(-np.log(((mixed((-1 if k is None else k) & (1 << 64) - 1 ^ seed) >> 12) + 0.5) / 2.0**52)) for k, _ in rows]
    order = sorted((w + d for w, d in zip(weight, drawn, strict=True)), reverse=True)
    got = Counter((r.doc_id, round(r.log_weight, 6), r.selected) for r in quality.resample(frame, model).collect())
    least = order[model.count - 1] - 1e-8
    assert got == Counter((k, round(w, 6), bool(w + d >= least)) for (k, _), w, d in zip(rows, weight, drawn, strict=True))


def test_kth_largest(spark):
    rng = random.Random(4)
    xs = [rng.randint(-(1 << 62), 1 << 62) for _ in range(300)] + [5, 5, 5, -1, 0]
    frame = spark.createDataFrame([(x,) for x in xs], "x long")
    for k in (1, 7, 150, len(xs)):
        assert quality.kth_largest(frame, "x", k) == sorted(xs, reverse=True)[k - 1]


def test_context_tree_scores(docs, empty):
    got = context_tree.context_tree_scores(docs).collect()
    held = lambda k: crc32(("" if k is None else str(k)).encode()) % 10 == 0
    rows = [(k, re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))) for k, t in rows_of(docs)]
    count = Counter(w for k, ws in rows if not held(k) for w in [*ws, None])
    n, v = sum(count.values()), len(count)
    base = lambda ws: sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*ws, None])
    expected = Counter((k, held(k), len(ws) + 1, sum(count[w] > 0 for w in [*ws, None]), n, round(base(ws), 6)) for k, ws in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert context_tree.context_tree_scores(empty).count() == 0


def test_context_tree_blocks_agree(docs, monkeypatch):
    """Scores don't depend on how texts are dealt into blocks and parts."""
    one = sorted((r.doc_id or -1, round(r.score, 3)) for r in context_tree.context_tree_scores(docs.coalesce(1)).collect())
    many = sorted((r.doc_id or -1, round(r.score, 3)) for r in context_tree.context_tree_scores(docs.repartition(7)).collect())
    assert one == many


def sequential_kt(bits):
    p, n = 1.0, [0, 0]
    for b in bits:
        p *= (n[b] + 0.5) / (sum(n) + 1)
        n[b] += 1
    return p


def weighted(history, depth, d, context):
    """P_w of the bits (with contexts, newest first) at a node, straight from the definition."""
    own = [b for c, b in history if c[:d] == context]
    if d == depth:
        return sequential_kt(own)
    below = 1.0
    for s in {c[d] for c, _ in history if c[:d] == context}:
        below *= weighted(history, depth, d + 1, (*context, s))
    return 0.5 * sequential_kt(own) + 0.5 * below


def decisions(texts, depth):
    """For each binary decision's bits before: the contexts (newest byte first) and bits of the texts' bytes and ends."""
    out = {}
    for text in texts:
        own = b"\xff" * depth + "".join(w + " " for w in text.lower().split()).encode() + b"\xff"
        for i in range(depth, len(own)):
            for j in range(8):
                out.setdefault(1 << j | own[i] >> (8 - j), []).append((tuple(own[i - depth : i][::-1]), own[i] >> (7 - j) & 1))
    return out


def test_score_by_definition(spark):
    """Each bit's probability is P_w(training bits and the bit) / P_w(training bits); word order counts."""
    rng = random.Random(31)
    rows = [(n, " ".join(rng.choice(["ab", "abc", "Ba", "caab", "\u00e9"]) for _ in range(rng.randint(0, 6)))) for n in range(24)] + [(200, "ab abc ba"), (200, "ba abc ab")]
    got = context_tree.context_tree_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    train = decisions([t for k, t in rows if crc32(str(k).encode()) % 10], context_tree.DEPTH)
    expected = []
    for k, text in rows:
        score = 0.0
        for before, events in decisions([text], context_tree.DEPTH).items():
            history = train.get(before, [])
            for event in events:
                score += np.log10(weighted([*history, event], context_tree.DEPTH, 0, ()) / weighted(history, context_tree.DEPTH, 0, ()))
        expected.append((k, pytest.approx(score, rel=1e-6)))
    assert sorted((r.doc_id, r.score) for r in got) == [(k, s) for k, s in sorted(expected, key=lambda x: (x[0], x[1].expected))]
    assert len({r.score for r in got if r.doc_id == 200}) == 2


def test_held_out_text_is_predicted(spark):
    """On text of one source the tree is well under eight bits a byte, also on texts that it hasn't seen."""
    rng = random.Random(12)
    frame = spark.createDataFrame([(n, sentence(rng, 60)) for n in range(300)], "doc_id long, text string")
    held = [r for r in context_tree.context_tree_scores(frame).collect() if r.held_out]
    assert held and all(r.bits_per_byte < 2.6 and r.score > 1.1 * r.base_score for r in held)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 6))
    v[50:120] = v[50]
    rows = [(n, x.tolist()) for n, x in enumerate(v)] + [(900, None), (901, []), (902, [0.0] * 6), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [float("nan")] * 6), (905, [float("inf")] * 6), (906, [1.0, 2.0]), (None, [1.0] * 6), (920, [2.0, 1.0])]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, dim string")
    got = {}
    for r in neighbours.nearest(frame, frame.where("vec_id % 20 = 0"), k=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fine = {k: np.array(x, float) for k, x in rows if k is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    for q, found in got.items():
        near = sorted(((-sum(a * b for a, b in zip(fine[q], x, strict=True)), k) for k, x in fine.items() if k != q and len(x) == len(fine[q])))[:8]
        assert [(k, s) for _, k, s in found] == [(k, pytest.approx(-s)) for s, k in near] and [r for r, _, _ in found] == list(range(1, len(near) + 1))
    assert set(got) == {k for k in fine if k % 20 == 0}
    assert neighbours.nearest(frame.limit(0), frame.limit(0)).count() == 0
    again = spark.createDataFrame([(1, [2.0, 0.0]), (1, [1.0, 5.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(again, again.where("vec_id = 20")).orderBy("rank").collect()] == [(20, 1, 1, 5.0), (20, 2, 2, 1.0)]


@pytest.mark.parametrize("kind", ["bits", "one-hot", "ternary", "one long", "one huge", "copies", "norms"])
def test_search_is_exact(kind, monkeypatch):
    """Ties of any number go to the smaller id; norms of any size don't disturb the rest."""
    monkeypatch.setattr(neighbours, "PAIRS_AT_ONCE", 500)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(900, 16))
    if kind == "bits":
        v = rng.integers(0, 2, (900, 16)).astype(float)
    if kind == "one-hot":
        v = np.eye(300)[rng.permutation(300)]
    if kind == "ternary":
        v = rng.integers(-1, 2, (900, 5)).astype(float)
    if kind == "one long":
        v[77] = 4e8
    if kind == "one huge":
        v[77] = 1e200
    if kind == "copies":
        v[100:700] = v[100]
    if kind == "norms":
        v *= 10.0 ** rng.integers(-20, 20, (900, 1))
    v = v[(v != 0).any(axis=1)]
    ids = rng.permutation(len(v)) * 3
    asked = np.concatenate([np.arange(0, len(v), 29), [min(77, len(v) - 1)]])
    tree = neighbours.VantageTree.unpack(neighbours.VantageTree.build(ids, v, leaf=32).pack())
    query, member, score = tree.search(ids[asked], v[asked], 20)
    for n, q in enumerate(asked):
        products = neighbours.inner_products(np.broadcast_to(v[q], v.shape), v)
        expected = [(-s, i) for s, i in sorted((-s, i) for s, i in zip(products.tolist(), ids.tolist(), strict=True) if i != ids[q])[:20]]
        assert list(zip(score[query == n].tolist(), member[query == n].tolist(), strict=True)) == expected


def test_recall_falls_slowly_with_relax():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16))
    tree = neighbours.VantageTree.unpack(neighbours.VantageTree.build(np.arange(3000), v).pack())
    queries = v[::100]
    exact = np.argsort(-(queries @ v.T), axis=1)[:, :10]
    recall = {}
    for relax in (1.0, 1.5, 4.0):
        query, member, _ = tree.search(np.full(len(queries), -1), queries, 10, relax)
        recall[relax] = np.mean([len(set(member[query == n].tolist()) & set(e.tolist())) / 10 for n, e in enumerate(exact)])
    assert recall[1.0] == 1 and recall[1.5] >= 0.9 and recall[4.0] <= recall[1.5]


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STRIDE", 500)
    big = "<p>" + "é" * 200
    rows = [(1, "http://a", big), (2, "http://b\n\"x\"", big), (3, None, None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (None, "u", big), (1, "http://a", big), (1 << 60, "u", big), (0, "u", "<p>own" * 40)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    packages = warc.write_packages(pages, f"file://{tmp_path}/w", package_bytes=300)
    got = Counter((r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload).decode()) for r in warc.fetch(warc.locate(packages)).collect())
    expected = Counter()
    for k, u, h in rows:
        again = h == big and k != 1
        expected[k, u, "revisit" if again else "response", 1 if again else None, len((h or "").encode()), None if again else h or ""] += 1
    assert got == expected and packages.count() > 1
    none = warc.write_packages(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.fetch(warc.locate(none)).count() == 0


def test_zip_directories(monkeypatch):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.comment = b"PK\5\6 a comment with the mark"
        for name, body in (("a/é.txt", b"hello world"), ("b", b""), ("c", b"0123456789" * 50)):
            z.writestr(name, body)
        z.writestr("packed", b"a" * 500, zipfile.ZIP_DEFLATED)
    size = len(data.getvalue())
    members = {m.name: m for m in ziparchive.directory(data, size)}
    at = ziparchive.data_start(data, members["c"])
    assert list(members) == ["a/é.txt", "b", "c", "packed"] and ziparchive.read_range(data, at + 3, 4) == b"3456"
    with pytest.raises(ValueError, match="compressed"):
        ziparchive.data_start(data, members["packed"])
    with pytest.raises(ValueError):
        ziparchive.directory(io.BytesIO(b"no archive" * 9), 90)


def test_zip64_directory():
    """The same archive with all places and sizes moved to ZIP64 fields."""
    body, name = b"stored bytes", b"x"
    local = struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<2H2Q", 1, 16, len(body), len(body))
    entry = struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 32, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<2H", 9, 0) + struct.pack("<2H3Q", 1, 24, len(body), len(body), 0)
    start = len(local) + len(body)
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, start + len(entry), 1)
    end = struct.pack("<4s4H2IH", b"PK\5\6", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    file = io.BytesIO(local + body + entry + end64 + locator + end)
    (member,) = ziparchive.directory(file, len(file.getvalue()))
    assert (member.name, member.size, member.header) == ("x", len(body), 0)
    assert ziparchive.read_range(file, ziparchive.data_start(file, member), member.size) == body


def test_stages_with_clashing_columns(spark, tmp_path):
    """Columns named like any that a stage adds stay as they are."""
    rng = random.Random(31)
    names = ["__gone", "__version", "gone", "version", "_gone", "log_weight", "selected", "toxicity", "order", "n_lines", "n_dropped", "__uid", "__part", "class_id", "node", "hash", "sequence_id", "offset", "piece", "length"]
    passage, line = sentence(rng, 30), sentence(rng, 9)
    texts = [f"{sentence(rng, 60)}\n{line}" for _ in range(8)] + [passage]
    spark.createDataFrame([(n, t, "en", "s", len(t), *[n] * len(names)) for n, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in names)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(n, 1, 0) for n in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(set(r[5:]) == {r.doc_id} for r in out.collect())
        assert name != "decontamination" or out.count() == 8
    assert corpus_pipeline.packing(spark, docs, str(tmp_path)).count() == 9


def test_pipeline_stages(spark, docs, empty, tmp_path):
    """Each stage on its own input: columns stay, decisions hold, odd rows and empty tables pass."""
    rng = random.Random(30)
    passage = sentence(rng, 30)
    more = spark.createDataFrame([(500, f"{sentence(rng, 20)}\n{passage}", "en", "s", 1, 1, "n", 1)], docs.schema)
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(n, 1, 0) for n in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    source = docs.unionByName(more)
    source.write.parquet(f"{tmp_path}/documents.parquet")
    at = source
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        assert stage(spark, empty, str(tmp_path)).count() == 0
        if name != "packing":
            assert out.columns == docs.columns and {f.dataType for f in out.schema} == {f.dataType for f in docs.schema}
            out.write.parquet(f"{tmp_path}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert (500 in ids) == (name not in ("decontamination", "packing"))
        at = out
    final = Counter((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert final == Counter((r.doc_id, r.piece) for r in at.collect())
