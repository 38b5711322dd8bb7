"""Near-duplicate classes by ProbMinHash signatures of weighted word shingles, banding, and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribolens.llm.bytetext import WORD, chunks, mix, spans, spans_hash
from ribolens.llm.shared import sized, small_batches, unused, written
from ribolens.operators.clustering import components

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band with a probability of (1 - 0.8 ** 6) ** 42 < 3e-6.
BANDS, ROWS = 42, 6
#: Buckets of so many nodes at most are compared pair by pair, larger ones in blocks.
PAIRED = 16
#: Nodes and shingles of a block, about: blocks are dealt by hash.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 19
#: A shingle that so many pairs of a block share is counted by a matrix product, others pair by pair.
COMMON_PAIRS = 4096
#: Pairs that a Python worker gets at a time.
PAIR_ROWS = 32
_STEP = np.uint64(0x9E3779B97F4A7C15)

SIGNED = "doc_id long, version long, node binary, size long, bands array<long>"


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each row's different k-word shingles, by row and hash; under k words, one of all words."""
    starts, ends, row = spans(WORD[buf], offsets)
    h = spans_hash(buf, starts, ends)
    rows = len(offsets) - 1
    n = np.bincount(row, minlength=rows)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    long, short = np.flatnonzero((np.arange(len(h)) + k <= np.cumsum(n)[row])), np.flatnonzero((n > 0) & (n < k))
    value = np.zeros(len(long), np.uint64)
    for j in range(k):
        value = mix(value * np.uint64(31) + h[long + j])
    first = np.cumsum(n) - n
    few = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = n[short] > j
        few[has] = mix(few[has] * np.uint64(31) + h[first[short[has]] + j])
    row, value = np.concatenate([row[long], short]), np.concatenate([value, few])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(row)))


def prob_minhash(row: np.ndarray, value: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """ProbMinHash signatures: rows x m elements; two rows agree in a place with their probability Jaccard similarity.

    Each element is a Poisson process of its weight as rate, whose points fall on the m places at random; a place keeps
    the element with the earliest point. An element ends once its next point comes later than its row's latest place.
    All rows' elements advance together, point by point. Rows without elements stay 0.
    """
    best = np.full(rows * m, np.inf)
    kept = np.zeros(rows * m, np.uint64)
    state, time = value.copy(), np.zeros(len(value))
    row, weight = row.astype(np.int64), weight.astype(float)
    while len(row):
        state = state + _STEP
        draw = mix(state)
        time = time - np.log(((draw >> np.uint64(12)).astype(float) + 0.5) / 2.0**52) / weight
        place = row * m + (mix(draw ^ _STEP) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, place, time)
        won = time == best[place]
        kept[place[won]] = value[won]
        some, back = np.unique(row, return_inverse=True)
        latest = best.reshape(rows, m)[some].max(axis=1)
        go = time < latest[back]
        row, value, weight, state, time = row[go], value[go], weight[go], state[go], time[go]
    return kept.reshape(rows, m)


def elements(row: np.ndarray, value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The multisets as sets: the j-th occurrence of a shingle is an element of its own."""
    each = np.repeat(np.arange(len(row)), count)
    turn = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
    return row[each], np.where(turn == 0, value[each], mix(value[each] + turn.astype(np.uint64) * _STEP))


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(docs[key].cast("long").alias("doc_id"), F.xxhash64(t).alias("version"), F.lower(t).alias("text"))


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: its key, text version, node (a digest of the shingle multiset, or of a text without words), size, bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offsets in chunks(batch.column(2)):
                rows = high - low
                row, value, count = shingles(buf, offsets)
                size = np.bincount(row, count, rows).astype(np.int64)
                wordless = np.flatnonzero(size == 0)
                whole = spans_hash(buf, offsets[:-1][wordless], offsets[1:][wordless])
                node = np.zeros((rows, 2), "<u8")
                for half in range(2):
                    np.add.at(node[:, half], row, mix(value + np.uint64(half)) * count.astype(np.uint64))
                    node[wordless, half] = mix(whole + np.uint64(half))
                sig = prob_minhash(row, value, count, rows, BANDS * ROWS).reshape(rows, BANDS, ROWS)
                band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (rows, BANDS)).copy()
                for r in range(ROWS):
                    band = mix(band * np.uint64(31) + sig[:, :, r])
                has = size > 0
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32), pa.array(band[has].reshape(-1).view(np.int64)))
                nodes = pa.array([x.tobytes() for x in node], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, rows), batch.column(1).slice(low, rows), nodes, pa.array(size), lists], ["doc_id", "version", "node", "size", "bands"])

    small_batches(docs.sparkSession)
    return _plain(docs, key, text).mapInArrow(sign, SIGNED)


def _sets(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """(node, shingles): the sorted element hashes of the documents chosen(doc_id, version, node), one for each node."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, buf, offsets in chunks(batch.column(1)):
                row, value = elements(*shingles(buf, offsets))
                order = np.lexsort((value, row))
                value = value[order]
                cut = np.cumsum(np.bincount(row, minlength=high - low))[:-1]
                sets = pa.array([x.tobytes() for x in np.split(value, cut)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), sets], ["node", "shingles"])

    picked = chosen.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "node")
    met = _plain(docs, key, text).join(sized(picked), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")))
    return met.select("node", "text").mapInArrow(gather, "node binary, shingles binary").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links of pairs(a, b): those with a weighted Jaccard similarity of ``similarity`` or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similar, pa.bool_())], ["a", "b", "similar"])

    one, two = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(compare, "a binary, b binary, similar boolean").where("similar").select("a", "b")


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``sets`` shares with each of ``others``: exact counts, [sets, others]."""
    m, n = len(sets), len(others)
    one, two = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (sets, others))
    _, at = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    own, other = at[: len(one)], at[len(one) :]
    width = int(at.max()) + 1 if len(at) else 0
    times = np.bincount(own, minlength=width), np.bincount(other, minlength=width)
    shared = times[0] * times[1]
    out = np.zeros((m, n), np.float32)
    common = np.flatnonzero(shared > COMMON_PAIRS)
    column = np.full(width, -1)
    column[common] = np.arange(len(common))
    for low in range(0, len(common), 2048):
        blocks = []
        for row, value, rows in ((one, column[own], m), (two, column[other], n)):
            has = (value >= low) & (value < low + 2048)
            block = np.zeros((rows, 2048), np.float32)
            block[row[has], value[has] - low] = 1
            blocks.append(block)
        out += blocks[0] @ blocks[1].T
    rare = (shared > 0) & (shared <= COMMON_PAIRS)
    order = np.argsort(other, kind="stable")
    begin = np.cumsum(times[1]) - times[1]
    mine = np.flatnonzero(rare[own])
    reps = times[1][own[mine]]
    cuts = np.searchsorted(np.cumsum(reps), np.arange(4 << 20, int(reps.sum()) + 1, 4 << 20))
    for part in np.split(np.arange(len(mine)), cuts):
        k, e = reps[part], mine[part]
        if len(k):
            step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            met = two[order[np.repeat(begin[own[e]], k) + step]]
            out += np.bincount(np.repeat(one[e], k) * n + met, minlength=m * n).reshape(m, n).astype(np.float32)
    return out


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of so few of the True cells of ``links`` that rows and columns stay as connected as by all."""
    fresh = np.ones(links.shape[1], bool)
    open_rows = np.ones(links.shape[0], bool)
    rows, columns = [], []
    for start in range(links.shape[0]):
        stack = [start] if open_rows[start] else []
        open_rows[start] = False
        while stack:
            row = stack.pop()
            new = np.flatnonzero(links[row] & fresh)
            fresh[new] = False
            rows.extend([row] * len(new))
            columns.extend(new.tolist())
            for c in new.tolist():
                more = np.flatnonzero(links[:, c] & open_rows)
                open_rows[more] = False
                rows.extend(more.tolist())
                columns.extend([c] * len(more))
                stack.extend(more.tolist())
    return np.array(rows, np.int64), np.array(columns, np.int64)


def _block_links(rows: DataFrame, keys: list[str], sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among rows(keys..., node, root, own, every) of equal keys, of nodes ``own`` to nodes ``every`` with other
    roots: as many of them as connect all that links connect."""

    def compare(table: pa.Table) -> pa.Table:
        nodes = np.array(table.column("node").to_pylist(), object)
        held = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        root = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
        one, two = (np.flatnonzero(table.column(c).to_numpy()) for c in ("own", "every"))
        size = np.array([len(x) for x in held])
        both = overlaps([held[i] for i in one], [held[i] for i in two]).astype(float)
        linked = (both >= similarity * (size[one][:, None] + size[two][None, :] - both)) & (root[one][:, None] != root[two][None, :])
        a, b = forest(linked)
        a, b = nodes[one[a]], nodes[two[b]]
        return pa.table({"a": pa.array(list(np.minimum(a, b)), pa.binary()), "b": pa.array(list(np.maximum(a, b)), pa.binary())})

    return rows.join(sets, "node").select(*keys, "node", "root", "own", "every", "shingles").groupBy(*keys).applyInArrow(compare, "a binary, b binary")


def _blocks(n: str, shingles: str) -> Column:
    """How many blocks so many nodes with so many shingles take."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_NODES), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _across(large: DataFrame, links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between blocks, in buckets of several blocks: the nodes that aren't in a bucket's most frequent class are
    compared with all its nodes of other classes, block by block."""
    rows = large.where("blocks > 1").select("band", "node", "size", "blocks").join(sized(components(links)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(rows, "classed")
    by_root = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    live = by_root.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.max(F.struct("n", "s")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    live = live.select("band", "top", (F.col("n") - F.col("most.n")).alias("rest"), (F.col("s") - F.col("most.s")).alias("rest_s")).where("rest > 0")
    live = written(live.select("band", "top", _blocks("rest", "rest_s").alias("rest_blocks")), "live")
    rows = rows.join(live, "band")
    deal = lambda of, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(of)).cast("int")
    columns = ["band", "node", "root"]
    own = rows.where("root <> top").select(*columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), deal("rest_blocks", 1).alias("j"), F.lit(True).alias("own"), F.lit(False).alias("every"))
    every = rows.select(*columns, deal("blocks", 0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("j"), F.lit(False).alias("own"), F.lit(True).alias("every"))
    return _block_links(own.unionByName(every), ["band", "i", "j"], sets, similarity)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, version, class_id, class_version) for each row of docs: classes of near duplicates.

    Two texts are linked if the weighted Jaccard similarity of their 5-word shingles (lower case; as often as they
    occur) is ``similarity`` or more; classes are chains of links, named by their smallest (doc_id, version); version is
    a hash of the text. Texts under five words are one shingle; texts without words are classes of equal texts. Null
    texts are empty. Rows with a null key are told apart by version.

    Equal multisets are one node from the start. Nodes that share a band are a bucket; of buckets with the same nodes one is
    enough. All pairs of a bucket are compared: in small buckets as rows, each pair once for all buckets; in larger ones
    inside blocks of nodes, whose task gives only as many links as connect them. Buckets of several blocks then compare
    what isn't in their most frequent class with the rest, a block with a block.
    """
    spark = docs.sparkSession
    rows = written(signed(docs, key, text), "signed")
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "version")).alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")
    banded = nodes.select("node", "size", F.explode("bands").alias("band"))
    digests = [F.bit_xor(F.xxhash64("node", F.lit(n))).alias(f"x{n}") for n in range(2)]
    counted = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), *digests).where("n > 1")
    several = counted.groupBy("n", "x0", "x1").agg(F.min_by(F.struct("band", "shingles"), "band").alias("of"))
    buckets = written(banded.join(several.select("of.*", "n"), "band"), "buckets")
    chosen = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("least.*", "node")
    sets = written(_sets(docs, written(chosen, "chosen"), key, text), "sets")
    small = buckets.where(F.col("n") <= PAIRED)
    other = small.select("band", F.col("node").alias("b"), F.col("size").alias("other_size"))
    fits = F.least("size", "other_size") >= F.greatest("size", "other_size") * F.lit(similarity) - 1e-6  # else no link is possible
    pairs = small.join(other, "band").where((F.col("node") < F.col("b")) & fits).select(F.col("node").alias("a"), "b").distinct()
    small_batches(spark, PAIR_ROWS)  # each row holds two texts' shingles
    links = written(_verified(pairs, sets, similarity), "links")
    small_batches(spark)
    large = buckets.where(F.col("n") > PAIRED).withColumn("blocks", _blocks("n", "shingles")).withColumn("root", F.col("node"))
    block = F.pmod(F.xxhash64("node", F.lit(0)), F.col("blocks")).cast("int")
    inside = large.select("band", "node", "root", block.alias("i"), F.lit(True).alias("own"), F.lit(True).alias("every"))
    links = links.unionByName(written(_block_links(inside, ["band", "i"], sets, similarity), "links"))
    if large.where("blocks > 1").limit(1).count():
        links = links.unionByName(written(_across(large, links, sets, similarity), "links"))
    roots = written(components(links), "roots")
    classes = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = classes.groupBy("root").agg(F.min("least").alias("name"))
    names = classes.join(named, "root").select("node", F.col("name.doc_id").alias("class_id"), F.col("name.version").alias("class_version"))
    return rows.select("doc_id", "version", "node").join(names, "node").select("doc_id", "version", "class_id", "class_version")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class of near duplicates: that with the smallest (key, version). Columns are as before."""
    least = near_classes(docs, similarity, key, text).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("version") == F.col("class_version")))
    least = written(least.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n")), "kept")
    d, v = unused(docs, "doc"), unused(docs, "version")
    kept = least.select(F.col("doc_id").alias(d), F.col("version").alias(v))
    version = F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit("")))
    met = docs.join(kept, docs[key].cast("long").eqNullSafe(F.col(d)) & (version == F.col(v)))
    if least.where("n > 1").limit(1).count():  # rows that are there more than once
        met = met.dropDuplicates([d, v])
    return met.drop(d, v)


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with the class of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_classes(docs).select("doc_id", "class_id")
