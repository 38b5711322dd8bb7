"""Merkle manifests of tables: aligned subtrees in van Emde Boas layout, built and read in blocks, recursing over block roots.

Nodes are 32 bytes; H is SHA-256 of the children's hexadecimal digests. A tree of n leaves joins every two neighbours, and an
odd last one stands alone for its own H, until one is left. Leaves at places [b * 2**HEIGHT, (b + 1) * 2**HEIGHT) are block b;
the blocks' roots are the leaves of the next level, and so on. A block's nodes lie in one array of 2**(height + 1) - 1 places in
van Emde Boas order, the root first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ribolens.llm.shared import small_batches, sized, written

#: Levels of a block above its leaves.
HEIGHT = 10
#: Rows that one range of the order holds, about; MOST_RANGES bounds what the driver knows of the order.
RANGE_ROWS, MOST_RANGES = 8192, 20_000
PATH = "array<struct<left: string, right: string>>"


@cache
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """Places of all nodes by depth (0 is the root), in van Emde Boas order: a tree of k levels is its top half of k // 2
    levels, then the bottom subtrees from left to right, each laid out so itself.

    A node's place is that of its bottom subtree's root's parent tree, past that top tree and past the bottom subtrees
    before its own: arithmetic on its number and three constants of its depth.
    """
    top, bottom, above = np.zeros((3, height + 1), np.int64)

    def split(depth: int, levels: int) -> None:
        if levels < 2:
            return
        upper = levels // 2
        cut = depth + upper
        top[cut], bottom[cut], above[cut] = (1 << upper) - 1, (1 << (levels - upper)) - 1, depth
        split(depth, upper)
        split(cut, levels - upper)

    split(0, height + 1)
    places = [np.zeros(1, np.int64)]
    for d in range(1, height + 1):
        number = (1 << d) + np.arange(1 << d)  # from 1 for the root on, level by level
        places.append(places[above[d]][np.arange(1 << d) >> (d - above[d])] + top[d] + (number & top[d]) * bottom[d])
    return tuple(places)


def grown(leaves: list[str], height: int) -> np.ndarray:
    """The block of these hexadecimal leaves, lifted through all levels; places without a node are zeros."""
    store, at = np.zeros(((1 << (height + 1)) - 1, 32), np.uint8), addresses(height)
    level = leaves
    for depth in range(height, -1, -1):
        store[at[depth][: len(level)]] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        level = [sha256("".join(level[k : k + 2]).encode()).hexdigest() for k in range(0, len(level), 2)]
    return store


def sibling_places(count: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf of a block and each level from the leaves on: the place of the sibling on its left and on its right,
    or -1."""
    at, leaf = addresses(height), np.arange(count)
    left, right = np.full((2, count, height), -1, np.int64)
    for up in range(height):
        node, there = leaf >> up, -(-count // (1 << up))
        level = at[height - up]
        odd, even = node & 1 == 1, (node & 1 == 0) & (node + 1 < there)
        left[odd, up] = level[node[odd] - 1]
        right[even, up] = level[node[even] + 1]
    return left, right


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hexadecimal digest and its path (left and right sibling of each level, or nulls) give."""
    none = F.lit("")
    return F.aggregate(path, leaf, lambda known, p: F.sha2(F.concat(F.coalesce(p["left"], none), known, F.coalesce(p["right"], none)), 256))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path in a row, from the leaf's level on."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda p: F.array(p["left"], p["right"]))), ""), 256)


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves(key, ...) with place: 0, 1, ... within each key by ``order`` (nulls first). Rows equal in it take any turn.

    Rows are dealt by ranges of (key, order), so neither a key nor equal rows of it fill one task: the last sort key is
    random. Ranges are numbered in turn, and a key's places in a range begin after those in the ranges before.
    """
    rows = written(leaves, "leaves")
    ranges = max(1, min(MOST_RANGES, -(-rows.count() // RANGE_ROWS)))
    by = ["key", *order, "__spread"]
    spread = rows.withColumn("__spread", F.rand(7)).repartitionByRange(ranges, *by).withColumn("__range", F.spark_partition_id())
    dealt = written(spread, "ranges")  # each row's range is settled here, once
    sizes = dealt.groupBy("key", "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("key", "__range", F.coalesce(before, F.lit(0)).alias("__before"))
    turn = F.row_number().over(Window.partitionBy("key", "__range").orderBy(*order, "__spread"))
    return dealt.withColumn("__turn", turn).join(sized(starts), ["key", "__range"]).withColumn("place", F.col("__before") + F.col("__turn") - 1).drop("__range", "__spread", "__before", "__turn")


def grow_blocks(leaves: DataFrame, count: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(key, block, height, n, total, items, store, root) of leaves(key, place, leaf, ...) and their counts(key, total).

    items are a block's rows in order (place first), of 2**height at most; store holds its nodes. A key's only block is as
    high as its leaves need, other blocks are lifted through all levels, lone last nodes too.
    """
    held = leaves.groupBy("key", F.shiftright("place", height).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", *[c for c in leaves.columns if c not in ("key", "place")]))).alias("items"))
    needed = F.when(F.col("total") > 1 << height, height).otherwise(F.ceil(F.log2("total") - 1e-9).cast("int"))
    blocks = held.join(sized(count), "key").select("key", "block", needed.alias("height"), F.size("items").alias("n"), "total", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            leaf, at = items.flatten().field("leaf").to_pylist(), np.concatenate([[0], np.cumsum(items.value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            stores = [grown(leaf[x:y], h) for x, y, h in zip(at, at[1:], batch.column("height").to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.tobytes() for s in stores], pa.binary()), pa.array([s[0].tobytes().hex() for s in stores])], [*batch.schema.names, "store", "root"])

    small_batches(leaves.sparkSession, 16)
    return blocks.mapInArrow(run, T.StructType([*blocks.schema.fields, T.StructField("store", T.BinaryType()), T.StructField("root", T.StringType())]))


def read_paths(blocks: DataFrame) -> DataFrame:
    """(key, item, path) of blocks(key, height, n, items, store, path): each item's siblings in its block by address, then
    the path of the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, paths, keys = batch.column("items"), batch.column("path"), batch.column("key")
            for k, (store, height) in enumerate(zip(batch.column("store").to_pylist(), batch.column("height").to_pylist(), strict=True)):
                own, above = items[k].values, paths[k].values
                n, hexed = len(own), store.hex()
                left, right = sibling_places(n, height)
                nodes = [hexed[x : x + 64] for x in range(0, len(hexed), 64)]
                base, up = len(nodes), len(above)
                pool = pa.array([*nodes, *above.field("left").to_pylist(), *above.field("right").to_pylist(), None], pa.string())
                tail = np.broadcast_to(np.arange(up), (n, up))
                pick = [pool.take(pa.array(np.concatenate([np.where(x < 0, base + 2 * up, x), tail + base + more], axis=1).ravel())) for x, more in ((left, 0), (right, up))]
                path = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (height + up), pa.int32()), pa.StructArray.from_arrays(pick, ["left", "right"]))
                yield pa.RecordBatch.from_arrays([pa.array([keys[k].as_py()] * n, pa.string()), own, path], ["key", "item", "path"])

    small_batches(blocks.sparkSession, 16)
    kinds = blocks.schema
    return blocks.select("key", "height", "n", "items", "store", "path").mapInArrow(run, T.StructType([kinds["key"], T.StructField("item", kinds["items"].dataType.elementType), kinds["path"]]))


class Manifest:
    """The trees of a table's parts, one for each key, under one root: written levels of blocks.

    levels[0] holds the leaves' blocks, levels[k + 1] the blocks over the roots of levels[k]; top the one tree over the
    subroots, by key (UTF-8 bytewise; a null key first).
    """

    def __init__(self, leaves: DataFrame, order: list[str], height: int = HEIGHT):
        """leaves(key string, leaf, ...): digests in hexadecimal form and what goes with them, by ``order`` within a key."""
        named = leaves.withColumn("key", F.coalesce(F.concat(F.lit("="), "key"), F.lit("-")))  # no nulls in joins; - is before =
        self.height, self.levels = height, []
        rows = numbered(named, order)
        self.subroots = self._grow(rows, self.levels)
        top = numbered(self.subroots.select(F.lit("").alias("key"), F.col("key").alias("part"), F.col("root").alias("leaf")), ["part"])
        self.top: list[DataFrame] = []
        self.root = self._grow(top, self.top)  # (key '', root): one row, or none without leaves

    def _grow(self, rows: DataFrame, levels: list[DataFrame]) -> DataFrame:
        """Writes levels of blocks until each key has one; gives (key, root)."""
        ended = None
        while True:
            count = rows.groupBy("key").agg(F.count(F.lit(1)).alias("total"))
            blocks = written(grow_blocks(rows, written(count, "counts"), self.height), "blocks")
            levels.append(blocks)
            last = blocks.where(F.col("total") <= 1 << self.height).select("key", "root")
            ended = last if ended is None else ended.unionByName(last)
            rows = blocks.where(F.col("total") > 1 << self.height).select("key", F.col("block").alias("place"), F.col("root").alias("leaf"))
            if rows.isEmpty():
                return ended

    def _read(self, levels: list[DataFrame], paths: DataFrame) -> DataFrame:
        """(key, item, path) of all leaves, from paths(key, path) of the roots: level by level from the highest down."""
        known = None
        for k in range(len(levels) - 1, -1, -1):
            ends = levels[k].where(F.col("total") <= 1 << self.height).select("key", "block")
            above = ends.join(sized(paths), "key").select("key", "block", "path")
            if known is not None:
                above = above.unionByName(known.select("key", F.col("item.place").alias("block"), "path"))
            known = read_paths(levels[k].join(sized(written(above, "paths"), 20_000), ["key", "block"]))
        return known

    def proofs(self) -> DataFrame:
        """(key, item, path, subroot, root): for each leaf the siblings of each level up to the root."""
        nothing = F.array().cast(PATH)
        over = self._read(self.top, self.root.select("key", nothing.alias("path"))).select(F.col("item.part").alias("key"), "path")
        leaves = self._read(self.levels, written(over, "top-paths"))
        root = self.root.first()
        ends = self.subroots.select("key", F.col("root").alias("subroot"), F.lit(root["root"] if root else None).cast("string").alias("root"))
        return leaves.join(sized(ends), "key")


def record_digest(*values: Column) -> Column:
    """H of values in a row: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """All documents by lang, their proofs, and what folding finds where n_chars has been tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("n_chars").cast("long"), "source", "lang", "text")
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    other = F.when(struck, record_digest(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields]))
    leaves = rows.select(F.col("lang").cast("string").alias("key"), record_digest(*[F.col(c) for c in fields]).alias("leaf"), "doc_id", other.alias("tampered"))
    proofs = Manifest(leaves, ["doc_id", "leaf"]).proofs()
    fold = folded(F.coalesce("item.tampered", "item.leaf"), F.col("path"))
    seen = proofs.select(F.col("item.doc_id").alias("doc_id"), F.col("item.leaf").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold.alias("folded_root"))
    return seen.withColumn("verified", F.col("folded_root") == F.col("root"))


_VALUE = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(crc[xor(c % 256, x) + 1], c // 256)), 4294967295)"
_SIDE = "CASE WHEN (p.place >> v.level) % 2 = 1 THEN 'L' || t.h ELSE coalesce('R' || t.h, '-') END"
OP11_SQL = f"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
d AS (SELECT doc_id, coalesce('=' || lang, '-') AS key, {_LEAF.format("n_chars")} AS leaf, CASE WHEN coalesce({_CRC} % 7 = 0, FALSE) THEN {_LEAF.format("(n_chars + 1)")} END AS other FROM documents, steps),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM d),
t(key, level, place, h, n) AS (SELECT key, 0, place, leaf, n FROM p UNION ALL SELECT key, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY key, level, place // 2),
l AS (SELECT key, h AS subroot, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, place, h, n) AS (SELECT 0, place, subroot, n FROM l UNION ALL SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY level, place // 2),
s AS (SELECT p.key, p.place, v.level, {_SIDE} AS e FROM p JOIN (SELECT DISTINCT key, level FROM t WHERE n > 1) v ON p.key = v.key LEFT JOIN t ON t.key = v.key AND t.level = v.level AND t.place = xor(p.place >> v.level, 1)
  UNION ALL SELECT o.key, o.place, 1000 + v.level, {_SIDE} FROM p o JOIN l p ON o.key = p.key JOIN (SELECT DISTINCT level FROM u WHERE n > 1) v ON TRUE LEFT JOIN u t ON t.level = v.level AND t.place = xor(p.place >> v.level, 1)),
w AS (SELECT key, place, list(e ORDER BY level) AS es FROM s GROUP BY key, place),
f AS (SELECT p.doc_id, p.leaf, l.subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(es, []), lambda e: CASE WHEN e = '-' THEN '' ELSE e[2:] END), '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(other, leaf), coalesce(es, [])), lambda a, e: sha256(CASE e[1] WHEN 'L' THEN e[2:] || a WHEN 'R' THEN a || e[2:] ELSE a END)) AS folded_root
  FROM p JOIN l ON p.key = l.key LEFT JOIN w ON w.key = p.key AND w.place = p.place)
SELECT *, folded_root = root AS verified FROM f
"""
