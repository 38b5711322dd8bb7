"""Nearest neighbours by largest inner product: a vantage-point tree for each shard, searched by blocks of queries."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ribolens.llm.shared import sized, written

#: Bytes of vectors in a shard and in a block of queries, and rows of a leaf.
SHARD_BYTES, BLOCK_BYTES, LEAF_ROWS = 4 << 20, 1 << 20, 128
#: The angle that parts a query from a side of a node is taken times this factor: 1 is exact, more skips more.
RELAX = 1.0
#: Pairs of queries and points after which they are measured exactly and only the best kept.
PAIRS_AT_ONCE = 1 << 20
#: Rounding of angles near zero.
_ANGLE = 1e-7


def norms(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms, without overflow of the squares."""
    most = np.abs(vectors).max(axis=1, initial=0.0)
    return most * np.sqrt(((vectors / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))


def directions(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, initial=0.0)[:, None]
    return scaled / np.sqrt((scaled**2).sum(axis=1))[:, None]


def angles(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(one @ other, -1.0, 1.0))


def inner_products(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last, so that equal vectors have equal products."""
    total = np.zeros(len(one))
    for j in range(one.shape[1]):
        total += one[:, j] * other[:, j]
    return total


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>, dim) of the vectors with an id that are not null, empty or zero and wholly finite."""
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


@dataclass
class VantageTree:
    """Different vectors of a shard in a tree over their directions; the angle is the metric. A side of a node knows the
    range of its angles to the vantage direction and of its norms, which bound its inner products with a query.
    members holds all ids, by vector and id."""

    points: np.ndarray  # in leaf order
    first: np.ndarray  # members of point i are members[first[i] : first[i + 1]]
    members: np.ndarray
    vantage: list = field(default_factory=list)  # per node: the vantage direction, or None in leaves
    bounds: list = field(default_factory=list)  # per node: for each side, least and largest angle and norm
    sides: list = field(default_factory=list)  # per node: its two children, or the rows of a leaf

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS) -> VantageTree:
        different, group = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, group.reshape(-1)))
        count = np.bincount(group.reshape(-1), minlength=len(different))
        size, unit = norms(different), directions(different)
        tree, perm, chance = cls(different, np.zeros(0), ids[order]), [], np.random.default_rng(7)
        total = 0

        def grow(rows: np.ndarray) -> int:
            nonlocal total
            node = len(tree.vantage)
            for x in (tree.vantage, tree.bounds, tree.sides):
                x.append(None)
            if len(rows) <= leaf:
                tree.sides[node] = (total, total + len(rows))
                perm.append(rows)
                total += len(rows)
                return node
            centre = unit[rows[chance.integers(len(rows))]]
            far = angles(unit[rows], centre)
            by = np.argsort(far, kind="stable")
            halves = by[: len(rows) // 2], by[len(rows) // 2 :]
            tree.vantage[node] = centre
            tree.bounds[node] = [(far[h].min(), far[h].max(), size[rows[h]].min(), size[rows[h]].max()) for h in halves]
            tree.sides[node] = tuple(grow(rows[h]) for h in halves)
            return node

        grow(np.arange(len(different)))
        perm = np.concatenate(perm)
        begin = np.cumsum(count) - count
        tree.points = different[perm]
        tree.first = np.concatenate([[0], np.cumsum(count[perm])])
        tree.members = np.concatenate([tree.members[begin[p] : begin[p] + count[p]] for p in perm])
        return tree

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, relax: float = RELAX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, inner product) of each query's k best, the query's own id left out; exact if relax is 1.

        ``floor`` is what k candidates of a query reach for certain; whatever may reach it, rounding and ties included, is
        a candidate. Candidates are measured exactly and ranked by product and id.
        """
        unit, size, own = directions(queries), norms(queries), norms(self.points)
        rounding = (queries.shape[1] + 4) * 2.0**-51
        floor = np.full(len(queries), -np.inf)
        best = np.full((len(queries), k + 1), -np.inf)  # the query itself may be one of them
        open_pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        waiting = 0

        def settle() -> None:
            nonlocal open_pairs, kept, waiting
            query, point, most = (np.concatenate(x) for x in zip(*open_pairs, strict=True))
            can = ~(most < floor[query])
            query, point = query[can], point[can]
            score = np.concatenate([np.zeros(0), *(inner_products(queries[query[at : at + 65536]], self.points[point[at : at + 65536]]) for at in range(0, len(query), 65536))])
            times = np.minimum(np.diff(self.first)[point], k + 1)
            each = np.repeat(np.arange(len(point)), times)
            member = self.members[self.first[point][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
            query, score = query[each], score[each]
            other = member != ids[query]
            query, member, score = (np.concatenate([x, y[other]]) for x, y in zip(kept, (query, member, score), strict=True))
            order = np.lexsort((member, -np.nan_to_num(score, nan=np.inf, posinf=np.inf, neginf=-np.inf), query))
            query, member, score = query[order], member[order], score[order]
            place = np.arange(len(query)) - np.searchsorted(query, np.arange(len(queries)))[query]
            last = place == k - 1
            floor[query[last]] = np.fmax(floor[query[last]], score[last])
            kept, open_pairs, waiting = tuple(x[place < k] for x in (query, member, score)), [], 0

        def visit(node: int, active: np.ndarray) -> None:
            nonlocal waiting
            if not len(active):
                return
            if self.vantage[node] is None:
                low, high = self.sides[node]
                about, slack = queries[active] @ self.points[low:high].T, rounding * size[active][:, None] * own[None, low:high]
                row, point = np.nonzero(~(about + slack < floor[active][:, None]))
                open_pairs.append((active[row], point + low, (about + slack)[row, point]))
                waiting += len(row)
                sure = np.concatenate([best[active], np.nan_to_num(about - slack, nan=-np.inf, posinf=np.inf, neginf=-np.inf)], axis=1)
                best[active] = -np.partition(-sure, k, axis=1)[:, : k + 1]
                floor[active] = np.maximum(floor[active], best[active].min(axis=1))
                if waiting > PAIRS_AT_ONCE:
                    settle()
                return
            far = angles(unit[active], self.vantage[node])
            reach = []
            for least, most, short, long in self.bounds[node]:
                gap = np.clip(np.maximum(far - most, least - far) * relax - _ANGLE, 0, np.pi)
                reach.append(size[active] * np.where(gap <= np.pi / 2, long, short) * np.cos(gap))
            first = far <= (self.bounds[node][0][1] + self.bounds[node][1][0]) / 2
            slack = rounding * size[active] * max(b[3] for b in self.bounds[node])
            for near, side in ((True, 0), (False, 1), (True, 1), (False, 0)):
                visit(self.sides[node][side], active[(first == near) & ~(reach[side] + slack < floor[active])])

        with np.errstate(all="ignore"):  # products may overflow
            visit(0, np.arange(len(queries)))
            settle()
        return kept

    def pack(self) -> bytes:
        out = io.BytesIO()
        inside = [v is not None for v in self.vantage]
        centres = np.array([v for v in self.vantage if v is not None]).reshape(-1, self.points.shape[1])
        np.savez(out, points=self.points, first=self.first, members=self.members, inside=inside, centres=centres, bounds=np.array([b or [(0, 0, 0, 0)] * 2 for b in self.bounds], float), sides=np.array(self.sides))
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> VantageTree:
        z = np.load(io.BytesIO(data))
        centres = iter(z["centres"])
        return cls(z["points"], z["first"], z["members"], [next(centres) if x else None for x in z["inside"]], z["bounds"].tolist(), [tuple(s) for s in z["sides"].tolist()])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>, dim) of the vectors with an id that are not null, empty or zero and wholly finite; of rows
    with one id and dimension, that with the least vector."""
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(fine & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    return rows.groupBy("vec_id", "dim").agg(F.min("v").alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float) + 0.0  # no negative zeros


def _dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """rows with the number of groups of about ``size`` bytes for their dimension, and the group, by hash of the id."""
    counts = written(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), "dimensions")
    groups = counts.select("dim", F.ceil(F.col("n") * F.col("dim") * 8 / size).cast("int").alias(f"{name}s"))
    return rows.join(sized(groups), "dim").withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col(f"{name}s")).cast("int"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, relax: float = RELAX, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of vectors with the largest inner product, the query's
    own id left out; ties go to the smaller vec_id. Fewer candidates give fewer rows.

    Vectors that are null, empty, zero or hold null or non-finite components, or that have no id, take no part. Only
    vectors of a query's dimension are its candidates. Of rows with one id, that with the least vector counts. A
    product that is no number (infinities of either sign) ranks first. Shards are hashes of the ids, so their sizes are
    even whatever the data; each query block meets each shard once, as the stated queries are held against all rows.
    """
    rows = written(usable(vectors, key, vector), "vectors")
    asked = usable(queries, key, vector)

    def index(group: pd.DataFrame) -> pd.DataFrame:
        tree = VantageTree.build(group["vec_id"].to_numpy(), _matrix(group["v"]))
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "shard": group["shard"].iloc[:1], "shards": group["shards"].iloc[:1], "tree": [tree.pack()]})

    def block(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": group["dim"].iloc[:1], "block": group["block"].iloc[:1], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "asked": [_matrix(group["v"]).tobytes()]})

    trees = written(_dealt(rows, SHARD_BYTES, "shard").groupBy("dim", "shard").applyInPandas(index, "dim int, shard int, shards int, tree binary"), "trees")
    packed = _dealt(asked, BLOCK_BYTES, "block").groupBy("dim", "block").applyInPandas(block, "dim int, block int, ids binary, asked binary")
    places = trees.groupBy("dim").agg(F.max("shards").alias("shards"))
    spread = packed.join(sized(places), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    met = spread.join(trees.drop("shards"), ["dim", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                tree, dim = VantageTree.unpack(batch.column(3)[n].as_py()), batch.column(0)[n].as_py()
                ids = np.frombuffer(batch.column(1)[n].as_py(), np.int64)
                query, member, score = tree.search(ids, np.frombuffer(batch.column(2)[n].as_py(), float).reshape(-1, dim), k, relax)
                yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(member), pa.array(score)], ["query_id", "vec_id", "score"])

    near = met.select("dim", "ids", "asked", "tree").mapInArrow(search, "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    """Every embedding whose vec_id is divisible by 20, against all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


OP5_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
