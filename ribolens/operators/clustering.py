"""Connected components and single-linkage clusters, by alternating stars: each round is one aggregate and one join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribolens.operators.alignment import RESIDUES, masks
from ribolens.session import written

#: Rows of an alignment that are compared in one task; larger alignments are dealt into blocks of about so many.
CLUSTER_ROWS = 8000


def _stars(rows: DataFrame) -> bool:
    """Whether no upper end of rows(u, v) is a lower end too, and each lower end has one upper end."""
    several = rows.groupBy("u").agg(F.min("v").alias("l"), F.max("v").alias("h")).where("l <> h").select("u")
    chained = rows.select(F.col("v").alias("u")).distinct().join(rows.select("u").distinct(), "u", "left_semi")
    return not several.unionAll(chained).limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node of its component.

    Alternating large and small stars need about log2(n) rounds whatever the components' shape, with as many rows as
    there are edges; a node with very many neighbours is only grouped by partial aggregates and joined.
    """
    rows = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(rows):
        both = rows.select("u", "v").unionAll(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rows = written(down.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    nodes = rows.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(rows.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def single_linkage(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, cluster) of nodes(node) under links(a, b): cluster is the smallest node that links lead to."""
    return nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("cluster"))


def flooded(bits: np.ndarray, label: np.ndarray, at_least: float) -> np.ndarray:
    """The least row of each row's single-linkage cluster, of bits[n, 4] (a row's columns by residue); label[n]: rows known to be
    one cluster. What a cluster has reached leaves the rest, which is all that its further rows are compared with."""
    n, size = len(bits), np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    root, left = np.full(n, -1), np.arange(n)
    while len(left):
        first = left[0]
        front, step = left[label[left] == label[first]], 1
        root[front] = first
        left = left[root[left] < 0]
        while len(front) and len(left):
            now, front = front[:step], front[step:]
            step = min(step * 4, max(1, 2_000_000 // len(left)))
            matches = sum(np.bitwise_count(bits[now, None, k] & bits[None, left, k]).astype(np.int64) for k in range(4))
            least = np.minimum(size[now, None], size[None, left])
            met = left[((least > 0) & (matches / np.maximum(least, 1) >= at_least)).any(axis=0)]
            if len(met):
                met = left[np.isin(label[left], label[met])]
                root[met] = first
                left = left[root[left] < 0]
                front = np.concatenate([front, met])
    return root


def identity_clusters(rows: DataFrame, width: int, at_least: float) -> DataFrame:
    """(msa_id, node, cluster) of rows(msa_id, node, aseq): single-linkage clusters of each alignment's rows at an identity (matches
    over the residues of the row that has fewer), named by their smallest node.

    Each block of CLUSTER_ROWS rows is clustered by itself; then each two blocks of an alignment meet, with the clusters that
    they have, and give a link for each cluster that others reach. No pairs of rows are made.
    """
    names = [f"m_{s}" for s in RESIDUES]
    counts = rows.groupBy("msa_id").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_ROWS).cast("int").alias("blocks"))
    dealt = rows.select("msa_id", "node", *masks(width)[:4]).join(counts, "msa_id").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        bits = group[names].to_numpy(np.int64).view(np.uint64)
        some = np.flatnonzero(bits.any(axis=1))  # rows without residues match nothing
        root = np.arange(len(group))
        root[some] = some[flooded(bits[some], np.arange(len(some)), at_least)]
        return group.assign(root=group["node"].to_numpy()[root])

    held = ", ".join(f"{c} long" for c in names)
    local = dealt.groupBy("msa_id", "block").applyInPandas(run, f"msa_id string, node string, {held}, blocks int, block int, root string")
    local = written(local.select("msa_id", "node", *names, "blocks", "block", "root"), "clusters")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        label = group["root"].factorize()[0]
        top = flooded(group[names].to_numpy(np.int64).view(np.uint64), label, at_least)
        found = pd.DataFrame({"a": group["root"], "b": group["root"].to_numpy()[top]})
        return found[found["a"] != found["b"]].drop_duplicates()

    several = local.where("blocks > 1").where(" OR ".join(f"{c} <> 0" for c in names))
    others = F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("block"))
    met = several.withColumn("other", F.explode(others)).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})
    links = met.select("msa_id", "p", "q", "node", "root", *names).groupBy("msa_id", "p", "q").applyInPandas(link, "a string, b string")
    if several.isEmpty():
        return local.select("msa_id", "node", F.col("root").alias("cluster"))
    joined = components(links).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    return local.join(joined, "root", "left").select("msa_id", "node", F.coalesce("cluster", "root").alias("cluster"))
