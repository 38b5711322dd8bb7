"""Greedy selection by rank as rounds over a table of conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ribolens.session import written


def greedy_selection(items: DataFrame, conflicts: DataFrame, most: int | None = None) -> DataFrame:
    """The items(group, item, order) that going through each group by ``order``, then item, would select: those that no selected
    one before them makes redundant, by conflicts(worse, better); of each group the first ``most``.

    In rounds: what no live better rival meets is selected, and what it makes redundant goes. A group takes as many rounds as
    its longest chain of rivals, and no group is gathered. Later selections never change earlier ones, so the limit
    applies at the end. Conflicts against the order, of one item with itself or between groups don't count.
    """
    ends = items.select("group", F.col("item"), "order")
    worse, better = (ends.select(F.col("group").alias(f"g_{s}"), F.col("item").alias(s), F.col("order").alias(f"o_{s}")) for s in ("worse", "better"))
    known = conflicts.select("worse", "better").distinct().join(worse, "worse").join(better, "better").where("g_worse = g_better")
    edges = written(known.where((F.col("o_better") < F.col("o_worse")) | ((F.col("o_better") == F.col("o_worse")) & (F.col("better") < F.col("worse")))).select("worse", "better"), "conflicts")
    live, kept = written(ends, "live-items"), None
    while True:
        blocked = edges.select(F.col("worse").alias("item")).distinct()
        free = live.join(blocked, "item", "left_anti")
        kept = free if kept is None else kept.unionByName(free)
        if edges.isEmpty():
            break
        gone = edges.join(free.select(F.col("item").alias("better")), "better", "left_semi").select(F.col("worse").alias("item")).distinct()
        live = written(live.join(blocked, "item", "left_semi").join(gone, "item", "left_anti"), "live-items")
        both = edges.join(live.select(F.col("item").alias("worse")), "worse", "left_semi").join(live.select(F.col("item").alias("better")), "better", "left_semi")
        edges = written(both, "conflicts")
    if most is not None:
        kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy("group").orderBy("order", "item"))).where(F.col("__n") <= most).drop("__n")
    return kept
