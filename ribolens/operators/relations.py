"""Relations of motifs, anchors and candidates: joins on sequences and intervals, weights, and repeatable resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ribolens.operators.intervals import overlap_join
from ribolens.operators.ranking import numbered_in_order

#: Instances of two motifs up to so far apart are near; so many positions of an instance may lie outside of an equal one.
NEAR, LOOSE, SAME_SHARE = 100, 25, 0.9


def motif_relations(one: DataFrame, two: DataFrame, names: list[str]) -> DataFrame:
    """One row for each two motifs of one(f1, seq_id, start, end, score, weight) and two(f2, ...) that share sequences, where
    they keep an order: left_first, num_seq, gap, overlap, weight.

    Instances in a sequence count as the same motif if one lies inside the other, or if they overlap in more than
    SAME_SHARE of either and leave under LOOSE positions of either; else as neighbours if they overlap or lie under NEAR
    apart. Motifs that are the same more often than neighbours in either order, and those in which the order of the larger
    score has under ``2`` of weight, have no row.
    """
    side = lambda t, n: t.select(names[n - 1], "seq_id", *[F.col(c).alias(f"{c}{n}") for c in ("start", "end", "score", "weight")])
    met = side(one, 1).join(side(two, 2), "seq_id")
    c = F.col
    first = c("start1") <= c("start2")  # the first motif begins first
    inside = F.when(first, c("end1") >= c("end2")).otherwise(c("end1") < c("end2"))
    overlap = F.when(first, c("end1") - c("start2")).otherwise(c("end2") - c("start1"))
    len1, len2 = c("end1") - c("start1"), c("end2") - c("start2")
    same = ((len1 - overlap < LOOSE) | (len2 - overlap < LOOSE)) & ((overlap > SAME_SHARE * len1) | (overlap > SAME_SHARE * len2))
    product = c("weight1") * c("weight2")
    marked = met.select(*names, first.alias("first"), overlap.alias("o"), product.alias("w"), ((c("weight1") + c("weight2")) / 2).alias("n"), (c("score1") * c("weight1") + c("score2") * c("weight2")).alias("s"), F.when(inside, "same").when(overlap <= -NEAR, "far").when(same, "same").otherwise("near").alias("kind"))
    total = lambda value, when: F.sum(F.when(when, value).otherwise(0.0))
    near = c("kind") == "near"
    aggs = [total(c("w"), c("kind") == "same").alias("same")]
    for n, order in ((1, c("first")), (2, ~c("first"))):
        aggs += [total(c("n"), near & order).alias(f"n{n}"), total(c("s"), near & order).alias(f"s{n}"), total(c("o") * c("w"), near & order & (c("o") > 0)).alias(f"o{n}"), total(-c("o") * c("w"), near & order & (c("o") <= 0)).alias(f"g{n}")]
    sums = marked.groupBy(*names).agg(*aggs).where("NOT (same > n1 AND same > n2)")
    left = c("s1") > c("s2")
    pick = lambda x: F.when(left, c(f"{x}1")).otherwise(c(f"{x}2"))
    held = sums.select(*names, left.alias("left_first"), pick("n").alias("num_seq"), pick("s").alias("s"), pick("o").alias("o"), pick("g").alias("g")).where("num_seq >= 2")
    return held.select(*names, "left_first", "num_seq", (c("g") / c("num_seq")).alias("gap"), (c("o") / c("num_seq")).alias("overlap"), (c("s") - c("g") / 2 - c("o")).alias("weight"))


def without_overlaps_by_place(hits: DataFrame) -> DataFrame:
    """hits without those that lie inside another one of their sequence and strand, or overlap one that begins later and ends
    later. Of equal intervals the smallest hit_id stays. hits(hit_id, seq_id, strand, start, stop), start <= stop."""
    keyed = hits.withColumn("__key", F.struct("seq_id", "strand"))
    other = keyed.select("__key", *[F.col(c).alias(f"r_{c}") for c in ("hit_id", "start", "stop")])
    met = overlap_join(keyed.select("__key", "hit_id", "start", "stop"), other, "__key").where("hit_id <> r_hit_id")
    equal = (F.col("start") == F.col("r_start")) & (F.col("stop") == F.col("r_stop"))
    inside = (F.col("start") >= F.col("r_start")) & (F.col("stop") <= F.col("r_stop"))
    behind = (F.col("r_start") > F.col("start")) & (F.col("r_stop") > F.col("stop"))
    gone = met.where(F.when(equal, F.col("r_hit_id") < F.col("hit_id")).otherwise(inside | behind)).select("hit_id").distinct()
    return hits.join(gone, "hit_id", "left_anti")


def consistent(pairs: DataFrame, anchors: DataFrame, key: str, shift: int = 50) -> DataFrame:
    """pairs(key, start1, stop1, start2, stop2, ...) of places in two sequences that no anchor of their key speaks against:
    by lying before one place and behind the other or beside only one of them, or, where both overlap, by being shifted by
    more than ``shift``. anchors has the same columns."""
    named = anchors.select(key, *[F.col(c).alias(f"a_{c}") for c in ("start1", "stop1", "start2", "stop2")])
    met = pairs.join(named, key)
    c = F.col
    before = [c(f"stop{n}") < c(f"a_start{n}") for n in (1, 2)]
    after = [c(f"start{n}") > c(f"a_stop{n}") for n in (1, 2)]
    fine = (before[0] & before[1]) | (after[0] & after[1])
    crossed = ((c("stop2") > c("a_stop2")) & before[0]) | ((c("stop1") > c("a_stop1")) & before[1]) | ((c("start1") < c("a_start1")) & after[1]) | ((c("start2") < c("a_start2")) & after[0])
    drift = lambda end, f: F.abs(f(end + "1", "a_" + end + "1") - f(end + "2", "a_" + end + "2") - (c(f"a_{end}1") - c(f"a_{end}2")))
    far = (drift("start", F.greatest) > shift) | (drift("stop", F.least) > shift)
    return pairs.join(met.where(~fine & (crossed | far)).select(*pairs.columns).distinct(), pairs.columns, "left_anti")


def local_optima(cells: DataFrame, key: str, reach: int = 3) -> DataFrame:
    """cells(key, i, j, energy), one row for each (key, i, j), with no lower energy up to ``reach`` outside of (i, j), and none as low
    inside (under ``reach`` away), of intervals around or within it."""
    width = reach + 1
    near = cells.withColumn("bin", F.floor(F.col("i") / width))
    other = cells.select(key, F.col("i").alias("k"), F.col("j").alias("l"), F.col("energy").alias("e")).withColumn("bin", F.explode(F.array(*[F.floor(F.col("k") / width) + d for d in (-1, 0, 1)])))
    met = near.join(other, [key, "bin"]).where("NOT (k = i AND l = j)")
    outside = F.col("k").between(F.col("i") - reach, F.col("i")) & F.col("l").between(F.col("j"), F.col("j") + reach) & (F.col("e") < F.col("energy"))
    inside = (F.col("k") >= F.col("i")) & (F.col("k") < F.col("i") + reach) & (F.col("l") <= F.col("j")) & (F.col("l") > F.col("j") - reach) & (F.col("k") < F.col("l")) & (F.col("e") <= F.col("energy"))
    return cells.join(met.where(outside | inside).select(key, "i", "j").distinct(), [key, "i", "j"], "left_anti")


def evalue_weights(hits: DataFrame, mu: float, rate: float, database: int, least: float = 3.0) -> DataFrame:
    """hits with weight: e to the minus database size times the extreme-value tail of the score; a group's weights are raised in
    proportion to ``least`` in all, each to 1 at most. hits(seq_id, score, ...)."""
    tail = 1 - F.exp(-F.exp(-rate * (F.col("score") - mu)))
    raw = hits.withColumn("weight", F.exp(-database * tail))
    total = F.sum("weight").over(Window.partitionBy("seq_id"))
    return raw.withColumn("weight", F.when((total < least) & (total > 0), F.least(F.col("weight") * least / total, F.lit(1.0))).otherwise(F.col("weight")))


def order_key(key: Column, place: Column, seed: str) -> Column:
    """A digest that orders places at random, always alike."""
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), place.cast("string")))


def shuffled_text(key: Column, text: Column, seed: str, size: int = 1) -> Column:
    """text with its words of ``size`` characters (the last may be shorter) in an order that key and seed decide."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int") - 1)
    drawn = F.transform(starts, lambda n: F.struct(order_key(key, n, seed).alias("d"), F.substr(text, n * size + 1, F.lit(size)).alias("w")))
    return F.array_join(F.transform(F.array_sort(drawn), lambda x: x["w"]), "")


def drawn_columns(rows: DataFrame, width: int, seed: str, replace: bool) -> DataFrame:
    """rows(msa_id, seq_id, aseq) with columns drawn with replacement (a bootstrap) or in another order; an alignment's rows
    all by the same columns, which its msa_id and the seed decide."""
    places = F.sequence(F.lit(1), F.lit(width))
    if replace:
        chosen = F.transform(places, lambda n: (F.conv(F.substring(order_key(F.col("msa_id"), n, seed), 1, 8), 16, 10).cast("long") % width + 1).cast("int"))
    else:
        chosen = F.transform(F.array_sort(F.transform(places, lambda n: F.struct(order_key(F.col("msa_id"), n, seed).alias("d"), n.alias("n")))), lambda x: x["n"])
    return rows.select("msa_id", "seq_id", F.array_join(F.transform(chosen, lambda n: F.substr("aseq", n, F.lit(1))), "").alias("aseq"))


def concatenated(one: DataFrame, two: DataFrame, width1: int, width2: int) -> DataFrame:
    """(seq_id, aseq) of two alignments side by side; a sequence that one lacks has gaps there."""
    met = one.select("seq_id", F.col("aseq").alias("a")).join(two.select("seq_id", F.col("aseq").alias("b")), "seq_id", "full_outer")
    return met.select("seq_id", F.concat(F.coalesce("a", F.lit("-" * width1)), F.coalesce("b", F.lit("-" * width2))).alias("aseq"))


def numbered_union(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(key, number): the ids of one with their own numbers, and those of two that one lacks, numbered on from the largest of
    one, in order."""
    old = one.select(key).distinct().withColumn("number", F.col(key))
    fresh = numbered_in_order(two.select(key).distinct().join(old.select(key), key, "left_anti"), key)
    top = one.agg(F.coalesce(F.max(key), F.lit(0)).alias("top"))
    return old.unionByName(fresh.join(F.broadcast(top)).select(key, (F.col("top") + F.col("nth") + 1).cast("long").alias("number")))
