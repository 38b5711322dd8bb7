"""Candidate hits: pairs, priorities, duplicates, agreement with annotations and structures."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ribolens.operators.intervals import overlap_join
from ribolens.operators.structures import compared_structures


def similar_length_pairs(hits: DataFrame, share: float = 0.3) -> DataFrame:
    """(key, h1, h2) for hits(key, hit_id, len) of one key whose lengths differ by less than ``share`` of the longer one.

    They meet in classes of lengths a factor 1 / (1 - share) apart: two such lengths are in one class or in neighbours.
    """
    factor = -log(1 - share)
    classed = hits.where("len > 0").withColumn("c", F.floor(F.log("len") / factor))
    other = classed.select("key", F.col("hit_id").alias("h2"), F.col("len").alias("len2"), F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"))
    met = classed.select("key", F.col("hit_id").alias("h1"), "len", "c").join(other, ["key", "c"]).where("h1 < h2")
    return met.where(F.abs(F.col("len") - F.col("len2")) < share * F.greatest("len", "len2")).select("key", "h1", "h2")


def similar_length_counts(hits: DataFrame, share: float = 0.3) -> DataFrame:
    """(key, pairs): how many pairs similar_length_pairs has of each key, counted from the number of hits of each length."""
    lengths = hits.where("len > 0").groupBy("key", "len").agg(F.count(F.lit(1)).alias("n"))
    named = lengths.select("key", "len", F.col("len").alias("hit_id"))
    met = similar_length_pairs(named, share)
    one, two = (lengths.select("key", F.col("len").alias(h), F.col("n").alias(f"n{h}")) for h in ("h1", "h2"))
    apart = met.join(one, ["key", "h1"]).join(two, ["key", "h2"]).select("key", (F.col("nh1") * F.col("nh2")).alias("pairs"))
    equal = lengths.where("n > 1").select("key", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    return apart.unionByName(equal).groupBy("key").agg(F.sum("pairs").alias("pairs"))


def without_lower_overlaps(hits: DataFrame) -> DataFrame:
    """hits that overlap no hit of their sequence with a higher score (of equal ones, with a smaller hit_id)."""
    right = hits.select("seq_id", *[F.col(c).alias(f"r_{c}") for c in ("hit_id", "start", "stop", "score")])
    met = overlap_join(hits, right, "seq_id")
    lower = met.where("r_score > score OR (r_score = score AND r_hit_id < hit_id)").select("hit_id").distinct()
    return hits.join(lower, "hit_id", "left_anti")


def covered_positions(hits: DataFrame, marks: DataFrame) -> DataFrame:
    """(hit_id, covered): positions of each hit that marks(seq_id, r_start, r_stop) cover; each position counts once."""
    met = overlap_join(hits, marks, "seq_id").select("hit_id", F.greatest("start", "r_start").alias("a"), F.least("stop", "r_stop").alias("b"))
    order = Window.partitionBy("hit_id").orderBy("a", "b")
    far = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("b") - F.greatest(F.col("a"), F.coalesce(far + 1, F.col("a"))) + 1, F.lit(0))
    counted = met.withColumn("n", fresh).groupBy("hit_id").agg(F.sum("n").alias("covered"))
    return hits.select("hit_id").join(counted, "hit_id", "left").select("hit_id", F.coalesce("covered", F.lit(0)).alias("covered"))


def group_members(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first, n): each row with the smallest key of its value and the size of that group."""
    groups = rows.groupBy(value).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    return rows.select(key, value).join(groups, value).select(key, "first", "n")


def pair_agreement(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    """(msa_id, both, only_one, only_two) of two lists of paired columns, by full outer join."""
    a, b = one.select(*key).distinct().withColumn("a", F.lit(1)), two.select(*key).distinct().withColumn("b", F.lit(1))
    met = a.join(b, key, "full_outer")
    count = lambda when: F.sum(F.when(when, 1).otherwise(0))
    ina, inb = F.col("a").isNotNull(), F.col("b").isNotNull()
    return met.groupBy(key[0]).agg(count(ina & inb).alias("both"), count(ina & ~inb).alias("only_one"), count(~ina & inb).alias("only_two"))


def structure_agreement(rows: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """pair_agreement of the pairs of two structures of each row; each row is by itself."""
    met = compared_structures(rows, key, one, two)
    return met.select(key, F.col("tp").alias("both"), (F.col("fp") + F.col("fm")).alias("only_one"), F.col("fn").alias("only_two"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    """n rows of rows, those with the smallest digests of key and seed: a random sample that repeats."""
    return rows.withColumn("__d", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))).orderBy("__d", key).limit(n).drop("__d")
