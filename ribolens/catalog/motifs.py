"""Queries on motif tables: pairs, ranks, sets (J-1, J-3, A-17, A-18, W-10, W-11, O-7, S block)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ribolens.operators import ranking as rk
from ribolens.operators.selection import greedy_selection
from ribolens.session import table, written

#: Motifs: orders of a customer are motifs of a family, with statistics from their lines.
MOTIFS = """motifs AS (SELECT o_orderkey AS motif, o_custkey AS family, CAST(count(*) AS DOUBLE) AS num, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS species,
  sum(l_quantity) / 10 AS conserved, sum(l_quantity) AS pairs, 0.5::DOUBLE + avg(l_discount) * 4 AS identity, avg(l_quantity) AS len
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""
M = f"WITH {MOTIFS} "


#: Lines that a task aggregates at a time; their number decides the number of partitions, so a task's memory doesn't grow.
TASK_LINES = 100_000


def _partitions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").count() // TASK_LINES + 1


def motifs(spark, sf_dir):
    """Lines are dealt out by order once, and summed by supplier, then by order, where they lie; orders meet the sums."""
    n, total, some = _partitions(spark, sf_dir), lambda c: F.sum(c).alias(c), F.col("q")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("motif"), "l_suppkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d")).repartition(n, "motif")
    each = line.groupBy("motif", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), total("q"), total("d"), F.count("q").alias("nq"), F.count("d").alias("nd"))
    sums = each.groupBy("motif").agg(F.count("l_suppkey").cast("double").alias("species"), *[total(c) for c in ("n", "q", "d", "nq", "nd")])
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("motif"), F.col("o_custkey").alias("family")).repartition(n, "motif")
    joined = orders.groupBy("motif", "family").agg(F.count(F.lit(1)).alias("same")).join(sums, "motif")  # an order given twice has its lines twice
    of = lambda c: F.nullif(F.col(c), F.lit(0))
    return joined.select(
        "motif", "family", (F.col("n") * F.col("same")).cast("double").alias("num"), "species", (some * F.col("same") / 10).alias("conserved"), (some * F.col("same")).alias("pairs"),
        (0.5 + F.col("d") / of("nd") * 4).alias("identity"), (some / of("nq")).alias("len"),
    )


def _indexed(spark, sf_dir, *more):
    c = F.col
    rows = motifs(spark, sf_dir)
    rank = rk.rank_index(c("conserved"), c("pairs"), c("identity"), c("len"), c("species"), c("num"))
    composite = rk.composite_index(c("conserved"), c("pairs"), c("identity"), c("species"), c("num"))
    return rows.select("motif", "family", F.round(rank, 6).alias("rank_index"), F.round(composite, 6).alias("composite_index"), *more)


_INDEX = """SELECT motif, family, round(sqrt(greatest((conserved + 0.2::DOUBLE) * (pairs / identity - 0.1::DOUBLE * len), 0)) * (species - 2) * (1 + ln(num / species)), 6) AS rank_index,
  round(sqrt((conserved + 0.2::DOUBLE) * pairs / identity) * species * (1 + ln(num / species)), 6) AS composite_index FROM motifs"""


def _family_rank(spark, sf_dir):
    by = Window.partitionBy("family").orderBy(F.desc("rank_index"), "motif")
    return _indexed(spark, sf_dir).select("family", "motif", F.row_number().over(by).alias("rank"))


def _pairs(spark, sf_dir):
    """Pairs of motifs of a family that share a supplier: they meet on it, not as all pairs."""
    n, line, orders = _partitions(spark, sf_dir), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    line, orders = line.select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey"), orders.select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    parts = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("family"), F.col("l_orderkey").alias("m1"), "l_suppkey")
    parts = parts.repartition(n, "family", "l_suppkey").distinct()
    met = parts.join(parts.withColumnRenamed("m1", "m2"), ["family", "l_suppkey"]).where("m1 < m2")
    return met.groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("shared"))


def _selected(spark, sf_dir):
    """At most five motifs of each family by rank index, of weight 2.5 (here: lines) and a rank of 1 at least. One is redundant
    beside a better one that has half of its sequences, or a sixth if that ranks twice as high."""
    rows = written(_indexed(spark, sf_dir, "species", "num").where("num >= 2.5 AND rank_index >= 1"), "ranked")
    own = rows.select("motif", "species", "rank_index")
    ends = _pairs(spark, sf_dir).select("shared", F.inline(F.array(F.struct(F.col("m1").alias("worse"), F.col("m2").alias("better")), F.struct(F.col("m2").alias("worse"), F.col("m1").alias("better")))))
    met = ends.join(own.withColumnsRenamed({"motif": "worse", "species": "s", "rank_index": "r"}), "worse").join(own.select(F.col("motif").alias("better"), F.col("rank_index").alias("rb")), "better")
    redundant = met.where((F.col("shared") >= 0.5 * F.col("s")) | ((F.col("shared") * 6 >= F.col("s")) & (F.col("r") < 0.5 * F.col("rb"))))
    items = rows.select(F.col("family").alias("group"), F.col("motif").alias("item"), (-F.col("rank_index")).alias("order"))
    return greedy_selection(items, redundant.select("worse", "better"), 5).select(F.col("group").alias("family"), F.col("item").alias("motif"), F.abs("order").alias("rank_index"))


_SELECTED = f"""WITH RECURSIVE {MOTIFS}, x AS ({_INDEX}), rows AS (SELECT m.motif, m.family, m.species, x.rank_index FROM motifs m JOIN x USING (motif) WHERE num >= 2.5 AND rank_index >= 1),
l AS (SELECT DISTINCT o_custkey AS family, l_orderkey AS motif, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT a.motif AS worse, b.motif AS better, count(*) AS shared FROM l a JOIN l b ON a.family = b.family AND a.l_suppkey = b.l_suppkey AND a.motif <> b.motif GROUP BY ALL),
c AS (SELECT worse, list(better) AS betters FROM s JOIN rows w ON w.motif = worse JOIN rows b ON b.motif = better WHERE shared >= 0.5 * w.species OR (shared * 6 >= w.species AND w.rank_index < 0.5 * b.rank_index) GROUP BY worse),
n AS (SELECT family, motif, rank_index, coalesce(betters, []) AS betters, row_number() OVER (PARTITION BY family ORDER BY rank_index DESC, motif) AS r FROM rows LEFT JOIN c ON worse = motif),
g(family, r, chosen) AS (SELECT DISTINCT family, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM n UNION ALL
  SELECT g.family, n.r, CASE WHEN len(chosen) < 5 AND NOT list_has_any(betters, chosen) THEN list_append(chosen, motif) ELSE chosen END FROM g JOIN n ON n.family = g.family AND n.r = g.r + 1),
z AS (SELECT family, unnest(arg_max(chosen, r)) AS motif FROM g GROUP BY family)
SELECT family, motif, rank_index FROM z JOIN n USING (family, motif)"""


def _sides(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ids = F.col("user_id").alias("id")
    return events.where(F.col("event_type") == "click").select(ids).distinct(), events.where(F.col("value") > 180).select(ids).distinct()


_A, _B = "SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'click'", "SELECT DISTINCT user_id AS id FROM events WHERE value > 180"


def _union_ids(spark, sf_dir):
    """The union of two id lists."""
    one, two = _sides(spark, sf_dir)
    return one.unionByName(two).distinct().select("id")


ENTRIES = {
    "W10_selected_motifs": (_selected, _SELECTED),
    "A17_A18_indexes": (_indexed, M + _INDEX),
    "W11_family_rank": (_family_rank, M + f", x AS ({_INDEX}) SELECT family, motif, CAST(row_number() OVER (PARTITION BY family ORDER BY rank_index DESC, motif) AS INTEGER) AS rank FROM x"),
    "F30_rank_filters": (
        lambda spark, sf_dir: motifs(spark, sf_dir).where(~((F.col("identity") > 0.75) & (F.col("num") <= 4)) & (F.col("num") >= 2.5)).select("motif", "num"),
        M + "SELECT motif, num FROM motifs WHERE NOT (identity > 0.75 AND num <= 4) AND num >= 2.5",
    ),
    "O7_top_ranked": (lambda spark, sf_dir: _indexed(spark, sf_dir).orderBy(F.desc("rank_index"), "motif").limit(50).select("motif", "rank_index"), M + f", x AS ({_INDEX}) SELECT motif, rank_index FROM x ORDER BY rank_index DESC, motif LIMIT 50"),
    "J1_J3_motif_pairs": (
        _pairs,
        "WITH p AS (SELECT DISTINCT o_custkey AS family, l_orderkey AS m, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT a.m AS m1, b.m AS m2, count(*) AS shared FROM p a JOIN p b ON a.family = b.family AND a.l_suppkey = b.l_suppkey AND a.m < b.m GROUP BY 1, 2",
    ),
    "S1_union": (_union_ids, f"{_A} UNION {_B}"),
    "S2_difference": (lambda spark, sf_dir: (lambda a, b: a.exceptAll(b))(*_sides(spark, sf_dir)), f"{_A} EXCEPT {_B}"),
    "S7_intersection": (lambda spark, sf_dir: (lambda a, b: a.intersect(b))(*_sides(spark, sf_dir)), f"{_A} INTERSECT {_B}"),
    "S4_subset": (lambda spark, sf_dir: (lambda a, b: table(spark, sf_dir, "events").join(b, F.col("user_id") == F.col("id"), "left_semi").select("event_id"))(*_sides(spark, sf_dir)), f"SELECT event_id FROM events WHERE user_id IN ({_B})"),
}
