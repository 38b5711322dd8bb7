"""Queries on hits and annotations (J, W, F-22, F-25 blocks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ribolens.catalog import views as v
from ribolens.operators import clustering as cl
from ribolens.operators import intervals as iv
from ribolens.operators import ranking as rk
from ribolens.session import table

H, HA = f"WITH {v.HITS} ", f"WITH {v.HITS}, {v.ANNOTATION} "


def hits(fn):
    return lambda spark, sf_dir: fn(v.hits(spark, sf_dir))


def _overlaps(spark, sf_dir):
    met = iv.overlap_join(v.hits(spark, sf_dir), v.annotation(spark, sf_dir), "seq_id")
    return met.select("hit_id", "r_hit_id", "overlap")


def _best(spark, sf_dir):
    return iv.best_overlap(v.hits(spark, sf_dir), v.annotation(spark, sf_dir), "seq_id").select("hit_id", "r_hit_id", "overlap")


def _relations(spark, sf_dir):
    one = v.hits(spark, sf_dir).groupBy("seq_id").agg(F.min_by(F.struct("start", "stop"), "hit_id").alias("a"), F.max_by(F.struct("start", "stop"), "hit_id").alias("b"))
    kind = iv.relation(F.col("a.start"), F.col("a.stop"), F.col("b.start"), F.col("b.stop"))
    return one.select("seq_id", kind.alias("relation"))


def _groups(spark, sf_dir):
    rows = v.hits(spark, sf_dir)
    found = cl.single_linkage(rows.select(F.col("hit_id").alias("node")), iv.neighbour_graph(rows, 20))
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _annotated(spark, sf_dir):
    """Hits with the number of annotations of their sequence, none included."""
    per = v.annotation(spark, sf_dir).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    return v.hits(spark, sf_dir).join(per, "seq_id", "left").select("hit_id", F.coalesce("n", F.lit(0)).alias("n"))


def _averaged(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kinds = events.select("event_type").distinct().orderBy("event_type").limit(2)
    pair = [r[0] for r in kinds.collect()]  # two names
    sides = [events.where(F.col("event_type") == k).groupBy(F.col("user_id").alias("seq_id")).agg(F.sum("value").alias("weight")) for k in (pair * 2)[:2]]
    return rk.averaged(*sides, "seq_id").withColumn("weight", F.round("weight", 6))


def _ranks(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("key")).distinct()
    ranks = rk.numbered_in_order(part, "key").select("key", (F.col("nth") + 1).alias("rank"))
    scores = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return rk.rank_lookup(scores, ranks)


ENTRIES = {
    "J5_overlaps": (_overlaps, HA + "SELECT hit_id, r_hit_id, least(stop, r_stop) - greatest(start, r_start) AS overlap FROM hits JOIN anno USING (seq_id) WHERE start <= r_stop AND r_start <= stop"),
    "J6_annotation_counts": (_annotated, HA + "SELECT hit_id, coalesce(n, 0) AS n FROM hits LEFT JOIN (SELECT seq_id, count(*) AS n FROM anno GROUP BY seq_id) USING (seq_id)"),
    "J20_J10_best_overlap": (
        _best,
        HA + ", o AS (SELECT hit_id, r_hit_id, least(stop, r_stop) - greatest(start, r_start) AS overlap FROM hits JOIN anno USING (seq_id) WHERE start <= r_stop AND r_start <= stop) SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY overlap DESC, r_hit_id) = 1",
    ),
    "J2_outer_join": (
        _averaged,
        """WITH k AS (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2), a AS (SELECT user_id, sum(value) AS w FROM events WHERE event_type = (SELECT min(event_type) FROM k) GROUP BY 1),
b AS (SELECT user_id, sum(value) AS w FROM events WHERE event_type = (SELECT max(event_type) FROM k) GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS seq_id, round((coalesce(a.w, 0) + coalesce(b.w, 0)) / 2, 6) AS weight, a.w IS NOT NULL AS in_one, b.w IS NOT NULL AS in_two FROM a FULL JOIN b ON a.user_id = b.user_id""",
    ),
    "J4_relations": (
        _relations,
        H
        + """, r AS (SELECT seq_id, first(start ORDER BY hit_id) AS s1, first(stop ORDER BY hit_id) AS e1, first(start ORDER BY hit_id DESC) AS s2, first(stop ORDER BY hit_id DESC) AS e2 FROM hits GROUP BY seq_id)
SELECT seq_id, CASE WHEN (s1 >= s2 AND e1 <= e2) OR (s2 >= s1 AND e2 <= e1) THEN 'contained' WHEN least(e1, e2) - greatest(s1, s2) > 0.9::DOUBLE * least(e1 - s1, e2 - s2) THEN 'same'
WHEN s1 <= s2 AND least(e1, e2) - greatest(s1, s2) > -100 THEN 'before' WHEN s2 < s1 AND least(e1, e2) - greatest(s1, s2) > -100 THEN 'after' ELSE 'apart' END AS relation FROM r""",
    ),
    "J14_uncontained": (
        hits(lambda h: iv.uncontained(h).select("hit_id")),
        H + "SELECT hit_id FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE a.seq_id = b.seq_id AND a.hit_id <> b.hit_id AND b.start <= a.start AND b.stop >= a.stop AND (b.start < a.start OR b.stop > a.stop OR b.hit_id < a.hit_id))",
    ),
    "W6_merged": (
        hits(lambda h: iv.merged(h, 2)),
        H
        + """, m AS (SELECT *, max(stop) OVER (PARTITION BY seq_id ORDER BY start, stop, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM hits),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY start, stop, hit_id ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT seq_id, min(start) AS start, max(stop) AS stop, count(*) AS n FROM g GROUP BY seq_id, grp""",
    ),
    "W7_O5_top_hits": (hits(lambda h: iv.top_hits(h).select("seq_id", "hit_id", "rank")), H + "SELECT seq_id, hit_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, hit_id) AS INTEGER) AS rank FROM hits QUALIFY rank <= 10"),
    "W8_distinct_shifts": (
        hits(lambda h: iv.distinct_shifts(h).select("hit_id")),
        H
        + """, r AS (SELECT *, stop - start + 1 AS len, score / (stop - start + 1) AS d FROM hits)
SELECT hit_id FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.seq_id = b.seq_id AND (b.d < a.d OR (b.d = a.d AND b.hit_id < a.hit_id)) AND greatest(abs(a.start - b.start), abs(a.stop - b.stop)) <= 10
AND greatest(abs(a.start - b.start), abs(a.stop - b.stop)) <= 0.15::DOUBLE * least(a.len, b.len))""",
    ),
    "F22_score_range": (hits(lambda h: h.where(F.col("score").between(10.0, 60.0)).select("hit_id")), H + "SELECT hit_id FROM hits WHERE score BETWEEN 10 AND 60"),
    "F25_good_ratio": (hits(lambda h: iv.good_ratio(h).select("hit_id")), H + "SELECT hit_id FROM hits QUALIFY NOT (score < max(score) OVER (PARTITION BY seq_id) / 2 AND score < 10)"),
    "J26_neighbour_groups": (
        _groups,
        H
        + """, m AS (SELECT *, max(stop) OVER (PARTITION BY seq_id ORDER BY start, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM hits),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY start, hit_id ROWS UNBOUNDED PRECEDING) AS grp FROM m)
SELECT min(hit_id) AS cluster, count(*) AS n FROM g GROUP BY seq_id, grp""",
    ),
    "J25_rank_lookup": (
        _ranks,
        """WITH k AS (SELECT key, row_number() OVER (ORDER BY key) AS rank FROM (SELECT DISTINCT p_retailprice AS key FROM part)),
f AS (SELECT s_suppkey AS id, s_acctbal AS score, min(key) AS key FROM supplier LEFT JOIN k ON key >= s_acctbal GROUP BY 1, 2)
SELECT id, score, CASE WHEN f.key IS NULL THEN (SELECT max(rank) FROM k) WHEN f.key = score THEN rank ELSE rank + 1 END AS rank FROM f LEFT JOIN k USING (key)""",
    ),
    "A21_zoop_weights": (
        hits(lambda h: rk.zoop_weight(h.withColumn("score", F.col("score") / 10), 500, 0.3).select("hit_id", F.round("weight", 6).alias("weight"))),
        H + "SELECT hit_id, round(pow(2, score / 10) * (0.3::DOUBLE / 500) / (1 - 0.3::DOUBLE + (0.3::DOUBLE / 500) * sum(pow(2, score / 10)) OVER (PARTITION BY seq_id)), 6) AS weight FROM hits",
    ),
    "A22_tcm_weights": (
        hits(lambda h: h.select("hit_id", F.round(rk.tcm_weight(F.col("score") / 4), 6).alias("weight"))),
        H + "SELECT hit_id, round(CASE WHEN score / 4 >= log2(1e7) THEN 1 ELSE pow(2, score / 4) * 1e-5 / (1 - 1e-5 + pow(2, score / 4) * 1e-5) END, 6) AS weight FROM hits",
    ),
    "A27_histogram": (hits(lambda h: rk.histogram(h, "score", 0.0, 2.5)), H + "SELECT CAST(ceil((score - 0.0::DOUBLE) / 2.5::DOUBLE - 1) AS BIGINT) AS bin, count(*) AS n FROM hits WHERE score IS NOT NULL GROUP BY 1"),
    "A28_exponential_fit": (
        hits(lambda h: rk.exponential_fit(h, "seq_id", "score").select("seq_id", F.round("mu", 6).alias("mu"), F.round("lambda", 6).alias("lambda"))),
        H + "SELECT seq_id, round(min(score), 6) AS mu, round(CASE WHEN avg(score) > min(score) THEN 1 / (avg(score) - min(score)) END, 6) AS lambda FROM hits GROUP BY seq_id",
    ),
    "A29_moments": (
        hits(lambda h: rk.moments(h, "seq_id", "score").select("seq_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "n")),
        H + "SELECT seq_id, round(avg(score), 6) AS mean, round(var_samp(score), 6) AS variance, count(*) AS n FROM hits GROUP BY seq_id",
    ),
    "A29_regression": (
        hits(lambda h: rk.regression(h, "seq_id", "start", "score").select("seq_id", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")),
        H + "SELECT seq_id, round(regr_slope(score, start), 6) AS slope, round(regr_intercept(score, start), 6) AS intercept, count(*) AS n FROM hits GROUP BY seq_id",
    ),
    "UD20_local_evalue": (
        hits(lambda h: h.select("hit_id", F.round(F.log10(rk.local_evalue(F.col("score"), F.col("start") + 100, F.col("stop") + 200)), 6).alias("log_evalue"))),
        H
        + """, n AS (SELECT hit_id, score, start + 100 AS n0, stop + 200 AS n1, (ln(start + 100) + ln(stop + 200)) / 0.36::DOUBLE AS sh FROM hits),
p AS (SELECT *, 0.177::DOUBLE * greatest(n0 - sh, 1) * greatest(n1 - sh, 1) * exp(-0.192::DOUBLE * score) AS p FROM n)
SELECT hit_id, round(log10(greatest(CASE WHEN p > 0.01 THEN 1 - exp(-p) ELSE p END, 1e-100) * floor(2000000 / (n0 + n1))), 6) AS log_evalue FROM p""",
    ),
    "O2_hit_order": (hits(lambda h: h.orderBy(F.desc("score"), "hit_id").limit(200).select("hit_id", "score")), H + "SELECT hit_id, score FROM hits ORDER BY score DESC, hit_id LIMIT 200"),
}
