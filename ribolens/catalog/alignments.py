"""Queries on alignments (A block, F-7, F-29, J-18, J-19, W-4, W-5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ribolens.catalog import views as v
from ribolens.operators import alignment as al
from ribolens.operators import clustering as cl
from ribolens.plans.summary import summary

C, P, R = f"WITH {v.CELLS} ", f"WITH {v.PAIRS} ", f"WITH {v.ROWS} "


def cells(fn):
    return lambda spark, sf_dir: fn(v.alignment_cells(spark, sf_dir))


def paired(fn):
    return lambda spark, sf_dir: fn(al.pair_cells(v.alignment_rows(spark, sf_dir), v.STRUCTURE))


def rows(fn):
    return lambda spark, sf_dir: fn(v.alignment_rows(spark, sf_dir))


def _identity(aligned):
    return al.pairwise_identity(aligned, v.WIDTH)


def _mean_identity(aligned):
    return al.weighted_identity(aligned, v.WIDTH)


def _jc(aligned):
    return al.jukes_cantor(_identity(aligned))


def _pb(aligned):
    return al.position_based_weights(aligned, v.WIDTH)


def _node(msa, seq):
    return F.concat_ws("#", msa, F.lpad(F.col(seq).cast("string"), 12, "0"))


def clusters(aligned, at_least=0.5):
    """Single-linkage clusters of each alignment's sequences at an identity, and weights 1 / size scaled to mean 1."""
    return cl.identity_clusters(aligned.select("msa_id", _node("msa_id", "seq_id").alias("node"), "aseq"), v.WIDTH, at_least).select("node", "cluster")


def _cluster_query(aligned):
    return clusters(aligned).select("node", "cluster")


def _blosum(aligned):
    from pyspark.sql import Window

    placed = clusters(aligned).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("cluster"))).withColumn("msa_id", F.split("node", "#")[0])
    by = Window.partitionBy("msa_id")
    return placed.select("node", (1 / F.col("size") * F.count(F.lit(1)).over(by) / F.sum(1 / F.col("size")).over(by)).alias("blosum_weight"))


def _kept_columns(aligned):
    """Alignments without the columns that are gaps in over 60 % of their sequences."""
    gaps = al.cells(aligned).groupBy("msa_id", "col").agg(F.avg(F.when(F.col("sym").isin(*al.RESIDUES), 0.0).otherwise(1.0)).alias("g")).where("g <= 0.6")
    kept = gaps.groupBy("msa_id").agg(F.sort_array(F.collect_list("col")).alias("cols"))  # WIDTH columns at most
    return aligned.join(kept, "msa_id").select("msa_id", "seq_id", F.array_join(F.transform("cols", lambda n: F.substr("aseq", n, F.lit(1))), "").alias("aseq"))


_ID = f""", ident AS (SELECT a.msa_id, a.seq_id AS s1, b.seq_id AS s2, a.aseq AS x, b.aseq AS y,
  length(translate(a.aseq, '-', '')) AS len1, length(translate(b.aseq, '-', '')) AS len2,
  len(list_filter(range(1, {v.WIDTH + 1}), lambda n: substr(a.aseq, n, 1) = substr(b.aseq, n, 1) AND substr(a.aseq, n, 1) <> '-')) AS matches,
  len(list_filter(range(1, {v.WIDTH + 1}), lambda n: substr(a.aseq, n, 1) <> '-' AND substr(b.aseq, n, 1) <> '-')) AS shared
  FROM aln a JOIN aln b ON a.msa_id = b.msa_id AND a.seq_id < b.seq_id),
ids AS (SELECT *, CASE WHEN least(len1, len2) > 0 THEN matches / least(len1, len2) ELSE 0 END AS identity FROM ident) """
_FREQ = """, freq AS (SELECT c.msa_id, c.col, s.sym, (sum(CASE WHEN c.sym = s.sym THEN weight ELSE 0 END) + sum(CASE WHEN NOT res THEN weight ELSE 0 END) * 0.25) / sum(weight) AS f
  FROM cells c, (VALUES ('A'), ('C'), ('G'), ('U')) s(sym) GROUP BY ALL) """
_CLUSTERS = """, node AS (SELECT msa_id, seq_id, msa_id || '#' || lpad(CAST(seq_id AS VARCHAR), 12, '0') AS node FROM aln),
link AS (SELECT msa_id || '#' || lpad(CAST(s1 AS VARCHAR), 12, '0') AS a, msa_id || '#' || lpad(CAST(s2 AS VARCHAR), 12, '0') AS b FROM ids WHERE identity >= 0.5),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT node AS a, node AS b FROM node UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
clus AS (SELECT a AS node, min(b) AS cluster FROM reach GROUP BY a) """
_CONS = """, prof AS (SELECT msa_id, col, sum(weight) AS w, sum(CASE WHEN NOT res THEN weight ELSE 0 END) AS g, greatest(sum(CASE WHEN sym = 'A' THEN weight ELSE 0 END),
  sum(CASE WHEN sym = 'C' THEN weight ELSE 0 END), sum(CASE WHEN sym = 'G' THEN weight ELSE 0 END), sum(CASE WHEN sym = 'U' THEN weight ELSE 0 END)) AS top FROM cells GROUP BY msa_id, col),
used AS (SELECT *, top > 0.7::DOUBLE * w AND top >= 3 AS good, row_number() OVER (PARTITION BY msa_id ORDER BY col) AS nth FROM prof WHERE g <= 0.6::DOUBLE * w),
isl AS (SELECT msa_id, nth - row_number() OVER (PARTITION BY msa_id ORDER BY col) AS island FROM used WHERE good),
runs AS (SELECT msa_id, island, count(*) AS n FROM isl GROUP BY ALL HAVING count(*) >= 4),
cons AS (SELECT m.msa_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS conserved FROM (SELECT DISTINCT msa_id FROM aln) m LEFT JOIN runs USING (msa_id) GROUP BY m.msa_id) """
_WID = f""", wpair AS (SELECT a.msa_id, a.weight * b.weight AS w, len(list_filter(range(1, {v.WIDTH + 1}), lambda n: substr(a.aseq, n, 1) <> '-' OR substr(b.aseq, n, 1) <> '-')) AS cols,
  len(list_filter(range(1, {v.WIDTH + 1}), lambda n: substr(a.aseq, n, 1) <> '-' AND substr(a.aseq, n, 1) = substr(b.aseq, n, 1))) AS same FROM aln a JOIN aln b ON a.msa_id = b.msa_id AND a.seq_id < b.seq_id),
wid AS (SELECT msa_id, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE s / p END AS mean_identity FROM (SELECT msa_id, count(*) AS n FROM aln GROUP BY msa_id)
  LEFT JOIN (SELECT msa_id, sum(w * same / cols) AS s, sum(w) AS p FROM wpair WHERE cols >= 10 GROUP BY msa_id) USING (msa_id)) """
_TOTALS = """SELECT msa_id, count(*) AS num, sum(weight) AS total_weight,
  sum(weight * length(replace(aseq, '-', ''))) / sum(weight) AS mean_len,
  sum(weight * (length(aseq) - length(translate(aseq, 'GC', ''))) / nullif(length(replace(aseq, '-', '')), 0)) / nullif(sum(weight) FILTER (length(replace(aseq, '-', '')) > 0), 0) AS mean_gc FROM aln GROUP BY msa_id"""
_KINDS = """SELECT msa_id, i, j, sum(CASE WHEN lr AND rr AND canon THEN weight ELSE 0 END) AS canonical,
  sum(CASE WHEN lr AND rr AND NOT canon THEN weight ELSE 0 END) AS noncanonical, sum(CASE WHEN lr <> rr THEN weight ELSE 0 END) AS one_gap,
  sum(CASE WHEN NOT lr AND NOT rr THEN weight ELSE 0 END) AS two_gaps FROM paired GROUP BY msa_id, i, j"""
_MI = """, sp AS (SELECT p.msa_id, p.i, p.j, x.s AS l, y.s AS r, p.weight * CASE WHEN p.lr THEN CAST(p."left" = x.s AS INTEGER) ELSE 0.25::DOUBLE END * CASE WHEN p.rr THEN CAST(p."right" = y.s AS INTEGER) ELSE 0.25::DOUBLE END AS w
  FROM paired p, (VALUES ('A'), ('C'), ('G'), ('U')) x(s), (VALUES ('A'), ('C'), ('G'), ('U')) y(s)),
joint AS (SELECT msa_id, i, j, l, r, sum(w) AS w FROM sp GROUP BY ALL),
share AS (SELECT *, sum(w) OVER (PARTITION BY msa_id, i, j) AS t, sum(w) OVER (PARTITION BY msa_id, i, j, l) AS wl, sum(w) OVER (PARTITION BY msa_id, i, j, r) AS wr FROM joint),
mi AS (SELECT msa_id, i, j, sum(CASE WHEN w > 0 THEN w / t * log2(w * t / (wl * wr)) ELSE 0 END) AS mi FROM share GROUP BY msa_id, i, j) """
_PB = """, k AS (SELECT msa_id, col, sym, count(*) AS n FROM cells WHERE res GROUP BY ALL), kk AS (SELECT *, count(*) OVER (PARTITION BY msa_id, col) AS k FROM k),
raw AS (SELECT c.msa_id, c.seq_id, coalesce(sum(1 / (kk.k * kk.n)) / nullif(count(kk.n), 0), 0) AS raw FROM cells c LEFT JOIN kk ON c.msa_id = kk.msa_id AND c.col = kk.col AND c.sym = kk.sym GROUP BY c.msa_id, c.seq_id)
SELECT msa_id, seq_id, CASE WHEN sum(raw) OVER (PARTITION BY msa_id) > 0 THEN raw * count(*) OVER (PARTITION BY msa_id) / sum(raw) OVER (PARTITION BY msa_id) ELSE 1 END AS pb_weight FROM raw"""

ENTRIES = {
    "A1_A2_A4_totals": (rows(al.totals), R + _TOTALS),
    "A5_relative_entropy": (cells(al.relative_entropy), C + _FREQ + "SELECT msa_id, sum(CASE WHEN f > 0 THEN f * log2(f / 0.25) ELSE 0 END) AS entropy FROM freq GROUP BY msa_id"),
    "A5_column_frequencies": (cells(al.column_frequencies), C + _FREQ + "SELECT msa_id, col, sym, f AS f FROM freq"),
    "A6_mutual_information": (paired(al.mutual_information), P + _MI + "SELECT msa_id, i, j, mi AS mi FROM mi"),
    "A34_pair_categories": (paired(al.pair_categories), P + _KINDS),
    "A15_W5_conserved": (cells(al.conserved_positions), C + _CONS + "SELECT msa_id, conserved FROM cons"),
    "A25_position_based_weights": (rows(_pb), C + _PB),
    "A25_blosum_weights": (
        rows(_blosum),
        f"WITH RECURSIVE {v.ROWS}{_ID}{_CLUSTERS}, sized AS (SELECT c.node, n.msa_id, 1 / count(*) OVER (PARTITION BY cluster) AS w FROM clus c JOIN node n USING (node)) SELECT node, w * count(*) OVER (PARTITION BY msa_id) / sum(w) OVER (PARTITION BY msa_id) AS blosum_weight FROM sized",
    ),
    "IT4_identity_clusters": (rows(_cluster_query), f"WITH RECURSIVE {v.ROWS}{_ID}{_CLUSTERS} SELECT node, cluster FROM clus"),
    "A30_pairwise_identity": (rows(_identity), R + _ID + "SELECT msa_id, s1, s2, CAST(matches AS INTEGER) AS matches, CAST(len1 AS INTEGER) AS len1, CAST(len2 AS INTEGER) AS len2, CAST(shared AS INTEGER) AS shared, CAST(identity AS DOUBLE) AS identity FROM ids"),
    "A13_mean_identity": (rows(_mean_identity), R + _WID + "SELECT msa_id, mean_identity FROM wid"),
    "A30_jukes_cantor": (
        rows(_jc),
        R
        + _ID
        + f""", bothn AS (SELECT msa_id, s1, s2, matches, len(list_filter(range(1, {v.WIDTH + 1}), lambda n: substr(x, n, 1) <> '-' AND substr(y, n, 1) <> '-')) AS b FROM ids),
d AS (SELECT msa_id, s1, s2, 1 - (b - matches) / b * (4.0::DOUBLE / 3) AS x FROM bothn WHERE b > 0) SELECT msa_id, s1, s2, CASE WHEN x > 0 THEN -ln(x) * 0.75 END AS distance FROM d""",
    ),
    "A36_consensus": (
        cells(al.consensus_columns),
        C
        + """, per AS (SELECT msa_id, col, sym, any_value(res) AS res, sum(weight) AS w FROM cells GROUP BY msa_id, col, sym),
best AS (SELECT msa_id, col, sum(w) AS t, coalesce(sum(w) FILTER (NOT res), 0) AS g, first(sym ORDER BY w DESC, sym) FILTER (res) AS best FROM per GROUP BY msa_id, col)
SELECT msa_id, col, CASE WHEN g <= 0.6::DOUBLE * t AND best IS NOT NULL THEN best ELSE '.' END AS rf FROM best""",
    ),
    "F7_W4_align_map": (cells(al.align_map), C + "SELECT msa_id, seq_id, col, CAST(pos AS BIGINT) AS pos FROM (SELECT *, sum(CAST(res AS INTEGER)) OVER (PARTITION BY msa_id, seq_id ORDER BY col) AS pos FROM cells) WHERE res"),
    "F29_fragment_bounds": (cells(al.fragment_bounds), C + "SELECT msa_id, seq_id, min(col) FILTER (res) AS first_col, max(col) FILTER (res) AS last_col FROM cells GROUP BY ALL"),
    "F31_gappy_columns_dropped": (
        rows(_kept_columns),
        C + ", kept AS (SELECT msa_id, col FROM cells GROUP BY ALL HAVING avg(CASE WHEN res THEN 0 ELSE 1 END) <= 0.6) SELECT msa_id, seq_id, string_agg(sym, '' ORDER BY col) AS aseq FROM cells JOIN kept USING (msa_id, col) GROUP BY ALL",
    ),
    "F6_J18_covarying_pairs": (
        paired(al.covarying_pairs),
        P + """SELECT a.msa_id, a.i, a.j, count(*) AS support FROM paired a JOIN paired b ON a.msa_id = b.msa_id AND a.i = b.i AND a.seq_id < b.seq_id AND a.canon AND b.canon AND a."left" <> b."left" AND a."right" <> b."right" GROUP BY a.msa_id, a.i, a.j""",
    ),
    "alignment_summary": (
        rows(lambda aligned: summary(aligned, v.STRUCTURE, v.WIDTH)),
        P
        + _FREQ
        + _MI
        + _CONS
        + _WID
        + f""", tot AS ({_TOTALS}), ent AS (SELECT msa_id, sum(CASE WHEN f > 0 THEN f * log2(f / 0.25) ELSE 0 END) AS entropy FROM freq GROUP BY msa_id),
m AS (SELECT msa_id, sum(mi) AS mi FROM mi GROUP BY msa_id)
SELECT tot.*, ent.entropy, m.mi, wid.mean_identity, cons.conserved FROM tot LEFT JOIN ent USING (msa_id) LEFT JOIN m USING (msa_id) LEFT JOIN wid USING (msa_id) LEFT JOIN cons USING (msa_id)""",
    ),
}
