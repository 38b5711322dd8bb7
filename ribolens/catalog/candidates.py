"""Queries on candidates, column pairs, structures and weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ribolens.catalog import views as v
from ribolens.functions import structure as st
from ribolens.operators import alignment as al
from ribolens.operators import candidates as cd

S, C, P, R, H = (f"WITH {x} " for x in (v.SEQUENCES, v.CELLS, v.PAIRS, v.ROWS, v.HITS))
HA = f"WITH {v.HITS}, {v.ANNOTATION} "


def _all_pairs(spark, sf_dir):
    """Expected mutual information of every two columns of an alignment: each row gives its pairs of columns itself."""
    return al.expected_information(v.alignment_rows(spark, sf_dir), v.WIDTH)


def _lengths(spark, sf_dir):
    return v.sequences(spark, sf_dir).select(F.concat_ws(":", "lang", "source").alias("key"), F.col("seq_id").alias("hit_id"), F.length("seq").alias("len"))


def _weights(spark, sf_dir):
    """The weights under each strategy: those given, all ones, position-based, and position-based times given."""
    rows = v.alignment_rows(spark, sf_dir)
    pb = al.position_based_weights(rows, v.WIDTH)
    given, own = F.col("weight"), F.col("pb_weight")
    return rows.join(pb, ["msa_id", "seq_id"]).select("msa_id", "seq_id", given.alias("given"), F.lit(1.0).alias("uniform"), own.alias("position_based"), (given * own).alias("both"))


def _pair_score(spark, sf_dir):
    """For each pair of columns the largest weight product of two covarying sequences, summed over the alignment: types
    that differ on both sides meet with the largest weight of each."""
    paired = al.pair_cells(v.alignment_rows(spark, sf_dir), v.STRUCTURE)
    types = paired.where(al.is_canonical(F.col("left"), F.col("right"))).groupBy("msa_id", "i", "j", "left", "right").agg(F.max("weight").alias("w"))
    other = types.select("msa_id", "i", "j", F.col("left").alias("l2"), F.col("right").alias("r2"), F.col("w").alias("w2"))
    best = types.join(other, ["msa_id", "i", "j"]).where("left <> l2 AND right <> r2").groupBy("msa_id", "i", "j").agg(F.max(F.col("w") * F.col("w2")).alias("best"))
    return best.groupBy("msa_id").agg(F.round(F.sum("best"), 6).alias("score"), F.round(F.max("best"), 6).alias("top"))


def _consensus_classes(spark, sf_dir):
    f = al.column_frequencies(v.alignment_cells(spark, sf_dir)).groupBy("msa_id", "col").agg(F.max(F.round("f", 6)).alias("f"))
    return f.select("msa_id", "col", F.when(F.col("f") >= 0.97, 3).when(F.col("f") >= 0.9, 2).when(F.col("f") >= 0.75, 1).otherwise(0).alias("level"))


def _log_sums(spark, sf_dir):
    return st.log_sum_exp(v.hits(spark, sf_dir).where("score IS NOT NULL").select("seq_id", "score"), "seq_id", "score")


def _descriptions(spark, sf_dir):
    """Weighted mean of scores read from "a..b<TAB>score"."""
    text = F.concat("start", F.lit(".."), "stop", F.lit("\t"), F.format_string("%.3f", F.round("score", 3)))
    score = F.regexp_extract(text, r"^\d+\.\.\d+\t(\S+)$", 1).cast("double")
    weight = (F.col("hit_id") % 7 + 1).cast("double")
    rows = v.hits(spark, sf_dir).select("seq_id", score.alias("score"), weight.alias("w"))
    return rows.groupBy("seq_id").agg(F.round(F.sum(F.col("w") * F.col("score")) / F.sum("w"), 6).alias("mean_score"), F.sum("w").alias("weight"))


def _previous(spark, sf_dir):
    """Each hit's place and its follower by start, and quartiles of score (window functions)."""
    by = Window.partitionBy("seq_id").orderBy("start", "hit_id")
    return v.hits(spark, sf_dir).select("hit_id", F.lag("hit_id").over(by).alias("before"), F.lead("hit_id").over(by).alias("after"), F.ntile(4).over(Window.partitionBy("seq_id").orderBy("score", "hit_id")).alias("quartile"))


ENTRIES = {
    "A7_J19_all_column_pairs": (
        _all_pairs,
        C
        + """, joint AS (SELECT a.msa_id, a.col AS i, b.col AS j, a.sym AS l, b.sym AS r, sum(a.weight) AS w FROM cells a JOIN cells b ON a.msa_id = b.msa_id AND a.seq_id = b.seq_id AND a.col < b.col AND a.res AND b.res GROUP BY ALL),
share AS (SELECT *, sum(w) OVER (PARTITION BY msa_id, i, j) AS t, sum(w) OVER (PARTITION BY msa_id, i, j, l) AS wl, sum(w) OVER (PARTITION BY msa_id, i, j, r) AS wr FROM joint),
x AS (SELECT msa_id, i, j, 100 * sum(w / t * log2(w * t / (wl * wr))) * any_value(t) AS mi FROM share GROUP BY msa_id, i, j),
n AS (SELECT msa_id, count(*) AS n FROM aln GROUP BY msa_id)
SELECT msa_id, i, j, mi / n AS mi FROM x JOIN n USING (msa_id)""",
    ),
    "A3_A19_described_scores": (
        _descriptions,
        H + "SELECT seq_id, round(sum((hit_id % 7 + 1) * round(score, 3)) / sum(hit_id % 7 + 1), 6) AS mean_score, CAST(sum(hit_id % 7 + 1) AS DOUBLE) AS weight FROM hits GROUP BY seq_id",
    ),
    "A23_evalue_weights": (
        lambda spark, sf_dir: v.hits(spark, sf_dir).select("hit_id", F.round(F.exp(-(F.col("stop") - F.col("start") + 1) * F.exp(-F.col("score") / 10)), 6).alias("weight")),
        H + "SELECT hit_id, round(exp(-(stop - start + 1) * exp(-score / 10)), 6) AS weight FROM hits",
    ),
    "A26_weight_products": (
        _weights,
        C + """, k AS (SELECT msa_id, col, sym, count(*) AS n FROM cells WHERE res GROUP BY ALL), kk AS (SELECT *, count(*) OVER (PARTITION BY msa_id, col) AS k FROM k),
raw AS (SELECT c.msa_id, c.seq_id, any_value(c.weight) AS w, coalesce(sum(1 / (kk.k * kk.n)) / nullif(count(kk.n), 0), 0) AS raw FROM cells c LEFT JOIN kk ON c.msa_id = kk.msa_id AND c.col = kk.col AND c.sym = kk.sym GROUP BY c.msa_id, c.seq_id),
pb AS (SELECT *, CASE WHEN sum(raw) OVER (PARTITION BY msa_id) > 0 THEN raw * count(*) OVER (PARTITION BY msa_id) / sum(raw) OVER (PARTITION BY msa_id) ELSE 1 END AS pb FROM raw)
SELECT msa_id, seq_id, w AS given, 1.0::DOUBLE AS uniform, pb AS position_based, w * pb AS both FROM pb""",
    ),
    "A33_consensus_levels": (
        _consensus_classes,
        C + """, freq AS (SELECT c.msa_id, c.col, s.sym, round((sum(CASE WHEN c.sym = s.sym THEN weight ELSE 0 END) + sum(CASE WHEN NOT res THEN weight ELSE 0 END) * 0.25) / sum(weight), 6) AS f FROM cells c, (VALUES ('A'), ('C'), ('G'), ('U')) s(sym) GROUP BY ALL)
SELECT msa_id, col, CASE WHEN max(f) >= 0.97 THEN 3 WHEN max(f) >= 0.9 THEN 2 WHEN max(f) >= 0.75 THEN 1 ELSE 0 END AS level FROM freq GROUP BY msa_id, col""",
    ),
    "A35_pair_score": (
        _pair_score,
        P + """, b AS (SELECT a.msa_id, a.i, max(a.weight * b.weight) AS best FROM paired a JOIN paired b ON a.msa_id = b.msa_id AND a.i = b.i AND a.canon AND b.canon AND a."left" <> b."left" AND a."right" <> b."right" GROUP BY a.msa_id, a.i)
SELECT msa_id, round(sum(best), 6) AS score, round(max(best), 6) AS top FROM b GROUP BY msa_id""",
    ),
    "A37_fragments": (
        lambda spark, sf_dir: v.alignment_rows(spark, sf_dir).select("msa_id", "seq_id", (F.length(F.translate("aseq", "-", "")) < 0.15 * F.length("aseq")).alias("fragment")),
        R + "SELECT msa_id, seq_id, length(replace(aseq, '-', '')) < 0.15 * length(aseq) AS fragment FROM aln",
    ),
    "A39_rollup": (
        lambda spark, sf_dir: v.sequences(spark, sf_dir).rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("residues")),
        S + "SELECT lang, source, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS residues FROM sequences GROUP BY ROLLUP (lang, source)",
    ),
    "F2_padded": (lambda spark, sf_dir: v.sequences(spark, sf_dir).select("seq_id", F.lpad("source", 12, "-").alias("left"), F.rpad("source", 12, ".").alias("right")), S + "SELECT seq_id, lpad(source, 12, '-') AS \"left\", rpad(source, 12, '.') AS \"right\" FROM sequences"),
    "F18_iupac_matches": (lambda spark, sf_dir: v.sequences(spark, sf_dir).select("seq_id", F.regexp_count("seq", F.lit(st.iupac_pattern("RYNGS"))).alias("n")), S + "SELECT seq_id, CAST(len(regexp_extract_all(seq, '[AG][CU][ACGU]G[CG]')) AS INTEGER) AS n FROM sequences"),
    "F20_common_prefixes": (
        lambda spark, sf_dir: v.hits(spark, sf_dir).select("hit_id", st.common_prefix(F.concat_ws(".", F.col("seq_id") % 3, F.col("start") % 2, "hit_id"), F.concat_ws(".", F.col("hit_id") % 3, F.col("start") % 2, "seq_id")).alias("prefix")),
        H + "SELECT hit_id, CASE WHEN seq_id % 3 <> hit_id % 3 THEN '' WHEN hit_id = seq_id THEN concat_ws('.', seq_id % 3, start % 2, hit_id) ELSE concat_ws('.', seq_id % 3, start % 2) END AS prefix FROM hits",
    ),
    "F23_span_filter": (lambda spark, sf_dir: v.hits(spark, sf_dir).where("stop - start + 1 >= 30 AND stop - start + 1 < 45 AND score < 50").select("hit_id"), H + "SELECT hit_id FROM hits WHERE stop - start + 1 >= 30 AND stop - start + 1 < 45 AND score < 50"),
    "F24_J8_similar_lengths": (
        lambda spark, sf_dir: cd.similar_length_counts(_lengths(spark, sf_dir)),
        S + """, l AS (SELECT concat_ws(':', lang, source) AS key, seq_id, length(seq) AS len FROM sequences)
SELECT a.key, count(*) AS pairs FROM l a JOIN l b ON a.key = b.key AND a.seq_id < b.seq_id AND a.len > 0 AND b.len > 0 AND abs(a.len - b.len) < 0.3::DOUBLE * greatest(a.len, b.len) GROUP BY a.key""",
    ),
    "F34_log_sums": (_log_sums, H + ", m AS (SELECT *, max(score) OVER (PARTITION BY seq_id) AS top FROM hits) SELECT seq_id, max(top) + ln(sum(exp(score - top))) AS log_sum FROM m WHERE score IS NOT NULL GROUP BY seq_id"),
    "F35_shares": (
        lambda spark, sf_dir: v.sequences(spark, sf_dir).select("seq_id", F.round(st.share(F.length("seq") - F.length(F.translate("seq", "G", "")), F.length("seq"), 4), 6).alias("g")),
        S + "SELECT seq_id, round(CASE WHEN length(seq) = 0 THEN 0.25 ELSE (length(seq) - length(replace(seq, 'G', ''))) / length(seq) END, 6) AS g FROM sequences",
    ),
    "J7_covered_positions": (
        lambda spark, sf_dir: cd.covered_positions(v.hits(spark, sf_dir), v.annotation(spark, sf_dir)),
        HA + """, p AS (SELECT hit_id, seq_id, unnest(range(start, stop + 1)) AS pos FROM hits), a AS (SELECT DISTINCT seq_id, unnest(range(r_start, r_stop + 1)) AS pos FROM anno)
SELECT hit_id, count(a.pos) AS covered FROM p LEFT JOIN a USING (seq_id, pos) GROUP BY hit_id""",
    ),
    "J15_priority_overlaps": (
        lambda spark, sf_dir: cd.without_lower_overlaps(v.hits(spark, sf_dir)).select("hit_id"),
        H + "SELECT hit_id FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE a.seq_id = b.seq_id AND a.start <= b.stop AND b.start <= a.stop AND (b.score > a.score OR (b.score = a.score AND b.hit_id < a.hit_id)))",
    ),
    "J16_J17_duplicate_groups": (
        lambda spark, sf_dir: cd.group_members(v.sequences(spark, sf_dir), "seq_id", "seq"),
        S + "SELECT seq_id, min(seq_id) OVER (PARTITION BY seq) AS first, count(*) OVER (PARTITION BY seq) AS n FROM sequences",
    ),
    "O8_hash_sample": (
        lambda spark, sf_dir: cd.hash_sample(v.hits(spark, sf_dir), "hit_id", 50).select("hit_id"),
        H + "SELECT hit_id FROM hits ORDER BY md5('s:' || hit_id), hit_id LIMIT 50",
    ),
    "S3_concatenated": (
        lambda spark, sf_dir: v.alignment_rows(spark, sf_dir).select("msa_id", "seq_id", F.concat("aseq", F.lit("--"), F.reverse("aseq")).alias("aseq")),
        R + "SELECT msa_id, seq_id, aseq || '--' || reverse(aseq) AS aseq FROM aln",
    ),
    "S5_combined": (
        lambda spark, sf_dir: (lambda h: h.where("score > 50").select("seq_id", "hit_id").unionByName(h.where("stop - start > 40").select("seq_id", "hit_id")))(v.hits(spark, sf_dir)),
        H + "SELECT seq_id, hit_id FROM hits WHERE score > 50 UNION ALL SELECT seq_id, hit_id FROM hits WHERE stop - start > 40",
    ),
    "W14_neighbours": (
        _previous,
        H + "SELECT hit_id, lag(hit_id) OVER w AS before, lead(hit_id) OVER w AS after, CAST(ntile(4) OVER (PARTITION BY seq_id ORDER BY score, hit_id) AS INTEGER) AS quartile FROM hits WINDOW w AS (PARTITION BY seq_id ORDER BY start, hit_id)",
    ),
}
