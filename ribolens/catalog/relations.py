"""Queries on relations, orders, weights and resampling (J, W-2, W-13, O, S, A-19 to A-32, F-5 to F-36)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ribolens.catalog import views as v
from ribolens.catalog.motifs import M, _INDEX, _A, _B, _indexed, _sides, motifs
from ribolens.functions import sequence as fs
from ribolens.functions import structure as st
from ribolens.operators import alignment as al
from ribolens.operators import relations as rl
from ribolens.session import table

H, S, R, D, C = (f"WITH {x} " for x in (v.HITS, v.SEQUENCES, v.ROWS, v.DEGENERATE, v.CELLS))


def hits(fn):
    return lambda spark, sf_dir: fn(v.hits(spark, sf_dir))


def _instances(spark, sf_dir):
    """A motif for each type of event: its best hit in each sequence."""
    e = table(spark, sf_dir, "events")
    h = v.hits(spark, sf_dir).join(e.select(F.col("event_id").alias("hit_id"), "event_type"), "hit_id")
    best = h.withColumn("n", F.row_number().over(Window.partitionBy("event_type", "seq_id").orderBy(F.desc("score"), "hit_id"))).where("n = 1")
    return best.select(F.col("event_type").alias("f"), "seq_id", "start", F.col("stop").alias("end"), "score", ((F.col("hit_id") % 4 + 1) / 4).alias("weight"))


def _motif_relations(spark, sf_dir):
    rows = _instances(spark, sf_dir)
    found = rl.motif_relations(rows.withColumnRenamed("f", "f1"), rows.withColumnRenamed("f", "f2"), ["f1", "f2"])
    return found.where("f1 < f2")


_RELATIONS = (
    H
    + """, b AS (SELECT e.event_type AS f, h.seq_id, h.start, h.stop AS "end", h.score, (h.hit_id % 4 + 1) / 4.0::DOUBLE AS weight FROM hits h JOIN events e ON h.hit_id = e.event_id QUALIFY row_number() OVER (PARTITION BY e.event_type, h.seq_id ORDER BY h.score DESC, h.hit_id) = 1),
m AS (SELECT a.f AS f1, b.f AS f2, a.start <= b.start AS first, a.weight * b.weight AS w, (a.weight + b.weight) / 2 AS n, a.score * a.weight + b.score * b.weight AS s, a."end" - a.start AS l1, b."end" - b.start AS l2,
  CASE WHEN a.start <= b.start THEN a."end" >= b."end" ELSE a."end" < b."end" END AS inside, CASE WHEN a.start <= b.start THEN a."end" - b.start ELSE b."end" - a.start END AS o FROM b a JOIN b ON a.seq_id = b.seq_id AND a.f < b.f),
k AS (SELECT *, CASE WHEN inside THEN 'same' WHEN o <= -100 THEN 'far' WHEN (l1 - o < 25 OR l2 - o < 25) AND (o > 0.9::DOUBLE * l1 OR o > 0.9::DOUBLE * l2) THEN 'same' ELSE 'near' END AS kind FROM m),
t AS (SELECT f1, f2, coalesce(sum(w) FILTER (kind = 'same'), 0) AS same, coalesce(sum(n) FILTER (kind = 'near' AND first), 0) AS n1, coalesce(sum(n) FILTER (kind = 'near' AND NOT first), 0) AS n2,
  coalesce(sum(s) FILTER (kind = 'near' AND first), 0) AS s1, coalesce(sum(s) FILTER (kind = 'near' AND NOT first), 0) AS s2, coalesce(sum(o * w) FILTER (kind = 'near' AND first AND o > 0), 0) AS o1, coalesce(sum(o * w) FILTER (kind = 'near' AND NOT first AND o > 0), 0) AS o2,
  coalesce(sum(-o * w) FILTER (kind = 'near' AND first AND o <= 0), 0) AS g1, coalesce(sum(-o * w) FILTER (kind = 'near' AND NOT first AND o <= 0), 0) AS g2 FROM k GROUP BY f1, f2),
p AS (SELECT f1, f2, s1 > s2 AS left_first, CASE WHEN s1 > s2 THEN n1 ELSE n2 END AS num_seq, CASE WHEN s1 > s2 THEN s1 ELSE s2 END AS s, CASE WHEN s1 > s2 THEN o1 ELSE o2 END AS o, CASE WHEN s1 > s2 THEN g1 ELSE g2 END AS g FROM t WHERE NOT (same > n1 AND same > n2))
SELECT f1, f2, left_first, num_seq, g / num_seq AS gap, o / num_seq AS overlap, s - g / 2 - o AS weight FROM p WHERE num_seq >= 2"""
)


def _stranded(spark, sf_dir):
    return v.hits(spark, sf_dir).withColumn("strand", F.when(F.col("hit_id") % 3 == 0, -1).otherwise(1))


def _anchor_pairs(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    pairs = line.select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), *_places())
    anchors = line.where("l_linenumber = 4 AND l_quantity > 47").select(F.col("l_suppkey").alias("key"), *_places())
    return rl.consistent(pairs, anchors, "key").select("id", "n")


def _places():
    start1, start2 = F.col("l_partkey") * 7 % 3000, (F.col("l_partkey") * 7 + F.col("l_linenumber") * 20) % 3000
    size = F.col("l_quantity").cast("long")
    return [start1.alias("start1"), (start1 + size).alias("stop1"), start2.alias("start2"), (start2 + size).alias("stop2")]


_PLACES = "l_partkey * 7 % 3000 AS start1, l_partkey * 7 % 3000 + CAST(l_quantity AS BIGINT) AS stop1, (l_partkey * 7 + l_linenumber * 20) % 3000 AS start2, (l_partkey * 7 + l_linenumber * 20) % 3000 + CAST(l_quantity AS BIGINT) AS stop2"


def _energies(spark, sf_dir):
    return v.hits(spark, sf_dir).groupBy((F.col("seq_id") % 3).alias("seq_id"), (F.col("start") % 60).alias("i"), (F.col("stop") % 60 + 60).alias("j")).agg(F.min("score").alias("energy"))


def _orders(h):
    by = lambda *cols: F.row_number().over(Window.partitionBy("seq_id").orderBy(*cols, "hit_id"))
    density = F.col("score") / (F.col("stop") - F.col("start") + 1)
    return h.select("hit_id", by(F.desc("score")).alias("by_score"), by(density).alias("by_density"), by("start", "stop").alias("by_place"))


def _capped(h, most=20, least=3, floor=50.0):
    """Hits up to ``most`` a sequence; beyond ``least`` only those over a score."""
    rank = F.row_number().over(Window.partitionBy("seq_id").orderBy(F.desc("score"), "hit_id"))
    return h.withColumn("rank", rank).where((F.col("rank") <= most) & ((F.col("rank") <= least) | (F.col("score") > floor))).select("hit_id", "rank")


def _both_ways(spark, sf_dir):
    from ribolens.operators import intervals as iv

    one, two = v.hits(spark, sf_dir), v.annotation(spark, sf_dir)
    met = iv.overlap_join(one, two, "seq_id").select("hit_id", "r_hit_id", "overlap")
    best = lambda a, b: iv.most_overlap(met, a, b)
    return best("hit_id", "r_hit_id").select(F.lit("forward").alias("way"), "hit_id", "r_hit_id", "overlap").unionByName(best("r_hit_id", "hit_id").select(F.lit("back").alias("way"), "hit_id", "r_hit_id", "overlap"))


def _annotation_modes(spark, sf_dir):
    """The kinds of annotation of each hit's sequence, all of them."""
    modes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("seq_id")).agg(F.array_join(F.sort_array(F.collect_set("l_returnflag")), ",").alias("modes"))  # three kinds at most
    return v.hits(spark, sf_dir).join(modes, "seq_id", "left").select("hit_id", "modes")


def _side_by_side(spark, sf_dir):
    rows = v.alignment_rows(spark, sf_dir)
    one, two = (rows.where(F.split("msa_id", ":")[2] == str(n)) for n in (0, 1))
    joined = rl.concatenated(one, two, v.WIDTH, v.WIDTH)
    return joined


def _shared_rows(spark, sf_dir):
    """Sequences that both of two alignments have, with their weights' mean."""
    rows = v.alignment_rows(spark, sf_dir)
    one, two = (rows.where(F.split("msa_id", ":")[2] == str(n)).select("seq_id", F.col("weight").alias(f"w{n}"), F.col("aseq").alias(f"a{n}")) for n in (0, 1))
    return one.join(two, "seq_id").select("seq_id", ((F.col("w0") + F.col("w1")) / 2).alias("weight"), (F.col("a0") == F.col("a1")).alias("same"))


def _described(h):
    """Weighted mean score by sequence; where all weights are 0, the plain mean."""
    w = (F.col("hit_id") % 2 * (F.col("seq_id") % 3)).cast("double")
    total = F.sum(w)
    return h.groupBy("seq_id").agg(F.when(total == 0, F.avg("score")).otherwise(F.sum(w * F.col("score")) / total).alias("mean_score"), F.when(total == 0, F.count(F.lit(1)).cast("double")).otherwise(total).alias("weight"))


def _stops(h, least_score=50.0, least_weight=2.5):
    w = (F.col("hit_id") % 4 + 1) / 4
    sums = h.groupBy("seq_id").agg(F.sum(w).alias("weight"), F.sum(w * F.col("score")).alias("score"))
    return sums.select("seq_id", "weight", "score", ((F.col("score") < least_score) | (F.col("weight") < least_weight)).alias("stops"))


def _updated_gamma(h, gamma=0.3, length=500):
    """The share of sequences that hold the motif, estimated anew from the instances' weights."""
    odds = F.pow(F.lit(2.0), F.col("score") / 40)
    rate = gamma / length
    weighted = h.withColumn("weight", odds * rate / (1 - gamma + rate * F.sum(odds).over(Window.partitionBy("seq_id"))))
    return weighted.agg(((F.sum("weight") + 0.3) / (F.countDistinct("seq_id") + 1)).alias("gamma"))


def _tail(h, mass=0.1):
    """The scores of the upper tail that holds ``mass`` of each sequence's hits: how many, and the least of them."""
    by = Window.partitionBy("seq_id")
    marked = h.select("seq_id", "score", F.row_number().over(by.orderBy(F.desc("score"), "hit_id")).alias("n"), F.floor(F.count(F.lit(1)).over(by) * mass).alias("size"))
    return marked.where("n <= size").groupBy("seq_id").agg(F.count(F.lit(1)).alias("size"), F.min("score").alias("least"))


def _goodness(h):
    """G and chi-square of each sequence's hits over ten classes of start against equal shares."""
    counts = h.groupBy("seq_id", F.floor(F.col("start") / 50).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    whole = h.groupBy("seq_id").agg((F.count(F.lit(1)) / 10).alias("e"))
    o, e = F.col("o"), F.col("e")
    met = counts.join(whole, "seq_id").groupBy("seq_id").agg((2 * F.sum(o * F.log(o / e))).alias("g"), F.sum((o - e) * (o - e) / e).alias("seen"), F.first("e").alias("e"), F.count(F.lit(1)).alias("bins"))
    return met.select("seq_id", "g", (F.col("seen") + (10 - F.col("bins")) * F.col("e")).alias("chi_square"))


def _residue_counts(spark, sf_dir):
    """Counts of residues, a degenerate letter dealt out evenly to those that it stands for."""
    seq = F.col("seq")
    times = lambda s: F.length(seq) - F.length(F.translate(seq, s, ""))
    each = {b: times(b) + sum(times(k) / float(len(of)) for k, of in st.IUPAC.items() if b in of) for b in "ACGU"}
    return v.degenerate(spark, sf_dir).select("seq_id", *[c.cast("double").alias(b.lower()) for b, c in each.items()])


_COUNTS = D + "SELECT seq_id, " + ", ".join(
    f"CAST(length(seq) - length(replace(seq, '{b}', '')) + " + " + ".join(f"(length(seq) - length(replace(seq, '{k}', ''))) / {len(of)}.0::DOUBLE" for k, of in st.IUPAC.items() if b in of) + f" AS DOUBLE) AS {b.lower()}" for b in "ACGU"
) + " FROM degenerate"


_KINDS = {"gaps": "[-._~]", "degenerate": "[RYMKSWHBVDNrymkswhbvdn]", "canonical": "[ACGUacgu]"}


def _symbol_kinds(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), *[F.regexp_count(t, F.lit(p)).alias(k) for k, p in _KINDS.items()])


def _flanked(spark, sf_dir, flank=5, most=6):
    """Places of 40 residues with ``most`` degenerate letters at most, ``flank`` residues on both sides counted in."""
    start = (F.col("seq_id") % 30 + 10).cast("int")
    part = F.substr("seq", start - flank, F.lit(40 + 2 * flank))
    rows = v.degenerate(spark, sf_dir).select("seq_id", start.alias("start"), fs.count_of(part, "RYMKSWHBVDN").alias("n_degenerate"))
    return rows.where(F.col("n_degenerate") <= most)


def _projections(spark, sf_dir):
    """An interval of columns, all but some, and some inserted: cut from each row."""
    a, whole = F.col("aseq"), v.WIDTH
    dropped = F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(whole)), lambda n: n % 7 != 3), lambda n: F.substr(a, n, F.lit(1))), "")
    inserted = F.concat(F.substring(a, 1, 10), F.lit("-----"), F.substring(a, 11, whole))
    return v.alignment_rows(spark, sf_dir).select("msa_id", "seq_id", F.substring(a, 11, 20).alias("interval"), dropped.alias("dropped"), inserted.alias("inserted"))


def _consensus_kept(spark, sf_dir):
    """Each row at its alignment's consensus columns alone, and without columns of gaps alone."""
    rows = v.alignment_rows(spark, sf_dir)
    known = al.column_masks(rows, v.WIDTH).withColumnRenamed("kept", "consensus")
    return al.masked_columns(rows.select("msa_id", "seq_id", "aseq").join(known, "msa_id"), v.WIDTH, ("consensus", "filled"))


def _alignment_statistics(spark, sf_dir):
    size = F.length(F.translate("aseq", "-", ""))
    return v.alignment_rows(spark, sf_dir).groupBy("msa_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("aseq")).alias("alen"), F.sum(size).alias("residues"), F.min(size).alias("shortest"), F.max(size).alias("longest"), F.avg(size).alias("mean"))


def _selected(spark, sf_dir, index=3.0, most=5):
    """Motifs chosen in each family: those near identical with little weight don't count, nor those of under 2.5; the choice
    ends at ``most`` or under an index."""
    m = motifs(spark, sf_dir).join(_indexed(spark, sf_dir).select("motif", "rank_index"), "motif")
    fine = m.where("NOT (identity > 0.95 AND num <= 4) AND num >= 2.5").where(F.col("rank_index") >= index)
    return fine.withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("rank_index"), "motif"))).where(F.col("rank") <= most).select("family", "motif", "rank")


def _alphabet(spark, sf_dir):
    """What alphabet a text's letters are of: nucleotides for 80 % at least, RNA if U is more frequent than T."""
    t = F.upper(F.coalesce("text", F.lit("")))
    letters, nucleotides = F.regexp_count(t, F.lit("[A-Z]")), F.regexp_count(t, F.lit("[ACGTUN]"))
    rna = F.regexp_count(t, F.lit("U")) > F.regexp_count(t, F.lit("T"))
    kind = F.when(letters == 0, "unknown").when(nucleotides < 0.8 * letters, "amino").when(rna, "rna").otherwise("dna")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("alphabet"))


def _name_parts(h):
    one, two = F.concat_ws(".", F.col("seq_id") % 3, F.col("start") % 2, "hit_id"), F.concat_ws(".", F.col("hit_id") % 3, F.col("start") % 2, "seq_id")
    prefix = st.common_prefix(one, two)
    rest = lambda name: F.array_join(F.slice(F.split(name, r"\."), F.size(F.filter(F.split(prefix, r"\."), lambda x: x != "")) + 1, 9), ".")
    return h.select("hit_id", prefix.alias("prefix"), rest(one).alias("suffix1"), rest(two).alias("suffix2"))


_SHUFFLED = "(SELECT string_agg(w, '' ORDER BY d) FROM (SELECT md5('{seed}:' || seq_id || ':' || n) AS d, substr(seq, n * {k} + 1, {k}) AS w FROM range(0, CAST(ceil(length(seq) / {k}.0) AS BIGINT)) t(n)))"
ENTRIES = {
    "J4_motif_relations": (_motif_relations, _RELATIONS),
    "J15_overlaps_by_place": (
        lambda spark, sf_dir: rl.without_overlaps_by_place(_stranded(spark, sf_dir)).select("hit_id"),
        H + """, s AS (SELECT *, CASE WHEN hit_id % 3 = 0 THEN -1 ELSE 1 END AS strand FROM hits)
SELECT hit_id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.seq_id = b.seq_id AND a.strand = b.strand AND a.hit_id <> b.hit_id AND CASE WHEN a.start = b.start AND a.stop = b.stop THEN b.hit_id < a.hit_id
  ELSE (a.start >= b.start AND a.stop <= b.stop) OR (b.start > a.start AND b.start <= a.stop AND b.stop > a.stop) END)""",
    ),
    "J9_consistent_with_anchors": (
        _anchor_pairs,
        f"""WITH p AS (SELECT l_suppkey AS key, l_orderkey AS id, l_linenumber AS n, {_PLACES} FROM lineitem), r AS (SELECT l_suppkey AS key, {_PLACES} FROM lineitem WHERE l_linenumber = 4 AND l_quantity > 47)
SELECT id, n FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.key = p.key AND NOT (p.stop1 < r.start1 AND p.stop2 < r.start2) AND NOT (p.start1 > r.stop1 AND p.start2 > r.stop2) AND (
  (p.stop2 > r.stop2 AND p.stop1 < r.start1) OR (p.stop1 > r.stop1 AND p.stop2 < r.start2) OR (p.start1 < r.start1 AND p.start2 > r.stop2) OR (p.start2 < r.start2 AND p.start1 > r.stop1)
  OR abs(greatest(p.start1, r.start1) - greatest(p.start2, r.start2) - (r.start1 - r.start2)) > 50 OR abs(least(p.stop1, r.stop1) - least(p.stop2, r.stop2) - (r.stop1 - r.stop2)) > 50))""",
    ),
    "W2_local_optima": (
        lambda spark, sf_dir: rl.local_optima(_energies(spark, sf_dir), "seq_id"),
        H + """, c AS (SELECT seq_id % 3 AS seq_id, start % 60 AS i, stop % 60 + 60 AS j, min(score) AS energy FROM hits GROUP BY ALL)
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.seq_id = c.seq_id AND NOT (o.i = c.i AND o.j = c.j) AND ((o.i BETWEEN c.i - 3 AND c.i AND o.j BETWEEN c.j AND c.j + 3 AND o.energy < c.energy)
  OR (o.i >= c.i AND o.i < c.i + 3 AND o.j <= c.j AND o.j > c.j - 3 AND o.i < o.j AND o.energy <= c.energy)))""",
    ),
    "O1_O2_hit_orders": (
        hits(_orders),
        H + """SELECT hit_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, hit_id) AS INTEGER) AS by_score, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY score / (stop - start + 1), hit_id) AS INTEGER) AS by_density,
  CAST(row_number() OVER (PARTITION BY seq_id ORDER BY start, stop, hit_id) AS INTEGER) AS by_place FROM hits""",
    ),
    "O5_capped_hits": (hits(_capped), H + "SELECT hit_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, hit_id) AS INTEGER) AS rank FROM hits QUALIFY rank <= 20 AND (rank <= 3 OR score > 50)"),
    "J20_best_both_ways": (
        _both_ways,
        f"WITH {v.HITS}, {v.ANNOTATION}" + """, o AS (SELECT hit_id, r_hit_id, least(stop, r_stop) - greatest(start, r_start) AS overlap FROM hits JOIN anno USING (seq_id) WHERE start <= r_stop AND r_start <= stop)
SELECT 'forward' AS way, * FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY hit_id ORDER BY overlap DESC, r_hit_id) = 1) UNION ALL SELECT 'back', * FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY r_hit_id ORDER BY overlap DESC, hit_id) = 1)""",
    ),
    "J6_annotation_values": (_annotation_modes, H + "SELECT hit_id, modes FROM hits LEFT JOIN (SELECT l_suppkey AS seq_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS modes FROM lineitem GROUP BY 1) USING (seq_id)"),
    "S3_side_by_side": (
        _side_by_side,
        R + f", a AS (SELECT seq_id, aseq FROM aln WHERE split_part(msa_id, ':', 3) = '0'), b AS (SELECT seq_id, aseq FROM aln WHERE split_part(msa_id, ':', 3) = '1') SELECT coalesce(a.seq_id, b.seq_id) AS seq_id, coalesce(a.aseq, repeat('-', {v.WIDTH})) || coalesce(b.aseq, repeat('-', {v.WIDTH})) AS aseq FROM a FULL JOIN b ON a.seq_id = b.seq_id",
    ),
    "J1_shared_rows": (
        _shared_rows,
        R + ", a AS (SELECT * FROM aln WHERE split_part(msa_id, ':', 3) = '0'), b AS (SELECT * FROM aln WHERE split_part(msa_id, ':', 3) = '1') SELECT a.seq_id, (a.weight + b.weight) / 2 AS weight, a.aseq = b.aseq AS same FROM a JOIN b ON a.seq_id = b.seq_id",
    ),
    "S1_numbered_union": (
        lambda spark, sf_dir: rl.numbered_union(*_sides(spark, sf_dir), "id"),
        f"WITH a AS ({_A}), b AS ({_B}) SELECT id, id AS number FROM a UNION ALL SELECT id, CAST((SELECT coalesce(max(id), 0) FROM a) + row_number() OVER (ORDER BY id) AS BIGINT) FROM b WHERE id NOT IN (SELECT id FROM a)",
    ),
    "A19_described_scores": (
        hits(_described),
        H + ", w AS (SELECT *, (hit_id % 2 * (seq_id % 3))::DOUBLE AS w FROM hits) SELECT seq_id, CASE WHEN sum(w) = 0 THEN avg(score) ELSE sum(w * score) / sum(w) END AS mean_score, CASE WHEN sum(w) = 0 THEN count(*)::DOUBLE ELSE sum(w) END AS weight FROM w GROUP BY seq_id",
    ),
    "A23_inflated_weights": (
        hits(lambda h: rl.evalue_weights(h, 20.0, 0.05, 3).select("hit_id", "weight")),
        H + """, r AS (SELECT hit_id, seq_id, exp(-3 * (1 - exp(-exp(-0.05::DOUBLE * (score - 20))))) AS w FROM hits), t AS (SELECT *, sum(w) OVER (PARTITION BY seq_id) AS t FROM r)
SELECT hit_id, CASE WHEN t < 3 AND t > 0 THEN least(w * 3 / t, 1) ELSE w END AS weight FROM t""",
    ),
    "A24_totals_and_stops": (hits(_stops), H + ", s AS (SELECT seq_id, sum((hit_id % 4 + 1) / 4.0::DOUBLE) AS weight, sum((hit_id % 4 + 1) / 4.0::DOUBLE * score) AS score FROM hits GROUP BY seq_id) SELECT *, score < 50 OR weight < 2.5 AS stops FROM s"),
    "A21_updated_gamma": (
        hits(_updated_gamma),
        H + ", w AS (SELECT seq_id, pow(2, score / 40) * (0.3::DOUBLE / 500) / (0.7::DOUBLE + (0.3::DOUBLE / 500) * sum(pow(2, score / 40)) OVER (PARTITION BY seq_id)) AS w FROM hits) SELECT (sum(w) + 0.3::DOUBLE) / (count(DISTINCT seq_id) + 1) AS gamma FROM w",
    ),
    "A27_tail": (hits(_tail), H + ", m AS (SELECT seq_id, score, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, hit_id) AS n, floor(count(*) OVER (PARTITION BY seq_id) * 0.1::DOUBLE) AS size FROM hits) SELECT seq_id, count(*) AS size, min(score) AS least FROM m WHERE n <= size GROUP BY seq_id"),
    "A27_A29_goodness": (
        hits(_goodness),
        H + """, c AS (SELECT seq_id, start // 50 AS bin, count(*)::DOUBLE AS o FROM hits GROUP BY ALL), e AS (SELECT seq_id, count(*) / 10.0::DOUBLE AS e FROM hits GROUP BY seq_id)
SELECT seq_id, 2 * sum(CASE WHEN coalesce(o, 0) > 0 THEN o * ln(o / e) ELSE 0 END) AS g, sum((coalesce(o, 0) - e) ** 2 / e) AS chi_square FROM (SELECT * FROM e, range(0, 10) b(bin)) LEFT JOIN c USING (seq_id, bin) GROUP BY seq_id""",
    ),
    "F36_residue_counts": (_residue_counts, _COUNTS),
    "F5_symbol_kinds": (
        _symbol_kinds,
        "SELECT doc_id AS seq_id, " + ", ".join(f"CAST(len(regexp_extract_all(coalesce(text, ''), '{p}')) AS INTEGER) AS {k}" for k, p in _KINDS.items()) + " FROM documents",
    ),
    "F27_flanked_counts": (
        _flanked,
        D + ", p AS (SELECT seq_id, CAST(seq_id % 30 + 10 AS INTEGER) AS start, substr(seq, seq_id % 30 + 5, 50) AS part FROM degenerate) SELECT seq_id, start, CAST(length(part) - length(translate(part, 'RYMKSWHBVDN', '')) AS INTEGER) AS n_degenerate FROM p WHERE length(part) - length(translate(part, 'RYMKSWHBVDN', '')) <= 6",
    ),
    "F31_projections": (
        _projections,
        R + f"SELECT msa_id, seq_id, substr(aseq, 11, 20) AS interval, array_to_string(list_transform(list_filter(range(1, {v.WIDTH + 1}), lambda n: n % 7 <> 3), lambda n: substr(aseq, n, 1)), '') AS dropped, substr(aseq, 1, 10) || '-----' || substr(aseq, 11) AS inserted FROM aln",
    ),
    "F31_kept_by_consensus": (
        _consensus_kept,
        C + """, g AS (SELECT msa_id, col, sum(CASE WHEN res THEN 0 ELSE weight END) <= 0.6::DOUBLE * sum(weight) AND bool_or(res) AS kept, bool_or(res) AS filled FROM cells GROUP BY msa_id, col)
SELECT msa_id, seq_id, coalesce(string_agg(sym, '' ORDER BY col) FILTER (kept), '') AS consensus, coalesce(string_agg(sym, '' ORDER BY col) FILTER (filled), '') AS filled FROM cells JOIN g USING (msa_id, col) GROUP BY msa_id, seq_id""",
    ),
    "A32_alignment_statistics": (
        _alignment_statistics,
        R + "SELECT msa_id, count(*) AS n, CAST(max(length(aseq)) AS INTEGER) AS alen, CAST(sum(length(replace(aseq, '-', ''))) AS BIGINT) AS residues, CAST(min(length(replace(aseq, '-', ''))) AS INTEGER) AS shortest, CAST(max(length(replace(aseq, '-', ''))) AS INTEGER) AS longest, avg(length(replace(aseq, '-', ''))) AS mean FROM aln GROUP BY msa_id",
    ),
    "F30_W11_selected": (
        _selected,
        M + f", x AS ({_INDEX}) SELECT m.family, m.motif, CAST(row_number() OVER (PARTITION BY m.family ORDER BY rank_index DESC, m.motif) AS INTEGER) AS rank FROM motifs m JOIN x ON m.motif = x.motif WHERE NOT (identity > 0.95 AND num <= 4) AND num >= 2.5 AND rank_index >= 3 QUALIFY rank <= 5",
    ),
    "F33_alphabet": (
        _alphabet,
        """WITH n AS (SELECT doc_id, len(regexp_extract_all(upper(coalesce(text, '')), '[A-Z]')) AS l, len(regexp_extract_all(upper(coalesce(text, '')), '[ACGTUN]')) AS n, len(regexp_extract_all(upper(coalesce(text, '')), 'U')) AS u, len(regexp_extract_all(upper(coalesce(text, '')), 'T')) AS t FROM documents)
SELECT doc_id, CASE WHEN l = 0 THEN 'unknown' WHEN n < 0.8 * l THEN 'amino' WHEN u > t THEN 'rna' ELSE 'dna' END AS alphabet FROM n""",
    ),
    "F20_name_parts": (
        hits(_name_parts),
        H + """SELECT hit_id, CASE WHEN seq_id % 3 <> hit_id % 3 THEN '' WHEN hit_id = seq_id THEN concat_ws('.', seq_id % 3, start % 2, hit_id) ELSE concat_ws('.', seq_id % 3, start % 2) END AS prefix,
  CASE WHEN seq_id % 3 <> hit_id % 3 THEN concat_ws('.', seq_id % 3, start % 2, hit_id) WHEN hit_id = seq_id THEN '' ELSE CAST(hit_id AS VARCHAR) END AS suffix1,
  CASE WHEN seq_id % 3 <> hit_id % 3 THEN concat_ws('.', hit_id % 3, start % 2, seq_id) WHEN hit_id = seq_id THEN '' ELSE CAST(seq_id AS VARCHAR) END AS suffix2 FROM hits""",
    ),
    "O10_shuffled": (
        lambda spark, sf_dir: v.sequences(spark, sf_dir).where("seq <> ''").select("seq_id", rl.shuffled_text(F.col("seq_id"), F.col("seq"), "mono").alias("mono"), rl.shuffled_text(F.col("seq_id"), F.col("seq"), "words", 3).alias("words"), F.reverse("seq").alias("back")),
        S + f"SELECT seq_id, {_SHUFFLED.format(seed='mono', k=1)} AS mono, {_SHUFFLED.format(seed='words', k=3)} AS words, reverse(seq) AS back FROM sequences WHERE seq <> ''",
    ),
    "O9_drawn_columns": (
        lambda spark, sf_dir: rl.drawn_columns(v.alignment_rows(spark, sf_dir), v.WIDTH, "boot", True),
        R + f"SELECT msa_id, seq_id, array_to_string(list_transform(range(1, {v.WIDTH + 1}), lambda n: substr(aseq, CAST(('0x' || substr(md5('boot:' || msa_id || ':' || n), 1, 8)) AS BIGINT) % {v.WIDTH} + 1, 1)), '') AS aseq FROM aln",
    ),
    "O9_permuted_columns": (
        lambda spark, sf_dir: rl.drawn_columns(v.alignment_rows(spark, sf_dir), v.WIDTH, "perm", False),
        R + f", o AS (SELECT msa_id, list(n ORDER BY md5('perm:' || msa_id || ':' || n)) AS o FROM (SELECT DISTINCT msa_id FROM aln), range(1, {v.WIDTH + 1}) t(n) GROUP BY msa_id) SELECT msa_id, seq_id, array_to_string(list_transform(o, lambda n: substr(aseq, n, 1)), '') AS aseq FROM aln JOIN o USING (msa_id)",
    ),
}
