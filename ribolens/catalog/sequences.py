"""Queries on single sequences (F, SC, W-1, A-31, O, S blocks)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ribolens.catalog import views as v
from ribolens.functions import sequence as fs
from ribolens.operators import intervals as iv
from ribolens.operators import ranking as rk

S, D = f"WITH {v.SEQUENCES} ", f"WITH {v.DEGENERATE} "
_CODONS = ", ".join(f"'{c}': '{aa}'" for aa, codons in fs.GENETIC_CODE.items() for c in codons.split())


def on(view, columns):
    """A projection of a view; columns are made when it runs, since they need a session."""
    return lambda spark, sf_dir: view(spark, sf_dir).select(*columns())


def _composition(spark, sf_dir):
    seq = F.col("seq")
    return v.sequences(spark, sf_dir).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.length(seq)).alias("min_len"), F.max(F.length(seq)).alias("max_len"), F.round(F.avg(F.length(seq)), 6).alias("mean_len"), *[F.sum(fs.count_of(seq, b)).alias(f"n_{b.lower()}") for b in "ACGU"]
    )


def _kmers(spark, sf_dir):
    rows = v.sequences(spark, sf_dir).where(F.length("seq") >= 4)
    kmers = F.transform(F.sequence(F.lit(1), F.length("seq") - 3), lambda n: F.substr("seq", n, F.lit(4)))
    return rows.select("lang", F.explode(kmers).alias("kmer")).groupBy("lang", "kmer").agg(F.count(F.lit(1)).alias("n"))


def _hit_ids(spark, sf_dir):
    name = F.concat(F.lit("S"), F.col("seq_id"), F.lit("/"), F.col("start"), F.lit("-"), F.col("stop"))
    rows = v.hits(spark, sf_dir).select("hit_id", name.alias("name"))
    return rows.select("hit_id", *[fs.hit_part(F.col("name"), n).alias(c) for n, c in ((1, "seq"), (2, "first"), (3, "last"))], F.signum(fs.hit_part(F.col("name"), 3).cast("long") - fs.hit_part(F.col("name"), 2).cast("long")).cast("int").alias("strand"))


def _frames(spark, sf_dir):
    rows = v.sequences(spark, sf_dir)
    both = rows.select("seq_id", F.lit(1).alias("strand"), "seq").unionAll(rows.select("seq_id", F.lit(-1), fs.reverse_complement(F.col("seq"))))
    return both.select("seq_id", "strand", F.inline(F.array(*[F.struct(F.lit(f).alias("frame"), fs.translated(F.col("seq"), f).alias("protein")) for f in range(3)])))


def _dedup(spark, sf_dir):
    return rk.unique_sequences(v.sequences(spark, sf_dir).where(F.length("seq") > 0), "seq", [F.desc("seq_id")]).select("seq_id")


def _contained(spark, sf_dir):
    return rk.contained_strings(v.sequences(spark, sf_dir), "seq_id", "seq")


def _species(spark, sf_dir):
    name = F.concat(F.upper("lang"), F.upper("lang"), F.col("source").substr(4, 1), F.lit("01/"), F.col("seq_id"))
    return v.sequences(spark, sf_dir).select("lang", fs.species_id(name).alias("species")).groupBy("lang").agg(F.countDistinct("species").alias("species"))


ENTRIES = {
    "F1_ungapped": (on(v.alignment_rows, lambda: ["msa_id", "seq_id", fs.ungapped(F.col("aseq")).alias("seq")]), f"WITH {v.ROWS} SELECT msa_id, seq_id, replace(aseq, '-', '') AS seq FROM aln"),
    "F3_residues": (on(v.sequences, lambda: ["seq_id", "seq"]), S + "SELECT seq_id, seq FROM sequences"),
    "F4_base_codes": (
        lambda spark, sf_dir: v.alignment_cells(spark, sf_dir).groupBy("msa_id", fs.base_code(F.col("sym")).alias("code")).agg(F.count(F.lit(1)).alias("n")),
        f"WITH {v.CELLS} SELECT msa_id, CASE sym WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 3 WHEN 'U' THEN 4 ELSE 0 END AS code, count(*) AS n FROM cells GROUP BY ALL",
    ),
    "F15_hit_names": (
        _hit_ids,
        f"WITH {v.HITS} SELECT hit_id, 'S' || seq_id AS seq, CAST(start AS VARCHAR) AS first, CAST(stop AS VARCHAR) AS last, 1 AS strand FROM hits",
    ),
    "F16_reverse_complement": (on(v.sequences, lambda: ["seq_id", fs.reverse_complement(F.col("seq")).alias("rc")]), S + "SELECT seq_id, reverse(translate(seq, 'ACGU', 'UGCA')) AS rc FROM sequences"),
    "F17_six_frames": (
        _frames,
        S
        + f""", both_strands AS (SELECT seq_id, 1 AS strand, seq FROM sequences UNION ALL SELECT seq_id, -1, reverse(translate(seq, 'ACGU', 'UGCA')) FROM sequences)
SELECT seq_id, strand, CAST(f AS INTEGER) AS frame, array_to_string(list_transform(range(0, (length(seq) - f) // 3), lambda n: coalesce(MAP {{{_CODONS}}}[substr(seq, CAST(n * 3 + f + 1 AS BIGINT), 3)], 'X')), '') AS protein
FROM both_strands, range(0, 3) t(f)""",
    ),
    "F19_subsequence": (on(v.sequences, lambda: ["seq_id", F.substring(F.col("seq"), 11, 30).alias("part")]), S + "SELECT seq_id, substr(seq, 11, 30) AS part FROM sequences"),
    "F21_species": (_species, "SELECT lang, count(DISTINCT substr(upper(lang) || upper(lang) || substr(source, 4, 1), 1, 4)) AS species FROM documents GROUP BY lang"),
    "F27_degenerate_counts": (
        on(v.degenerate, lambda: ["seq_id", fs.count_of(F.col("seq"), "RYMKSWHBVDN").alias("n_degenerate")]),
        D + "SELECT seq_id, CAST(length(seq) - length(translate(seq, 'RYMKSWHBVDN', '')) AS INTEGER) AS n_degenerate FROM degenerate",
    ),
    "F28_trimmed": (
        on(v.degenerate, lambda: ["seq_id", fs.trimmed(F.col("seq")).alias("seq"), (F.length(F.col("seq")) - F.length(F.regexp_replace(F.col("seq"), "^[^ACGU]+", ""))).alias("shift")]),
        D + "SELECT seq_id, regexp_replace(regexp_replace(seq, '^[^ACGU]+', ''), '[^ACGU]+$', '') AS seq, CAST(length(seq) - length(regexp_replace(seq, '^[^ACGU]+', '')) AS INTEGER) AS shift FROM degenerate",
    ),
    "F33_unknown_to_n": (on(v.degenerate, lambda: ["seq_id", F.translate(F.col("seq"), "RYMKSWHBVD", "NNNNNNNNNN").alias("seq")]), D + "SELECT seq_id, translate(seq, 'RYMKSWHBVD', 'NNNNNNNNNN') AS seq FROM degenerate"),
    "F37_masked": (
        lambda spark, sf_dir: v.sequences(spark, sf_dir).where(F.length("seq") >= 20).select("seq_id", fs.masked(F.col("seq"), F.lit(6), F.lit(15)).alias("seq")),
        S + "SELECT seq_id, substr(seq, 1, 5) || 'NNNNNNNNNN' || substr(seq, 16) AS seq FROM sequences WHERE length(seq) >= 20",
    ),
    "SC9_context_windows": (
        lambda spark, sf_dir: iv.strand_windows(v.sequences(spark, sf_dir), 200, 30),
        S + "SELECT seq_id, CAST(b AS INTEGER) AS begin, CAST(least(b, 30) AS INTEGER) AS lead, substr(seq, CAST(b - least(b, 30) + 1 AS BIGINT), CAST(least(b, 30) + 200 AS BIGINT)) AS window FROM (SELECT seq_id, seq, unnest(range(0, length(seq), 200)) AS b FROM sequences WHERE length(seq) > 0)",
    ),
    "W1_sliding_windows": (
        lambda spark, sf_dir: iv.sliding(v.sequences(spark, sf_dir), 200, 100),
        S + "SELECT seq_id, CAST(b AS INTEGER) AS begin, substr(seq, CAST(b + 1 AS BIGINT), 200) AS window FROM (SELECT seq_id, seq, unnest(range(0, length(seq), 100)) AS b FROM sequences WHERE length(seq) > 0)",
    ),
    "A31_composition": (
        _composition,
        S + "SELECT lang, count(*) AS n, CAST(min(length(seq)) AS INTEGER) AS min_len, CAST(max(length(seq)) AS INTEGER) AS max_len, round(avg(length(seq)), 6) AS mean_len, " + ", ".join(f"CAST(sum(length(seq) - length(replace(seq, '{b}', ''))) AS BIGINT) AS n_{b.lower()}" for b in "ACGU") + " FROM sequences GROUP BY lang",
    ),
    "O10_kmer_counts": (_kmers, S + "SELECT lang, substr(seq, CAST(p AS BIGINT), 4) AS kmer, count(*) AS n FROM (SELECT lang, seq, unnest(range(1, length(seq) - 2)) AS p FROM sequences WHERE length(seq) >= 4) GROUP BY ALL"),
    "J12_same_sequence": (_dedup, S + "SELECT max(seq_id) AS seq_id FROM sequences WHERE length(seq) > 0 GROUP BY seq"),
    "J13_contained_sequences": (
        _contained,
        S + "SELECT DISTINCT a.seq_id FROM sequences a JOIN sequences b ON length(a.seq) > 0 AND length(a.seq) < length(b.seq) AND contains(b.seq, a.seq)",
    ),
    "O6_longest_first": (
        lambda spark, sf_dir: v.sequences(spark, sf_dir).select("seq_id", F.length("seq").alias("len")).orderBy(F.desc("len"), "seq_id").limit(100),
        S + "SELECT seq_id, CAST(length(seq) AS INTEGER) AS len FROM sequences ORDER BY len DESC, seq_id LIMIT 100",
    ),
}
