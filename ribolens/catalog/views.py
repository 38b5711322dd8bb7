"""Sequence, alignment, hit and annotation tables derived from the driver's tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribolens.functions.sequence import gapped, residues
from ribolens.operators.alignment import cells
from ribolens.session import table

WIDTH = 60
#: The consensus structure of each derived alignment: columns i and WIDTH + 1 - i pair for i up to STEM.
STEM = 25


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq_id"), "lang", "source", residues(F.col("text")).alias("seq"))


def degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that keep the IUPAC letters."""
    kept = F.translate(F.upper(F.regexp_replace("text", "[^ACGTURYMKSWHBVDNacgturymkswhbvdn]", "")), "T", "U")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), kept.alias("seq"))


def alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, cut into blocks of WIDTH characters: the blocks with one number of all texts of a language and source
    are an alignment. Characters other than nucleotides are gaps, and fill up last blocks."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    # texts are cleaned whole, character by character, and cut in one pass
    parts = F.posexplode(F.regexp_extract_all(gapped(F.col("text")), F.lit(f".{{1,{WIDTH}}}"), F.lit(0))).alias("block", "part")
    rows = docs.where(F.length("text") > 0).join(labels, "doc_id", "left").select("doc_id", "lang", "source", "quality", parts)
    return rows.select(
        F.concat_ws(":", "lang", "source", "block").alias("msa_id"), F.col("doc_id").alias("seq_id"), F.rpad("part", WIDTH, "-").alias("aseq"), (0.5 + 0.5 * F.coalesce("quality", F.lit(0))).alias("weight")
    )


def alignment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(alignment_rows(spark, sf_dir))


#: The pairs of columns of that structure.
STRUCTURE = [(i, WIDTH + 1 - i) for i in range(1, STEM + 1)]


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("event_id") % 500).alias("start")
    stop = (F.col("event_id") % 500 + 10 + F.col("event_id") % 40).alias("stop")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("hit_id"), F.col("user_id").alias("seq_id"), start, stop, F.col("value").alias("score"))


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    start = F.col("l_partkey") % 500
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("r_hit_id"), F.col("l_suppkey").alias("seq_id"), start.alias("r_start"), (start + F.col("l_quantity").cast("long")).alias("r_stop"))


SEQUENCES = "sequences AS (SELECT doc_id AS seq_id, lang, source, translate(upper(regexp_replace(text, '[^ACGTUacgtu]', '', 'g')), 'T', 'U') AS seq FROM documents)"
DEGENERATE = "degenerate AS (SELECT doc_id AS seq_id, translate(upper(regexp_replace(text, '[^ACGTURYMKSWHBVDNacgturymkswhbvdn]', '', 'g')), 'T', 'U') AS seq FROM documents)"
ROWS = f"""aln AS (SELECT concat_ws(':', lang, source, block) AS msa_id, doc_id AS seq_id,
  rpad(translate(upper(regexp_replace(substr(text, CAST(block * {WIDTH} + 1 AS BIGINT), {WIDTH}), '[^ACGTUacgtu]', '-', 'g')), 'T', 'U'), {WIDTH}, '-') AS aseq, 0.5::DOUBLE + 0.5::DOUBLE * coalesce(quality, 0) AS weight
  FROM (SELECT *, unnest(range(0, (length(text) + {WIDTH - 1}) // {WIDTH})) AS block FROM documents) LEFT JOIN labels USING (doc_id))"""
CELLS = f"{ROWS}, cells AS (SELECT msa_id, seq_id, CAST(col AS INTEGER) AS col, substr(aseq, CAST(col AS INTEGER), 1) AS sym, weight, substr(aseq, CAST(col AS INTEGER), 1) IN ('A','C','G','U') AS res FROM aln, range(1, {WIDTH + 1}) t(col))"
PAIRS = f"""{CELLS}, sides AS (SELECT msa_id, seq_id, CAST(i AS INTEGER) AS i, CAST({WIDTH + 1} - i AS INTEGER) AS j, substr(aseq, CAST(i AS INTEGER), 1) AS "left", substr(aseq, CAST({WIDTH + 1} - i AS INTEGER), 1) AS "right", weight FROM aln, range(1, {STEM + 1}) t(i)),
paired AS (SELECT *, "left" IN ('A','C','G','U') AS lr, "right" IN ('A','C','G','U') AS rr, "left" || "right" IN ('AU','UA','CG','GC','GU','UG') AS canon FROM sides)"""
HITS = "hits AS (SELECT event_id AS hit_id, user_id AS seq_id, event_id % 500 AS start, event_id % 500 + 10 + event_id % 40 AS stop, value AS score FROM events)"
ANNOTATION = "anno AS (SELECT l_orderkey * 10 + l_linenumber AS r_hit_id, l_suppkey AS seq_id, l_partkey % 500 AS r_start, l_partkey % 500 + CAST(l_quantity AS BIGINT) AS r_stop FROM lineitem)"
