"""Candidate files: a name line ``>sequence_candidate_start_stop energy``, the residues, and their structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def candidate_lines(rows: DataFrame) -> DataFrame:
    """(value): a record of three lines of rows(seq_id, cand_id, start, stop, energy, seq, ss). Rows with a null are left out,
    since the form has no place for it; energies have six decimals."""
    head = F.concat(F.lit(">"), F.concat_ws("_", "seq_id", "cand_id", "start", "stop"), F.lit(" "), F.format_string("%.6f", F.col("energy").cast("double")))
    return rows.dropna(subset=["seq_id", "cand_id", "start", "stop", "energy", "seq", "ss"]).select(F.concat_ws("\n", head, "seq", "ss").alias("value"))


def write_candidates(rows: DataFrame, path: str) -> None:
    candidate_lines(rows).write.text(path)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, cand_id, start, stop, energy, seq, ss, good) of candidate files. Records are split by Spark's text source at "\\n>".
    good: the name line has all its numbers, and residues and structure are there and as long as each other; what is missing is
    null. A file for many sequences and one for a set of seeds look alike."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    lines = F.split(F.regexp_replace("value", r"^>|\n+$", ""), "\n")
    head = raw.select(F.get(lines, F.lit(0)).alias("head"), F.trim(F.get(lines, F.lit(1))).alias("seq"), F.trim(F.get(lines, F.lit(2))).alias("ss"))
    part = lambda n: F.expr(f"try_cast(nullif(regexp_extract(head, '^(-?[0-9]+)_(-?[0-9]+)_(-?[0-9]+)_(-?[0-9]+)[ \\\\t]+([-+.0-9eE]+)', {n}), '') AS {'double' if n == 5 else 'long'})")
    names = ("seq_id", "cand_id", "start", "stop", "energy")
    rows = head.select(*[part(n).alias(c) for n, c in enumerate(names, 1)], "seq", "ss")
    whole = F.coalesce(F.length("seq") == F.length("ss"), F.lit(False))
    for c in names:
        whole = whole & F.col(c).isNotNull()
    return rows.withColumn("good", whole)
