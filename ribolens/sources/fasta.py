"""FASTA in and out: splittable text scans, one row a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(acc, desc, seq) of FASTA files. Records are split by Spark's text source at "\\n>"; blanks in sequences go."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    record = F.regexp_replace("value", r"^>", "")
    head = F.substring_index(record, "\n", 1)
    body = F.when(F.instr(record, "\n") > 0, F.substr(record, F.instr(record, "\n") + 1)).otherwise("")
    parts = raw.select(F.regexp_extract(head, r"^(\S*)", 1).alias("acc"), F.trim(F.regexp_extract(head, r"^\S*\s*(.*)$", 1)).alias("desc"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return parts.where("acc <> ''")


def fasta_lines(rows: DataFrame, width: int = 60) -> DataFrame:
    """(value): a record of rows(acc, desc, seq) as text; records without a sequence are left out."""
    folded = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    head = F.rtrim(F.concat_ws(" ", F.concat(F.lit(">"), "acc"), "desc"))
    return rows.where("seq <> ''").select(F.concat(head, F.lit("\n"), folded).alias("value"))


def write_fasta(rows: DataFrame, path: str, width: int = 60) -> None:
    fasta_lines(rows, width).write.text(path)
