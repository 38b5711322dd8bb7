"""Text formats of unaligned sequences: records(value) from and to rows(name, desc, seq), DataFrame functions only.

A record is one sequence; ``record_files`` splits files into records while it reads them, so large files are read in parts.
Reading drops digits, blanks and end marks from sequences and puts them into upper case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a record of each format in a file.
SEPARATORS = {"fasta": "\n>", "embl": "\n//\n", "uniprot": "\n//\n", "genbank": "\n//\n", "pir": "\n>", "ig": "\n;", "gcg": "\n!!"}


def record_files(spark: SparkSession, path: str, form: str) -> DataFrame:
    raw = spark.read.option("lineSep", SEPARATORS[form]).text(path)
    mark = {"fasta": ">", "pir": ">", "ig": ";", "gcg": "!!"}.get(form, "")
    value = F.when(F.col("value").startswith(mark), F.col("value")).otherwise(F.concat(F.lit(mark), "value")) if mark else F.col("value")
    return raw.where(F.trim("value") != "").select(value.alias("value"))


def _line(tag: str, rest: str = r"(.*)") -> Column:
    return F.regexp_extract("value", rf"(?m)^{tag}\s+{rest}", 1)


def _after(pattern: str) -> Column:
    """What stands after the line that the pattern begins."""
    return F.regexp_extract("value", rf"(?s)(?:^|\n){pattern}[^\n]*\n(.*)$", 1)


def read_sequences(records: DataFrame, form: str) -> DataFrame:
    """rows of records in one of the formats of SEPARATORS."""
    name, desc, body = {
        "fasta": lambda: (F.regexp_extract("value", r"^>\s*(\S+)", 1), F.regexp_extract("value", r"^>\s*\S+[ \t]*([^\n]*)", 1), _after(">")),
        "embl": lambda: (_line("ID", r"([^\s;]+)"), _line("DE"), _after("SQ")),
        "uniprot": lambda: (_line("ID", r"([^\s;]+)"), _line("DE"), _after("SQ")),
        "genbank": lambda: (_line("LOCUS", r"(\S+)"), _line("DEFINITION"), _after("ORIGIN")),
        "pir": lambda: (F.regexp_extract("value", r"^>[A-Z0-9]{2};\s*(\S+)", 1), F.regexp_extract("value", r"^>[^\n]*\n([^\n]*)", 1), F.regexp_extract("value", r"(?s)^>[^\n]*\n[^\n]*\n([^*]*)", 1)),
        "ig": lambda: (F.regexp_extract("value", r"(?m)^([^;\s][^\n]*?)\s*$", 1), F.regexp_extract("value", r"^;[ \t]*([^\n]*)", 1), F.regexp_extract("value", r"(?s)^(?:;[^\n]*\n)+[^\n]*\n([^12]*)", 1)),
        "gcg": lambda: (F.regexp_extract("value", r"(?m)^\s*(\S+)\s+Length:", 1), F.regexp_extract("value", r"^!![^\n]*\n([^\n]*)", 1), F.regexp_extract("value", r"(?s)\.\.[^\n]*\n(.*)$", 1)),
    }[form]()
    seq = F.upper(F.regexp_replace(body, r"[\s0-9*]|//", ""))
    return records.select(name.alias("name"), F.trim(desc).alias("desc"), seq.alias("seq")).where("name <> ''")


def write_sequences(rows: DataFrame, form: str, width: int = 60) -> DataFrame:
    """records of rows(name, desc, seq), each with its end where the format has one."""
    folded = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    indented = F.concat(F.lit("     "), F.regexp_replace(folded, "\n", "\n     "))
    size = F.length("seq").cast("string")
    lit = F.lit
    value = {
        "fasta": lambda: F.concat(lit(">"), "name", lit(" "), "desc", lit("\n"), folded),
        "embl": lambda: F.concat(lit("ID   "), "name", lit("; SV 1; linear; RNA; "), size, lit(" BP.\nDE   "), "desc", lit("\nSQ   Sequence "), size, lit(" BP;\n"), indented, lit("\n//")),
        "uniprot": lambda: F.concat(lit("ID   "), "name", lit("   Reviewed; "), size, lit(" AA.\nDE   "), "desc", lit("\nSQ   SEQUENCE   "), size, lit(" AA;\n"), indented, lit("\n//")),
        "genbank": lambda: F.concat(lit("LOCUS       "), "name", lit(" "), size, lit(" bp RNA\nDEFINITION  "), "desc", lit("\nORIGIN\n"), indented, lit("\n//")),
        "pir": lambda: F.concat(lit(">P1;"), "name", lit("\n"), "desc", lit("\n"), folded, lit("*")),
        "ig": lambda: F.concat(lit("; "), "desc", lit("\n"), "name", lit("\n"), folded, lit("1")),
        "gcg": lambda: F.concat(lit("!!NA_SEQUENCE 1.0\n"), "desc", lit("\n\n  "), "name", lit("  Length: "), size, lit("  Type: N  Check: 0  ..\n\n"), folded),
    }[form]()
    return rows.select(value.alias("value"))


def guess_format(value: Column) -> Column:
    """The format of a record by its beginning; null if none fits."""
    uniprot = value.rlike(r"^ID .*\bAA\.")
    return (
        F.when(value.rlike(r"^>[A-Z0-9]{2};"), "pir").when(value.startswith(">"), "fasta").when(uniprot, "uniprot").when(value.startswith("ID "), "embl").when(value.startswith("LOCUS "), "genbank").when(value.startswith(";"), "ig").when(value.startswith("!!"), "gcg")
    )
