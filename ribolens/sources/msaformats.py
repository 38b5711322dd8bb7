"""Text formats of alignments: texts(msa_id, value) from and to rows(msa_id, ordinal, name, aseq), DataFrame functions only.

A text is one alignment, as one file holds it; ``msa_files`` reads files whole. Names have no blanks and are different within
an alignment. Reading puts ``-`` for every kind of gap and upper case for every residue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats of blocks of lines "name residues", and the lines that aren't such.
SKIPPED = {"stockholm": r"^(#|//)", "pfam": r"^(#|//)", "clustal": r"^CLUSTAL", "selex": r"^#", "psiblast": r"^$", "msf": r"^$"}
FORMATS = (*SKIPPED, "phylip", "phylips", "afa", "a2m")
#: Columns of a line.
WIDTH = 80


def msa_files(spark: SparkSession, path: str) -> DataFrame:
    """texts of files, named by their paths."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("msa_id"), "value")


def residues_of(chunk: Column) -> Column:
    return F.upper(F.translate(F.regexp_replace(chunk, r"\s", ""), "._~", "---"))


def _ordered(parts: DataFrame, by: str = "name") -> DataFrame:
    """Rows from parts(msa_id, nth, name, chunk): a name's chunks in the order of lines; or those of one value of ``by``, which has
    its name in one of them."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "chunk"))), lambda x: x["chunk"]), "")
    name = [] if by == "name" else [F.max("name").alias("name")]
    rows = parts.groupBy("msa_id", by).agg(F.min("nth").alias("ordinal"), joined.alias("aseq"), *name)
    return rows.select("msa_id", "ordinal", "name", residues_of(F.col("aseq")).alias("aseq"))


def _read_blocks(texts: DataFrame, skipped: str) -> DataFrame:
    lines = texts.select("msa_id", F.posexplode(F.split("value", r"\r?\n")).alias("nth", "line"))
    pattern = r"^(\S+)\s+(\S.*)$"
    lines = lines.where(F.col("line").rlike(pattern) & ~F.col("line").rlike(skipped))
    return _ordered(lines.select("msa_id", "nth", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("chunk")))


def _read_phylip(texts: DataFrame, sequential: bool) -> DataFrame:
    """Names take ten characters. Interleaved: further blocks have no names. Sequential: a sequence's further lines begin
    with a blank."""
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    held = texts.select("msa_id", F.regexp_extract("value", r"^\s*(\d+)", 1).cast("int").alias("n"), lines.alias("lines"))
    body = held.select("msa_id", "n", F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("nth", "line"))
    if sequential:
        first = ~F.col("line").startswith(" ")
        from pyspark.sql import Window

        owner = F.max(F.when(first, F.col("nth"))).over(Window.partitionBy("msa_id").orderBy("nth"))
    else:
        first, owner = F.col("nth") < F.col("n"), F.col("nth") % F.col("n")
    chunk = F.when(first, F.substring("line", 11, 1 << 30)).otherwise(F.col("line"))
    return _ordered(body.select("msa_id", "nth", owner.alias("owner"), F.when(first, F.trim(F.substring("line", 1, 10))).alias("name"), chunk.alias("chunk")), "owner")


def _read_fasta(texts: DataFrame) -> DataFrame:
    records = F.filter(F.split(F.concat(F.lit("\n"), "value"), r"\r?\n>"), lambda x: F.trim(x) != "")
    each = texts.select("msa_id", F.posexplode(records).alias("ordinal", "record"))
    body = F.substr("record", F.locate("\n", "record"))
    return each.select("msa_id", "ordinal", F.regexp_extract("record", r"^(\S+)", 1).alias("name"), residues_of(body).alias("aseq"))


def read_msa(texts: DataFrame, form: str) -> DataFrame:
    """rows of texts in one of FORMATS."""
    if form in ("phylip", "phylips"):
        return _read_phylip(texts, form == "phylips")
    if form in ("afa", "a2m"):
        return _read_fasta(texts)
    if form == "msf":  # the blocks stand after the line of two slashes
        texts = texts.withColumn("value", F.substring_index("value", "\n//\n", -1))
    return _read_blocks(texts, SKIPPED[form])


def guess_format(value: Column) -> Column:
    """The format of a text by its beginning; null if none fits."""
    return (
        F.when(value.startswith("# STOCKHOLM"), "stockholm").when(value.startswith("CLUSTAL"), "clustal").when(value.rlike(r"^(!!|PileUp)|MSF:"), "msf").when(value.startswith(">"), "afa").when(value.rlike(r"^\s*\d+\s+\d+\s*\n"), "phylip").when(value.rlike(r"^(#.*\n)*\S+ +\S"), "selex")
    )


def _gathered(rows: DataFrame) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("ordinal", "name", "aseq")))  # an alignment is one text
    return rows.groupBy("msa_id").agg(held.alias("rows"), F.max(F.length("aseq")).alias("alen"), F.max(F.length("name")).alias("wide"))


def _blocks(width: int, gap: str = "-", named: bool = True) -> Column:
    """All rows in blocks of ``width`` columns, or without names."""
    start = lambda b: b * width + 1
    chunk = lambda r, b: F.translate(F.substr(r["aseq"], start(b), F.lit(width)), "-", gap)
    line = lambda r, b: F.concat(F.rpad(r["name"], F.col("wide") + 2, F.lit(" ")), chunk(r, b)) if named else chunk(r, b)
    count = F.greatest(F.ceil(F.col("alen") / width), F.lit(1)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.array_join(F.transform("rows", lambda r: line(r, b)), "\n")), "\n\n")


def write_msa(rows: DataFrame, form: str, width: int = WIDTH) -> DataFrame:
    """texts of rows in one of FORMATS. Of A2M all columns are match columns; PHYLIP names are cut to ten characters."""
    held, n = _gathered(rows), F.size("rows").cast("string")
    each = lambda line: F.array_join(F.transform("rows", line), "\n")
    size = F.concat(F.lit(" "), n, F.lit(" "), F.col("alen").cast("string"), F.lit("\n"))
    ten = lambda r: F.rpad(F.substring(r["name"], 1, 10), 10, " ")
    msf_name = lambda r: F.concat(F.lit(" Name: "), r["name"], F.lit("  Len: "), F.col("alen").cast("string"), F.lit("  Check: 0  Weight: 1.00"))
    value = {
        "stockholm": lambda: F.concat(F.lit("# STOCKHOLM 1.0\n#=GF ID "), "msa_id", F.lit("\n\n"), _blocks(width), F.lit("\n//\n")),
        "pfam": lambda: F.concat(F.lit("# STOCKHOLM 1.0\n#=GF ID "), "msa_id", F.lit("\n\n"), each(lambda r: F.concat(F.rpad(r["name"], F.col("wide") + 2, F.lit(" ")), r["aseq"])), F.lit("\n//\n")),
        "clustal": lambda: F.concat(F.lit("CLUSTAL multiple sequence alignment\n\n\n"), _blocks(width), F.lit("\n")),
        "selex": lambda: F.concat(F.lit("# SELEX\n\n"), _blocks(width, "."), F.lit("\n")),
        "psiblast": lambda: F.concat(_blocks(width), F.lit("\n")),
        "msf": lambda: F.concat(F.lit("!!NA_MULTIPLE_ALIGNMENT 1.0\n\n "), "msa_id", F.lit("  MSF: "), F.col("alen").cast("string"), F.lit("  Type: N  Check: 0  ..\n\n"), each(msf_name), F.lit("\n\n//\n"), _blocks(width, "."), F.lit("\n")),
        "phylip": lambda: F.concat(size, each(lambda r: F.concat(ten(r), F.substr(r["aseq"], F.lit(1), F.lit(width)))), F.when(F.col("alen") > width, F.concat(F.lit("\n\n"), _rest(width))).otherwise(""), F.lit("\n")),
        "phylips": lambda: F.concat(size, each(lambda r: F.concat(ten(r), F.regexp_replace(F.substr(r["aseq"], F.lit(1)), f"(.{{{width}}})(?=.)", "$1\n ")))),
        "afa": lambda: F.concat(each(lambda r: F.concat(F.lit(">"), r["name"], F.lit("\n"), F.regexp_replace(r["aseq"], f"(.{{{width}}})(?=.)", "$1\n"))), F.lit("\n")),
        "a2m": lambda: F.concat(each(lambda r: F.concat(F.lit(">"), r["name"], F.lit("\n"), F.upper(r["aseq"]))), F.lit("\n")),
    }[form]()
    return held.select("msa_id", value.alias("value"))


def _rest(width: int) -> Column:
    """The blocks after the first, without names."""
    chunk = lambda r, b: F.substr(r["aseq"], b * width + 1, F.lit(width))
    count = F.greatest(F.ceil(F.col("alen") / width), F.lit(2)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), count - 1), lambda b: F.array_join(F.transform("rows", lambda r: chunk(r, b)), "\n")), "\n\n")
