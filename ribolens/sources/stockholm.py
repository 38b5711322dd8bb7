"""Stockholm alignments in and out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS = "msa_id string, ordinal int, seq_id string, weight double, start int, stop int, score double, aseq string, ss string"


def line_kind(line: Column) -> Column:
    """gf, gc, gs, gr, sequence, end, blank or comment."""
    kind = F.when(F.trim(line) == "", "blank").when(line.startswith("//"), "end")
    for tag in ("GF", "GC", "GS", "GR"):
        kind = kind.when(line.startswith(f"#={tag} "), tag.lower())
    return kind.when(line.startswith("#"), "comment").otherwise("sequence")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(msa_id, nth, line, kind): the lines of the alignments of files, one or several a file, compressed or not; msa_id is
    the alignment's GF ID, or the file and a number where there is none."""
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    own = F.nullif(F.regexp_extract("value", r"(?m)^#=GF ID\s+(\S+)", 1), F.lit(""))
    record = raw.where(F.col("value").rlike(r"\S")).withColumn("msa_id", F.coalesce(own, F.concat_ws("#", "file", "at")))
    split = record.select("msa_id", F.posexplode(F.split("value", "\n")).alias("nth", "line"))
    return split.select("msa_id", "nth", F.rtrim("line").alias("line")).withColumn("kind", line_kind(F.col("line"))).where("kind NOT IN ('blank', 'end')")


def read_stockholm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows and column annotation of alignments.

    rows(msa_id, ordinal, seq_id, weight, start, stop, score, aseq, ss): blocks of a sequence are joined in file order; weight
    from GS WT (1 where absent), start, stop, score from GS DE "a..b<TAB>score", ss from GR SS.
    columns(msa_id, tag, value): GC lines, joined too.
    """
    parsed = lines(spark, path)
    line = F.col("line")
    word = lambda n: F.element_at(F.split(line, r"\s+", 5), n)
    joined = lambda value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", value.alias("v")))), lambda x: x["v"]), "")
    seqs = parsed.where("kind = 'sequence'").groupBy("msa_id", word(1).alias("seq_id")).agg(F.min("nth").alias("first"), joined(word(2)).alias("aseq"))
    seqs = seqs.withColumn("ordinal", F.row_number().over(Window.partitionBy("msa_id").orderBy("first")))
    structure = parsed.where("kind = 'gr'").where(word(3) == "SS").groupBy("msa_id", word(2).alias("seq_id")).agg(joined(word(4)).alias("ss"))
    rest = F.regexp_extract(line, r"^#=GS\s+\S+\s+\S+\s+(.*)$", 1)
    place = r"^(\d+)\s*\.\.\s*(\d+)(?:\s+(\S+))?"
    tags = parsed.where("kind = 'gs'").groupBy("msa_id", word(2).alias("seq_id")).agg(
        F.max(F.when(word(3) == "WT", F.try_to_number(rest, F.lit("S999999999D999999999")).cast("double"))).alias("weight"), F.max(F.when(word(3) == "DE", rest)).alias("de")
    )
    part = lambda n, kind: F.when(F.col("de").rlike(place), F.nullif(F.regexp_extract("de", place, n), F.lit("")).try_cast(kind))
    rows = seqs.join(structure, ["msa_id", "seq_id"], "left").join(tags, ["msa_id", "seq_id"], "left")
    rows = rows.select("msa_id", "ordinal", "seq_id", F.coalesce("weight", F.lit(1.0)).alias("weight"), part(1, "int").alias("start"), part(2, "int").alias("stop"), part(3, "double").alias("score"), "aseq", "ss")
    columns = parsed.where("kind = 'gc'").groupBy("msa_id", word(2).alias("tag")).agg(joined(word(3)).alias("value"))
    return rows, columns


def accepted(columns: DataFrame, accept: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """columns(msa_id, tag, value) with tags of ``accept`` alone, if it is given, and without those of ``ignore``."""
    kept = columns.where(F.col("tag").isin(accept)) if accept is not None else columns
    return kept.where(~F.col("tag").isin(ignore)) if ignore else kept


def placed(rows: DataFrame, name: str) -> DataFrame:
    """rows with acc, start, stop (start <= stop) and strand of names "acc/first-last"; first is larger on the reverse strand.
    All are null where the name has no such form."""
    part = lambda n: F.nullif(F.regexp_extract(name, r"^(\S+)/(\d+)-(\d+)$", n), F.lit(""))
    first, last = part(2).cast("long"), part(3).cast("long")
    return rows.withColumns({"acc": part(1), "start": F.least(first, last), "stop": F.greatest(first, last), "strand": F.when(first <= last, 1).when(first > last, -1)})


def stockholm_text(rows: DataFrame, columns: DataFrame, width: int = 80) -> DataFrame:
    """(msa_id, value): each alignment as a Stockholm text in blocks of ``width`` columns."""
    # new column identities, since both may come from the same lines
    rows, columns = (t.select([F.col(c).alias(c) for c in t.columns]) for t in (rows, columns))
    members = F.array_sort(F.collect_list(F.struct("ordinal", "seq_id", "weight", "start", "stop", "score", "aseq", "ss")))  # an alignment is one text
    # names are measured where rows are gathered: what a text's lines share mustn't be worked out for each of them
    longest = F.max(F.when(F.col("ss").isNotNull() & F.col("seq_id").isNotNull(), F.length("seq_id") + 8).otherwise(F.length("seq_id")))
    held = rows.groupBy("msa_id").agg(members.alias("rows"), F.max(F.length("aseq")).alias("alen"), longest.alias("longest_row"))
    noted = columns.groupBy("msa_id").agg(F.array_sort(F.collect_list(F.struct("tag", "value"))).alias("notes"), F.max(F.length("tag") + 5).alias("longest_note"))
    both = held.join(noted, "msa_id", "left")
    weights = F.transform("rows", lambda r: F.concat(F.lit("#=GS "), r["seq_id"], F.lit(" WT "), r["weight"].cast("string")))
    placed = F.filter("rows", lambda r: r["start"].isNotNull() & r["stop"].isNotNull())
    places = F.transform(placed, lambda r: F.concat(F.lit("#=GS "), r["seq_id"], F.lit(" DE "), r["start"].cast("string"), F.lit(".."), r["stop"].cast("string"), F.lit("\t"), F.coalesce(r["score"], F.lit(0.0)).cast("string")))
    line = lambda name, text: F.struct(name.alias("name"), text.alias("text"))
    own = lambda r: F.array_compact(F.array(line(r["seq_id"], r["aseq"]), F.when(r["ss"].isNotNull(), line(F.concat(F.lit("#=GR "), r["seq_id"], F.lit(" SS")), r["ss"]))))
    notes = F.coalesce("notes", F.array().cast("array<struct<tag:string,value:string>>"))
    body = F.concat(F.flatten(F.transform("rows", own)), F.transform(notes, lambda n: line(F.concat(F.lit("#=GC "), n["tag"]), n["value"])))
    both = both.select("msa_id", "alen", F.greatest("longest_row", "longest_note").alias("longest"), F.concat(weights, places).alias("tags"), body.alias("body"))
    cut = lambda b: F.array_join(F.transform("body", lambda x: F.concat(F.rpad(x["name"], F.col("longest") + 1, F.lit(" ")), F.substr(x["text"], b * width + 1, F.lit(width)))), "\n")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("alen") / width), F.lit(1)).cast("int") - 1), cut)
    head = F.concat(F.lit("# STOCKHOLM 1.0\n#=GF ID "), "msa_id", F.lit("\n\n"), F.array_join("tags", "\n"))
    return both.select("msa_id", F.concat(head, F.lit("\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n//")).alias("value"))


def write_stockholm(rows: DataFrame, columns: DataFrame, path: str) -> None:
    stockholm_text(rows, columns).select("value").write.text(path)


def aligned_fasta(rows: DataFrame) -> DataFrame:
    """(msa_id, ordinal, value): a FASTA record with gaps for each sequence."""
    return rows.select("msa_id", "ordinal", F.concat(F.lit(">"), "seq_id", F.lit("\n"), "aseq").alias("value"))


def phylip_text(rows: DataFrame) -> DataFrame:
    """(msa_id, value): sequential PHYLIP, names cut or filled up to ten characters."""
    line = F.concat(F.rpad(F.substring("seq_id", 1, 10), 10, " "), "aseq")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("v")))), lambda x: x["v"]), "\n")
    return rows.groupBy("msa_id").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" "), F.max(F.length("aseq")).cast("string"), F.lit("\n"), body).alias("value"))


def stats_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of lines of Key=value pairs."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.explode(F.regexp_extract_all("value", F.lit(r"(\S+=\S+)"), F.lit(1))).alias("kv"))
    return raw.select("file", F.substring_index("kv", "=", 1).alias("key"), F.substr("kv", F.instr("kv", "=") + 1).alias("value"))


def newick_edges(trees: DataFrame) -> DataFrame:
    """(tree_id, node, parent, name, length) of trees(tree_id, newick): nodes in the order in which they end."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for batch in batches:
            rows = []
            for tree, text in zip(batch["tree_id"], batch["newick"], strict=True):
                open_nodes, ready, number = [[]], None, 0
                for token in re.findall(r"[(),;]|[^(),;\s]+", text or ""):
                    if token == "(":
                        open_nodes.append([])
                    elif token in ",);":
                        if token == ")":
                            open_nodes[-1].append(ready) if ready is not None else None
                            ready = [number, "", None, open_nodes.pop()]
                            number += 1
                        elif ready is not None:
                            open_nodes[-1].append(ready)
                            ready = None
                    else:
                        name, _, size = token.partition(":")
                        if ready is None:
                            ready, number = [number, "", None, []], number + 1
                        ready[1], ready[2] = name, float(size) if size else None
                stack = [(n, None) for n in open_nodes[0]]
                while stack:
                    (n, name, size, below), parent = stack.pop()
                    rows.append((tree, n, parent, name, size))
                    stack.extend((x, n) for x in below)
            out = pd.DataFrame(rows, columns=["tree_id", "node", "parent", "name", "length"])
            yield out.astype({"node": "Int64", "parent": "Int64"})

    return trees.select("tree_id", "newick").mapInPandas(parse, "tree_id long, node long, parent long, name string, length double")
