"""Queries on formats (SC, SK and ST blocks): the derived tables are written in a format and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ribolens.catalog import views as v
from ribolens.catalog.motifs import M, motifs
from ribolens.operators import intervals as iv
from ribolens.session import shared_dir, written
from ribolens.sources import fasta, msaformats, seqformats, stockholm
from ribolens.streaming.hits import sequence_stream

S, R, H = (f"WITH {x} " for x in (v.SEQUENCES, v.ROWS, v.HITS))
_ALIGNED = R + "SELECT msa_id, seq_id, aseq FROM aln"
#: Columns of a block: less than an alignment has, so that sequences are put together again.
BLOCK = 25


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _named(spark, sf_dir):
    rows = v.alignment_rows(spark, sf_dir)
    return rows.select("msa_id", F.col("seq_id").alias("ordinal"), F.col("seq_id").cast("string").alias("name"), "aseq", "weight")


def aligned_in(form):
    def query(spark, sf_dir):
        texts = written(msaformats.write_msa(_named(spark, sf_dir), form, BLOCK), form)
        return msaformats.read_msa(texts, form).select("msa_id", F.col("name").cast("long").alias("seq_id"), "aseq")

    return query


def _sequence_formats(spark, sf_dir):
    """Every sequence in every format: the guessed format, and what is read."""
    rows = v.sequences(spark, sf_dir).where("seq <> ''").select(F.concat(F.lit("s"), "seq_id").alias("name"), "source", "seq")
    rows = rows.select("name", F.concat(F.lit("from "), "source").alias("desc"), "seq")
    out = None
    for form in seqformats.SEPARATORS:
        records = seqformats.write_sequences(rows, form)
        one = seqformats.read_sequences(records, form).select(F.lit(form).alias("form"), "name", "desc", "seq")
        out = one if out is None else out.unionByName(one)
    return out


def _one_format(records):
    """The one format of all records."""
    found = [r[0] for r in records.select(seqformats.guess_format(F.col("value"))).distinct().limit(2).collect()]
    if len(found) != 1 or found[0] is None:
        raise ValueError("records of several formats, or of none")
    return found[0]


def _sequence_files(spark, sf_dir):
    """Every sequence in a file of records: written, split while reading, parsed."""
    rows = v.sequences(spark, sf_dir).where("seq <> ''").select(F.concat(F.lit("s"), "seq_id").alias("name"), F.col("source").alias("desc"), "seq")
    path = _folder(spark, "genbank")
    seqformats.write_sequences(rows, "genbank").write.text(path)
    records = seqformats.record_files(spark, path, "genbank")
    return seqformats.read_sequences(records, _one_format(records)).select("name", "desc", "seq")


def _fasta(spark, sf_dir):
    rows = v.sequences(spark, sf_dir).select(F.col("seq_id").cast("string").alias("acc"), F.col("source").alias("desc"), "seq", "seq_id")
    path = _folder(spark, "fasta")
    fasta.write_fasta(rows.orderBy("seq_id").drop("seq_id"), path)
    return fasta.read_fasta(spark, path).select(F.col("acc").cast("long").alias("seq_id"), F.col("desc").alias("source"), "seq")


def _stockholm(spark, sf_dir, **how):
    """Weights and places too; alignments stand one after the other in compressed files."""
    rows = v.alignment_rows(spark, sf_dir).where("seq_id % 4 < 2")
    start = (F.col("seq_id") % 90 + 1).cast("int")
    rows = rows.select("msa_id", F.col("seq_id").cast("int").alias("ordinal"), F.col("seq_id").cast("string").alias("seq_id"), "weight", start.alias("start"), (start + 59).alias("stop"), (start / 4).alias("score"), "aseq", F.lit(None).cast("string").alias("ss"))
    columns = rows.select("msa_id").distinct().select("msa_id", F.lit("SS_cons").alias("tag"), F.lit("<" * v.STEM + "." * (v.WIDTH - 2 * v.STEM) + ">" * v.STEM).alias("value"))
    path = _folder(spark, "stockholm")
    stockholm.stockholm_text(rows, columns).select("value").write.option("compression", "gzip").text(path)
    return stockholm.read_stockholm(spark, path)


def _stockholm_rows(spark, sf_dir):
    return _stockholm(spark, sf_dir)[0].select("msa_id", F.col("seq_id").cast("long").alias("seq_id"), "weight", "start", "stop", "score", "aseq")


def _stockholm_columns(spark, sf_dir):
    return stockholm.accepted(_stockholm(spark, sf_dir)[1], accept=["SS_cons", "RF"], ignore=["RF"])


def _line_kinds(spark, sf_dir):
    texts = msaformats.write_msa(_named(spark, sf_dir), "stockholm", BLOCK)
    lines = texts.select("msa_id", F.explode(F.split("value", "\n")).alias("line"))
    return lines.groupBy("msa_id", stockholm.line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n")).where("kind <> 'blank'")


def _rfam(spark, sf_dir):
    """Names seq/start-stop, of every other hit on the reverse strand."""
    h = v.hits(spark, sf_dir)
    a, b = F.when(F.col("hit_id") % 2 == 0, F.col("start")).otherwise(F.col("stop")), F.when(F.col("hit_id") % 2 == 0, F.col("stop")).otherwise(F.col("start"))
    named = h.select("hit_id", F.concat("seq_id", F.lit("/"), a, F.lit("-"), b).alias("name"))
    return stockholm.placed(named, "name").select("hit_id", "acc", "start", "stop", "strand")


def _newick(spark, sf_dir):
    """A tree of three leaves for each supplier, as text."""
    from ribolens.session import table

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tree_id"))
    text = F.concat(F.lit("((a"), "tree_id", F.lit(":1,b:"), "tree_id", F.lit(")x:0.5,c:2)root;"))
    return stockholm.newick_edges(s.select("tree_id", text.alias("newick")))


def _stats_lines(spark, sf_dir):
    path = _folder(spark, "stats")
    m = motifs(spark, sf_dir)
    m.select(F.concat(F.lit("motif="), "motif", F.lit(" Num="), F.col("num").cast("long"), F.lit("  Species="), F.col("species").cast("long")).alias("value")).write.text(path)
    pairs = stockholm.stats_lines(spark, path)
    return pairs.where("key <> 'motif'").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def _csv(spark, sf_dir):
    path = _folder(spark, "ranked")
    motifs(spark, sf_dir).select("motif", "family", "num", "species").write.option("header", True).csv(path)
    return spark.read.schema("motif long, family long, num double, species double").option("header", True).csv(path)


def _hit_table(spark, sf_dir):
    """Hits in columns parted by blanks, comments before them, as a table for reading by eye; and read again."""
    h = v.hits(spark, sf_dir).select("hit_id", "seq_id", "start", "stop", F.format_string("%.2f", F.round("score", 2)).alias("score"))
    columns = {"hit_id": 10, "seq_id": 8, "start": 6, "stop": 6, "score": 9}
    line = F.concat_ws(" ", *[F.lpad(F.col(c).cast("string"), n, " ") for c, n in columns.items()])
    path = _folder(spark, "hits")
    h.select(line.alias("value")).unionAll(spark.range(1).select(F.lit("# hit seq start stop score").alias("value"))).write.text(path)
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#"))
    return rows.select(*[parts[n].cast("double" if c == "score" else "long").alias(c) for n, c in enumerate(columns)])


def _both_strands(spark, sf_dir):
    from ribolens.functions.sequence import reverse_complement

    rows = v.sequences(spark, sf_dir).select("seq_id", "seq")
    strands = rows.withColumn("strand", F.lit(1)).unionByName(rows.select("seq_id", reverse_complement(F.col("seq")).alias("seq"), F.lit(-1).alias("strand")))
    keyed = strands.withColumn("seq_id", F.struct("seq_id", "strand"))
    return iv.strand_windows(keyed, 200, 20).select("seq_id.seq_id", "seq_id.strand", "begin", "lead", "window")


def _stream(spark, sf_dir):
    """FASTA files read as a stream, all that are there."""
    source, sink, log = (_folder(spark, f"stream-{n}") for n in ("in", "out", "log"))
    rows = v.sequences(spark, sf_dir).select(F.col("seq_id").cast("string").alias("acc"), F.col("source").alias("desc"), "seq")
    fasta.write_fasta(rows, source)
    query = sequence_stream(spark, source).writeStream.trigger(availableNow=True).option("checkpointLocation", log).format("parquet").start(sink)
    query.awaitTermination()
    return spark.read.parquet(sink).select(F.col("acc").cast("long").alias("seq_id"), "seq")


def _clusters_padded(spark, sf_dir):
    """Merged hits as lines seq start stop, padded by 100 on both sides and to 300 positions at least, from 1 on."""
    merged = iv.merged(v.hits(spark, sf_dir), 2)
    return iv.padded(merged, 100, 300).select("seq_id", "start", "stop", "n")


def _ranges(spark, sf_dir):
    """A file of lines "name start stop", joined to the sequences of those names; lines of other names are left out."""
    path = _folder(spark, "ranges")
    v.hits(spark, sf_dir).select(F.concat_ws(" ", F.concat(F.lit("s"), "seq_id"), "start", "stop").alias("value")).write.text(path)
    parts = F.split("value", r"\s+")
    ranges = spark.read.text(path).select(parts[0].alias("name"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("stop"))
    names = v.sequences(spark, sf_dir).select(F.concat(F.lit("s"), "seq_id").alias("name"), "seq_id", F.length("seq").alias("len"))
    return ranges.join(names, "name").where("start <= len").groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("stop", "len") - F.col("start") + 1).alias("covered"))


_REVERSED = "translate(reverse(seq), 'ACGU', 'UGCA')"
ENTRIES = {
    **{f"SC12_SK5_{form}": (aligned_in(form), _ALIGNED) for form in msaformats.FORMATS},
    "SC8_SC13_SK6_sequence_formats": (
        _sequence_formats,
        S + "SELECT form, 's' || seq_id AS name, 'from ' || source AS \"desc\", seq FROM sequences, (VALUES ('fasta'), ('embl'), ('uniprot'), ('genbank'), ('pir'), ('ig'), ('gcg')) f(form) WHERE seq <> ''",
    ),
    "SK16_converted_files": (_sequence_files, S + "SELECT 's' || seq_id AS name, source AS \"desc\", seq FROM sequences WHERE seq <> ''"),
    "SC1_SK1_fasta": (_fasta, S + "SELECT seq_id, source, seq FROM sequences WHERE seq <> ''"),
    "SC2_SC6_SK2_stockholm": (
        _stockholm_rows,
        R + "SELECT msa_id, seq_id, weight, CAST(seq_id % 90 + 1 AS INTEGER) AS start, CAST(seq_id % 90 + 60 AS INTEGER) AS stop, (seq_id % 90 + 1) / 4.0::DOUBLE AS score, aseq FROM aln WHERE seq_id % 4 < 2",
    ),
    "SC4_accepted_tags": (_stockholm_columns, R + f"SELECT DISTINCT msa_id, 'SS_cons' AS tag, repeat('<', {v.STEM}) || repeat('.', {v.WIDTH - 2 * v.STEM}) || repeat('>', {v.STEM}) AS value FROM aln WHERE seq_id % 4 < 2"),
    "SC5_line_kinds": (
        _line_kinds,
        R + f"""SELECT msa_id, kind, CASE WHEN kind = 'sequence' THEN n * {-(-v.WIDTH // BLOCK)} ELSE 1 END AS n
FROM (SELECT msa_id, count(*) AS n FROM aln GROUP BY msa_id), (VALUES ('comment'), ('gf'), ('sequence'), ('end')) k(kind)""",
    ),
    "SC3_F15_placed_names": (_rfam, H + "SELECT hit_id, CAST(seq_id AS VARCHAR) AS acc, start, stop, CASE WHEN hit_id % 2 = 0 THEN 1 ELSE -1 END AS strand FROM hits"),
    "SC22_newick": (
        _newick,
        """SELECT s_suppkey AS tree_id, node, parent, CASE WHEN name = 'a' THEN 'a' || s_suppkey ELSE name END AS name, CASE WHEN name = 'b' THEN s_suppkey ELSE length END AS length
FROM supplier, (VALUES (0, 2, 'a', 1.0::DOUBLE), (1, 2, 'b', 0.0), (2, 4, 'x', 0.5), (3, 4, 'c', 2.0), (4, NULL, 'root', NULL)) t(node, parent, name, length)""",
    ),
    "SC25_stats_lines": (_stats_lines, M + "SELECT key, CAST(CASE key WHEN 'Num' THEN CAST(num AS BIGINT) ELSE CAST(species AS BIGINT) END AS VARCHAR) AS value, count(*) AS n FROM motifs, (VALUES ('Num'), ('Species')) k(key) GROUP BY ALL"),
    "SK11_ranked_csv": (_csv, M + "SELECT motif, family, num, species FROM motifs"),
    "SK10_hit_table": (_hit_table, H + "SELECT hit_id, seq_id, start, stop, round(score, 2) AS score FROM hits"),
    "SC9_ST2_both_strands": (
        _both_strands,
        S + f""", b AS (SELECT seq_id, strand, s, CAST(unnest(range(0, greatest(length(s), 1), 200)) AS BIGINT) AS begin FROM (SELECT seq_id, 1 AS strand, seq AS s FROM sequences UNION ALL SELECT seq_id, -1, {_REVERSED} FROM sequences) WHERE s <> '')
SELECT seq_id, strand, begin, CAST(least(begin, 20) AS INTEGER) AS lead, substr(s, begin - least(begin, 20) + 1, 200 + least(begin, 20)) AS "window" FROM b""",
    ),
    "ST1_sequence_stream": (_stream, S + "SELECT seq_id, seq FROM sequences WHERE seq <> ''"),
    "SK8_padded_clusters": (
        _clusters_padded,
        H + """, m AS (SELECT *, max(stop) OVER (PARTITION BY seq_id ORDER BY start, stop, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM hits),
g AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY start, stop, hit_id ROWS UNBOUNDED PRECEDING) AS grp FROM m),
u AS (SELECT seq_id, min(start) - 100 AS a, max(stop) + 100 AS b, count(*) AS n FROM g GROUP BY seq_id, grp),
w AS (SELECT seq_id, n, a, b, greatest(300 - (b - a + 1), 0) AS more FROM u)
SELECT seq_id, CAST(greatest(a - more // 2, 1) AS BIGINT) AS start, CAST(b + more - more // 2 AS BIGINT) AS stop, n FROM w""",
    ),
    "SC16_ranges": (_ranges, S + f", {v.HITS} SELECT s.seq_id, count(*) AS n, CAST(sum(least(h.stop, length(seq)) - h.start + 1) AS BIGINT) AS covered FROM hits h JOIN sequences s ON h.seq_id = s.seq_id WHERE h.start <= length(seq) GROUP BY s.seq_id"),
}
