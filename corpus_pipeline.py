"""The corpus pipeline: STAGES over documents, each a call of one operator of ribolens.llm.

A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All stages but
the last return the columns of documents. Each takes null, empty, very long and repeated texts as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribolens.llm.decontamination import contaminated
from ribolens.llm.line_dedup import drop_recurring_lines
from ribolens.llm.near_dedup import keep_one
from ribolens.llm.packing import pack, pieces
from ribolens.llm.quality import fit, resample
from ribolens.llm.shared import sized, unused, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the importance resampling draws."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weight, drawn = unused(docs, "log_weight"), unused(docs, "selected")
    return resample(docs, model, weight=weight, selected=drawn).where(F.col(drawn)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those that had other lines only are gone. n_chars is counted anew."""
    columns, total, dropped = docs.columns, unused(docs, "n_lines"), unused(docs, "n_dropped")
    rest = drop_recurring_lines(docs, total=total, dropped=dropped).where((F.col(dropped) == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in columns:
        rest = rest.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rest.select(columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a window like a benchmark item. Of rows with one doc_id, or none, only those whose own text
    has such a window are gone."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_text=True).select("doc_id", "version").distinct()
    own, version = unused(docs, "gone"), unused(docs, "version")
    gone = written(found.withColumnsRenamed({"doc_id": own, "version": version}), "contaminated")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(docs["text"].cast("string")) == F.col(version))
    return docs.join(sized(gone), same, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its place in a sequence."""
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Draws, signatures and packing go beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
