"""What several operators need: written intermediate tables, sized joins, column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ribolens.session import shared_dir, written

__all__ = ["key_and_text", "shared_dir", "sized", "small_batches", "unused", "written"]

#: Rows of an Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of a join side that is broadcast; their count is taken first, and a larger side is shuffled.
BROADCAST_ROWS = 200_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has ``rows`` rows at most (they must be short ones), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows and bytes from here on, since a row can be a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def key_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only (doc_id long, text string); a null text is the empty text. Extra columns, whatever their names, are left out."""
    return docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
