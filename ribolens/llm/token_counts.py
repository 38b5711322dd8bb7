"""Token counts of whole texts by compiled transducers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ribolens.llm.bytetext import chunks
from ribolens.llm.shared import key_and_text, small_batches

LIMIT = 4096


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    model is the path of a sentencepiece BPE model on every executor. Counts equal the library's plain encoding. Null
    and empty texts have no tokens. Repeated rows are counted each. Extra columns are left out. No shuffle takes place.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ribolens.llm.transducer import counter  # the worker's own module, which keeps compiled transitions

        pieces = counter(model)
        for batch in batches:
            for low, high, _, offsets in chunks(batch.column(1)):
                n = pieces.count(batch.column(1).slice(low, high - low).to_pylist())
                keys = batch.column(0).slice(low, high - low)
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return key_and_text(docs, key, text).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents under piece_bpe_32k.model."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
