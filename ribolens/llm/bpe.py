"""Byte-level BPE of whole texts as DataFrame operators: encoding to ids and decoding to bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ribolens.llm.bytepairs import PATTERN, library_classes
from ribolens.llm.bytetext import CHUNK, chunks
from ribolens.llm.shared import key_and_text, small_batches


def encode(docs: DataFrame, ranks: str, pattern: str = PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, ids array<int>): each row's ids, as the library gives them without special tokens.

    ranks is the path of a rank file on every executor. Null and empty texts have no ids, repeated rows are encoded each,
    null keys stay null, extra columns are left out. No shuffle takes place; a very long text is encoded in cuts. Another
    pattern than PATTERN is a ValueError.
    """
    if pattern != PATTERN:
        raise ValueError(f"not the pattern of the rank files: {pattern}")
    classes = library_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ribolens.llm.bytepairs import codec  # the worker's own module, which keeps what it has met

        known = codec(ranks, classes)
        for batch in batches:
            for low, high, buf, offsets in chunks(batch.column(1), CHUNK // 2):
                if len(buf) > CHUNK:
                    ids = known.encode_long(buf)
                    at = np.where(offsets > 0, len(ids), 0)  # a chunk of more than its limit is one row
                else:
                    ids, at = known.encode(buf, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return key_and_text(docs, key, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the bytes of their ids as a binary column ``out``, in place of any of that name. Null ids have null bytes,
    none are empty bytes; an id that the rank file lacks is an error."""
    kept, classes = rows.drop(out), library_classes()
    at_ids = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ribolens.llm.bytepairs import codec

        known = codec(ranks, classes)  # the one that encodes, if it is there
        for batch in batches:
            held = batch.column(at_ids)
            flat, ends = held.flatten().to_numpy(zero_copy_only=False), np.cumsum(held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            data = known.decode(flat).tobytes()
            bytes_to = np.concatenate([[0], np.cumsum(known.sizes(flat))])[np.concatenate([[0], ends]).astype(np.int64)].tolist()
            got = [data[x:y] if valid else None for x, y, valid in zip(bytes_to, bytes_to[1:], held.is_valid().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*batch.schema.names, out])

    small_batches(rows.sparkSession)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents to ids of byte_bpe_50k.tiktoken and back."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, public_tokenizers.PATTERN), ranks)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
