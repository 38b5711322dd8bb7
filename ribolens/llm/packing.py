"""Best-fit packing of token sequences with bounds that certify each partition."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribolens.llm.bytetext import chunks
from ribolens.llm.shared import key_and_text, small_batches, written

CAPACITY = 4096
#: Pieces that one task packs.
PART_PIECES = 20_000
#: Rounds in which partitions with gaps exchange pieces.
ROUNDS = 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids plus end_id; only those longer than capacity are cut, into pieces of capacity ids.

    A null or empty text is one piece that holds end_id alone. Repeated rows give repeated pieces. Null keys stay null.
    """
    from zlib import crc32

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ribolens.llm.wordpieces import encoder  # the worker's own module, which keeps its words from task to task

        words = encoder(tokenizer)
        for batch in batches:
            for low, high, _, _ in chunks(batch.column(1)):
                keys, texts = (batch.column(c).slice(low, high - low).to_pylist() for c in (0, 1))
                rows = []
                for k, ids in zip(keys, words.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for n, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        rows.append((k, n, at, len(part), crc32(part.tobytes()), part.tolist() if with_ids else None)[: 6 if with_ids else 5])
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds)], names[: len(rows[0])])

    small_batches(docs.sparkSession)
    return key_and_text(docs, key, text).mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing of these lengths needs: the best of some dual feasible functions.

    f maps lengths to [0, capacity] so that no bin's values can sum to over capacity; hence sum(f) / capacity bounds
    the bins from below. Used are the identity, the threshold functions (over capacity - t counts whole, under t
    counts nothing; t up to half the capacity) and the rounding functions floor((k + 1) x / capacity) / k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    mass, many = np.cumsum(count * size), np.cumsum(count)
    for t in range(1, capacity // 2 + 1):
        whole = many[capacity] - many[capacity - t]
        middle = mass[capacity - t] - mass[t - 1]
        best = max(best, int(whole) + -(-int(middle) // capacity))
    for k in range(1, 21):
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, size * k, (k + 1) * size // capacity * capacity)  # times k / capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best fit in decreasing order: bin and offset of each length, and the number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the sorted keys of room
    bins = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b, left = bins, capacity
            bins += 1
        else:
            left = rooms[at]
            b = room[left].pop()
            if not room[left]:
                del room[left]
                rooms.pop(at)
        bin_of[i], offset[i] = b, capacity - left
        left -= n
        if left:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append(b)
    return bin_of, offset, bins


def pack(items: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, part_pieces: int = PART_PIECES) -> DataFrame:
    """items (with columns doc_id, piece, length, ...) with sequence_id long and offset long.

    Pieces are dealt at random over partitions of about part_pieces; each is packed by best fit decreasing and
    compared with its lower bound. Partitions that don't meet the bound are repacked, with their pieces dealt anew
    among them, for ``rounds`` rounds; a round's packing is taken only if it uses fewer bins in all. The bins of
    certified partitions stay. Repeated rows are packed each on its own. Empty input gives an empty result.
    Full pieces fill a sequence alone. Sequence ids are numbers without meaning.
    """
    spark = items.sparkSession
    placed_cols = ["__uid", "__part", "sequence_id", "offset", "__bins", "__bound"]
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    rows = written(items.select(*kept).withColumn("__uid", F.monotonically_increasing_id()), "pack-items")
    small = rows.select("__uid", F.col("length").cast("long").alias("length")).where(F.col("length") < capacity)
    total = small.count()
    parts = max(1, -(-total // part_pieces))

    def pack_part(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy(np.int64)
        bin_of, offset, bins = best_fit(lengths, capacity)
        part = int(group["__part"].iloc[0])
        return pd.DataFrame({"__uid": group["__uid"], "length": lengths, "__part": part, "sequence_id": bin_of, "offset": offset, "__bins": bins, "__bound": lower_bound(lengths, capacity)})

    schema = "__uid long, length long, __part long, sequence_id long, offset long, __bins long, __bound long"

    def deal(frame: DataFrame, n: int, seed: int, base: int) -> DataFrame:
        dealt = frame.select("__uid", "length", (F.pmod(F.xxhash64("__uid", F.lit(seed)), F.lit(n)) + base).cast("long").alias("__part"))
        return written(dealt.groupBy("__part").applyInPandas(pack_part, schema), "pack-round")

    def summary(frame: DataFrame) -> tuple[int, int, int, int]:
        per = frame.groupBy("__part").agg(F.max("__bins").alias("b"), F.max("__bound").alias("l"))
        gap = F.when(F.col("b") > F.col("l"), 1).otherwise(0)
        got = per.agg(F.sum("b"), F.sum(gap), F.sum(gap * F.col("b")), F.max("__part")).first()
        return tuple(int(x or 0) for x in got)

    done = None
    base = 0
    current = deal(small, parts, 0, base)
    bins, with_gap, gap_bins, _ = summary(current)
    for turn in range(1, rounds + 1):
        if not with_gap:
            break
        certified, open_part = current.where("__bins = __bound"), current.where("__bins > __bound")
        base += parts
        again = deal(open_part, max(1, with_gap - turn % 2), turn, base)
        new_bins, new_gap, new_gap_bins, _ = summary(again)
        if new_bins >= gap_bins:
            continue
        done = certified if done is None else done.unionByName(certified)
        current, with_gap, gap_bins = again, new_gap, new_gap_bins
    packed = current if done is None else done.unionByName(current)
    wide = F.col("__part") * F.lit(1 << 32) + F.col("sequence_id")
    packed = packed.select("__uid", wide.alias("sequence_id"), "offset")
    whole = rows.where(F.col("length") >= capacity).select("*", (-1 - F.col("__uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = rows.where(F.col("length") < capacity).join(packed, "__uid").select(whole.columns).unionByName(whole)
    return out.drop("__uid")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
