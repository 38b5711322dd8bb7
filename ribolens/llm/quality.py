"""Quality classification by importance resampling over hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ribolens.llm.bytetext import SPACE, WORD, chunks, mix, spans, spans_hash
from ribolens.llm.shared import small_batches, unused, written

#: Buckets of the hashed one- and two-token features. The target counts start with PRIOR features for each bucket on
#: average, dealt as in the raw text, so buckets that the target hardly shows stay near ratio one.
BUCKETS, PRIOR = 10_000, 10.0
#: A log weight is the mean log ratio of SPREAD features; EASED features of ratio one are added to each text.
SPREAD, EASED = 100.0, 20.0
#: Labelled documents that the target model and the cut are fitted on at most, the smallest hashes of doc_id first.
LABELLED = 50_000
SEED = 20240229
#: The ratio of toxic to clean labelled documents counts in how many documents each feature occurs, in finer buckets, with
#: EVEN documents of ratio one added. Features of at least FACTOR times the clean share are kept, and a text is judged by its
#: TELLING largest log ratios: a few words make a long text toxic. LOST: the share of clean held-out documents beyond the
#: cut; PENALTY: what a unit of log ratio beyond the cut takes from the log weight.
FINE_BUCKETS, EVEN, FACTOR, TELLING, LOST, PENALTY = 1 << 20, 2.0, 2.0, 3, 0.005, 100.0


def hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of the one- and two-token features. Tokens are runs of word bytes, or of other bytes but
    white space; case counts."""
    word = WORD[buf]
    starts, ends, row = spans(word, offsets)
    starts2, ends2, row2 = spans(~word & ~SPACE[buf], offsets)
    starts, ends, row = (np.concatenate(x) for x in ((starts, starts2), (ends, ends2), (row, row2)))
    order = np.argsort(starts, kind="stable")
    row = row[order]
    single = spans_hash(buf, starts[order], ends[order])
    pair = mix(single[:-1] * np.uint64(3) + single[1:])[row[:-1] == row[1:]]
    return np.concatenate([single, pair]), np.concatenate([row, row[:-1][row[:-1] == row[1:]]])


def buckets_of(hashed: np.ndarray) -> np.ndarray:
    return (hashed % np.uint64(BUCKETS)).astype(np.int64)


def present(hashed: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fine buckets and row numbers, each pair once."""
    both = np.unique(row.astype(np.int64) * FINE_BUCKETS + (hashed & np.uint64(FINE_BUCKETS - 1)).astype(np.int64))
    return both % FINE_BUCKETS, both // FINE_BUCKETS


def noise(keys: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel draws that only the keys and the seed decide."""
    draw = (mix(keys.astype(np.int64).view(np.uint64) ^ mix(np.array([seed], np.uint64))) >> np.uint64(12)).astype(float)
    return -np.log(-np.log((draw + 0.5) / 2.0**52))


def sortable(x: np.ndarray) -> np.ndarray:
    """Longs in the order of doubles."""
    bits = (np.asarray(x, float) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


@dataclass
class Model:
    """ratio: log of target to raw probability by bucket; cut: the least log weight of what is like the target;
    count: how many are drawn; least: the smallest key (log weight plus noise, as a sortable long) that is drawn.
    telling: log ratios of the fine buckets that are kept, in their order; beyond: the toxicity that costs nothing."""

    ratio: np.ndarray
    seed: int
    telling_buckets: np.ndarray
    telling: np.ndarray
    beyond: float = np.inf
    cut: float = -np.inf
    count: int = 0
    least: int = 0

    def toxicity(self, hashed: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The sum of each row's TELLING largest log ratios among kept features."""
        if not len(self.telling_buckets):
            return np.zeros(rows)
        number = np.full(FINE_BUCKETS, -1, np.int32)
        number[self.telling_buckets] = np.arange(len(self.telling))
        at = number[(hashed & np.uint64(FINE_BUCKETS - 1)).astype(np.int64)]
        some = np.flatnonzero(at >= 0)  # few features are telling
        both = np.unique(row[some].astype(np.int64) * len(self.telling) + at[some])
        row, ratio = both // len(self.telling), self.telling[both % len(self.telling)]
        order = np.lexsort((-ratio, row))
        row, ratio = row[order], ratio[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < TELLING
        return np.bincount(row[first], ratio[first], rows)


def labelled_sample(labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, quality, toxic) of ``limit`` labelled documents at most; a toxic one has quality 0. A document with several
    labels takes the worst."""
    toxic = F.coalesce(F.col("toxic").cast("int"), F.lit(0)) == 1
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(toxic, 0).otherwise(F.col("quality").cast("int")).alias("quality"), toxic.cast("int").alias("toxic")).dropna()
    one = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _scored(docs: DataFrame, model: Model, key: str, text: str, out: list[str]) -> DataFrame:
    """docs with three columns more: the log weight, weight plus noise as a sortable long, and the toxicity."""
    at_key, at_text = docs.columns.index(key), docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, toxic = np.zeros(len(batch)), np.zeros(len(batch))
            for low, high, buf, offsets in chunks(batch.column(at_text)):
                hashed, row = hashes(buf, offsets)
                weight[low:high] = np.bincount(row, model.ratio[buckets_of(hashed)], high - low) * SPREAD / (np.bincount(row, minlength=high - low) + EASED)
                toxic[low:high] = model.toxicity(hashed, row, high - low)
            weight -= PENALTY * np.maximum(0, toxic - model.beyond)
            keys = batch.column(at_key).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            order = sortable(np.round(weight + noise(keys, model.seed), 9))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight), pa.array(order), pa.array(toxic)], [*batch.schema.names, *out])

    small_batches(docs.sparkSession)
    kinds = (T.DoubleType(), T.LongType(), T.DoubleType())
    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in zip(out, kinds, strict=True)]]))


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The k-th largest of a long column, from its highest 16 bits to its lowest: four counts of 65536 groups at most."""
    known, left = 0, k
    for turn in range(4):
        shift = 48 - 16 * turn
        part = rows if not turn else rows.where(F.shiftright(column, shift + 16) == known)
        counts = part.groupBy(F.shiftright(column, shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("p")).collect()
        for r in counts:
            if left <= r["n"]:
                known = r["p"]
                break
            left -= r["n"]
    return known


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut, midway between two neighbouring weights, that parts good from bad with the best mean of both rates."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    below = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    above = 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    score = below + above
    edges = np.concatenate([[True], weights[1:] > weights[:-1], [True]])
    n = int(np.argmax(np.where(edges, score, -1)))
    return float(-np.inf if n == 0 else np.inf if n == len(weights) else (weights[n - 1] + weights[n]) / 2)


def telling_features(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fine buckets, in order, and log ratios of the features that mark toxic documents of marked(text, toxic): in how many
    toxic ones they occur against what their share of all would make. None without documents of both kinds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic, documents = np.zeros(FINE_BUCKETS, np.int64), np.zeros(FINE_BUCKETS, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            marks = batch.column(1).to_numpy(zero_copy_only=False) == 1
            documents += [len(batch), marks.sum()]
            for low, high, buf, offsets in chunks(batch.column(0)):
                bucket, row = present(*hashes(buf, offsets))
                every += np.bincount(bucket, minlength=FINE_BUCKETS)
                toxic += np.bincount(bucket[marks[low:high][row]], minlength=FINE_BUCKETS)
        some = np.flatnonzero(every)
        rows = (np.append(some, -1), np.append(every[some], documents[0]), np.append(toxic[some], documents[1]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["bucket", "every", "toxic"])

    small_batches(marked.sparkSession)
    counts = written(marked.mapInArrow(count, "bucket long, every long, toxic long").groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("toxic").alias("toxic")), "toxic-counts")
    whole = counts.where("bucket = -1").first()
    if not whole or not 0 < whole["toxic"] < whole["every"]:
        return np.zeros(0, np.int64), np.zeros(0)
    odds = (F.col("toxic") + EVEN) / (F.col("every") * (whole["toxic"] / whole["every"]) + EVEN)
    kept = counts.where(F.col("bucket") >= 0).select("bucket", odds.alias("odds")).where(F.col("odds") >= FACTOR).orderBy("bucket").toPandas()  # some of FINE_BUCKETS
    return kept["bucket"].to_numpy(np.int64), np.log(kept["odds"].to_numpy(float))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, seed: int = SEED, key: str = "doc_id", text: str = "text") -> Model:
    """Fits the raw model on all documents, the target model on half of the labelled ones of quality 1 that aren't toxic.

    A document's log weight is the mean log ratio of its features times SPREAD: the ratio of the models' likelihoods,
    tempered to one length, since else a long text's sampling error outweighs a short text's junk. A second ratio, of toxic
    to clean documents of the same half, takes from the weight of what is beyond its cut. Both cuts are fitted on the labelled
    sample without the target's half; as many documents as have the quality cut's weight at least, and aren't toxic beyond
    the other cut, are drawn by Gumbel top-k over all. Without labels of both kinds all are; without toxic ones in both halves none is toxic.
    """
    spark = docs.sparkSession
    plain = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    sample = F.broadcast(written(labelled_sample(labels, labelled), "labelled"))  # of a bounded number of rows
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2)) == 0
    marked = plain.join(sample, "doc_id", "left").select("text", ((F.coalesce("quality", F.lit(0)) == 1) & half).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            like = batch.column(1).to_numpy(zero_copy_only=False)
            for low, high, buf, offsets in chunks(batch.column(0)):
                hashed, row = hashes(buf, offsets)
                buckets = buckets_of(hashed)
                raw += np.bincount(buckets, minlength=BUCKETS)
                target += np.bincount(buckets[like[low:high][row]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, raw[some], target[some])], ["bucket", "raw", "target"])

    small_batches(spark)
    counts = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = np.zeros((2, BUCKETS))
    for r in counts.collect():  # BUCKETS rows at most
        got[:, r["bucket"]] = r["target"], r["raw"]
    raw = (got[1] + 1) / (got[1] + 1).sum()
    target = (got[0] + PRIOR * BUCKETS * raw) / (got[0].sum() + PRIOR * BUCKETS)
    known = written(plain.join(sample, "doc_id"), "labelled-texts")  # a bounded number of different documents
    model = Model(np.log(target / raw), seed, *telling_features(known.where(half).select("text", "toxic")))
    rest = _scored(known.where((F.col("quality") != 1) | ~half), model, "doc_id", "text", ["weight", "order", "toxicity"])
    rest = rest.withColumn("half", half).groupBy("doc_id", "quality", "toxic", "half").agg(F.min("weight").alias("weight"), F.max("toxicity").alias("toxicity")).toPandas()
    apart = rest[~rest["half"].astype(bool)]
    clean = apart.loc[apart["quality"] == 1, "toxicity"].to_numpy(float)
    if len(model.telling) and len(clean) and (apart["toxic"] == 1).any():
        model.beyond = float(np.quantile(clean, 1 - LOST, method="higher"))
        rest = rest[rest["toxic"] == 0]  # the second ratio judges the others
    model.cut = best_cut(rest["weight"].to_numpy(float), rest["quality"].to_numpy() == 1) if len(rest) else -np.inf
    scored = written(_scored(plain, model, "doc_id", "text", ["weight", "order", "toxicity"]).select("weight", "order", "toxicity"), "weights")
    model.count = scored.where((F.col("weight") >= float(model.cut)) & (F.col("toxicity") <= float(model.beyond))).count()
    model.least = int(kth_largest(scored, "order", model.count)) if model.count else np.iinfo(np.int64).max
    return model


def resample(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", weight: str = "log_weight", selected: str = "selected") -> DataFrame:
    """docs with log_weight and selected (whether the Gumbel top-k draw takes the row).

    Rows whose key equals the k-th are all taken, so repeated rows share their fate. Null and empty texts have weight 0. A
    null doc_id draws as -1. Columns of docs with these names are replaced.
    """
    rest = docs.drop(weight, selected)
    order, toxicity = unused(rest, "order"), unused(rest, "toxicity")
    scored = _scored(rest, model, key, text, [weight, order, toxicity])
    return scored.withColumn(selected, F.col(order) >= model.least).drop(order, toxicity)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """All documents, with the draw."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return resample(docs, model).select("doc_id", "log_weight", "selected")
