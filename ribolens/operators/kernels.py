"""Dynamic programming and greedy steps that run in tasks, on sequences, pairs or groups that Spark deals out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribolens.kernels.strings import gsc_weights, linkage, local_alignments, neighbour_joining, pair_table
from ribolens.operators.alignment import RESIDUES, masks
from ribolens.operators.intervals import binned
from ribolens.session import written


def paired_places(structures: DataFrame) -> DataFrame:
    """(msa_id, id, i, j) of structures(msa_id, id, structure): pairs of places from 1; unbalanced structures give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for msa, key, text in zip(batch["msa_id"], batch["id"], batch["structure"], strict=True):
                try:
                    rows += [(msa, key, i + 1, j + 1) for i, j in enumerate(pair_table(text)) if j > i]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["msa_id", "id", "i", "j"])

    return structures.select("msa_id", "id", "structure").mapInPandas(run, "msa_id string, id long, i int, j int")


#: Pairs that a task aligns at a time, so that there are many of about one length.
PAIRS = 80_000


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The batches put together to ``least`` rows at least, but for the last."""
    parts, n = [], 0
    for part in batches:
        parts.append(part)
        n += len(part)
        if n >= least:
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            parts, n = [], 0
    if n:
        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def locally_aligned(pairs: DataFrame) -> DataFrame:
    """pairs(msa_id, s1, s2, a, b) with the best local alignment's score and ranges. Pairs are aligned where they are made, a
    batch at a time, and equal ones of a batch once: no shuffle carries them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, PAIRS):
            a, b = (batch.column(k).dictionary_encode() for k in (3, 4))
            different, which = np.unique(a.indices.to_numpy().astype(np.int64) << 32 | b.indices.to_numpy(), return_inverse=True)
            one, two = (texts.dictionary.take(pa.array(k)).to_pylist() for texts, k in ((a, different >> 32), (b, different & (1 << 32) - 1)))
            got = local_alignments(one, two)[which]
            places = [pa.array(got[:, k].astype(np.int32)) for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got[:, 0].astype(float)), *places], names)

    names = ["msa_id", "s1", "s2", "score", "a_start", "a_stop", "b_start", "b_stop"]
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names[:3]) + ", score double, " + ", ".join(f"{c} int" for c in names[4:])
    return pairs.where("a IS NOT NULL AND b IS NOT NULL").select(*names[:3], "a", "b").mapInArrow(run, schema)


def _by_alignment(rows: DataFrame, width: int, schema: str, columns: Callable[[np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """(msa_id, ...) from each alignment's sequence ids, in order, and the matrix of 1 - identity (matches over the residues of the
    row that has fewer), which is made where it is used: rows meet by msa_id alone. It is for alignments whose matrix fits a task."""
    names, held = [f.split()[0] for f in schema.split(", ")], [f"m_{s}" for s in RESIDUES]

    def run(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("seq_id", kind="stable")
        distance = distances(members[held].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame([(members["msa_id"].iat[0], *r) for r in columns(members["seq_id"].to_numpy(), distance)], columns=names)

    return rows.select("msa_id", "seq_id", *masks(width)[:4]).groupBy("msa_id").applyInPandas(run, schema)


def distances(bits: np.ndarray) -> np.ndarray:
    """1 - identity of each two rows of bits[n, 4], a row's columns by residue; 0 of a row to itself."""
    n, size = len(bits), np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    out, step = np.empty((n, n)), max(1, 1_000_000 // max(n, 1))
    for low in range(0, n, step):
        some = slice(low, low + step)
        matches = sum(np.bitwise_count(bits[some, None, k] & bits[None, :, k]) for k in range(4))
        least = np.minimum(size[some, None], size[None, :])
        out[some] = 1 - np.where(least > 0, matches / np.maximum(least, 1), 0.0)
    np.fill_diagonal(out, 0.0)
    return out


def tree_weights(rows: DataFrame, width: int) -> DataFrame:
    """(msa_id, seq_id, gsc_weight) from pairwise identities of rows(msa_id, seq_id, aseq)."""
    return _by_alignment(rows, width, "msa_id string, seq_id long, gsc_weight double", lambda ids, d: list(zip(ids.tolist(), gsc_weights(d).tolist(), strict=True)))


def joined_trees(rows: DataFrame, width: int) -> DataFrame:
    """(msa_id, child, parent, length): the edges of each alignment's tree by neighbour joining. Leaves are seq_ids (not negative),
    inner nodes -1, -2, ..., the root the last; an alignment of one sequence has none."""

    def edges(ids: np.ndarray, d: np.ndarray) -> list[tuple]:
        name = lambda k: int(ids[k]) if k < len(ids) else len(ids) - k - 1
        return [(name(c), name(p), x) for c, p, x in neighbour_joining(d)]

    return _by_alignment(rows, width, "msa_id string, child long, parent long, length double", edges)


def linkage_merges(rows: DataFrame, width: int, how: str) -> DataFrame:
    """(msa_id, step, height): where clusters of each alignment merge, from the lowest on, by ``linkage``."""
    return _by_alignment(rows, width, "msa_id string, step long, height double", lambda ids, d: [(k, h) for k, (_, _, h) in enumerate(linkage(d, how))])


def greedy_hits(hits: DataFrame) -> DataFrame:
    """(hit_id) of hits that no better kept hit of their sequence overlaps, best first by (score descending, hit_id).

    In rounds: a hit that is the best live one of every bin it touches is met by no better one and stays; what overlaps it
    goes. A bin keeps one hit a round at most, so live hits meet at most one for each bin of theirs: no pairs of hits are
    made, and no sequence or run of overlapping hits is gathered. Each round settles the best live hit of every sequence at
    least, and in general the best of every neighbourhood. Live hits are written after each round.
    """
    live = written(hits.select("seq_id", "hit_id", "start", "stop", "score"), "live-hits")
    kept = None
    while not live.isEmpty():
        at = binned(live)
        order = F.struct(F.col("score"), -F.col("hit_id"))
        best = at.groupBy("seq_id", "bin").agg(F.max_by(F.struct("hit_id", "start", "stop"), order).alias("best"))
        met = at.join(best, ["seq_id", "bin"])
        won = met.groupBy("seq_id", "hit_id").agg(F.min((F.col("hit_id") == F.col("best.hit_id")).cast("int")).alias("won")).where("won = 1").select("seq_id", "hit_id")
        won = written(won, "kept-hits")
        held = best.join(won.withColumnRenamed("hit_id", "of"), (best["seq_id"] == won["seq_id"]) & (F.col("best.hit_id") == F.col("of")), "left_semi")
        gone = at.join(held, ["seq_id", "bin"]).where("start <= best.stop AND best.start <= stop").select("seq_id", "hit_id").distinct()
        live = written(live.join(gone, ["seq_id", "hit_id"], "left_anti"), "live-hits")
        kept = won if kept is None else kept.unionByName(won)
    return (live if kept is None else kept).select("hit_id")


def shuffled(sequences: DataFrame, seed: int = 1) -> DataFrame:
    """(seq_id, seq): each sequence's residues in an order that the seed and its id decide."""
    residues = F.posexplode(F.split("seq", "")).alias("at", "r")
    order = F.struct(F.xxhash64("seq_id", "at", F.lit(seed)), "at")
    rows = sequences.select("seq_id", residues).where("r <> ''").select("seq_id", order.alias("o"), "r")
    return rows.groupBy("seq_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "r"))), lambda x: x["r"]), "").alias("seq"))


def neighbour_shuffled(sequences: DataFrame, how: str = "walk", seed: int = 1) -> DataFrame:
    """(seq_id, seq): each sequence shuffled so that its pairs of neighbours stay (``walk``), or drawn by what follows what in it
    (``markov``). The seed and its id decide; null sequences stay null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ribolens.kernels import walks

        draw = {"walk": walks.walked, "markov": walks.markov}[how]
        for batch in batches:
            seeded = (np.random.default_rng([seed, k & (1 << 63) - 1, int(k < 0)]) for k in batch["seq_id"].tolist())
            yield pd.DataFrame({"seq_id": batch["seq_id"], "seq": [None if s is None else draw(s, rng) for s, rng in zip(batch["seq"], seeded, strict=True)]})

    return sequences.select("seq_id", "seq").mapInPandas(run, "seq_id long, seq string")


def consensus_structures(evidence: DataFrame, columns: DataFrame, cost: float, hairpin: int = 3) -> DataFrame:
    """(msa_id, ss, pairs, score): the best structure of each alignment of columns(msa_id, col, rf) by evidence(msa_id, i, j,
    evidence), over its consensus columns (rf isn't a dot) alone; see best_structure. An alignment's columns and its pairs of
    columns with positive evidence are one group, bounded by its width and not by its rows."""

    def run(held: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        from ribolens.kernels.consensus import best_structure

        if held.empty:
            return pd.DataFrame({"msa_id": [], "ss": [], "pairs": [], "score": []})
        width, kept = int(held["col"].max()), np.sort(held.loc[held["rf"] != ".", "col"].to_numpy())
        matrix, at = np.zeros((len(kept), len(kept))), {c: n for n, c in enumerate(kept.tolist())}
        for i, j, x in zip(known["i"], known["j"], known["evidence"], strict=True):
            if i in at and j in at:
                matrix[at[i], at[j]] = x
        some = np.flatnonzero((matrix > 0).any(axis=0) | (matrix > 0).any(axis=1))  # other columns can't pair
        score, pairs = best_structure(matrix[np.ix_(some, some)], kept[some], cost, hairpin)
        kept, ss = kept[some], ["."] * width
        for i, j in pairs:
            ss[kept[i] - 1], ss[kept[j] - 1] = "<", ">"
        return pd.DataFrame({"msa_id": held["msa_id"].iloc[:1], "ss": ["".join(ss)], "pairs": [len(pairs)], "score": [score]})

    # new column identities, since both may come from the same rows
    columns, evidence = (t.select([F.col(c).alias(c) for c in t.columns]) for t in (columns, evidence.where("evidence > 0")))
    # a helix needs evidence of more than its cost: alignments without that much in all have no pairs
    strong = evidence.groupBy("msa_id").agg(F.sum("evidence").alias("most")).where(F.col("most") > cost).select("msa_id")
    held, known = (t.join(strong, "msa_id", "left_semi") for t in (columns, evidence))
    folded = held.groupBy("msa_id").cogroup(known.groupBy("msa_id")).applyInPandas(run, "msa_id string, ss string, pairs long, score double")
    rest = columns.join(strong, "msa_id", "left_anti").groupBy("msa_id").agg(F.max("col").alias("width"))
    return folded.unionByName(rest.select("msa_id", F.repeat(F.lit("."), F.col("width")).alias("ss"), F.lit(0).cast("long").alias("pairs"), F.lit(0.0).alias("score")))
