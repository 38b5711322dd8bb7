"""Folding of sequences and what alignments take from it: structures, energies, pair probabilities and evidence for pairs.

Each different sequence is folded once, in a task with others of about its length. Tables of a sequence take memory and time
that grow with its length squared and cubed, so these operators are for sequences of some hundred residues: whole texts go
in as blocks or windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribolens.functions.sequence import ungapped
from ribolens.kernels.loops import LoopModel, default_model
from ribolens.operators.alignment import RESIDUES, joint_profiles

#: Cells of the tables that a task fills at a time, over all sequences of a batch.
CELLS = 400_000
PROBABILITIES = "array<struct<i: int, j: int, p: double>>"


def _folded(sequences: DataFrame, schema: str, columns: Callable[[list[str], LoopModel], list[pa.Array]], model: LoopModel | None) -> DataFrame:
    """(seq, ...) of the different sequences(seq), with columns computed in runs of about one length."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            low = 0
            while low < len(seqs):
                longest, high = len(seqs[low]), low + 1
                while high < len(seqs) and (high - low + 1) * max(longest, len(seqs[high]), 1) ** 2 <= CELLS:
                    longest = max(longest, len(seqs[high]))
                    high += 1
                names = ["seq", *[x.split()[0] for x in schema.split(", ")[1:]]] if "<" not in schema else ["seq", "ensemble", "pairs"]
                yield pa.RecordBatch.from_arrays([pa.array(seqs[low:high]), *columns(seqs[low:high], model)], names)
                low = high

    different = sequences.select("seq").where("seq IS NOT NULL").distinct()
    return different.sortWithinPartitions(F.length("seq")).mapInArrow(run, schema)


def best_structures(sequences: DataFrame, model: LoopModel | None = None) -> DataFrame:
    """(seq, structure, energy) of each different sequence: the structure of least energy, and it, in kcal/mol. Null
    sequences are left out; an empty one has the empty structure."""

    def columns(seqs: list[str], loops: LoopModel) -> list[pa.Array]:
        from ribolens.kernels.folding import best

        found = best(seqs, loops)
        return [pa.array([x for x, _ in found]), pa.array([e for _, e in found])]

    return _folded(sequences, "seq string, structure string, energy double", columns, model)


def pair_probabilities(sequences: DataFrame, model: LoopModel | None = None) -> DataFrame:
    """(seq, ensemble, pairs) of each different sequence: the energy of all its structures together (kcal/mol), and the
    probability of each two places, from 1, that pair in any structure."""

    def columns(seqs: list[str], loops: LoopModel) -> list[pa.Array]:
        from ribolens.kernels.folding import partition

        ensemble, p = partition(seqs, loops)
        b, i, j = np.nonzero(p)
        offsets = np.searchsorted(b, np.arange(len(seqs) + 1))
        kinds = zip((i + 1, j + 1), (pa.int32(), pa.int32()), strict=True)
        pairs = pa.StructArray.from_arrays([*[pa.array(x, t) for x, t in kinds], pa.array(p[b, i, j])], ["i", "j", "p"])
        return [pa.array(ensemble), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)]

    return _folded(sequences, f"seq string, ensemble double, pairs {PROBABILITIES}", columns, model)


def structure_energies(rows: DataFrame, model: LoopModel | None = None) -> DataFrame:
    """(seq, ss, energy) of the different rows(seq, ss): the energy of a given structure (kcal/mol). Brackets of any kind nest
    together; two residues that don't fit pair as a pair of no kind. Null where lengths differ or a bracket has no partner."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ribolens.kernels.loops import Loops
        from ribolens.kernels.strings import nested_table

        for batch in batches:
            out = []
            for seq, ss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                partner = nested_table(ss) if len(seq) == len(ss) else None
                out.append(None if partner is None else Loops(model, seq).structure(partner) / 100)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["seq", "ss", "energy"])

    return rows.select("seq", "ss").where("seq IS NOT NULL AND ss IS NOT NULL").distinct().mapInArrow(run, "seq string, ss string, energy double")


def _places(aseq: Column) -> Column:
    """The columns, from 1, of a row's residues."""
    symbols = F.transform(F.split(aseq, ""), lambda c, n: F.struct((n + 1).alias("n"), c.alias("c")))
    return F.transform(F.filter(symbols, lambda x: ~x["c"].isin("", ".", "-")), lambda x: x["n"])


def average_probabilities(rows: DataFrame, fragments: bool = False, model: LoopModel | None = None) -> DataFrame:
    """(msa_id, i, j, p) of rows(msa_id, aseq, weight): the mean probability that columns i < j pair, over the alignment's
    weight. A row with a gap at either column counts as not pairing; with ``fragments``, a row isn't counted where i lies
    before its first residue or j behind its last.

    An alignment's rows pass through one task in order; equal sequences of a batch are folded once, and pairs are summed where
    they are found, so only an alignment's square of columns is held, whatever number of rows it has.
    """
    return _averaged(rows, fragments, model, lambda batch: batch, "p")


def fold_log_odds(rows: DataFrame, floor: float = -400.0, least: float | None = None, model: LoopModel | None = None) -> DataFrame:
    """(msa_id, i, j, log_odds): pair_log_odds of average_probabilities(rows), taken where an alignment's means are made, so that
    they aren't joined to their columns; with ``least``, those of so much alone."""

    def odds(batch: pa.RecordBatch) -> pa.RecordBatch:
        i, j, p = (np.asarray(batch.column(k)) for k in (1, 2, 3))
        free = 1 - np.bincount(np.concatenate([i, j]), np.concatenate([p, p]))
        both = free[i] * free[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(p == 0, floor, np.maximum(0.5 * 144.269504 * np.log(p / both), floor))
        unknown = (p != 0) & ~(both > 0)
        found = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(value, mask=unknown)], ["msa_id", "i", "j", "log_odds"])
        return found if least is None else found.filter(pa.array(~unknown & (value >= least)))

    return _averaged(rows, False, model, odds, "log_odds")


def _averaged(rows: DataFrame, fragments: bool, model: LoopModel | None, of: Callable[[pa.RecordBatch], pa.RecordBatch], column: str) -> DataFrame:
    """(msa_id, i, j, column): what ``of`` makes of each alignment's mean probabilities."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last alignment's name, weight, and sums of pairs and of ends by columns
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            sums = _column_sums(names.indices.to_numpy(), batch.column(1).to_pylist(), np.asarray(batch.column(2), float), model)
            for k, name in enumerate(names.dictionary.to_pylist()):
                if held is not None and held[0] == name:
                    held = (name, held[1] + sums[0][k], _added(held[2], sums[1][k]), _added(held[3], sums[2][k]))
                    continue
                if held is not None:
                    yield from map(of, _means(*held, fragments))
                held = (name, sums[0][k], sums[1][k], sums[2][k])
        if held is not None:
            yield from map(of, _means(*held, fragments))

    given = rows.where("msa_id IS NOT NULL AND aseq IS NOT NULL").select("msa_id", "aseq", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    return given.repartition("msa_id").sortWithinPartitions("msa_id").mapInArrow(_in_runs(run), f"msa_id string, i int, j int, {column} double")


#: Rows of a batch that a task gives back.
ROWS_BACK = 50_000


def _in_runs(run: Callable) -> Callable:
    """The record batches of run(batches) put together to ROWS_BACK rows at least, but for the last."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for part in run(batches):
            parts.append(part)
            n += len(part)
            if n >= ROWS_BACK:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                parts, n = [], 0
        if n:
            yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    return joined


_Sums = tuple[np.ndarray, np.ndarray]  # keys i << 20 | j in order, and their sums


def _added(one: _Sums, two: _Sums) -> _Sums:
    keys, at = np.unique(np.concatenate([one[0], two[0]]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([one[1], two[1]]), len(keys))


def _column_sums(of: np.ndarray, texts: list[str], weight: np.ndarray, model: LoopModel) -> tuple[np.ndarray, list[_Sums], list[_Sums]]:
    """By alignment (of: each row's, from 0 in order): weight, sums of weight times probability by the columns of pairs, and of
    weight by a row's first and last column with a residue."""
    from ribolens.kernels.folding import partition

    width, n = max(map(len, texts), default=0), int(of.max(initial=-1)) + 1
    chars = np.frombuffer("".join(t.ljust(width, "-") for t in texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)
    free = (chars == ord("-")) | (chars == ord("."))
    place = np.argsort(free, axis=1, kind="stable")  # columns of a row's residues first
    size = width - free.sum(axis=1)
    seqs = [t.replace("-", "").replace(".", "") for t in texts]
    number = {s: k for k, s in enumerate(sorted(set(seqs), key=len))}
    different, which = list(number), np.array([number[s] for s in seqs])

    def by_alignment(key: np.ndarray, value: np.ndarray) -> list[_Sums]:
        keys, at = np.unique(key, return_inverse=True)
        summed, ends = np.bincount(at, value, len(keys)), np.searchsorted(keys >> 40, np.arange(n + 1))
        return [(keys[a:b] & (1 << 40) - 1, summed[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    found, low = [], next((k for k, s in enumerate(different) if len(s) > 4), len(different))
    while low < len(different):
        high = min(len(different), low + 1)
        while high < len(different) and (high - low + 1) * len(different[high]) ** 2 <= CELLS:
            high += 1
        p = partition(different[low:high], model)[1]
        b, i, j = np.nonzero(p)
        found.append((b + low, i, j, p[b, i, j]))
        low = high
    b, i, j, p = (np.concatenate([f[k] for f in found]) for k in range(4)) if found else (np.zeros(0, np.int64),) * 4
    first = np.searchsorted(b, np.arange(len(different) + 1))
    count = np.diff(first)[which]
    row = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[which], count)
    pairs = by_alignment(of[row].astype(np.int64) << 40 | place[row, i[at]] + 1 << 20 | place[row, j[at]] + 1, weight[row] * p[at]) if len(row) else [(np.zeros(0, np.int64), np.zeros(0))] * n
    some = np.flatnonzero(size)
    ends = by_alignment(of[some].astype(np.int64) << 40 | place[some, 0] + 1 << 20 | place[some, size[some] - 1] + 1, weight[some])
    return np.bincount(of, weight, n), pairs, ends


def _means(name: str, weight: float, pairs: _Sums, ends: _Sums, fragments: bool) -> Iterator[pa.RecordBatch]:
    keys, mass = pairs
    i, j = keys >> 20, keys & (1 << 20) - 1
    whole = np.full(len(keys), weight)
    if fragments and len(keys):
        width = int(max(j.max(), (ends[0] & (1 << 20) - 1).max()))
        covered = np.zeros((width + 2, width + 2))
        covered[ends[0] >> 20, ends[0] & (1 << 20) - 1] = ends[1]
        covered = np.cumsum(np.cumsum(covered, axis=0)[:, ::-1], axis=1)[:, ::-1]  # rows that begin at i or before and end at j or behind
        whole = covered[i, j]
    kept = whole > 0
    if kept.any():
        columns = [pa.repeat(name, int(kept.sum())), pa.array(i[kept].astype(np.int32)), pa.array(j[kept].astype(np.int32)), pa.array(mass[kept] / whole[kept])]
        yield pa.RecordBatch.from_arrays(columns, ["msa_id", "i", "j", "p"])


# Standard frequencies of residues A, C, G, U, and of their pairs in structures, by the left residue's rows.
SINGLE = (0.238, 0.235, 0.261, 0.266)
DOUBLE = (
    (0.0081, 0.0160, 0.0091, 0.1554),
    (0.0160, 0.0084, 0.2315, 0.0098),
    (0.0091, 0.2315, 0.0093, 0.0596),
    (0.1554, 0.0098, 0.0596, 0.0114),
)


def standard_log_odds(left: tuple[int, ...], right: tuple[int, ...]) -> float:
    """The log odds of pairing, of two symbols that stand for any of these residues (by number)."""
    mean = lambda xs: sum(xs) / len(xs)
    return float(np.log(mean([DOUBLE[x][y] for x in left for y in right]) / (mean([SINGLE[x] for x in left]) * mean([SINGLE[y] for y in right]))))


def column_log_odds(rows: DataFrame, floor: float = -400.0) -> DataFrame:
    """(msa_id, i, j, log_odds) of rows(msa_id, seq_id, aseq, weight), for columns i < j in which some row has residues in
    both: half the mean log odds, in hundredths of bits, of pairing against standing alone by standard frequencies. A gap is
    any residue; rows with gaps in both aren't counted; ``floor`` at least.

    A row with one gap adds what only its residue decides, so such rows are counted by columns: each column's weight of a
    residue less what meets a residue in the other.
    """
    every = tuple(range(4))
    n = {s: k for k, s in enumerate(RESIDUES)}
    met = joint_profiles(rows)
    total, weight = F.lit(0.0), -F.col("both")
    for x in RESIDUES:
        row, column = sum(F.col(x + y) for y in RESIDUES), sum(F.col(y + x) for y in RESIDUES)
        total = total + sum(F.lit(standard_log_odds((n[x],), (n[y],))) * F.col(x + y) for y in RESIDUES)
        total = total + F.lit(standard_log_odds((n[x],), every)) * (F.col(f"i_{x}") - row) + F.lit(standard_log_odds(every, (n[x],))) * (F.col(f"j_{x}") - column)
        weight = weight + F.col(f"i_{x}") + F.col(f"j_{x}")
    return met.select("msa_id", "i", "j", F.greatest(0.5 * 144.269504 * total / weight, F.lit(floor)).alias("log_odds"))


def structure_measures(rows: DataFrame, structures: DataFrame, probabilities: DataFrame, model: LoopModel | None = None) -> DataFrame:
    """(msa_id, bp_org, bp, conflict, deleted, energy) of rows(msa_id, aseq, weight) under structures(msa_id, ss): the pairs
    of each structure, the sum of their mean probabilities(msa_id, i, j, p), the weight of rows that can't pair there times
    that probability (deleted: gaps at both), and the weighted mean energy of the rows in that structure, each 10 kcal/mol
    at most. Pairs with a gap at one end are opened for the energy. All in one structure nest."""
    from ribolens.operators.structures import pair_rows, plain

    pairs = pair_rows(structures, "msa_id").join(probabilities, ["msa_id", "i", "j"], "left").na.fill(0.0, ["p"])
    listed = pairs.groupBy("msa_id").agg(F.count(F.lit(1)).alias("bp_org"), F.sum("p").alias("bp"), F.collect_list(F.struct("i", "j", "p")).alias("pairs"))  # half a width at most
    held = rows.groupBy("msa_id", "aseq").agg(F.sum("weight").alias("w"))
    met = held.join(structures.select("msa_id", plain(F.col("ss")).alias("ss")), "msa_id").join(listed, "msa_id", "left")
    symbol = lambda at: F.substr("aseq", at, F.lit(1))
    ends = lambda x: F.concat(symbol(x["i"]), symbol(x["j"]))
    none = F.array().cast("array<struct<i: int, j: int, p: double>>")
    known = F.coalesce("pairs", none)
    bad = F.filter(known, lambda x: ~ends(x).isin("AU", "UA", "CG", "GC", "GU", "UG"))
    mass = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["p"])
    lost = F.filter(bad, lambda x: ends(x).rlike("^[.-]{2}$"))
    opened = F.flatten(F.transform(F.filter(known, lambda x: ends(x).rlike("[.-]")), lambda x: F.array(x["i"], x["j"])))
    kept = F.filter(F.transform(F.split("ss", ""), lambda c, n: F.struct((n + 1).alias("n"), F.when(F.array_contains(opened, n + 1), ".").otherwise(c).alias("c"))), lambda x: ~symbol(x["n"]).isin("", ".", "-"))
    seen = met.select("msa_id", "w", mass(lost).alias("deleted"), (mass(bad) - mass(lost)).alias("conflict"), ungapped(F.col("aseq")).alias("seq"), F.array_join(F.transform(kept, lambda x: x["c"]), "").alias("ss"))
    energies = structure_energies(seen, model)
    summed = seen.join(energies, ["seq", "ss"], "left").groupBy("msa_id").agg(
        F.sum(F.col("w") * F.col("conflict")).alias("conflict"), F.sum(F.col("w") * F.col("deleted")).alias("deleted"), (F.sum(F.col("w") * F.least("energy", F.lit(10.0))) / F.nullif(F.sum("w"), F.lit(0.0))).alias("energy")
    )
    return summed.join(listed.select("msa_id", "bp_org", "bp"), "msa_id", "left").select("msa_id", F.coalesce("bp_org", F.lit(0)).alias("bp_org"), F.coalesce("bp", F.lit(0.0)).alias("bp"), "conflict", "deleted", "energy")
