"""Statistics of alignments: rows(msa_id, seq_id, aseq, weight), and cells(msa_id, seq_id, col, sym, weight), a row for each
sequence and column. Other symbols than residues are gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ribolens.functions.sequence import is_canonical
from ribolens.session import written

RESIDUES = ("A", "C", "G", "U")
#: Relative background frequency of each residue.
BACKGROUND = 0.25
#: Rows of a block in comparisons of all rows of an alignment.
BLOCK_ROWS = 2000
#: Blocks of a part of an alignment, whose rows meet all of it in one task.
PART_BLOCKS = 50


def cells(rows: DataFrame) -> DataFrame:
    """rows(msa_id, seq_id, aseq, weight) in long form."""
    symbols = F.posexplode(F.split(F.col("aseq"), "")).alias("pos", "sym")
    return rows.select("msa_id", "seq_id", "weight", symbols).where("sym <> ''").select("msa_id", "seq_id", (F.col("pos") + 1).alias("col"), "sym", "weight")


def _weighted_mean(value: Column) -> Column:
    return F.sum(F.col("weight") * value) / F.nullif(F.sum(F.when(value.isNotNull(), F.col("weight"))), F.lit(0.0))


def totals(rows: DataFrame) -> DataFrame:
    """Number of sequences, total weight, weighted mean length and GC share by alignment."""
    seq = F.translate("aseq", ".-", "")
    gc = (F.length(seq) - F.length(F.translate(seq, "GC", ""))) / F.nullif(F.length(seq), F.lit(0))
    return rows.groupBy("msa_id").agg(
        F.count(F.lit(1)).alias("num"), F.sum("weight").alias("total_weight"), _weighted_mean(F.length(seq)).alias("mean_len"), _weighted_mean(gc).alias("mean_gc")
    )


def column_profile(long: DataFrame) -> DataFrame:
    """(msa_id, col, w, gap, A, C, G, U): each column's whole weight and that of its gaps and residues."""
    of = lambda when: F.sum(F.when(when, F.col("weight")).otherwise(0.0))
    return long.groupBy("msa_id", "col").agg(F.sum("weight").alias("w"), of(~F.col("sym").isin(*RESIDUES)).alias("gap"), *[of(F.col("sym") == s).alias(s) for s in RESIDUES])


def column_frequencies(long: DataFrame) -> DataFrame:
    """(msa_id, col, sym, f): weighted frequencies of the residues, gaps dealt out by the background."""
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("sym"), ((F.col(s) + F.col("gap") * BACKGROUND) / F.col("w")).alias("f")) for s in RESIDUES]))
    return column_profile(long).where("w > 0").select("msa_id", "col", each)


def column_entropy() -> Column:
    """Of a column profile: bits of the frequencies against the background."""
    term = lambda f: F.when(f > 0, f * F.log2(f / BACKGROUND)).otherwise(0.0)
    return sum((term((F.col(s) + F.col("gap") * BACKGROUND) / F.col("w")) for s in RESIDUES), F.lit(0.0))


def relative_entropy(long: DataFrame) -> DataFrame:
    """(msa_id, entropy): bits of the columns' frequencies against the background, summed over columns."""
    return column_profile(long).where("w > 0").groupBy("msa_id").agg(F.sum(column_entropy()).alias("entropy"))


def pair_cells(rows: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """(msa_id, seq_id, i, j, left, right, weight) for the structure's pairs (i, j) of columns, cut from each row."""
    each = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.substring("aseq", i, 1).alias("left"), F.substring("aseq", j, 1).alias("right")) for i, j in pairs]
    return rows.select("msa_id", "seq_id", "weight", F.inline(F.array(*each))).select("msa_id", "seq_id", "i", "j", "left", "right", "weight")


def joint_weights(paired: DataFrame) -> DataFrame:
    """(msa_id, i, j, n, w, AA, AC, ..., U-, --): the weight of each pair of symbols at each pair of columns."""
    symbols = (*RESIDUES, "-")

    def number(side: str) -> Column:
        out = F.lit(len(RESIDUES))
        for n, s in enumerate(RESIDUES):
            out = F.when(F.col(side) == s, n).otherwise(out)
        return out

    coded = paired.select("msa_id", "i", "j", "weight", (number("left") * len(symbols) + number("right")).alias("kind"))
    few = coded.groupBy("msa_id", "i", "j", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))  # one sum a row
    names = [x + y for x in symbols for y in symbols]
    cells = [F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0)).alias(name) for k, name in enumerate(names)]
    return few.groupBy("msa_id", "i", "j").agg(F.sum("n").alias("n"), F.sum("weight").alias("w"), *cells)


def _information(joint: dict[str, Column], whole: Column) -> Column:
    """Mutual information in bits of joint weights by pair of residues, with their sum."""
    total = F.lit(0.0)
    for x in RESIDUES:
        for y in RESIDUES:
            left, right = sum(joint[x + r] for r in RESIDUES), sum(joint[r + y] for r in RESIDUES)
            both = joint[x + y]
            total = total + F.when(both > 0, both / whole * F.log2(both * whole / (left * right))).otherwise(0.0)
    return total


def mutual_information(paired: DataFrame) -> DataFrame:
    """(msa_id, i, j, mi): weighted mutual information of paired columns in bits. A gap counts as any residue, by the
    background."""
    q = BACKGROUND
    spread = {x + y: F.col(f"`{x}{y}`") + q * F.col(f"`{x}-`") + q * F.col(f"`-{y}`") + q * q * F.col("`--`") for x in RESIDUES for y in RESIDUES}
    named = joint_weights(paired).where("w > 0").select("msa_id", "i", "j", "w", *[c.alias(k) for k, c in spread.items()])
    return named.select("msa_id", "i", "j", _information({k: F.col(k) for k in spread}, F.col("w")).alias("mi"))


def _joint(rows: DataFrame, more: bool) -> DataFrame:
    """joint_residues, and with ``more`` also n, the alignment's rows, and i_A, ..., j_U, the weight of each residue in either column.

    An alignment's rows pass through one task in order, but only their sums are held: a square of its columns, whatever
    number of rows it has.
    """
    keys = [x + y for x in RESIDUES for y in RESIDUES]
    singles = [f"{c}_{s}" for c in "ij" for s in RESIDUES]

    def found(sums: np.ndarray, n: int) -> np.ndarray:
        """A row of i, j, both, the sixteen weights and the further columns for each two columns that meet."""
        width, alone = len(sums) // 4, np.diagonal(sums).reshape(-1, 4)
        cells = sums.reshape(width, 4, width, 4)
        i, j = np.nonzero(np.triu(cells.sum(axis=(1, 3)), 1) > 0)
        kinds = cells[i, :, j, :].reshape(len(i), 16)
        extra = [np.full((len(i), 1), n), alone[i], alone[j]] if more else []
        return np.hstack([i[:, None] + 1, j[:, None] + 1, kinds.sum(axis=1, keepdims=True), kinds, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.array([ord(s) for s in RESIDUES], np.uint8)
        names, held, size = [], [], 0

        def batch_of() -> pa.RecordBatch:
            table = np.vstack(held)
            of = pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]))
            numbers = [pa.array(table[:, k].astype(np.int32)) for k in (0, 1)] + [pa.array(np.ascontiguousarray(table[:, k])) for k in range(2, table.shape[1])]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(of), *numbers], ["msa_id", "i", "j", "both", *keys, *(["n", *singles] if more else [])])

        name, sums, n = None, None, 0
        for batch in batches:
            ids, texts, weight = batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.asarray(batch.column(2), float)
            width = max(map(len, texts), default=0)
            chars = np.frombuffer("".join(t.ljust(width) for t in texts).encode("ascii", "replace"), np.uint8).reshape(len(texts), width)
            low = 0
            while low < len(ids):
                high = low + 1
                while high < len(ids) and high < low + 1000 and ids[high] == ids[low]:
                    high += 1
                if sums is not None and ids[low] != name:
                    names.append(name)
                    held.append(found(sums, n))
                    size += len(held[-1])
                    sums, n = None, 0
                    if size > 100_000:
                        yield batch_of()
                        names, held, size = [], [], 0
                if sums is None:
                    name, sums = ids[low], np.zeros((4 * width, 4 * width))
                elif len(sums) < 4 * width:
                    sums = np.pad(sums, (0, 4 * width - len(sums)))
                is_residue = (chars[low:high, :, None] == code).reshape(high - low, -1).astype(float)
                sums[: 4 * width, : 4 * width] += (is_residue * weight[low:high, None]).T @ is_residue
                n += high - low
                low = high
        if sums is not None:
            names.append(name)
            held.append(found(sums, n))
        if held:
            yield batch_of()

    schema = ", ".join(["msa_id string, i int, j int, both double", *[f"{k} double" for k in keys], *([f"{k} double" for k in ("n", *singles)] if more else [])])
    given = rows.select("msa_id", F.coalesce("aseq", F.lit("")).alias("aseq"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    return given.repartition("msa_id").sortWithinPartitions("msa_id").mapInArrow(run, schema)


def joint_residues(rows: DataFrame) -> DataFrame:
    """(msa_id, i, j, both, AA, AC, ..., UU) for every two columns i < j in which some row has residues in both: the weight of
    each two residues, and their sum."""
    return _joint(rows, False)


def expected_information(rows: DataFrame, width: int) -> DataFrame:
    """(msa_id, i, j, mi) for every two columns i < j of ``width`` in which some row has residues in both: mutual information
    over such rows, in hundredths of bits, times their weight over the number of all rows."""
    keys = [x + y for x in RESIDUES for y in RESIDUES]
    mi = 100 * _information({k: F.col(k) for k in keys}, F.col("both")) * F.col("both") / F.col("n")
    return _joint(rows, True).where(F.col("j") <= width).select("msa_id", "i", "j", mi.alias("mi"))


def joint_profiles(rows: DataFrame) -> DataFrame:
    """joint_residues with i_A, i_C, ..., j_U: the weight of each residue in either column, whatever the other one has."""
    return _joint(rows, True).drop("n")


def pair_log_odds(pairs: DataFrame, floor: float = -400.0) -> DataFrame:
    """(msa_id, i, j, log_odds) of pairs(msa_id, i, j, p): half the log odds, in hundredths of bits, of pairing against both
    columns being free; a column is free with what its pairs leave of 1. ``floor`` at least, and for p = 0; null where a
    column is never free."""
    ends = pairs.select("msa_id", F.explode(F.array("i", "j")).alias("at"), "p").groupBy("msa_id", "at").agg((1 - F.sum("p")).alias("free"))
    one, two = (ends.select("msa_id", F.col("at").alias(c), F.col("free").alias(f"free_{c}")) for c in "ij")
    free = F.col("free_i") * F.col("free_j")
    odds = F.when(F.col("p") == 0, F.lit(floor)).when(free > 0, F.greatest(0.5 * 144.269504 * F.log(F.col("p") / free), F.lit(floor)))
    return pairs.join(one, ["msa_id", "i"]).join(two, ["msa_id", "j"]).select("msa_id", "i", "j", odds.alias("log_odds"))


def merged_evidence(information: DataFrame, odds: DataFrame, known: bool = False) -> DataFrame:
    """(msa_id, i, j, evidence): mutual information plus log odds; 0 where the log odds are negative or not given, and null
    where they are null (a column that is never free). With ``known``, rows without log odds are left out."""
    given = odds.withColumn("given", F.lit(True))
    met = information.join(given, ["msa_id", "i", "j"], "inner" if known else "left")
    return met.select("msa_id", "i", "j", F.when(F.col("given").isNull() | (F.col("log_odds") < 0), 0.0).otherwise(F.col("mi") + F.col("log_odds")).alias("evidence"))


def pair_categories(paired: DataFrame) -> DataFrame:
    """(msa_id, i, j, canonical, noncanonical, one_gap, two_gaps): weights by kind of pair."""
    lg, rg = ~F.col("left").isin(*RESIDUES), ~F.col("right").isin(*RESIDUES)
    fits = is_canonical(F.col("left"), F.col("right"))
    weight = lambda when: F.sum(F.when(when, F.col("weight")).otherwise(0.0))
    return paired.groupBy("msa_id", "i", "j").agg(
        weight(~lg & ~rg & fits).alias("canonical"), weight(~lg & ~rg & ~fits).alias("noncanonical"), weight(lg != rg).alias("one_gap"), weight(lg & rg).alias("two_gaps")
    )


def covarying_pairs(paired: DataFrame) -> DataFrame:
    """(msa_id, i, j, support): pairs of sequences that are both canonical at a pair of columns and differ on both sides.

    Counted from the numbers of each pair type, without joining sequences to sequences: types that differ on both sides
    are joined (at most six by six for a pair of columns) and their counts multiplied.
    """
    types = paired.where(is_canonical(F.col("left"), F.col("right"))).groupBy("msa_id", "i", "j", "left", "right").agg(F.count(F.lit(1)).alias("n"))
    other = types.select("msa_id", "i", "j", F.col("left").alias("l2"), F.col("right").alias("r2"), F.col("n").alias("n2"))
    met = types.join(other, ["msa_id", "i", "j"]).where("left <> l2 AND right <> r2 AND concat(left, right) < concat(l2, r2)")
    return met.groupBy("msa_id", "i", "j").agg(F.sum(F.col("n") * F.col("n2")).alias("support"))


def position_based_weights(rows: DataFrame, width: int) -> DataFrame:
    """(msa_id, seq_id, pb_weight) of rows of ``width`` columns: each column shares 1 / (kinds * count of the residue) among
    its residues; sums are divided by the sequence's residues and scaled to mean 1; all ones where no sequence has residues.

    An alignment's shares are one row of ``width`` entries, which its sequences meet by msa_id alone.
    """
    long = cells(rows.select("msa_id", "seq_id", "aseq", "weight"))
    counts = long.groupBy("msa_id", "col").agg(*[F.count(F.when(F.col("sym") == s, 1)).alias(s) for s in RESIDUES])
    kinds = sum(F.when(F.col(s) > 0, 1).otherwise(0) for s in RESIDUES)
    shares = counts.select("msa_id", "col", *[F.when(F.col(s) > 0, 1.0 / (kinds * F.col(s))).otherwise(0.0).alias(s) for s in RESIDUES])
    shares = shares.groupBy("msa_id").agg(F.array_sort(F.collect_list(F.struct("col", *RESIDUES))).alias("shares"))  # width entries
    met = rows.select("msa_id", "seq_id", "aseq").join(shares, "msa_id")

    def of(symbol: Column, share: Column) -> Column:
        out = F.lit(0.0)
        for s in RESIDUES:
            out = F.when(symbol == s, share[s]).otherwise(out)
        return out

    symbols = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda n: F.substr("aseq", n, F.lit(1)))
    each = F.zip_with(symbols, F.col("shares"), of)
    residues = F.length("aseq") - F.length(F.translate("aseq", "ACGU", ""))
    every = met.select("msa_id", "seq_id", F.when(residues > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / residues).otherwise(0.0).alias("raw"))
    by = Window.partitionBy("msa_id")
    total, count = F.sum("raw").over(by), F.count(F.lit(1)).over(by)
    return every.select("msa_id", "seq_id", F.when(total > 0, F.col("raw") * count / total).otherwise(1.0).alias("pb_weight"))


def masks(width: int) -> list[Column]:
    """Of rows of up to 64 columns: bits m_A, m_C, m_G, m_U of the columns with that residue, and m_gap of those without."""
    if width > 64:
        raise ValueError("masks hold 64 columns at most")
    bits = lambda keep: F.conv(F.translate("aseq", "ACGU-", "".join("1" if s in keep else "0" for s in "ACGU-")), 2, -10).cast("long")
    return [*[bits(s).alias(f"m_{s}") for s in RESIDUES], bits("-").alias("m_gap")]


def row_pairs(rows: DataFrame, carried: Sequence[str], either: Sequence[str] = ()) -> DataFrame:
    """All pairs of rows(msa_id, seq_id, carried..., either...) of one alignment: s1 < s2, and carried columns as a_... and b_...,
    of which a_... is s1's, and so the columns ``either``, of which a_... may be s2's.

    A row meets the others as arrays of about BLOCK_ROWS rows, which the join of alignments carries and an explode opens, so
    neither side is copied for each block of the other. Only alignments of over PART_BLOCKS blocks are dealt into parts, to
    each of which all blocks go.
    """
    counts = rows.groupBy("msa_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = rows.select("msa_id", "seq_id", *carried, *either).join(counts, "msa_id").withColumn("block", F.pmod(F.xxhash64("seq_id"), F.col("blocks")).cast("int"))
    parts = F.ceil(F.col("blocks") / PART_BLOCKS).cast("int")
    one = dealt.select("msa_id", F.pmod("block", parts).alias("part"), F.col("block").alias("p"), F.col("seq_id").alias("s1"), *[F.col(c).alias(f"a_{c}") for c in (*carried, *either)])
    two = dealt.select("msa_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("block").alias("q"), F.struct("seq_id", *carried, *either).alias("row"))
    held = two.repartition("msa_id", "part").groupBy("msa_id", "part", "q").agg(F.collect_list("row").alias("rows"))
    met = one.repartition("msa_id", "part").hint("merge").join(held, ["msa_id", "part"]).where("p <= q")
    met = met.select("msa_id", "p", "q", "s1", *[f"a_{c}" for c in (*carried, *either)], F.inline("rows").alias("s2", *[f"b_{c}" for c in (*carried, *either)])).where("(p < q OR s1 < s2) AND s1 <> s2")
    turned = F.col("s1") > F.col("s2")
    sides = [(f"a_{c}", f"b_{c}") for c in carried]
    turn = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in sides] + [F.when(turned, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in sides]
    return met.select("msa_id", F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2"), *turn, *[f"{side}_{c}" for c in either for side in "ab"])


#: Rows of a block in comparisons of blocks inside tasks.
LARGE_BLOCK = 10_000


def compared_blocks(rows: DataFrame, carried: Sequence[str], compare: Callable[[str, list[np.ndarray], list[np.ndarray] | None], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What compare(msa_id, one, two) gives for each two blocks of about LARGE_BLOCK rows(msa_id, carried...) of an alignment: their
    carried columns as arrays, two being None for a block and itself. A task holds two blocks at a time, and no pairs of rows."""
    counts = rows.groupBy("msa_id").agg(F.ceil(F.count(F.lit(1)) / LARGE_BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(counts, "msa_id").withColumn("block", F.pmod(F.xxhash64(*carried), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("msa_id", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def ended() -> Iterator[pa.RecordBatch]:
            block, *columns = (np.concatenate([h[k] for h in held]) for k in range(len(carried) + 1))
            if key[1] == key[2]:
                return compare(key[0], columns, None)
            first = block == key[1]
            return compare(key[0], [c[first] for c in columns], [c[~first] for c in columns])

        for batch in batches:
            names = batch.column(0).dictionary_encode()
            of, known = names.indices.to_numpy(), names.dictionary.to_pylist()
            p, q, *columns = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns))
            begins = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]) if len(of) else []
            for low, high in zip(begins, [*begins[1:], len(of)], strict=True):
                now = (known[of[low]], int(p[low]), int(q[low]))
                if held and now != key:
                    yield from ended()
                    held = []
                key = now
                held.append([c[low:high] for c in columns])
        if held:
            yield from ended()

    return met.repartition("msa_id", "p", "q").sortWithinPartitions("msa_id", "p", "q").mapInArrow(run, schema)


def _matches() -> Column:
    return sum(F.bit_count(F.col(f"a_m_{s}").bitwiseAND(F.col(f"b_m_{s}"))) for s in RESIDUES)


def _residues(side: str) -> Column:
    return sum(F.bit_count(f"{side}_m_{s}") for s in RESIDUES)


MASKS = ("m_A", "m_C", "m_G", "m_U", "m_gap")


def pairwise_identity(rows: DataFrame, width: int) -> DataFrame:
    """(msa_id, s1, s2, matches, len1, len2, shared, identity) for pairs of sequences of one alignment, s1 < s2: matches over the
    shorter sequence's residues; shared: columns with residues in both. Columns are compared as bits of a long."""
    held = rows.select("msa_id", "seq_id", *masks(width)).withColumn("len", F.lit(width) - F.bit_count("m_gap"))
    met = row_pairs(held, ("len",), MASKS)
    both = F.lit(width) - F.bit_count(F.col("a_m_gap").bitwiseOR(F.col("b_m_gap")))
    met = met.select("msa_id", "s1", "s2", _matches().alias("matches"), F.col("a_len").alias("len1"), F.col("b_len").alias("len2"), both.alias("shared"))
    least = F.least("len1", "len2")
    return met.withColumn("identity", F.when(least > 0, F.col("matches") / least).otherwise(0.0))


def weighted_identity(rows: DataFrame, width: int, least: int = 10) -> DataFrame:
    """(msa_id, mean_identity): the mean over pairs of sequences, weighted by the product of their weights, of matches over
    columns that aren't gaps in both; pairs of under ``least`` such columns are left out. 1 for one sequence, null
    if no pair is left. Equal strings are compared once, by the sum of their weights; alignments of up to LARGE_BLOCK rows in
    one task each, and others in blocks."""
    from ribolens.operators.streamed import small_identities

    return with_large_identities(small_identities(rows, width, least, LARGE_BLOCK), rows, width, least)


def with_large_identities(small: DataFrame, rows: DataFrame, width: int, least: int = 10) -> DataFrame:
    """small(msa_id, ..., mean_identity, whole) without ``whole``, and with the identities of the alignments that aren't whole."""
    small = written(small, "identities")
    large = small.where("NOT whole")
    if large.isEmpty():
        return small.drop("whole")
    found = _large_identities(rows.join(F.broadcast(large.select("msa_id")), "msa_id", "left_semi"), width, least).withColumnRenamed("mean_identity", "found")
    rest = large.join(found, "msa_id", "left").select(*[F.col("found").alias(c) if c == "mean_identity" else c for c in small.columns])
    return small.where("whole").unionByName(rest).drop("whole")


def _large_identities(rows: DataFrame, width: int, least: int) -> DataFrame:
    from ribolens.operators.streamed import identity_sums

    w, square = F.col("weight"), F.col("weight") * F.col("weight")
    strings = rows.groupBy("msa_id", "aseq").agg(F.sum(w).alias("w"), F.sum(square).alias("square"), F.count(F.lit(1)).alias("n"))
    held = strings.select("msa_id", "w", "square", "n", *masks(width))

    def compare(name: str, one: list[np.ndarray], two: list[np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        sides = [None if x is None else (np.stack(x[1:], axis=1).view(np.uint64), x[0]) for x in (one, two)]
        same, pairs = identity_sums(*sides, least)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([same]), pa.array([pairs]), pa.array([bool(pairs)])], ["msa_id", "same", "pairs", "some"])

    apart = compared_blocks(held.select("msa_id", F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"), *MASKS[:4]), ("w", *MASKS[:4]), compare, "msa_id string, same double, pairs double, some boolean")
    apart = apart.where("some").groupBy("msa_id").agg(F.sum("same").alias("same"), F.sum("pairs").alias("pairs"))
    own = F.when((F.col("n") > 1) & (F.lit(width) - F.bit_count("m_gap") >= least), (F.col("w") * F.col("w") - F.col("square")) / 2).otherwise(0.0)
    inside = held.groupBy("msa_id").agg(F.sum(own).alias("equal"))
    joined = inside.join(apart, "msa_id", "left").select("msa_id", *[(F.coalesce(c, F.lit(0.0)) + F.coalesce("equal", F.lit(0.0))).alias(c) for c in ("same", "pairs")])
    return joined.select("msa_id", (F.col("same") / F.nullif("pairs", F.lit(0.0))).alias("mean_identity"))


def column_statistics(long: DataFrame, frequency: float = 0.7, least: float = 3.0, gap: float = 0.6, block: int = 4) -> DataFrame:
    """(msa_id, entropy, conserved): see relative_entropy and conserved_positions; from one profile of the columns."""
    profile = column_profile(long).where("w > 0")
    top = F.greatest(*RESIDUES)
    flags = F.struct("col", (F.col("gap") <= gap * F.col("w")).alias("used"), ((top > frequency * F.col("w")) & (top >= least)).alias("good"))
    cols = profile.groupBy("msa_id").agg(F.sum(column_entropy()).alias("entropy"), F.array_sort(F.collect_list(flags)).alias("cols"))  # one entry a column
    closed = lambda a: F.when(a["run"] >= block, a["total"] + a["run"]).otherwise(a["total"])
    state = lambda run, total: F.struct(run.cast("long").alias("run"), total.cast("long").alias("total"))
    step = lambda a, c: F.when(~c["used"], a).when(c["good"], state(a["run"] + 1, a["total"])).otherwise(state(F.lit(0), closed(a)))
    return cols.select("msa_id", "entropy", F.aggregate("cols", state(F.lit(0), F.lit(0)), step, closed).alias("conserved"))


def conserved_positions(long: DataFrame, **how: float) -> DataFrame:
    """(msa_id, conserved): columns in runs of ``block`` at least in which one residue has more than ``frequency`` of the whole
    weight, and ``least`` of weight. Columns with more than ``gap`` gaps neither lengthen nor break a run."""
    return column_statistics(long, **how).select("msa_id", "conserved")


def consensus_columns(long: DataFrame, gap: float = 0.6) -> DataFrame:
    """(msa_id, col, rf): the heaviest residue of columns whose gaps weigh ``gap`` of the total at most, else a dot; ties
    go to the first residue."""
    per = long.groupBy("msa_id", "col", "sym").agg(F.sum("weight").alias("w"))
    is_residue = F.col("sym").isin(*RESIDUES)
    best = F.max_by(F.when(is_residue, F.col("sym")), F.when(is_residue, F.struct("w", -F.ascii("sym"))))
    cols = per.groupBy("msa_id", "col").agg(F.sum("w").alias("t"), F.sum(F.when(~is_residue, F.col("w")).otherwise(0.0)).alias("g"), best.alias("best"))
    return cols.select("msa_id", "col", F.when((F.col("g") <= gap * F.col("t")) & F.col("best").isNotNull(), F.col("best")).otherwise(".").alias("rf"))


def _symbols(texts: pa.Array, width: int) -> np.ndarray:
    """[row, column] of strings of ``width`` ASCII characters."""
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
    if (np.diff(ends) != width).any():
        raise ValueError(f"rows of {width} ASCII characters only")
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(len(texts), width)


def column_masks(rows: DataFrame, width: int, gap: float = 0.6) -> DataFrame:
    """(msa_id, kept, filled) of rows(msa_id, aseq, weight) of up to 64 columns: bits of the columns (the first is bit 0) that
    consensus_columns gives a residue, and of those with a residue in any row.

    An alignment's rows pass through one task in order, which holds a weight for each of its columns and no rows of cells.
    """
    if width > 64:
        raise ValueError("masks hold 64 columns at most")
    bits = np.uint64(1) << np.arange(width, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last alignment's name, weight, weight of gaps and number of residues by column

        def masks_of(name: str, total: float, gaps: np.ndarray, residues: np.ndarray) -> tuple[str, int, int]:
            kept = (gaps <= gap * total) & (residues > 0)
            return name, int(bits[kept].sum().view(np.int64)), int(bits[residues > 0].sum().view(np.int64))

        for batch in batches:
            if not len(batch):
                continue
            names = batch.column(0).dictionary_encode()
            of, weight = names.indices.to_numpy(), np.asarray(batch.column(2))
            is_residue = np.isin(_symbols(batch.column(1), width), np.frombuffer("".join(RESIDUES).encode(), np.uint8))
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            totals, gaps = np.add.reduceat(weight, begins), np.add.reduceat(~is_residue * weight[:, None], begins)
            residues, out = np.add.reduceat(is_residue, begins, dtype=np.int64), []
            for k, name in enumerate(names.dictionary.take(pa.array(of[begins])).to_pylist()):
                if held is not None and held[0] == name:
                    held = (name, held[1] + totals[k], held[2] + gaps[k], held[3] + residues[k])
                    continue
                if held is not None:
                    out.append(masks_of(*held))
                held = (name, totals[k], gaps[k], residues[k])
            yield _masked(out)
        if held is not None:
            yield _masked([masks_of(*held)])

    def _masked(out: list[tuple]) -> pa.RecordBatch:
        held = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(held, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["msa_id", "kept", "filled"])

    given = rows.where("msa_id IS NOT NULL AND aseq IS NOT NULL").select("msa_id", "aseq", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
    return given.repartition("msa_id").sortWithinPartitions("msa_id").mapInArrow(run, "msa_id string, kept long, filled long")


def masked_columns(rows: DataFrame, width: int, names: Sequence[str]) -> DataFrame:
    """rows(msa_id, seq_id, aseq, names...) with each mask of ``names`` as the row's symbols at its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, cut = _symbols(batch.column(2), width), []
            for k in range(len(names)):
                mask = np.asarray(batch.column(3 + k)).view(np.uint64)
                keep = (mask[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(bool)
                ends = np.r_[0, np.cumsum(keep.sum(axis=1))].astype(np.int32)
                cut.append(pa.StringArray.from_buffers(len(batch), pa.py_buffer(ends), pa.py_buffer(symbols[keep])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cut], ["msa_id", "seq_id", *names])

    kind = rows.schema["seq_id"].dataType.simpleString()
    return rows.select("msa_id", "seq_id", "aseq", *names).mapInArrow(run, f"msa_id string, seq_id {kind}, " + ", ".join(f"{c} string" for c in names))


def fragment_bounds(long: DataFrame) -> DataFrame:
    """(msa_id, seq_id, first_col, last_col): the first and last column with a residue, null without any."""
    col = F.when(F.col("sym").isin(*RESIDUES), F.col("col"))
    return long.groupBy("msa_id", "seq_id").agg(F.min(col).alias("first_col"), F.max(col).alias("last_col"))


def align_map(long: DataFrame) -> DataFrame:
    """(msa_id, seq_id, col, pos): the residue's position in its ungapped sequence, from 1."""
    at = Window.partitionBy("msa_id", "seq_id").orderBy("col")
    is_residue = F.when(F.col("sym").isin(*RESIDUES), 1).otherwise(0)
    return long.withColumn("pos", F.sum(is_residue).over(at)).where(is_residue == 1).select("msa_id", "seq_id", "col", "pos")


def jukes_cantor(identities: DataFrame) -> DataFrame:
    """(msa_id, s1, s2, distance): Jukes-Cantor distance over columns with residues in both; null where it's infinite."""
    x = 1 - (F.col("shared") - F.col("matches")) / F.col("shared") * (4.0 / 3)
    return identities.where("shared > 0").select("msa_id", "s1", "s2", F.when(x > 0, -F.log(x) * 0.75).alias("distance"))
