"""Secondary structures as bracket strings: pairs, helices, comparisons and column selections in relational form.

All kinds of brackets nest together. A structure with an open or surplus bracket has no pairs, and ``balanced`` says so.
Windows run within one structure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ribolens.kernels import brackets

OPEN, CLOSE = "(<[{", ")>]}"
#: Results of a batch of rows that leave a task at a time.
PAIRS = 100_000


def plain(ss: Column) -> Column:
    """Brackets as ( and ), everything else as a dot."""
    return F.regexp_replace(F.translate(ss, OPEN + CLOSE, "(((())))"), "[^()]", ".")


def balanced(ss: Column) -> Column:
    """Whether every bracket has a partner."""
    step = lambda c: F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
    state = lambda depth, least: F.struct(depth.alias("depth"), least.alias("least"))
    walked = F.aggregate(F.split(plain(ss), ""), state(F.lit(0), F.lit(0)), lambda a, c: state(a["depth"] + step(c), F.least(a["least"], a["depth"] + step(c))))
    return (walked["depth"] == 0) & (walked["least"] == 0)


def _by_text(rows: DataFrame, key: str, texts: Sequence[str], schema: str, columns: Callable[..., dict]) -> DataFrame:
    """(key, ...) from columns(texts...), which gives the number of each result's row, and the other columns as arrays. Rows with
    a null text give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = columns(*[batch.column(n + 1).to_pylist() for n in range(len(texts))])
            for low in range(0, max(len(of), 1), PAIRS):
                part = slice(low, low + PAIRS)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[part])), *[pa.array(x[part], t) for x, t in found.values()]], [key, *found])

    whole = T.StructType([T.StructField(key, rows.schema[key].dataType), *T.StructType.fromDDL(schema).fields])
    return rows.select(key, *texts).na.drop(subset=list(texts)).mapInArrow(run, whole)


def pair_rows(rows: DataFrame, key: str, ss: str = "ss") -> DataFrame:
    """(key, i, j) of rows(key, ss): the pairs of balanced structures, i < j, from 1. Each row is by itself.

    A bracket's partner is the next one of the other kind on its level: on each level opening and closing brackets take
    turns.
    """

    def columns(texts: list[str]) -> tuple[np.ndarray, dict]:
        _, first, of, i, j, _ = brackets.balanced_pairs(texts, OPEN, CLOSE)
        return of, {"i": (i - first[of] + 1, pa.int32()), "j": (j - first[of] + 1, pa.int32())}

    return _by_text(rows, key, [ss], "i int, j int", columns)


def loop_kinds(rows: DataFrame, key: str, ss: str = "ss") -> DataFrame:
    """(key, i, j, hairpin, multiloop): of each pair of balanced structures whether its loop closes without another pair, and
    whether inside of it a stem begins after another one has ended."""

    def columns(texts: list[str]) -> tuple[np.ndarray, dict]:
        step, first, of, i, j, _ = brackets.balanced_pairs(texts, OPEN, CLOSE)
        at = np.flatnonzero(step)
        rank = np.zeros(len(step), np.int64)
        rank[at] = np.arange(len(at))
        turned = np.concatenate([[0, 0], np.cumsum((step[at][:-1] < 0) & (step[at][1:] > 0))])  # by bracket: closed before, then opened
        a, b = rank[i], rank[j]
        inner = turned[np.maximum(b, 1)] - turned[np.minimum(a + 2, len(turned) - 1)] if len(at) else a
        found = {"i": (i - first[of] + 1, pa.int32()), "j": (j - first[of] + 1, pa.int32())}
        return of, found | {"hairpin": (b == a + 1, pa.bool_()), "multiloop": ((b > a + 2) & (inner > 0), pa.bool_())}

    return _by_text(rows, key, [ss], "i int, j int, hairpin boolean, multiloop boolean", columns)


def helix_rows(rows: DataFrame, key: str, ss: str = "ss") -> DataFrame:
    """helices of the pairs of rows(key, ss); each row is by itself."""

    def columns(texts: list[str]) -> tuple[np.ndarray, dict]:
        _, first, of, i, j, _ = brackets.balanced_pairs(texts, OPEN, CLOSE)
        i, j = i - first[of] + 1, j - first[of] + 1
        order = np.lexsort((i, i + j, of))
        of, i, j = of[order], i[order], j[order]
        n = np.arange(len(i))
        new = np.ones(len(i) + 1, bool)
        new[1:-1] = (of[1:] != of[:-1]) | (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] - 1)
        starts = np.flatnonzero(new)
        run = np.cumsum(new[:-1]) - 1
        return of, {"i": (i, pa.int32()), "j": (j, pa.int32()), "outer": (n - starts[run], pa.int64()), "inner": (starts[run + 1] - 1 - n, pa.int64())}

    return _by_text(rows, key, [ss], "i int, j int, outer long, inner long", columns)


def with_partners(rows: DataFrame, key: str, texts: Sequence[str], ss: str = "ss") -> DataFrame:
    """(key, texts..., partners) of rows with balanced structures: each place's partner, from 1, 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step, first, of, i, j, bad = brackets.balanced_pairs(batch.column(0).to_pylist(), OPEN, CLOSE)
            partner = np.zeros(len(step), np.int32)
            partner[i], partner[j] = j - first[of] + 1, i - first[of] + 1
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(partner))
            whole = pa.RecordBatch.from_arrays([*batch.columns[1:], lists], [key, *texts, "partners"])
            yield whole.filter(pa.array(~bad))

    schema = T.StructType([*[T.StructField(c, rows.schema[c].dataType) for c in (key, *texts)], T.StructField("partners", T.ArrayType(T.IntegerType()))])
    return rows.where(F.col(ss).isNotNull()).select(F.col(ss).alias("__ss"), key, *texts).mapInArrow(run, schema)


def is_hairpin(ss: Column) -> Column:
    """Whether a loop has no pairs inside: of the string between a pair's ends."""
    return ~plain(ss).rlike("[()]")


def is_multiloop(ss: Column) -> Column:
    """Whether, inside the outer ends, a stem begins after another one has ended."""
    return F.substr(plain(ss), F.lit(2), F.greatest(F.length(ss) - 2, F.lit(0))).rlike(r"\).*\(")


def helices(pairs: DataFrame, key: str) -> DataFrame:
    """(key, i, j, outer, inner): for each pair how many stacked pairs lie outside and inside it, without a gap."""
    inside = Window.partitionBy(key, "sum").orderBy("i")
    island = pairs.withColumn("sum", F.col("i") + F.col("j")).withColumn("island", F.col("i") - F.row_number().over(inside))
    order = Window.partitionBy(key, "sum", "island").orderBy("i")
    size = F.count(F.lit(1)).over(Window.partitionBy(key, "sum", "island"))
    return island.select(key, "i", "j", (F.row_number().over(order) - 1).cast("long").alias("outer"), (size - F.row_number().over(order)).alias("inner"))


def partners(pairs: DataFrame, key: str) -> DataFrame:
    """(key, place, partner, side): both ends of each pair."""
    ends = F.inline(F.array(F.struct(F.col("i").alias("place"), F.col("j").alias("partner"), F.lit("left").alias("side")), F.struct(F.col("j").alias("place"), F.col("i").alias("partner"), F.lit("right").alias("side"))))
    return pairs.select(key, ends)


def ct_lines(rows: DataFrame, key: str, seq: str = "seq", ss: str = "ss") -> DataFrame:
    """(key, place, base, before, after, partner): connectivity rows, partner 0 where there is none. Each row is by itself."""
    held = with_partners(rows.where(F.length(seq) > 0), key, [seq], ss)
    chars = held.select(key, F.length(seq).alias("len"), F.posexplode(F.split(seq, "")).alias("n", "base"), "partners").where("base <> ''")
    at = F.col("n") + 1
    partner = F.coalesce(F.get("partners", F.col("n")), F.lit(0)).alias("partner")
    return chars.select(key, at.alias("place"), "base", F.col("n").alias("before"), F.when(at < F.col("len"), at + 1).otherwise(0).alias("after"), partner)


def from_ct(lines: DataFrame, key: str) -> DataFrame:
    """(key, seq, ss) of connectivity rows."""
    mark = F.when(F.col("partner") == 0, ".").when(F.col("partner") > F.col("place"), "(").otherwise(")")
    whole = lambda value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", value.alias("v")))), lambda x: x["v"]), "")
    return lines.groupBy(key).agg(whole(F.col("base")).alias("seq"), whole(mark).alias("ss"))


def kept_columns(rows: DataFrame, key: str, keep: Callable[[Column], Column], ss: str = "ss") -> DataFrame:
    """(key, ss) over the columns that ``keep`` takes; pairs that lose an end are opened. Balanced structures only, of which some
    column stays. Each row is by itself."""
    places = F.transform("partners", lambda p, n: F.struct(p.alias("p"), (n + 1).alias("n")))
    kept = F.filter(places, lambda x: F.coalesce(keep(x["n"]), F.lit(False)))
    mark = lambda x: F.when((x["p"] == 0) | ~F.coalesce(keep(x["p"]), F.lit(False)), ".").when(x["p"] > x["n"], "(").otherwise(")")
    marks = with_partners(rows, key, [], ss).select(key, F.transform(kept, mark).alias("marks")).where(F.size("marks") > 0)
    return marks.select(key, F.array_join("marks", "").alias("ss"))


def compared_structures(rows: DataFrame, key: str, one: str, two: str) -> DataFrame:
    """compared, of two structures of each row; a structure that isn't balanced has no pairs, and rows without pairs of either
    have no result. Each row is by itself."""

    def columns(first_texts: list[str], second_texts: list[str]) -> tuple[np.ndarray, dict]:
        (_, f1, of1, i1, j1, _), (_, f2, of2, i2, j2, _) = (brackets.balanced_pairs(x, OPEN, CLOSE) for x in (first_texts, second_texts))
        wide = int(max(np.diff(f1).max(initial=0), np.diff(f2).max(initial=0))) + 1
        place = lambda of, first, at: of * wide + at - first[of]
        a, b = place(of1, f1, i1), place(of1, f1, j1)
        partner = np.full(len(first_texts) * wide, -1)
        c, d = place(of2, f2, i2), place(of2, f2, j2)
        partner[c], partner[d] = d, c
        same, clash = partner[a] == b, (partner[a] >= 0) | (partner[b] >= 0)
        count = lambda of: np.bincount(of, minlength=len(first_texts))
        n = {"tp": count(of1[same]), "fp": count(of1[~same & ~clash]), "fn": count(of2) - count(of1[same]), "fm": count(of1[~same & clash])}
        some = np.flatnonzero(sum(n.values()))
        return some, {k: (x[some], pa.int64()) for k, x in n.items()}

    return _by_text(rows, key, [one, two], "tp long, fp long, fn long, fm long", columns)


def compared(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(key, tp, fp, fn, fm) of two lists of pairs(key, i, j): pairs of both; of the first whose ends are free in the second;
    of the second alone; and of the first with an end that the second pairs otherwise."""
    both = one.withColumn("a", F.lit(True)).join(two.withColumn("b", F.lit(True)), [key, "i", "j"], "full_outer")
    taken = partners(two, key).select(key, F.col("place"), F.lit(True).alias("taken")).distinct()
    left = taken.select(key, F.col("place").alias("i"), F.col("taken").alias("ti"))
    right = taken.select(key, F.col("place").alias("j"), F.col("taken").alias("tj"))
    marked = both.join(left, [key, "i"], "left").join(right, [key, "j"], "left")
    clash = F.coalesce("ti", F.lit(False)) | F.coalesce("tj", F.lit(False))
    count = lambda when: F.sum(F.when(when, 1).otherwise(0))
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return marked.groupBy(key).agg(count(a & b).alias("tp"), count(a & ~b & ~clash).alias("fp"), count(b & ~a).alias("fn"), count(a & ~b & clash).alias("fm"))
