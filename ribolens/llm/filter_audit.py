"""Audit of filters in every order: what each removes, alone and after the others, by a Gray-code walk over subsets."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The filters of the registered query, in the bits of a mask from the lowest on.
LETTERS = "ABCDE"
COUNTED = ("n", "good", "toxic")


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A (under 200 words), B (under half of its words distinct), C (over 3 % of its code points are
    A to Z) and D (holds any of ``#$%&*|``). A null text is the empty text; without words B and C hold no failure."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    upper = F.octet_length(F.regexp_replace(text, "[^A-Z]", ""))
    return [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * upper > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good, toxic) with one row for each labelled document: any of its labels counts."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    return known.agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part (a lang; null is the empty string) by the filters that they fail.

    Filter E fails where any smaller doc_id of the whole table has the same text (by its SHA-256), removed or not. A null
    doc_id is neither smaller nor larger than others and has no label. Rows with one doc_id and text don't fail for each
    other. Extra columns are left out.

    Texts are read once; only digests and masks are shuffled. Equal rows are counted before each shuffle, so a text or a
    doc_id of a third of all rows arrives as a count: nothing gathers the rows of a group.
    """
    fails = text_failures(docs["text"])
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(fails)), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), digest.alias("digest"), mask.alias("mask"), F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"))
    counted = rows.groupBy("doc_id", "digest", "mask", "part").agg(F.count(F.lit(1)).alias("n"))
    # rows without a doc_id meet no label, and are dealt by their digests rather than to one task
    spread = counted.withColumn("spread", F.coalesce("doc_id", F.xxhash64("digest")))
    tagged = labelled(labels).withColumnRenamed("doc_id", "spread")
    known = spread.join(tagged, (spread["spread"] == tagged["spread"]) & spread["doc_id"].isNotNull(), "left").na.fill(0, ["good", "toxic"])
    # one row for each text, part and kind of label, with its smallest doc_id and the rows of that
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    nulls = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nulls")
    kinds = known.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), least, nulls)
    # only as many rows for each text as there are parts and kinds of labels
    held = F.array(F.struct(F.lit(False).alias("again"), F.col("first").alias("n")), F.struct(F.lit(True).alias("again"), (F.col("n") - F.col("first")).alias("n")))
    first = F.col("nulls") + F.when(F.col("least.doc_id") == F.col("smallest"), F.col("least.n")).otherwise(0)
    smallest = F.min("least.doc_id").over(Window.partitionBy("digest"))
    split = kinds.withColumn("smallest", smallest).withColumn("first", first).select("part", "mask", "good", "toxic", F.inline(held))
    whole = split.select("part", (F.col("mask") + F.col("again").cast("int") * (1 << len(fails))).alias("mask"), "n", (F.col("good") * F.col("n")).alias("good"), (F.col("toxic") * F.col("n")).alias("toxic"))
    return whole.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTED])


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """states[subset]: what is left of cells[mask] (rows of counts) when the subset's filters are applied.

    The walk visits all subsets so that two neighbours differ in one filter. Each mask's number of active filters that it
    fails goes up or down by one where it fails the toggled filter; it leaves the running survivors as that number leaves
    zero, and returns with zero.
    """
    masks = np.arange(len(cells))
    fails, left = np.zeros(len(cells), np.int64), cells.sum(axis=0)
    states = np.zeros_like(cells)
    states[0], active = left, 0
    for turn in range(1, len(cells)):
        bit = turn & -turn
        active ^= bit
        hit = (masks & bit) != 0
        if active & bit:
            left = left - cells[hit & (fails == 0)].sum(axis=0)
            fails[hit] += 1
        else:
            fails[hit] -= 1
            left = left + cells[hit & (fails == 0)].sum(axis=0)
        states[active] = left
    return states


def step_rows(states: np.ndarray, letters: str) -> list[tuple]:
    """(filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders,
    each a difference of states: column 0 counts rows, 1 good ones, 2 toxic ones."""
    k = len(letters)
    full = (1 << k) - 1
    failing, unique = (states[0, 0] - states[1 << np.arange(k), 0]).tolist(), (states[full ^ (1 << np.arange(k)), 0] - states[full, 0]).tolist()
    steps = []
    for order in permutations(range(k)):
        active, name = 0, "".join(letters[f] for f in order)
        for step, f in enumerate(order, 1):
            after = active | 1 << f
            lost = (states[active] - states[after]).tolist()
            steps.append((name, step, f, int(states[after, 0]), lost[0], failing[f] - lost[0], unique[f], lost[1], lost[2]))
            active = after
    shapley = [0] * k
    for row in steps:
        shapley[row[2]] += row[4]
    return [(*row[:2], letters[row[2]], *row[3:], shapley[row[2]]) for row in steps]


STEPS = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step of cells(part, mask, n, good, toxic); see step_rows.

    Sums of all orders stand for the Shapley value times their number, k!. A part is a group of 2 ** k cells at most.
    An empty table has no parts and gives no rows.
    """
    size, names = 1 << len(letters), [f.split()[0] for f in STEPS.split(", ")]

    def walk(held: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((size, len(COUNTED)), np.int64)
        counts[held["mask"].to_numpy()] = held[list(COUNTED)].to_numpy(np.int64)
        out = pd.DataFrame(step_rows(gray_walk(counts), letters), columns=names[1:])
        out.insert(0, "part", held["part"].iloc[0])
        return out

    return cells.groupBy("part").applyInPandas(walk, STEPS)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The five filters over all documents, in all 120 orders, for each lang."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(failure_cells(docs, labels))


_BIT = "(CASE x WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END)"
OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
  CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, FALSE) THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
o AS (SELECT a.x || b.x || c.x || e.x || f.x AS filter_order FROM (SELECT unnest(string_split('ABCDE', '')) AS x) a, (SELECT unnest(string_split('ABCDE', '')) AS x) b, (SELECT unnest(string_split('ABCDE', '')) AS x) c,
  (SELECT unnest(string_split('ABCDE', '')) AS x) e, (SELECT unnest(string_split('ABCDE', '')) AS x) f WHERE len(list_distinct([a.x, b.x, c.x, e.x, f.x])) = 5),
s AS (SELECT filter_order, step, x, {_BIT} AS bit, CAST(list_sum(list_transform(string_split(filter_order[1:step - 1], ''), lambda x: CASE x WHEN '' THEN 0 ELSE {_BIT} END)) AS BIGINT) AS before
  FROM (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS x FROM o, range(1, 6) r(step))),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
r AS (SELECT part, filter_order, step, x AS filter, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""
