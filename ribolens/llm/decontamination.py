"""Benchmark decontamination by SimHash over item-sized windows: DataFrame functions only.

A window of a document is as long, in words, as a benchmark item; a shorter document is one window. Every window in which
enough shingles occur in items of that length is made: all others fall short of the similarity, whatever the item.
Windows and items get 64-bit SimHash fingerprints. Eight blocks of 8 bits, each probed within 2 bits, give all pairs of
windows and items of equal length within 23 bits; the exact weighted Jaccard similarity of the shingle multisets decides.
Windows of equal words, from however many documents, are fingerprinted, looked up and compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribolens.llm.shared import sized, written

WORDS, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_BITS, PROBE_BITS = 8, 8, 2
#: Pairs of fingerprints that differ in so many bits at most are all found.
RADIUS = BLOCKS * (PROBE_BITS + 1) - 1
#: A block is probed under every value that differs by one of these masks.
MASKS = [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= PROBE_BITS]
#: Different shingles of the benchmark, two short numbers a row, that are broadcast at most; more are shuffled.
SHINGLE_ROWS = 2_000_000
_HALVES = 0x0000000100000001


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none of a null text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _shingles(rows: DataFrame, hashes: str, k: int, keep: list[str]) -> DataFrame:
    """A row (keep..., pos, shingle) for each k neighbouring words; pos from 0."""
    last = F.greatest(F.size(hashes), F.lit(1))
    shifted = [F.col(hashes) if n == 0 else F.slice(hashes, n + 1, last) for n in range(k)]
    zipped = F.arrays_zip(*[c.alias(f"h{n}") for n, c in enumerate(shifted)])
    named = rows.select(*keep, F.posexplode(zipped).alias("pos", "z"))
    parts = [F.col("z").getField(n) for n in named.schema["z"].dataType.fieldNames()]
    return named.where(parts[-1].isNotNull()).select(*keep, "pos", F.xxhash64(*parts).alias("shingle"))


def _fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of each group's shingles, weighted by how often they occur: bit b is set if most hashes have it.

    Two bits are counted in one long (bits j and j + 32), which holds for groups of under 2**31 shingles.
    """
    counts = [F.sum(F.shiftrightunsigned("shingle", j).bitwiseAND(F.lit(_HALVES))).alias(f"c{j}") for j in range(32)]
    summed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *counts)
    bits = None
    for j in range(32):
        for at, n in ((j, F.col(f"c{j}").bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(f"c{j}", 32))):
            bit = F.when(n * 2 > F.col("total"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
            bits = bit if bits is None else bits.bitwiseOR(bit)
    return summed.select(*keys, "total", bits.alias("print"))


def _blocks(prints: DataFrame) -> DataFrame:
    block = [F.struct(F.lit(b).alias("b"), F.shiftrightunsigned("print", b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("v")) for b in range(BLOCKS)]
    return prints.select("*", F.inline(F.array(*block)))


def near_prints(windows: DataFrame, items: DataFrame) -> DataFrame:
    """All pairs (n, print, item_print) of fingerprints of windows and items, of equal n, that differ in RADIUS bits at most.

    If they do, some block differs in PROBE_BITS bits at most; items are filed under every such value of each block. Equal
    fingerprints are looked up once. The join is a shuffled one: Spark's size estimate doesn't see the probes.
    """
    spread = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = items.select("n", "print").distinct().repartition(spread, "n", "print")
    probes = _blocks(filed).select("n", "b", F.col("print").alias("item_print"), F.explode(F.array(*[F.col("v").bitwiseXOR(F.lit(m)) for m in MASKS])).alias("v"))
    met = _blocks(windows.select("n", "print").distinct()).join(probes.hint("merge"), ["n", "b", "v"])
    return met.where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("n", "print", "item_print").distinct()


def _starts(similarity: float) -> Column:
    """Where windows of n words begin that hold ``need`` of the sorted places ``found`` at least, each start once: by the
    first place that a window holds."""
    width = F.col("n") - F.col("k") + 1  # shingles of a window

    def at(i: Column) -> Column:
        first, last = F.get("found", i), F.get("found", i + F.col("need") - 1)
        low = F.greatest(F.lit(0), F.coalesce(F.get("found", i - 1) + 1, F.lit(0)), last - width + 1)
        high = F.least(first, F.col("have") - F.col("n"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(F.col("have") < F.col("n"), F.array(F.lit(0))).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size("found") - F.col("need")), at)))


def item_windows(hashed: DataFrame, filed: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, version, n, start): the windows of hashed(doc_id, version, h) that can be similar to some item of n words.

    filed has the items' shingles of ``size`` words. Of a window and an item of a and b shingles, similarity s needs
    s / (1 + s) * (a + b) common ones; so many places of the window have to hold a shingle of items of that length. A
    document's places are gathered in one row; it is no longer than its text.
    """
    places = sized(filed.select("shingle", "n").distinct(), SHINGLE_ROWS)
    met = _shingles(hashed.withColumn("have", F.size("h")), "h", size, ["doc_id", "version", "have"]).join(places, "shingle")
    found = met.groupBy("doc_id", "version", "have", "n").agg(F.array_sort(F.collect_set("pos")).alias("found")).withColumn("k", F.lit(size))
    shingles = F.col("n") + F.least("have", "n") - 2 * (size - 1)
    need = F.greatest(F.lit(1), F.ceil(shingles * (similarity / (1 + similarity)) - 1e-6)).cast("int")
    enough = found.withColumn("need", need).where(F.size("found") >= F.col("need"))
    return enough.select("doc_id", "version", "n", F.explode(_starts(similarity)).alias("start"))


def _all_shingles(rows: DataFrame, sizes: list[int], k: int, keep: list[str]) -> DataFrame:
    """The shingles of rows(n, h): of n words where that is under k, else of k."""
    out = None
    for size in sizes:
        own = _shingles(rows.where(F.least("n", F.lit(k)) == size), "h", size, keep)
        out = own if out is None else out.unionByName(own)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, k: int = WORDS, by_text: bool = False) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): for each document and item the window most similar to the item,
    where that is ``similarity`` or more; ties go to the first window.

    docs has doc_id and text, benchmark item_id and text; other columns are left out. Null and empty texts match nothing.
    Items of under k words are compared as one shingle of all their words. Documents of fewer words than an item are
    one window of their own length, in shingles as long as the item's. Rows with a null doc_id
    are one document for each different text, and so are rows of one doc_id; ``by_text`` gives a row for each of them, with
    version (xxhash64 of the text) after doc_id, else the best of all is given. Repeated rows count once. Items without an item_id are left out; of
    items with one item_id any one is taken.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _hashed(F.col("text").cast("string")).alias("h"))
    items = written(items.withColumn("n", F.size("h")).where("n > 0 AND item_id IS NOT NULL").dropDuplicates(["item_id"]), "items")
    sizes = sorted({min(r["n"], k) for r in items.select(F.least("n", F.lit(k)).alias("n")).distinct().collect()})  # k numbers at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"doc_id long, {'version long, ' if by_text else ''}item_id long, start int, n_words int, similarity double")
    item_rows = written(_all_shingles(items, sizes, k, ["item_id", "n"]), "item-shingles")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    hashed = source.select("doc_id", F.xxhash64("text").alias("version"), _hashed(F.col("text")).alias("h"))
    windows = None
    for size in sizes:
        own = item_windows(hashed, item_rows.where(F.least("n", F.lit(k)) == size), size, similarity)
        windows = own if windows is None else windows.unionByName(own)
    windows = written(windows, "windows")
    text = source.select("doc_id", "text", F.xxhash64("text").alias("version")).withColumnsRenamed({"doc_id": "d", "version": "v"})
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("v") == F.col("version"))
    whole = text.join(sized(windows.select("doc_id", "version").distinct()), same, "left_semi").dropDuplicates(["d", "v"])
    cut = windows.join(whole.select("d", "v", _hashed(F.col("text")).alias("all")), same)
    cut = cut.select("doc_id", "version", "n", "start", F.slice("all", F.col("start") + 1, F.col("n")).alias("h"))
    content = ["n", "u0", "u1"]  # equal words, by 128 bits
    cut = written(cut.select("*", F.xxhash64("h").alias("u0"), F.xxhash64(F.lit(1), "h").alias("u1")), "cut")
    window_rows = written(_all_shingles(cut.select(*content, "h").dropDuplicates(content), sizes, k, content), "window-shingles")
    prints, item_prints = _fingerprint(window_rows, content), _fingerprint(item_rows, ["item_id", "n"]).withColumnRenamed("total", "item_total")
    pairs = written(near_prints(prints, item_prints), "near")
    item_prints = item_prints.withColumnsRenamed({"print": "item_print"})
    near = prints.join(sized(pairs), ["n", "print"]).join(sized(item_prints), ["n", "item_print"]).select(*content, "total", "item_id", "item_total")
    counted = window_rows.groupBy(*content, "shingle").agg(F.count(F.lit(1)).alias("times"))
    item_counts = item_rows.groupBy("item_id", "shingle").agg(F.count(F.lit(1)).alias("item_times"))
    both = near.join(counted, content).join(sized(item_counts), ["item_id", "shingle"])
    judged = both.groupBy(*content, "item_id", "total", "item_total").agg(F.sum(F.least("times", "item_times")).alias("shared"))
    judged = judged.withColumn("similarity", F.col("shared") / (F.col("total") + F.col("item_total") - F.col("shared"))).where(F.col("similarity") >= similarity)
    judged = written(judged.select(*content, "item_id", "similarity", (F.col("total") + F.least("n", F.lit(k)) - 1).cast("int").alias("n_words")), "judged")
    met = cut.select("doc_id", "version", "start", *content).join(sized(judged), content)
    best = F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start"))).alias("best")
    keys = ["doc_id", "version", "item_id"] if by_text else ["doc_id", "item_id"]
    return met.groupBy(*keys).agg(best).select(*keys, F.col("best.start").alias("start"), F.col("best.n_words").alias("n_words"), F.col("best.similarity").alias("similarity"))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: All windows of the item's length, of every document that shares a shingle with an item of that length.
OP1_SQL = r"""
WITH iw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, w, CAST(len(w) AS INTEGER) AS n, CAST(least(len(w), 5) AS INTEGER) AS k FROM iw WHERE len(w) > 0),
dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, w, CAST(len(w) AS INTEGER) AS have FROM dw WHERE len(w) > 0),
ish AS (SELECT item_id, n, k, array_to_string(w[p + 1 : p + k], ' ') AS s FROM (SELECT *, unnest(range(0, n - k + 1)) AS p FROM i)),
dsh AS (SELECT DISTINCT doc_id, k, array_to_string(w[p + 1 : p + k], ' ') AS s FROM (SELECT *, unnest(range(0, have - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM ish))),
met AS (SELECT DISTINCT doc_id, item_id, n, k FROM dsh JOIN ish USING (k, s)),
win AS (SELECT doc_id, n, k, w[start + 1 : start + n] AS w, start FROM (SELECT *, CAST(unnest(range(0, greatest(have - n, 0) + 1)) AS INTEGER) AS start FROM (SELECT DISTINCT doc_id, n, k FROM met) JOIN d USING (doc_id))),
wsh AS (SELECT doc_id, n, start, s, count(*) AS c FROM (SELECT doc_id, n, start, array_to_string(w[p + 1 : p + k], ' ') AS s FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS p FROM win)) GROUP BY ALL),
tot AS (SELECT doc_id, n, start, k, len(w) - k + 1 AS t, CAST(len(w) AS INTEGER) AS n_words FROM win),
ic AS (SELECT item_id, n, k, s, count(*) AS c FROM ish GROUP BY ALL),
shared AS (SELECT doc_id, n, start, item_id, sum(least(wsh.c, ic.c)) AS m FROM wsh JOIN ic USING (n, s) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, n_words, m / (t + n - k + 1.0 - m) AS similarity FROM shared JOIN tot USING (doc_id, n, start))
SELECT doc_id, item_id, start, n_words, CAST(similarity AS DOUBLE) AS similarity FROM sim WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
