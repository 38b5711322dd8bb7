"""Sharding by weighted rendezvous hashing: DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task numbers when slots are given out.
SLOT_ROWS = 50_000


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that only the key and the shard decide: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _best(key: Column, weights: Sequence[float], shards: range) -> Column:
    """(score, shard) of the best of ``shards``: the largest weight / -ln(draw), of ties the larger shard."""
    scored = [F.struct((F.lit(float(weights[k])) / -F.log(draw(key, k))).alias("score"), F.lit(k).alias("shard")) for k in shards if weights[k] > 0]
    return F.array_max(F.array(*scored)) if scored else F.lit(None).cast("struct<score: double, shard: int>")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the largest weight / -ln(draw); ties go to the larger shard.

    A shard more (or a weight raised) can only win rows for itself, so on average its share of the rows moves and
    no others. Shards of weight 0 take none.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("rendezvous needs a shard of positive weight")
    return _best(key, weights, range(len(weights)))["shard"]


def shard_records(rows: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """rows with shard, slot (0, 1, ... in each shard without gaps) and grown_shard (under the weights ``grown``).

    Slots count a shard's rows by (hash bucket, key, then ``order``); the bucket is decided by key and ``order``. They are
    numbered inside buckets of about SLOT_ROWS rows and shifted by the sizes of the buckets before, so no task holds a
    whole shard, nor all rows of one key unless they are equal in ``order`` too.
    Null keys act as one key named "null". Repeated rows each get a slot. An empty table gives an empty result.
    Columns of rows named shard, slot or grown_shard are replaced.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("rendezvous needs a shard of positive weight")
    total = rows.count()
    buckets = max(1, -(-total // (SLOT_ROWS * max(1, len(weights)))))
    placed = rows.drop("shard", "slot", "grown_shard").withColumn("__best", _best(F.col(key), weights, range(len(weights))))
    more = F.lit(None).cast("int")
    if grown and list(grown[: len(weights)]) == list(weights):  # only the new shards are drawn besides
        more = F.greatest(F.col("__best"), _best(F.col(key), grown, range(len(weights), len(grown))))["shard"]
    elif grown:
        more = rendezvous(F.col(key), grown)
    spread = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (key, *order)])
    placed = placed.withColumns({"shard": F.col("__best.shard"), "grown_shard": more, "__bucket": F.floor(draw(spread, -1) * buckets).cast("int")}).drop("__best")
    sizes = placed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("shard", "__bucket", (F.sum("__n").over(_window(["shard"], ["__bucket"])) - F.col("__n")).alias("__before"))
    numbered = placed.withColumn("__rank", F.row_number().over(_window(["shard", "__bucket"], [key, *order])))
    joined = numbered.join(before, ["shard", "__bucket"])
    return joined.withColumn("slot", (F.col("__before") + F.col("__rank") - 1).cast("long")).drop("__bucket", "__before", "__rank")


def _window(by: list[str], order: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents over 24 equal shards by law ``key``; 25 shards for grown_shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = shard_records(rows, "doc_id", [1.0] * 24, [1.0] * 25, ["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: CRC-32 is folded byte by byte over its table, which eight shifts for each byte value make; the draws are MD5 digits.
OP7_SQL = """
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS data, text IS NULL AS none FROM documents),
b AS (SELECT doc_id, CASE WHEN none THEN 0 ELSE octet_length(data) END + 8 AS size, list_transform(regexp_extract_all(hex(data), '..'), lambda h: CAST(16 * (strpos('0123456789ABCDEF', h[1]) - 1) + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(crc[xor(c % 256, x) + 1], c // 256)), 4294967295) AS text_crc32 FROM b, steps),
p AS (SELECT *, list_transform(range(25), lambda k: substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', k)), 1, 13)) AS draws,
  substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', size, ':', text_crc32, ':-1')), 1, 13) AS spread FROM c),
s AS (SELECT *, list_position(draws, list_max(draws[1:24])) - 1 AS shard, list_position(draws, list_max(draws)) - 1 AS grown,
  floor((CAST(('0x' || spread) AS BIGINT) + 0.5) / 4503599627370496.0 * greatest(1, ceil((SELECT count(*) FROM documents) / 1200000.0))) AS bucket FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM s
"""
