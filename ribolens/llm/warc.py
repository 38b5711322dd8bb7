"""WARC records in ZIP packages: written with revisits of equal payloads, read back in ranges without extraction."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribolens.llm.shared import shared_dir, small_batches, written

#: Bytes of compressed records after which a package is closed.
PACKAGE_BYTES = 8 << 20
#: Payloads shorter than this are never revisits.
LEAST_SHARED = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of a package that one task fetches records from.
STRIDE = 4 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEXED = "package string, page_id long, start long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or (first given) a revisit of that page's response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        *([f"WARC-Target-URI: {json.dumps(url)[1:-1]}"] if url is not None else []),
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {_REVISIT}"] if first is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; a response's payload is digested anew and held against its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, number = fields["WARC-Payload-Digest"].removeprefix("sha256:"), lambda x: int(x) if (x := x[len("<urn:page:") : -1]) else None
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != told or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what its header says")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": json.loads(f'"{fields["WARC-Target-URI"]}"') if "WARC-Target-URI" in fields else None,
        "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload_bytes": told,
        "payload_digest": digest,
        "payload": payload if response else None,
    }


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_first(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, payload, digest, first): first is the smallest page_id of an equal payload of at least ``least``
    bytes, null on that page itself. Payloads are grouped by digest with partial aggregates; pages then meet their
    ``first`` by page_id, so a payload that a third of the pages share is dealt evenly."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    marks = rows.where(F.octet_length("payload") >= least).select("page_id", "digest")
    firsts = marks.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    again = marks.distinct().join(firsts, "digest").where("page_id IS NULL OR page_id > first").select(F.col("page_id").alias("__page"), F.col("digest").alias("__digest"), "first")
    return rows.join(again, F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest")), "left").drop("__page", "__digest")


def write_packages(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", package_bytes: int = PACKAGE_BYTES, least: int = LEAST_SHARED) -> DataFrame:
    """Writes a WARC record per row of pages(page_id, url, html) into ZIP packages in ``folder``; returns their paths.

    folder is a URI that all executors reach. A package holds its records gzipped one by one in a stored member, with a
    stored index of them. A package is written whole under a new name, so a task that runs twice leaves one that
    nobody lists. Null html is an empty payload; null page_id and url are kept; repeated rows give repeated records.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _files(folder)
        files.create_dir(root)
        body, index = io.BytesIO(), []

        def close() -> pd.DataFrame:
            name = f"{uuid.uuid4().hex}.wacz"
            with files.open_output_stream(f"{root}/{name}") as out:
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED) as z:
                    z.writestr(DATA, body.getbuffer())
                    z.writestr(INDEX, "\n".join(index))
                out.write(held.getbuffer())
            body.seek(0)
            body.truncate()
            index.clear()
            return pd.DataFrame({"package": [f"{folder}/{name}"]})

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                known = lambda x: None if pd.isna(x) else int(x)
                data = gzip.compress(record(known(page_id), url, bytes(payload), digest, known(first), date), 6, mtime=0)
                index.append(json.dumps({"page_id": known(page_id), "offset": body.tell(), "length": len(data)}))
                body.write(data)
                if body.tell() >= package_bytes:
                    yield close()
        if index:
            yield close()

    small_batches(pages.sparkSession)
    rows = with_first(pages, least).select("page_id", "url", "payload", "digest", "first")
    # page numbers over 2**53 stay exact: pandas would turn longs with nulls into doubles
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "first")})
    return written(rows.mapInPandas(write, "package string"), "packages")


def locate(packages: DataFrame) -> DataFrame:
    """The records of packages(package): their absolute places, from each package's directory and index."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ribolens.llm.ziparchive import data_start, directory, read_range

        for batch in batches:
            for uri in batch["package"]:
                files, path = _files(uri)
                with files.open_input_file(path) as file:
                    members = {m.name: m for m in directory(file, file.size())}
                    data, at = data_start(file, members[DATA]), data_start(file, members[INDEX])
                    lines = read_range(file, at, members[INDEX].size).decode().splitlines()
                rows = [json.loads(x) for x in lines]
                yield pd.DataFrame({"package": uri, "page_id": pd.array([r["page_id"] for r in rows], "Int64"), "start": [data + r["offset"] for r in rows], "length": [r["length"] for r in rows]})

    return packages.select("package").repartition("package").mapInPandas(find, INDEXED)


def fetch(places: DataFrame) -> DataFrame:
    """Reads the records at places(package, start, length), each by its range; a task reads runs of STRIDE bytes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ribolens.llm.ziparchive import read_range

        for batch in batches:
            for uri, group in batch.groupby("package"):
                files, path = _files(uri)
                with files.open_input_file(path) as file:
                    rows = [parse(gzip.decompress(read_range(file, int(s), int(n)))) for s, n in zip(group["start"], group["length"], strict=True)]
                yield pd.DataFrame(rows).astype({"page_id": "Int64", "refers_to": "Int64"})

    small_batches(places.sparkSession)
    places = written(places, "places")  # short rows, for which the packages are opened once
    near = F.floor(F.col("start") / STRIDE)
    total = places.agg(F.sum("length")).first()[0] or 0
    return places.repartition(max(1, -(-total // STRIDE)), F.col("package"), near).mapInPandas(read, RECORDS)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as records and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    packages = write_packages(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return fetch(locate(packages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
