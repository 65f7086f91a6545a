"""WARC archives of page captures: writing, reading back, and the merged capture index.

``write`` turns each page into one WARC/1.1 record and lets Spark's text writer store them: the record separator of
the format, CR LF CR LF, is the writer's line separator, so files are written in parallel under Spark's commit
protocol, to any store.  Of records with equal payloads of at least ``MIN_REVISIT`` bytes, the one with the smallest
page id carries the payload; the others are revisit records that refer to it and repeat its HTTP header.

``read`` parses archives file by file; each file yields a capture run, sorted by (URL key, timestamp, page id).
``merge`` range-partitions the runs by the same key, which splits a hot URL by time, and merges the pieces of the
runs that meet in a partition with a loser tree.  Partitions follow each other in key order, so the capture history
is globally ordered.

Defined cases: a null html is an empty payload; a null url has no target line and reads back as null, with the empty
key; a null page id sorts last and is never referred to; equal rows each get their own record, the first of equal
ids with equal payloads being told apart by nothing, so all of the smallest id are responses; control characters and
spaces in urls are percent-encoded; archives of several gzip members, such as one for each record, are read whole, and
offsets count uncompressed bytes; an empty table gives empty archives and an empty index; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from odflux.llm._common import durable, least_heavy, meet, numbered, remove, scratch

MIN_REVISIT = 100
CRLF = "\r\n"
#: Captures without a timestamp column are dated one second apart, by page id, from this instant.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = StructType(
    [
        StructField("run", StringType()),
        StructField("url_key", StringType()),
        StructField("captured", StringType()),
        StructField("page_id", LongType()),
        StructField("offset", LongType()),
        StructField("record_type", StringType()),
        StructField("refers_to", LongType()),
        StructField("payload_bytes", LongType()),
        StructField("payload_digest", StringType()),
        StructField("url", StringType()),
    ]
)


def capture_time(page_id: Column) -> Column:
    at = F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(1 << 31)))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(pages: DataFrame) -> DataFrame:
    """One row for each page with its record's text in ``value``."""
    page = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "[\\x00-\\x09\\x0B\\x0C\\x0E-\\x20\\x7F]", "%20"), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    measured = page.withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    # a payload of very many pages is spread over tasks, and small ones, which meet nothing, lie anywhere
    measured = measured.withColumn("key", F.when(F.col("size") >= MIN_REVISIT, F.col("digest")))
    groups = measured.where("key is not null").groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k"))
    groups = durable(groups.where("k > 1"))
    joined = meet(measured, groups, "key", least_heavy(groups.agg(F.sum("k")).first()[0] or 0), ["page_id", "url"], "left")
    revisit = (F.col("size") >= MIN_REVISIT) & (F.col("page_id") != F.col("first"))
    revisit = F.coalesce(revisit, (F.col("size") >= MIN_REVISIT) & F.col("page_id").isNull() & F.col("first").isNotNull())
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    some = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", capture_time(F.col("page_id"))),
        some("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
        F.lit(CRLF),
    )
    return joined.select(F.concat(header, http, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, path: str, records_per_file: int = 20_000) -> None:
    """Write the archives of all pages under ``path``, gzip-compressed."""
    writer = records(pages).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
    writer.text(path)


def url_key(url: str | None) -> str:
    """Host labels reversed, then the rest: captures of one site sort together."""
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://([^/?#]*)([^#]*)", url or "")
    if not m:
        return url or ""
    host = m[1].rpartition("@")[2].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, named fields and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(fields["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at offset {at} doesn't end where it says")
        yield at, fields, data[end + 4 : stop]
        at = stop + 4


def unpacked(content: bytes) -> bytes:
    """An archive as it was before compression: any number of gzip members one after another, or none."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(content))
        if not member.eof:
            raise ValueError("a gzip member is cut off")
        content = member.unused_data
    return b"".join(parts)


def page_of(uri: str | None) -> int | None:
    digits = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def order(row: tuple) -> tuple:
    """Key of an index row: URL key, timestamp, page id with null last, run and offset."""
    return row[1], row[2], row[3] is None, row[3] or 0, row[0], row[4]


def entries(path: str, content: bytes) -> list[tuple]:
    """The capture run of one archive, sorted; payloads are checked against their digests."""
    out = []
    for at, f, block in parse(unpacked(content)):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
        if f["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of {f['WARC-Record-ID']} in {path} is damaged")
        url = f.get("WARC-Target-URI")
        refers = page_of(f.get("WARC-Refers-To"))
        out.append((path, url_key(url), f["WARC-Date"], page_of(f["WARC-Record-ID"]), at, f["WARC-Type"], refers, size, digest, url))
    return sorted(out, key=order)


def batch_of(rows: list[tuple], schema: StructType = INDEX) -> pa.RecordBatch:
    kinds = [pa.int64() if f.dataType == LongType() else pa.string() for f in schema]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The index rows of all archives under ``path``: one sorted run for each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                yield batch_of(entries(name.as_py(), content.as_py()))

    return files.mapInArrow(run, INDEX)


class LoserTree:
    """K-way merge: inner nodes keep the loser of each match, the winner is replaced along one leaf-to-root path."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else order(h) for h in self.heads]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None
        return self.keys[a] < self.keys[b]

    def _replay(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) >> 1
        while node > 0:
            held = self.tree[node]
            if held < 0 and building:
                self.tree[node] = winner
                return
            if self._beats(held, winner):
                self.tree[node], winner = winner, held
            node >>= 1
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self.heads[w] = head = next(self.runs[w], None)
            self.keys[w] = None if head is None else order(head)
            self._replay(w)


def merge(index: DataFrame) -> DataFrame:
    """Index rows in global order of URL key, timestamp and page id, merged from their sorted runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(row[0], []).append(row)
        # a shuffle may hand over pieces of a run out of turn
        pieces = [sorted(r, key=order) for _, r in sorted(runs.items())]
        out: list[tuple] = []
        for row in LoserTree(pieces):
            out.append(row)
            if len(out) == 10_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return index.repartitionByRange("url_key", "captured", "page_id", "run", "offset").mapInArrow(run, INDEX)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archives, read them back, and return the merged index, with each record's place in it as ``place``.

    Without a path of the caller's the archives go to the shared folder and are removed once the index is durable.
    """
    spark = pages.sparkSession
    where = path or scratch(spark, "warc")
    write(pages, where)
    index = read(spark, where)
    if path is None:
        index = durable(index)
        remove(spark, where)
    return numbered(merge(index), "place")[0]


def oracle() -> str:
    """DuckDB SQL for the columns of ``round_trip`` that the query returns, over ``pages`` with distinct ids."""
    return rf"""
WITH base AS (
  SELECT page_id, coalesce(html, '') AS html,
    regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '[\x00-\x09\x0B\x0C\x0E-\x20\x7F]', '%20', 'g'), '\r', '%0D', 'g'), '\n', '%0A', 'g') AS url FROM pages),
sized AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
    regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') AS whole, url,
    regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '')), '^www\.', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS tail,
    strftime(TIMESTAMP '{EPOCH:%Y-%m-%d %H:%M:%S}' + to_seconds(coalesce(page_id, 0) % {1 << 31}), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM base),
led AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first,
    CASE WHEN whole THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN tail = '' THEN '/' ELSE tail END ELSE url END AS url_key FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to,
  url_key, captured, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS place
FROM led"""
