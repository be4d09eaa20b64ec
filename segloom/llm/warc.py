"""WARC records and their Merkle fixity audit.

Each record is hashed; the records of a file, in order of their offsets, are hashed by ranges of bytes;
ranges are hashed FANOUT at a time into a tree. Two replicas are compared from the roots on, and only
branches that differ are descended, down to the records that are damaged.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialise

#: Pages of consecutive page_id in a file, bytes of a range, children of a node.
PAGES, RANGE, FANOUT = 4096, 1 << 16, 16


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a response record; null values are empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(url, F.lit("")), "[\r\n]", ""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def _named(pages: DataFrame, pages_per_file: int) -> DataFrame:
    return pages.select(
        F.coalesce(F.floor(F.col("page_id") / pages_per_file), F.lit(-1)).cast("long").alias("file_id"),
        "page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"),
    )


def _placed(rows: DataFrame) -> DataFrame:
    before = Window.partitionBy("file_id").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def records(pages: DataFrame, pages_per_file: int = PAGES) -> DataFrame:
    """(file_id, offset, length, page_id, record): pages in files by page_id, in order of page_id and digest.

    Repeated rows are records of their own. Pages without page_id are in file -1. Only page_id, url and html
    are read; an empty table gives no rows.
    """
    rows = _named(pages, pages_per_file).withColumns({"length": F.octet_length("record").cast("long"), "digest": F.sha2("record", 256)})
    return _placed(rows).select("file_id", "offset", "length", "page_id", "record")


def manifest(pages: DataFrame, pages_per_file: int = PAGES) -> DataFrame:
    """(file_id, offset, length, page_id, digest) of records(), the digest being the record's SHA-256.

    Records are hashed where they are read, so only digests are shuffled.
    """
    rows = _named(pages, pages_per_file).select("file_id", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    return _placed(rows).select("file_id", "offset", "length", "page_id", "digest")


def drill(pages: DataFrame, pages_per_file: int = PAGES) -> tuple[DataFrame, DataFrame]:
    """The manifest of pages and that of a replica with known damage, by the hash of page_id: of 256 records one is altered in its middle, one is lost.

    Every record of the replica is hashed from its own content. A lost record leaves a gap, as a hole in a file does:
    the others stay where they are.
    """
    named = _named(pages, pages_per_file)
    mark = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    middle = F.floor(F.length("record") / 2).cast("int")
    altered = F.concat(F.substring("record", 1, middle), F.lit("\u0000"), F.substring(F.col("record"), middle + 2, F.length("record")))
    replica = F.when(mark == "00", altered).otherwise(F.col("record"))
    rows = named.select(
        "file_id", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), mark.alias("mark"),
        F.octet_length(replica).cast("long").alias("their_length"), F.sha2(replica, 256).alias("their_digest"),
    )
    placed = materialise(_placed(rows), "drill")
    theirs = placed.where("mark <> '01'").select("file_id", "offset", F.col("their_length").alias("length"), "page_id", F.col("their_digest").alias("digest"))
    return placed.select("file_id", "offset", "length", "page_id", "digest"), theirs


def tree(leaves: DataFrame, levels: int, range_bytes: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes (file_id, node, hash) of each level, ranges first, roots last; each is written once, and the next is made of it."""

    def combine(rows: DataFrame, node: Column, order: str, line: Column) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
        return rows.groupBy("file_id", node.alias("node")).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("hash"))

    line = F.concat_ws(":", "offset", "length", "digest")
    found = [materialise(combine(leaves, F.floor(F.col("offset") / range_bytes), "offset", line), "nodes")]
    for _ in range(levels):
        found.append(materialise(combine(found[-1], F.floor(F.col("node") / fanout), "node", F.concat_ws(":", "node", "hash")), "nodes"))
    return found


def depth(leaves: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> int:
    """Levels over the ranges until every file has one node."""
    most = leaves.agg(F.max("offset")).first()[0]
    nodes, levels = (most or 0) // range_bytes + 1, 0
    while nodes > 1:
        nodes, levels = -(-nodes // fanout), levels + 1
    return levels


def audit(ours: DataFrame, theirs: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """(file_id, offset, page_id, length, kind, our_digest, their_digest) of each record in which two manifests differ.

    kind: "changed"; "missing", if only ours has a record there; "extra", if only theirs has. Records are held
    against each other by file and offset; where one manifest lists several records at one place, they are
    compared in order of their digests. What stands at another offset is another place: a replica that closed the gap
    of a lost record differs from there to the end of that file, each record being missing and extra. page_id and length are ours, or theirs for what is extra. Rows whose
    file_id or offset is null are left out. Equal manifests give no rows.
    """
    keep = lambda m, name: materialise(m.where("file_id is not null and offset is not null"), name)
    ours, theirs = keep(ours, "ours"), keep(theirs, "theirs")
    levels = max(depth(ours, range_bytes, fanout), depth(theirs, range_bytes, fanout))
    mine, other = tree(ours, levels, range_bytes, fanout), tree(theirs, levels, range_bytes, fanout)

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.withColumnRenamed("hash", "a").join(b.withColumnRenamed("hash", "b"), ["file_id", "node"], "full")
        return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("file_id", "node")

    bad = materialise(differing(mine[-1], other[-1]), "branches")
    for level in range(levels - 1, -1, -1):
        parent = bad.withColumnRenamed("node", "parent")
        below = lambda nodes: nodes.withColumn("parent", F.floor(F.col("node") / fanout)).join(parent, ["file_id", "parent"], "left_semi").drop("parent")  # noqa: B023, E731
        bad = materialise(differing(below(mine[level]), below(other[level])), "branches")

    def inside(m: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("file_id", "offset").orderBy("digest", "length", "page_id"))
        return m.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(bad, ["file_id", "node"], "left_semi").withColumn("nth", nth)

    a = inside(ours).select("file_id", "offset", "nth", F.struct("page_id", "length", "digest").alias("a"))
    b = inside(theirs).select("file_id", "offset", "nth", F.struct("page_id", "length", "digest").alias("b"))
    both = a.join(b, ["file_id", "offset", "nth"], "full")
    either = F.coalesce("a", "b")
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    differs = F.col("a").isNull() | F.col("b").isNull() | ~F.col("a.digest").eqNullSafe(F.col("b.digest")) | (F.col("a.length") != F.col("b.length"))
    return both.where(differs).select(
        "file_id", "offset", either["page_id"].alias("page_id"), either["length"].alias("length"), kind.alias("kind"),
        F.col("a.digest").alias("our_digest"), F.col("b.digest").alias("their_digest"),
    )


ORACLE = f"""
WITH r AS (
  SELECT coalesce(CAST(floor(page_id / {PAGES}) AS BIGINT), -1) AS file_id, page_id,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
         || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), ''), chr(10), '') || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages),
o AS (
  SELECT *, strlen(record) AS length, substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS mark,
         coalesce(sum(strlen(record)) OVER (PARTITION BY file_id ORDER BY page_id, sha256(record) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM r)
SELECT file_id, CAST(begins AS BIGINT) AS "offset", page_id, CAST(length AS BIGINT) AS length,
       CASE mark WHEN '00' THEN 'changed' ELSE 'missing' END AS kind, sha256(record) AS our_digest,
       CASE mark WHEN '00' THEN sha256(substr(record, 1, length(record) // 2) || chr(0) || substr(record, length(record) // 2 + 2)) END AS their_digest
FROM o WHERE mark IN ('00', '01')
"""


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields in lower case, body) of each record of a WARC file; gzip members are opened.

    Stops at what isn't a record. Offsets and lengths of a compressed file count its uncompressed bytes.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while data[at : at + 5] == b"WARC/":
        head = data.find(b"\r\n\r\n", at)
        if head < 0:
            return
        lines = data[at:head].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = fields.get("content-length", "")
        if not size.isdigit() or head + 4 + int(size) > len(data):
            return
        end = head + 4 + int(size)
        to = end + 4 if data[end : end + 4] == b"\r\n\r\n" else end
        yield at, to - at, fields, data[head + 4 : end]
        at = to


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, record_id, url, type, body, digest) of all records of the WARC files at path."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("type", pa.string()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [
                    dict(zip(schema.names, (name, at, n, f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-type"), body)))
                    for at, n, f, body in parse(data)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = "file string, offset long, length long, record_id string, url string, type string, body binary"
    return files.mapInArrow(run, kind).withColumn("digest", F.sha2("body", 256))
