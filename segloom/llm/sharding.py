"""Shards of even bytes out of indivisible groups, by Karmarkar-Karp differencing.

A partial partition is a tuple of one sum for each shard. The two of largest spread (greatest less least
sum) are combined in opposite order, largest with least, until one is left. One task differences a bounded
number of groups: of more, the largest are differenced first, and the others in buckets, each of which also
has its equal part of the large groups' partition to even out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TMP, emit, materialise, starts_of, whole_groups

#: Shards; most groups that are differenced at once, but for chance in the buckets' sizes.
SHARDS, BUCKET = 64, 4096


def difference(parts: np.ndarray) -> np.ndarray:
    """For partial partitions (n x shards): the shard of every slot of each, after all are combined.

    Ties go to the partition that comes first; one made of others counts from its first.
    """
    n, k = parts.shape
    if not n:
        return np.zeros((0, k), np.int64)
    down = np.argsort(-parts, axis=1, kind="stable")
    sums: list[np.ndarray | None] = list(np.take_along_axis(parts, down, 1))
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(int(s[-1]) - int(s[0]), i, i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, first, a = heapq.heappop(heap)
        _, second, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[a] = sums[b] = None
        made.append((a, b, order))
        sums.append(total)
        heapq.heappush(heap, (int(total[-1]) - int(total[0]), min(first, second), len(sums) - 1))
    where: list[np.ndarray | None] = [None] * len(sums)
    where[-1] = np.arange(k)
    for at in range(len(made) - 1, -1, -1):
        a, b, order = made[at]
        own = where[n + at]
        where[a], where[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        where[a][order] = own
        where[b][k - 1 - order] = own
        where[n + at] = None
    out = np.empty((n, k), np.int64)
    np.put_along_axis(out, down, np.stack(where[:n]), 1)
    return out


def _bucket(part: np.ndarray):
    """Arrow function over (bucket, unit, bytes) sorted: the shard of each unit; part: what each bucket's shards hold already."""
    schema = pa.schema([("unit", pa.int64()), ("shard", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "bucket"):
            bucket, unit, size = (table.column(c).to_numpy() for c in ("bucket", "unit", "bytes"))
            first = starts_of(bucket)
            for at, to in zip(first, np.r_[first[1:], len(bucket)]):
                parts = np.zeros((to - at + 1, len(part)), np.int64)
                parts[:-1, 0], parts[-1] = size[at:to], part
                goes = difference(parts)
                shard = np.empty(len(part), np.int64)
                shard[goes[-1]] = np.arange(len(part))
                yield emit(schema, unit[at:to], shard[goes[:-1, 0]])

    return run


def assign(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """(unit, shard) for groups(unit long, bytes long), one row a group.

    Up to `bucket` groups are differenced at once. Of more, the largest half a bucket is differenced first (ties by
    unit). The others are put in buckets of about that size by their hash, and each is differenced together with
    the large groups' partition divided by the number of buckets, so that the buckets' shards add up to even ones:
    the spread of all is at most the sum of the buckets' spreads. Groups of no bytes get a shard like others. Null
    units are left out, null bytes count as 0.
    """
    spark = groups.sparkSession
    units = groups.where("unit is not null").select("unit", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    units = materialise(units, "groups")
    n = units.count()
    part, buckets, large = np.zeros(shards, np.int64), 1, []
    if n > bucket:
        large = [tuple(r) for r in units.orderBy(F.desc("bytes"), "unit").limit(max(1, bucket // 2)).collect()]
        parts = np.zeros((len(large), shards), np.int64)
        parts[:, 0] = [size for _, size in large]
        where = difference(parts)[:, 0]
        buckets = -(-(n - len(large)) // bucket)
        part = np.bincount(where, parts[:, 0], shards).astype(np.int64) // buckets
        done = spark.createDataFrame([(u, int(s)) for (u, _), s in zip(large, where)], "unit long, shard int")
        units = units.join(F.broadcast(done.select("unit")), "unit", "left_anti")
    key = F.pmod(F.xxhash64("unit"), F.lit(buckets)) if buckets > 1 else F.lit(0).cast("long")
    rows = units.select(key.alias("bucket"), "unit", "bytes").repartition("bucket").sortWithinPartitions("bucket", "unit")
    found = rows.mapInArrow(_bucket(part), "unit long, shard int")
    return found.unionByName(done) if large else found


def _groups(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.xxhash64("text").alias("unit")).agg(F.sum(F.octet_length("text")).alias("bytes"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, text_hash, bytes, shard) for every row of docs; equal texts form an indivisible group.

    bucket: most groups or buckets that a task differences, as in assign(). bytes: of the text in UTF-8; a null text has none, and all null texts are one group. Repeated rows and
    rows whose doc_id is null are each returned. Only doc_id and text are read. No rows for an empty table.
    """
    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    slim = materialise(slim, "sizes")
    groups = slim.groupBy(F.col("text_hash").alias("unit")).agg(F.sum("bytes").alias("bytes"))
    return slim.join(assign(groups, shards, bucket).withColumnRenamed("unit", "text_hash"), "text_hash").select("doc_id", "text_hash", "bytes", "shard")


def with_shard(docs: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """docs with the column shard of shard_documents(), which replaces a column of that name."""
    docs = docs.drop("shard")
    order = docs.columns
    goes = assign(_groups(docs), shards, bucket).withColumnRenamed("unit", TMP + "unit")
    return docs.withColumn(TMP + "h", F.xxhash64("text")).join(goes, F.col(TMP + "h") == F.col(TMP + "unit")).select(*order, "shard")
