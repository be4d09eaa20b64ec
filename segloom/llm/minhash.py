"""MinHash near-duplicate groups by tensored banding.

Instead of one set of minhashes for every table, two collections of a few short bands are made, and
every pair of a band from each is a table key: 2 * bands * rows minhashes serve bands ** 2 tables of
2 * rows minhashes each. Candidates are confirmed by the exact Jaccard similarity of word shingles, pair by
pair: first members of a table against two of its members, which joins most of each group, then all pairs
of a table whose members are not yet in one group. So no task holds a component of candidates, which with
boilerplate grows faster than the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import TMP, discard, emit, materialise, slices, starts_of, text_buffers, whole_groups
from .graph import components

#: Word shingle length, least Jaccard similarity, bands in either collection, minhashes in a band.
SHINGLE, THRESHOLD, BANDS, ROWS = 3, 0.5, 12, 2
#: Minhashes of which, besides those of the bands, four bits are kept as marks; pairs that are emitted at once.
MARKS, PAIRS = 144, 1 << 20


def agreement(threshold: float) -> int:
    """Of 64 one-bit sketch bits, those that have to agree inside a table: three standard deviations less than texts of that similarity have.

    Unlike texts agree in 32 of 64; texts of the threshold itself fall below in about one of a thousand pairs.
    """
    p = (1 + threshold) / 2
    return int(64 * p - 3 * (64 * p * (1 - p)) ** 0.5)


def differing(threshold: float, samples: int) -> int:
    """Of so many marks of four bits, those that may differ: three standard deviations more than in texts of that similarity."""
    p = (1 - threshold) * 15 / 16
    return int(samples * p + 3 * (samples * p * (1 - p)) ** 0.5) + 1


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance that two texts of this similarity share a table."""
    return (1 - (1 - similarity**rows) ** bands) ** 2


def shingles(data: np.ndarray, bounds: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams and where each text's begin; a text of 1 to n - 1 words is one shingle."""
    hashes, offsets = T.words(data, bounds)
    lengths = np.diff(offsets)
    grams, ok = T.ngrams(hashes, n), T.inside(offsets, n)
    counts = np.maximum(lengths - n + 1, 0)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    if not len(short):
        return grams[ok], np.r_[0, np.cumsum(counts)]
    counts[short] = 1
    at = np.r_[0, np.cumsum(counts)]
    out = np.empty(at[-1], np.uint64)
    mask = np.ones(at[-1], bool)
    mask[at[short]] = False
    out[mask] = grams[ok]
    out[~mask] = [T.mix(np.array([sum(int(h) * (k + 3) for k, h in enumerate(hashes[offsets[i] : offsets[i + 1]])) % 2**64], np.uint64))[0] for i in short]
    return out, at


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = T.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return x[:n] | np.uint64(1), x[n:]


def half_keys(bands: int, rows: int):
    """Arrow function: (node, text) to (node, sketch, a, b, marks), a and b being the two collections of band hashes."""
    schema = pa.schema([("node", pa.int64()), ("sketch", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("marks", pa.binary())])
    times, plus = _factors(2 * bands * rows)
    more_times, more_plus = ((x >> np.uint64(32)).astype(np.uint32) for x in _factors(1024 + MARKS))
    more_times, more_plus = more_times[-MARKS:] | np.uint32(1), more_plus[-MARKS:]
    salts = T.mix(np.arange(1, 2 * bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                grams, at = shingles(*text_buffers(batch.column("text")))
                some = np.flatnonzero(np.diff(at) > 0)
                if not len(some):
                    continue
                least = np.empty((len(some), len(times)), np.uint64)
                begin = at[some]
                for k in range(len(times)):
                    least[:, k] = np.minimum.reduceat(grams * times[k] + plus[k], begin)
                mixed = T.mix(least)
                short = (grams >> np.uint64(32)).astype(np.uint32)
                more = np.empty((len(some), MARKS), np.uint32)
                for k in range(MARKS):
                    more[:, k] = np.minimum.reduceat(short * more_times[k] + more_plus[k], begin)
                marks = _packed(np.concatenate([mixed, T.mix(more.astype(np.uint64))], axis=1))
                bits = np.zeros(len(some), np.uint64)
                for k in range(64):
                    bits |= ((mixed[:, k % mixed.shape[1]] >> np.uint64(7 + k // mixed.shape[1])) & np.uint64(1)) << np.uint64(k)
                folded = mixed.reshape(len(some), 2 * bands, rows)
                keys = np.zeros((len(some), 2 * bands), np.uint64)
                for r in range(rows):
                    keys = T.mix(keys + folded[:, :, r] + salts)
                keys = keys.view(np.int64)
                ends = pa.array(np.arange(len(some) + 1) * bands, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(batch.column("node").to_numpy()[some]),
                        pa.array(bits.view(np.int64)),
                        pa.ListArray.from_arrays(ends, pa.array(keys[:, :bands].ravel())),
                        pa.ListArray.from_arrays(ends, pa.array(keys[:, bands:].ravel())),
                        pa.array([row.tobytes() for row in marks], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def _packed(hashes: np.ndarray) -> np.ndarray:
    """Four bits of each hash, sixteen in a word; what is over in the last word is the same in all rows."""
    n, many = hashes.shape
    out = np.zeros((n, -(-many // 16)), np.uint64)
    for k in range(many):
        out[:, k // 16] |= (hashes[:, k] >> np.uint64(20) & np.uint64(15)) << np.uint64(4 * (k % 16))
    return out


def _marks(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The words of a column of marks, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return text_buffers(column)[0].copy().view(np.uint64).reshape(len(column), -1)


def _unlike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many marks differ, for each row."""
    total = np.zeros(len(x), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k] ^ y[:, k]
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        total += np.bitwise_count(d & np.uint64(0x1111111111111111))
    return total


def _shared(agree: int):
    """Arrow function over (key, node, sketch) sorted by key and node: members of tables of two or more, each with the first and the last of its table, or itself where their sketches don't agree.

    Nodes are hashes, so these are members by chance, and mostly the same ones in all tables of a group: few pairs are to be verified.
    """
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("one", pa.int64()), ("two", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            key, node, sketch = (table.column(c).to_numpy() for c in ("key", "node", "sketch"))
            first = starts_of(key)
            sizes = np.diff(np.r_[first, len(key)])
            many = np.repeat(sizes > 1, sizes)
            if not many.any():
                continue
            asked = []
            for which in (first, first + sizes - 1):
                other = np.repeat(which, sizes)
                like = np.bitwise_count(~(sketch ^ sketch[other]).view(np.uint64)) >= agree
                asked.append(np.where(like, node[other], node)[many])
            yield emit(schema, key[many], node[many], *asked)

    return run


def _in_tables(agree: int, most: int | None = None):
    """Arrow function over (key, node, sketch) sorted by key: all pairs of a table whose sketches agree.

    most: with it rows also have a label and marks and are sorted by key and label; only pairs of different
    labels are given, and only if at most so many of their marks differ.
    """
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            key, node, sketch = (table.column(c).to_numpy() for c in ("key", "node", "sketch"))
            label = node if most is None else table.column("label").to_numpy()
            marks = None if most is None else _marks(table.column("marks"))
            first = starts_of(key)
            end = np.repeat(np.r_[first[1:], len(key)], np.diff(np.r_[first, len(key)]))
            same = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (label[1:] != label[:-1])])
            # each row is held against those after the rows of its label, the nearest first
            other = np.repeat(np.r_[same[1:], len(key)], np.diff(np.r_[same, len(key)]))
            own = np.flatnonzero(other < end)
            other, end = other[own], end[own]
            src, dst, n = [], [], 0
            while len(own):
                near = np.bitwise_count(~(sketch[own] ^ sketch[other]).view(np.uint64)) >= agree
                u, v = own[near], other[near]
                if most is not None and len(u):
                    near = _unlike(marks[u], marks[v]) <= most
                    u, v = u[near], v[near]
                src.append(node[u])
                dst.append(node[v])
                n += len(u)
                if n > PAIRS:
                    yield emit(schema, np.concatenate(src), np.concatenate(dst))
                    src, dst, n = [], [], 0
                other = other + 1
                left = other < end
                if not left.all():
                    own, other, end = own[left], other[left], end[left]
            if n:
                yield emit(schema, np.concatenate(src), np.concatenate(dst))

    return run


def _with_like_marks(most: int):
    """Arrow function: the pairs of which at most so many marks differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _unlike(_marks(batch.column("u_marks")), _marks(batch.column("v_marks"))) <= most
            yield batch.select(["u", "v"]).filter(pa.array(near))

    return run


def _verified(threshold: float):
    """Arrow function over (u, v, u_text, v_text): the pairs whose Jaccard similarity is at least the threshold."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "u_text"):
                near = np.zeros(batch.num_rows, bool)
                (one, at), (two, to) = (shingles(*text_buffers(batch.column(c))) for c in ("u_text", "v_text"))
                for k in range(batch.num_rows):
                    x, y = np.unique(one[at[k] : at[k + 1]]), np.unique(two[to[k] : to[k + 1]])
                    both = np.sort(np.concatenate([x, y]))
                    shared = int((both[1:] == both[:-1]).sum())
                    near[k] = shared >= threshold * (len(both) - shared)
                yield emit(schema, batch.column("u").to_numpy()[near], batch.column("v").to_numpy()[near])

    return run


def _pairs(edges: DataFrame) -> DataFrame:
    """(u, v) of edges(src, dst), each once, u being the lesser."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def _links(pairs: DataFrame, docs: DataFrame, chosen: DataFrame, threshold: float) -> DataFrame:
    """The pairs that are similar, written; pairs: a written table of (u, v); chosen: of each node one doc_id that has its text."""
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    # a row that is repeated gives its text once
    texts = docs.join(nodes.join(chosen, "node"), ["doc_id", "node"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = materialise(texts, "texts")
    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("v_text")), "v")
    both = both.join(texts.select(F.col("node").alias("u"), F.col("text").alias("u_text")), "u")
    links = materialise(both.select("u", "v", "u_text", "v_text").mapInArrow(_verified(threshold), "src long, dst long"), "links")
    discard(texts, pairs)
    return links


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, agree: int | None = None) -> DataFrame:
    """Groups of near duplicates: (doc_id, text_hash, group_id, n_docs, keep).

    docs: needs doc_id and text; other columns, whatever their names, aren't read. A document is the pair
    of its doc_id and the hash of its text, so repeated rows count once. Texts are similar if the Jaccard
    similarity of their 3-word shingles (split at ASCII white space; a shorter text is one shingle) is at
    least `threshold`; groups are closed under that, and equal texts always share one. group_id is the
    least doc_id of the group, n_docs its documents; keep marks one document, that of least
    (doc_id, text_hash). Only groups of two or more are returned. Candidates are the texts that share one of
    bands ** 2 tables, agree in `agree` of 64 sketch bits (by default agreement(threshold)) and differ in at most
    differing() marks: at the threshold of 0.5 itself 0.94 of all pairs, at 0.6 0.99 (recall()); a pair that is
    missed is still grouped if others link it. Texts are told apart by 64-bit hashes. doc_id has to be a whole number. Rows whose doc_id or text is null, and
    texts without a word, belong to no group. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    docs = docs.withColumn("node", F.xxhash64("text"))
    agree = agreement(threshold) if agree is None else agree
    most = differing(threshold, 2 * bands * rows + MARKS)
    halves = docs.select("node", "text").mapInArrow(half_keys(bands, rows), "node long, sketch long, a array<long>, b array<long>, marks binary")
    halves = materialise(halves.dropDuplicates(["node"]), "halves")
    keyed = halves.select("node", "sketch", F.explode("a").alias("a"), "b").select("node", "sketch", "a", F.explode("b").alias("b"))
    keyed = keyed.select(F.xxhash64("a", "b").alias("key"), "node", "sketch")
    tables = keyed.repartition("key").sortWithinPartitions("key", "node")
    tables = materialise(tables.mapInArrow(_shared(agree), "key long, node long, one long, two long"), "tables")

    members = docs.where(F.col("text").rlike("[^ \\t\\n\\x0b\\f\\r]")).select("doc_id", "node").distinct()
    members = materialise(members, "members")
    chosen = members.groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    asked = _pairs(tables.select(F.col("node").alias("src"), F.explode(F.array("one", "two")).alias("dst")))
    for end in ("u", "v"):
        asked = asked.join(halves.select(F.col("node").alias(end), F.col("marks").alias(end + "_marks")), end)
    asked = asked.select("u", "v", "u_marks", "v_marks").mapInArrow(_with_like_marks(most), "u long, v long")
    first = _links(materialise(asked, "pairs"), docs, chosen, threshold)

    labels = components(first, "labels").withColumnRenamed("component", "label")
    known = halves.select("node", "sketch", "marks").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = tables.select("key", "node").join(known, "node").repartition("key").sortWithinPartitions("key", "label")
    rest = _pairs(rest.mapInArrow(_in_tables(agree, most), "src long, dst long"))
    rest = _links(materialise(rest, "pairs"), docs, chosen, threshold)
    discard(halves, tables)
    groups = components(first.unionByName(rest), "groups")

    grouped = members.join(groups, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    sums = grouped.groupBy("component").agg(
        F.min(F.struct("doc_id", "node")).alias("least"), F.count(F.lit(1)).alias("n_docs")
    ).where("n_docs > 1")
    return grouped.join(sums, "component").select(
        "doc_id", F.col("node").alias("text_hash"), F.col("least.doc_id").alias("group_id"), "n_docs",
        (F.struct("doc_id", "node") == F.col("least")).alias("keep"),
    )


def drop_near(docs: DataFrame, **options) -> DataFrame:
    """docs without all but one document of each near-duplicate group.

    All columns stay. Of rows repeated with the same doc_id and text one stays, too. Rows whose doc_id or
    text is null, and texts without a word, stay. An empty table stays empty.
    """
    key, order = F.xxhash64("text"), docs.columns
    known = docs.where("doc_id is not null").select("doc_id", key.alias(TMP + "h"))
    repeated = known.groupBy("doc_id", TMP + "h").count().where("count > 1").select(
        "doc_id", TMP + "h", F.lit(False).alias(TMP + "drop")
    )
    dropped = near_groups(docs, **options).where("not keep").select("doc_id", F.col("text_hash").alias(TMP + "h"), F.lit(True).alias(TMP + "drop"))
    marks = dropped.unionByName(repeated).groupBy("doc_id", TMP + "h").agg(F.max(TMP + "drop").alias(TMP + "drop"))
    marks = marks.select(F.col("doc_id").alias(TMP + "id"), TMP + "h", TMP + "drop")
    marked = docs.withColumn(TMP + "k", key).join(
        marks, (F.col("doc_id") == F.col(TMP + "id")) & (F.col(TMP + "k") == F.col(TMP + "h")), "left"
    )
    marked = marked.where(F.coalesce(F.col(TMP + "drop"), F.lit(False)) == F.lit(False))
    # the join has brought equal keys together, so numbering them needs no further shuffle
    nth = F.row_number().over(Window.partitionBy("doc_id", TMP + "k").orderBy("doc_id"))
    return marked.withColumn(TMP + "n", nth).where(F.col(TMP + "drop").isNull() | (F.col(TMP + "n") == 1)).select(*order)
