"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a run of LEAST words are tiled: the longest run that is unmarked in
both is marked, again and again, until none of LEAST words is left. The share of an item's words under
tiles doesn't depend on the order of its parts, so reordered passages are caught.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import TMP, emit, slices, text_buffers
from .quality import WORD_CODES

#: Shortest tile in words; least share of an item's words under tiles; most bytes of items that go to every task.
LEAST, COVERAGE, SMALL = 4, 0.6, 32 << 20


def tiles(doc: np.ndarray, item: np.ndarray, at_doc: np.ndarray, at_item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(doc position, item position, length) of the tiles, given all places where `least` words agree.

    Longest first; of equal length the one earliest in the item, then in the document.
    """
    # runs of agreeing words along a diagonal
    order = np.lexsort((at_item, at_doc - at_item))
    a, b = at_doc[order], at_item[order]
    new = np.flatnonzero(np.r_[True, (np.diff(a - b) != 0) | (np.diff(b) != 1)])
    ends = np.r_[new[1:], len(a)] - 1
    heap = [(-(int(b[e] - b[s]) + least), int(b[s]), int(a[s])) for s, e in zip(new, ends)]
    heapq.heapify(heap)
    in_doc, in_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    found = []
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        free = ~(in_item[i : i + n] | in_doc[d : d + n])
        if free.all():
            in_item[i : i + n] = in_doc[d : d + n] = True
            found.append((d, i, n))
            continue
        edge = np.flatnonzero(np.diff(np.r_[False, free, False]))
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s >= least:
                heapq.heappush(heap, (-int(e - s), i + int(s), d + int(s)))
    return found


class Items:
    """Test items as word hashes, and their runs of `least` words in order of their hash."""

    def __init__(self, ids: list, texts: list[str], least: int):
        self.ids, self.least = ids, least
        data, bounds = text_buffers(pa.array(texts, pa.large_string()))
        hashes, self.offsets = T.words(data, bounds, WORD_CODES)
        self.words = hashes
        ok = T.inside(self.offsets, least)
        runs, places = T.ngrams(hashes, least)[ok], np.flatnonzero(ok)
        order = np.argsort(runs, kind="stable")
        self.runs, self.places = runs[order], places[order]
        self.owners = np.searchsorted(self.offsets, self.places, side="right") - 1
        # first bits of the runs, some for each run
        self.shift = np.uint64(64 - min(22, max(8, len(runs).bit_length() + 6)))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[(self.runs >> self.shift).astype(np.int64)] = True

    def match(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, words under tiles, words of the item) for each pair that shares a run."""
        hashes, offsets = T.words(*text_buffers(texts), WORD_CODES)
        runs = T.ngrams(hashes, self.least)
        maybe = np.flatnonzero(self.seen[(runs >> self.shift).astype(np.int64)])
        low = np.searchsorted(self.runs, runs[maybe], side="left")
        count = np.searchsorted(self.runs, runs[maybe], side="right") - low
        maybe, low, count = maybe[count > 0], low[count > 0], count[count > 0]
        text = np.searchsorted(offsets, maybe, side="right") - 1
        fits = maybe + self.least <= offsets[text + 1]
        maybe, low, count, text = maybe[fits], low[fits], count[fits], text[fits]
        if not len(maybe):
            return
        which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place, text, owner = np.repeat(maybe, count), np.repeat(text, count), self.owners[which]
        order = np.lexsort((owner, text))
        place, text, owner, which = place[order], text[order], owner[order], which[order]
        cut = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (np.diff(owner) != 0)])
        for s, e in zip(cut, np.r_[cut[1:], len(text)]):
            t, o = int(text[s]), int(owner[s])
            doc, item = hashes[offsets[t] : offsets[t + 1]], self.words[self.offsets[o] : self.offsets[o + 1]]
            found = tiles(doc, item, place[s:e] - offsets[t], self.places[which[s:e]] - self.offsets[o], self.least)
            yield t, o, sum(n for _, _, n in found), len(item)


def _clean_items(items: DataFrame) -> DataFrame:
    return items.select("item_id", "text").where("item_id is not null and text is not null").distinct()


def _small(items: DataFrame, small: int) -> list | None:
    """The items if they take at most `small` bytes."""
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    return sorted(map(tuple, items.collect())) if size <= small else None


def _pairs(known: list, least: int, coverage: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("covered_words", pa.int64()), ("item_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items([i for i, _ in known], [t for _, t in known], least)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = batch.column("doc_id")
                hits = [(ids[t].as_py(), items.ids[o], n, m) for t, o, n, m in items.match(batch.column("text")) if n >= coverage * m]
                if hits:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, h)) for h in hits], schema)

    return run


def _runs(name: str, least: int):
    """Arrow function: (id, text) to its distinct runs of words."""
    schema = pa.schema([(name, pa.int64()), ("run", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, offsets = T.words(*text_buffers(batch.column("text")), WORD_CODES)
                ok = T.inside(offsets, least)
                yield emit(schema, batch.column(name).to_numpy()[T.texts_of(offsets)[: len(ok)][ok]], T.ngrams(hashes, least)[ok].view(np.int64))

    return run


def _tile_joined(least: int, coverage: float):
    """Arrow function over (h, text, items): pairs of enough coverage."""
    schema = pa.schema([("h", pa.int64()), ("item_id", pa.int64()), ("covered_words", pa.int64()), ("item_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                h, known = batch.column("h")[r].as_py(), batch.column("items")[r].as_py()
                items = Items([i["item_id"] for i in known], [i["item"] for i in known], least)
                hits = [(h, items.ids[o], n, m) for _, o, n, m in items.match(batch.column("text").slice(r, 1)) if n >= coverage * m]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in hits], schema)

    return run


def _shuffled(docs: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """(h, item_id, ...) for items of any size: shared runs are found by a join; h is the hash of the text."""
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text").dropDuplicates(["h"])
    seeds = items.mapInArrow(_runs("item_id", least), "item_id long, run long").distinct()
    own = texts.mapInArrow(_runs("h", least), "h long, run long").distinct()
    pairs = own.join(seeds, "run").select("h", "item_id").distinct()
    found = pairs.join(items.withColumnRenamed("text", "item"), "item_id").groupBy("h").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    joined = texts.join(found, "h").select("h", "text", "items")
    return joined.mapInArrow(_tile_joined(least, coverage), "h long, item_id long, covered_words long, item_words long")


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE, small: int = SMALL) -> DataFrame:
    """(doc_id, item_id, covered_words, item_words, coverage) of each pair whose tiles cover enough of the item.

    Words are split at ASCII white space, ASCII case and punctuation don't count. Items of fewer than
    `least` words can't be told from chance and are not looked for, nor those whose item_id or text is
    null; an item_id with several texts stands for each. Documents with a null text hold nothing; a
    null doc_id is reported as null. Repeated rows are reported once. Items of up to `small` bytes go to
    every task; more are found by a join on shared runs, with the same result. A text that is empty or of marks
    only holds nothing. doc_id and item_id have to be whole numbers.
    """
    docs, items = docs.select("doc_id", "text"), _clean_items(items)
    known = _small(items, small)
    if known is not None:
        found = docs.mapInArrow(_pairs(known, least, coverage), "doc_id long, item_id long, covered_words long, item_words long")
    else:
        hits = _shuffled(docs, items, least, coverage)
        found = docs.select("doc_id", F.xxhash64("text").alias("h")).join(hits, "h").drop("h")
    return found.distinct().withColumn("coverage", F.col("covered_words") / F.col("item_words"))


def _leaks(known: list, least: int, coverage: float, text: Column) -> Column:
    kept: list[Items] = []

    def run(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Items([i for i, _ in known], [t for _, t in known], least))
        parts = [np.zeros(0, bool)]
        for batch in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            hit = np.zeros(batch.num_rows, bool)
            for t, _, n, m in kept[0].match(batch.column("text")):
                hit[t] |= n >= coverage * m
            parts.append(hit)
        return pa.array(np.concatenate(parts))

    return F.arrow_udf(run, "boolean")(text)


def drop_contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE, small: int = SMALL) -> DataFrame:
    """docs without those that contaminated() reports, all columns as they are; a null text stays."""
    items, order = _clean_items(items), docs.columns
    known = _small(items, small)
    if known is not None:
        return docs.withColumn(TMP + "hit", _leaks(known, least, coverage, F.col("text"))).where(f"not {TMP}hit").select(*order)
    hits = _shuffled(docs, items, least, coverage).select(F.col("h").alias(TMP + "h")).distinct()
    return docs.withColumn(TMP + "k", F.xxhash64("text")).join(hits, F.col(TMP + "k") == F.col(TMP + "h"), "left_anti").select(*order)
