"""Passages that repeat across documents, by sparse suffix arrays.

Only suffixes at minimiser positions are kept: the least hashed run of SEED words in every window of
LEAST words, so any repeat of LEAST words has the same suffixes in each of its copies. Suffixes whose
first SEED words occur in several texts are sorted with their words, neighbours are compared, and the
match is extended to the right and to the left; each anchor answers for the windows of LEAST words
around it. Of each window the least document that holds it is kept; windows are joined to whole passages,
and within them to parts of one first document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import emit, materialise, slices, starts_of, text_buffers, whole_groups
from .mixing import n_tokens

#: Least words of a passage, words of a seed.
LEAST, SEED = 50, 16


def anchors(hashes: np.ndarray, offsets: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of the minimisers of all windows of `least` words inside a text, and their seeds' hashes."""
    seeds = T.ngrams(hashes, seed)
    width = least - seed + 1
    ok = T.inside(offsets, least)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bits = np.uint64(int(len(seeds)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    best = (T.mix(seeds) & ~low) | np.arange(len(seeds), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: -(width - span)], best[width - span :])
    place = np.unique((best[: len(ok)][ok] & low).astype(np.int64))
    return place, seeds[place]


def _find(least: int, seed: int):
    """Arrow function: (h, text) to (seed, h, place)."""
    schema = pa.schema([("seed", pa.int64()), ("h", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, offsets = T.words(*text_buffers(batch.column("text")))
                place, found = anchors(hashes, offsets, least, seed)
                text = np.searchsorted(offsets, place, side="right") - 1
                yield emit(schema, found.view(np.int64), batch.column("h").to_numpy()[text], place - offsets[text])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (seed, h, place), sorted: the anchors whose seed occurs in several texts, each once."""
    schema = pa.schema([("h", pa.int64()), ("place", pa.int64())])
    for table in whole_groups(batches, "seed"):
        seed, h, place = (table.column(c).to_numpy() for c in ("seed", "h", "place"))
        first = starts_of(seed)
        sizes = np.diff(np.r_[first, len(seed)])
        several = np.repeat(h[first] != h[first + sizes - 1], sizes)
        several[1:] &= (seed[1:] != seed[:-1]) | (h[1:] != h[:-1]) | (place[1:] != place[:-1])
        yield emit(schema, h[several], place[several])


def _contexts(least: int, seed: int):
    """Arrow function: (h, doc_id, text, places) to (seed, h, doc_id, place, ahead, behind); a word is 4 bytes, 0 outside the text."""
    back = least - seed
    kinds = [("seed", pa.int64()), ("h", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("ahead", pa.binary()), ("behind", pa.binary())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                hashes, offsets = T.words(*text_buffers(batch.column("text")))
                lists = batch.column("places")
                counts = lists.value_lengths().to_numpy()
                text = np.repeat(np.arange(batch.num_rows), counts)
                place = lists.flatten().to_numpy()
                short = ((hashes >> np.uint64(32)) | np.uint64(1)).astype(">u4")
                seeds = T.ngrams(hashes, seed)
                for at in range(0, len(place), 1 << 14):
                    own, p = text[at : at + (1 << 14)], place[at : at + (1 << 14)]
                    spot = p + offsets[own]
                    around = spot[:, None] + np.arange(-back, least)
                    out = (around < offsets[own][:, None]) | (around >= offsets[own + 1][:, None])
                    words = np.where(out, 0, short[np.clip(around, 0, len(short) - 1)]).astype(">u4")
                    ahead, behind = np.ascontiguousarray(words[:, back:]), np.ascontiguousarray(words[:, :back][:, ::-1])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(seeds[spot].view(np.int64)), pa.array(batch.column("h").to_numpy()[own]),
                            pa.array(batch.column("doc_id").to_numpy()[own]), pa.array(p),
                            _binary(ahead), _binary(behind),
                        ],
                        schema=schema,
                    )

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.ChunkedArray, words: int) -> np.ndarray:
    return np.concatenate([text_buffers(c.cast(pa.large_binary()))[0] for c in column.chunks]).view(">u4").reshape(-1, words).astype(np.uint32)


def _run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words agree from the first on."""
    same = (a == b) & (a != 0)
    return np.where(same.all(1), a.shape[1], np.argmin(same, axis=1))


def matches(seed, h, doc, place, ahead, behind, least: int):
    """(row, from, to, least doc_id) of what repeats around each suffix in another text; rows are sorted.

    Neighbours in the sorted array are compared first. That settles pairs. In larger groups a longer match to
    the left, or the least document, may be in a text that isn't a neighbour: there the suffixes that begin at
    every word up to the first that this anchor answers for are sorted in turn.
    """
    n, back = len(seed), behind.shape[1]
    begin = starts_of(seed)
    sizes = np.diff(np.r_[begin, n])
    near = begin[sizes == 2]
    near = near[h[near] != h[near + 1]]
    right, left = _run(ahead[near], ahead[near + 1]), _run(behind[near], behind[near + 1])
    far = right + left >= least
    near, right, left = near[far], right[far], left[far]
    first = np.minimum(doc[near], doc[near + 1])
    found = [(near + k, place[near + k] - left, place[near + k] + right, first) for k in (0, 1)]

    rows = np.flatnonzero(np.repeat(sizes > 2, sizes))
    if len(rows):
        words = np.concatenate([behind[rows][:, ::-1], ahead[rows]], axis=1).astype(np.uint64)
        group, own, ids = np.repeat(np.arange(len(begin)), sizes)[rows], h[rows], doc[rows]
        power = T.powers(least)
        value = (words[:, :least] * power).sum(1, dtype=np.uint64)
        for k in range(back + 1):
            inside = (words[:, k] != 0) & (words[:, k + least - 1] != 0)
            key = T.mix(value + T.mix(group.astype(np.uint64)))
            order = np.flatnonzero(inside)
            order = order[np.lexsort((own[order], key[order]))]
            if len(order):
                runs = starts_of(key[order])
                ends = np.r_[runs[1:], len(order)]
                several = np.repeat(own[order][runs] != own[order][ends - 1], ends - runs)
                lowest = np.repeat(np.minimum.reduceat(ids[order], runs), ends - runs)
                hit = order[several]
                start = place[rows[hit]] - back + k
                found.append((rows[hit], start, start + least, lowest[several]))
            if k < back:
                value = (value - words[:, k]) * np.uint64(T.INVERSE) + words[:, k + least] * power[-1]
    return tuple(np.concatenate(c) for c in zip(*found))


def _compare(least: int, seed: int):
    schema = pa.schema([("h", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "seed"):
            columns = [table.column(c).to_numpy() for c in ("seed", "h", "doc_id", "place")]
            ahead, behind = _matrix(table.column("ahead"), least), _matrix(table.column("behind"), least - seed)
            row, start, end, first = matches(*columns, ahead, behind, least)
            if len(row):
                h = columns[1][row]
                yield emit(schema, *settle(h, start, end, first, least))

    return run


def merge(h: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
    """Join overlapping or touching stretches of a text, sorted by text and start."""
    text = starts_of(h)
    # a running maximum that begins anew with every text: texts are moved apart by more than their length
    apart = np.repeat(np.arange(len(text)), np.diff(np.r_[text, len(h)])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + apart)
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (start[1:] + apart[1:] > reach[:-1])])
    return h[new], start[new], np.maximum.reduceat(end, new), np.minimum.reduceat(first, new)


def settle(h: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, least: int):
    """Each window of `least` words in the stretches with the least of its firsts, joined to stretches of one first; sorted."""
    many = end - start - least + 1
    at = np.repeat(start - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    h, first = np.repeat(h, many), np.repeat(first, many)
    order = np.lexsort((first, at, h))
    h, at, first = h[order], at[order], first[order]
    one = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1])])
    h, at, first = h[one], at[one], first[one]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1])])
    last = np.r_[new[1:], len(h)] - 1
    return h[new], at[new], at[last] + least, first[new]


def _merge_stream(least: int):
    """Arrow function over (h, from, to, first) sorted by h: passages with their parts."""
    part = pa.struct([("from_word", pa.int64()), ("to_word", pa.int64()), ("first_doc_id", pa.int64())])
    schema = pa.schema([("h", pa.int64()), ("from", pa.int64()), ("to", pa.int64()), ("first", pa.int64()), ("parts", pa.list_(part))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "h"):
            h, start, end, first = settle(*(table.column(c).to_numpy() for c in schema.names[:4]), least)
            passages = merge(h, start, end, first)
            # a passage's first part begins where it does
            begins = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (start[1:] > end[:-1])])
            parts = pa.StructArray.from_arrays([pa.array(c) for c in (start, end, first)], fields=list(part))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(h)], pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in passages), lists], schema=schema)

    return run


def repeats(docs: DataFrame, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """(doc_id, from_word, to_word, n_words, first_doc_id, is_first, parts) of passages of at least `least` words that other texts hold too.

    Words are split at ASCII white space and have to be equal byte for byte. Every window of `least` words
    that occurs in another document's text is in a passage, and no other word is. to_word is exclusive;
    first_doc_id is the least doc_id that holds a window of it, is_first whether that is this document. parts
    has (from_word, to_word, first_doc_id, is_first) of each run of windows that the same document holds first;
    parts overlap by up to `least` - 1 words. To cut copies, keep the words of parts with is_first and cut the
    passage's others: every window then stays in its first document. What repeats only within one document isn't
    reported. Documents with equal texts repeat each other from end to end. Rows repeated with the same
    doc_id and text count once; a doc_id with several texts counts as several documents. Rows whose doc_id
    or text is null are left out, and texts of fewer words have no passages.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null").withColumn("h", F.xxhash64("text"))
    found = docs.select("h", "text").mapInArrow(_find(least, seed), "seed long, h long, place long")
    found = found.repartition("seed").sortWithinPartitions("seed", "h", "place")
    shared = found.mapInArrow(_shared, "h long, place long").groupBy("h").agg(F.collect_set("place").alias("places"))

    members = materialise(docs.select("doc_id", "h", n_tokens(F.col("text")).alias("words")).distinct(), "members")
    one = members.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
    wanted = shared.join(one.select("h", "doc_id"), "h")
    around = docs.join(wanted, ["doc_id", "h"]).select("h", "doc_id", "text", "places").mapInArrow(
        _contexts(least, seed), "seed long, h long, doc_id long, place long, ahead binary, behind binary"
    )
    around = around.repartition("seed").sortWithinPartitions("seed", "ahead", "behind", "h", "place")
    kind = "h long, `from` long, `to` long, first long"
    parts = around.mapInArrow(_compare(least, seed), kind)
    # a copied text is repeated from end to end; windows that others share with it may have an earlier first document
    copied = one.where((F.col("n") > 1) & (F.col("words") >= least)).select(
        "h", F.lit(0).cast("long").alias("from"), F.col("words").cast("long").alias("to"), F.col("doc_id").alias("first")
    )
    stretches = parts.unionByName(copied).repartition("h").sortWithinPartitions("h", "from", "to")
    passages = stretches.mapInArrow(_merge_stream(least), f"{kind}, parts array<struct<from_word:long,to_word:long,first_doc_id:long>>")
    return members.join(passages, "h").select(
        "doc_id", F.col("from").alias("from_word"), F.col("to").alias("to_word"), (F.col("to") - F.col("from")).alias("n_words"),
        F.col("first").alias("first_doc_id"), (F.col("doc_id") == F.col("first")).alias("is_first"),
        F.transform("parts", lambda p: p.withField("is_first", p["first_doc_id"] == F.col("doc_id"))).alias("parts"),
    )
