"""Language-model scoring by online logistic context mixing.

Bytes are read as the decisions of a Huffman code of the corpus, bit by bit. Each of several contexts (the
last one, two and three bytes, and the word so far) is hashed with the place in the code to a cell, whose
counts over the corpus predict the bit. A mixer adds the predictions in the logistic domain, with weights
that a gate (the kind of the last byte) selects, and a last stage refines its output by what
came of like outputs before. The counts are frozen while a text is read; weights and refinement start alike
in every text and are learned online, a block of bytes at a time.

What is rarer than such contexts is told by long ones. At content-selected places the last AHEAD bytes are
a context of the stretch up to the next such place, and a decision says whether the stretch is one that
another row has there. Its predictors (how many rows have the context, how such decisions went in this text)
are mixed in the same way; a stretch that is known costs what picks it among those that others have, and its
bytes cost nothing more. The long contexts are counted exactly, over all rows, in written tables that are
sorted by context, so they grow with the corpus; a row's own occurrences are taken out before it is scored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import text as T
from .common import discard, emit, materialise, slices, starts_of, text_buffers, whole_groups

#: log2 of a context's cells at least and at most, contexts, folds, bytes after which weights are refined.
BITS, MOST, CONTEXTS, FOLDS, BLOCK = 21, 24, 4, 2, 64
#: Bytes of a text that are read by such blocks, and the longer blocks of the rest; multiples of BLOCK.
EARLY, LATER = 1024, 256
#: log2 of the words' hashes that counts are gathered by, cells of a table for each that holds counts, and counts a task holds of a kind.
WIDE, SPARE, HELD = 26, 4, 1 << 21
#: log2 of the parts that the counts of a kind are divided into: of all 2**WIDE words and 2**24 times three bytes, one has at most a 64th.
PARTS = 6
#: Bytes of a word that its context holds; step of the mixer; weight of an output class's first guess.
PREFIX, STEP, PRIOR = 64, 0.4, 24.0
GATES, CLASSES = 8, 33
#: Bytes of a long context, one place in how many has one, and bytes of a stretch at most.
AHEAD, EVERY, STRETCH = 24, 64, 256
#: Bytes that are worked on at once: arrays of their decisions should stay in a cache.
CHUNK = 1 << 17
#: Predictions are held in sixteenths, and so are the weights' first values.
UNIT = np.float32(1 / 16)
START = np.array([0.15, 0.25, 0.45, 0.4, 0.0], np.float32)
_ASCII = np.arange(256)
#: Gate by the last byte: white space, vowel, consonant, capital, digit, punctuation, first and later byte of a longer character.
_KINDS = np.array(
    [0 if c <= 32 else 6 if c >= 192 else 7 if c >= 128 else 4 if chr(c).isdigit() else 1 if chr(c) in "aeiou" else 2 if chr(c).islower() else 3 if chr(c).isupper() else 5 for c in _ASCII]
)
_LETTER = np.array([chr(c).isalnum() or c >= 128 for c in _ASCII])
_SALTS = (0x1B873593, 0x52DCE729, 0x38495AB5, 0x6C078965)


class Code:
    """A Huffman code: for each byte its decisions, as (place in the tree, bit)."""

    def __init__(self, counts: np.ndarray):
        heap = [(int(c) + 1, k, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        made = 256
        while len(heap) > 1:
            a, _, x = heapq.heappop(heap)
            b, _, y = heapq.heappop(heap)
            parent[x], parent[y] = (made, 0), (made, 1)
            heapq.heappush(heap, (a + b, made, made))
            made += 1
        paths = []
        for k in range(256):
            path, at = [], k
            while at in parent:
                at, bit = parent[at]
                path.append((made - at, bit))
            paths.append(path[::-1])
        self.lengths = np.array([len(p) for p in paths])
        self.begins = np.r_[0, np.cumsum(self.lengths)[:-1]]
        self.nodes = np.array([n for p in paths for n, _ in p])
        #: The heavier a node, the lower its number: as cells follow their context's hash, those of a context's usual decisions are in one or two cache lines.
        self.places = self.nodes.astype(np.int64)
        self.bits = np.array([b for p in paths for _, b in p], np.uint8)
        self.ones = self.bits.astype(np.float32)


def _hash32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32 bits."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def _sums_of(data: np.ndarray) -> np.ndarray:
    """Of each place the hash of all bytes before it, from which that of any stretch is taken."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(T.BYTE_CODES[data] * T.powers(len(data)), out=total[1:])
    return total


def contexts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte the last three bytes, the last one lowest, and the hash of the word so far; neither reaches over the text's begin."""
    n = len(data)
    inner = bounds[:-1][np.diff(bounds) > 0]
    three = np.zeros(n, np.uint32)
    for k in (1, 2, 3):
        three[k:] |= data[:-k].astype(np.uint32) << np.uint32(8 * (k - 1))
    for k in (0, 1, 2):
        # the first three bytes of a text have only those before them
        near = inner[inner + k < n] + k
        three[near] &= np.uint32((1 << 8 * k) - 1)
    total = _sums_of(data)
    word = np.zeros(n, np.int64)
    other = np.flatnonzero(~_LETTER[data[:-1]]) + 1
    word[other] = other
    word[inner] = inner
    np.maximum.accumulate(word, out=word)
    np.maximum(word, np.arange(-PREFIX, n - PREFIX), out=word)
    prefix = T.mix((total[:-1] - total[word]) * T.powers(n, T.INVERSE)[word])
    return three, ((prefix >> np.uint64(32)).astype(np.uint32) ^ (three & np.uint32(255)) * np.uint32(0x01000193)) >> np.uint32(32 - WIDE)


def hashed(three: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """The CONTEXTS hashes of 32 bits: one, two and three bytes, and the word."""
    known = (three & np.uint32(0xFF), three & np.uint32(0xFFFF), three, word)
    return [_hash32(c + np.uint32(s)).astype(np.int64) for c, s in zip(known, _SALTS)]


def cells(context: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """The cell of a context's hash and a place in the code; those of a smaller table are the last bits of a larger one's."""
    return (context + place) & ((1 << bits) - 1)


def decisions(data: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """How many decisions each byte has, and for each decision the index into the code's paths."""
    lengths = code.lengths[data]
    ends = np.cumsum(lengths)
    return lengths, np.arange(ends[-1] if len(ends) else 0) + np.repeat(code.begins[data] - (ends - lengths), lengths)


def _long(data: np.ndarray, bounds: np.ndarray, most: int = 8 * CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Pieces of (bytes, bounds, bytes that only serve as context); a text over `most` is cut."""
    if len(data) <= most:
        yield data, bounds, 0
        return
    # slices() leaves a text over the limit alone in its batch
    for at in range(0, len(data), most):
        low = max(0, at - PREFIX - 3)
        yield data[low : at + most], np.array([0, min(at + most, len(data)) - low]), at - low


def _by_fold(whole: pa.RecordBatch, most: int) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Runs of rows of one fold by their length, as texts of like length are read together; only a part of the batch is copied at a time."""
    for part in slices(whole, "text", 1 << 23):
        fold, lengths = part.column("fold").to_numpy(), np.diff(text_buffers(part.column("text"))[1])
        order = np.lexsort((lengths, fold))
        cuts = np.searchsorted(fold[order], np.arange(FOLDS + 1))
        for k in range(FOLDS):
            if cuts[k] < cuts[k + 1]:
                yield k, slices(part.take(pa.array(order[cuts[k] : cuts[k + 1]])), "text", most)


# Counts of the short contexts

_COUNTS = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())])
_COUNTS_DDL = "part long, n long, counts binary"


def _added(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each key once, sorted, with the sums of its counts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = starts_of(keys)
    return keys[first], *(np.add.reduceat(c[order], first) for c in counts)


def _squeeze(sorted_: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted numbers and counts that belong to them as bytes; most differences and counts are small."""
    columns = np.stack([np.diff(sorted_.astype(np.uint64), prepend=np.uint64(0)), *(c.astype(np.uint64) for c in counts)])
    return pa.Codec("zstd", 1).compress(columns.view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes(), asbytes=True)


def _spread(squeezed: bytes, n: int, columns: int) -> np.ndarray:
    """What _squeeze() was given, a row each."""
    raw = np.frombuffer(pa.Codec("zstd").decompress(squeezed, n * columns * 8), np.uint8)
    found = np.ascontiguousarray(raw.reshape(columns, 8, n).transpose(0, 2, 1)).view(np.uint64).reshape(columns, n).copy()
    np.cumsum(found[0], out=found[0])
    return found


def _parted(kind: int, part: np.ndarray, bits: int, keys: np.ndarray, *counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys and their counts in rows, one for each part that has some."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = starts_of(part)
    for at, to in zip(first, np.r_[first[1:], len(part)]):
        own = order[at:to]
        yield emit(_COUNTS, [kind << bits | int(part[at])], [to - at], [_squeeze(keys[own], *(c[own] for c in counts))])


def _of_part(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Over (part, n, counts) sorted by part: each part, and its keys with their sums."""
    for table in whole_groups(batches, "part"):
        part, n, squeezed = table.column("part").to_numpy(), table.column("n").to_numpy(), table.column("counts")
        first = starts_of(part)
        for at, to in zip(first, np.r_[first[1:], len(part)]):
            yield int(part[at]), _added(*np.concatenate([_spread(squeezed[i].as_py(), int(n[i]), columns) for i in range(at, to)], axis=1))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, text) to how often each byte follows three bytes, and the word so far.

    A kind is a fold, and bytes or words; its contexts are divided into parts by their hash. What a task holds is
    bounded: a pair of context and byte may come more than once.
    """
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(2 * FOLDS)]
    many = [0] * len(held)

    def rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = _hash32((keys >> np.uint64(8)).astype(np.uint32)) >> np.uint32(32 - PARTS)
        yield from _parted(kind, part.astype(np.int64), PARTS, keys, counts)

    for whole in batches:
        for fold, runs in _by_fold(whole, 4 * CHUNK):
            for batch in runs:
                for data, bounds, skip in _long(*text_buffers(batch.column("text"))):
                    if len(data) <= skip:
                        continue
                    three, word = contexts(data, bounds)
                    byte = data[skip:]
                    for which, keys in enumerate((three[skip:] << np.uint32(8) | byte, word[skip:].astype(np.uint64) << np.uint64(8) | byte)):
                        keys.sort()
                        first = starts_of(keys)
                        kind = fold * 2 + which
                        held[kind].append((keys[first].astype(np.uint64), np.diff(np.r_[first, len(keys)]).astype(np.uint64)))
                        many[kind] += len(first)
                        if many[kind] > HELD:
                            held[kind] = [_added(*map(np.concatenate, zip(*held[kind])))]
                            many[kind] = len(held[kind][0][0])
                            if many[kind] > HELD // 2:
                                yield from rows(kind, *held[kind].pop())
                                many[kind] = 0
    for kind, parts in enumerate(held):
        if parts:
            yield from rows(kind, *_added(*map(np.concatenate, zip(*parts))))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, (keys, counts) in _of_part(batches, 2):
        yield emit(_COUNTS, [part], [len(keys)], [_squeeze(keys, counts)])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte occurs, from what follows three bytes."""
    schema = pa.schema([("byte", pa.int32()), ("n", pa.int64())])
    total = np.zeros(256, np.int64)
    for part, (keys, counts) in _of_part(batches, 2):
        if not part >> PARTS & 1:
            total += np.bincount((keys & np.uint64(255)).astype(np.int64), counts, 256).astype(np.int64)
    yield emit(schema, np.flatnonzero(total), total[total > 0])


def _by_cell(code: Code):
    """Arrow function: how often bytes follow contexts to the zeros and ones of cells, in parts of a kind (fold and context) by their cells' last bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (keys, counts) in _of_part(batches, 2):
            fold, words = divmod(part >> PARTS, 2)
            byte, known = (keys & np.uint64(255)).astype(np.uint8), (keys >> np.uint64(8)).astype(np.uint32)
            lengths, path = decisions(byte, code)
            many, ones = np.repeat(counts, lengths), code.bits[path].astype(np.uint64)
            for k in (CONTEXTS - 1,) if words else range(CONTEXTS - 1):
                cell = cells(np.repeat(hashed(known, known)[k], lengths), code.places[path], 32)
                found = _added(cell, many * (1 - ones), many * ones)
                yield from _parted(fold * CONTEXTS + k, found[0] & ((1 << PARTS) - 1), PARTS, *found)

    return run


def _cells_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, (keys, zeros, ones) in _of_part(batches, 3):
        yield emit(_COUNTS, [part], [len(keys)], [_squeeze(keys, zeros, ones)])


def _pack(sizes: list[int]):
    """Arrow function: the counts of each part to its predictions, a byte for each cell; sizes: log2 of each kind's cells."""
    schema = pa.schema([("part", pa.int64()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n, squeezed in zip(*(batch.column(c) for c in ("part", "n", "counts"))):
                own = sizes[part.as_py() >> PARTS]
                cell, zeros, ones = _spread(squeezed.as_py(), n.as_py(), 3)
                cell = ((cell & np.uint64((1 << own) - 1)) >> np.uint64(PARTS)).astype(np.int64)
                z, o = (np.bincount(cell, c, 1 << own - PARTS) for c in (zeros, ones))
                q = np.clip(np.rint(np.log((o + 0.4) / (z + 0.4)) * 16), -127, 127).astype(np.int8)
                yield emit(schema, [part.as_py()], [q.tobytes()])

    return run


def fit(docs: DataFrame, bits: int = BITS) -> tuple[Code, list[list[np.ndarray]]]:
    """The code, and for each fold and short context the logit of every cell in sixteenths, from all documents of that fold.

    docs: fold and text. A context's tables have at least 2**bits cells, SPARE for each that the counts of a fold
    fill, and at most 2**MOST, where cells are shared by more and more contexts; so driver and tasks hold at most
    FOLDS * CONTEXTS * 2**MOST bytes (128 MB). What is counted is gathered in parts, and never all in one place.
    """
    counted = docs.select("fold", "text").mapInArrow(_counter, _COUNTS_DDL)
    follows = materialise(counted.repartition("part").sortWithinPartitions("part").mapInArrow(_merged, _COUNTS_DDL), "follows")
    counts = np.zeros(256, np.int64)
    for r in follows.mapInArrow(_histogram, "byte int, n long").groupBy("byte").agg(F.sum("n")).collect():
        counts[r[0]] = r[1]
    code = Code(counts)
    sums = follows.mapInArrow(_by_cell(code), _COUNTS_DDL).repartition("part").sortWithinPartitions("part").mapInArrow(_cells_merged, _COUNTS_DDL)
    sums = materialise(sums, "counts")
    discard(follows)
    sizes = [bits] * (FOLDS * CONTEXTS)
    for k, n in sums.groupBy(F.shiftright("part", PARTS)).agg(F.sum("n")).collect():
        for same in range(k % CONTEXTS, len(sizes), CONTEXTS):
            sizes[same] = max(bits, min(MOST, max(sizes[same], (SPARE * n - 1).bit_length())))
    tables = [np.zeros(1 << b, np.int8) for b in sizes]
    for r in sums.mapInArrow(_pack(sizes), "part long, cells binary").toLocalIterator():
        tables[r[0] >> PARTS].reshape(-1, 1 << PARTS)[:, r[0] & ((1 << PARTS) - 1)] = np.frombuffer(r[1], np.int8)
    discard(sums)
    return code, [tables[fold * CONTEXTS : (fold + 1) * CONTEXTS] for fold in range(FOLDS)]


# Mixing


class Scratch:
    """Arrays that the next batch uses again, as fresh memory is slow; longer ones than batches usually need aren't kept."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, n: int, kind: type, rows: int = 1) -> np.ndarray:
        if n > 8 * CHUNK:
            return np.empty((rows, n) if rows > 1 else n, kind)
        if name not in self.held or len(self.held[name]) < n * rows:
            self.held[name] = np.empty(min(n + n // 4, 8 * CHUNK) * rows, kind)
        found = self.held[name][: n * rows]
        return found.reshape(rows, n) if rows > 1 else found

    def upto(self, n: int) -> np.ndarray:
        """The numbers below n."""
        if n > 8 * CHUNK:
            return np.arange(n)
        if "upto" not in self.held or len(self.held["upto"]) < n:
            self.held["upto"] = np.arange(max(n, 5 * CHUNK))
        return self.held["upto"][:n]


class Reader:
    """State of the mixer and the refinement for some texts."""

    def __init__(self, n: int):
        first = START.copy()
        first[:CONTEXTS] *= UNIT
        self.weights = np.tile(first[:, None], n * GATES)
        centre = 1 / (1 + np.exp(-(np.arange(CLASSES) - CLASSES // 2) / 2.0))
        self.counts = np.tile(np.stack([(1 - centre) * PRIOR, centre * PRIOR], 1).ravel(), n)

    def read(self, rows: np.ndarray, sizes: np.ndarray, x: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The chance given to each decision in a block of some texts: rows (text and gate) and sizes of the runs of decisions, x (contexts x decisions) in sixteenths."""
        starts = np.cumsum(sizes) - sizes
        own = self.weights[:, rows].repeat(sizes, axis=1)
        own[:CONTEXTS] *= x
        z = np.add.reduce(own, axis=0)
        np.clip(z, -8, 8, out=z)
        p = np.exp(-z)
        p += 1
        np.reciprocal(p, out=p)
        text = rows // GATES
        n = int(text.max()) + 1
        counts = self.counts[: n * CLASSES * 2]
        chance = (counts[1::2] / (counts[::2] + counts[1::2])).astype(np.float32).repeat(2)
        # the class and the bit in one number, that of its count
        z *= 2
        np.rint(z, out=z)
        z *= 2
        z += bit
        kind = z.astype(np.intp)
        kind += np.repeat((text * CLASSES + CLASSES // 2) * 2, sizes)
        refined = chance.take(kind, mode="clip")
        refined += p
        refined *= np.float32(0.5)
        np.clip(refined, 1 / 4096, 1 - 1 / 4096, out=refined)
        refined -= 1 - bit
        miss = np.subtract(bit, p, out=p)
        step = np.float32(STEP) / sizes.astype(np.float32)
        np.multiply(miss, x, out=own[:CONTEXTS])
        own[CONTEXTS] = miss
        change = np.add.reduceat(own, starts, axis=1)
        change[:CONTEXTS] *= UNIT * UNIT
        change *= step
        self.weights[:, rows] += change
        counts += np.bincount(kind, minlength=len(counts))
        return np.abs(refined, out=refined)


def blocks(at: np.ndarray) -> np.ndarray:
    """The block of each byte, by its place in its text."""
    return np.where(at < EARLY, at // BLOCK, EARLY // BLOCK + (at - EARLY) // LATER)


def bits_of(data: np.ndarray, bounds: np.ndarray, code: Code, tables: Sequence[np.ndarray], bits: int | Sequence[int], room: Scratch | None = None) -> np.ndarray:
    """Bits of each byte of some texts, by one fold's tables; bits: log2 of their cells, of all or of each; room: what other calls have used."""
    room = room or Scratch()
    logs = [int(b) for b in np.broadcast_to(bits, CONTEXTS)]
    lengths = np.diff(bounds)
    rank = np.argsort(-lengths, kind="stable")
    place = np.empty_like(rank)
    place[rank] = np.arange(len(rank))
    reader = Reader(len(lengths))
    before, out = 0, np.zeros(len(data), np.float32)
    for part, ends, skip in _long(data, bounds):
        if len(part) <= skip:
            continue
        three, word = (c[skip:] for c in contexts(part, ends))
        known = hashed(three, word)
        text = T.texts_of(ends)[skip:]
        block = blocks(np.arange(skip, len(part)) - ends[:-1][text] - skip + before)
        # all texts' first blocks, then all second ones, each by gate; longer texts come first, so those that go on are a prefix
        if len(lengths) > 1:
            going = np.bincount(blocks(np.maximum(lengths, 1) - 1))[::-1].cumsum()[::-1]
            owner = np.arange(going.sum()) - np.repeat(np.cumsum(going) - going, going)
            number = (np.cumsum(going) - going)[block] + place[text]
        else:
            # only a text that is alone comes in several pieces
            going = np.ones(int(block[-1] - block[0]) + 1, np.int64)
            owner, number = np.zeros(len(going), np.int64), block - block[0]
        key = number * GATES + _KINDS[three & np.uint32(255)]
        order = np.argsort(key.astype(np.uint16 if len(owner) * GATES < 1 << 16 else np.int64), kind="stable")
        key, chosen = key[order], part[skip:][order].astype(np.intp)
        many = code.lengths.take(chosen, mode="clip")
        begins = np.cumsum(many) - many
        n = int(begins[-1] + many[-1])
        # a byte's decisions look up its contexts and path by its number: cheaper than to repeat each
        byte = np.repeat(np.arange(len(chosen)), many)
        at = (code.begins.take(chosen, mode="clip") - begins).take(byte, out=room("at", n, np.intp), mode="clip")
        at += room.upto(n)
        spots = code.places.take(at, out=room("spots", n, np.int64), mode="clip")
        bit = code.ones.take(at, out=room("bit", n, np.float32), mode="clip")
        x, logit = room("x", n, np.float32, CONTEXTS), room("logit", n, np.int8)
        for k in range(CONTEXTS):
            # cells(): a place is added to the last bits of a hash, and a table's end is followed by its begin
            (known[k] & (1 << logs[k]) - 1).take(order, mode="clip").take(byte, out=at, mode="clip")
            at += spots
            x[k] = tables[k].take(at, out=logit, mode="wrap")
        first = starts_of(key)
        key = key[first]
        runs = begins[first]
        sizes = np.diff(np.r_[runs, n])
        rows = owner[key // GATES] * GATES + key % GATES
        edge = starts_of(np.repeat(np.arange(len(going)), going)[key // GATES])
        taken = room("taken", n, np.float32)
        for a, b in zip(edge, np.r_[edge[1:], len(runs)]):
            low, high = runs[a], runs[b] if b < len(runs) else n
            taken[low:high] = reader.read(rows[a:b], sizes[a:b], x[:, low:high], bit[low:high])
        own = np.empty(len(order), np.float32)
        own[order] = -np.bincount(byte, np.log2(taken, out=taken), len(order))
        out[before : before + len(own)] = own
        before += len(own)
    return out


# Long contexts


def stretches(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, from, to, context, stretch) of the places that have a long context: the hash of the AHEAD bytes before, and that with what follows.

    A place is taken if the hash says so, one in EVERY is; but not if the place before it has the same context, as
    in runs of one byte. The stretch goes on to the next place or the text's end, for STRETCH bytes at most.
    """
    found = []
    size = 1 << 20
    for at in range(0, len(data), size):
        low, high = max(0, at - AHEAD), min(len(data), at + size + STRETCH)
        if high - low <= AHEAD:
            continue
        part = data[low:high]
        total = _sums_of(part)
        back = T.powers(len(part), T.INVERSE)
        before = (total[AHEAD:-1] - total[: -AHEAD - 1]) * back[: len(part) - AHEAD]
        place = np.flatnonzero(before * np.uint64(0x9E3779B97F4A7C15) < np.uint64((1 << 64) // EVERY))
        place = place[(place == 0) | (before[place] != before[place - 1])]
        known = T.mix(before[place])
        place = place + AHEAD
        text = np.searchsorted(bounds, place + low, side="right") - 1
        fits = place + low - AHEAD >= bounds[text]
        place, known, text = place[fits], known[fits], text[fits]
        if not len(place):
            continue
        end = np.minimum(np.minimum(np.r_[place[1:], len(part)], bounds[text + 1] - low), place + STRETCH)
        # a place in the part's last STRETCH bytes is the next part's, and so is one in its first ones that this part has for context
        mine = (place + low >= at) & (place + low < at + size)
        place, end, known, text = place[mine], end[mine], known[mine], text[mine]
        follows = T.mix((total[end] - total[place]) * back[place]) + (end - place).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        found.append((text, place + low, end + low, known, T.mix(known ^ T.mix(follows))))
    if not found:
        return *(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2))
    return tuple(np.concatenate(c) for c in zip(*found))


def _repeated(text: np.ndarray, what: np.ndarray) -> np.ndarray:
    """How often each occurs in its text."""
    order = np.lexsort((what, text))
    first = np.flatnonzero(np.r_[True, (np.diff(text[order]) != 0) | (np.diff(what[order]) != 0)]) if len(order) else order
    out = np.empty(len(order), np.int32)
    out[order] = np.repeat(np.diff(np.r_[first, len(order)]), np.diff(np.r_[first, len(order)]))
    return out


_LONG = pa.struct([("context", pa.int64()), ("stretch", pa.int64()), ("own_context", pa.int32()), ("own_stretch", pa.int32()), ("bits", pa.float32())])
_LONG_DDL = "array<struct<context:long,stretch:long,own_context:int,own_stretch:int,bits:float>>"


def _scorer(model, id_type: pa.DataType):
    """Arrow function: each row's bits by the short contexts, and its long contexts with the bits that their stretches take so."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", id_type), ("n_bytes", pa.int64()), ("bits", pa.float64()), ("long", pa.list_(_LONG))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables = model.value
        bits, room = [len(t).bit_length() - 1 for t in tables[0]], Scratch()
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 36
        for whole in batches:
            for fold, runs in _by_fold(whole, CHUNK):
                for batch in runs:
                    data, bounds = text_buffers(batch.column("text"))
                    sums = np.zeros(len(data) + 1)
                    np.cumsum(bits_of(data, bounds, code, tables[(fold + 1) % FOLDS], bits, room), out=sums[1:], dtype=np.float64)
                    text, start, end, known, stretch = stretches(data, bounds)
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32()),
                        pa.StructArray.from_arrays(
                            [pa.array(known.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(_repeated(text, known)), pa.array(_repeated(text, stretch)), pa.array((sums[end] - sums[start]).astype(np.float32))],
                            fields=list(_LONG),
                        ),
                    )
                    total = sums[bounds[1:]] - sums[bounds[:-1]]
                    rows = pa.array(np.arange(row, row + batch.num_rows))
                    row += batch.num_rows
                    yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id").cast(id_type), pa.array(np.diff(bounds)), pa.array(total), lists], schema=schema)

    return run


#: Weights of a long context's decision (rows that have it, how such decisions went in the text, and a first guess by the last one: none, known, unknown).
ROWS, WENT, GUESS = 0.4, 0.6, np.array([0.5, 2.5, -1.0])


def known_bits(row: np.ndarray, others: np.ndarray, same: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bits of each long context's decision and stretch, in order of rows and places: others that have the context, and that have the stretch too."""
    hit = same > 0
    first = starts_of(row)
    sizes = np.diff(np.r_[first, len(row)])
    hits = np.cumsum(hit) - hit
    hits -= np.repeat(hits[first], sizes)
    misses = np.arange(len(row)) - np.repeat(first, sizes) - hits
    last = np.where(np.r_[False, hit[:-1]], 1, 2)
    last[first] = 0
    z = ROWS * np.log((others + 0.4) / 0.6) + WENT * np.log((hits + 0.5) / (misses + 0.5)) + GUESS[last]
    p = 1 / (1 + np.exp(-np.clip(z, -8, 8)))
    return np.where(hit, -np.log2(p) - np.log2(np.maximum(same, 1) / others), bits - np.log2(1 - p))


def _saved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (row, at, others, same, bits) sorted by row and at: each row's change of bits by its long contexts."""
    schema = pa.schema([("row", pa.int64()), ("change", pa.float64())])
    for table in whole_groups(batches, "row"):
        row, others, same, bits = (table.column(c).to_numpy() for c in ("row", "others", "same", "bits"))
        first = starts_of(row)
        yield emit(schema, row[first], np.add.reduceat(known_bits(row, others, same, bits.astype(float)) - bits, first))


def score(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) for every row of docs.

    The short contexts of a row's bytes are predicted by counts over all rows of the other of two folds; the fold is a
    hash of doc_id and text. The long contexts are counted over all rows but itself, so a text that another row holds
    too takes few bits. Rows repeated with the same doc_id and text are rows like any others: they tell each other.
    Null and empty texts have 0 bytes, 0 bits and a null bits_per_byte; results are rounded, as sums of 32-bit floats
    depend on how rows are batched in their eighth digit. doc_id may be of any type, and null. Only doc_id and
    text are read. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLDS)).cast("int").alias("fold"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, bits))
    kind = docs.schema["doc_id"].dataType
    scored = rows.mapInArrow(_scorer(model, to_arrow_type(kind)), f"row long, doc_id {kind.simpleString()}, n_bytes long, bits double, long {_LONG_DDL}")
    scored = materialise(scored, "scored")
    model.destroy()
    long = scored.select("row", F.posexplode("long").alias("at", "l")).select("row", "at", "l.*")
    # one shuffle and one sort serve both counts; a context of many rows is spilled, not held. Where a row has all of a context, nothing else does, so whole contexts are left out between them
    long = long.repartition("context").sortWithinPartitions("context", "stretch")
    shared = long.withColumn("have_context", F.count(F.lit(1)).over(Window.partitionBy("context"))).where("have_context > own_context")
    shared = shared.withColumn("have_stretch", F.count(F.lit(1)).over(Window.partitionBy("context", "stretch")))
    shared = shared.select("row", "at", (F.col("have_context") - F.col("own_context")).alias("others"), (F.col("have_stretch") - F.col("own_stretch")).alias("same"), "bits")
    saved = shared.repartition("row").sortWithinPartitions("row", "at").mapInArrow(_saved, "row long, change double")
    out = scored.select("row", "doc_id", "n_bytes", "bits").join(saved, "row", "left").withColumn("bits", F.col("bits") + F.coalesce("change", F.lit(0.0)))
    return out.select("doc_id", "n_bytes", F.round("bits", 1).alias("bits"), F.round(F.try_divide("bits", "n_bytes"), 4).alias("bits_per_byte"))
