"""Context mixing against brute force: plain Python, with contexts as strings and no hashing."""

import heapq
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segloom.llm import lm
from segloom.llm.common import text_buffers

from .conftest import prose


def huffman(counts: Counter) -> dict[int, list[tuple[int, int]]]:
    """For each byte its decisions as (inner node, bit)."""
    heap = [(counts[k] + 1, k) for k in range(256)]
    heapq.heapify(heap)
    up, made = {}, 256
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (made, 0), (made, 1)
        heapq.heappush(heap, (a + b, made))
        made += 1
    out = {}
    for k in range(256):
        path, at = [], k
        while at in up:
            at, bit = up[at]
            path.append((at, bit))
        out[k] = path[::-1]
    return out


def plain_contexts(data: bytes, i: int) -> list:
    low = lambda k: data[max(0, i - k) : i]
    letter = lambda c: chr(c).isalnum() or c >= 128
    at = i
    while at > max(0, i - lm.PREFIX) and letter(data[at - 1]):
        at -= 1
    return [low(1).rjust(1, b"\0"), low(2).rjust(2, b"\0"), low(3).rjust(3, b"\0"), (data[at:i], low(1))]


def kind_of(c: int) -> int:
    ch = chr(c)
    return 0 if c <= 32 else 6 if c >= 192 else 7 if c >= 128 else 4 if ch.isdigit() else 1 if ch in "aeiou" else 2 if ch.islower() else 3 if ch.isupper() else 5


def plain_bits(data: bytes, code, predict) -> list[float]:
    """Bits of each byte; predict(k, context, node): the logit of a context's cell in sixteenths."""
    weights = {g: [0.15, 0.25, 0.45, 0.4, 0.0] for g in range(8)}
    centre = [1 / (1 + math.exp(-(c - 16) / 2)) for c in range(33)]
    ones, seen = [c * lm.PRIOR for c in centre], [lm.PRIOR] * 33
    out, edges = [], [*range(0, 1024, 64), *range(1024, len(data) + 256, 256)]
    for at, to in zip(edges, edges[1:]):
        grads, kinds = defaultdict(list), []
        for i in range(at, min(to, len(data))):
            gate, known, bits = kind_of(data[i - 1] if i else 0), plain_contexts(data, i), 0.0
            for node, bit in code[data[i]]:
                x = [predict(k, c, node) / 16 for k, c in enumerate(known)] + [1.0]
                z = min(8, max(-8, sum(a * b for a, b in zip(weights[gate], x))))
                p, kind = 1 / (1 + math.exp(-z)), round(z * 2) + 16
                q = min(1 - 1 / 4096, max(1 / 4096, (p + ones[kind] / seen[kind]) / 2))
                bits -= math.log2(q if bit else 1 - q)
                grads[gate].append([(bit - p) * v for v in x])
                kinds.append((kind, bit))
            out.append(bits)
        for gate, g in grads.items():
            weights[gate] = [w + 0.4 * sum(c) / len(g) for w, c in zip(weights[gate], zip(*g))]
        for kind, bit in kinds:
            seen[kind] += 1
            ones[kind] += bit
    return out


def plain_score(docs: list[tuple[int, str]], fold_of) -> dict[int, float]:
    """Total bits of each document, with counts in dictionaries."""
    texts = {i: t.encode() for i, t in docs}
    histogram = Counter(b for t in texts.values() for b in t)
    code = huffman(histogram)
    counts = [[defaultdict(lambda: [0, 0]) for _ in range(4)] for _ in range(2)]
    for i, t in texts.items():
        for at in range(len(t)):
            for k, c in enumerate(plain_contexts(t, at)):
                for node, bit in code[t[at]]:
                    counts[fold_of[i]][k][c, node][bit] += 1

    def predict(fold):
        def one(k, c, node):
            z, o = counts[1 - fold][k].get((c, node), (0, 0))
            return min(127, max(-127, round(math.log((o + 0.4) / (z + 0.4)) * 16)))

        return one

    # long contexts, as strings; only where they are is asked of the code under test
    places, have, follow = {}, Counter(), Counter()
    for i, t in texts.items():
        arr = np.frombuffer(t, np.uint8)
        _, start, end, *_ = lm.stretches(arr, np.array([0, len(arr)]))
        places[i] = [(t[s - 24 : s], t[s:e], s, e) for s, e in zip(start.tolist(), end.tolist())]
        assert all(s >= 24 and 0 < e - s <= 256 for _, _, s, e in places[i])
        have.update(c for c, *_ in places[i])
        follow.update((c, f) for c, f, *_ in places[i])
    out = {}
    for i, t in texts.items():
        bits = plain_bits(t, code, predict(fold_of[i]))
        total, hits, misses, last = sum(bits), 0, 0, 0
        own, own_follow = Counter(c for c, *_ in places[i]), Counter((c, f) for c, f, *_ in places[i])
        for c, f, s, e in places[i]:
            others, same = have[c] - own[c], follow[c, f] - own_follow[c, f]
            if not others:
                continue
            z = 0.4 * math.log((others + 0.4) / 0.6) + 0.6 * math.log((hits + 0.5) / (misses + 0.5)) + (0.5, 2.5, -1.0)[last]
            p = 1 / (1 + math.exp(-min(8, max(-8, z))))
            if same:
                total += -math.log2(p) - math.log2(same / others) - sum(bits[s:e])
                hits, last = hits + 1, 1
            else:
                total -= math.log2(1 - p)
                misses, last = misses + 1, 2
        out[i] = total
    return out


def corpus():
    r = random.Random(4)
    passage = prose(900, 60)
    docs = [(i, prose(i, r.randint(1, 120))) for i in range(60)]
    docs += [(100, docs[3][1]), (101, docs[7][1]), (102, docs[7][1])]
    docs += [(200 + k, f"{prose(300 + k, 20)} {passage} {prose(400 + k, 20)}") for k in range(4)]
    docs += [(300, "ab " * 700), (301, "=" * 400 + "ü\n" + prose(5, 40)), (302, "x"), (303, "")]
    return docs


def test_scores_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    fold_of = {r.doc_id: r.fold for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)).alias("fold")).collect()}
    want = plain_score(docs, fold_of)
    got = {r.doc_id: r.bits for r in lm.score(df).collect()}
    assert got.keys() == want.keys()
    # cells that contexts share by chance are the one difference
    assert all(got[i] == pytest.approx(want[i], rel=0.03, abs=1.5) for i in want)
    assert sum(got.values()) == pytest.approx(sum(want.values()), rel=0.005)


def test_copies_are_told_apart(spark):
    """Both of two copies take few bits, whatever their folds; all others as many as before."""
    docs = [(i, prose(i, 100)) for i in range(150)]
    twice = [(1000 + i, docs[i][1]) for i in range(0, 150, 15)]
    got = {r.doc_id: r.bits_per_byte for r in lm.score(spark.createDataFrame(docs + twice, "doc_id long, text string"), bits=16).collect()}
    copied = {i for k, _ in twice for i in (k, k - 1000)}
    assert max(got[i] for i in copied) < 0.6 * min(v for i, v in got.items() if i not in copied)


def test_a_row_never_tells_itself(spark):
    """A text that repeats its own stretches has no long context from others."""
    text = " ".join([prose(1, 40)] * 5)
    docs = [(1, text), *((k, prose(k, 50)) for k in range(2, 30))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    alone = {r.doc_id: r.bits_per_byte for r in lm.score(df, bits=14).collect()}
    both = {r.doc_id: r.bits_per_byte for r in lm.score(df.unionByName(df.where("doc_id = 1")), bits=14).where("doc_id = 1").collect()}
    assert both[1] < alone[1] / 4


def test_long_texts_score_as_in_one_piece(monkeypatch):
    data = np.frombuffer(prose(8, 900).encode(), np.uint8)
    code = lm.Code(np.bincount(data, minlength=256))
    tables = np.random.default_rng(1).integers(-80, 80, (lm.CONTEXTS, 1 << 12)).astype(np.int8)
    args = (data, np.array([0, len(data)]), code, tables, 12)
    whole = lm.bits_of(*args)
    pieces = lm._long
    monkeypatch.setattr(lm, "_long", lambda d, b: pieces(d, b, lm.LATER * 4))
    assert lm.bits_of(*args) == pytest.approx(whole, rel=1e-3)


def test_texts_read_together_score_as_alone():
    texts = [prose(k, 5 + 13 * k) for k in range(20)] + ["", "a"]
    data, bounds = text_buffers(pa.array(texts))
    code = lm.Code(np.bincount(data, minlength=256))
    tables = np.random.default_rng(1).integers(-80, 80, (lm.CONTEXTS, 1 << 12)).astype(np.int8)
    whole = lm.bits_of(data, bounds, code, tables, 12)
    for k, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        assert lm.bits_of(own, np.array([0, len(own)]), code, tables, 12) == pytest.approx(whole[bounds[k] : bounds[k + 1]], rel=1e-3)


def test_stretches_are_those_of_their_text(monkeypatch):
    texts = [prose(k, 300) for k in range(4)] + ["", "z" * 3000, prose(2, 300)]
    data, bounds = text_buffers(pa.array(texts))
    text, start, end, known, stretch = lm.stretches(data, bounds)
    assert len(text) > 60 and (np.diff(text) >= 0).all() and not (text == 4).any()
    for k in set(text.tolist()):
        mine = text == k
        own = np.frombuffer(texts[k].encode(), np.uint8)
        alone = lm.stretches(own, np.array([0, len(own)]))
        assert (alone[1] + bounds[k] == start[mine]).all() and (alone[2] + bounds[k] == end[mine]).all()
        assert (alone[3] == known[mine]).all() and (alone[4] == stretch[mine]).all()
    assert (known[text == 2] == known[text == 6]).all() and (stretch[text == 2] == stretch[text == 6]).all()
    assert lm._repeated(np.array([0, 0, 1, 0]), np.array([5, 6, 5, 5])).tolist() == [2, 1, 1, 2]


def test_long_stretches_over_pieces():
    """Places near the edge of a megabyte are as those of the same text elsewhere."""
    body = prose(3, 400_000)[: (1 << 20) + 5000]
    shift = "#" * 777
    a, b = (np.frombuffer(t.encode(), np.uint8) for t in (body, shift + body))
    one, two = lm.stretches(a, np.array([0, len(a)])), lm.stretches(b, np.array([0, len(b)]))
    later = two[1] >= 777 + lm.AHEAD
    assert (one[1] == two[1][later] - 777).all() and (one[2] == two[2][later] - 777).all() and (one[4] == two[4][later]).all()


def test_tables_grow_with_what_the_corpus_holds(spark, monkeypatch):
    docs = [(i % 2, prose(i, 60)) for i in range(300)]
    df = spark.createDataFrame(docs, "fold int, text string").repartition(3)
    code, tables = lm.fit(df, bits=8)
    plain = huffman(Counter(b for _, t in docs for b in t.encode()))
    assert [len(plain[k]) for k in range(256)] == code.lengths.tolist()
    for fold in range(lm.FOLDS):
        filled = [set() for _ in range(lm.CONTEXTS)]
        for f, t in docs:
            if f == fold:
                for at in range(len(t)):
                    for k, c in enumerate(plain_contexts(t.encode(), at)):
                        filled[k].update((c, node) for node, _ in plain[t.encode()[at]])
        for k, table in enumerate(tables[fold]):
            # contexts of words are hashed, so that a few may be one
            assert len(table) >= max(1 << 8, lm.SPARE * len(filled[k]) * 0.98) and np.count_nonzero(table) <= len(filled[k])
    monkeypatch.setattr(lm, "MOST", 10)
    assert {len(t) for fold in lm.fit(df, bits=8)[1] for t in fold} == {1 << 10}


def test_counts_stay_whole_when_a_task_holds_little(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"fold": pa.array([k % 2 for k in range(60)], pa.int32()), "text": [prose(k % 40, 30) for k in range(60)]})

    def sums():
        parts = sorted((b for b in lm._counter(iter([batch, batch]))), key=lambda b: b.column("part")[0].as_py())
        return [(b.column("part")[0].as_py(), lm._spread(b.column("counts")[0].as_py(), b.column("n")[0].as_py(), 2).tolist()) for b in lm._merged(iter(parts))]

    whole = sums()
    assert sum(sum(c[1]) for _, c in whole) == 2 * sum(len(t.as_py().encode()) for t in batch.column("text")) * 2
    monkeypatch.setattr(lm, "HELD", 50)
    assert sums() == whole


def test_scores_tell_known_text_from_noise(spark, messy, nothing):
    r = random.Random(2)
    docs = [(i, prose(i, 80)) for i in range(200)] + [(1000, "".join(chr(r.randint(33, 126)) for _ in range(500)))]
    got = {x.doc_id: x.bits_per_byte for x in lm.score(spark.createDataFrame(docs, "doc_id long, text string"), bits=14).collect()}
    assert max(v for k, v in got.items() if k < 1000) < 3.5 < got[1000]
    out = lm.score(messy, bits=12)
    by = {r.doc_id: r for r in out.collect()}
    assert out.count() == messy.count() and by[5].bits_per_byte is None and by[6].n_bytes == 0 and by[9].n_bytes > 200_000
    assert lm.score(nothing, bits=12).count() == 0
    named = lm.score(spark.createDataFrame([("a", "some words"), (None, "b")], "doc_id string, text string"), bits=12)
    assert {x.doc_id for x in named.collect()} == {"a", None}


def test_short_texts_learn():
    """The second half of 200 bytes is cheaper than by the first weights alone."""
    arr = np.frombuffer(b"ab" * 100, np.uint8)
    code = lm.Code(np.bincount(arr, minlength=256))
    tables = np.zeros((lm.CONTEXTS, 1 << 8), np.int8)
    half, whole = (lm.bits_of(arr[:n], np.array([0, n]), code, tables, 8).sum() for n in (lm.BLOCK, 200))
    assert whole != pytest.approx(half * 200 / lm.BLOCK, rel=0.01)
    assert list(lm.blocks(np.array([0, lm.BLOCK, lm.EARLY - 1, lm.EARLY, lm.EARLY + lm.LATER]))) == [0, 1, lm.EARLY // lm.BLOCK - 1, lm.EARLY // lm.BLOCK, lm.EARLY // lm.BLOCK + 1]


def test_arrays_that_batches_share_change_no_bit(monkeypatch):
    """Batches that grow and shrink, and a text longer than what is kept, through the same arrays as by fresh ones."""
    monkeypatch.setattr(lm, "CHUNK", 1 << 10)
    r, room = np.random.default_rng(3), lm.Scratch()
    batches = [[prose(500 + k, n) for k in range(m)] for m, n in ((3, 40), (6, 90), (1, 2000), (2, 5), (5, 60))]
    arrays = [np.frombuffer("".join(b).encode(), np.uint8) for b in batches]
    code = lm.Code(np.bincount(np.concatenate(arrays), minlength=256))
    tables = [r.integers(-127, 128, 1 << 10).astype(np.int8) for _ in range(lm.CONTEXTS)]
    for texts, data in zip(batches, arrays):
        bounds = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
        assert np.array_equal(lm.bits_of(data, bounds, code, tables, 10, room), lm.bits_of(data, bounds, code, tables, 10))
    assert room.held and all(len(a) <= 8 * lm.CHUNK * lm.CONTEXTS for a in room.held.values())


def test_cells_of_a_context_are_side_by_side():
    """No two decisions of a context share a cell, and nearly all that texts have are within a cache line's length."""
    arr = np.frombuffer(" ".join(prose(k, 200) for k in range(20)).encode(), np.uint8)
    code = lm.Code(np.bincount(arr, minlength=256))
    lengths, path = lm.decisions(arr, code)
    assert len(np.unique(code.places)) == 255 and code.places.min() >= 0 and code.places.max() < 256
    assert (code.places[path] < 64).mean() > 0.95
    # bits_of() takes the cells that cells() says, at a table's end too
    tables = np.random.default_rng(5).integers(-127, 128, (lm.CONTEXTS, 1 << 8)).astype(np.int8)
    arr = arr[: lm.BLOCK]
    lengths, path = lm.decisions(arr, code)
    known = lm.hashed(*lm.contexts(arr, np.array([0, len(arr)])))
    x = sum(w * t[lm.cells(np.repeat(h, lengths), code.places[path], 8)] / 16 for w, t, h in zip(lm.START, tables, known))
    p, centre = 1 / (1 + np.exp(-np.clip(x, -8, 8))), 1 / (1 + np.exp(-np.clip(np.rint(np.clip(x, -8, 8) * 2), -16, 16) / 2))
    taken = np.abs(1 - code.bits[path] - np.clip((p + centre) / 2, 1 / 4096, 1 - 1 / 4096))
    want = -np.add.reduceat(np.log2(taken), np.cumsum(lengths) - lengths)
    assert lm.bits_of(arr, np.array([0, len(arr)]), code, tables, 8) == pytest.approx(want, rel=1e-3)


def test_long_contexts_are_counted_by_one_shuffle(spark):
    """Only each row's sum is joined, and a context that all rows have is counted in full when it is spilled."""
    shared = prose(77, 60)
    docs = [(k, f"{shared} {prose(800 + k % 30, 15)}") for k in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = lm.score(df, bits=12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("posexplode(") == 1
    want = {r.doc_id: r.bits for r in out.collect()}
    # each of 30 texts is there eight times, all begin alike: little is left to tell
    assert max(want.values()) < 0.5 * lm.score(df.limit(1), bits=12).collect()[0].bits
    kept = {k: spark.conf.get(k) for k in ("spark.sql.windowExec.buffer.in.memory.threshold", "spark.sql.windowExec.buffer.spill.threshold")}
    try:
        for k in kept:
            spark.conf.set(k, "4")
        assert {r.doc_id: r.bits for r in lm.score(df, bits=12).collect()} == pytest.approx(want, abs=0.11)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
