"""Near duplicates, repeated passages, mixing, sharding, contamination, quality and scores of documents."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segloom.llm import decontam, minhash, mixing, quality, sharding, suffix
from segloom.llm import text as T
from segloom.llm.common import slices, text_buffers, whole_groups

from .conftest import prose


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# tokens


def test_words_and_ngrams_are_told_apart_as_words_are(monkeypatch):
    texts = ["a bb  c\n", "", " a bb", "bb c a bb c", "Ünï a"]
    data, bounds = text_buffers(pa.array(texts))
    whole, at = T.words(data, bounds)
    monkeypatch.setattr(T, "PIECE", 4)
    cut, at2 = T.words(data, bounds)
    assert (whole == cut).all() and (at == at2).all()
    split = [t.split() for t in texts]
    assert list(np.diff(at)) == [len(s) for s in split]
    flat = [w for s in split for w in s]
    assert all((whole[i] == whole[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    pairs, ok = T.ngrams(whole, 2), T.inside(at, 2)
    assert ok.sum() == sum(max(len(s) - 1, 0) for s in split)
    names = [tuple(flat[i : i + 2]) for i in range(len(flat) - 1)]
    assert all((pairs[i] == pairs[j]) == (names[i] == names[j]) for i in range(len(names)) for j in range(len(names)))


def test_whole_groups_joins_batches():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": k}) for k in ([1, 1, 2], [2, 2], [2, 3], [4, 4], [5])]
    seen = [t.column("k").to_pylist() for t in whole_groups(iter(batches), "k")]
    assert sum(seen, []) == [1, 1, 2, 2, 2, 2, 3, 4, 4, 5]
    assert all(not set(a) & set(b) for i, a in enumerate(seen) for b in seen[i + 1 :])


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (1, 50, 3, 0, 200, 5)]})
    assert [x for b in slices(batch, "text", 60) for x in b.column("text").to_pylist()] == batch.column("text").to_pylist()


# near duplicates


def brute_groups(docs):
    sets = {}
    for i, t in docs:
        w = t.split() if t else []
        if i is not None and w:
            sets[i, t] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    groups = defaultdict(list)
    for k in keys:
        groups[find(k)].append(k)
    return {(k[0], g[0][0], len(g), k == g[0]) for g in groups.values() if len(g) > 1 for k in g}


def many_near(n=60):
    r, out = random.Random(3), []
    for base in range(n):
        words = prose(1000 + base, 40).split()
        for copy in range(r.choice([1, 1, 2, 5, 12])):
            new = list(words)
            for _ in range(r.choice([0, 1, 2])):
                new[r.randrange(len(new))] = f"w{r.random()}"
            out.append((len(out) + 1, " ".join(new)))
    return out


def test_near_groups_equal_brute_force(spark):
    docs = many_near()
    found = minhash.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.group_id, r.n_docs, r.keep) for r in found} == brute_groups(docs)


def test_near_groups_messy(messy, nothing):
    found = minhash.near_groups(messy)
    got = {(r.doc_id, r.group_id, r.n_docs, r.keep) for r in found.collect()}
    assert got == {(1, 1, 3, True), (2, 1, 3, False), (3, 1, 3, False), (8, 8, 2, True), (12, 8, 2, False)}
    kept = minhash.drop_near(messy)
    assert kept.columns == messy.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter([1, 4, 5, 6, 7, 8, 9, 10, 11, 13, 13, None, None])
    assert minhash.near_groups(nothing).count() == 0 and minhash.drop_near(nothing).count() == 0


def test_a_table_links_members_that_agree_with_another_than_the_first():
    sketch = [0, -1, -1, 0]
    batch = pa.RecordBatch.from_pydict({"key": [5, 5, 5, 5], "node": [1, 2, 3, 4], "sketch": sketch})
    edges = {tuple(sorted(e)) for b in minhash._in_tables(40)(iter([batch])) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert edges == {(1, 4), (2, 3)}


def test_only_pairs_of_different_labels_with_like_marks():
    """What is in one group by now isn't compared again; unlike marks and other tables don't meet."""
    marks = [np.array([x] * 3, np.uint64).tobytes() for x in (0, 0, 0, 2**64 - 1, 0)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([5, 5, 5, 5, 6]), pa.array([1, 2, 3, 4, 9]), pa.array([0] * 5), pa.array([1, 1, 3, 4, 9]), pa.array(marks, pa.binary())],
        names=["key", "node", "sketch", "label", "marks"],
    )
    edges = [tuple(sorted(e)) for b in minhash._in_tables(40, 10)(iter([batch])) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert sorted(edges) == [(1, 3), (2, 3)]


def test_pairs_are_verified_without_their_component():
    """A task is given pairs with their texts, however large the component of candidates is."""
    base = prose(5, 40).split()
    near, far = [*base[:-2], "x", "y"], [*base[:10], *prose(6, 30).split()]
    texts = [" ".join(t) for t in (base, near, far)]
    batch = pa.RecordBatch.from_pydict({"u": [1, 1, 2], "v": [2, 3, 3], "u_text": [texts[0], texts[0], texts[1]], "v_text": [texts[1], texts[2], texts[2]]})
    assert [tuple(r.values()) for b in minhash._verified(0.5)(iter([batch])) for r in b.to_pylist()] == [(1, 2)]


def test_marks_tell_boilerplate_from_near_texts():
    """Pairs of Jaccard 0.5 to 0.6 pass, and most that share a fifth of their shingles don't, half of which agree in their sketches."""
    r, texts, kinds = random.Random(8), [], []
    while len(kinds) < 600:
        words = [f"w{r.getrandbits(40)}" for _ in range(60)]
        new = list(words)
        if len(kinds) % 2:
            new[22:] = [f"n{r.getrandbits(40)}" for _ in range(38)]
        else:
            for at in r.sample(range(60), 4):
                new[at] = f"n{r.getrandbits(40)}"
        a, b = ({tuple(w[k : k + 3]) for k in range(58)} for w in (words, new))
        same = len(a & b) / len(a | b)
        if 0.5 <= same or same < 0.25:
            texts += [" ".join(words), " ".join(new)]
            kinds.append(same >= 0.5)
    batch = pa.RecordBatch.from_pydict({"node": np.arange(len(texts)), "text": texts})
    out = pa.Table.from_batches(list(minhash.half_keys(minhash.BANDS, minhash.ROWS)(iter([batch]))))
    marks, sketch, near = minhash._marks(out.column("marks")), out.column("sketch").to_numpy(), np.array(kinds)
    like = minhash._unlike(marks[::2], marks[1::2]) <= minhash.differing(0.5, 2 * minhash.BANDS * minhash.ROWS + minhash.MARKS)
    agree = np.bitwise_count(~(sketch[::2] ^ sketch[1::2]).view(np.uint64)) >= minhash.agreement(0.5)
    assert like[near].mean() > 0.99 and like[~near].mean() < 0.02 and agree[~near].mean() > 0.4


# repeated passages


def brute_passages(docs, least):
    owners = defaultdict(set)
    texts = {(i, t): t.split() for i, t in docs if i is not None and t}
    for key, w in texts.items():
        for k in range(len(w) - least + 1):
            owners[tuple(w[k : k + least])].add(key)
    out = set()
    for key, w in texts.items():
        now = None
        for k in range(len(w) - least + 1):
            if len(owners[tuple(w[k : k + least])]) < 2:
                continue
            if now and k <= now[1]:
                now[1] = k + least
            else:
                if now:
                    out.add((key[0], *now))
                now = [k, k + least]
        if now:
            out.add((key[0], *now))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_passages_equal_brute_force(spark, seed):
    r = random.Random(seed)
    stock = [prose(r.random(), r.randint(8, 40)) for _ in range(12)]
    docs = [(i, " ".join(r.choice(stock) if r.random() < 0.5 else prose(r.random(), 15) for _ in range(r.randint(1, 8)))) for i in range(50)]
    found = suffix.repeats(spark.createDataFrame(docs, "doc_id long, text string"), least=12, seed=4).collect()
    assert {(x.doc_id, x.from_word, x.to_word) for x in found} == brute_passages(docs, 12)
    assert all(x.first_doc_id <= x.doc_id and x.is_first == (x.first_doc_id == x.doc_id) for x in found)


def test_passages_messy(messy, nothing):
    found = suffix.repeats(messy).collect()
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    assert {(x.doc_id, x.from_word, x.to_word) for x in found} == brute_passages(docs, 50)
    assert {x.doc_id for x in found} == {1, 2, 3, 10, 11}
    assert suffix.repeats(nothing).count() == 0


def test_every_repeated_window_has_its_least_document(spark):
    """Passages of two first documents, copied texts with an earlier document's passage, and groups of near copies."""
    r = random.Random(5)
    p, q, boiler = prose(201, 15), prose(202, 15), prose(203, 14)
    body = prose(204, 60) + " " + boiler + " " + prose(205, 60)
    docs = [(5, f"{p} {q}"), (2, f"{p} {prose(206, 5)}"), (9, f"{prose(207, 5)} {q}"), (1, boiler), (11, body), (12, body), (13, body + " end")]
    stock = [prose(r.random(), r.randint(8, 40)) for _ in range(6)]
    docs += [(20 + i, " ".join(r.choice(stock) if r.random() < 0.7 else prose(r.random(), 9) for _ in range(r.randint(1, 6)))) for i in range(40)]
    least, holders = 12, defaultdict(set)
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - least + 1):
            holders[tuple(w[k : k + least])].add(i)
    want = {(i, k): min(holders[tuple(w[k : k + least])]) for i, t in docs for w in [t.split()] for k in range(len(w) - least + 1) if len(holders[tuple(w[k : k + least])]) > 1}
    found = suffix.repeats(spark.createDataFrame(docs, "doc_id long, text string"), least=least, seed=4).collect()
    got = [((x.doc_id, k), y.first_doc_id, y.is_first) for x in found for y in x.parts for k in range(y.from_word, y.to_word - least + 1)]
    assert len(got) == len(want) and {k: f for k, f, _ in got} == want
    assert all(mine == (k[0] == f) for k, f, mine in got)
    for x in found:
        assert (min(y.from_word for y in x.parts), max(y.to_word for y in x.parts), min(y.first_doc_id for y in x.parts)) == (x.from_word, x.to_word, x.first_doc_id)


# contamination


def test_tiles_are_longest_first_and_reordering_is_caught(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, prose(50, 30)), (3, "too few words")]
    w = items[0][1].split()
    docs = [
        (1, "x y " + " ".join(w[5:]) + " z " + " ".join(w[:5]) + " q"), (2, prose(51, 200)), (3, prose(60, 40) + " " + items[1][1].upper().replace(" ", ", ")), (4, " ".join(w[:5])), (5, None), (6, "too few words"),
        (None, items[0][1]), (3, prose(60, 40) + " " + items[1][1].upper().replace(" ", ", ")),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (None, "a b c d e"), (4, None)], "item_id long, text string")
    want = [(1, 1, 10, 10, 1.0), (3, 2, 30, 30, 1.0), (None, 1, 10, 10, 1.0)]
    assert rows(decontam.contaminated(d, b)) == want
    assert rows(decontam.contaminated(d, b, small=0)) == want
    kept = [(1, 1), (3, 2), (3, 2), (None, 1)]
    for small in (decontam.SMALL, 0):
        assert Counter(r.doc_id for r in decontam.drop_contaminated(d, b, small=small).collect()) == Counter(x[0] for x in docs) - Counter(k[0] for k in kept)


def brute_tiles(doc, item, least):
    used_d, used_i, total = set(), set(), 0
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n >= least and (best is None or (-n, i, d) < best):
                    best = (-n, i, d)
        if best is None:
            return total
        n, i, d = -best[0], best[1], best[2]
        used_i |= set(range(i, i + n))
        used_d |= set(range(d, d + n))
        total += n


@pytest.mark.parametrize("seed", range(40))
def test_tiling_equals_brute_force(seed):
    r = random.Random(seed)
    doc, item = [[r.choice("abcd") for _ in range(n)] for n in (40, 14)]
    matcher = decontam.Items([0], [" ".join(item)], 2)
    found = [n for _, _, n, _ in matcher.match(pa.array([" ".join(doc)]))]
    assert (found or [0]) == [brute_tiles(doc, item, 2)]


def test_contamination_empty(messy, nothing, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(messy, none).count() == 0 and decontam.contaminated(nothing, none).count() == 0
    assert decontam.drop_contaminated(messy, none).count() == messy.count()


# mixing


def brute_mix(docs, block, power=mixing.POWER):
    import hashlib

    per = defaultdict(list)
    for i, t, s in docs:
        n = len((t or "").split())
        if n:
            per[s or ""].append((hashlib.md5(f"{mixing.SEED}|{'' if i is None else i}".encode()).hexdigest(), i, n))
    blocks = {}
    for s, items in per.items():
        at, out = 0, defaultdict(list)
        for _, i, n in sorted(items, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
            for b in range(at // block, (at + n - 1) // block + 1):
                out[b].append((i, max(0, b * block - at), min(n, (b + 1) * block - at)))
            at += n
        blocks[s] = (out, at)
    weight = {s: int(blocks[s][1] ** power * 1000) for s in sorted(blocks)}
    total, cum, cuts = sum(weight.values()), 0, []
    for s in weight:
        cum += weight[s]
        cuts.append((cum * mixing.CIRCLE // total, s))
    used, out = Counter(), []
    for slot in range(1, sum(-(-b[1] // block) for b in blocks.values()) + 1):
        u = (slot * mixing.GOLDEN) % mixing.CIRCLE
        s = next(s for hi, s in cuts if u < hi)
        k = -(-blocks[s][1] // block)
        out += [(slot, s, used[s] // k, used[s] % k, *p) for p in blocks[s][0][used[s] % k]]
        used[s] += 1
    return out


def test_mix_equals_brute_force(messy, nothing):
    docs = [(r.doc_id, r.text, r.source) for r in messy.collect()]
    want = brute_mix(docs, 64)
    assert rows(mixing.mix(messy, block=64)) == sorted(want, key=str)
    drawn = Counter(x[4] for x in want if x[5] == 0)
    out = mixing.mixed_documents(messy, block=64)
    assert out.columns == messy.columns and Counter(r.doc_id for r in out.collect()) == drawn
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mix_reaches_given_weights(spark):
    docs = spark.createDataFrame([(i, prose(i, 50), "ab"[i % 10 == 0]) for i in range(400)], "doc_id long, text string, source string")
    got = Counter(r.source for r in mixing.mix(docs, {"a": 1, "b": 3}, block=25).select("slot", "source").distinct().collect())
    assert abs(got["a"] / sum(got.values()) - 0.25) < 0.01
    assert mixing.mix(docs, {"zzz": 1.0}).count() == 0


# sharding


def test_differencing_is_as_good_as_it_should_be():
    assert sorted(np.bincount(sharding.difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))[:, 0], [8, 7, 6, 5, 4])) == [14, 16]
    r = random.Random(1)
    sizes = [r.randint(1, 10_000) for _ in range(500)]
    parts = np.zeros((500, 8), np.int64)
    parts[:, 0] = sizes
    sums = np.bincount(sharding.difference(parts)[:, 0], sizes, 8)
    heap = [0] * 8
    for s in sorted(sizes, reverse=True):
        heap[heap.index(min(heap))] += s
    assert sums.max() - sums.min() < max(heap) - min(heap)
    assert sharding.difference(np.zeros((0, 3), np.int64)).shape == (0, 3)


def brute_kk(sizes, k):
    """The same on lists of (sum, members)."""
    parts = [(n, [(s, [n])] + [(0, [])] * (k - 1)) for n, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(max(s for s, _ in p[1]) - min(s for s, _ in p[1])), p[0]))
        (m, a), (n, b), *parts = parts
        parts.append((min(m, n), [(x + y, u + v) for (x, u), (y, v) in zip(sorted(a, key=lambda t: -t[0]), sorted(b, key=lambda t: -t[0])[::-1])]))
    return sorted(s for s, _ in parts[0][1])


@pytest.mark.parametrize("seed", range(5))
def test_differencing_equals_brute_force(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 50) for _ in range(30)]
    parts = np.zeros((30, 4), np.int64)
    parts[:, 0] = sizes
    assert sorted(np.bincount(sharding.difference(parts)[:, 0], sizes, 4)) == brute_kk(sizes, 4)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_shards_keep_groups_together(messy, nothing, bucket):
    found = sharding.shard_documents(messy, shards=3, bucket=bucket)
    got = found.collect()
    assert len(got) == messy.count() and all(0 <= r.shard < 3 for r in got)
    assert all(len(s) == 1 for s in [{r.shard for r in got if r.text_hash == h} for h in {r.text_hash for r in got}])
    out = sharding.with_shard(messy, shards=3, bucket=bucket)
    assert Counter(out.columns) == Counter(messy.columns) and out.count() == messy.count()
    assert sharding.shard_documents(nothing).count() == 0 and sharding.with_shard(nothing).count() == 0


# quality


def test_classifier_on_held_out_documents(spark):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = prose(i, 60)
        text = " ".join(w.upper() + "!!" for w in text.split()) if bad else text
        if toxic:
            words = text.split()
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["vile", "nasty", "awful"]))
            text = " ".join(words)
        docs.append((i, text))
        if i % 2:
            pass
        labels.append((i, int(not bad), int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    train = spark.createDataFrame(labels[:400] + [(0, None, None), (None, 1, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.classify(d, train).collect()}
    held = [x for x in labels[400:]]
    assert np.mean([(got[i].p_quality >= 0.5) == bool(q) for i, q, _ in held]) > 0.97
    assert np.mean([(got[i].p_toxic > 0.3) == bool(t) for i, _, t in held]) > 0.97
    kept = {x.doc_id for x in quality.drop_rejected(d, train).collect()}
    assert kept == {i for i, x in got.items() if x.keep}


def test_classifier_messy(messy, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = quality.classify(messy, none)
    assert scored.count() == messy.count() and scored.where("not keep").count() == 0
    one = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, None, None)], none.schema)
    out = quality.drop_rejected(messy, one)
    assert out.columns == messy.columns
    assert quality.classify(nothing, one).count() == 0 and quality.drop_rejected(nothing, none).count() == 0


def test_scores_are_sparse_dot_products(spark):
    texts = ["a b, c", "a B c!!", "", "a a a"]
    found, owner = quality.features(*text_buffers(pa.array(texts)))
    sets = [set(found[owner == k].tolist()) for k in range(4)]
    w = np.zeros(quality.BUCKETS)
    buckets = np.array(sorted(set().union(*sets) | {0}))
    w[buckets] = np.linspace(-1, 1, len(buckets))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r.doc_id: r.p for r in df.select("doc_id", quality.score(F.col("text"), (buckets, w[buckets][:, None]), ("p",))["p"].alias("p")).collect()}
    for k in range(4):
        assert got[k] == pytest.approx(1 / (1 + np.exp(-(w[0] + w[list(sets[k] - {0})].sum()))))
    assert len(sets[0] & sets[1]) >= 3


# brute force of what is fitted, and limits of what is searched


def plain_features(text: str) -> set:
    """Words without marks, pairs of them, and marks and capitals of a word, as strings."""
    words = text.split()
    core = ["".join(c for c in w.lower() if c.isalnum()) for w in words]
    out = {("w", c) for c in core} | {("p", *p) for p in zip(core, core[1:])}
    for w in words:
        marks, capitals = "".join(sorted(c for c in w if not c.isalnum())), sum(c.isupper() for c in w) > 1 and not any(c.islower() for c in w)
        if marks or capitals:
            out.add(("s", marks, capitals))
    return out


def test_training_equals_plain_ftrl(spark):
    """FTRL-proximal on dictionaries, in the same order of rows."""
    r = random.Random(8)
    docs, labels = [], []
    for i in range(120):
        words = prose(i, 20).split()
        if i % 3 == 0:
            words = [w.upper() + "!" for w in words]
        if i % 4 == 0:
            words.insert(r.randrange(20), '"vile"')
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 > 0), int(i % 4 == 0) if i % 5 else None))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    order = [x.doc_id for x in d.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    text, truth = dict(docs), {i: (q, t) for i, q, t in labels}
    z, n = defaultdict(lambda: [0.0, 0.0]), defaultdict(lambda: [0.0, 0.0])
    l1 = quality.L1 * len(order) ** 0.5

    def weight(f, k):
        if abs(z[f][k]) <= l1:
            return 0.0
        return -(z[f][k] - np.sign(z[f][k]) * l1) / ((quality.BETA + n[f][k] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.PASSES):
        for i in order:
            own = plain_features(text[i]) | {"bias"}
            for k in (0, 1):
                if truth[i][k] is None:
                    continue
                w = {f: weight(f, k) for f in own}
                g = 1 / (1 + np.exp(-sum(w.values()))) - truth[i][k]
                for f in own:
                    z[f][k] += g - ((n[f][k] + g * g) ** 0.5 - n[f][k] ** 0.5) / quality.ALPHA * w[f]
                    n[f][k] += g * g
    got = {x.doc_id: x for x in quality.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for i in order:
        own = plain_features(text[i]) | {"bias"}
        for k, p in enumerate((got[i].p_quality, got[i].p_toxic)):
            assert p == pytest.approx(1 / (1 + np.exp(-sum(weight(f, k) for f in own))), abs=1e-6)
    assert len({round(x.p_toxic, 3) for x in got.values()}) > 1


def test_nothing_learned_of_toxicity_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, prose(i, 30).upper() if i % 2 else prose(i, 30)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(60)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert {x.p_toxic for x in got} == {0.5} and {x.doc_id for x in got if x.keep} == set(range(0, 60, 2))


def test_marks_do_not_count():
    same = ["it's a co-operative word", '"its (a) cooperative - *word*', "ITS a -- cooperative word!", "its a cooperative word"]
    data, bounds = text_buffers(pa.array(same))
    hashes, at = T.words(data, bounds, quality.WORD_CODES)
    assert list(np.diff(at)) == [4] * 4 and len({tuple(hashes[a:b]) for a, b in zip(at, at[1:])}) == 1


def test_marked_up_items_are_found(spark):
    item = prose(70, 24)
    marked = " ".join(f'"{w}' if k % 3 == 0 else f"{w} -" if k % 3 == 1 else f"*{w}*" for k, w in enumerate(item.split()))
    docs = spark.createDataFrame([(1, prose(71, 20) + " " + marked), (2, prose(72, 50)), (3, "- ! ."), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, "--- ... !!!"), (3, "")], "item_id long, text string")
    for small in (decontam.SMALL, 0):
        assert [(x.doc_id, x.item_id, x.coverage) for x in decontam.contaminated(docs, items, small=small).collect()] == [(1, 1, 1.0)]


def test_joined_search_equals_that_of_a_task(spark):
    """Some thousands of texts and hundreds of items that share common phrases."""
    r = random.Random(3)
    phrases = [prose(500 + k, 5) for k in range(20)]
    items = [(k, " ".join([prose(600 + k, r.randint(2, 12)), r.choice(phrases), prose(800 + k, r.randint(0, 12))])) for k in range(300)]
    docs = [(k, " ".join([prose(2000 + k, 20), r.choice(phrases), r.choice(items)[1] if k % 7 == 0 else "", r.choice(phrases)])) for k in range(2500)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = rows(decontam.contaminated(d, i))
    assert len(found) > 300 and found == rows(decontam.contaminated(d, i, small=0))


def test_recall_at_the_threshold():
    """Pairs of Jaccard 0.5 to 0.6 that share a table and agree in their sketches."""
    r, pairs = random.Random(6), []
    while len(pairs) < 1500:
        words = [f"w{r.getrandbits(40)}" for _ in range(60)]
        new = list(words)
        for at in r.sample(range(60), r.randint(4, 7)):
            new[at] = f"n{r.getrandbits(40)}"
        a, b = ({tuple(w[k : k + 3]) for k in range(58)} for w in (words, new))
        if 0.5 <= len(a & b) / len(a | b) < 0.6:
            pairs += [(" ".join(words), " ".join(new))]
    batch = pa.RecordBatch.from_pydict({"node": np.arange(len(pairs) * 2), "text": [t for p in pairs for t in p]})
    out = pa.Table.from_batches(list(minhash.half_keys(minhash.BANDS, minhash.ROWS)(iter([batch])))).to_pylist()
    caught = 0
    for x, y in zip(out[::2], out[1::2]):
        meets = set(x["a"]) & set(y["a"]) and set(x["b"]) & set(y["b"])
        caught += bool(meets) and 64 - ((x["sketch"] ^ y["sketch"]) & (2**64 - 1)).bit_count() >= minhash.agreement(0.5)
    assert caught / len(pairs) > 0.94 and minhash.recall(0.5) > 0.93 and minhash.agreement(0.5) == 37


@pytest.mark.parametrize("power", [1.2, 3.0])
def test_buckets_lose_little_of_evenness(spark, power):
    """Against one run over all groups, some of which are as large as a bucket."""
    r = random.Random(2)
    sizes = [int(r.paretovariate(power) * 1000) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "unit long, bytes long")
    spread = {}
    for bucket in (4096, 256):
        found = sharding.assign(df, 8, bucket).join(df, "unit")
        sums = [x[1] for x in found.groupBy("shard").agg(F.sum("bytes")).collect()]
        assert len(sums) == 8 and sum(sums) == sum(sizes) and found.count() == 4000
        spread[bucket] = max(sums) - min(sums)
    assert spread[4096] < 100 and spread[256] < 0.001 * sum(sizes) / 8


@pytest.mark.parametrize("seed", range(4))
def test_combined_partitions_spread_no_more_than_the_widest(seed):
    r = np.random.default_rng(seed)
    parts = r.integers(0, 1000, (40, 6))
    goes = sharding.difference(parts)
    sums = np.bincount(goes.ravel(), parts.ravel(), 6)
    assert sums.max() - sums.min() <= (parts.max(1) - parts.min(1)).max()


def test_mixed_documents_draw_the_text_that_is_due(spark):
    """Two texts of one doc_id and length: their order is that of their hashes, and rows stay whole."""
    docs = [(7, prose(1, 40), "a", "x"), (7, prose(2, 40), "a", "y"), (7, prose(2, 40), "a", "y"), *((k, prose(k, 40), "ab"[k % 2], "z") for k in range(10, 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, tag string")
    runs = [Counter(map(tuple, mixing.mixed_documents(df.repartition(n), {"a": 1, "b": 3}, block=100).collect())) for n in (1, 3)]
    assert runs[0] == runs[1] and set(runs[0]) <= set(docs)
