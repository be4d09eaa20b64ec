"""The stages of the pipeline, each on all that its predecessor kept, against brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from segloom.llm import minhash, quality

from .conftest import prose
from .test_documents import brute_groups, brute_mix, brute_tiles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, folder = random.Random(11), str(tmp_path_factory.mktemp("sf"))
    items = [(k, prose(700 + k, 20)) for k in range(4)]
    docs = []
    for i in range(160):
        words = prose(i, r.randint(30, 80)).split()
        if i % 6 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 9 == 0:
            words.insert(3, "vile")
        docs.append((i, " ".join(words)))
    docs += [(300 + k, docs[k * 7 + 1][1] + (" more" if k % 2 else "")) for k in range(10)]
    docs += [(400 + k, f"{prose(800 + k, 15)} {items[k][1]} {prose(900 + k, 15)}") for k in range(4)]
    docs += [(500, ""), (501, None), (None, prose(999, 40)), (None, None), (3, docs[3][1]), (502, prose(1000, 3000))]
    rows = [(i, t, "en", "abc"[(i or 0) % 3] if i != 8 else None, len(t) if t else None) for i, t in docs]
    labels = [(i, int(i % 6 > 0), int(i % 9 == 0)) for i in range(150)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, labels, items


def plain(t):
    return ["".join(c for c in w.lower() if c.isalnum()) for w in (t or "").split()]


def test_stages_equal_brute_force(spark, tables):
    folder, rows, labels, items = tables
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_duplicates", "decontamination", "source_mix", "shards"]
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = [tuple(x)[:5] for x in docs.collect()]
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    # the classifier drops what its scores reject, and these are the bad and toxic ones
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    scores = quality.classify(whole, spark.read.parquet(f"{folder}/labels.parquet")).where("keep").collect()
    assert Counter(x[0] for x in kept["quality_classifier"]) == Counter(x.doc_id for x in scores)
    ids = {x[0] for x in kept["quality_classifier"]}
    assert sum((i in ids) == (q == 1 and t == 0) for i, q, t in labels) >= 148
    # one of each group of near duplicates stays, and one of repeated rows
    before = kept["quality_classifier"]
    dropped = {g[0] for g in brute_groups([x[:2] for x in before]) if not g[3]}
    want = Counter({x: 1 if x[0] is not None and x[1] is not None and x[1].strip() else n for x, n in Counter(before).items() if x[0] not in dropped})
    assert Counter(kept["near_duplicates"]) == want
    # documents that hold 0.6 of an item's words in runs of four
    holds = [x for x in kept["near_duplicates"] if any(brute_tiles(plain(x[1]), plain(t), 4) >= 0.6 * len(plain(t)) for _, t in items if len(set(plain(t)) & set(plain(x[1]))) > 8)]
    assert len(holds) == 4 and Counter(kept["decontamination"]) == Counter(kept["near_duplicates"]) - Counter(holds)
    # as often as the schedule draws them
    clean = kept["decontamination"]
    drawn = Counter((x[1], x[4]) for x in brute_mix([(x[0], x[1], x[3]) for x in clean], 2048) if x[5] == 0)
    assert Counter((x[3] or "", x[0]) for x in kept["source_mix"]) == drawn
    assert set(kept["source_mix"]) <= set(clean)
    # all of them, equal texts together
    assert Counter(kept["shards"]) == Counter(kept["source_mix"])
    by_text = {}
    for x in docs.collect():
        by_text.setdefault(x.text, set()).add(x.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_run_is_all_stages_and_is_the_same_again(spark, tables):
    one, two = (Counter(map(tuple, corpus_pipeline.run(spark, tables[0]).collect())) for _ in range(2))
    assert one == two and sum(one.values()) > 50


def test_empty_tables(spark, tmp_path):
    for name, kind in (("documents", COLUMNS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert minhash.drop_near(spark.createDataFrame([], COLUMNS)).count() == 0


def test_stage_of_near_duplicates_verifies_few_pairs(spark, monkeypatch):
    """Texts that share a fifth are candidates by the hundred, but hardly any pair of them is read; no copy stays."""
    shared = prose(2000, 24)
    rows = [(i, f"{shared} {prose(2001 + i, 38)}") for i in range(300)]
    rows += [(300 + i, rows[i][1] + " more") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], COLUMNS)
    read, links = [], minhash._links
    monkeypatch.setattr(minhash, "_links", lambda pairs, *rest: read.append(pairs.count()) or links(pairs, *rest))
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(x.doc_id for x in kept) == list(range(300))
    assert 30 <= sum(read) < 1000
