"""Segmentation and agreement operators on small cases, and queries against their SQL."""

import os
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from segloom.functions import matching, morphology
from segloom.operators import agreement, alignment, cascade, dependency, edu, grammar, labels, learning, rules, spans
from segloom.plans import annotate
from segloom.plans import queries as plans
from segloom.sources import brackets, conll, lexicon
from segloom.streaming import files

SF = "/root/testdata/sf0.001"
#: Queries whose SQL takes long or whose Python part does; the driver compares them too.
SLOW = {"dependency_closure", "macro_micro_f1", "f1_tp_fp"}


def words(text):
    out = []
    for line in text.split("|"):
        idx, form, lemma, pos, feat, head, rel = line.split()
        out.append({"idx": int(idx), "form": form, "lemma": lemma, "pos": pos, "feat": morphology.parse_features(feat.replace("/", "|")), "phead": int(head), "pdeprel": rel})
    return out


def types(node):
    return [(c.feats.get("type"), [t["form"] for t in c.tokens()]) for c in node.children]


SENTENCE = "1 Sie sie PPER nom/sg 2 SB|2 weiß wissen VVFIN sg 0 --|3 , -- $, _ 2 --|4 {} {} KOUS _ 6 CP|5 er er PPER nom 6 SB|6 kommt kommen VVFIN sg 2 OC|7 . -- $. _ 6 --"


def test_complements_stay_and_other_subordinates_stand_alone():
    assert [t for t, _ in types(edu.segment(words(SENTENCE.format("dass", "dass"))))] == ["MainCl"]
    assert types(edu.segment(words(SENTENCE.format("weil", "weil")))) == [("MainCl", ["Sie", "weiß", ","]), ("SubCl", ["weil", "er", "kommt", "."])]


def test_relative_clause_inside_is_embedded():
    text = "1 Der der ART nom 2 NK|2 Mann Mann NN nom 8 SB|3 , -- $, _ 2 --|4 der der PRELS nom 6 SB|5 dort dort ADV _ 6 MO|6 wohnt wohnen VVFIN sg 2 RC|7 , -- $, _ 2 --|8 schläft schlafen VVFIN sg 0 --|9 . -- $. _ 8 --"
    rows = edu.rows(words(text))
    assert [r for r in rows if r["type"] == "RelCl"] and sum(r["n_tokens"] for r in rows if r["depth"] == 1) >= 9


@pytest.mark.parametrize("seed", range(20))
def test_cascade_keeps_the_tokens(seed):
    r = random.Random(seed)
    tags = "ART NN ADJA PPER VVFIN VAFIN VVPP VVINF KOUS KOUI KON PRELS PWAV APPR ADV ADJD $, $. PTKVZ PTKZU NE PROAV".split()
    sent = [{"idx": k + 1, "form": "um" if r.random() < 0.1 else f"w{k}", "lemma": r.choice(["um", "zu", "genug", "dass", "sagen", "x"]), "pos": r.choice(tags), "feat": {}, "phead": r.randint(0, 9), "pdeprel": "--"} for k in range(r.randint(1, 60))]
    tree = grammar.clause_tree(sent)
    assert [t["idx"] for t in tree.tokens()] == list(range(1, len(sent) + 1))
    assert sorted(t["idx"] for t in edu.segment(sent).tokens()) == list(range(1, len(sent) + 1))


def test_group_limits_the_node_and_not_the_match():
    made = cascade.Cascade([cascade.Rule(1, "X", "A [[ B ]] C"), cascade.Rule(2, "Y", "C A")]).parse([{"pos": p, "form": p} for p in "ABCABC"])
    assert [n.label if isinstance(n, cascade.Node) else n["pos"] for n in made.children] == ["A", "X", "Y", "X", "C"]


def test_rule_files():
    rules_, macros = cascade.read_rules(["# comment", "V=VVFIN VAFIN", "2\tVP\t{@V} NC  # verb", "1\tNC\tART? NN"])
    made = cascade.Cascade(rules_, macros).parse([{"pos": p} for p in ("VAFIN", "ART", "NN")])
    assert made.children[0].label == "VP" and made.children[0].children[1].label == "NC"
    with pytest.raises(ValueError):
        cascade.read_rules(["A=B", "A=C"])


def test_long_sentences_take_polynomial_time():
    tags = (["NN", "$,", "NE", "KON"] * 200 + ["KOUS"] + ["NN", "KON", "NE"] * 200)[:1400]
    sent = [{"idx": k + 1, "form": "x", "lemma": "x", "pos": t, "feat": {}, "phead": 0, "pdeprel": "--"} for k, t in enumerate(tags)]
    assert len(list(grammar.clause_tree(sent).tokens())) == len(sent)


def test_features():
    assert morphology.parse_features("Nom|sg|neut|3") == {"case": "nom", "num": "sg", "gender": "neut", "pers": "3"}
    assert morphology.parse_features("pos|case=Gen") == {"pos": "True", "case": "Gen"} and morphology.parse_features("_") == {}
    assert not morphology.unifies(morphology.feature_bits({"num": "sg"}), morphology.feature_bits({"num": "pl"}))
    assert morphology.feature_bits({}) == 511


def test_lexicon():
    table = lexicon.verb_table(lexicon.COMPLEMENT_VERBS)
    dep = lambda lemma, pos="ADV", rel="MO": {"lemma": lemma, "pos": pos, "pdeprel": rel}
    assert lexicon.verb_matches(table, "sagen", []) and not lexicon.verb_matches(table, "zeigen", [dep("es", rel="SB")])
    assert lexicon.verb_matches(table, "zeigen", [dep("es", rel="SB"), dep("sich", rel="OA")])
    assert lexicon.verb_matches(table, "nehmen", [dep("wahr", "PTKVZ")]) and lexicon.verb_matches(table, "nehmen", [dep("an", "PTKVZ")]) and not lexicon.verb_matches(table, "nehmen", [])
    assert lexicon.verb_matches(table, "annehmen", []) and lexicon.finite_verbs()["hättest"] == "A" and lexicon.finite_verbs()["ging"] == "V"
    assert lexicon.read_typed_verbs(["bin\tA\n", "\n"]) == {"bin": "A"} and lexicon.read_skip_rules(["# x", "a@b # y"]) == ["a@b"]


# trees and agreement

TREES = {
    1: ("(P u v w )", [3], [(0, 3, "P")]), 2: ("(P u (Q v (R w ) ) )", [1, 1, 1], [(0, 3, "P"), (1, 2, "Q"), (2, 1, "R")]),
    3: ("(P (Q u ) (R v ) w )", [1, 1, 1], [(0, 1, "Q"), (0, 3, "P"), (1, 1, "R")]), 4: ("(P u (Q v (R w ) x ) y )", [1] * 5, [(0, 5, "P"), (1, 3, "Q"), (2, 1, "R")]),
}


@pytest.fixture(scope="module")
def nodes(spark):
    return brackets.nodes(spark.createDataFrame([(k, t) for k, (t, _, _) in TREES.items()], "tree_id long, text string")).cache()


def test_bracket_round_trip(nodes):
    assert {r.tree_id: r.text for r in brackets.write(nodes).collect()} == {k: t for k, (t, _, _) in TREES.items()}
    rows = {(r.tree_id, r.node_id): r for r in nodes.collect()}
    assert rows[4, 5].parent_id == 4 and rows[4, 5].token == "w" and rows[4, 4].label == "R" and rows[4, 6].ord == 2
    assert {(r.tree_id, r.node_id): r.height for r in brackets.heights(nodes).collect()}[4, 0] == 4


def test_spans_and_masses(nodes):
    inner = nodes.where("not is_leaf").select(F.col("tree_id").alias("doc_id"), "start", (F.col("end") - F.col("start")).alias("len"), "label", "depth")
    for k, (_, masses, found) in TREES.items():
        one = inner.where(f"doc_id = {k}")
        assert sorted((r.start, r.len, r.label) for r in spans.typed_spans(one).collect()) == found
        assert [r.mass for r in spans.untyped_masses(one).orderBy("seg").collect()] == masses
        assert [r.start for r in spans.masses_to_spans(spans.untyped_masses(one)).orderBy("seg").collect()] == [sum(masses[:n]) for n in range(len(masses))]


def test_tree_files(spark):
    lines = ["(A x", "(B y \\( ) )", "", 'No parse for : "p q"', "(C z )"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    assert [r.text for r in brackets.tree_lines(df).orderBy("tree_id").collect()] == ["(A x (B y -OP- ) )", "(TOP p q)", "(C z )"]
    assert spark.range(1).select(brackets.pieces(F.lit("(A x (B y ) ) (C z )"))).first()[0] == ["(A x (B y ) )", "(C z )"]


def test_segment_files(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, "(HS Wir gehen , (SUB wenn es regnet . ) )"), (1, 1, " "), (1, 2, "(A (B x ) ) y (C )"), (2, 0, "ohne")], "doc_id long, line_no int, line string")
    got = brackets.segment_lines(lines).orderBy("doc_id", "seg").collect()
    assert [tuple(r) for r in got] == [(1, 0, "HS", 0, 7), (1, 1, "SUB", 3, 4), (1, 2, "A", 7, 1), (1, 4, "C", 9, 0)]
    bad = spark.createDataFrame([(1, 0, "(HS a"), (1, 1, ") (HS b"), (1, 2, "(HS c )")], "doc_id long, line_no int, line string")
    with pytest.raises(Exception, match="balance"):
        brackets.segment_lines(bad).collect()
    assert [r.label for r in brackets.segment_lines(bad, "PERMISSIVE").collect()] == ["HS"]
    assert brackets.segment_lines(lines.limit(0)).count() == 0
    (tmp_path / "a.tree").write_text("(TEXT\n (HS a b )\n (HS c ) )\n")
    trees = brackets.nodes(brackets.tree_files(spark, str(tmp_path)))
    assert {(r.tree_id, r.label, r.start, r.end) for r in trees.where("not is_leaf").collect()} == {("a", "TEXT", 0, 3), ("a", "HS", 0, 2), ("a", "HS", 2, 3)}


def test_rows_of_corrupt_lines_are_left_out(spark):
    lines = [(1, 0, "\t".join(["1", "er", "_", "er", "_", "PPER", "_", "_", "-1", "2", "_", "SB", "_", "_"])), (1, 1, "broken"), (1, 2, "\t".join(["x"] * 14))]
    read = conll.rows(spark.createDataFrame(lines, "doc_id long, line_no int, line string"))
    assert read.count() == 3
    assert [r.n_tokens for r in rules.segments(read).where("label = 'SDS'").collect()] == [1]


def test_kappa_of_the_textbook(spark):
    pairs = 46 * [(0, 0)] + 6 * [(1, 0)] + 32 * [(1, 1)] + 6 * [(1, 2)] + 10 * [(2, 2)]
    r = agreement.kappa(spark.createDataFrame([(1, str(a), str(b)) for a, b in pairs], "doc_id int, gold string, pred string"), ["doc_id"]).first()
    assert (round(r.kappa, 3), round(r.expected, 3), round(r.accuracy, 3)) == (0.801, 0.396, 0.88)


def segs(spark, masses):
    rows, at = [(1, 0, sum(masses), "T", 0)], 0
    for m in masses:
        rows.append((1, at, m, "S", 1))
        at += m
    return spark.createDataFrame(rows, "doc_id long, start int, len int, label string, depth int")


@pytest.mark.parametrize("seed", range(4))
def test_windows_equal_brute_force(spark, seed):
    r = random.Random(seed)
    a = [r.randint(1, 5) for _ in range(8)]
    b = a[:]
    if seed:
        b = [x for m in a for x in ([m] if m < 3 or r.random() < 0.5 else [1, m - 1])]
    got = agreement.windows(segs(spark, a), segs(spark, b)).first()
    x, y = ([k for k, m in enumerate(s) for _ in range(m)] for s in (a, b))
    k = max(2, int(len(y) / len(b) / 2 + 0.5))
    places = range(len(x) - k)
    assert got.pk == pytest.approx(sum((x[i] == x[i + k]) != (y[i] == y[i + k]) for i in places) / len(places))
    assert got.window_diff == pytest.approx(sum(x[i + k] - x[i] != y[i + k] - y[i] for i in places) / len(places))


def test_boundaries_and_units():
    assert agreement.boundary_similarity([3, 7], [3, 7])[0] == 0 and agreement.boundary_similarity([3], [4])[:2] == (0.5, 1)
    assert agreement.boundary_similarity([3, 9], [9])[:2] == (1.0, 2)
    same = agreement.alpha_terms([(0, 3, "a"), (3, 4, "b")], [(0, 3, "a"), (3, 4, "b")], 10)
    assert all(o == 0 and e > 0 for o, e in same)
    (o, e), = agreement.alpha_terms([(0, 4, None)], [(2, 4, None)], 10)
    assert o == pytest.approx(2 * (4 + 4) / 200) and 0 < e


def test_alignment():
    assert alignment.align(list("AGTACGCA"), list("TCGC")) == [[], [], [0], [], [1], [2], [3], []] == alignment.align_linear(list("AGTACGCA"), list("TCGC"))
    assert alignment.align([], list("ab"), keep=True) == [] and alignment.align(list("ab"), [], keep=True) == [[], []]
    split = lambda x: x.split()
    assert alignment.align_trees(split("(S ab c )"), split("(S a bc )")) == (split("(S a b c )"), split("(S a b c )"))
    assert alignment.align_trees(split("(S (S a b ) )"), split("(S a b )"), True)[1] == ["(S", "tok", "tok", ")"]
    for other in ("(S a )", "(S a c )"):
        with pytest.raises(alignment.Misaligned):
            alignment.align_trees(split("(S a b c )"), split(other))


@pytest.mark.parametrize("seed", range(10))
def test_alignment_is_optimal_and_monotone(seed):
    r = random.Random(seed)
    a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))

    def best(i, j):
        if not i or not j:
            return -2 * (i + j)
        return max(best(i - 1, j - 1) + (2 if a[i - 1] == b[j - 1] else -1), best(i - 1, j) - 2, best(i, j - 1) - 2)

    for how in (alignment.align, alignment.align_linear):
        found = how(a, b)
        flat = [x for y in found for x in y]
        assert flat == sorted(set(flat))
        score = sum((2 if a[i] == b[y[0]] else -1) if y else -2 for i, y in enumerate(found)) - 2 * (len(b) - len(flat))
        assert score == best(len(a), len(b))


def test_greedy_and_generous_segments():
    heads = {1: 4, 2: 3, 3: 0, 4: 3, 5: 4}
    names = {k: f"w{k}" for k in heads}
    text = lambda found: " ".join(x.text() if isinstance(x, dependency.Segment) else x for _, x in found)
    assert text(dependency.segment_sentence(names, heads, {4: "SUB"})) == "w1 w2 w3 (SUB w4 w5 )"
    assert text(dependency.segment_sentence(names, heads, {4: "SUB"}, "generous")) == "(SUB w1 w2 w3 w4 w5 )"


def test_closure_of_cycles_ends(spark):
    edges = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 2, 1), (1, 0, 3, 0)], "doc_id long, sent_id int, idx int, head int")
    assert {(r.idx, r.inside) for r in dependency.closure(edges).collect()} == {(1, 1), (2, 1), (1, 2), (2, 2), (3, 3)}


def test_label_join_prefers_exact_spans(spark):
    toks = spark.createDataFrame([(1, k, f) for k, f in enumerate(["a", "b", ",", "c"])], "doc_id long, tok_no int, form string")
    nodes_ = spark.createDataFrame([(1, 0, 2), (1, 3, 1), (1, 0, 4)], "doc_id long, start int, len int")
    segments = spark.createDataFrame([(1, 0, 3, "HS")], "doc_id long, start int, len int, label string")
    got = {(r.start, r.len): r.seg_label for r in labels.label_nodes(nodes_, segments, toks).collect()}
    assert got == {(0, 2): "HS", (3, 1): None, (0, 4): None}


def test_conll_reader_and_writer(spark, tmp_path):
    row = lambda i, form="x": "\t".join([str(i), form, "_", form, "_", "NN", "_", "nom|sg", "-1", str(i - 1), "_", "--", "_", "_"])
    (tmp_path / "t.parsed.conll").write_text("\n".join([row(1), row(2), row(1), row(2), "", row(1), row(2), row(2), "bad line"]))
    got = conll.rows(conll.lines(spark, str(tmp_path), ".parsed.conll"))
    assert [r.sent_id for r in got.where("corrupt is null").orderBy("line_no").collect()] == [0, 0, 1, 1, 2, 2, 2]
    assert [r.line_no for r in got.orderBy("line_no").collect()] == [0, 1, 2, 3, 5, 6, 7, 8]
    assert got.where("corrupt is not null").count() == 1 and got.first().doc_id == "t" and got.first().feats == {"case": "nom", "num": "sg"}
    with pytest.raises(Exception):
        conll.rows(conll.lines(spark, str(tmp_path)), "FAILFAST").collect()
    text = {r.sent_id: r.text for r in conll.write(got.where("corrupt is null")).collect()}
    assert text[0].split("\n")[0].split("\t")[7] == "nom|sg" and text[0].endswith("\n\n")
    assert conll.to_dependency(got).where("rel = 'ROOT'").count() == 3


def test_matching(spark):
    df = spark.createDataFrame([(["the", "cat", "sat"],), (["the"],), (["a", "cat"],)], "w array<string>")
    assert [r[0] for r in df.select(matching.starts_with(F.col("w"), [["the", "a"], ["cat"]])).collect()] == [True, True, True]
    assert [r[0] for r in df.select(matching.starts_with(F.col("w"), [["cat"], ["sat"]], reverse=True)).collect()] == [True, False, False]


def test_learning(spark):
    rows = spark.createDataFrame([(k % 12, [f"f={k % 3}", "all"], ["A", "B", "C"][k % 3], float(k % 5)) for k in range(240)], "doc_id long, names array<string>, label string, n double")
    got = learning.cross_validate(rows, ["n"], k=3)
    assert got.count() == 240 and got.where("gold = pred").count() > 230
    m = learning.macro_micro(got).first()
    assert m.macro_f1 > 0.95 and m.micro_f1 > 0.95
    sizes = [r["count"] for r in learning.folds(spark.range(13).withColumnRenamed("id", "doc_id")).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [2, 2, 2] + [1] * 7
    assert {r.name for r in learning.varying(rows).collect()} == {"f=0", "f=1", "f=2"}
    with pytest.raises(RuntimeError):
        learning.load("/nowhere")


def test_streamed_sentences(spark, tmp_path):
    row = lambda i, form, pos, head: "\t".join([str(i), form, "_", form, "_", pos, "_", "_", "-1", str(head), "_", "--", "_", "_"])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.conll").write_text("\n".join([row(1, "er", "PPER", 2), row(2, "kommt", "VVFIN", 0), row(3, ".", "$.", 2), "", row(1, "gut", "ADJD", 0)]))
    stream = files.segment_stream(spark, str(tmp_path / "in"))
    q = stream.writeStream.format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.n_tokens for r in spark.table("segs").where("label = 'SDS'").collect()} == {3, 1}


# queries


@pytest.mark.parametrize("name", sorted({*plans.ORACLES, *plans.SMALL} - SLOW))
def test_query_equals_sql(spark, name):
    got = driver.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    cur = con.execute((plans.ORACLES | plans.SMALL)[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    shown = lambda v: None if v is None else f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)
    want = sorted((tuple(shown(v) for v in r) for r in cur.fetchall()), key=str)
    assert sorted((tuple(shown(r[c]) for c in names) for r in got.collect()), key=str) == want


def test_segments_cover_all_tokens(spark):
    got = plans.QUERIES["discourse_segments"](spark, SF)
    n = plans.toks(spark, SF).count()
    assert got.where("depth = 0").agg(F.sum("n_tokens")).first()[0] == n


def test_greedy_keeps_all_words(spark):
    count = lambda column: {r.w: r["count"] for r in column.where("w <> '' and w not rlike '[()]'").groupBy("w").count().collect()}
    want = count(plans.toks(spark, SF).select(F.col("form").alias("w")))
    for name in ("segments_greedy", "segments_generous"):
        assert count(plans.QUERIES[name](spark, SF).select(F.explode(F.split("text", " ")).alias("w"))) == want


# within one row: no shuffle, and the same as over grouped words

#: Queries whose words don't leave their document's row, and those that shuffle a few counts or whole sentences only.
LOCAL = ["dependency_closure", "subtree_spans", "subtree_features", "segments_greedy", "segments_generous", "clauses", "discourse_segments", "segment_text", "label_join_subtrees"]
SUMMED = {"text_assembly": 1, "f1_tp_fp": 1, "class_weights": 2, "macro_micro_f1": 3}


@pytest.mark.parametrize("name", LOCAL + sorted(SUMMED))
def test_words_stay_in_their_row(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") + plan.count("Window") + plan.count("Aggregate") <= SUMMED.get(name, 0), plan


def test_reader_equals_tokens(spark):
    odd = spark.createDataFrame([(1, "Der Ärger, 12 ٣ ünd (\n\n \t\nWeil. İst Kon :\"x y"), (2, None), (3, ""), (4, "\n . \n"), (None, "a b")], "doc_id long, text string")
    for docs in (odd, plans.documents(spark, SF)):
        got = [(d, s, a + k, w.form[b + k], w.tag[b + k], w.rel[b + k], int(w.idx[b + k]), int(w.head[b + k])) for batch in annotate.plain(docs).toArrow().to_batches() for w in annotate.read(batch) for d, s, a, b, n in zip(w.doc, w.sent, w.start.tolist(), w.base.tolist(), w.size.tolist()) for k in range(n)]
        want = [(r.doc_id, r.sent_id, r.tok_no, r.form, r.tag, r.rel, r.idx, r["head"]) for r in annotate.tokens(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        t = annotate.tokens(docs)
        for nodes, side in ((annotate.gold(t), annotate.gold_nodes), (annotate.pred(t), annotate.pred_nodes)):
            own = []
            for batch in annotate.plain(docs).toArrow().to_batches():
                for w in annotate.read(batch):
                    n = side(w)
                    own += [(w.doc[w.first[d]], *x) for d, *x in zip(n.doc.tolist(), n.start.tolist(), n.len.tolist(), n.label.tolist(), n.depth.tolist())]
            assert sorted(own, key=str) == sorted((tuple(r) for r in nodes.collect()), key=str)


def test_subtrees_of_odd_heads(spark):
    edges = [(1, 0, 1, 0, "a"), (1, 0, 2, 9, "b"), (1, 0, 3, 2, "c"), (1, 1, 1, 2, "d"), (1, 1, 2, 1, "e"), (1, 1, 3, None, None), (1, 1, 4, 3, "f")]
    df = spark.createDataFrame([(*e, "NK", "NN") for e in edges], "doc_id long, sent_id int, idx int, head int, form string, rel string, tag string")
    got = {(r.sent_id, r.idx): (r["first"], r["last"], r["size"], r.text) for r in dependency.subtree_spans(df).collect()}
    assert got == {
        (0, 1): (1, 1, 1, "a"), (0, 2): (2, 3, 2, "b c"), (0, 3): (3, 3, 1, "c"), (0, 9): (2, 3, 2, "b c"), (1, 1): (1, 2, 2, "d e"), (1, 2): (1, 2, 2, "d e"), (1, 3): (3, 4, 2, "f"), (1, 4): (4, 4, 1, "f"),
    }
    found = {(r.sent_id, r.idx): r for r in dependency.features(df).collect()}
    assert len(found) == 7 and found[0, 2].head_word == "[NONE]" and found[0, 3]["rel+head_pos+this_pos"] == "NK+NN+NN" and found[0, 2].words == ["word_b", "word_c"] and found[0, 2].left_word == "a"
    assert dependency.closure(df.limit(0)).count() == 0


def test_long_sentences_take_time_in_proportion(spark):
    n = 30_000
    edges = spark.range(1, n + 1).selectExpr("1L doc_id", "0 sent_id", "cast(id as int) idx", "cast(id div 2 as int) head", "'w' form", "'NK' rel", "'NN' tag")
    began = time.perf_counter()
    assert dependency.closure(edges).count() == sum(k.bit_length() for k in range(1, n + 1))
    assert dependency.segments(edges).first().text.count("w") == n
    assert time.perf_counter() - began < 20  # steps in proportion to the square took minutes


def test_rules_are_passed_over_only_where_they_cannot_match():
    r = random.Random(1)
    for c in (grammar.chunker(), grammar.clauses()):
        letters = [c.alphabet[x] for x in list(c.alphabet._codes)]
        for _ in range(300):
            tags = "".join(r.choice(letters) for _ in range(r.randint(1, 12)))
            for rule in c.rules:
                assert not rule.regex.search(tags) or not any(map(set(tags).isdisjoint, rule.needs))
        assert sum(bool(rule.needs) for rule in c.rules) > 0.8 * len(c.rules)


@pytest.mark.parametrize("name", ["label_join_constituents", "constituent_features", "kappa", "accuracy", "alpha_unit", "parseval_f1", "pk_window_diff"])
def test_only_nodes_are_shuffled(spark, name):
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan, plan  # no row for each word
    if name in ("label_join_constituents", "constituent_features"):
        assert not any(x in plan for x in ("Join", "Window", "Aggregate")), plan


def test_features_of_long_expressions_are_computed_once(spark):
    plan = plans.QUERIES["morph_features"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1, plan  # one copy of the tag's expression, not one for each use of the line
    df = spark.createDataFrame([("Nom|sg|neut|3",), ("pos|case=Gen|case=dat",), (" _ | ",), (None,), ("",)], "f string")
    got = df.select(morphology.features_column(F.col("f")).alias("m"), morphology.text_bits(F.col("f")).alias("b")).collect()
    assert [r.m for r in got] == [{"case": "nom", "num": "sg", "gender": "neut", "pers": "3"}, {"pos": "True", "case": "dat"}, {}, {}, {}]
    assert [r.b for r in got] == [morphology.feature_bits(r.m) for r in got]


def test_svm_predictions_leave_folds_and_iterations_to_the_operator(spark, monkeypatch):
    called = []
    monkeypatch.setattr(learning, "cross_validate_counted", lambda rows, *args, **options: called.append((rows, args, options)))
    plans.QUERIES["svm_predictions"](spark, SF)
    (rows, args, options), = called
    assert (args, options) == ((["idx"],), {})
    t = plans.toks(spark, SF)
    want = learning.one_hot(t, ["rel", "tag"]).join(labels.owners(annotate.gold(t)), ["doc_id", "tok_no"]).select("doc_id", "names", "label", F.col("idx").cast("double"))
    count = lambda df: {tuple(map(str, r[:4])): r[4] for r in df.groupBy("doc_id", "names", "label", "idx").count().collect()}
    assert count(rows) == count(want)


def test_counted_predictions_are_those_of_each_row(spark):
    rows = spark.createDataFrame([(k % 6, [f"f={k % 3}"], ["A", "B"][k % 3 == 0], float(k % 2)) for k in range(60)], "doc_id long, names array<string>, label string, n double")
    counted = learning.cross_validate_counted(rows, ["n"], k=2, iterations=5).collect()
    assert sum(r.n for r in counted) == 60 and sum(r.n for r in counted if r.gold == r.pred) == 60
