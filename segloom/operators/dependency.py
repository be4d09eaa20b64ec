"""Dependency trees: closures, validity, features of subtrees, and segments under greedy or generous rules.

Edges are rows (doc_id, sent_id, idx, head, rel, form, tag); head 0 is the root above the sentence.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .flat import KEY


def dependants(edges: DataFrame) -> DataFrame:
    """(doc_id, sent_id, head, deps): the sorted dependants of every head."""
    return edges.groupBy(*KEY, "head").agg(F.sort_array(F.collect_list("idx")).alias("deps"))


def valid_trees(edges: DataFrame) -> DataFrame:
    """(doc_id, sent_id, n, valid): whether exactly one word hangs on the root."""
    return edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("head") == 0) == 1).alias("valid"))


class Subtrees:
    """The pairs of words and what is above them, and the trees' extents, of flat.Words.

    Words are numbered in their batch, and heads that are no words of their sentence after them. A word's walk to
    the root ends at a head that isn't positive, and in a cycle when all of it has been seen.
    """

    def __init__(self, w: flat.Words):
        n = len(w.idx)
        key = (w.sentence << 33) + w.idx
        if (key[1:] == key[:-1]).any():
            raise ValueError("a sentence has several words of one number")
        target = (w.sentence << 33) + w.head
        at = np.minimum(np.searchsorted(key, target), max(n - 1, 0))
        inside = w.head > 0
        known = inside & (key[at] == target) if n else inside
        others, place = np.unique(target[inside & ~known], return_inverse=True)
        up = np.full(n + len(others), -1)
        up[:n][known] = at[known]
        up[:n][inside & ~known] = n + place
        self.n, self.up = n, up
        self.idx, self.sentence = np.r_[w.idx, others & ((1 << 33) - 1)], np.r_[w.sentence, others >> 33]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(above, inside) in parts, each word above itself."""
        end = self.up
        for _ in range(int(self.n).bit_length() + 1):
            end = np.where(end >= 0, end[end], -1)
        begin = np.flatnonzero(self.idx[: self.n] > 0)
        turning = end[begin] >= 0
        inside = above = begin[~turning]
        while len(inside):
            yield above, inside
            above = self.up[above]
            inside, above = inside[above >= 0], above[above >= 0]
        for word in begin[turning].tolist():
            seen: dict[int, None] = {}
            at = word
            while at >= 0 and at not in seen:
                seen[at] = None
                at = int(self.up[at])
            yield np.array(list(seen)), np.full(len(seen), word)

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tops, where each top's words begin, the words in order of them)."""
        parts = list(self.pairs())
        above, inside = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
        inside = inside[order := np.argsort(above * max(self.n, 1) + inside)]
        tops, begin = np.unique(above[order], return_index=True)
        return tops, begin, inside


def closure(edges: DataFrame) -> DataFrame:
    """(doc_id, sent_id, idx, inside) for every word inside of idx's subtree, itself included. A cycle ends a walk when all of it has been seen."""
    return closure_in(flat.grouped(edges, "head"), flat.rows)


def closure_in(source: DataFrame, read: Callable) -> DataFrame:
    """closure() of the sentences that read finds in source."""

    def work(w: flat.Words) -> Iterator[list]:
        trees = Subtrees(w)
        for above, inside in trees.pairs():
            s = trees.sentence[inside]
            yield [flat.of(w.doc, s), flat.of(w.sent, s), trees.idx[above], w.idx[inside]]

    return flat.over(source, read, work, "doc_id long, sent_id int, idx int, inside int")


def subtree_spans(edges: DataFrame) -> DataFrame:
    """(doc_id, sent_id, idx, first, last, size, text): extent and words of every subtree."""
    return subtree_spans_in(flat.grouped(edges, "head", "form"), flat.rows)


def subtree_spans_in(source: DataFrame, read: Callable) -> DataFrame:
    """subtree_spans() of the sentences that read finds in source."""

    def work(w: flat.Words) -> Iterator[list]:
        trees = Subtrees(w)
        tops, begin, inside = trees.sorted()
        if not len(tops):
            return
        end = np.r_[begin[1:], len(inside)]
        s = trees.sentence[tops]
        if None in w.form:  # nulls are left out
            texts = [" ".join(f for f in w.forms[inside[a:b]] if f is not None) for a, b in zip(begin.tolist(), end.tolist())]
        else:
            words = w.forms[inside].tolist()
            texts = [" ".join(words[a:b]) for a, b in zip(begin.tolist(), end.tolist())]
        yield [flat.of(w.doc, s), flat.of(w.sent, s), trees.idx[tops], w.idx[inside[begin]], w.idx[inside[end - 1]], end - begin, texts]

    return flat.over(source, read, work, "doc_id long, sent_id int, idx int, first int, last int, size long, text string")


NONE = "[NONE]"


def features(edges: DataFrame) -> DataFrame:
    """One row for every subtree with its categorical features, length and punctuation count, and its words' names.

    What isn't there is [NONE]. Words to the left of the sentence's first or the right of its last are missing.
    """
    return features_in(flat.grouped(edges, "head", "rel", "form", "tag"), flat.rows)


def features_in(source: DataFrame, read: Callable) -> DataFrame:
    """features() of the sentences that read finds in source."""
    names = ["rel", "head_word", "head_pos", "this_word", "this_pos", "first_word", "last_word", "left_word", "right_word"]
    ddl = "doc_id long, sent_id int, idx int, " + ", ".join(f"{c} string" for c in names) + ", length_abs long, punct_count long, words array<string>"
    joined = [["rel", "head_pos", "this_pos"], ["rel", "head_pos"], ["rel", "this_pos"], ["head_pos", "this_pos"]]

    def work(w: flat.Words) -> Iterator[list]:
        trees = Subtrees(w)
        tops, begin, inside = trees.sorted()
        end = np.r_[begin[1:], len(inside)]
        begin, end, tops = begin[own := tops < trees.n], end[own], tops[own]
        if not len(tops):
            return
        s, n = trees.sentence[tops], trees.n
        key = (w.sentence << 33) + w.idx

        def at(idx: np.ndarray) -> np.ndarray:
            """The words of these numbers in the tops' sentences, n if there is none."""
            target = (s << 33) + idx
            place = np.minimum(np.searchsorted(key, target), n - 1)
            return np.where(key[place] == target, place, n)

        listed = lambda column, places: column[places].tolist()
        forms, tags, rels = (np.empty(n + 1, object) for _ in range(3))
        forms[:n], tags[:n], rels[:n] = w.form, w.tag, w.rel
        this_pos, rel = listed(tags, tops), listed(rels, tops)
        forms[n] = tags[n] = NONE
        head = at(w.head[tops])
        filled = lambda values: [NONE if v is None else v for v in values]
        head_pos = filled(listed(tags, head))
        first, last = inside[begin], inside[end - 1]
        stop = np.array([t in ("$.", "$,") for t in w.tag], np.int64)[inside]
        # each subtree's different words in order: their ranks among the batch's
        names, rank = np.unique(np.array([f"word_{f}" if f is not None else "" for f in w.form], object), return_inverse=True)
        number = np.repeat(np.arange(len(tops)), end - begin)
        taken = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)]) if not own.all() else slice(None)
        pairs = np.sort(number * len(names) + rank[inside[taken]])
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(len(tops) + 1) * len(names)), pa.int32()), pa.array(names, pa.string()).take(pa.array(pairs % len(names))))
        yield [
            flat.of(w.doc, s), flat.of(w.sent, s), w.idx[tops], rel, filled(listed(forms, head)), head_pos, listed(forms, tops), this_pos,
            listed(forms, first), listed(forms, last),
            filled(listed(forms, at(w.idx[first] - 1))), filled(listed(forms, at(w.idx[last] + 1))), end - begin, np.add.reduceat(stop, begin) if own.all() else [int(stop[a:b].sum()) for a, b in zip(begin, end)], lists,
        ]

    return flat.over(source, read, work, ddl).select(*KEY, "idx", *names[:5], *(F.concat_ws("+", *c).alias("+".join(c)) for c in joined), *names[5:], "length_abs", "punct_count", "words")


class Segment:
    """A named stretch: leaves are (position, word or Segment)."""

    def __init__(self, name: str, leaves: list | None = None):
        self.name, self.leaves = name, leaves or []

    def end(self) -> int:
        return max((p if not isinstance(x, Segment) or not x.leaves else x.end()) for p, x in self.leaves) if self.leaves else -1

    def insert(self, leaf: tuple) -> None:
        """In order of position; into a segment before that reaches over it."""
        at = bisect_left(self.leaves, leaf[0], key=lambda x: x[0])
        if at and isinstance(self.leaves[at - 1][1], Segment) and self.leaves[at - 1][1].end() > leaf[0]:
            self.leaves[at - 1][1].insert(leaf)
        else:
            self.leaves.insert(at, leaf)

    def text(self) -> str:
        return f"({self.name} " + "".join((x.text() if isinstance(x, Segment) else str(x)) + " " for _, x in self.leaves) + ")"


def _islands(leaves: list) -> list[list]:
    runs: list[list] = []
    end = None
    for place, leaf in leaves:
        if end is None or place != end + 1:
            runs.append([])
        runs[-1].append((place, leaf))
        end = leaf.end() if isinstance(leaf, Segment) and leaf.leaves else place
    return runs


def _absorb(row: list) -> list:
    """Segments take in what lies between their first and last leaf."""
    out: list = []
    at = 0
    while at < len(row):
        start, leaf = row[at]
        at += 1
        if isinstance(leaf, Segment):
            while out and (out[-1][1].end() if isinstance(out[-1][1], Segment) else out[-1][0]) > start:
                leaf.insert(out.pop())
            end, taken = leaf.end(), []
            while at < len(row) and row[at][0] < end:
                taken.append(row[at])
                if isinstance(row[at][1], Segment):
                    end = max(end, row[at][1].end())
                at += 1
            if taken:
                leaf.leaves = _absorb(sorted([*leaf.leaves, *taken], key=lambda x: x[0]))
        out.append((start, leaf))
    return out


def segment_sentence(words: dict[int, str], heads: dict[int, int], labels: dict[int, str | None], strategy: str = "greedy") -> list:
    """Leaves and segments of a sentence: a labelled word begins a segment with its subtree.

    greedy: only the run of neighbours that holds the word stays in it, and other leaves move to the level
    above; generous: it also takes in the words in between.
    """
    below: dict[int, list[int]] = {}
    for i in sorted(heads):
        below.setdefault(heads[i], []).append(i)

    def walk(start: list[int]) -> list:
        todo, out, seen = start[::-1], [], set()
        while todo:
            at = todo.pop()
            if at in seen:
                continue
            seen.add(at)
            deps = below.get(at, [])
            if labels.get(at) is None:
                if at:
                    out.append((at, words[at]))
                todo += reversed(deps)
                continue
            made = Segment(labels[at], walk(deps))
            if at:
                made.insert((at, words[at]))
            if strategy == "greedy" and at:
                runs = _islands(made.leaves)
                made.leaves = [x for r in runs if any(p == at for p, _ in r) for x in r]
                out += [x for r in runs if not any(p == at for p, _ in r) for x in r]
            out.append((made.leaves[0][0] if made.leaves else -1, made))
        out.sort(key=lambda x: x[0])
        return _absorb(out) if strategy == "generous" else out

    return walk([0])


def default_label(idx: int, rel: str, child_tags: list[str]) -> str | None:
    """TOP words begin a sentence segment; a word with a conjunction below begins SUB, with a relative pronoun ARR."""
    if rel in ("TOP", "ROOT"):
        return "HS"
    return next(({"KOUS": "SUB", "PRELS": "ARR"}[t] for t in child_tags if t in ("KOUS", "PRELS")), None)


def segments(edges: DataFrame, strategy: str = "greedy", decide: Callable = default_label) -> DataFrame:
    """(doc_id, sent_id, text): bracketed segments of every sentence.

    A sentence of no or several roots is one HS of all its words. All segments of a sentence are kept, those
    that others were moved out of too.
    """
    return segments_in(flat.grouped(edges, "head", "rel", "form", "tag"), flat.rows, strategy, decide)


def segments_in(source: DataFrame, read: Callable, strategy: str = "greedy", decide: Callable = default_label) -> DataFrame:
    """segments() of the sentences that read finds in source."""

    def one(idx: list[int], head: list[int], form: list, rel: list, tag: list) -> str:
        words = dict(zip(idx, form))
        if head.count(0) != 1:
            return Segment("HS", sorted(words.items())).text()
        tags: dict[int, list] = {}
        for h, t in zip(head, tag):
            tags.setdefault(h, []).append(t)
        labels = {i: decide(i, r, tags.get(i, ())) for i, r in zip(idx, rel)}
        found = segment_sentence(words, dict(zip(idx, head)), labels, strategy)
        return " ".join(x.text() if isinstance(x, Segment) else str(x) for _, x in found)

    def work(w: flat.Words) -> Iterator[list]:
        idx, head = w.idx.tolist(), w.head.tolist()
        cuts = [slice(a, a + n) for a, n in zip(w.base.tolist(), w.size.tolist())]
        yield [w.doc, w.sent, [one(idx[c], head[c], w.form[c], w.rel[c], w.tag[c]) for c in cuts]]

    return flat.over(source, read, work, "doc_id long, sent_id int, text string")


def assemble(sentences: DataFrame) -> DataFrame:
    """(doc_id, text): the bracketed texts of segments() in order of their sentences, under one TEXT for each document.

    Sentences of null text are left out; a document without any other has no row.
    """
    ordered = F.array_sort(F.collect_list(F.struct("sent_id", "text")))
    rows = sentences.where("text is not null").groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    return rows.select("doc_id", F.concat(F.lit("(TEXT "), "text", F.lit(" )")).alias("text"))
