"""How far two segmentations agree: confusions, kappa, brackets, windows, boundary edits, unitizing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import cut_points, lineage, mass_array, numbered


def confusions(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, start, len, gold, pred): labels of each span in both; null where one lacks it. Of nodes of one span the greatest label counts."""
    one = lambda nodes, name: nodes.groupBy("doc_id", "start", "len").agg(F.max("label").alias(name))
    return one(first, "gold").join(one(second, "pred"), ["doc_id", "start", "len"], "full")


def accuracy(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Share of pairs (gold, pred) that are equal, null being a category of its own."""
    return pairs.groupBy(*by).agg(F.avg(F.col("gold").eqNullSafe(F.col("pred")).cast("int")).alias("accuracy"))


def kappa(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, accuracy, expected, kappa) by Cohen; null counts as a category; kappa is null if chance alone would agree always."""
    counts = pairs.groupBy(*by, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("gold").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0)).alias("same"))
    side = lambda c: counts.groupBy(*by, F.coalesce(c, F.lit("∅")).alias("cat")).agg(F.sum("n").alias(c))
    both = side("gold").join(side("pred"), [*by, "cat"]).groupBy(*by).agg(F.sum(F.col("gold") * F.col("pred")).alias("both"))
    rows = sums.join(both, by, "left") if by else sums.crossJoin(both)
    rows = rows.withColumn("accuracy", F.col("same") / F.col("n")).withColumn("expected", F.coalesce("both", F.lit(0)) / (F.col("n") * F.col("n")))
    return rows.select(*by, "n", "accuracy", "expected", F.try_divide(F.col("accuracy") - F.col("expected"), 1 - F.col("expected")).alias("kappa"))


def confusion_report(pairs: DataFrame) -> DataFrame:
    """(pairs, n, matching, same, share, accuracy, expected, kappa) of three sets of pairs (gold, pred).

    They are all, those of spans that gold has, and those of spans that both have; share is how many of a set's spans
    both have. A null label is a span that isn't there. Without pairs there are no rows.
    """
    gold, pred = F.col("gold").isNotNull(), F.col("pred").isNotNull()
    sets = F.filter(F.array(F.lit("all"), F.when(gold, "gold"), F.when(gold & pred, "both")), lambda x: x.isNotNull())
    rows = pairs.withColumn("pairs", F.explode(sets))
    sums = rows.groupBy("pairs").agg(F.count_if(gold & pred).alias("matching"), F.count_if(F.col("gold") == F.col("pred")).alias("same"))
    found = kappa(rows, ["pairs"]).join(sums, "pairs")
    return found.select("pairs", "n", "matching", "same", (F.col("matching") / F.col("n")).alias("share"), "accuracy", "expected", "kappa")


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def brackets(nodes: DataFrame, labelled: bool) -> DataFrame:
    """Nodes that hold another node (flat ones don't count), as (doc_id, start, len, label)."""
    label = F.col("label") if labelled else F.lit("")
    return nodes.where("height > 2").select("doc_id", "start", "len", label.alias("label"))


def with_height(nodes: DataFrame) -> DataFrame:
    """Adds height: 2 for a node over leaves only, one more than its highest child else. A repeated node counts once."""
    rows = numbered(nodes.select("doc_id", "start", "len", "label", "depth").distinct())
    deep = lineage(rows, "doc_id", "node_id").groupBy("doc_id", F.col("up").alias("node_id")).agg(F.max("own").alias("deep"))
    return rows.join(deep, ["doc_id", "node_id"]).select("doc_id", "start", "len", "label", "depth", (F.col("deep") - F.col("depth") + 2).alias("height"))


def parseval(first: DataFrame, second: DataFrame, labelled: bool, by: list[str]) -> DataFrame:
    """(by, precision, recall, f1) of brackets, as shares of 1; by may be empty, for all documents together. A bracket counts if the other side has it at all; null without brackets."""
    a, b = brackets(first, labelled), brackets(second, labelled)
    key = ["doc_id", "start", "len", "label"]

    def share(of: DataFrame, among: DataFrame, name: str) -> DataFrame:
        marked = of.join(among.distinct().withColumn("hit", F.lit(1)), key, "left")
        return marked.groupBy(*by).agg(F.avg(F.coalesce("hit", F.lit(0))).alias(name))

    p, r = share(b, a, "precision"), share(a, b, "recall")
    rows = p.join(r, by, "full") if by else p.crossJoin(r)
    return rows.withColumn("f1", F.when(F.col("precision").isNotNull() & F.col("recall").isNotNull(), f1(F.col("precision"), F.col("recall"))))


def windows(first: DataFrame, second: DataFrame, reference: str = "second") -> DataFrame:
    """(doc_id, n, k, pk, window_diff) over each document's leaves.

    k is half the mean mass of the reference, at least 2. Both scores are null where no window fits. All is done
    in arrays of one row for each document, after one grouping of either side.
    """
    cuts = cut_points(first).withColumnRenamed("cuts", "a").join(cut_points(second).withColumnRenamed("cuts", "b"), "doc_id")
    ids = lambda c: F.flatten(F.transform(mass_array(F.col(c)), lambda m, k: F.array_repeat(k, m)))
    ref = "b" if reference == "second" else "a"
    rows = cuts.select("doc_id", ids("a").alias("a"), ids("b").alias("b"), F.array_max(ref).alias("n"), (F.size(ref) - 1).alias("segs"))
    rows = rows.withColumn("k", F.greatest(F.lit(2), F.floor((F.col("n") + F.col("segs")) / (2 * F.col("segs")))).cast("int"))
    fits = F.col("n") > F.col("k")
    starts = F.when(fits, F.sequence(F.lit(0), F.col("n") - F.col("k") - 1))
    apart = lambda c, i: F.get(c, i + F.col("k")) - F.get(c, i)
    pk = F.filter(starts, lambda i: (apart("a", i) == 0) != (apart("b", i) == 0))
    wd = F.filter(starts, lambda i: apart("a", i) != apart("b", i))
    share = lambda x: F.when(fits, F.size(x) / (F.col("n") - F.col("k")))
    return rows.select("doc_id", "n", "k", share(pk).alias("pk"), share(wd).alias("window_diff"))


def boundary_similarity(a: list[int], b: list[int], n_t: int = 2) -> tuple[float, int, int]:
    """(sum of edit weights, pairs counted, matches) between two lists of boundary places.

    A boundary in both is a match; one of each within n_t - 1 places is a transposition, weighing less the nearer
    it is; what is left are additions of weight 1.
    """
    both = set(a) & set(b)
    only_a, only_b = sorted(set(a) - both), sorted(set(b) - both)
    weight, moved = 0.0, 0
    for x in only_a[:]:
        near = [y for y in only_b if 0 < abs(y - x) < n_t]
        if near:
            y = min(near, key=lambda v: (abs(v - x), v))
            only_b.remove(y)
            only_a.remove(x)
            weight += abs(y - x) / n_t
            moved += 1
    added = len(only_a) + len(only_b)
    return added + weight, added + moved + len(both), len(both)


def boundary_pi(first: DataFrame, second: DataFrame) -> DataFrame:
    """(n_docs, similarity, chance, pi): agreement on boundaries beyond chance, pooled over documents.

    Observed agreement is the boundary similarity weighted by the pairs that it counts; chance is the squared
    share of possible boundaries that were placed. Null if chance leaves no room.
    """
    cuts = cut_points(first).withColumnRenamed("cuts", "a").join(cut_points(second).withColumnRenamed("cuts", "b"), "doc_id")
    inner = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 2, F.lit(0)))
    rows = cuts.select(inner("a").alias("a"), inner("b").alias("b"), (F.array_max("a") - 1).alias("room"))
    rows = rows.select("room", (F.size("a") + F.size("b")).alias("placed"), F.size(F.array_intersect("a", "b")).alias("both"), F.array_except("a", "b").alias("a"), F.array_except("b", "a").alias("b"))
    # with transpositions of one place, each boundary of the first in order takes its free neighbour, the left one first
    step = lambda acc, x: F.struct(
        (acc["moved"] + F.when(F.array_contains("b", x - 1) & (acc["taken"] != x - 1) | F.array_contains("b", x + 1), 1).otherwise(0)).alias("moved"),
        F.when(F.array_contains("b", x - 1) & (acc["taken"] != x - 1), x - 1).when(F.array_contains("b", x + 1), x + 1).otherwise(acc["taken"]).alias("taken"),
    )
    start = F.struct(F.lit(0).alias("moved"), F.lit(-9).alias("taken"))
    rows = rows.withColumn("moved", F.aggregate("a", start, step, lambda acc: acc["moved"]))
    rows = rows.withColumn("added", F.size("a") + F.size("b") - 2 * F.col("moved"))
    sums = rows.agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("added") + F.col("moved") * 0.5).alias("e"), F.sum(F.col("added") + F.col("moved") + F.col("both")).alias("p"),
        F.sum("placed").alias("placed"), F.sum(2 * F.greatest("room", F.lit(0))).alias("places"),
    )
    similarity = F.when(F.col("p") == 0, 1.0).otherwise(1 - F.try_divide(F.col("e"), F.col("p")))
    share = F.coalesce(F.try_divide("placed", "places"), F.lit(0.0))
    rows = sums.select("n_docs", similarity.alias("similarity"), (share * share).alias("chance"))
    return rows.withColumn("pi", F.try_divide(F.col("similarity") - F.col("chance"), 1 - F.col("chance")))


def alpha_terms(a: list[tuple], b: list[tuple], length: int) -> tuple[float, list[tuple[float, float]]]:
    """Krippendorff's unitizing terms of one continuum: numerators by category of observed and expected disagreement.

    a, b: (start, length, category) of two observers, not overlapping within one. Returned are, for each category,
    (observed, expected).
    """
    out = []
    for c in sorted({u[2] for u in [*a, *b]}, key=str):
        sections = []
        for units in (a, b):
            own, at = [], 0
            for s, n, _ in sorted(u for u in units if u[2] == c):
                if s > at:
                    own.append((at, s - at, 0))
                own.append((s, n, 1))
                at = s + n
            if at < length:
                own.append((at, length - at, 0))
            sections.append(np.array(own, float).reshape(-1, 3))
        observed = 0.0
        for x, y in ((0, 1), (1, 0)):
            # either side divides the whole continuum, so the pairs that overlap are no more than the sections
            g, h = sections[x], sections[y]
            low = np.searchsorted(h[:, 0] + h[:, 1], g[:, 0], side="right")
            many = np.searchsorted(h[:, 0], g[:, 0] + g[:, 1], side="left") - low
            g = np.repeat(g, many, axis=0)
            h = h[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            gap = g[:, 0] - h[:, 0]
            meet = (g[:, 2] == 1) & (h[:, 2] == 1)
            inside = (g[:, 2] == 1) & (h[:, 2] == 0) & (gap >= 0) & (h[:, 1] - g[:, 1] >= gap)
            around = (g[:, 2] == 0) & (h[:, 2] == 1) & (gap <= 0) & (h[:, 1] - g[:, 1] <= gap)
            over = gap + g[:, 1] - h[:, 1]
            observed += np.where(meet, gap**2 + over**2, np.where(inside, g[:, 1] ** 2, np.where(around, h[:, 1] ** 2, 0))).sum()
        every = np.concatenate(sections)
        units, gaps = every[every[:, 2] == 1], np.sort(every[every[:, 2] == 0][:, 1])
        n = units[:, 1]
        # gaps of at least a unit's length: how many, and their sum
        first = np.searchsorted(gaps, n, side="left")
        rest = np.r_[np.cumsum(gaps[::-1])[::-1], 0.0][first]
        total = ((len(units) - 1) / 3 * (2 * n**3 - 3 * n**2 + n) + n**2 * (rest - (len(gaps) - first) * (n - 1))).sum()
        bottom = 2 * length * (2 * length - 1) - (units[:, 1] * (units[:, 1] - 1)).sum()
        out.append((observed / (2 * length**2), 2 / length * total / bottom if bottom else 0.0))
    return out


def alpha_unit(first: DataFrame, second: DataFrame, typed: bool = True) -> DataFrame:
    """(doc_id, n, observed, expected, alpha) of non-overlapping spans (doc_id, start, mass, label); alpha is null where nothing is expected."""
    side = lambda rows, name: rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "mass", "label")).alias(name))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("observed", pa.float64()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "a", "b"))):
                units = [[(u["start"], u["mass"], u["label"] if typed else None) for u in x] for x in (a, b)]
                n = max(s + m for s, m, _ in units[0])
                terms = alpha_terms(*units, n)
                rows.append((doc, n, sum(o for o, _ in terms), sum(e for _, e in terms)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = side(first, "a").join(side(second, "b"), "doc_id").mapInArrow(run, "doc_id long, n long, observed double, expected double")
    return rows.withColumn("alpha", 1 - F.try_divide("observed", "expected"))


def report(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n, mean, std) over documents of each column named; std is that of a sample, null for one document."""
    long = scores.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select("x.*")
    return long.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
