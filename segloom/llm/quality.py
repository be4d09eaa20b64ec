"""Document quality and toxicity: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A text's features are the hashes of its words, of its word pairs and of its words' shapes (punctuation
and capitals), each present or not; both scores are sparse dot products with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import TMP, emit, slices, text_buffers

#: Weights of a model; feature 0 is the bias.
BUCKETS = 1 << 20
#: Most labelled rows that a fit reads, those of least hashed doc_id.
SAMPLE = 20_000
#: L1 is multiplied by the root of the number of rows: a word has to tell more than the labels' noise does.
PASSES, ALPHA, BETA, L1, L2 = 3, 1.0, 1.0, 0.1, 0.5
#: Least probability of good quality and greatest of toxicity of a document that is kept.
GOOD, TOXIC = 0.5, 0.3

_ASCII = np.arange(256)
_ALNUM = np.array([chr(c).isalnum() or c >= 128 for c in _ASCII])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in _ASCII])
#: Lower case; ASCII punctuation counts for nothing.
WORD_CODES = np.where(_ALNUM, T.BYTE_CODES[_LOWER], np.uint64(0))
_SHAPE_CODES = np.where(_ALNUM | T.SPACE, np.uint64(0), T.BYTE_CODES)
_UPPER = np.where((_ASCII >= 65) & (_ASCII <= 90), 1, np.where((_ASCII >= 97) & (_ASCII <= 122), -1000, 0)).astype(np.int32)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the text of each, repeats included, in no order."""
    cores, shapes, begins = [], [], []
    for at, to in T.pieces(data, bounds):
        part = data[at:to]
        start, end = T.spans(part, np.clip(bounds, at, to) - at)
        if not len(start):
            continue
        cores.append(T.hashes_of(part, start, end, WORD_CODES)[0])
        marks = np.add.reduceat(_SHAPE_CODES[part], start)
        capitals = np.add.reduceat(_UPPER[part], start) > 1
        shapes.append(marks + capitals.astype(np.uint64))
        begins.append(start + at)
    if not cores:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    core, shape = np.concatenate(cores), np.concatenate(shapes)
    offsets = np.searchsorted(np.concatenate(begins), bounds)
    owner = T.texts_of(offsets)
    pairs = T.inside(offsets, 2)
    number = lambda x: (T.mix(x) >> np.uint64(44)).astype(np.int64)
    plain = shape != 0
    return (
        np.concatenate([number(core), number(core[:-1] * np.uint64(3) + core[1:])[pairs], number(shape[plain] ^ np.uint64(0x5851F42D4C957F2D))]),
        np.concatenate([owner, owner[:-1][pairs], owner[plain]]),
    )


def _trainer(labels: int, passes: int):
    """Arrow function over one partition (text, l0, l1, ...): bucket and weights that aren't all 0."""
    schema = pa.schema([("bucket", pa.int64()), *((f"w{k}", pa.float64()) for k in range(labels))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        goals: list[np.ndarray] = []
        for whole in batches:
            for batch in slices(whole, "text"):
                found, owner = features(*text_buffers(batch.column("text")))
                both = np.unique(owner * BUCKETS + found)
                at = np.searchsorted(both, np.arange(batch.num_rows + 1) * BUCKETS)
                rows += [np.union1d(both[a:b] % BUCKETS, [0]).astype(np.int32) for a, b in zip(at, at[1:])]
                goals.append(np.stack([batch.column(f"l{k}").to_numpy(zero_copy_only=False).astype(float) for k in range(labels)], 1))
        if not rows:
            return
        goal = np.concatenate(goals)
        z, n = np.zeros((BUCKETS, labels)), np.zeros((BUCKETS, labels))

        l1 = L1 * np.sqrt(len(rows))

        def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
            return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

        for _ in range(passes):
            for own, y in zip(rows, goal):
                zi, ni = z[own], n[own]
                w = weights(zi, ni)
                g = 1 / (1 + np.exp(-np.clip(w.sum(0), -35, 35))) - y
                g = np.where(np.isnan(y), 0.0, g)
                z[own] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
                n[own] = ni + g * g
        w = weights(z, n)
        kept = np.flatnonzero(w.any(1))
        yield emit(schema, kept, *(w[kept, k] for k in range(labels)))

    return run


def fit(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("quality", "toxic"), sample: int = SAMPLE, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights, a column for each label, of a model fitted to labelled documents.

    At most `sample` labelled rows are read, those of least hashed doc_id, which is the one bound here. A
    label that is null teaches nothing; several labels of one doc_id count as the least quality and
    the greatest toxicity. Labels without a document and documents without a label aren't used. With
    nothing to learn from, there are no weights, and every score is 0.5.
    """
    one = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias(TMP + "id")).agg(
        *((F.min(c) if c == "quality" else F.max(c)).cast("double").alias(f"l{k}") for k, c in enumerate(columns))
    )
    one = one.withColumn("order", F.xxhash64(TMP + "id")).orderBy("order", TMP + "id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(one), F.col("doc_id") == F.col(TMP + "id"))
    rows = rows.repartition(1).sortWithinPartitions("order", "doc_id", "text")
    rows = rows.select("text", *(F.coalesce(f"l{k}", F.lit(float("nan"))).alias(f"l{k}") for k in range(len(columns))))
    schema = "bucket long, " + ", ".join(f"w{k} double" for k in range(len(columns)))
    table = rows.mapInArrow(_trainer(len(columns), passes), schema).toArrow()
    return table.column("bucket").to_numpy(), np.stack([table.column(f"w{k}").to_numpy() for k in range(len(columns))], 1)


def score(text: Column, model: tuple[np.ndarray, np.ndarray], names: tuple[str, ...] = ("p_quality", "p_toxic")) -> Column:
    """A struct of probabilities; a null text counts as an empty one, of which only the bias tells."""
    buckets, weights = model
    kept: dict[str, np.ndarray] = {}

    def run(texts: pa.Array) -> pa.Array:
        if not kept:
            kept["any"] = np.zeros(BUCKETS, bool)
            kept["any"][buckets[buckets != 0]] = True
            kept["w"] = np.zeros((BUCKETS, weights.shape[1]))
            kept["w"][buckets] = weights
        parts = [np.zeros((0, weights.shape[1]))]
        for batch in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            found, owner = features(*text_buffers(batch.column("text")))
            some = kept["any"][found]
            both = np.unique(owner[some] * BUCKETS + found[some])
            owner, found = both // BUCKETS, both % BUCKETS
            sums = np.stack([np.bincount(owner, kept["w"][found, k], batch.num_rows) for k in range(weights.shape[1])], 1)
            parts.append(1 / (1 + np.exp(-np.clip(sums + kept["w"][0], -35, 35))))
        p = np.concatenate(parts)
        return pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(p.shape[1])], list(names))

    return F.arrow_udf(run, "struct<" + ",".join(f"{n}:double" for n in names) + ">")(text)


def keeps(p_quality: Column, p_toxic: Column, model: tuple[np.ndarray, np.ndarray]) -> Column:
    """Whether a document is kept; what the model has no weight for rejects none."""
    told = model[1].any(0)
    return (p_quality >= GOOD if told[0] else F.lit(True)) & (p_toxic <= TOXIC if told[1] else F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, p_quality, p_toxic, keep) for every row of docs; keep: p_quality >= GOOD and p_toxic <= TOXIC
    (where nothing was learned of one of them, it rejects no document).

    Repeated rows and rows whose doc_id is null are scored like all others; a null text as an empty one.
    Only doc_id and text are read, so other columns may have any name. An empty table gives no rows.
    """
    model = fit(docs, labels, **options)
    scored = docs.select("doc_id", score(F.col("text"), model).alias("s"))
    p, q = F.col("s.p_quality"), F.col("s.p_toxic")
    return scored.select("doc_id", p.alias("p_quality"), q.alias("p_toxic"), keeps(p, q, model).alias("keep"))


def drop_rejected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without those that classify() wouldn't keep, all columns as they are."""
    order, model = docs.columns, fit(docs, labels, **options)
    scored = docs.withColumn(TMP + "s", score(F.col("text"), model))
    return scored.where(keeps(F.col(TMP + "s.p_quality"), F.col(TMP + "s.p_toxic"), model)).select(*order)
