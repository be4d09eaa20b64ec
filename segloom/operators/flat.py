"""Sentences of a batch as flat arrays, for operators that are a loop within a sentence or a document.

A reader makes Words of a batch: rows() of grouped words, plans.annotate.read() of plain text. So an operator runs
over either, and over text without a shuffle, as all words of a document come from one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words that are worked on at once, or one document or sentence of more.
CHUNK = 1 << 16
KEY = ["doc_id", "sent_id"]


@dataclass
class Words:
    """doc, sent, size and start (the first word's number in its document, if it is known) of each sentence; the others of each word."""

    doc: list
    sent: list
    size: np.ndarray
    start: np.ndarray | None
    idx: np.ndarray
    head: np.ndarray
    form: list
    tag: list
    rel: list

    @cached_property
    def base(self) -> np.ndarray:
        """Where each sentence's words begin."""
        return np.cumsum(self.size) - self.size

    @cached_property
    def sentence(self) -> np.ndarray:
        """The sentence of each word."""
        return np.repeat(np.arange(len(self.size)), self.size)

    @cached_property
    def first(self) -> np.ndarray:
        """The first sentence of each document."""
        return np.flatnonzero(self.start == 0)

    @cached_property
    def document(self) -> np.ndarray:
        """The place of each sentence's document among the batch's."""
        return np.cumsum(self.start == 0) - 1

    @cached_property
    def tags(self) -> np.ndarray:
        out = np.empty(len(self.tag), object)
        out[:] = self.tag
        return out

    @cached_property
    def forms(self) -> np.ndarray:
        out = np.empty(len(self.form), object)
        out[:] = self.form
        return out


@dataclass
class Nodes:
    """doc (its place among the batch's documents), start, len, label and depth of each node of a segmentation."""

    doc: np.ndarray
    start: np.ndarray
    len: np.ndarray
    label: np.ndarray
    depth: np.ndarray

    def spans(self, w: Words) -> np.ndarray:
        """A number for each node's place and length, the same for equal ones only."""
        return ((w.base[w.first][self.doc] + self.start) << 32) + self.len

    @staticmethod
    def of(*parts: tuple) -> Nodes:
        """Nodes of several (doc, start, len, label, depth), of which a scalar holds for all."""
        whole = [[np.broadcast_to(np.asarray(c, object if isinstance(c, str) else None), len(p[0])) for c in p] for p in parts]
        return Nodes(*(np.concatenate(c) for c in zip(*whole)))


def grouped(words: DataFrame, *fields: str) -> DataFrame:
    """(doc_id, sent_id, words): each sentence's words in order of idx."""
    return words.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("idx", *fields))).alias("words"))


def rows(batch: pa.RecordBatch) -> Iterator[Words]:
    """Words of grouped(); fields that aren't there are null, and numbers that are null -1."""
    sizes, at = batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        part = batch.slice(at, to - at)
        flat = part.column("words").flatten()
        names = [f.name for f in flat.type]
        number = lambda c: flat.field(names.index(c)).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        text = lambda c: flat.field(names.index(c)).to_pylist() if c in names else [None] * len(flat)
        yield Words(part.column("doc_id").to_pylist(), part.column("sent_id").to_pylist(), sizes[at:to], None, number("idx"), number("head"), text("form"), text("tag"), text("rel"))
        at = to


def over(source: DataFrame, read: Callable, work: Callable[[Words], Iterator[list]], ddl: str) -> DataFrame:
    """What work yields for the Words that read makes of source: lists of columns as in ddl, the documents' numbers being of their type."""
    schema = StructType.fromDDL(ddl)
    schema["doc_id"].dataType = source.schema["doc_id"].dataType
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in read(batch):
                for columns in work(words):
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return source.mapInArrow(run, schema)


def greatest(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted key the greatest of its values, None if it isn't there. Nulls count as the least."""
    found = np.full(len(wanted), None, object)
    if len(keys):
        names = sorted({v for v in values if v is not None})
        rank = {v: k for k, v in enumerate([None, *names])}
        order = np.lexsort((np.array([rank[v] for v in values]), keys))
        keys, values = keys[order], values[order]
        at = np.searchsorted(keys, wanted, side="right") - 1
        hit = (at >= 0) & (keys[at] == wanted)
        found[hit] = values[at[hit]]
    return found


def of(values: list, places: np.ndarray) -> pa.Array:
    """The values at these places."""
    return pa.array(values).take(pa.array(places))
