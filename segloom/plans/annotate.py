"""A deterministic annotation of plain text, alike in Spark and in standard SQL, for texts that come without a parse.

Lines are sentences; words and punctuation marks are tokens; tags come from closed word classes and a word's
form; heads are those of a heap. Of every text there are two segmentations: sentences with what follows their
first comma inside ("gold"), and stretches that end at punctuation ("pred").
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flat

WORD = r"""[^ \t\r\n.,;:!?()"]+|[.,;:!?()"]"""

CLASSES = {
    "ART": "der die das den dem ein eine the a el la le les un una",
    "KOUS": "dass weil wenn that because si als",
    "APPR": "in von mit zu auf of to on for de en sur par pour",
    "KON": "und oder and or et y",
    "PRELS": "which who qui welche que",
    "VAFIN": "ist hat wird is was are has es est",
    "PPER": "er sie he it elle",
}


def tag_sql(like: str) -> str:
    """CASE expression of a form's tag; like: the dialect's function for regular expressions."""
    cases = [
        "WHEN form = ',' THEN '$,'", "WHEN form IN ('.', ';', ':', '!', '?') THEN '$.'", "WHEN form IN ('(', ')', '\"') THEN '$('",
        f"WHEN {like}(form, '^[0-9]+$') THEN 'CARD'",
        *(f"WHEN lower(form) IN ({', '.join(repr(w) for w in words.split())}) THEN '{tag}'" for tag, words in CLASSES.items()),
        "WHEN substring(form, 1, 1) <> lower(substring(form, 1, 1)) THEN 'NN'",
        "WHEN length(form) % 7 = 0 THEN 'VVINF'", "WHEN length(form) % 5 = 0 THEN 'VVFIN'", "WHEN length(form) % 3 = 0 THEN 'ADJA'",
    ]
    return "CASE " + " ".join(cases) + " ELSE 'NN' END"


REL = "CASE WHEN idx = 1 THEN 'ROOT' WHEN tag IN ('KOUS', 'KON') THEN 'CP' WHEN tag IN ('$,', '$.', '$(') THEN '--' WHEN tag = 'PPER' THEN 'SB' ELSE 'NK' END"


def tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, sent_id, idx, tok_no, form, tag, head, rel), without a shuffle; null texts have no tokens."""
    lines = F.split("text", "\n", -1)
    one = lambda line, s: F.transform(F.regexp_extract_all(line, F.lit(WORD), 0), lambda w, i: F.struct(s.alias("sent_id"), (i + 1).alias("idx"), w.alias("form")))
    rows = docs.where("text is not null").select(F.col(key).alias("doc_id"), F.posexplode(F.flatten(F.transform(lines, one))).alias("tok_no", "t"))
    rows = rows.select("doc_id", "t.sent_id", "t.idx", "tok_no", "t.form").withColumn("tag", F.expr(tag_sql("regexp_like")))
    rows = rows.withColumn("head", F.expr("CASE WHEN idx = 1 THEN 0 ELSE idx div 2 END").cast("int"))
    return rows.withColumn("rel", F.expr(REL))


class _Tags(dict):
    """tag_sql()'s tags of the forms met, forgotten when they are many."""

    known = {w: tag for tag, words in reversed(CLASSES.items()) for w in words.split()} | dict.fromkeys(".;:!?", "$.") | dict.fromkeys('()"', "$(") | {",": "$,"}

    def __missing__(self, form: str) -> str:
        if len(self) >= 200_000:
            self.clear()
        n, first = len(form), form[0]
        self[form] = tag = (
            "CARD" if form.isascii() and form.isdigit()
            else self.known.get(form.lower())
            or ("NN" if first != first.lower() else "VVINF" if n % 7 == 0 else "VVFIN" if n % 5 == 0 else "ADJA" if n % 3 == 0 else "NN")
        )
        return tag


_TAGS, _WORD = _Tags(), re.compile(WORD)
_RELS = {"KOUS": "CP", "KON": "CP", "$,": "--", "$.": "--", "$(": "--", "PPER": "SB"}


def plain(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, text), what read() takes."""
    return docs.select(F.col(key).alias("doc_id"), "text")


def read(batch: pa.RecordBatch) -> Iterator[flat.Words]:
    """The words of tokens(), whole documents together; lines without words are no sentences."""
    doc, sent, size, start, form = [], [], [], [], []

    def words() -> flat.Words:
        sizes, tags = np.array(size, np.int64), list(map(_TAGS.__getitem__, form))
        idx = np.arange(1, len(form) + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rels = [_RELS.get(t, "NK") for t in tags]
        for at in (np.cumsum(sizes) - sizes).tolist():
            rels[at] = "ROOT"
        return flat.Words(doc, sent, sizes, np.array(start, np.int64), idx, idx // 2, form, tags, rels)

    for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        at = 0
        for k, line in enumerate((text.as_py() or "").split("\n")):
            found = _WORD.findall(line)
            if found:
                doc.append(number)
                sent.append(k)
                size.append(len(found))
                start.append(at)
                form += found
                at += len(found)
        if len(form) >= flat.CHUNK:
            yield words()
            doc, sent, size, start, form = [], [], [], [], []
    if form:
        yield words()


def gold(toks: DataFrame) -> DataFrame:
    """Nodes (doc_id, start, len, label, depth): the text, its sentences, and in each what follows the first comma."""
    sents = toks.groupBy("doc_id", "sent_id").agg(
        F.min("tok_no").alias("start"), F.count(F.lit(1)).cast("int").alias("len"), F.min(F.when(F.col("tag") == "$,", F.col("tok_no"))).alias("comma")
    )
    end = F.col("start") + F.col("len")
    nodes = F.array(
        F.struct(F.col("start").alias("start"), F.col("len").alias("len"), F.lit("HS").alias("label"), F.lit(1).alias("depth")),
        F.when(F.col("comma") + 1 < end, F.struct((F.col("comma") + 1).alias("start"), (end - F.col("comma") - 1).alias("len"), F.lit("SUB").alias("label"), F.lit(2).alias("depth"))),
    )
    inner = sents.select("doc_id", F.explode(nodes).alias("n")).where("n is not null").select("doc_id", "n.*")
    return inner.unionByName(_whole(toks))


def _whole(toks: DataFrame) -> DataFrame:
    return toks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("len")).select(
        "doc_id", F.lit(0).alias("start"), "len", F.lit("TEXT").alias("label"), F.lit(0).alias("depth")
    )


def pred(toks: DataFrame) -> DataFrame:
    """Nodes of the text and of stretches up to the next punctuation mark."""
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("tok_no").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.col("tag").isin("$.", "$,"), 1).otherwise(0)
    chunks = toks.withColumn("chunk", F.coalesce(F.sum(cut).over(before), F.lit(0))).groupBy("doc_id", "chunk").agg(
        F.min("tok_no").alias("start"), F.count(F.lit(1)).cast("int").alias("len"), F.min_by("tag", "tok_no").alias("tag")
    )
    label = F.when(F.col("tag").isin("KOUS", "KON", "PRELS"), "SUB").otherwise("HS")
    return chunks.select("doc_id", "start", "len", label.alias("label"), F.lit(1).alias("depth")).unionByName(_whole(toks))


def _whole_nodes(w: flat.Words) -> tuple:
    ends = np.r_[w.first[1:], len(w.size)] - 1
    return np.arange(len(w.first)), 0, w.start[ends] + w.size[ends], "TEXT", 0


def gold_nodes(w: flat.Words) -> flat.Nodes:
    """gold() of read()'s words."""
    comma = np.flatnonzero(w.tags == "$,")
    sent, nth = np.unique(w.sentence[comma], return_index=True)
    before = comma[nth] - w.base[sent] + 1
    sent, before = sent[rest := before < w.size[sent]], before[rest]
    return flat.Nodes.of((w.document, w.start, w.size, "HS", 1), (w.document[sent], w.start[sent] + before, w.size[sent] - before, "SUB", 2), _whole_nodes(w))


def pred_nodes(w: flat.Words) -> flat.Nodes:
    """pred() of read()'s words."""
    n = len(w.idx)
    begins = np.zeros(n + 1, bool)
    begins[w.base[w.first]] = True
    begins[1:] |= (w.tags == "$.") | (w.tags == "$,")
    at = np.flatnonzero(begins[:n])
    sent = w.sentence[at]
    label = np.array([("HS", "SUB")[w.tag[k] in ("KOUS", "KON", "PRELS")] for k in at.tolist()], object)
    return flat.Nodes.of((w.document[sent], w.start[sent] + at - w.base[sent], np.diff(np.r_[at, n]), label, 1), _whole_nodes(w))


def nodes(docs: DataFrame, side: Callable[[flat.Words], flat.Nodes], key: str = "doc_id") -> DataFrame:
    """gold() or pred() of documents, made within each document's row."""

    def work(w: flat.Words) -> Iterator[list]:
        n = side(w)
        yield [flat.of(w.doc, w.first[n.doc]), n.start, n.len, n.label.tolist(), n.depth]

    return flat.over(plain(docs, key), read, work, "doc_id long, start int, len int, label string, depth int")


#: The same in DuckDB: tok, gold and pred, to be followed by more or by a SELECT.
SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS sent_id
  FROM documents WHERE text IS NOT NULL),
ws AS (SELECT doc_id, sent_id, regexp_extract_all(line, '{WORD}') AS ws FROM lines),
tok0 AS (SELECT doc_id, CAST(sent_id AS INT) AS sent_id, unnest(ws) AS form, CAST(unnest(range(1, len(ws) + 1)) AS INT) AS idx FROM ws),
tok1 AS (
  SELECT doc_id, sent_id, idx, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, idx) - 1 AS INT) AS tok_no, form,
         {tag_sql("regexp_matches")} AS tag, CAST(CASE WHEN idx = 1 THEN 0 ELSE idx // 2 END AS INT) AS head
  FROM tok0),
tok AS MATERIALIZED (SELECT *, {REL} AS rel FROM tok1),
whole AS (SELECT doc_id, 0 AS start, CAST(count(*) AS INT) AS len, 'TEXT' AS label, 0 AS depth FROM tok GROUP BY doc_id),
sents AS (
  SELECT doc_id, sent_id, min(tok_no) AS start, CAST(count(*) AS INT) AS len, min(CASE WHEN tag = '$,' THEN tok_no END) AS comma
  FROM tok GROUP BY doc_id, sent_id),
gold AS MATERIALIZED (
  SELECT doc_id, start, len, 'HS' AS label, 1 AS depth FROM sents
  UNION ALL SELECT doc_id, comma + 1, start + len - comma - 1, 'SUB', 2 FROM sents WHERE comma + 1 < start + len
  UNION ALL SELECT * FROM whole),
chunked AS (
  SELECT *, coalesce(sum(CASE WHEN tag IN ('$.', '$,') THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY tok_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM tok),
pred AS MATERIALIZED (
  SELECT doc_id, min(tok_no) AS start, CAST(count(*) AS INT) AS len,
         CASE WHEN min_by(tag, tok_no) IN ('KOUS', 'KON', 'PRELS') THEN 'SUB' ELSE 'HS' END AS label, 1 AS depth
  FROM chunked GROUP BY doc_id, chunk
  UNION ALL SELECT * FROM whole)
"""
