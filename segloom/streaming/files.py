"""Segmenting files as they arrive: a file holds whole sentences, so no state is kept between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import rules
from ..sources.conll import FIELDS


def segment_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the discourse segments of every sentence of new dependency files in a folder, as rules.segments() gives them.

    A file is one record; sentences are cut at blank lines inside it. doc_id is the hash of the file's name. Lines
    of other than 14 fields, or without a number in the first, are left out.
    """
    text = spark.readStream.text(folder, wholetext=True)
    cut = F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n\\s*\n")).alias("sent_id", "block")
    sents = text.select(F.xxhash64(F.input_file_name()).alias("doc_id"), "value").select("doc_id", cut)
    line = F.filter(F.split("block", "\n"), lambda x: F.size(F.split(x, "\t")) == len(FIELDS))
    place = {f: k for k, f in enumerate(FIELDS)}
    at = lambda x, f: F.get(F.split(x, "\t"), place[f])
    word = lambda x: F.struct(at(x, "idx").try_cast("int").alias("idx"), *(at(x, f).alias(f) for f in ("form", "lemma", "pos", "feat")), at(x, "phead").try_cast("int").alias("phead"), at(x, "pdeprel").alias("pdeprel"))
    sents = sents.select("doc_id", "sent_id", F.transform(line, word).alias("words")).withColumn("words", F.filter("words", lambda w: w["idx"].isNotNull())).where(F.size("words") > 0)
    return rules.segment_sentences(sents)
