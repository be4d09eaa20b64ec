"""Mixing sources to target weights by a low-discrepancy schedule.

Slot n of the schedule has the point frac(n / golden ratio), held as a 32-bit integer; the source whose
part of the cumulative weights holds the point gives that slot's block. A source's slots are ranked, and
rank r takes block r of the source's shuffled documents, cut into blocks of equal tokens; when they are
used up, its next epoch begins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TMP, materialise

#: Tokens of a block; power of a source's tokens that its weight is by default; shuffling seed.
BLOCK, POWER, SEED = 2048, 0.7, "mix-1"
GOLDEN, CIRCLE = 2654435769, 1 << 32


def n_tokens(text: Column) -> Column:
    """Words, split at ASCII white space; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0b\\f\\r]+")), F.lit(0)).cast("long")


def shuffled(seed: str) -> Column:
    """The hash that a source's documents are ordered by."""
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _order(docs: DataFrame, seed: str) -> DataFrame:
    """Adds source (null as ''), tokens, the shuffling hash, and the hash's first digits, of which prefix sums are made first."""
    return docs.select(
        "*", F.coalesce("source", F.lit("")).alias(TMP + "source"), n_tokens(F.col("text")).alias(TMP + "tokens"),
        shuffled(seed).alias(TMP + "hash"),
    ).withColumn(TMP + "part", F.substring(TMP + "hash", 1, 3))


def _bases(slim: DataFrame) -> DataFrame:
    """Tokens of a source before each part: a few thousand parts a source, so that no task orders a whole source."""
    parts = slim.groupBy(TMP + "source", TMP + "part").agg(F.sum(TMP + "tokens").alias("n"))
    before = Window.partitionBy(TMP + "source").orderBy(TMP + "part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(TMP + "source", TMP + "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(TMP + "base"))


def _starts(rows: DataFrame, bases: DataFrame) -> DataFrame:
    """Adds the token of the source at which each document begins."""
    order = [c for c in (TMP + "hash", "doc_id", TMP + "tokens", TMP + "text") if c in rows.columns]
    before = Window.partitionBy(TMP + "source", TMP + "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(TMP + "local", F.coalesce(F.sum(TMP + "tokens").over(before), F.lit(0)))
    return rows.join(bases, [TMP + "source", TMP + "part"]).withColumn(TMP + "start", F.col(TMP + "base") + F.col(TMP + "local"))


def _plan(slim: DataFrame, weights: dict[str, float] | None, block: int, epochs: float) -> list[dict]:
    """For each source with tokens and weight, by name: blocks and the part of the circle from lo to hi; one row a source."""
    sums = sorted((r[0], r[1]) for r in slim.groupBy(TMP + "source").agg(F.sum(TMP + "tokens")).collect() if r[1])
    given = [(s, n, int((n**POWER if weights is None else weights.get(s, 0.0)) * 1000)) for s, n in sums]
    given = [g for g in given if g[2] > 0]
    total, cum, plan = sum(w for _, _, w in given), 0, []
    for source, n, w in given:
        lo, cum = cum * CIRCLE // total, cum + w
        plan.append({"source": source, "blocks": -(-n // block), "lo": lo, "hi": cum * CIRCLE // total})
    return plan


def n_slots(plan: list[dict], epochs: float) -> int:
    return int(sum(p["blocks"] for p in plan) * epochs)


def schedule(spark: SparkSession, plan: list[dict], slots: int) -> DataFrame:
    """(slot, source number, rank of the slot within its source) for slots 1 to n."""
    cuts = np.array([p["hi"] for p in plan], np.int64)
    which = F.arrow_udf(lambda u: pa.array(np.searchsorted(cuts, u.to_numpy(), side="right").astype(np.int32)), "int")
    rows = spark.range(1, slots + 1).select(
        F.col("id").alias("slot"), which((F.col("id") % CIRCLE * GOLDEN) % CIRCLE).alias("k"), F.shiftright("id", 16).alias("run")
    )
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("k", "run").orderBy("slot")))
    runs = rows.groupBy("k", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("k").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("k", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(runs, ["k", "run"]).select("slot", "k", (F.col("base") + F.col("nth") - 1).alias("rank"))


def _source_table(spark: SparkSession, plan: list[dict]) -> DataFrame:
    return spark.createDataFrame([(k, p["source"], p["blocks"]) for k, p in enumerate(plan)], "k int, source string, blocks long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """The schedule with its contents: (slot, source, epoch, block, doc_id, token_from, token_to).

    A row says that slot `slot` trains on tokens token_from to token_to (exclusive) of a document. The
    schedule has `epochs` times as many slots as there are blocks: sources under their target repeat
    blocks, those over it leave some out. weights: by source, any scale; a source not named isn't used; by
    default tokens ** 0.7. Blocks hold `block` tokens but for the last of a source. A null source is the
    source ''. Documents without words (a null text too) are in no block; rows with equal or null doc_id
    count each. Only doc_id, source and text are read. Without tokens or weights there are no rows.
    """
    spark = docs.sparkSession
    slim = _order(docs.select("doc_id", "source", "text"), seed).drop("text", "source").where(f"{TMP}tokens > 0")
    slim = materialise(slim, "tokens")
    plan = _plan(slim, weights, block, epochs)
    starts = _starts(slim, _bases(slim))
    first, last = F.floor(F.col(TMP + "start") / block), F.floor((F.col(TMP + "start") + F.col(TMP + "tokens") - 1) / block)
    pieces = starts.select(
        F.col(TMP + "source").alias("source"), "doc_id", F.col(TMP + "tokens").alias("n"), F.col(TMP + "start").alias("at"),
        F.explode(F.sequence(first, last)).alias("block"),
    )
    slots = schedule(spark, plan, n_slots(plan, epochs)).join(F.broadcast(_source_table(spark, plan)), "k").select(
        "slot", "source", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block")
    )
    return slots.join(pieces, ["source", "block"]).select(
        "slot", "source", "epoch", "block", "doc_id",
        F.greatest(F.lit(0), F.col("block") * block - F.col("at")).alias("token_from"),
        F.least("n", (F.col("block") + 1) * block - F.col("at")).alias("token_to"),
    )


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """docs as the schedule of mix() draws them: each as often as the block of its first token is scheduled, perhaps never.

    All columns stay. Documents without words are in no block and are left out. Rows of one doc_id and as many
    tokens are in order of their texts' hashes; of rows with the same doc_id, source and text any may be drawn more
    often than another. An empty table stays empty.
    """
    spark, order = docs.sparkSession, docs.columns
    text = F.xxhash64("text").alias(TMP + "text")
    rows = _order(docs.select("doc_id", "source", "text"), seed).where(f"{TMP}tokens > 0")
    slim = materialise(rows.select("doc_id", TMP + "source", TMP + "tokens", TMP + "hash", TMP + "part", text), "tokens")
    plan = _plan(slim, weights, block, epochs)
    drawn = schedule(spark, plan, n_slots(plan, epochs)).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    sources = _source_table(spark, plan).join(drawn, "k").select(F.col("source").alias(TMP + "source"), F.col("blocks").alias(TMP + "blocks"), F.col("n").alias(TMP + "n"))
    starts = _starts(slim, _bases(slim)).join(F.broadcast(sources), TMP + "source")
    own = F.floor(F.col(TMP + "start") / block)
    times = F.floor(F.col(TMP + "n") / F.col(TMP + "blocks")) + (own < F.col(TMP + "n") % F.col(TMP + "blocks")).cast("long")
    # rows of one key are numbered on either side, by which they are joined one to one
    key = [TMP + "hash", TMP + "source", TMP + "text"]
    nth = lambda by: F.row_number().over(Window.partitionBy(*key).orderBy(by))
    drawn = starts.withColumn(TMP + "times", times).withColumn(TMP + "nth", nth(TMP + "start")).where(f"{TMP}times > 0").select(*key, TMP + "nth", TMP + "times")
    whole = docs.withColumns({TMP + "hash": shuffled(seed), TMP + "source": F.coalesce("source", F.lit("")), TMP + "text": F.xxhash64("text")})
    found = whole.withColumn(TMP + "nth", nth(TMP + "hash")).join(drawn, [*key, TMP + "nth"])
    return found.select(*order, F.explode(F.sequence(F.lit(1), F.col(TMP + "times")))).select(*order)


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')), 0) AS n
  FROM documents),
s AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM d WHERE n > 0),
w AS (
  SELECT source, CAST((sum(n) + {BLOCK - 1}) // {BLOCK} AS BIGINT) AS blocks, CAST(floor(pow(sum(n), {POWER}) * 1000) AS HUGEINT) AS w
  FROM s GROUP BY source),
c AS (
  SELECT source, blocks, sum(w) OVER (ORDER BY source) * {CIRCLE} // sum(w) OVER () AS hi,
         (sum(w) OVER (ORDER BY source) - w) * {CIRCLE} // sum(w) OVER () AS lo
  FROM w),
t AS (SELECT n AS slot, (n % {CIRCLE} * {GOLDEN}) % {CIRCLE} AS u FROM generate_series(1, (SELECT CAST(sum(blocks) AS BIGINT) FROM c)) g(n)),
r AS (
  SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM t JOIN c ON u >= lo AND u < hi),
p AS (SELECT source, doc_id, n, begins, unnest(generate_series(CAST(begins // {BLOCK} AS BIGINT), CAST((begins + n - 1) // {BLOCK} AS BIGINT))) AS block FROM s)
SELECT slot, source, CAST(rank // blocks AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block, doc_id,
       CAST(greatest(0, block * {BLOCK} - begins) AS BIGINT) AS token_from, CAST(least(n, (block + 1) * {BLOCK} - begins) AS BIGINT) AS token_to
FROM r JOIN p USING (source) WHERE p.block = r.rank % r.blocks
"""
