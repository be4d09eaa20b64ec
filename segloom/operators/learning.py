"""Linear classification of tree nodes: one-hot features, folds, weights, models and their scores."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import CountVectorizerModel, IndexToString, StringIndexer, VarianceThresholdSelector, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def one_hot(rows: DataFrame, categorical: list[str], extra: str | None = None) -> DataFrame:
    """Adds names: "feature=value" of each categorical column, and the names in the array column extra."""
    parts = F.array(*(F.concat(F.lit(c + "="), F.col(f"`{c}`")) for c in categorical))
    return rows.withColumn("names", F.concat(parts, F.col(extra)) if extra else parts)


def vocabulary(rows: DataFrame) -> DataFrame:
    """(name, n_rows) of all names, each row counted once."""
    return rows.select(F.explode(F.array_distinct("names")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


def varying(rows: DataFrame) -> DataFrame:
    """vocabulary() without names that all rows have, which tell nothing."""
    return vocabulary(rows).crossJoin(rows.agg(F.count(F.lit(1)).alias("all"))).where("n_rows < all").drop("all")


def folds(texts: DataFrame, k: int = 10) -> DataFrame:
    """(doc_id, fold): contiguous folds in order of doc_id, the first ones larger by one.

    Whole-numbered documents are counted by runs of 4096 numbers, and others by the hash of what they begin with, so
    no task orders them all. A null doc_id is in no fold; fewer than k documents make as many folds.
    """
    ids = texts.where("doc_id is not null").select("doc_id").distinct()
    whole = dict(ids.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    ids = ids.withColumn("run", F.floor(F.col("doc_id") / 4096) if whole else F.substring(F.col("doc_id").cast("string"), 1, 3))
    runs = ids.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("all"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("run").orderBy("doc_id")) - 1
    rows = ids.join(runs, "run").withColumn("place", place)
    size, more = F.floor(F.col("all") / k), F.col("all") % k
    fold = F.when(F.col("place") < more * (size + 1), F.floor(F.col("place") / (size + 1))).otherwise(more + F.floor((F.col("place") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return rows.select("doc_id", fold.cast("int").alias("fold"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): inverse to a class's rows, 1 on average."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # of a row for each class
    return counts.select(label, "n", (F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def tp_fp_fn(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn, f1) of pairs (gold, pred): a segment where gold has NONE is false, any other difference a miss; case doesn't count."""
    gold, pred = F.lower("gold"), F.lower("pred")
    fp, tp = (gold == "none") & (pred != "none"), gold == pred
    sums = pairs.groupBy(*by).agg(F.count_if(tp).alias("tp"), F.count_if(fp).alias("fp"), F.count_if(~tp & ~fp).alias("fn"))
    return sums.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def label_f1(pairs: DataFrame) -> DataFrame:
    """(label, tp, n_gold, n_pred, f1) for every label of either side; an undefined score is 0."""
    counts = pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    tp = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(none)
    own = lambda c, g, p, t: F.struct(F.col(c).alias("label"), g.alias("n_gold"), p.alias("n_pred"), t.alias("tp"))
    sides = counts.select(F.explode(F.array(own("gold", F.col("n"), none, tp), own("pred", none, F.col("n"), none))).alias("s")).select("s.*")
    rows = sides.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "n_gold", "n_pred")))
    return rows.select("label", "tp", "n_gold", "n_pred", (2 * F.col("tp") / (F.col("n_gold") + F.col("n_pred"))).alias("f1"))


def macro_micro(pairs: DataFrame) -> DataFrame:
    """(macro_f1, micro_f1): mean over labels, and over rows."""
    return label_f1(pairs).agg(F.avg("f1").alias("macro_f1"), (F.sum("tp") / F.sum("n_gold")).alias("micro_f1"))


def train(rows: DataFrame, numbers: list[str], c: float = 0.3, balanced: bool = True, min_rows: float = 1.0, iterations: int = 30) -> PipelineModel:
    """One-vs-rest linear SVM over names (one-hot) and numeric columns, without features that never vary.

    rows: names, numbers, label. The hinge loss is Spark's, with regularisation 1 / (C n). Rows that are alike are
    trained on as one of their joint weight, so iterations run over different rows only. min_rows: rows that a name
    needs, or their share below 1; the names kept are held by the driver.
    """
    return _fit(rows.groupBy("names", *numbers, "label").agg(F.count(F.lit(1)).alias("n_rows")), numbers, c, balanced, min_rows, iterations)


def _fit(counted: DataFrame, numbers: list[str], c: float = 0.3, balanced: bool = True, min_rows: float = 1.0, iterations: int = 30) -> PipelineModel:
    """train() of rows that are counted by n_rows."""
    sizes = {r.label: r.own for r in counted.groupBy("label").agg(F.sum("n_rows").alias("own")).collect()}
    n = sum(sizes.values())
    share = F.create_map(*(F.lit(x) for label, own in sizes.items() if label is not None for x in (label, n / (len(sizes) * own) if balanced else 1.0)))
    counted = counted.where("label is not null").withColumn("weight", F.try_element_at(share, F.col("label")) * F.col("n_rows")).persist()
    try:
        need = min_rows if min_rows >= 1 else min_rows * n
        known = counted.select(F.explode(F.array_distinct("names")).alias("name"), "n_rows").groupBy("name").agg(F.sum("n_rows").alias("n")).where(F.col("n") >= need)
        names = [r.name for r in known.orderBy(F.desc("n"), "name").collect()]
        hot = CountVectorizerModel.from_vocabulary(names, inputCol="names", outputCol="hot").setBinary(True)
        svm = LinearSVC(maxIter=iterations, regParam=1.0 / (c * max(n, 1)))
        stages = [
            StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"),
            hot,
            VectorAssembler(inputCols=["hot", *numbers], outputCol="all"),
            VarianceThresholdSelector(featuresCol="all", outputCol="features", varianceThreshold=0.0),
            OneVsRest(classifier=svm, labelCol="label_index", featuresCol="features", weightCol="weight", predictionCol="index", parallelism=4),
        ]
        fitted = Pipeline(stages=stages).fit(counted)
        back = IndexToString(inputCol="index", outputCol="pred", labels=fitted.stages[0].labels)
        return PipelineModel(stages=[*fitted.stages[1:], back])
    finally:
        counted.unpersist()


def save(model: PipelineModel, path: str) -> None:
    """Write a model to a path, in place of one that is there."""
    model.write().overwrite().save(path)


def load(model: str | PipelineModel) -> PipelineModel:
    """A model, or the one saved at a path."""
    if isinstance(model, PipelineModel):
        return model
    try:
        return PipelineModel.load(model)
    except Exception as why:
        raise RuntimeError(f"no model can be read from {model}") from why


def cross_validate(rows: DataFrame, numbers: list[str], k: int = 10, **options) -> DataFrame:
    """(fold, gold, pred) of every row, each by a model that was trained on the other folds' documents."""
    found = cross_validate_counted(rows, numbers, k, **options)
    return found.select("fold", "gold", "pred", F.explode(F.sequence(F.lit(1), "n"))).select("fold", "gold", "pred")


def cross_validate_counted(rows: DataFrame, numbers: list[str], k: int = 10, **options) -> DataFrame:
    """(fold, gold, pred, n): cross_validate() with rows that are alike counted.

    They are trained on and told once. The counted rows stay persisted, as the result is still to be computed from them.
    """
    counted = rows.join(folds(rows, k), "doc_id").groupBy("fold", "names", *numbers, "label").agg(F.count(F.lit(1)).alias("n_rows"))
    counted = counted.coalesce(4).persist()  # different rows are few, and each iteration has a task for each part

    def told(fold: int) -> DataFrame:
        others = counted.where(F.col("fold") != fold).groupBy("names", *numbers, "label").agg(F.sum("n_rows").alias("n_rows")).coalesce(4)
        own = _fit(others, numbers, **options).transform(counted.where(F.col("fold") == fold))
        return own.groupBy("fold", F.col("label").alias("gold"), "pred").agg(F.sum("n_rows").alias("n"))

    with ThreadPool(4) as pool:
        parts = pool.map(told, sorted(r.fold for r in counted.select("fold").distinct().collect()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_fold(scores: DataFrame) -> DataFrame:
    """The fold of the greatest macro_f1, the first of equal ones, of (fold, macro_f1)."""
    return scores.agg(F.max_by("fold", F.struct("macro_f1", -F.col("fold"))).alias("fold"))
