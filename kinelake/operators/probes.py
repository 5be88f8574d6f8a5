"""Linear probes on feature arrays: standardized, class-balanced logistic regression with grouped out-of-fold probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators.evaluate import stratified_group_folds


def fit_probe(rows: DataFrame, c: float = 1.0, max_iter: int = 200):
    """A pipeline model of rows(features vector, y 0/1); None where only one class is present. c is the inverse strength of the penalty per row."""
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}  # two rows at most
    if len(counts) < 2:
        return None
    n = sum(counts.values())
    weight = F.when(F.col("y") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    model = LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", regParam=1 / (n * c), standardization=False, maxIter=max_iter)
    return Pipeline(stages=[scaler, model]).fit(rows.withColumn("weight", weight))


def oof_probabilities(rows: DataFrame, k: int = 5, c: float = 1.0) -> DataFrame:
    """rows(group, y, features array<double>, ...) with fold and p: each row's probability of 1 from the model of the other folds.

    Groups stay whole. If the other folds hold one class, p is that class. k models are fitted, whatever the number of rows.
    """
    folds = stratified_group_folds(rows.select("group", "y"), k)
    dealt = rows.join(folds.select("group", "fold"), "group").persist()
    ready = dealt.withColumn("features", array_to_vector("features"))
    parts = []
    for fold in sorted(r.fold for r in dealt.select("fold").distinct().collect()):
        rest, held = ready.where(F.col("fold") != fold), dealt.where(F.col("fold") == fold)
        model = fit_probe(rest, c)
        if model is None:
            only = rest.agg(F.max("y")).first()[0]
            parts.append(held.withColumn("p", F.lit(None if only is None else float(only)).cast("double")))
            continue
        scored = model.transform(held.withColumn("raw", F.col("features")).withColumn("features", array_to_vector("features")))
        scored = scored.withColumn("p", vector_to_array("probability")[1]).withColumn("features", F.col("raw"))
        parts.append(scored.select(*dealt.columns, "p"))
    return reduce(DataFrame.unionByName, parts) if parts else dealt.withColumn("p", F.lit(None).cast("double"))


def fit_classes(rows: DataFrame, hidden: tuple[int, ...] | None = None, max_iter: int = 200, penalty: float = 0.0, seed: int = 0, part_rows: int = 10_000):
    """A pipeline model of rows(features array<double>, y 0, 1, ...): multinomial logistic regression, or a perceptron with hidden layers, on standardized features."""
    # a file's row groups may be fewer than the cores, and every step passes over all rows; each part sends a gradient a step, so few rows aren't cut up
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // part_rows))
    dealt = rows.select("features", "y") if parts < 2 else rows.select("features", "y").repartition(parts)
    ready = dealt.withColumn("features", array_to_vector("features"))
    width = len(rows.select("features").first().features)
    classes = rows.agg(F.max("y")).first()[0] + 1
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    if hidden is None:
        model = LogisticRegression(featuresCol="scaled", labelCol="y", family="multinomial", regParam=penalty, standardization=False, maxIter=max_iter)
    else:
        model = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="y", layers=[width, *hidden, max(2, classes)], maxIter=max_iter, seed=seed)
    return Pipeline(stages=[scaler, model]).fit(ready)


def class_probabilities(model, rows: DataFrame) -> DataFrame:
    """rows with p array<double>, a probability per class."""
    scored = model.transform(rows.withColumn("_raw", F.col("features")).withColumn("features", array_to_vector("features")))
    return scored.withColumn("features", F.col("_raw")).select(*rows.columns, vector_to_array("probability").alias("p"))


def fold_report(scored: DataFrame, keys: tuple[str, ...] = ("conductor", "video_id")) -> DataFrame:
    """One row (win_n, win_acc, win_macro, rec_n, rec_correct) of scored(keys, y, p): windows hit, mean share of hits of a recording, and recordings hit by their summed probabilities."""
    best = lambda p: F.array_position(p, F.array_max(p)) - 1
    hit = (best(F.col("p")) == F.col("y")).cast("double")
    each = scored.select(*keys, "y", hit.alias("hit"), F.posexplode("p").alias("k", "v"))
    sums = each.groupBy(*keys, "k").agg(F.sum("v").alias("v"), F.max("y").alias("y"), F.avg("hit").alias("share"), F.count("*").alias("n"), F.sum("hit").alias("hits"))
    top = sums.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.round("v", 12)), "k"))).where("_at = 1")
    return top.agg(F.sum("n").alias("win_n"), F.try_divide(F.sum("hits"), F.sum("n")).alias("win_acc"), F.avg("share").alias("win_macro"), F.count("*").alias("rec_n"), F.count_if(F.col("k") == F.col("y")).alias("rec_correct"))
