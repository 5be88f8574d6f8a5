"""Evaluation statistics on probability rows (conductor, video_id, run, y, p): votes, confusion, F1, ranks, calibration, folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators.sampling import RANGE_DIGITS, digest


def argmax(p: Column) -> Column:
    """Place of the largest element, the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def vote(rows: DataFrame, keys: list[str], n: int, normalize: bool = False) -> DataFrame:
    """(keys, y, pred, hit): the class of largest summed probability; one partial aggregate with a sum per class, no explode.

    normalize: each row counts with a total of 1 (votes of votes).
    """
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x) if normalize else F.lit(1.0)
    sums = [F.sum(F.get("p", k) / total).alias(f"_{k}") for k in range(n)]
    both = rows.groupBy(*keys).agg(F.max("y").alias("y"), *sums)
    p = F.array(*[F.round(f"_{k}", 9) for k in range(n)])
    return both.select(*keys, "y", F.array(*[F.col(f"_{k}") for k in range(n)]).alias("p"), argmax(p).alias("pred")).withColumn("hit", F.col("y") == F.col("pred"))


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.where("y >= 0").groupBy("y", "pred").agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """(y, precision, recall, f1) from confusion counts; empty denominators count as one."""
    m = matrix.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("true"), F.lit(0).cast("long").alias("pred"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("true"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    per = m.groupBy(F.col("c").alias("y")).agg(*[F.sum(c).alias(c) for c in ("true", "pred", "hit")])
    pr, rc = F.col("hit") / F.greatest("pred", F.lit(1)), F.col("hit") / F.greatest("true", F.lit(1))
    return per.select("y", pr.alias("precision"), rc.alias("recall"), (2 * pr * rc / F.greatest(pr + rc, F.lit(1e-9))).alias("f1"))


def accuracy_against_chance(predicted: DataFrame) -> DataFrame:
    """(n, acc, chance, z): chance is the share of the most frequent class."""
    per = predicted.groupBy("y").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    whole = per.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("n").alias("top"))
    acc, c = F.col("hits") / F.col("n"), F.col("top") / F.col("n")
    return whole.select("n", acc.alias("acc"), c.alias("chance"), ((acc - c) / F.sqrt(F.greatest(F.lit(1e-9), c * (1 - c) / F.col("n")))).alias("z"))


def window_chance(matrix: DataFrame) -> DataFrame:
    """(n, chance, acc) of confusion counts (y, pred, n): the largest true class's share, and what was hit."""
    per = matrix.groupBy("y").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    total = F.sum("n")
    return per.agg(total.alias("n"), F.try_divide(F.max("n"), total).alias("chance"), F.try_divide(F.sum("hit"), total).alias("acc"))


def crop_subgroup(scored: DataFrame, threshold: float | None) -> DataFrame:
    """(n, false_reject, rate) among accepted rows that have crops, of scored(p, y, has_crops); without a threshold, or without such rows, nothing is rejected and the rate is null."""
    above = F.lit(False) if threshold is None else F.col("p") >= threshold
    rate = F.lit(None).cast("double") if threshold is None else F.try_divide(F.count_if(above), F.count("*"))
    return scored.where("y = 0 AND has_crops").agg(F.count("*").alias("n"), F.count_if(above).alias("false_reject"), rate.alias("rate"))


def distinct_counts(rows: DataFrame, by: list[str], what: dict[str, list[str]]) -> DataFrame:
    """(by, a count of distinct values for each name in what)."""
    return rows.groupBy(*by).agg(*[F.count_distinct(*cols).alias(name) for name, cols in what.items()])


def mean_scores(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """(by, n, score): the mean of a recording's scores, nulls left out."""
    return rows.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("score"))


def average_rank(by: str, value: str) -> Column:
    """0-based rank within ``by``, ties at their mean."""
    w = W.partitionBy(by).orderBy(value)
    return F.rank().over(w) - 1 + (F.count("*").over(W.partitionBy(by, value)) - 1) / 2


def spearman(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """(by, n, rho); null with fewer than two rows or a constant side."""
    ranked = rows.select(by, average_rank(by, a).alias("ra"), average_rank(by, b).alias("rb"))
    # not corr(): it divides by zero on a constant side
    rho = F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb"))
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, rho).alias("rho"))


def era_auc(rows: DataFrame, by: str, cutoff: int) -> DataFrame:
    """(by, auc): the chance that a score from the cutoff year on beats an older one, ties half, from ranks; null if one side is empty."""
    ranked = rows.select(by, (F.col("yr") >= cutoff).alias("new"), average_rank(by, "score").alias("r"))
    n1, n0 = F.count_if("new"), F.count_if(~F.col("new"))
    u = F.sum(F.when(F.col("new"), F.col("r") + 1)) - n1 * (n1 + 1) / 2
    return ranked.groupBy(by).agg(F.try_divide(u, n1 * n0).alias("auc"))


def calibrate(scored: DataFrame, precision: float, support: int, ranges: int = 4096) -> DataFrame:
    """(threshold): the lowest score at which rows at or above it are positive at the given precision, with that support.

    Counts are taken per distinct score, running totals within ranges of [0, 1]; only the ranges' own totals, a row each, are summed in one task.
    """
    at = F.greatest(F.lit(0), F.least(F.lit(ranges - 1), F.floor(F.col("p") * ranges))).cast("int")
    per = scored.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).withColumn("range", at)
    above = W.orderBy(F.desc("range")).rowsBetween(W.unboundedPreceding, -1)
    sizes = per.groupBy("range").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    before = sizes.select("range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"before_{c}") for c in ("n", "pos")])
    w = W.partitionBy("range").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = per.join(before, "range").select("p", *[(F.sum(c).over(w) + F.col(f"before_{c}")).alias(c) for c in ("n", "pos")])
    return total.where((F.col("n") >= support) & (F.col("pos") / F.col("n") >= precision)).agg(F.min("p").alias("threshold"))


def matched_repertoire(rows: DataFrame) -> DataFrame:
    """(piece, video_id) of pieces that two conductors or more have, documentaries and miscellany left out."""
    live = rows.where("type <> 'doc' AND piece <> 'misc'")
    shared = live.groupBy("piece").agg(F.count_distinct("conductor").alias("n")).where("n >= 2")
    return live.join(shared.select("piece"), "piece", "left_semi").select("piece", "video_id").distinct()


def stratified_group_folds(rows: DataFrame, k: int) -> DataFrame:
    """(group, fold): whole groups of rows(group, y) dealt to k folds so that classes spread evenly.

    Groups with the same class counts are alike: each fold gets the same number of them, and fewer than k are left over. The
    left-over ones are dealt one by one, most uneven first, each to the fold that keeps the spread of class shares lowest,
    then the smaller fold. That pass runs on the driver, over a row per distinct list of class counts; groups themselves are
    numbered on the executors, within ranges of a seeded hash. Where there are fewer than k groups each is a fold.
    """
    counts = rows.groupBy("group", "y").count()
    listed = counts.groupBy("group").agg(F.array_sort(F.collect_list(F.struct(F.col("y").alias("y"), F.col("count").alias("n")))).alias("kind"))
    keyed = listed.withColumn("key", F.sha2(F.to_json("kind"), 256)).withColumn("_h", digest(F.col("group"))).withColumn("_range", F.substring("_h", 1, RANGE_DIGITS))
    kinds = keyed.groupBy("key").agg(F.first("kind").alias("kind"), F.count("*").alias("many")).collect()
    n_groups = sum(r.many for r in kinds)
    k = min(k, max(1, n_groups))
    classes = sorted({c.y for r in kinds for c in r.kind})
    place = {c: i for i, c in enumerate(classes)}
    m = np.zeros((len(kinds), len(classes)))
    for i, r in enumerate(kinds):
        for c in r.kind:
            m[i, place[c.y]] = c.n
    total = np.maximum(1, m.T @ np.array([r.many for r in kinds], float)) if kinds else np.ones(0)
    held, sizes, left = np.zeros((k, len(classes))), np.zeros(k, int), []
    for i in sorted(range(len(kinds)), key=lambda i: (-m[i].std(), kinds[i].key)):
        even, rest = divmod(kinds[i].many, k)
        held, sizes = held + m[i] * even, sizes + even
        for at in range(rest):
            spread = []
            for f in range(k):
                held[f] += m[i]
                spread.append((round(float((held / total).std(0).mean()), 12), float(held[f].sum()), int(sizes[f]), f))
                held[f] -= m[i]
            best = min(spread)[-1]
            held[best], sizes[best] = held[best] + m[i], sizes[best] + 1
            left.append((kinds[i].key, even * k + at, best))
    first = keyed.groupBy("key", "_range").count()
    first = first.select("key", "_range", (F.sum("count").over(W.partitionBy("key").orderBy("_range")) - F.col("count")).alias("_first"))
    inside = F.row_number().over(W.partitionBy("key", "_range").orderBy("_h", "group")) - 1
    numbered = keyed.withColumn("_in", inside).join(first, ["key", "_range"]).select("group", "key", (F.col("_first") + F.col("_in")).alias("at"))
    rest = rows.sparkSession.createDataFrame(left, "key string, at long, _fold int")
    return numbered.join(rest, ["key", "at"], "left").select("group", F.coalesce("_fold", (F.col("at") % k).cast("int")).alias("fold"))
