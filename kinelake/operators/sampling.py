"""Seeded sampling and folds without a random generator's state: every draw is a hash of its key, so reruns and lost executors change nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = 17
#: Hexadecimal digits of the hash that name a range when all keys are numbered.
RANGE_DIGITS = 3


def digest(*key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key]).cast("binary"))


def draw(n: Column, *key: Column, seed: int = SEED) -> Column:
    """A number in 0 ... n - 1."""
    u = F.conv(F.substring(digest(*key, seed=seed), 1, 8), 16, 10).cast("long")
    return F.floor(u.cast("double") / 2**32 * n).cast("long")


def random_windows(segments: DataFrame, length: int, per_run: int, by: str = "run", seed: int = SEED) -> DataFrame:
    """(by, draw, start, real_len): per_run windows of every run, each possible start alike; a segment shorter than a window has one start, its own."""
    spans = segments.select(by, "a", "b", F.greatest(F.lit(1), F.col("b") - F.col("a") - length + 1).cast("long").alias("span"))
    before = F.coalesce(F.sum("span").over(W.partitionBy(by).orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = spans.withColumn("before", before).where("b > a")
    draws = spans.where("b > a").groupBy(by).agg(F.sum("span").alias("total")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_run - 1))))
    draws = draws.select(F.col(by).alias("_by"), "draw", draw(F.col("total"), F.col(by), F.col("draw"), seed=seed).alias("at"))
    hit = (F.col(by) == F.col("_by")) & (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("span"))
    start = (F.col("a") + F.col("at") - F.col("before")).cast("int")
    return placed.join(draws, hit).select(by, "draw", start.alias("start"), F.least(F.lit(length), F.col("b") - F.col("a")).cast("int").alias("real_len"))


def round_robin_folds(groups: DataFrame, key: str, k: int, seed: int = SEED) -> DataFrame:
    """(key, fold) of every distinct key, dealt in turn in the order of a seeded hash. Keys are numbered within hash ranges, whose sizes alone are summed in one task."""
    keyed = groups.select(key).distinct().withColumn("_h", digest(F.col(key), seed=seed)).withColumn("_range", F.substring("_h", 1, RANGE_DIGITS))
    first = keyed.groupBy("_range").count().select("_range", (F.sum("count").over(W.orderBy("_range")) - F.col("count")).alias("_first"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_h", key)) - 1
    return keyed.withColumn("_at", inside).join(first, "_range").select(key, ((F.col("_first") + F.col("_at")) % k).cast("int").alias("fold"))
