"""Windows for training and their controls: edge-repeating crops, random frames, noise, lost and shuffled frames, masks.

Every draw is a hash of its key (see sampling), so reruns and lost executors change nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators.sampling import SEED, digest, draw, random_windows
from kinelake.operators.windows import windows


def edge_index(i: Column, n: Column) -> Column:
    """Place i of n rows, the last one repeated beyond the end."""
    return F.least(i, n - 1).cast("int")


def uniform(low: Column | float, high: Column | float, *key: Column, seed: int = SEED) -> Column:
    """A number in [low, high) drawn from the key, in steps of 2^-52 of it."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    u = F.conv(F.substring(digest(*key, seed=seed), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)
    return low + u * (high - low)


def normal(sigma: float, *key: Column, seed: int = SEED) -> Column:
    """A number of mean 0 and deviation sigma drawn from the key."""
    a, b = 1.0 - uniform(0.0, 1.0, *key, F.lit("a"), seed=seed), uniform(0.0, 1.0, *key, F.lit("b"), seed=seed)
    return F.sqrt(-2.0 * F.log(a)) * F.cos(2 * math.pi * b) * sigma


def with_noise(long: DataFrame, sigma: float = 0.02, seed: int = SEED, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """long(by, t, j, x, y, ...) with noise on x and y."""
    key = [*[F.col(c) for c in by], F.col("t"), F.col("j")]
    return long.withColumn("x", F.col("x") + normal(sigma, *key, F.lit("x"), seed=seed)).withColumn("y", F.col("y") + normal(sigma, *key, F.lit("y"), seed=seed))


def kept_frames(n: Column, *key: Column, share: float = 0.1, chance: float = 0.5, seed: int = SEED) -> Column:
    """array<int>: for each of a window's n frames the one that stands there once some were lost.

    With the given chance, fewer than share * n frames are lost, one after the other: each is replaced by what then stands before it.
    """
    places = F.sequence(F.lit(0), n.cast("int") - 1)
    losses = draw(F.greatest(F.lit(1), F.floor(n * share)), *key, F.lit("n"), seed=seed)
    happens = (n > 1) & (uniform(0.0, 1.0, *key, F.lit("happens"), seed=seed) < chance) & (losses > 0)
    at = lambda k: (draw(n - 1, *key, F.lit("at"), k, seed=seed) + 1).cast("int")
    # each loss is drawn once, and only slices are taken of what is held
    every = F.transform(F.sequence(F.lit(1), F.greatest(losses, F.lit(1)).cast("int")), at)
    lose = lambda held, i: F.concat(F.slice(held, 1, i), F.slice(held, i, 1), F.slice(held, i + 2, F.size(held)))
    lost = F.aggregate(every, places, lose)
    return F.when(happens, lost).otherwise(places)


def shuffled(rows: DataFrame, by: tuple[str, ...], seed: int = SEED) -> DataFrame:
    """rows(by, t, ...) with ``t`` dealt anew within by: the same frames in a random order."""
    order = W.partitionBy(*by).orderBy(digest(*[F.col(c) for c in by], F.col("t"), seed=seed), "t")
    return rows.withColumn("t", (F.row_number().over(order) - 1).cast("int"))


def random_frames(frames: DataFrame, n_train: int = 32, n_eval: int = 8, by: str = "run", seed: int = SEED) -> DataFrame:
    """(by, t, part): n_train frames of each run without replacement ('train'), and n_eval evenly spaced ones ('eval', a place as often as it is hit)."""
    per = W.partitionBy(by)
    dealt = frames.select(by, "t", (F.row_number().over(per.orderBy(digest(F.col(by), F.col("t"), seed=seed), "t"))).alias("_k"), (F.row_number().over(per.orderBy("t")) - 1).alias("_at"), F.count("*").over(per).alias("_n"))
    train = dealt.where(F.col("_k") <= n_train).select(by, "t", F.lit("train").alias("part"))
    steps = F.sequence(F.lit(0), F.lit(n_eval - 1))
    hits = F.filter(steps, lambda i: F.rint(i * (F.col("_n") - 1) / max(1, n_eval - 1)) == F.col("_at"))
    even = dealt.withColumn("_hit", F.explode(hits)).select(by, "t", F.lit("eval").alias("part"))
    return train.unionByName(even)


def train_windows(segments: DataFrame, runs: DataFrame, labels: DataFrame, length: int, per_run: int, seed: int = SEED) -> DataFrame:
    """(run, draw, y, start, real_len, frames array<int>): random windows of runs(run, conductor), with the class of labels(conductor, y) and the source frame of each of their frames after some were lost."""
    drawn = random_windows(segments, length, per_run, seed=seed)
    named = drawn.join(with_classes(runs, labels, "inner"), "run")
    kept = kept_frames(F.col("real_len"), F.col("run"), F.col("draw"), seed=seed)
    return named.select("run", "draw", "y", "start", "real_len", F.transform(kept, lambda i: i + F.col("start")).alias("frames"))


def with_classes(runs: DataFrame, labels: DataFrame, how: str = "left") -> DataFrame:
    """(run, y) of runs(run, conductor) by labels(conductor, y): a label is a row per class, so runs aren't dealt by their class."""
    return runs.select("run", "conductor").join(F.broadcast(labels), "conductor", how).select("run", "y")


def observed(real_len: Column, length: int, one: str = "1", none: str = "0") -> Column:
    """A window's mask as text, a letter per frame: cut from a fixed text, so no row makes its own."""
    return F.substring(F.lit(one * length + none * length), length + 1 - F.least(real_len, F.lit(length)), F.lit(length))


def eval_items(segments: DataFrame, runs: DataFrame, labels: DataFrame, length: int, n_eval: int) -> DataFrame:
    """The windows(run, start, real_len, ...) of segments with y, -1 for a class that wasn't trained, and mask, text with 1 where a frame is observed. Segments get their class, then windows are made of them."""
    named = segments.join(with_classes(runs, labels), "run").withColumn("y", F.coalesce("y", F.lit(-1)))
    return windows(named, length, n_eval).withColumn("mask", observed(F.col("real_len"), length))
