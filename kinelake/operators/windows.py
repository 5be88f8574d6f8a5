"""Windows over segments: evenly spaced starts, caps per recording, padding rules. Windows are rows, their frames never copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _spread(a: Column, b: Column, length: int, n_eval: int, stride_frac: float = 0.5, margin: int = 0) -> tuple[Column, Column]:
    """(number of windows less one, the start of window i as a function of i's column)."""
    stride = max(1, round(length * stride_frac))
    m = F.least(F.lit(margin), F.floor(F.greatest(F.lit(0), b - a - length) / 2).cast("int")) if margin else F.lit(0)
    first, span = a + m, b - a - 2 * m - length
    k = F.greatest(F.lit(1), F.least(F.lit(n_eval), F.floor(span / stride).cast("int") + 1))
    return F.when(span <= 0, F.lit(0)).otherwise(k - 1), lambda i: first + F.rint(i * (span / F.greatest(k - 1, F.lit(1)))).cast("int")


def window_starts(a: Column, b: Column, length: int, n_eval: int, **more) -> Column:
    """array<int>: at most n_eval starts, at least round(length * stride_frac) apart, margin frames from both ends; a segment that is too short has its own start."""
    last, start = _spread(a, b, length, n_eval, **more)
    return F.transform(F.sequence(F.lit(0), last), start)


def windows(segments: DataFrame, length: int, n_eval: int, **more) -> DataFrame:
    """segments with start and real_len, a row per window; short segments are one window of their own length. Windows are numbered, then placed row by row."""
    last, start = _spread(F.col("a"), F.col("b"), length, n_eval, **more)
    numbered = segments.withColumn("_i", F.explode(F.sequence(F.lit(0), last)))
    return numbered.withColumn("start", start(F.col("_i"))).withColumn("real_len", F.least(F.lit(length), F.col("b") - F.col("a"))).drop("_i")


def capped(rows: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """At most cap rows per key, evenly thinned in the given order (places rint(i * (n - 1) / (cap - 1)))."""
    per = W.partitionBy(*keys)
    numbered = rows.select("*", (F.row_number().over(per.orderBy(*order)) - 1).alias("_at"), F.count("*").over(per).alias("_n"))
    near = F.rint(F.col("_at") * (cap - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    # the place that the nearest step rounds to, and its neighbours: enough to invert the rounding
    hit = F.exists(F.array(near - 1, near, near + 1), lambda i: (i >= 0) & (i <= cap - 1) & (F.rint(i * (F.col("_n") - 1) / (cap - 1)) == F.col("_at")))
    return numbered.where((F.col("_n") <= cap) | hit).drop("_at", "_n")


def mirror_index(i: Column, n: Column) -> Column:
    """Index reflected at both ends without repeating them."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    r = F.pmod(i, period)
    return F.when(n == 1, F.lit(0)).otherwise(F.least(r, period - r)).cast("int")


def strip_indices(total: Column, n: int) -> Column:
    """At most n strictly increasing frame numbers at the middles of n equal parts."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.least(F.floor((i + 0.5) / n * total).cast("int"), total.cast("int") - 1)))


def sample_times(duration: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i + 0.5) * duration / n)
