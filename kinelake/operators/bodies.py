"""Kernels on the 17-joint body: remapping, scaling to a unit square, frame sizes, head boxes, frontal scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The joints of the 17-joint source body whose mean is joint 0, 1, ... of the H36M body.
H36M = (
    (11, 12), (12,), (14,), (16,), (11,), (13,), (15,), (5, 6, 11, 12), (5, 6),
    (0,), (3, 4), (5,), (7,), (9,), (6,), (8,), (10,),
)
#: Standard widths and heights of videos, and what stands where nothing is visible.
WIDTHS = (426, 640, 854, 1280, 1440, 1920, 2560, 3840)
HEIGHTS = (240, 360, 480, 720, 1080, 1440, 2160)
NO_SIZE = (1920.0, 1080.0)
HEAD, LEFT_EYE, RIGHT_EYE, LEFT_SHOULDER, RIGHT_SHOULDER = (0, 1, 2, 3, 4), 1, 2, 5, 6
FRONTAL = (0, 5, 6, 9, 10)


def h36m(joints: Column) -> Column:
    """array<struct<x, y, conf>> of the H36M body; a synthesized joint is as sure as the least sure of its sources."""

    def mean(sources: tuple[int, ...]) -> Column:
        of = lambda name: [F.get(joints, i)[name] for i in sources]
        conf = F.least(*of("conf")) if len(sources) > 1 else of("conf")[0]
        return F.struct(*[(sum(of(n)[1:], of(n)[0]) / len(sources)).alias(n) for n in ("x", "y")], conf.alias("conf"))

    return F.array(*[mean(s) for s in H36M])


def crop_scaled(long: DataFrame, by: str = "run") -> DataFrame:
    """long(by, t, j, x, y, conf) in [-1, 1]: the square around all points with any confidence; under four points or no extent give zeros. Confidences are clipped too."""
    seen = F.col("conf") != 0
    ends = [f(F.when(seen, F.col(c))).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]
    box = long.groupBy(by).agg(F.count(F.when(seen, 1)).alias("n"), *ends).withColumn("scale", F.greatest(F.expr("hi_x - lo_x"), F.expr("hi_y - lo_y")))
    fits = (F.col("n") >= 4) & (F.col("scale") > 0)
    clip = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    place = lambda c: 2 * ((F.col(c) - (F.col(f"lo_{c}") + F.col(f"hi_{c}") - F.col("scale")) / 2) / F.col("scale") - 0.5)
    zero = lambda x: F.when(fits, clip(x)).otherwise(0.0)
    return long.join(box, by).select(by, "t", "j", zero(place("x")).alias("x"), zero(place("y")).alias("y"), zero(F.col("conf")).alias("conf"))


def frame_size(long: DataFrame, by: str = "run", min_conf: float = 0.3) -> DataFrame:
    """(by, width, height): the next standard size that holds every visible point; beyond all, the largest coordinate itself."""
    seen = F.col("conf") > min_conf
    most = long.groupBy(by).agg(*[F.max(F.when(seen, F.col(c))).alias(c) for c in "xy"])

    def fit(c: str, sizes: tuple[int, ...], missing: float) -> Column:
        at_least = F.get(F.filter(F.array(*[F.lit(float(s)) for s in sizes]), lambda s: s >= F.col(c)), F.lit(0))
        return F.coalesce(at_least, F.col(c), F.lit(missing))

    return most.select(by, fit("x", WIDTHS, NO_SIZE[0]).alias("width"), fit("y", HEIGHTS, NO_SIZE[1]).alias("height"))


def head_box(joints: Column, width: int, height: int, pad: float = 0.6, min_conf: float = 0.3, min_size: float = 0.04) -> Column:
    """struct<x0, y0, x1, y1: int> around the head, reaching further up than down; null without a visible face point or where the head is too small."""
    face = F.filter(F.transform(F.array(*[F.lit(i) for i in HEAD]), lambda i: F.get(joints, i)), lambda p: p["conf"] >= min_conf)
    of = lambda c: F.transform(face, lambda p: p[c])
    mean = lambda c: F.aggregate(of(c), F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(face), F.lit(0))
    extent = lambda c: F.array_max(of(c)) - F.array_min(of(c))
    sure = lambda i, k: (F.get(joints, i)["conf"] >= min_conf) & (F.get(joints, k)["conf"] >= min_conf)
    apart = lambda i, k: F.abs(F.get(joints, i)["x"] - F.get(joints, k)["x"])
    scale = (
        F.when(sure(LEFT_SHOULDER, RIGHT_SHOULDER), apart(LEFT_SHOULDER, RIGHT_SHOULDER))
        .when(sure(LEFT_EYE, RIGHT_EYE), 2.5 * apart(LEFT_EYE, RIGHT_EYE))
        .otherwise(2.0 * F.greatest(extent("x"), extent("y"), F.lit(1.0)))
    )
    half = scale * (0.5 + pad)
    cut = lambda v, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)).cast("int")
    x0, x1 = cut(mean("x") - half, 0, width - 1), cut(mean("x") + half, 1, width)
    y0, y1 = cut(mean("y") - 1.2 * half, 0, height - 1), cut(mean("y") + 0.8 * half, 1, height)
    good = (F.size(face) > 0) & (scale >= min_size * min(width, height)) & (x1 - x0 >= 2) & (y1 - y0 >= 2)
    return F.when(good, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def frontal_score(joints: Column) -> Column:
    """Product of the confidences of nose, shoulders and wrists."""
    score = F.lit(1.0)
    for i in FRONTAL:
        score = score * F.get(joints, i)["conf"]
    return score
