"""People in frames: boxes around the upper body, crops, the pick among several, and spans and shots of frontal frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators import pose
from kinelake.operators.bodies import crop_scaled, frontal_score, h36m
from kinelake.operators.qc import MIN_CONF, true_spans

UPPER_BODY = 13


def person_boxes(frames: DataFrame, width: int, height: int, margin: float = 0.35, window: int = 15, upper_body: bool = True) -> DataFrame:
    """(run, t, x0, y0, x1, y1: int) around the sure joints, half-open, wider by the margin; frames without one take the nearest box.

    Centre and size are smoothed over the window and the box is clipped to the frame; a run without any sure joint gets the whole frame.
    """
    seen = F.filter(F.slice("joints", 1, UPPER_BODY) if upper_body else F.col("joints"), lambda p: p["conf"] >= MIN_CONF)
    end = lambda f, c: f(F.transform(seen, lambda p: p[c]))
    lows, highs = [end(F.array_min, c) for c in "xy"], [end(F.array_max, c) for c in "xy"]
    wide = [(hi - lo) * (1 + 2 * margin) for lo, hi in zip(lows, highs, strict=True)]
    box = F.struct(((lows[0] + highs[0]) / 2).alias("cx"), ((lows[1] + highs[1]) / 2).alias("cy"), wide[0].alias("w"), wide[1].alias("h"))
    raw = frames.select("run", "t", F.when(F.size(seen) > 0, box).alias("box"))
    whole = F.struct(F.lit(width / 2).alias("cx"), F.lit(height / 2).alias("cy"), F.lit(float(width)).alias("w"), F.lit(float(height)).alias("h"))
    filled = pose.nearest_fill(raw, "box").select("run", "t", F.coalesce("filled", whole).alias("box")).select("run", "t", "box.*")
    smooth = filled.select("run", "t", *[pose.moving_average(filled, c, window).alias(c) for c in ("cx", "cy", "w", "h")])
    clip = lambda v, low, high: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)).cast("int")
    cx, cy, w, h = (F.col(c) for c in ("cx", "cy", "w", "h"))
    return smooth.select("run", "t", clip(cx - w / 2, 0, width - 1).alias("x0"), clip(cy - h / 2, 0, height - 1).alias("y0"), clip(cx + w / 2, 1, width).alias("x1"), clip(cy + h / 2, 1, height).alias("y1"))


def with_crop_offset(joints: Column, x0: Column, y0: Column) -> Column:
    """Joints found inside a crop, back in the frame's coordinates."""
    return F.transform(joints, lambda p: F.struct((p["x"] + x0).alias("x"), (p["y"] + y0).alias("y"), p["conf"].alias("conf")))


def extract_normalized(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Shoulder-normalized frames(run, t, joints) of spans(run, a, b), half-open; a frame in several spans comes once for each."""
    inside = spans.select("run", "a", "b", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("t")).where("b > a")
    return pose.shoulder_norm(frames.join(inside, ["run", "t"]))


def frames_in_segments(frames: DataFrame, segments: DataFrame, block: int = 256) -> DataFrame:
    """(run, t, seg_idx, frame columns): frames whose number lies in [a, b) of a segment(run, seg_idx, a, b) of their run.

    Frames and segments meet by blocks of frame numbers, the bounds are compared within: a segment is sent once for each block it touches, whatever its frames.
    """
    touched = F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block)))
    sent = segments.where("b > a").select("run", "seg_idx", F.col("a").alias("_a"), F.col("b").alias("_b"), touched.alias("_block"))
    met = frames.withColumn("_block", F.floor(F.col("t") / block)).join(sent, ["run", "_block"]).where("t >= _a AND t < _b")
    return met.select("run", "t", "seg_idx", *[c for c in frames.columns if c not in ("run", "t")])


def pick_person(persons: DataFrame, passes: Column) -> DataFrame:
    """(run, t, person, score): per frame, of persons(run, t, person, joints), the most frontal one, those that pass before all others; of equal ones the first."""
    scored = persons.select("run", "t", "person", F.coalesce(passes, F.lit(False)).alias("_ok"), frontal_score(F.col("joints")).alias("score"))
    best = F.max_by(F.struct("person", "score"), F.struct(F.col("_ok").cast("int"), "score", -F.col("person")))
    return scored.groupBy("run", "t").agg(best.alias("b")).select("run", "t", "b.person", "b.score")


def spans_of_checked(checked: DataFrame, fps: float, min_seconds: float, max_gap_seconds: float) -> DataFrame:
    """(run, a, b) in frame numbers, inclusive: spans of frontal frames over checked(run, frame, flag), which needn't be all frames; gaps and lengths count checked frames."""
    order = W.partitionBy("run").orderBy("frame")
    placed = checked.withColumn("t", F.row_number().over(order) - 1)
    spans = true_spans(placed.select("run", "t", "flag"), round(max_gap_seconds * fps), round(min_seconds * fps))
    frame = placed.select("run", "t", "frame")
    first, last = frame.select("run", F.col("t").alias("a"), F.col("frame").alias("first")), frame.select("run", F.col("t").alias("b"), F.col("frame").alias("last"))
    return spans.join(first, ["run", "a"]).join(last, ["run", "b"]).select("run", F.col("first").alias("a"), F.col("last").alias("b"))


def shots_in_seconds(shots: DataFrame, fps: Column) -> DataFrame:
    """shots(start_frame, end_frame, ...) with start_sec and end_sec."""
    return shots.withColumn("start_sec", F.col("start_frame") / fps).withColumn("end_sec", F.col("end_frame") / fps)


def flag_share(flag: Column) -> Column:
    """Aggregate: the share of true flags, 0 without any flag."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def shot_is_conductor(flag: Column, min_share: float, min_count: int) -> Column:
    """Aggregate: enough frontal frames, by number and by share; false without any frame."""
    n, hits = F.count(flag), F.count_if(flag)
    return (n > 0) & (hits >= min_count) & (hits >= F.lit(min_share) * n)


def can_auto_reject(decision: Column, identity: Column) -> Column:
    """Only rejects with a known identity score are taken without a human."""
    return F.coalesce(decision == "reject", F.lit(False)) & identity.isNotNull()


def fps_equals(fps: Column, wanted: float, tolerance: float = 0.05) -> Column:
    return F.abs(fps - wanted) < tolerance


def without_confidence(joints: Column) -> Column:
    return F.transform(joints, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(0.0).alias("conf")))


def without_legs(joints: Column, first: int = 13, last: int = 16) -> Column:
    """Knees and ankles set to 0 altogether."""
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("conf"))
    return F.transform(joints, lambda p, i: F.when(i.between(first, last), zero).otherwise(F.struct(p["x"].alias("x"), p["y"].alias("y"), p["conf"].alias("conf"))))


def disk_ok(free_bytes: Column, min_free_gb: float = 60.0) -> Column:
    return free_bytes >= F.lit(min_free_gb * 2**30)


def prep_scaled(frames: DataFrame, by: str = "run") -> DataFrame:
    """(by, t, j, x, y, conf) of the H36M body in the unit square of its window."""
    long = frames.select(by, "t", F.posexplode(h36m(F.col("joints"))).alias("j", "p")).select(by, "t", "j", "p.x", "p.y", "p.conf")
    return crop_scaled(long, by)


def prep_centred(frames: DataFrame, sizes: DataFrame, by: str = "run") -> DataFrame:
    """(by, t, j, x, y, conf) with the frame's middle at 0 and its edges at -1 and 1; sizes(by, width, height)."""
    long = frames.select(by, "t", F.posexplode("joints").alias("j", "p")).select(by, "t", "j", "p.x", "p.y", "p.conf").join(sizes, by)
    half = lambda c: F.col(c) / 2
    return long.select(by, "t", "j", ((F.col("x") - half("width")) / half("width")).alias("x"), ((F.col("y") - half("height")) / half("height")).alias("y"), "conf")


def motion_stats(frames: DataFrame, by: str, pixels: str) -> DataFrame:
    """(by, motion_mean, motion_p90) of the mean absolute change of pixels (an array) from frame to frame; 0 for fewer than two."""
    before = F.lag(pixels).over(W.partitionBy(by).orderBy("t"))
    change = F.aggregate(F.zip_with(pixels, before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(pixels)
    steps = frames.select(by, F.when(before.isNotNull(), change).alias("d"))
    return steps.groupBy(by).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("motion_mean"), F.coalesce(F.percentile("d", F.lit(0.9)), F.lit(0.0)).alias("motion_p90"))


def dropped_segments(segments: DataFrame, runs: DataFrame, blacklist: DataFrame) -> DataFrame:
    """(conductor, segments, dropped): segments of the runs, and how many of them the blacklist(run, seg_idx) takes."""
    marked = segments.join(runs.select("run", "conductor"), "run").join(blacklist.select("run", "seg_idx").distinct().withColumn("_bad", F.lit(True)), ["run", "seg_idx"], "left")
    return marked.groupBy("conductor").agg(F.count("*").alias("segments"), F.count_if(F.coalesce("_bad", F.lit(False))).alias("dropped"))
