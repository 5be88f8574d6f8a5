"""Quality control of frame rows (run, t, joints): speeds, spikes, clean segments, summaries.

Null means "can't be judged"; NaN never enters. Everything is window functions over a run's frames: one shuffle by run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

# fixed values: joint numbers, and thresholds in shoulder widths per second, confidence and seconds
NOSE, LEFT_SHOULDER, RIGHT_SHOULDER, LEFT_WRIST, RIGHT_WRIST = 0, 5, 6, 9, 10
SPEED_TH, JUMP_TH, MIN_CONF, MIN_SEGMENT_S, KEEP_S = 25.0, 3.0, 0.3, 1.0, 2.0


def frame_order() -> WindowSpec:
    return W.partitionBy("run").orderBy("t")


def joint(j: int) -> Column:
    return F.get("joints", F.lit(j))


def norm2(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def median3(x: Column, over: WindowSpec | None = None) -> Column:
    """Temporal median of three frames; the two ends stay."""
    over = over or frame_order()
    before, after = F.lag(x).over(over), F.lead(x).over(over)
    return F.when(before.isNull() | after.isNull(), x).otherwise(F.get(F.array_sort(F.array(before, x, after)), F.lit(1)))


def with_kinematics(frames: DataFrame, fps: float = 25.0) -> DataFrame:
    """frames with n (of the run), scale (median shoulder width), speed and jump, both at the frame of arrival."""
    named = {"lw": LEFT_WRIST, "rw": RIGHT_WRIST, "ls": LEFT_SHOULDER, "rs": RIGHT_SHOULDER}
    flat = frames.select("run", "t", *[joint(j)[f].alias(f"{n}_{f}") for n, j in named.items() for f in ("x", "y", "conf")])
    sure = (F.col("ls_conf") >= MIN_CONF) & (F.col("rs_conf") >= MIN_CONF)
    width = lambda p: F.when(sure, norm2(F.col(f"ls_x{p}") - F.col(f"rs_x{p}"), F.col(f"ls_y{p}") - F.col(f"rs_y{p}")))
    whole = W.partitionBy("run")
    smooth = flat.select("*", *[median3(F.col(f"{n}_{f}")).alias(f"{n}_{f}3") for n in named for f in ("x", "y")], width("").alias("width"))
    smooth = smooth.select("*", width("3").alias("width3"), F.median("width").over(whole).alias("scale"), F.count("*").over(whole).alias("n"))

    def wrist(n: str) -> Column:
        step = norm2(F.col(f"{n}_x3") - F.lag(f"{n}_x3").over(frame_order()), F.col(f"{n}_y3") - F.lag(f"{n}_y3").over(frame_order()))
        return F.when((F.col(f"{n}_conf") >= MIN_CONF) & (F.lag(f"{n}_conf").over(frame_order()) >= MIN_CONF) & (F.col("scale") > 0), step / F.col("scale") * fps)

    jump = F.when(F.col("scale") > 0, F.abs(F.col("width3") - F.lag("width3").over(frame_order())) / F.col("scale") * fps)
    low = F.least("lw_conf", "rw_conf") < MIN_CONF
    return smooth.select("run", "t", "n", "scale", wrist("lw").alias("speed_l"), wrist("rw").alias("speed_r"), jump.alias("jump"), low.alias("low_conf")).withColumn("speed", F.greatest("speed_l", "speed_r"))


def with_spikes(kinematics: DataFrame, speed_th: float = SPEED_TH, jump_th: float = JUMP_TH) -> DataFrame:
    spike = F.coalesce(F.col("speed") > speed_th, F.lit(False)) | F.coalesce(F.col("jump") > jump_th, F.lit(False))
    return kinematics.withColumn("spike", spike)


def clean_segments(spikes: DataFrame, fps: float = 25.0, min_seconds: float = MIN_SEGMENT_S) -> DataFrame:
    """(run, a, b), half-open: islands between spikes of at least round(min_seconds * fps) frames."""
    island = F.sum(F.col("spike").cast("int")).over(frame_order())
    found = spikes.withColumn("island", island).groupBy("run", "island").agg(F.min("t").alias("a"), (F.max("t") + 1).alias("b"))
    return found.where(F.col("b") - F.col("a") >= F.rint(F.lit(min_seconds * fps))).select("run", "a", "b")


def summary(spikes: DataFrame, segments: DataFrame, fps: float = 25.0) -> DataFrame:
    """One row per run: counts, rates, extremes and the kept share."""
    per = spikes.groupBy("run").agg(
        F.count("*").alias("n_frames"), F.count_if("spike").alias("n_spikes"), F.coalesce(F.max("speed"), F.lit(0.0)).alias("max_speed"),
        F.coalesce(F.max("jump"), F.lit(0.0)).alias("max_jump"), F.avg(F.col("low_conf").cast("double")).alias("low_conf_frac"),
    )
    kept = segments.groupBy("run").agg(F.sum(F.col("b") - F.col("a")).alias("kept"), F.max(F.col("b") - F.col("a")).alias("longest"))
    both = per.join(kept, "run", "left").withColumn("kept_frames", F.coalesce("kept", F.lit(0)))
    return both.select(
        "run", "n_frames", "n_spikes", "kept_frames", (1 - F.col("kept_frames") / F.col("n_frames")).alias("drop_frac"),
        (F.col("n_spikes") / (F.col("n_frames") / fps)).alias("spike_rate"), "max_speed", "max_jump", "low_conf_frac", F.coalesce("longest", F.lit(0)).alias("longest"),
    )


def disposition(longest: Column, fps: float = 25.0, keep_s: float = KEEP_S) -> Column:
    return F.when(longest >= keep_s * fps, "keep").otherwise("discard")


def review_samples(summaries: DataFrame, n_worst: int, n_borderline: int, threshold: float = SPEED_TH) -> DataFrame:
    """The worst runs by speed, then those nearest to the threshold among the rest; ties by run. Top-k by order and limit, so no global sort."""
    worst = summaries.orderBy(F.desc("max_speed"), "run").limit(n_worst).select("run", "max_speed", F.lit("worst").alias("why"))
    rest = summaries.join(worst.select("run"), "run", "left_anti")
    near = rest.orderBy(F.abs(F.col("max_speed") - threshold), "run").limit(n_borderline).select("run", "max_speed", F.lit("borderline").alias("why"))
    return worst.unionByName(near)


def preview_spans(segments: DataFrame, fps: float = 25.0, max_seconds: float = 3.0) -> DataFrame:
    """Per run the middle, at most max_seconds long, of its longest segment (the first of equal ones)."""
    limit = round(max_seconds * fps)
    best = segments.groupBy("run").agg(F.max_by(F.struct("a", "b"), F.struct(F.col("b") - F.col("a"), -F.col("a"))).alias("s")).select("run", "s.a", "s.b")
    cut = F.col("b") - F.col("a") - limit
    a = F.col("a") + F.when(cut > 0, F.floor(cut / 2)).otherwise(0)
    return best.select("run", a.cast("int").alias("a"), (a + F.least(F.col("b") - F.col("a"), F.lit(limit))).cast("int").alias("b"))




def true_spans(signal: DataFrame, merge_gap: int, min_len: int) -> DataFrame:
    """(run, a, b), both inclusive: runs of true flags, gaps of at most merge_gap frames closed, then at least min_len frames long."""
    hits = signal.where("flag")
    gap = F.col("t") - F.lag("t").over(frame_order()) - 1
    island = F.sum(F.coalesce((gap > merge_gap).cast("int"), F.lit(0))).over(frame_order())
    spans = hits.withColumn("island", island).groupBy("run", "island").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return spans.where(F.col("b") - F.col("a") + 1 >= min_len).select("run", "a", "b")


def jitter(frames: DataFrame, min_conf: float = MIN_CONF) -> DataFrame:
    """Per run the median length of second differences, over all joints sure in the last of the three frames; 0 if none."""
    long = frames.select("run", "t", F.posexplode("joints").alias("j", "p")).select("run", "t", "j", "p.x", "p.y", "p.conf")
    w = W.partitionBy("run", "j").orderBy("t")
    second = lambda c: F.col(c) - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)
    d = long.select("run", F.when(F.col("conf") >= min_conf, norm2(second("x"), second("y"))).alias("d"))
    return d.groupBy("run").agg(F.coalesce(F.median("d"), F.lit(0.0)).alias("jitter"))
