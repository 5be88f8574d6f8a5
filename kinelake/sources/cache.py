"""A table of features that is read through: what it lacks is extracted, committed and from then on found."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators import pose
from kinelake.runtime import names_in


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """Everything that whole commits below path hold, with the commit's name; None before the first. A commit that never ended has no _SUCCESS and isn't read."""
    done = [c for c in names_in(spark, path) if c.startswith("commit=") and "_SUCCESS" in names_in(spark, f"{path}/{c}")]
    return spark.read.option("basePath", path).parquet(*[f"{path}/{c}" for c in done]) if done else None


def read_through(rows: DataFrame, keys: list[str], extract: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """The features of every key of rows, with ``hit``: whether they were there before. extract(rows) -> (keys, features), one row per key.

    Only rows of missing keys go through extract; its result is written as one commit of its own, so that readers see all of it or
    nothing, and two writers don't disturb each other (of two commits of a key the first by name counts). A key that extract gives nothing for is missing again next time. Null keys
    are left out.
    """
    spark = rows.sparkSession
    some = rows.dropna(subset=keys)
    wanted = some.select(*keys).distinct()
    held = committed(spark, path)
    missing = some if held is None else some.join(held.select(*keys).distinct(), keys, "left_anti")
    if not missing.isEmpty():
        name = f"commit={uuid.uuid4().hex}"
        extract(missing).write.mode("errorifexists").parquet(f"{path}/{name}")
    else:
        name = ""
    now = committed(spark, path)
    if now is None:
        return wanted.withColumn("hit", F.lit(False)).limit(0)
    features = [c for c in now.columns if c not in (*keys, "commit")]
    first = now.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct((F.concat(F.lit("commit="), "commit") == name).alias("fresh"), "commit")).alias("c"), F.min_by(F.struct(*features), F.struct((F.concat(F.lit("commit="), "commit") == name).alias("fresh"), "commit")).alias("f"))
    return first.select(*keys, "f.*", (~F.col("c.fresh")).alias("hit"))


def run_table(frames: DataFrame, bones: list[tuple[int, int]], cutoff: float | None = None, anchor: str | None = "median", raw: DataFrame | None = None) -> DataFrame:
    """(run, t, joints array<struct<x, y, conf, [r]>>) of frames(run, t, joints) at 25 a second: smoothed below ``cutoff`` Hz, with r, the foreshortening of the bone that ends in a joint.

    r is judged on ``raw`` (run, t, joints, [fps]) as it was before smoothing, by default on frames themselves; raw frames of
    another rate are brought to 25. It is 1 where raw has no such frame. Without an anchor joints have no r.
    """
    long = pose.long_frames(frames)
    if cutoff:
        long = pose.lowpass(long, 25.0, cutoff)
    point = [F.col(c) for c in ("j", "x", "y", "conf")]
    if anchor is not None:
        before = frames if raw is None else raw
        ratios = pose.fore_ratios(before.select("run", "t", "joints"), bones, anchor)
        if "fps" in before.columns:
            ratios = pose.resample_clamped(ratios.join(before.groupBy("run").agg(F.first("fps").alias("fps")), "run"), ["r"]).select("run", "t", "j", "r")
        long = long.join(ratios, ["run", "t", "j"], "left").withColumn("r", F.coalesce("r", F.lit(1.0)))
        point.append(F.col("r"))
    whole = long.groupBy("run", "t").agg(F.array_sort(F.collect_list(F.struct(*point))).alias("joints"))
    return whole.select("run", "t", F.transform("joints", lambda p: p.dropFields("j")).alias("joints"))


def cached_runs(frames: DataFrame, path: str, bones: list[tuple[int, int]], cutoff: float | None = None, anchor: str | None = "median") -> DataFrame:
    """``run_table`` of every run of frames, with ``hit``: runs that were computed before under the same settings are read, only the others are computed.

    Settings have a folder each; a run is cached as a whole, by the first whole commit that holds it.
    """
    spark, home = frames.sparkSession, f"{path}/cutoff={cutoff or 0:g},anchor={anchor}"
    held = committed(spark, home)
    missing = frames if held is None else frames.join(held.select("run").distinct(), "run", "left_anti")
    name = f"commit={uuid.uuid4().hex}"
    if not missing.isEmpty():
        run_table(missing, bones, cutoff, anchor).write.mode("errorifexists").parquet(f"{home}/{name}")
    now = committed(spark, home)
    if now is None:
        return run_table(frames, bones, cutoff, anchor).withColumn("hit", F.lit(False))
    wanted = now.join(frames.select("run").distinct(), "run", "left_semi")
    fresh = F.concat(F.lit("commit="), "commit") == name
    first = wanted.groupBy("run").agg(F.min(F.struct(fresh.alias("fresh"), "commit")).alias("c")).select("run", "c.commit", (~F.col("c.fresh")).alias("hit"))
    return wanted.join(first, ["run", "commit"]).select("run", "t", "joints", "hit")
