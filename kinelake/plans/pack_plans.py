"""Queries on packs, cached run tables and padded windows, and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinelake.operators import pose
from kinelake.plans.pose_plans import _B, _CHANNELS, _RATIO, _W, TREE, _lp
from kinelake.runtime import checkpoint_dir
from kinelake.sources import packs
from kinelake.sources import views as v
from kinelake.sources.cache import cached_runs
from kinelake.sources.views import duck

#: Frames of a window that is padded, and the least length of a third party's segment.
LENGTH, LEAST = 20, 38


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}_{uuid.uuid4().hex}"


def packs_by_run(spark, d):
    """All frames written as packs, a pack per conductor and task, and read back run by run."""
    frames = v.v_frames(spark, d).withColumn("conductor", F.concat(F.lit("of_"), (F.col("run") % 3).cast("string")))
    path = _folder(spark, "packs")
    packs.write_packs(frames, path, 4)
    p = F.posexplode("joints").alias("j", "p")
    return packs.read_packs(spark, path).select("conductor", "run", "t", p).select("conductor", "run", "t", "j", "p.x", "p.y", "p.conf")


def third_party_runs(spark, d):
    """Segments of one conductor's runs of two rates, some without quality control."""
    run = F.col("run")
    segments = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "a", "b"))), lambda s: F.array(s["a"].cast("long"), s["b"].cast("long")))
    rows = v.v_segments(spark, d).groupBy("run").agg(segments.alias("segments"))
    qc = F.when(run % 11 != 0, F.struct(F.when(run % 2 == 0, 50.0).otherwise(29.97).alias("fps"), "segments"))
    notes = rows.select(F.concat(F.lit("c"), (run % 3).cast("string")).alias("conductor"), run.cast("string").alias("run"), qc.alias("qc"), F.struct(F.concat(F.lit("v"), (run % 20).cast("string")).alias("video_id")).alias("meta"))
    return packs.third_party(notes, "c1", LEAST)


def run_cache(spark, d):
    """Runs smoothed below 6 Hz with their foreshortening, first the even runs, then all."""
    frames, path = v.v_frames(spark, d), _folder(spark, "runs")
    cached_runs(frames.where("run % 2 = 0"), path, TREE, 6.0)
    found = cached_runs(frames, path, TREE, 6.0).select("run", "t", "hit", F.posexplode("joints").alias("j", "p"))
    return found.select("run", "t", "j", "hit", "p.*").select("run", "t", "j", "hit", *_r("x", "y", "r"))


def padded_channels(spark, d):
    """Windows of 20 frames of every run, the last one padded."""
    t = F.col("t")
    windows = v.v_frames(spark, d).select((F.col("run") * 100000 + F.floor(t / LENGTH)).alias("run"), (t % LENGTH).alias("t"), "joints")
    found = pose.padded_channels(pose.channels(windows, "body"), LENGTH)
    return found.select("run", "t", "j", *_r(*[c for names in pose.BRANCHES.values() for c in names]), "mask")


QUERIES = {f.__name__: f for f in (packs_by_run, third_party_runs, run_cache, padded_channels)}

_FRAMES = f"v_frames AS (SELECT CAST(run * 100000 + t // {LENGTH} AS BIGINT) AS run, CAST(t % {LENGTH} AS INTEGER) AS t, j, x, y, conf FROM v_all), "
_WINDOWS = _W.replace("v_frames AS (", "v_all AS (", 1).replace(", wd AS (", f", {_FRAMES}wd AS (", 1)
_NAMES = [c for names in pose.BRANCHES.values() for c in names]
_AT = "CAST(round_even({c} * (25.0::DOUBLE / fps), 0) AS INTEGER)"
ORACLES = {
    "packs_by_run": duck("v_frames") + " SELECT 'of_' || (run % 3) AS conductor, CAST(run AS VARCHAR) AS run, t, j, x, y, conf FROM v_frames",
    "third_party_runs": duck("v_segments") + f""", s AS (SELECT *, CASE WHEN run % 2 = 0 THEN 50.0::DOUBLE ELSE 29.97::DOUBLE END AS fps FROM v_segments WHERE run % 3 = 1 AND run % 11 <> 0),
m AS (SELECT 'c1' AS conductor, 'v' || (run % 20) AS video_id, CAST(run AS VARCHAR) AS run, fps, seg_idx, {_AT.format(c="a")} AS a, {_AT.format(c="b")} AS b FROM s) SELECT * FROM m WHERE b - a >= {LEAST}""",
    "run_cache": _B + _RATIO + f", lp AS (SELECT run, j, t, {_lp('x')}, {_lp('y')} FROM v_frames WINDOW w AS (PARTITION BY run, j ORDER BY t)) SELECT lp.run, lp.t, lp.j, lp.run % 2 = 0 AS hit, lp.x, lp.y, round(ra.r, 6) AS r FROM lp JOIN ra ON ra.anchor = 'median' AND ra.run = lp.run AND ra.t = lp.t AND ra.j = lp.j",
    "padded_channels": _WINDOWS + _CHANNELS.format(js="0, 5, 6, 7, 8, 9, 10, 11, 12", r="1.0::DOUBLE") + ", e AS (SELECT run, j, max(t) + 1 AS n FROM c2 GROUP BY 1, 2) SELECT run, t, j, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _NAMES)
    + f" , 1 AS mask FROM c2 UNION ALL SELECT run, CAST(range AS INTEGER), j, {', '.join('1.0' if c == 'r' else '0.0' for c in _NAMES)}, 0 FROM e, range({LENGTH}) WHERE range >= n",
}
