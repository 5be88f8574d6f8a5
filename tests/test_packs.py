"""Packs as a source and a sink."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake.sources import packs


def _rows(df):
    return {(r.conductor, r.run, r.t): [tuple(j) for j in r.joints] for r in df.collect()}


def test_packs_are_read_run_by_run(spark, tmp_path):
    r = np.random.default_rng(3)
    runs = {f"r{i}": r.random((n, 4, 3)) for i, n in enumerate([1, 0, 7, 600, 30])}
    np.savez(tmp_path / "a_b_1.npz", **{k: runs[k] for k in ("r0", "r1", "r2")})
    np.savez_compressed(tmp_path / "c_2.npz", r3=np.asfortranarray(runs["r3"]), r4=runs["r4"].astype("float32"))
    (tmp_path / "_half_3.npz").write_bytes(b"not whole")
    of = {"r0": "a_b", "r1": "a_b", "r2": "a_b", "r3": "c", "r4": "c"}
    want = {(of[k], k, t): [tuple(p) for p in f] for k, x in runs.items() for t, f in enumerate(x if k != "r4" else x.astype("float32").astype(float))}
    for options in ({}, {"splitBytes": 1, "batchFrames": 5}):
        df = packs.read_packs(spark, str(tmp_path), **options)
        assert _rows(df) == want and df.count() == len(want)
    split = packs.read_packs(spark, str(tmp_path), splitBytes=1)
    assert split.rdd.getNumPartitions() == 5
    assert split.where("run = 'r2'").rdd.getNumPartitions() == 1 and _rows(split.where("run = 'r2'")) == {k: x for k, x in want.items() if k[1] == "r2"}
    assert _rows(split.where("conductor IN ('c') AND t > 590")) == {k: x for k, x in want.items() if k[0] == "c" and k[2] > 590}
    assert split.where("run = 'none'").count() == 0


def test_packs_are_written_whole_or_not_at_all(spark, tmp_path):
    joints = F.array(*[F.struct((F.col("t") * 1.5 + j).alias("x"), F.lit(0.1).alias("y"), F.lit(float(j)).alias("conf")) for j in range(3)])
    frames = spark.range(300).select((F.col("id") % 3).cast("string").alias("conductor"), (F.col("id") % 12).cast("string").alias("run"), F.floor(F.col("id") / 12).cast("int").alias("t")).withColumn("joints", joints)
    path = str(tmp_path / "out")
    packs.write_packs(frames, path, 3)
    assert _rows(packs.read_packs(spark, path)) == _rows(frames)
    packs.write_packs(frames.where("run <> '1'"), path, 2, "overwrite")
    assert _rows(packs.read_packs(spark, path)) == _rows(frames.where("run <> '1'"))
    with pytest.raises(Exception, match="numbered from 0"):
        packs.write_packs(frames.where("t <> 3"), path, 2)
    assert _rows(packs.read_packs(spark, path)) == _rows(frames.where("run <> '1'"))


def test_cached_runs_compute_misses_alone(spark, tmp_path):
    from kinelake.operators import pose
    from kinelake.sources import cache

    r = np.random.default_rng(5)
    rows = [(k, t, [(*map(float, r.random(2)), 1.0) for _ in range(13)]) for k in range(3) for t in range(6 + k)]
    frames = spark.createDataFrame(rows, "run long, t int, joints array<struct<x: double, y: double, conf: double>>")
    bones, path = [(5, 7), (7, 9)], str(tmp_path / "runs")
    want = {(x.run, x.t): x.joints for x in cache.run_table(frames, bones, 6.0).collect()}
    assert {(x.run, x.t) for x in cache.cached_runs(frames.where("run < 1"), path, bones, 6.0).collect()} == {(0, t) for t in range(6)}
    for hits in ({0}, {0, 1, 2}):
        got = cache.cached_runs(frames, path, bones, 6.0).collect()
        assert {(x.run, x.t): x.joints for x in got} == want and len(got) == len(want) and {x.run for x in got if x.hit} == hits
    plain = cache.cached_runs(frames, path, bones, None, None)
    assert plain.where("hit").count() == 0 and "r" not in plain.schema["joints"].dataType.elementType.names
    assert {(x.run, x.t): [tuple(j) for j in x.joints] for x in plain.collect()} == {(k, t): [tuple(j) for j in x] for k, t, x in rows}
    slow = frames.withColumn("fps", F.lit(50.0))
    ratios = {(x.run, x.t): [j.r for j in x.joints] for x in cache.run_table(frames, bones, raw=slow).collect()}
    half = {(x.run, x.t, x.j): x.r for x in pose.resample_clamped(pose.fore_ratios(frames, bones).withColumn("fps", F.lit(50.0)), ["r"]).collect()}
    assert ratios == {(k, t): [half.get((k, t, j), 1.0) for j in range(13)] for k, t in want}


def test_padding_is_neutral(spark):
    from kinelake.operators import pose

    rows = spark.createDataFrame([(1, 0, 5, 2.0, 0.5), (1, 1, 5, 3.0, 0.7), (2, 0, 5, 1.0, 1.0), (2, 1, 5, 1.0, 1.0), (2, 2, 5, 1.0, 1.0), (2, 3, 5, 1.0, 1.0)], "run long, t int, j int, x double, r double")
    for neutral, r in ((True, 1.0), (False, 0.0)):
        got = sorted(tuple(x) for x in pose.padded_channels(rows, 3, neutral=neutral).collect())
        assert got == sorted([(*x, 1) for x in map(tuple, rows.collect())] + [(1, 2, 5, 0.0, r, 0)])
    assert pose.padded_channels(rows.limit(0), 3).count() == 0
