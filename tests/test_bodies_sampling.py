"""Worked examples of the 17-joint kernels, seeded sampling, listings and probes."""

import math
from collections import Counter

from pyspark.sql import functions as F

from kinelake.operators import bodies, probes, sampling
from kinelake.sources import listings

JOINTS = "array<struct<x: double, y: double, conf: double>>"


def test_h36m_takes_means_and_the_least_confidence(spark):
    row = [(float(i), 2.0 * i, 0.9 if i != 12 else 0.2) for i in range(17)]
    got = spark.createDataFrame([(row,)], f"joints {JOINTS}").select(bodies.h36m(F.col("joints")).alias("b")).first().b
    assert len(got) == 17 and tuple(got[0]) == (11.5, 23.0, 0.2) and tuple(got[7]) == (8.5, 17.0, 0.2)
    assert got[9].x == 0 and got[10].x == 3.5 and got[3].x == 16


def test_head_box_is_null_without_a_face_or_when_small(spark):
    base = [(0.0, 0.0, 0.0)] * 17
    face = list(base)
    face[0], face[5], face[6] = (300.0, 200.0, 1.0), (250.0, 300.0, 1.0), (350.0, 300.0, 1.0)
    small = list(face)
    small[6] = (260.0, 300.0, 1.0)
    rows = spark.createDataFrame([(0, base), (1, face), (2, small)], f"i int, joints {JOINTS}")
    got = {r.i: r.b for r in rows.select("i", bodies.head_box(F.col("joints"), 640, 480).alias("b")).collect()}
    assert got[0] is None and got[2] is None
    assert tuple(got[1]) == (190, 68, 410, 288)


def test_crop_scaled_needs_four_points(spark):
    few = [(1, 0, j, float(j), float(j), 1.0) for j in range(3)]
    four = [(2, 0, j, 10.0 * (j % 2), 10.0 * (j // 2), 1.0) for j in range(4)]
    rows = spark.createDataFrame(few + four, "run int, t int, j int, x double, y double, conf double")
    got = {(r.run, r.j): (r.x, r.y) for r in bodies.crop_scaled(rows).collect()}
    assert all(got[1, j] == (0.0, 0.0) for j in range(3))
    assert [got[2, j] for j in range(4)] == [(-1.0, -1.0), (1.0, -1.0), (-1.0, 1.0), (1.0, 1.0)]


def test_frame_size_rounds_up(spark):
    rows = spark.createDataFrame([(1, 700.0, 300.0, 0.9), (1, 5000.0, 1.0, 0.1), (2, 9.0, 9.0, 0.0), (3, 5000.0, 9.0, 1.0)], "run int, x double, y double, conf double")
    got = {r.run: (r.width, r.height) for r in bodies.frame_size(rows).collect()}
    assert got == {1: (854.0, 360.0), 2: (1920.0, 1080.0), 3: (5000.0, 240.0)}


def test_random_windows_stay_inside_and_are_even(spark):
    rows = spark.createDataFrame([(1, 0, 109), (1, 200, 209), (1, 300, 300), (2, 5, 9)], "run int, a int, b int")
    got = sampling.random_windows(rows, 10, 2000).collect()
    one = [r for r in got if r.run == 1]
    assert len(one) == 2000 and all((r.start <= 99 and r.real_len == 10) or (r.start == 200 and r.real_len == 9) for r in one)
    counts = Counter(r.start for r in one)
    assert len(counts) == 101 and max(counts.values()) < 50
    assert {(r.start, r.real_len) for r in got if r.run == 2} == {(5, 4)}
    assert sampling.random_windows(rows, 10, 2000).exceptAll(spark.createDataFrame(got)).count() == 0


def test_round_robin_folds_are_level(spark):
    folds = sampling.round_robin_folds(spark.range(1003), "id", 5).collect()
    assert len(folds) == 1003 and sorted(Counter(r.fold for r in folds).values()) == [200, 200, 201, 201, 201]
    assert sampling.round_robin_folds(spark.range(0), "id", 5).count() == 0


def test_listing_skips_bad_lines(spark):
    lines = ['{"id": "a", "uploader": "u", "duration": 2.5}', "", "{bad", '{"title": "no id"}', '{"id": "b", "channel": "c", "uploader": "u"}', None]
    got = {r.id: (r.channel, r.duration) for r in listings.parsed(spark.createDataFrame([(x,) for x in lines], "line string"), F.col("line")).collect()}
    assert got == {"a": ("u", 2.5), "b": ("c", None)}


def test_probe_learns_and_leaves_groups_out(spark):
    rows = [(g, g % 2, [math.sin(7 * g + i) + 3 * (g % 2), math.cos(5 * g + i)]) for g in range(40) for i in range(5)]
    got = probes.oof_probabilities(spark.createDataFrame(rows, "group int, y int, features array<double>")).collect()
    assert len(got) == 200 and sum((r.p >= 0.5) == (r.y == 1) for r in got) >= 190
    folds = {}
    for r in got:
        assert folds.setdefault(r.group, r.fold) == r.fold


def test_probe_of_one_class_is_constant(spark):
    rows = spark.createDataFrame([(g, 1, [float(g)]) for g in range(10)], "group int, y int, features array<double>")
    assert {r.p for r in probes.oof_probabilities(rows).collect()} == {1.0}
