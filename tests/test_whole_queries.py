"""Queries that cover every joint, step and row."""

import pytest
from pyspark.sql import functions as F

from kinelake import catalog
from kinelake.sources import views as v

SF = "/root/testdata/sf0.001"
Q = catalog.queries()


@pytest.mark.parametrize("name", ["lowpass", "nearest_fill", "moving_average", "body_aligned"])
def test_every_joint_of_every_frame(spark, name):
    frames = v.v_frames(spark, SF)
    assert Q[name](spark, SF).count() == frames.select(F.sum(F.size("joints"))).first()[0]


def test_resample_has_every_joint(spark):
    per = Q["resample_25"](spark, SF).groupBy("run", "t").agg(F.countDistinct("j").alias("n"))
    assert {r.n for r in per.select("n").distinct().collect()} == {21}


@pytest.mark.parametrize("name", ["motion_basic", "motion_spectral"])
def test_both_wrists_of_every_run(spark, name):
    want = {(r.run, j) for r in v.v_frames(spark, SF).select("run").distinct().collect() for j in (9, 10)}
    assert sorted((r.run, r.j) for r in Q[name](spark, SF).select("run", "j").collect()) == sorted(want)


def test_every_step_is_padded_or_kept(spark):
    signal = v.v_signal(spark, SF)
    got = Q["padded_steps"](spark, SF)
    assert got.where("mask = 1").count() == signal.count()
    assert got.where("mask = 1").agg(F.max("i")).first()[0] == signal.agg(F.max("t")).first()[0] >= 40


def test_review_queue_has_every_pending_row(spark):
    n = v.v_ledger(spark, SF, True).where("verdict = ''").count()
    got = Q["review_queue"](spark, SF).orderBy("position").collect()
    assert n > 100 and [r.position for r in got] == list(range(1, n + 1))
