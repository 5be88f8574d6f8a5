"""Steps whose cost has to grow with the rows, not with their square or with what they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake import catalog
from kinelake.operators import augment, networks, people, pose, probes, tracks
from kinelake.runtime import table
from kinelake.sources import views

SF = "/root/testdata/sf0.001"


def test_frames_meet_segments_of_any_length(spark):
    """A segment isn't opened to its frame numbers: one of two billion costs no more than its blocks."""
    frames = spark.createDataFrame([(r, t, t % 2 == 0) for r in (1, 2) for t in range(600)], "run int, t int, flag boolean")
    spans = [(1, 0, 0, 2_147_483_000), (1, 1, 255, 257), (1, 2, 255, 256), (1, 3, 256, 513), (1, 4, 7, 7), (2, 0, -5, 3), (2, 1, 1, 600), (3, 0, 0, 9)]
    segments = spark.createDataFrame(spans, "run int, seg_idx int, a int, b int")
    got = people.frames_in_segments(frames, segments)
    assert got.columns == ["run", "t", "seg_idx", "flag"]
    want = sorted((r, t, s, t % 2 == 0) for r, s, a, b in spans if r < 3 for t in range(max(a, 0), min(b, 600)))
    assert sorted(map(tuple, got.collect())) == want


def test_nearest_fill_reads_no_row_for_every_row(spark):
    """No frame that shrinks towards the end (Spark reads such a one anew for every row), and the same results."""
    values = [None, None, 3.0, None, None, None, 7.0, None, 8.0, None]
    rows = spark.createDataFrame([(1, t, v) for t, v in enumerate(values)] + [(2, t, None) for t in range(3)], "run int, t int, v double")
    got = pose.nearest_fill(rows, "v")
    assert "currentrow$(), unboundedfollowing$()" not in got._jdf.queryExecution().analyzed().toString().lower()
    seen = [t for t, v in enumerate(values) if v is not None]
    want = {(1, t): values[min(seen, key=lambda s: (abs(s - t), s))] for t in range(len(values))} | {(2, t): None for t in range(3)}
    assert {(r.run, r.t): r.filled for r in got.collect()} == want


def test_resample_of_a_long_run(spark):
    """60,000 frames: places times frames are beyond 32 bits, and all output frames are there, also those from 10,000 on."""
    n = 60_000
    rows = spark.range(n).select(F.lit(1).alias("run"), F.lit(0).alias("j"), F.col("id").cast("int").alias("t"), *[F.col("id").cast("double").alias(c) for c in ("x", "y", "conf")])
    got = pose.resample(rows, 29.97)
    last = round((n - 1) * 25 / 29.97)
    r = got.agg(F.count("*").alias("n"), F.countDistinct("t").alias("d"), F.max("t").alias("last"), F.max(F.abs(F.col("x") - F.col("t").cast("double") * (n - 1) / last)).alias("off")).first()
    assert (r.n, r.d, r.last) == (last + 1, last + 1, last) and r.off < 1e-6


def test_losses_are_drawn_once(spark):
    """A loss's place is one digest, not one for each frame that it might be; results by the definition, from the same draws."""
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 76 + 1).cast("int").alias("n"))
    key = [F.col("id")]
    losses = augment.draw(F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)), *key, F.lit("n"))
    happens = (F.col("n") > 1) & (augment.uniform(0.0, 1.0, *key, F.lit("happens")) < 0.5)
    ats = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda k: (augment.draw(F.col("n") - 1, *key, F.lit("at"), k) + 1).cast("int"))
    got = rows.select("n", augment.kept_frames(F.col("n"), F.col("id")).alias("kept"), losses.alias("losses"), happens.alias("happens"), F.when(F.col("n") > 1, ats).alias("ats"))
    some = 0
    for r in got.collect():
        want = list(range(r.n))
        for at in r.ats[: r.losses] if r.happens else ():
            want[at] = want[at - 1]
            some += 1
        assert r.kept == want
    assert some > 100
    plan = rows.select(augment.kept_frames(F.col("n"), F.col("id")).alias("kept"))._jdf.queryExecution().optimizedPlan().toString()
    parts = plan.split("sequence(0, ")  # what is folded, the fold, what stands without losses
    assert len(parts) == 3 and "md5" in parts[0] and "md5" not in parts[1]


def test_no_window_is_dealt_by_its_class(spark):
    """Five classes would be five tasks: labels are sent to the runs, and segments get their class before windows are made of them."""
    segments = spark.createDataFrame([(1, 0, 0, 200), (2, 0, 10, 60), (3, 0, 5, 80)], "run int, seg_idx int, a int, b int")
    runs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "run int, conductor string")
    labels = spark.createDataFrame([("x", 0), ("z", 1)], "conductor string, y int")
    got = augment.eval_items(segments, runs, labels, 75, 8)
    want = sorted((1, s, 0, "1" * 75) for s in (0, 42, 83, 125)) + [(2, 10, -1, "1" * 50 + "0" * 25), (3, 5, 1, "1" * 75)]
    assert sorted((r.run, r.start, r.y, r.mask) for r in got.collect()) == want
    for made in (got, augment.train_windows(segments, runs, labels, 75, 2)):
        assert "hashpartitioning(conductor" not in made._jdf.queryExecution().executedPlan().toString()


def test_rocket_features_go_out_in_blocks(spark):
    """A worker holds the features of a block, not of a batch; every window comes out once, with the features it has alone."""
    drawn = np.random.default_rng(3).normal(size=(50, 2, 40))
    windows = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(drawn)], "run int, start int, x array<array<double>>").coalesce(1)
    model = tracks.fit_rocket(windows, 500)
    got = {r.start: r.ppv for r in tracks.rocket_features(windows, model, block=7).collect()}
    assert sorted(got) == list(range(50))
    assert all(np.array_equal(got[i], tracks.ppv(drawn[i], model)) for i in range(50))


def test_runs_are_scored_by_one_worker_a_task(spark, tmp_path):
    """Network, encoder and head of a stored state are one step on the workers."""
    random = np.random.default_rng(1)
    weights = networks.residual_weights(np.eye(2), 3, 2, widths=(4,), strides=(1,), embed=8)
    state = weights | {"encoder": random.normal(size=(8, 4)), "classes.w": random.normal(size=(4, 2)), "classes.b": np.zeros(2)}
    networks.to_table(spark, state).write.parquet(f"{tmp_path}/state")
    x = random.normal(size=(20, 6 * 2 * 3))
    windows = spark.createDataFrame([(1, i, 6, v.tolist()) for i, v in enumerate(x)], "run int, start int, real int, x array<double>")
    scored = networks.score_runs(windows, f"{tmp_path}/state", 2, 6)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    u = networks.residual_embedding(x.reshape(20, 6, 2, 3), np.full(20, 6), weights) @ state["encoder"]
    want = networks.softmax(networks.dense(u / np.sqrt((u**2).sum(1, keepdims=True)), state, "classes"))
    got = {r.start: r.p for r in scored.collect()}
    assert len(got) == 20 and all(np.allclose(got[i], want[i]) for i in range(20))


def test_probes_use_all_cores(spark, monkeypatch):
    """Rows that come in one partition are dealt before the many passes over them."""
    seen = []
    fit = probes.Pipeline.fit
    monkeypatch.setattr(probes.Pipeline, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    rows = spark.createDataFrame([([float(i % 2), float(i)], i % 2) for i in range(400)], "features array<double>, y int").coalesce(1)
    probes.fit_classes(rows, (3,), max_iter=3, part_rows=40)
    assert seen == [spark.sparkContext.defaultParallelism]


@pytest.mark.parametrize("name", ["edge_crop", "mirror_crop"])
def test_crops_are_spread_by_what_they_write(spark, monkeypatch, name):
    """75 rows a segment: the tasks that write them are as many as the segments ask for, not as what is read of these, and all segments are there."""
    monkeypatch.setattr(views, "SEGMENTS_A_TASK", 100, raising=False)
    places = catalog.queries()[name](spark, SF).withColumn("task", F.spark_partition_id())
    tasks = [r.n for r in places.where("k = 0").groupBy("task").agg(F.count("*").alias("n")).collect()]
    segments = table(spark, SF, "lineitem").count()
    assert sum(tasks) == segments > 5000 and max(tasks) < 250
    assert places.count() == 75 * segments
