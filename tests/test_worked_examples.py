"""Small cases worked by hand, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kinelake.functions import text
from kinelake.operators import curation, evaluate, features, pose, qc, tracks, windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_titles(spark):
    t = F.lit("Beethoven: Symphony No. 7 - II (1/2)")
    assert one(spark, text.normalize_title(t)) == "beethoven symphony no 7"
    assert one(spark, text.work_numbers(t)) == [7]
    assert one(spark, text.composer_set(F.lit("dvořák no 9"))) == ["dvorák"]


@pytest.mark.parametrize(("title", "year"), [("Live 1989", 1989), ("1985 vs 1986", None), ("1978 remastered", None), ("Remaster 2004 of 1989", 1989), ("1989 - REMASTERED", 1989), ("op. 1812", None)])
def test_strict_year(spark, title, year):
    assert one(spark, text.year_strict(F.lit(title))) == year


def test_years(spark):
    assert one(spark, text.normalize_year_input(F.lit("80s"))) == "1980s"
    assert one(spark, text.normalize_year_input(F.lit("1935s"))) is None
    assert tuple(one(spark, text.bucket_range(F.lit("2000s~20s")))) == (2000, 2029)
    assert tuple(one(spark, text.bucket_range(F.lit("1960s~70s")))) == (1960, 1979)
    assert one(spark, text.video_id(F.lit("A [abcdefghij_] [ABCDEFGHIJK].mp4"))) == "ABCDEFGHIJK"


def test_window_starts(spark):
    starts = lambda a, b: one(spark, windows.window_starts(F.lit(a), F.lit(b), 75, 8))
    assert starts(0, 200) == [0, 42, 83, 125]
    assert starts(10, 50) == [10]
    assert [one(spark, windows.mirror_index(F.lit(i), F.lit(3))) for i in range(-1, 6)] == [1, 0, 1, 2, 1, 0, 1]


def test_clean_segments(spark):
    spikes = lambda at: spark.createDataFrame([(1, t, t in at) for t in range(100)], "run int, t int, spike boolean")
    seg = lambda at: sorted((r.a, r.b) for r in qc.clean_segments(spikes(at)).collect())
    assert seg({30, 60}) == [(0, 30), (30, 60), (60, 100)]
    assert seg({30, 60, 70}) == [(0, 30), (30, 60), (70, 100)]


def test_median3_removes_flicker_and_keeps_steps(spark):
    def smoothed(values):
        df = spark.createDataFrame([(1, t, float(x)) for t, x in enumerate(values)], "run int, t int, x double")
        return [r.m for r in df.select("t", qc.median3(F.col("x")).alias("m")).orderBy("t").collect()]

    assert smoothed([0, 0, 9, 0, 0]) == [0, 0, 0, 0, 0]
    assert smoothed([0, 0, 5, 5, 5]) == [0, 0, 5, 5, 5]
    assert smoothed([3, 1]) == [3, 1]


def test_resample_length_and_ends(spark):
    df = spark.createDataFrame([(1, 0, t, float(t), 0.0, 1.0) for t in range(30)], "run int, j int, t int, x double, y double, conf double")
    out = [r.x for r in pose.resample(df, 30.0).orderBy("t").collect()]
    assert len(out) == round(29 * 25 / 30) + 1
    assert out[0] == 0 and out[-1] == 29


def test_lowpass_of_a_constant_is_the_constant(spark):
    df = spark.createDataFrame([(1, 0, t, 4.0, -2.0, 1.0) for t in range(7)], "run int, j int, t int, x double, y double, conf double")
    assert all(math.isclose(r.x, 4.0) and math.isclose(r.y, -2.0) for r in pose.lowpass(df).collect())


def test_adjacency_is_symmetric_and_whole(spark):
    edges = pose.graph_edges(spark, "both")
    rows = {(r.i, r.j): r.w for r in pose.normalized_adjacency(edges, 51).collect()}
    assert len({i for i, _ in rows}) == 51
    assert all(math.isclose(w, rows[j, i]) for (i, j), w in rows.items())
    assert len(pose.BONES) == 51


def test_merge_keeps_human_verdicts(spark):
    cols = "conductor string, video_id int, run int, source_verdict string, verdict string, preview string, judged_at string"
    new = spark.createDataFrame([("c", 1, 1, "", "", "p", "")], cols)
    old = spark.createDataFrame([("c", 1, 1, "", "accept", "q", "d"), ("c", 1, 2, "", "reject", "", "e"), ("c", 1, 3, "", "", "", "")], cols)
    assert sorted((r.run, r.verdict, r.preview) for r in curation.merge_ledger(new, old).collect()) == [(1, "accept", "p"), (2, "reject", "")]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in curation.components(edges).collect()}
    assert set(got.values()) == {0, 100} and got[40] == 0 and got[101] == 100


def test_rank_statistics(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0), ("b", 1, 6.0)], "g string, yr int, score double")
    rho = {r.g: r.rho for r in evaluate.spearman(rows, "g", "yr", "score").collect()}
    assert math.isclose(rho["a"], 1.0) and rho["b"] is None
    assert {r.g: r.auc for r in evaluate.era_auc(rows, "g", 2).collect()} == {"a": 1.0, "b": None}


def test_folds_keep_groups_whole(spark):
    rows = spark.createDataFrame([(g, g % 3) for g in range(40) for _ in range(g % 4 + 1)], "group long, y long")
    folds = evaluate.stratified_group_folds(rows, 5).collect()
    assert len(folds) == 40 and len({r.group for r in folds}) == 40 and {r.fold for r in folds} == set(range(5))


def test_features_do_not_change_with_scale(spark):
    track = spark.createDataFrame([Row(run=1, t=t, x=math.sin(t / 3), y=math.cos(t / 4) + t % 3) for t in range(60)])
    big = track.select("run", "t", (F.col("x") * 1000).alias("x"), (F.col("y") * 1000).alias("y"))
    for f, names in ((features.speed_features, ("cv", "skew", "pause", "turn")), (features.spectral_features, ("autocorr", "concentration", "period"))):
        a, b = f(track).first(), f(big).first()
        assert all(math.isclose(a[n], b[n], rel_tol=1e-4) for n in names)
    assert tracks.HIGH.shape == (84, 3) and np.isclose(tracks.responses(np.ones((2, 30)), np.ones((84, 2)), 2), 0).all()


def test_capped_windows(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 100), (2, 5)) for i in range(n)], "k int, i int")
    got = [r.i for r in windows.capped(rows, ["k"], ["i"], 8).where("k = 1").orderBy("i").collect()]
    assert got == [round(i * 99 / 7) for i in range(8)]
    assert windows.capped(rows, ["k"], ["i"], 8).where("k = 2").count() == 5


def test_upsert_updates_inserts_and_grows(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B", 9), (3, "C", 8)], "k int, v string, w int")
    assert sorted(tuple(r) for r in curation.upsert(old, new, ["k"]).collect()) == [(1, "a", None), (2, "B", 9), (3, "C", 8)]
