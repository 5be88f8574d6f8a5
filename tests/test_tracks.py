"""What SQL can't express, against brute force: convolutions, lost frames, sessions, diverse picks, folds, probes, and sources outside the tables."""

import hashlib
import json
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinelake import catalog
from kinelake.functions import text
from kinelake.operators import augment, curation, evaluate, identity, people, probes, sessions, tracks
from kinelake.sources import listings, packs
from kinelake.sources import views as v

SF = "/root/testdata/sf0.001"
Q = catalog.queries()


def test_convolutions_as_brute_force(spark):
    x = tracks.track_windows(v.v_frames(spark, SF), (9, 10), 40, 20)
    model = tracks.fit_rocket(x, 1000, seed=3)
    assert model.dilations == tracks.dilations_for(40) == [1, 2] and model.biases[0].shape == (84, 6)
    assert set(model.channels.sum(1).astype(int)) == {1, 2, 3, 4}
    frames = {(r.run, r.t): [r.joints[j][c] for j in (9, 10) for c in ("x", "y")] for r in v.v_frames(spark, SF).collect()}
    rows = {(r.run, r.start): r for r in tracks.rocket_features(x, model).collect()}
    last = {run: max(t for q, t in frames if q == run) for run, _ in frames}
    assert set(rows) == {(run, s) for run in last for s in range(0, last[run] - 38, 20)}
    for key in sorted(rows)[:3]:
        w = np.array([frames[key[0], key[1] + i] for i in range(40)]).T
        assert np.allclose(w, {(r.run, r.start): r.x for r in x.collect()}[key])
        want = []
        for d, biases in zip(model.dilations, model.biases):
            for k, high in enumerate(tracks.HIGH.tolist()):
                weights = [2.0 if i in high else -1.0 for i in range(9)]
                signal = w[model.channels[k] > 0].sum(0)
                out = np.array([sum(weights[i] * signal[t + i * d] for i in range(9)) for t in range(40 - 8 * d)])
                want += [(out > b).mean() for b in biases[k]]
        assert np.abs(np.array(rows[key].ppv) - want).max() <= 1.5 / 24
        assert np.isclose(rows[key].ppv, want).mean() > 0.99  # a response may equal a bias but for rounding


def test_dilations_leave_half_the_length():
    assert tracks.dilations_for(9) == [1] and tracks.dilations_for(75) == [1, 2, 4] and all(8 * d <= 250 for d in tracks.dilations_for(500))


def _u(digits, *key):
    return int(hashlib.md5(":".join(["17", *map(str, key)]).encode()).hexdigest()[:digits], 16) / 16**digits


def test_lost_frames_as_brute_force(spark):
    rows = spark.range(200).select("id", (F.col("id") % 60 + 1).alias("n"))
    changed = 0
    for r in rows.select("id", "n", augment.kept_frames(F.col("n"), F.col("id")).alias("k")).collect():
        want = list(range(r.n))
        if r.n > 1 and _u(13, r.id, "happens") < 0.5:
            for k in range(1, int(_u(8, r.id, "n") * max(1, int(r.n * 0.1))) + 1):
                at = int(_u(8, r.id, "at", k) * (r.n - 1)) + 1
                want[at] = want[at - 1]
        assert r.k == want
        changed += want != list(range(r.n))
    assert changed > 20


def test_train_windows_as_brute_force(spark):
    drawn = {(r.run, r.draw): r for r in augment.random_windows(v.v_segments(spark, SF).where("b - a >= 38"), 75, 2).collect()}
    got = Q["train_windows"](spark, SF).collect()
    assert got and {r.y for r in got} == {0, 1, 2}
    for r in got[:200]:
        d = drawn[r.run, r.draw]
        frames = [int(x) for x in r.frames.split(",")]
        assert (r.start, r.real_len) == (d.start, d.real_len) == (r.start, len(frames)) and all(0 <= f - r.start < r.real_len for f in frames)


def test_fuzzy_sessions_as_brute_force(spark):
    titles = ["Beethoven: Symphony No. 5", "beethoven symphony no 5 live", "Symphony No. 5", "Mahler: Symphony No. 5", "Symphony No. 7", "", "beethoven symphony 5 berlin", "Symphony No. 5", "symphony 5 of ludwig", "Ouverture"]
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(titles)] + [("d", 20, titles[0])], "conductor string, video_id long, title string")
    got = {(r.conductor, r.video_id): r.session for r in sessions.sessions(df, sessions.title_edges(df, 0.7)).collect()}
    facts = {r.video_id: (r.n, r.k, set(r.c)) for r in df.select("video_id", text.normalize_title(F.col("title")).alias("n"), text.work_numbers(F.col("title")).alias("k"), text.composer_set(text.normalize_title(F.col("title"))).alias("c")).collect()}
    low = {i: i for i in range(len(titles))}
    for _ in titles:
        for i in low:
            for j in low:
                (a, ka, ca), (b, kb, cb) = facts[i], facts[j]
                if i < j and a and b and ka == kb and not (ca and cb and not ca & cb) and SequenceMatcher(None, a, b).ratio() >= 0.7:
                    low[i] = low[j] = min(low[i], low[j])
    assert got == {("c", i): s for i, s in low.items()} | {("d", 20): 20}


def test_ratio_bound_is_a_bound(spark):
    words = ["abc def", "abd", "", "zz", "symphony five", "five symphonies", "aab", "baa"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", text.ratio_bound(F.col("a"), F.col("b")).alias("bound"))
    assert all(r.bound >= SequenceMatcher(None, r.a, r.b).ratio() - 1e-12 for r in df.collect())


def test_diverse_picks_as_brute_force(spark):
    faces = v.v_faces(spark, SF).withColumn("score", (F.col("vec_id") * 37 % 101) / 100.0)
    got = {}
    for r in identity.select_diverse(faces, 8, 0.2).collect():
        got.setdefault(r.conductor, []).append((r.rank, r.vec_id))
    held = {}
    for r in faces.where("score >= 0.2").collect():
        x = np.array(r.emb)
        held.setdefault(r.conductor, []).append((-r.score, r.vec_id, x / np.linalg.norm(x)))
    for conductor, members in held.items():
        members.sort(key=lambda m: m[:2])
        taken = [members[0]]
        while len(taken) < min(8, len(members)):
            near = [(max(float(m[2] @ t[2]) for t in taken), i) for i, m in enumerate(members) if m[1] not in {t[1] for t in taken}]
            near = [x for x in near if x[0] < 0.95]
            if not near:
                break
            taken.append(members[min(near)[1]])
        assert [i for _, i in sorted(got[conductor])] == [t[1] for t in taken]


@pytest.mark.parametrize("groups", [3, 40, 12_000])
def test_folds_keep_groups_whole_and_classes_even(spark, groups):
    rows = spark.range(groups).select(F.col("id").alias("group"), F.explode(F.sequence(F.lit(0), (F.col("id") % 3).cast("int"))).alias("i")).withColumn("y", ((F.col("group") + F.col("i")) % 4).cast("string"))
    folds = evaluate.stratified_group_folds(rows, 5)
    assert folds.count() == folds.select("group").distinct().count() == groups
    again = evaluate.stratified_group_folds(rows.repartition(3), 5)
    assert folds.exceptAll(again).isEmpty()
    per = rows.join(folds, "group").groupBy("fold", "y").count().collect()
    if groups > 5:
        for y in "0123":
            n = [r["count"] for r in per if r.y == y]
            assert len(n) == 5 and max(n) - min(n) <= 4


def test_probes_learn_what_separates(spark):
    rng = np.random.default_rng(5)
    rows = [("c", int(i), [float(z) for z in rng.normal(0, 0.3, 3) + (2 * np.eye(3)[i % 3])], int(i % 3)) for i in range(150)]
    df = spark.createDataFrame(rows, "conductor string, video_id long, features array<double>, y int")
    for hidden in (None, (8,)):
        report = probes.fold_report(probes.class_probabilities(probes.fit_classes(df.where("video_id < 100"), hidden), df.where("video_id >= 100"))).first()
        assert report.win_n == report.rec_n == 50 and report.win_acc > 0.9 and report.win_macro > 0.9 and report.rec_correct > 45
    scored = spark.createDataFrame([("c", 1, 0, [0.6, 0.4]), ("c", 1, 0, [0.1, 0.9]), ("c", 2, 1, [0.5, 0.5])], "conductor string, video_id long, y int, p array<double>")
    assert tuple(probes.fold_report(scored).first()) == (3, 1 / 3, 0.25, 2, 0)
    assert Q["linear_head"](spark, SF).first().win_n == 100


def test_out_of_fold_probabilities_are_of_the_other_folds(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i // 4), int(i % 2), [float(i % 2) * 2 + float(rng.normal(0, 0.3)), float(rng.normal())]) for i in range(120)]
    found = probes.oof_probabilities(spark.createDataFrame(rows, "group long, y int, features array<double>"), 3)
    assert found.count() == 120 and found.groupBy("group").agg(F.countDistinct("fold").alias("n")).where("n <> 1").isEmpty()
    assert evaluate.era_auc(found.select(F.lit(1).alias("k"), F.col("y").alias("yr"), F.col("p").alias("score")), "k", 1).first().auc > 0.95


def test_packs_and_notes(spark, tmp_path):
    runs = {"a": np.arange(12.0).reshape(2, 2, 3), "b": np.zeros((0, 2, 3)), "c": np.ones((1, 2, 3))}
    np.savez(tmp_path / "von_k_1.npz", a=runs["a"], b=runs["b"])
    np.savez(tmp_path / "von_k_2.npz", c=runs["c"])
    note = {"qc": {"fps": 50.0, "n_frames": 2, "kept_frames": 2, "segments": [[0, 200], [300, 310]]}, "meta": {"video_id": "v", "source_clip": "v(01).mp4"}}
    (tmp_path / "meta_von_k.json").write_text(json.dumps({"a": note, "b": note, "c": note | {"qc": None}}))
    frames, notes = packs.read_packs(spark, str(tmp_path)), packs.read_notes(spark, str(tmp_path))
    got = {(r.conductor, r.run, r.t): [tuple(p) for p in r.joints] for r in packs.unpacked(frames, notes).collect()}
    assert got == {("von_k", k, t): [tuple(p) for p in x[t]] for k, x in runs.items() for t in range(len(x))}
    with pytest.raises(Exception, match="no notes"):
        packs.unpacked(frames, notes.where("run <> 'a'")).collect()
    assert [tuple(r) for r in packs.third_party(notes, "von_k", 75).orderBy("run").collect()] == [("von_k", "v", k, 50.0, 0, 0, 100) for k in "ab"]


def test_registries(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"name": "a", "queries": ["q"]}, {"name": "b", "aliases": ["bb"], "min_duration_s": 5, "reference_faces": "x"}]))
    rows = {r.name: r for r in packs.read_registry(spark, str(path)).collect()}
    assert (rows["a"].aliases, rows["a"].min_duration_s, rows["a"].max_duration_s, rows["a"].reference_faces) == (["a"], 120, 4800, "data/reference_faces/a")
    assert (rows["b"].aliases, rows["b"].min_duration_s, rows["b"].reference_faces) == (["bb"], 5, "x") and packs.read_registry(spark, str(path), "b").count() == 1
    with pytest.raises(ValueError):
        packs.read_registry(spark, str(path), "z")
    path.write_text(json.dumps({"a": {"v1": {"piece": "p", "type": "full"}}, "b": {"v2": {"piece": "p", "type": "doc"}}}))
    with pytest.raises(ValueError):
        packs.read_registry(spark, str(path))
    assert {tuple(r) for r in packs.read_repertoire(spark, str(path)).collect()} == {("a", "v1", "p", "full"), ("b", "v2", "p", "doc")}


def test_verdict_errors(spark):
    ledger = spark.createDataFrame([("c", "r", "", "")], "conductor string, run string, verdict string, judged_at string")
    given = lambda run, verdict: spark.createDataFrame([("c", run, verdict)], "conductor string, run string, verdict string")
    assert [tuple(r) for r in curation.record_verdicts(ledger, given("r", "accept"), F.lit("now")).collect()] == [("c", "r", "accept", "now")]
    for run, verdict, why in (("r", "maybe", "invalid verdict"), ("r", None, "invalid verdict"), ("q", "accept", "no such run")):
        with pytest.raises(Exception, match=why):
            curation.record_verdicts(ledger, given(run, verdict), F.lit("now")).collect()
    clips = spark.createDataFrame([("v", "1", "", "x")], "video_id string, clip_num string, verdict string, crops string")
    assert [tuple(r) for r in curation.record_clip_verdicts(clips, spark.createDataFrame([(" v", "01", "hold", None)], clips.schema)).collect()] == [("v", "1", "hold", "")]
    with pytest.raises(Exception, match="no such clip"):
        curation.record_clip_verdicts(clips, spark.createDataFrame([("w", "01", "hold", None)], clips.schema)).collect()


def test_small_rules(spark):
    lines = spark.createDataFrame([('{"id": "", "title": "t"}',), ('{"id": "a"}',), ('{"id": "b", "channel": "", "uploader": "u"}',), ("{",), ("",)], "l string")
    assert [tuple(r)[:2] + (r.channel,) for r in listings.parsed(lines, F.col("l")).collect()] == [("a", "", ""), ("b", "", "u")]
    flags = spark.createDataFrame([(1, None), (2, True), (2, True), (2, False)], "k int, f boolean")
    got = {r.k: (r.s, r.c) for r in flags.groupBy("k").agg(people.flag_share(F.col("f")).alias("s"), people.shot_is_conductor(F.col("f"), 0.5, 2).alias("c")).collect()}
    assert got == {1: (0.0, False), 2: (2 / 3, True)}
    one = spark.range(1).select(identity.decide(F.lit(0.3), None, F.lit(None).cast("double"), F.lit(0.9), identity_enabled=False).alias("d")).first().d
    assert tuple(one) == ("accept", "frontal=0.30(accept);id=off;crop=0.90(accept)")
    years = [("recorded op 1985", None, 1985), ("op 1985-03-04", None, None), ("live 1990", None, 1990), ("live 1990", 1980, None), ("live 2030", 0, None)]
    df = spark.createDataFrame([(t, y) for t, y, _ in years], "t string, y int")
    assert [r.g.year for r in df.select(text.year_ranked(F.col("t"), F.col("y"), F.lit(2026)).alias("g")).collect()] == [w for _, _, w in years]
    with pytest.raises(ValueError):
        from kinelake.operators import pose

        pose.channels(v.v_frames(spark, SF), "body", ("pos", "depth"))


def test_ledger_kept_by_a_stream(spark, tmp_path):
    from kinelake.streaming import events

    spark.createDataFrame([("c", "r", "", ""), ("c", "q", "", "")], "conductor string, run string, verdict string, judged_at string").write.parquet(f"{tmp_path}/ledger")
    schema = "conductor string, run string, verdict string, at long"
    for batch in ([("c", "r", "accept", 1), ("c", "r", "reject", 2)], [("c", "q", "hold", 3)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
        events.keep_ledger(spark.readStream.schema(schema).parquet(f"{tmp_path}/changes"), f"{tmp_path}/ledger", f"{tmp_path}/state", "now")
    kept = {(r.run, r.verdict, r.judged_at) for r in spark.read.parquet(f"{tmp_path}/ledger_1").collect()}
    assert kept == {("r", "reject", "now"), ("q", "hold", "now")}
