"""Queries on both arms' motion, people in frames, training windows and their controls, and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinelake.operators import augment as a
from kinelake.operators import bodies, people, pose, sampling, tracks
from kinelake.operators import windows as w
from kinelake.operators.probes import class_probabilities, fit_classes, fold_report
from kinelake.runtime import table
from kinelake.sources import packs
from kinelake.sources import views as v
from kinelake.sources.views import duck

W, H = 1280, 720


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def _pixels(spark, d):
    j = F.transform("joints", lambda p: F.struct((640 + 900 * p["x"]).alias("x"), (360 + 900 * p["y"]).alias("y"), p["conf"].alias("conf")))
    return v.v_frames(spark, d).select("run", "t", j.alias("joints"))


def view_robust(spark, d):
    return tracks.view_robust(v.v_frames(spark, d)).select("run", *_r(*tracks.ROBUST))


def rich_motion(spark, d):
    found = tracks.rich_motion(v.v_frames(spark, d))
    return found.select("run", *_r(*[c for c in found.columns if c != "run"]))


def minirocket_ppv(spark, d):
    """About 10,000 features of every window of 40 frames of both wrists."""
    x = tracks.track_windows(v.v_frames(spark, d), (9, 10), 40, 20)
    return tracks.rocket_features(x, tracks.fit_rocket(x))


def person_boxes(spark, d):
    return people.person_boxes(_pixels(spark, d), W, H)


def crop_offset(spark, d):
    joints = people.with_crop_offset(F.col("joints"), F.col("t") * 2, F.lit(7))
    return pose.long_frames(v.v_frames(spark, d).withColumn("joints", joints)).select("run", "t", "j", *_r("x", "y", "conf"))


def extract_normalized(spark, d):
    """Spans of 15 frames, one from every tenth frame on, over the whole of each run."""
    starts = F.sequence(F.lit(0), F.max("t").cast("int"), F.lit(10))
    spans = v.v_frames(spark, d).groupBy("run").agg(starts.alias("s")).select("run", F.explode("s").alias("a")).withColumn("b", F.col("a") + 15)
    return pose.long_frames(people.extract_normalized(v.v_frames(spark, d), spans).withColumn("run", F.col("run") * 1_000_000 + F.col("a"))).select("run", "t", "j", *_r("x", "y", "conf"))


def frames_in_segments(spark, d):
    """Signal frames of each run that lie in its segments."""
    return people.frames_in_segments(v.v_signal(spark, d), v.v_segments(spark, d)).groupBy("run", "seg_idx").agg(F.count("*").alias("n"), F.count_if("flag").alias("hits"), F.min("t").alias("first"))


def pick_person(spark, d):
    """Three runs' frames of the same number are the persons of one frame."""
    p = v.v_frames(spark, d).select(F.floor(F.col("run") / 3).cast("int").alias("run"), "t", (F.col("run") % 3).alias("person"), "joints")
    passes = F.get("joints", F.lit(5))["conf"] > 0.6
    return people.pick_person(p, passes).select("run", "t", "person", *_r("score"))


def checked_spans(spark, d):
    """Every third frame was checked."""
    s = v.v_signal(spark, d).where("t % 3 = 0").select("run", F.col("t").alias("frame"), "flag")
    return people.spans_of_checked(s, 25.0, 0.2, 0.04)


def shots(spark, d):
    s = v.v_segments(spark, d).select("run", "seg_idx", F.col("a").alias("start_frame"), F.col("b").alias("end_frame"))
    return people.shots_in_seconds(s, F.when(F.col("run") % 2 == 0, 25.0).otherwise(29.97)).select("run", "seg_idx", *_r("start_sec", "end_sec"))


def shot_flags(spark, d):
    s = v.v_signal(spark, d).groupBy("run", F.floor(F.col("t") / 7).alias("shot"))
    return s.agg(F.round(people.flag_share(F.col("flag")), 6).alias("share"), people.shot_is_conductor(F.col("flag"), 0.8, 3).alias("conductor"))


def run_policies(spark, d):
    r = v.v_runs(spark, d)
    score = F.when(F.col("run") % 4 != 0, (F.col("run") % 100) / 100.0)
    return r.select("run", people.can_auto_reject(F.col("verdict"), score).alias("auto"), people.fps_equals(F.col("fps"), 25.0).alias("at25"), people.disk_ok(F.col("n_frames") * (1 << 24)).alias("disk"), F.col("verdict").isin("accept", "reject").alias("judged"))


def masked_joints(spark, d):
    f = v.v_frames(spark, d)
    legs = pose.long_frames(f.withColumn("joints", people.without_legs(F.col("joints")))).withColumn("mask", F.lit("legs"))
    conf = pose.long_frames(f.withColumn("joints", people.without_confidence(F.col("joints")))).withColumn("mask", F.lit("conf"))
    return legs.unionByName(conf).select("mask", "run", "t", "j", *_r("x", "y", "conf"))


def prep_scaled(spark, d):
    return people.prep_scaled(_pixels(spark, d)).select("run", "t", "j", *_r("x", "y", "conf"))


def prep_centred(spark, d):
    f = _pixels(spark, d)
    return people.prep_centred(f, bodies.frame_size(pose.long_frames(f))).select("run", "t", "j", *_r("x", "y", "conf"))


def motion_stats(spark, d):
    f = v.v_faces(spark, d).select("conductor", F.col("vec_id").alias("t"), F.transform("emb", lambda x: x * 255).alias("pixels"))
    return people.motion_stats(f, "conductor", "pixels").select("conductor", *_r("motion_mean", "motion_p90"))


def dropped_segments(spark, d):
    s = v.v_segments(spark, d)
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("conductor"), F.col("o_orderkey").alias("run"))
    return people.dropped_segments(s, runs, s.where("contaminated"))


def edge_crop(spark, d):
    """The source frame of every place of a window of 75 that starts with a segment; its last frame is held."""
    places = v.v_lengths(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(74))))
    return places.select("run", "seg_idx", "k", a.edge_index(F.col("k"), F.col("n")).alias("i"))


def random_frames(spark, d):
    return a.random_frames(v.v_signal(spark, d))


def shuffled_frames(spark, d):
    return a.shuffled(v.v_signal(spark, d).withColumn("from", F.col("t")), ("run",)).select("run", "t", "from")


def noisy_frames(spark, d):
    return a.with_noise(pose.long_frames(v.v_frames(spark, d))).select("run", "t", "j", *_r("x", "y"))


def uniform_waits(spark, d):
    """Waits between videos, and rests after batches."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k, F.round(a.uniform(20.0, 45.0, k, F.lit("wait")), 6).alias("wait_s"), F.round(a.uniform(900.0, 1800.0, k, F.lit("rest")), 6).alias("rest_s"))


def _classes(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("conductor"))
    labels = runs.select("conductor").distinct().where("conductor < '4'").select("conductor", (F.substring("conductor", 1, 1).cast("int") - 1).alias("y"))
    return runs, labels


def train_windows(spark, d):
    return a.train_windows(v.v_segments(spark, d).where("b - a >= 38"), *_classes(spark, d), 75, 2).select("run", "draw", "y", "start", "real_len", F.array_join(F.col("frames").cast("array<string>"), ",").alias("frames"))


def eval_items(spark, d):
    s = v.v_segments(spark, d).where("b - a >= 38")
    return a.eval_items(s, *_classes(spark, d), 75, 8).select("run", "seg_idx", "start", "y", "mask")


def labelled_clips(spark, d):
    k = F.col("p_partkey")
    said = F.element_at(F.array(*map(F.lit, (" Accept", "reject ", "hold", ""))), (k % 4 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.concat(F.lit(" v"), k.cast("string")).alias("video_id"), (k % 120).alias("clip_num"), said.alias("verdict"), F.when(k % 3 == 0, " ").when(k % 3 == 1, "1.0-2.0").alias("crops"))
    return packs.load_labels(rows)


def faces_saved(spark, d):
    """Saved and read back, all conductors."""
    from kinelake.runtime import checkpoint_dir

    path = packs.save_faces(v.v_faces(spark, d), f"{checkpoint_dir(spark)}/faces_{uuid.uuid4().hex}")
    return packs.load_faces(spark, path).groupBy("conductor").agg(F.count("*").alias("n"), F.round(F.sum(F.get("emb", F.lit(0))), 6).alias("x0"))


def _probe(spark, d, hidden):
    """Every fifth vector is scored by what the others teach."""
    f = v.v_faces(spark, d).select("conductor", "video_id", "vec_id", F.col("emb").alias("features"), F.col("conductor").cast("int").alias("y"))
    model = fit_classes(f.where("vec_id % 5 <> 0"), hidden)
    return fold_report(class_probabilities(model, f.where("vec_id % 5 = 0")))


def linear_head(spark, d):
    return _probe(spark, d, None)


def mlp_probe(spark, d):
    return _probe(spark, d, (256, 128))


QUERIES = {f.__name__: f for f in (view_robust, rich_motion, minirocket_ppv, person_boxes, crop_offset, extract_normalized, frames_in_segments, pick_person, checked_spans, shots, shot_flags, run_policies, masked_joints, prep_scaled, prep_centred, motion_stats, dropped_segments, edge_crop, random_frames, shuffled_frames, noisy_frames, uniform_waits, train_windows, eval_items, labelled_clips, faces_saved, linear_head, mlp_probe)}

_WIDE = duck("v_frames") + ", wd AS (SELECT run, t, " + ", ".join(f"max({f}) FILTER (j = {j}) AS {f}{j}" for j in (5, 6, 7, 8, 9, 10) for f in ("x", "y")) + " FROM v_frames GROUP BY run, t), an AS (SELECT *, -atan2(y6 - y5, x6 - x5) AS a FROM wd), al AS (SELECT run, t, " + ", ".join(f"x{j} * cos(a) - y{j} * sin(a) AS x{j}, x{j} * sin(a) + y{j} * cos(a) AS y{j}" for j in (5, 6, 7, 8, 9, 10)) + " FROM an)"


def _elbow(s: int, e: int, h: int) -> str:
    ax, ay, bx, by = f"(x{s} - x{e})", f"(y{s} - y{e})", f"(x{h} - x{e})", f"(y{h} - y{e})"
    return f"acos(least(1.0, greatest(-1.0, ({ax} * {bx} + {ay} * {by}) / (sqrt({ax} * {ax} + {ay} * {ay}) * sqrt({bx} * {bx} + {by} * {by}) + 1e-8))))"


_ARMS = _WIDE + f""", st0 AS (SELECT run, t, x9 AS x_l, y9 AS y_l, x10 AS x_r, y10 AS y_r, {_elbow(5, 7, 9)} AS elbow_l, {_elbow(6, 8, 10)} AS elbow_r, (y5 + y6) / 2 AS mid, abs(x6 - x5) AS width FROM al),
st1 AS (SELECT *, """ + ", ".join(f"{c}_{n} - lag({c}_{n}) OVER w AS d{c}_{n}" for n in "lr" for c in "xy") + " FROM st0 WINDOW w AS (PARTITION BY run ORDER BY t)), st2 AS (SELECT *, " + ", ".join(f"sqrt(dx_{n} * dx_{n} + dy_{n} * dy_{n}) AS s_{n}" for n in "lr") + " FROM st1)"
#: Autocorrelation, spectrum and cross-correlation by their sums.
_SPECTRA = _ARMS + """, ce AS (SELECT run, t, y_l - avg(y_l) OVER (PARTITION BY run) AS a, y_r - avg(y_r) OVER (PARTITION BY run) AS b, count(*) OVER (PARTITION BY run) AS n FROM st2),
xc AS (SELECT p.run, p.t - q.t AS lag, any_value(p.n) AS n, sum(p.a * q.b) AS ab, sum(p.a * q.a) AS aa, sum(p.b * q.b) AS bb FROM ce p JOIN ce q ON p.run = q.run GROUP BY 1, 2),
sd AS (SELECT run, any_value(n) AS n, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM ce GROUP BY run),
xm AS (SELECT xc.run, max(ab / (sa * sb * xc.n + 1e-8)) AS xcorr, abs(arg_min(lag, (-round(ab / (sa * sb * xc.n + 1e-8), 12), lag))) AS lag, max(aa) FILTER (lag >= 3) / max(aa) FILTER (lag = 0) AS autocorr_l, max(bb) FILTER (lag >= 3) / max(bb) FILTER (lag = 0) AS autocorr_r FROM xc JOIN sd ON sd.run = xc.run GROUP BY xc.run),
dt AS (SELECT run, k, n, sum(a * h * cos(u)) AS ca, sum(a * h * sin(u)) AS ga, sum(b * h * cos(u)) AS cb, sum(b * h * sin(u)) AS gb FROM (SELECT run, n, k, a, b, 0.5 - 0.5 * cos(2 * pi() * t / (n - 1)) AS h, 2 * pi() * k * t / n AS u FROM ce, range(1, 200) z(k) WHERE k <= n // 2) GROUP BY 1, 2, 3),
pw AS (SELECT run, k, n, ca * ca + ga * ga AS pa, cb * cb + gb * gb AS pb FROM dt), pk AS (SELECT run, any_value(n) AS n, arg_max(k, pa) AS ka, arg_max(k, pb) AS kb, sum(pa) AS ta, sum(pb) AS tb FROM pw GROUP BY run),
sp AS (SELECT pw.run, sum(pa) FILTER (k BETWEEN ka - 1 AND ka + 1) / any_value(ta) AS spec_l, sum(pb) FILTER (k BETWEEN kb - 1 AND kb + 1) / any_value(tb) AS spec_r, any_value(pk.n)::DOUBLE / any_value(kb) AS period FROM pw JOIN pk ON pk.run = pw.run GROUP BY pw.run)"""


def _rich(n: str) -> str:
    fast = f"s_{n} > 0.25 * (mean_{n} + 1e-8) AND ps_{n} > 0.25 * (mean_{n} + 1e-8)"
    return ", ".join([
        f"round(avg(elbow_{n}), 6) AS elbow_mean_{n}", f"round(stddev_pop(elbow_{n}), 6) AS elbow_std_{n}",
        f"round(coalesce(avg(CASE WHEN {fast} THEN atan2(abs(pdx_{n} * dy_{n} - pdy_{n} * dx_{n}), pdx_{n} * dx_{n} + pdy_{n} * dy_{n}) END), 0), 6) AS turn_{n}",
        f"round(CASE WHEN max(median_{n}) < 1e-8 THEN 1 ELSE avg(CASE WHEN s_{n} < 0.2 * median_{n} THEN 1.0::DOUBLE WHEN s_{n} IS NOT NULL THEN 0 END) END, 6) AS pause_{n}",
        f"round(stddev_pop(dy_{n}) / (stddev_pop(dx_{n}) + stddev_pop(dy_{n}) + 1e-8), 6) AS vertical_{n}",
        f"round(CASE WHEN stddev_pop(s_{n}) < 1e-8 THEN 0 ELSE avg((s_{n} - mean_{n}) ** 3) / stddev_pop(s_{n}) ** 3 END, 6) AS skew_{n}", f"round((avg(y_{n}) - avg(mid)) / (avg(width) + 1e-8), 6) AS height_{n}",
    ])


_U = lambda *key: "CAST('0x' || substr(md5('17:' || " + " || ':' || ".join(key) + "), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE"
_DRAW = lambda n, *key: f"CAST(floor(CAST('0x' || substr(md5('17:' || " + " || ':' || ".join(key) + f"), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE * ({n})) AS BIGINT)"
_PX = duck("v_frames") + ", px AS (SELECT run, t, j, 640 + 900 * x AS x, 360 + 900 * y AS y, conf FROM v_frames)"
_LAB = "lb AS (SELECT o_orderkey AS run, CASE WHEN o_orderpriority < '4' THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 END AS y FROM orders)"
_MA = lambda c: f"(SELECT run, t, avg({c}) AS v FROM (SELECT p.run, p.t, q.{c} FROM fi p, range(-7, 8) o(k) JOIN fi q ON q.run = p.run AND q.t = greatest(0, least(p.last, p.t + k))) GROUP BY run, t)"
_MAP = ", ".join(f"({k}, {j})" for k, s in enumerate(bodies.H36M) for j in s)
_NEXT = "coalesce((SELECT min(s) FROM (SELECT CAST(unnest({0}) AS DOUBLE) AS s) WHERE s >= {1}), {1}, {2})"
ORACLES = {
    "view_robust": _SPECTRA + """, co AS (SELECT run, CASE WHEN stddev_pop(y_l) < 1e-8 OR stddev_pop(y_r) < 1e-8 THEN 0 ELSE corr(y_l, y_r) END AS corr, (max(y_l) - min(y_l)) / ((max(y_l) - min(y_l)) + (max(y_r) - min(y_r)) + 1e-8) AS vrange_ratio, sum(s_l) / (sum(s_l) + sum(s_r) + 1e-8) AS path_ratio,
stddev_pop(s_l) / (avg(s_l) + 1e-8) AS cv_l, stddev_pop(s_r) / (avg(s_r) + 1e-8) AS cv_r, avg(CASE WHEN s_l > mr * (1 + 1e-9) + 1e-8 THEN 1.0::DOUBLE WHEN s_l IS NOT NULL THEN 0 END) AS active_ratio FROM (SELECT *, median(s_r) OVER (PARTITION BY run) AS mr FROM st2) GROUP BY run)
SELECT co.run, """ + ", ".join(f"round({c}, 6) AS {c}" for c in tracks.ROBUST if c != "phase_lag") + ", round(least(lag / (period + 1e-8), 1), 6) AS phase_lag FROM co JOIN xm ON xm.run = co.run JOIN sp ON sp.run = co.run",
    "rich_motion": _ARMS + ", st3 AS (SELECT *, " + ", ".join(f"avg(s_{n}) OVER (PARTITION BY run) AS mean_{n}, median(s_{n}) OVER (PARTITION BY run) AS median_{n}, " + ", ".join(f"lag({c}_{n}) OVER w AS p{c}_{n}" for c in ("dx", "dy", "s")) for n in "lr") + f" FROM st2 WINDOW w AS (PARTITION BY run ORDER BY t)) SELECT run, {_rich('l')}, {_rich('r')} FROM st3 GROUP BY run",
    "person_boxes": f"""{_PX}, b0 AS (SELECT run, t, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (max(x) - min(x)) * 1.7 AS w, (max(y) - min(y)) * 1.7 AS h FROM px WHERE j < 13 AND conf >= 0.3 GROUP BY run, t),
al AS (SELECT DISTINCT run, t, max(t) OVER (PARTITION BY run) AS last FROM px),
ne AS (SELECT al.run, al.t, al.last, (SELECT b0.t FROM b0 WHERE b0.run = al.run ORDER BY abs(b0.t - al.t), b0.t LIMIT 1) AS at FROM al),
fi AS (SELECT ne.run, ne.t, ne.last, coalesce(cx, 640) AS cx, coalesce(cy, 360) AS cy, coalesce(w, 1280) AS w, coalesce(h, 720) AS h FROM ne LEFT JOIN b0 ON b0.run = ne.run AND b0.t = ne.at),
sm AS (SELECT x.run, x.t, x.v AS cx, y.v AS cy, w.v AS w, h.v AS h FROM {_MA('cx')} x JOIN {_MA('cy')} y ON x.run = y.run AND x.t = y.t JOIN {_MA('w')} w ON x.run = w.run AND x.t = w.t JOIN {_MA('h')} h ON x.run = h.run AND x.t = h.t)
SELECT run, t, CAST(trunc(greatest(0, least(1279, cx - w / 2))) AS INTEGER) AS x0, CAST(trunc(greatest(0, least(719, cy - h / 2))) AS INTEGER) AS y0, CAST(trunc(greatest(1, least(1280, cx + w / 2))) AS INTEGER) AS x1, CAST(trunc(greatest(1, least(720, cy + h / 2))) AS INTEGER) AS y1 FROM sm""",
    "crop_offset": duck("v_frames") + " SELECT run, t, j, round(x + t * 2, 6) AS x, round(y + 7, 6) AS y, round(conf, 6) AS conf FROM v_frames",
    "extract_normalized": duck("v_frames") + """, n AS (SELECT run, t, max(x) FILTER (j = 5) AS ax, max(y) FILTER (j = 5) AS ay, max(x) FILTER (j = 6) AS bx, max(y) FILTER (j = 6) AS b_y FROM v_frames GROUP BY run, t), m AS (SELECT *, sqrt((ax - bx) ** 2 + (ay - b_y) ** 2) AS width FROM n)
SELECT CAST(f.run * 1000000 + s.a AS INTEGER) AS run, f.t, j, round((x - (ax + bx) / 2) / CASE WHEN width > 1e-6 THEN width ELSE 1 END, 6) AS x, round((y - (ay + b_y) / 2) / CASE WHEN width > 1e-6 THEN width ELSE 1 END, 6) AS y, round(CASE WHEN width > 1e-6 THEN conf ELSE 0 END, 6) AS conf FROM v_frames f JOIN m ON f.run = m.run AND f.t = m.t JOIN (SELECT run, unnest(range(0, max(t) + 1, 10)) AS a FROM v_frames GROUP BY run) s ON f.run = s.run AND f.t >= s.a AND f.t < s.a + 15""",
    "frames_in_segments": duck("v_signal", "v_segments") + " SELECT s.run, seg_idx, count(*) AS n, count(*) FILTER (flag) AS hits, min(t) AS first FROM v_segments s JOIN v_signal f ON f.run = s.run AND f.t >= s.a AND f.t < s.b GROUP BY 1, 2",
    "pick_person": duck("v_frames") + """, p AS (SELECT run // 3 AS run, t, run % 3 AS person, product(conf) FILTER (j IN (0, 5, 6, 9, 10)) AS score, max(conf) FILTER (j = 5) > 0.6 AS ok FROM v_frames GROUP BY 1, 2, 3)
SELECT run, t, person, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY run, t ORDER BY ok DESC, score DESC, person) = 1""",
    "checked_spans": duck("v_signal") + """, c AS (SELECT run, t AS frame, flag, row_number() OVER (PARTITION BY run ORDER BY t) AS k FROM v_signal WHERE t % 3 = 0), h AS (SELECT *, k - lag(k) OVER (PARTITION BY run ORDER BY k) - 1 > 1 AS cut FROM c WHERE flag), i AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY run ORDER BY k) AS island FROM h)
SELECT run, min(frame) AS a, max(frame) AS b FROM i GROUP BY run, island HAVING max(k) - min(k) + 1 >= 5""",
    "shots": duck("v_segments") + " SELECT run, seg_idx, round(a / CASE WHEN run % 2 = 0 THEN 25.0::DOUBLE ELSE 29.97::DOUBLE END, 6) AS start_sec, round(b / CASE WHEN run % 2 = 0 THEN 25.0::DOUBLE ELSE 29.97::DOUBLE END, 6) AS end_sec FROM v_segments",
    "shot_flags": duck("v_signal") + " SELECT run, CAST(t // 7 AS BIGINT) AS shot, round(avg(flag::INT), 6) AS share, count(*) FILTER (flag) >= 3 AND count(*) FILTER (flag) >= 0.8::DOUBLE * count(flag) AS conductor FROM v_signal GROUP BY 1, 2",
    "run_policies": duck("v_runs") + " SELECT run, verdict = 'reject' AND run % 4 <> 0 AS auto, abs(fps - 25) < 0.05 AS at25, n_frames * 16777216 >= 60 * 1073741824::DOUBLE AS disk, verdict IN ('accept', 'reject') AS judged FROM v_runs",
    "masked_joints": duck("v_frames") + " SELECT 'legs' AS mask, run, t, j, " + ", ".join(f"round(CASE WHEN j BETWEEN 13 AND 16 THEN 0 ELSE {c} END, 6) AS {c}" for c in ("x", "y", "conf")) + " FROM v_frames UNION ALL SELECT 'conf', run, t, j, round(x, 6), round(y, 6), 0 FROM v_frames",
    "prep_scaled": f"""{_PX}, hb AS (SELECT run, t, k AS j, avg(x) AS x, avg(y) AS y, min(conf) AS conf FROM px JOIN (VALUES {_MAP}) m(k, src) ON j = src GROUP BY run, t, k),
b AS (SELECT run, count(*) FILTER (conf <> 0) AS n, min(x) FILTER (conf <> 0) AS lx, max(x) FILTER (conf <> 0) AS hx, min(y) FILTER (conf <> 0) AS ly, max(y) FILTER (conf <> 0) AS hy FROM hb GROUP BY run), s AS (SELECT *, greatest(hx - lx, hy - ly) AS scale FROM b)
SELECT hb.run, t, j, """ + ", ".join(f"round(CASE WHEN n >= 4 AND scale > 0 THEN greatest(-1, least(1, {e})) ELSE 0 END, 6) AS {c}" for c, e in (("x", "2 * ((x - (lx + hx - scale) / 2) / scale - 0.5)"), ("y", "2 * ((y - (ly + hy - scale) / 2) / scale - 0.5)"), ("conf", "conf"))) + " FROM hb JOIN s ON s.run = hb.run",
    "prep_centred": f"{_PX}, z0 AS (SELECT run, max(x) FILTER (conf > 0.3) AS mx, max(y) FILTER (conf > 0.3) AS my FROM px GROUP BY run), z AS (SELECT run, " + _NEXT.format(list(bodies.WIDTHS), "mx", bodies.NO_SIZE[0]) + " AS w, " + _NEXT.format(list(bodies.HEIGHTS), "my", bodies.NO_SIZE[1]) + " AS h FROM z0) SELECT px.run, t, j, round((x - w / 2) / (w / 2), 6) AS x, round((y - h / 2) / (h / 2), 6) AS y, round(conf, 6) AS conf FROM px JOIN z ON z.run = px.run",
    "motion_stats": duck("v_faces") + """, f AS (SELECT conductor, vec_id AS t, list_transform(emb, lambda x: x * 255) AS p FROM v_faces), g AS (SELECT *, lag(p) OVER (PARTITION BY conductor ORDER BY t) AS q FROM f), e AS (SELECT conductor, list_avg(list_transform(list_zip(p, q), lambda z: abs(z[1] - z[2]))) AS d FROM g WHERE q IS NOT NULL)
SELECT conductor, round(avg(d), 6) AS motion_mean, round(quantile_cont(d, 0.9), 6) AS motion_p90 FROM e GROUP BY conductor""",
    "dropped_segments": duck("v_segments") + " SELECT o_orderpriority AS conductor, count(*) AS segments, count(*) FILTER (contaminated) AS dropped FROM v_segments JOIN orders ON o_orderkey = run GROUP BY 1",
    "edge_crop": duck("v_segments") + " SELECT run, seg_idx, CAST(k AS INTEGER) AS k, CAST(least(k, b - a - 1) AS INTEGER) AS i FROM v_segments, range(75) r(k)",
    "random_frames": duck("v_signal") + """, k AS (SELECT run, t, row_number() OVER (PARTITION BY run ORDER BY md5('17:' || run || ':' || t), t) AS k, count(*) OVER (PARTITION BY run) AS n FROM v_signal)
SELECT run, t, 'train' AS part FROM k WHERE k <= 32 UNION ALL SELECT run, t, 'eval' FROM k, range(8) r(i) WHERE round_even(i * (n - 1)::DOUBLE / 7, 0) = t""",
    "shuffled_frames": duck("v_signal") + ' SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY md5(\'17:\' || run || \':\' || t), t) - 1 AS INTEGER) AS t, t AS "from" FROM v_signal',
    "noisy_frames": duck("v_frames") + " SELECT run, t, j, " + ", ".join(f"round({c} + sqrt(-2.0 * ln(1.0::DOUBLE - {_U('run', 't', 'j', repr(c), repr('a'))})) * cos(2 * pi() * {_U('run', 't', 'j', repr(c), repr('b'))}) * 0.02::DOUBLE, 6) AS {c}" for c in "xy") + " FROM v_frames",
    "uniform_waits": f"SELECT o_orderkey, round(20.0 + {_U('o_orderkey', repr('wait'))} * 25.0, 6) AS wait_s, round(900.0 + {_U('o_orderkey', repr('rest'))} * 900.0, 6) AS rest_s FROM orders",
    "eval_items": duck("v_segments") + f""", {_LAB}, s AS (SELECT run, seg_idx, a, b FROM v_segments WHERE b - a >= 38), win AS (SELECT run, seg_idx, b - a AS n, CASE WHEN b - a - 75 <= 0 OR k = 1 THEN a ELSE a + CAST(round_even(i * ((b - a - 75)::DOUBLE / (k - 1)), 0) AS INTEGER) END AS start FROM (SELECT *, greatest(1, least(8, (b - a - 75) // 38 + 1)) AS k FROM s) x, (SELECT CAST(range AS INTEGER) AS i FROM range(8)) y WHERE i = 0 OR (b - a - 75 > 0 AND i < k))
SELECT win.run, seg_idx, start, coalesce(y, -1) AS y, repeat('1', least(75, n)) || repeat('0', greatest(0, 75 - n)) AS mask FROM win JOIN lb ON lb.run = win.run""",
    "labelled_clips": "SELECT 'v' || p_partkey AS video_id, 'v' || p_partkey || '(' || CASE WHEN p_partkey % 120 < 100 THEN lpad(CAST(p_partkey % 120 AS VARCHAR), 2, '0') ELSE substr(CAST(p_partkey % 120 AS VARCHAR), 1, 2) END || ')' AS stem, CAST(p_partkey % 4 AS INTEGER) AS y, p_partkey % 3 = 1 AS has_crops FROM part WHERE p_partkey % 4 < 2",
    "faces_saved": duck("v_faces") + " SELECT conductor, count(*) AS n, round(sum(emb[1]), 6) AS x0 FROM v_faces GROUP BY 1",
}
