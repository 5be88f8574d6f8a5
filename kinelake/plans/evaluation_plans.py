"""Queries on identity, decisions, evaluation statistics and motion features, and their oracles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators import evaluate as e
from kinelake.operators import features as m
from kinelake.operators import identity as i
from kinelake.operators.pose import long_frames
from kinelake.operators.qc import joint
from kinelake.runtime import ship, table
from kinelake.sources import views as v
from kinelake.sources.views import duck


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def identity_centroids(spark, d):
    return i.centroids(v.v_faces(spark, d)).select("conductor", F.posexplode("centroid").alias("k", "x")).select("conductor", "k", *_r("x"))


def identity_match(spark, d):
    f = v.v_faces(spark, d)
    refs = f.where("vec_id % 5 = 0").select("conductor", "emb").union(i.centroids(f).select("conductor", "centroid"))
    return i.match_scores(f.where("vec_id % 5 <> 0"), refs).select("vec_id", *_r("score"))


def loo_scores(spark, d):
    return i.loo_scores(v.v_faces(spark, d)).select("conductor", "i", *_r("score"))


def dominant_cluster(spark, d):
    return i.dominant_cluster(v.v_faces(spark, d), 0.1)


def cross_video_cluster(spark, d):
    return i.cross_video_cluster(v.v_faces(spark, d), 0.1)


def select_diverse(spark, d):
    ship(spark)
    return i.select_diverse(v.v_faces(spark, d).withColumn("score", (F.col("vec_id") * 37 % 101) / 100.0), 8, 0.2)


def frontal_reasons(spark, d):
    return v.v_frames(spark, d).select("run", "t", F.array_join(i.frontal_reasons(0.6), ";").alias("reasons"))


def hands_in_frame(spark, d):
    f = v.v_frames(spark, d)
    wrists, left, right = F.array(joint(9), joint(10)), F.slice("joints", 11, 5), F.slice("joints", 16, 6)
    inside = lambda j: F.transform(j, lambda p: F.struct((p["x"] + 0.5).alias("x"), (p["y"] + 0.5).alias("y"), p["conf"].alias("conf")))
    return f.select("run", "t", i.in_frame(inside(wrists), 1.0, 1.0).alias("wrists"), i.hand_kept(inside(left), 0.9, 0.9).alias("left"), i.hand_kept(inside(right), 0.9, 0.9).alias("right"))


def shot_decision(spark, d):
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50.0).alias("f"), (F.col("p_partkey") % 7).alias("n"), F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 64) / 100.0).alias("id"), ((F.col("p_partkey") % 21) / 20.0).alias("c"))
    return s.select("p_partkey", i.decide(F.col("f"), F.col("n"), F.col("id"), F.col("c")).alias("x")).select("p_partkey", "x.decision", "x.reasons")


def aggregate_match(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").alias("video_id"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("score"))
    return i.aggregate_match(s, 4).select("video_id", *_r("score"))


def best_identity(spark, d):
    return table(spark, d, "part").select("p_partkey", i.best_index(F.array(F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") % 7), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") % 5), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") % 9))).alias("at"))


def _votes(spark, d):
    w = v.v_votes(spark, d)
    each = [F.get("w", F.lit(k)) for k in range(10)]
    total = sum(each[1:], each[0])
    return w.select("conductor", "video_id", "run", "win", "l_partkey", "l_suppkey", "y", F.array(*[x / total for x in each]).alias("p"))


def recording_vote(spark, d):
    return e.vote(_votes(spark, d).withColumn("y", F.lit(3)), ["conductor", "video_id"], 10).select("conductor", "video_id", "pred")


def run_vote(spark, d):
    return e.vote(_votes(spark, d), ["run"], 10).select("run", "y", "pred", "hit")


def session_vote(spark, d):
    per = e.vote(_votes(spark, d).withColumn("y", F.lit(1)), ["conductor", "video_id"], 10).withColumn("session", F.floor(F.col("video_id") / 3))
    return e.vote(per.select("conductor", "session", "y", "p"), ["conductor", "session"], 10, normalize=True).select("conductor", "session", "pred")


def confusion(spark, d):
    return e.confusion(e.vote(_votes(spark, d), ["run"], 10))


def macro_f1(spark, d):
    s = e.class_scores(e.confusion(e.vote(_votes(spark, d), ["run"], 10)))
    return s.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.avg("recall"), 6).alias("macro_recall"))


def class_scores(spark, d):
    return e.class_scores(e.confusion(e.vote(_votes(spark, d), ["run"], 10))).select("y", *_r("precision", "recall", "f1"))


def window_macro(spark, d):
    hit = _votes(spark, d).select("conductor", "video_id", (e.argmax(F.transform("p", lambda x: F.round(x, 9))) == F.col("y")).cast("double").alias("hit"))
    per = hit.groupBy("conductor", "video_id").agg(F.avg("hit").alias("acc"))
    return per.agg(F.round(F.avg("acc"), 6).alias("win_macro"), F.count("*").alias("recordings"))


def majority_z(spark, d):
    return e.accuracy_against_chance(e.vote(_votes(spark, d), ["run"], 10)).select("n", *_r("acc", "chance", "z"))


def spearman_year(spark, d):
    return e.spearman(v.v_recordings(spark, d), "conductor", "yr", "score").select("conductor", "n", *_r("rho"))


def era_auc(spark, d):
    return e.era_auc(v.v_recordings(spark, d), "conductor", 1998).select("conductor", *_r("auc"))


def conf_era_proxy(spark, d):
    frame = v.v_frames(spark, d).select("run", F.aggregate("joints", F.lit(0.0), lambda s, p: s + p["conf"]).alias("s"))
    return frame.groupBy("run").agg(F.round(F.avg(F.col("s") / 21), 6).alias("conf"), F.round(F.avg((F.col("s") / 21 < 0.6).cast("double")), 6).alias("low"))


def score_quantiles(spark, d):
    q = v.v_recordings(spark, d).groupBy("conductor").agg(F.median("score").alias("mid"), F.percentile("score", F.lit(0.25)).alias("p25"), F.percentile("score", F.lit(0.75)).alias("p75"), F.stddev_pop("score").alias("sd"))
    return q.select("conductor", *[F.round(c, 6).alias(c) for c in ("mid", "p25", "p75", "sd")])


def era_colour(spark, d):
    """Career stage of each recording: its year within its conductor's, 0.5 where that is one year."""
    w = W.partitionBy("conductor")
    lo, hi = F.min("yr").over(w), F.max("yr").over(w)
    return v.v_recordings(spark, d).select("video_id", F.round(F.when(hi > lo, (F.col("yr") - lo) / (hi - lo)).otherwise(0.5), 6).alias("stage"))


def repertoire_matched(spark, d):
    return e.matched_repertoire(v.v_repertoire(spark, d))


def composer_accuracy(spark, d):
    """Per name pattern: rows, accuracy and videos of which all rows hit."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("title"))
    hits = _votes(spark, d).select("l_partkey", "video_id", (e.argmax(F.transform("p", lambda x: F.round(x, 9))) == F.col("y")).alias("hit")).join(t, "l_partkey")
    kind = F.when(F.col("title").rlike("a") & F.col("title").rlike("e"), "both").when(F.col("title").rlike("o"), "o").otherwise("other")
    per = hits.withColumn("kind", kind).groupBy("kind", "video_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.bool_and("hit").alias("whole"))
    return per.groupBy("kind").agg(F.sum("n").alias("n"), F.round(F.sum("hits") / F.sum("n"), 6).alias("acc"), F.count_if("whole").alias("all_correct"))


def _scored(spark, d):
    o = table(spark, d, "orders")
    p = (F.col("o_orderkey") * 7919 % 1000) / 1000.0
    return o.select("o_orderkey", p.alias("p"), F.when(p * 1000 + F.col("o_custkey") % 60 > 900, 1).otherwise(0).alias("y"), (F.col("o_custkey") % 3 == 0).alias("has_crops"))


def calibrate_threshold(spark, d):
    return e.calibrate(_scored(spark, d), 0.9, 20)


def crop_subgroup(spark, d):
    return e.crop_subgroup(_scored(spark, d), 0.5).select("n", "false_reject", F.round("rate", 6).alias("rate"))


def crop_subgroup_uncalibrated(spark, d):
    return e.crop_subgroup(_scored(spark, d), None)


def window_chance(spark, d):
    m = e.confusion(e.vote(_votes(spark, d), ["run"], 10))
    return e.window_chance(m).select("n", *_r("chance", "acc"))


def distinct_counts(spark, d):
    rows = _votes(spark, d).select("conductor", "video_id", "run", F.floor(F.col("video_id") / 3).alias("session"))
    return e.distinct_counts(rows, ["conductor"], {"videos": ["video_id"], "sessions": ["session"], "runs": ["run"]})


def mean_scores(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("conductor"), F.col("o_custkey").alias("video_id"), (F.col("o_orderkey") % 1009).alias("score"))
    return e.mean_scores(o, ["conductor", "video_id"], "score").select("conductor", "video_id", "n", *_r("score"))


def stratified_folds(spark, d):
    r = v.v_recordings(spark, d).select(F.floor(F.col("video_id") / 5).alias("group"), F.col("conductor").alias("y"))
    return e.stratified_group_folds(r, 5)


def pooled_embeddings(spark, d):
    """Mean and maximum of every component per class."""
    x = v.v_faces(spark, d).select("conductor", F.posexplode("emb").alias("k", "x"))
    return x.groupBy("conductor", "k").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.max("x"), 6).alias("max"))


def _wrists(spark, d):
    """Both wrists' frames, ``track`` naming run and joint."""
    return long_frames(v.v_frames(spark, d)).where("j IN (9, 10)").withColumn("track", F.col("run").cast("long") * 32 + F.col("j"))


def _by_wrist(features):
    return features.select(F.shiftright("track", 5).cast("int").alias("run"), (F.col("track") % 32).cast("int").alias("j"), *[c for c in features.columns if c != "track"])


def motion_basic(spark, d):
    found = _by_wrist(m.speed_features(_wrists(spark, d), "track"))
    return found.select("run", "j", "n", *_r("path", "cv", "skew", "pause", "turn", "height"))


def motion_spectral(spark, d):
    ship(spark)
    found = _by_wrist(m.spectral_features(_wrists(spark, d).select("track", "t", "y"), "track"))
    return found.select("run", "j", *_r("autocorr", "concentration", "period"))


QUERIES = {f.__name__: f for f in (identity_centroids, identity_match, loo_scores, dominant_cluster, cross_video_cluster, select_diverse, frontal_reasons, hands_in_frame, shot_decision, aggregate_match, best_identity, recording_vote, run_vote, session_vote, confusion, macro_f1, class_scores, window_macro, majority_z, spearman_year, era_auc, conf_era_proxy, score_quantiles, era_colour, repertoire_matched, composer_accuracy, calibrate_threshold, crop_subgroup, crop_subgroup_uncalibrated, window_chance, distinct_counts, mean_scores, stratified_folds, pooled_embeddings, motion_basic, motion_spectral)}

_U = duck("v_faces") + """, u AS (SELECT conductor, video_id, vec_id, list_transform(emb, lambda x: x / greatest(sqrt(list_sum(list_transform(emb, lambda z: z * z))), 1e-9)) AS u FROM v_faces),
k AS (SELECT CAST(range AS INTEGER) AS k FROM range(64)),
ce AS (SELECT conductor, k, avg(u[k + 1]) AS m FROM u, k GROUP BY 1, 2), cn AS (SELECT conductor, sqrt(sum(m * m)) AS n FROM ce GROUP BY 1)"""
_P = _U + ", pr AS (SELECT a.conductor, a.vec_id AS i, b.vec_id AS j, a.video_id AS vi, b.video_id AS vj, list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2])) AS s FROM u a JOIN u b ON a.conductor = b.conductor)"
_V = duck("v_votes") + ", pv AS (SELECT conductor, video_id, run, win, l_partkey, y, list_transform(w, lambda x: x / list_sum(w)) AS p FROM v_votes)"
_SUMS = ", ".join(f"sum(p[{k + 1}]) AS s{k}" for k in range(10))
_LIST = "[" + ", ".join(f"round(s{k}, 9)" for k in range(10)) + "]"
_PRED = f"CAST(list_position({_LIST}, list_max({_LIST})) - 1 AS INTEGER)"
_RUN = _V + f", sr AS (SELECT run, y, {_SUMS} FROM pv GROUP BY 1, 2), rv AS (SELECT run, y, {_PRED} AS pred, {_PRED} = y AS hit FROM sr), cf AS (SELECT y, pred, count(*) AS n FROM rv GROUP BY 1, 2)"
_CS = _RUN + """, cls AS (SELECT y AS c FROM cf UNION SELECT pred FROM cf), cc AS (SELECT c, coalesce(sum(n) FILTER (y = c), 0) AS t, coalesce(sum(n) FILTER (pred = c), 0) AS p, coalesce(sum(n) FILTER (y = c AND pred = c), 0) AS h FROM cls, cf GROUP BY c),
pc AS (SELECT c AS y, h::DOUBLE / greatest(p, 1) AS precision, h::DOUBLE / greatest(t, 1) AS recall FROM cc), ff AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-9) AS f1 FROM pc)"""
_WP = "[" + ", ".join(f"round(p[{k + 1}], 9)" for k in range(10)) + "]"
_WHIT = f"list_position({_WP}, list_max({_WP})) - 1 = y"
_RK = lambda c: f"rank() OVER (PARTITION BY conductor ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY conductor, {c}) - 1) / 2.0::DOUBLE"
_SC = "sc AS (SELECT (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS p, CASE WHEN o_orderkey * 7919 % 1000 + o_custkey % 60 > 900 THEN 1 ELSE 0 END AS y, o_custkey % 3 = 0 AS has_crops FROM orders)"
ORACLES = {
    "identity_centroids": _U + " SELECT ce.conductor, k, round(m / greatest(n, 1e-9), 6) AS x FROM ce JOIN cn ON ce.conductor = cn.conductor",
    "identity_match": _U + """, rf AS (SELECT conductor, emb FROM v_faces WHERE vec_id % 5 = 0 UNION ALL SELECT conductor, list(m ORDER BY k) FROM ce GROUP BY conductor)
SELECT a.vec_id, round(max(list_sum(list_transform(list_zip(a.emb, b.emb), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.emb, lambda z: z * z))) * sqrt(list_sum(list_transform(b.emb, lambda z: z * z))))), 6) AS score FROM v_faces a JOIN rf b ON a.conductor = b.conductor WHERE a.vec_id % 5 <> 0 GROUP BY a.vec_id""",
    "loo_scores": _P + " SELECT conductor, i, round(coalesce(avg(s) FILTER (i <> j), 0), 6) AS score FROM pr GROUP BY 1, 2",
    "dominant_cluster": _P + """, mn AS (SELECT conductor, i, round(avg(s), 9) AS m FROM pr GROUP BY 1, 2), md AS (SELECT conductor, i FROM (SELECT *, row_number() OVER (PARTITION BY conductor ORDER BY m DESC, i) AS k FROM mn) WHERE k = 1)
SELECT pr.conductor, pr.i AS medoid, j AS member FROM pr JOIN md ON pr.conductor = md.conductor AND pr.i = md.i WHERE s >= 0.1""",
    "cross_video_cluster": _P + """, c AS (SELECT conductor, i, count(DISTINCT vj) AS videos, count(*) AS members FROM pr WHERE s >= 0.1 GROUP BY 1, 2)
SELECT conductor, i AS seed, videos, members FROM (SELECT *, row_number() OVER (PARTITION BY conductor ORDER BY videos DESC, members DESC, i) AS k FROM c) WHERE k = 1""",
    "frontal_reasons": duck("v_frames") + ", wd AS (SELECT run, t, " + ", ".join(f"max({f}) FILTER (j = {j}) AS {f}{j}" for j in (0, 5, 6, 9, 10) for f in ("x", "conf")) + """ FROM v_frames GROUP BY run, t)
SELECT run, t, CASE WHEN NOT (conf5 >= 0.3 AND conf6 >= 0.3) THEN 'shoulder not visible' ELSE concat_ws(';', CASE WHEN NOT (conf9 >= 0.3 AND conf10 >= 0.3) THEN 'wrist not visible' END, CASE WHEN abs(x5 - x6) < 0.08::DOUBLE * 0.6::DOUBLE THEN 'person too small' END,
CASE WHEN NOT ((x5 + x6) / 2 BETWEEN 0.6::DOUBLE * 0.225::DOUBLE AND 0.6::DOUBLE * 0.775::DOUBLE) THEN 'off center' END, CASE WHEN NOT conf0 >= 0.3 THEN 'nose not visible' WHEN degrees(atan(2 * abs(x0 - (x5 + x6) / 2) / greatest(abs(x5 - x6), 1e-6))) > 30 THEN 'face not frontal' END) END AS reasons FROM wd""",
    "hands_in_frame": duck("v_frames") + """, f AS (SELECT run, t, j, x + 0.5::DOUBLE AS x, y + 0.5::DOUBLE AS y, conf FROM v_frames)
SELECT run, t, bool_and(conf >= 0.3 AND x BETWEEN 0.02 AND 0.98 AND y BETWEEN 0.02 AND 0.98) FILTER (j IN (9, 10)) AS wrists,
count(*) FILTER (j BETWEEN 10 AND 14 AND conf >= 0.3) = 0 OR count(*) FILTER (j BETWEEN 10 AND 14 AND conf >= 0.3 AND NOT (x BETWEEN 0.018 AND 0.882 AND y BETWEEN 0.018 AND 0.882))::DOUBLE / greatest(count(*) FILTER (j BETWEEN 10 AND 14 AND conf >= 0.3), 1) < 0.3 AS "left", count(*) FILTER (j BETWEEN 15 AND 20 AND conf >= 0.3) = 0 OR count(*) FILTER (j BETWEEN 15 AND 20 AND conf >= 0.3 AND NOT (x BETWEEN 0.018 AND 0.882 AND y BETWEEN 0.018 AND 0.882))::DOUBLE / greatest(count(*) FILTER (j BETWEEN 15 AND 20 AND conf >= 0.3), 1) < 0.3 AS "right" FROM f GROUP BY run, t""",
    "shot_decision": """WITH s AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS f, p_partkey % 7 AS n, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 64) / 100.0::DOUBLE END AS id, (p_partkey % 21) / 20.0::DOUBLE AS c FROM part),
b AS (SELECT *, CASE WHEN n < 3 THEN 'reject' WHEN f >= 0.25 THEN 'accept' WHEN f >= 0.15 THEN 'hold' ELSE 'reject' END AS fb, CASE WHEN id IS NULL THEN 'hold' WHEN id >= 0.3 THEN 'accept' WHEN id >= 0.12 THEN 'hold' ELSE 'reject' END AS ib, CASE WHEN c >= 0.7 THEN 'accept' WHEN c >= 0.5 THEN 'hold' ELSE 'reject' END AS cb FROM s)
SELECT p_partkey, CASE WHEN fb = 'reject' OR ib = 'reject' THEN 'reject' WHEN fb = 'hold' OR ib = 'hold' OR cb <> 'accept' THEN 'hold' ELSE 'accept' END AS decision,
printf('frontal=%.2f(%s)', f, fb) || ';' || CASE WHEN id IS NULL THEN 'id=none(hold)' ELSE printf('id=%.2f(%s)', id, ib) END || ';' || printf('crop=%.2f(%s)', c, cb) AS reasons FROM b""",
    "aggregate_match": "SELECT user_id AS video_id, round(CASE WHEN count(*) FILTER (event_id % 3 <> 0 AND value IS NOT NULL) >= 4 THEN median(value) FILTER (event_id % 3 <> 0) END, 6) AS score FROM events GROUP BY 1",
    "best_identity": """WITH a AS (SELECT p_partkey, [CASE WHEN p_partkey % 2 = 0 THEN p_size % 7 END, CASE WHEN p_partkey % 3 = 0 THEN p_size % 5 END, CASE WHEN p_partkey % 5 = 0 THEN p_size % 9 END] AS s FROM part)
SELECT p_partkey, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS at FROM a""".replace("AS at", 'AS "at"').replace("list_position(s, list_max(s)) - 1", "CASE WHEN list_max(s) IS NOT NULL THEN list_position(s, list_max(s)) - 1 END"),
    "recording_vote": _V + f", sr AS (SELECT conductor, video_id, {_SUMS} FROM pv GROUP BY 1, 2) SELECT conductor, video_id, {_PRED} AS pred FROM sr",
    "run_vote": _RUN + " SELECT run, y, pred, hit FROM rv",
    "session_vote": _V + f", sr AS (SELECT conductor, video_id, {_SUMS} FROM pv GROUP BY 1, 2), nn AS (SELECT conductor, video_id // 3 AS session, [" + ", ".join(f"s{k}" for k in range(10)) + "] AS q FROM sr), s2 AS (SELECT conductor, session, " + ", ".join(f"sum(q[{k + 1}] / list_sum(q)) AS s{k}" for k in range(10)) + f" FROM nn GROUP BY 1, 2) SELECT conductor, session, {_PRED} AS pred FROM s2",
    "confusion": _RUN + " SELECT y, pred, n FROM cf",
    "macro_f1": _CS + " SELECT round(avg(f1), 6) AS macro_f1, round(avg(recall), 6) AS macro_recall FROM ff",
    "class_scores": _CS + " SELECT y, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ff",
    "window_macro": _V + f", h AS (SELECT conductor, video_id, avg(CASE WHEN {_WHIT} THEN 1.0::DOUBLE ELSE 0 END) AS acc FROM pv GROUP BY 1, 2) SELECT round(avg(acc), 6) AS win_macro, count(*) AS recordings FROM h",
    "majority_z": _RUN + ", pc AS (SELECT y, count(*) AS n, count(*) FILTER (hit) AS h FROM rv GROUP BY y), t AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(h)::DOUBLE / sum(n)::DOUBLE AS acc, max(n)::DOUBLE / sum(n)::DOUBLE AS c FROM pc) SELECT n, round(acc, 6) AS acc, round(c, 6) AS chance, round((acc - c) / sqrt(greatest(1e-9, c * (1 - c) / n)), 6) AS z FROM t",
    "spearman_year": duck("v_recordings") + f", r AS (SELECT conductor, {_RK('yr')} AS ra, {_RK('score')} AS rb FROM v_recordings) SELECT conductor, count(*) AS n, round(CASE WHEN count(*) >= 2 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END, 6) AS rho FROM r GROUP BY 1",
    "era_auc": duck("v_recordings") + " SELECT a.conductor, round(CASE WHEN count(*) FILTER (a.yr >= 1998 AND b.yr < 1998) > 0 THEN sum(CASE WHEN a.yr >= 1998 AND b.yr < 1998 THEN CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0 END END) / count(*) FILTER (a.yr >= 1998 AND b.yr < 1998) END, 6) AS auc FROM v_recordings a JOIN v_recordings b ON a.conductor = b.conductor GROUP BY 1",
    "conf_era_proxy": duck("v_frames") + ", f AS (SELECT run, t, sum(conf ORDER BY j) / 21 AS c FROM v_frames GROUP BY 1, 2) SELECT run, round(avg(c), 6) AS conf, round(avg(CASE WHEN c < 0.6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS low FROM f GROUP BY 1",
    "score_quantiles": duck("v_recordings") + " SELECT conductor, round(median(score), 6) AS mid, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.75), 6) AS p75, round(stddev_pop(score), 6) AS sd FROM v_recordings GROUP BY 1",
    "era_colour": duck("v_recordings") + ", r AS (SELECT *, min(yr) OVER (PARTITION BY conductor) AS lo, max(yr) OVER (PARTITION BY conductor) AS hi FROM v_recordings) SELECT video_id, round(CASE WHEN hi > lo THEN (yr - lo)::DOUBLE / (hi - lo) ELSE 0.5 END, 6) AS stage FROM r",
    "repertoire_matched": duck("v_repertoire") + " SELECT DISTINCT piece, video_id FROM v_repertoire WHERE type <> 'doc' AND piece <> 'misc' AND piece IN (SELECT piece FROM v_repertoire WHERE type <> 'doc' AND piece <> 'misc' GROUP BY piece HAVING count(DISTINCT conductor) >= 2)",
    "composer_accuracy": _V + f""", h AS (SELECT CASE WHEN lower(p_name) LIKE '%a%' AND lower(p_name) LIKE '%e%' THEN 'both' WHEN lower(p_name) LIKE '%o%' THEN 'o' ELSE 'other' END AS kind, video_id, {_WHIT} AS hit FROM pv JOIN part ON p_partkey = l_partkey),
g AS (SELECT kind, video_id, count(*) AS n, count(*) FILTER (hit) AS hits, bool_and(hit) AS whole FROM h GROUP BY 1, 2) SELECT kind, CAST(sum(n) AS BIGINT) AS n, round(sum(hits)::DOUBLE / sum(n)::DOUBLE, 6) AS acc, count(*) FILTER (whole) AS all_correct FROM g GROUP BY 1""",
    "calibrate_threshold": f"WITH {_SC}, c AS (SELECT DISTINCT p, count(*) OVER (ORDER BY p DESC) AS n, sum(y) OVER (ORDER BY p DESC) AS pos FROM sc) SELECT min(p) AS threshold FROM c WHERE n >= 20 AND pos::DOUBLE / n >= 0.9",
    "crop_subgroup": f"WITH {_SC} SELECT count(*) AS n, count(*) FILTER (p >= 0.5) AS false_reject, round(count(*) FILTER (p >= 0.5)::DOUBLE / count(*), 6) AS rate FROM sc WHERE y = 0 AND has_crops",
    "crop_subgroup_uncalibrated": f"WITH {_SC} SELECT count(*) AS n, 0::BIGINT AS false_reject, NULL::DOUBLE AS rate FROM sc WHERE y = 0 AND has_crops",
    "window_chance": _RUN + ", ro AS (SELECT y, sum(n) AS n FROM cf GROUP BY y) SELECT CAST(sum(n) AS BIGINT) AS n, round(max(n)::DOUBLE / sum(n)::DOUBLE, 6) AS chance, round((SELECT sum(n) FROM cf WHERE y = pred)::DOUBLE / sum(n)::DOUBLE, 6) AS acc FROM ro",
    "distinct_counts": _V + " SELECT conductor, count(DISTINCT video_id) AS videos, count(DISTINCT video_id // 3) AS sessions, count(DISTINCT run) AS runs FROM pv GROUP BY 1",
    "mean_scores": "SELECT o_orderpriority AS conductor, o_custkey AS video_id, count(*) AS n, round(avg(o_orderkey % 1009), 6) AS score FROM orders GROUP BY 1, 2",
    "pooled_embeddings": duck("v_faces") + ", k AS (SELECT CAST(range AS INTEGER) AS k FROM range(64)) SELECT conductor, k, round(avg(emb[k + 1]), 6) AS mean, round(max(emb[k + 1]), 6) AS max FROM v_faces, k GROUP BY 1, 2",
    "motion_spectral": duck("v_frames") + """, ce AS (SELECT run, j, t, y - avg(y) OVER (PARTITION BY run, j) AS a, count(*) OVER (PARTITION BY run, j) AS n FROM v_frames WHERE j IN (9, 10)),
ac AS (SELECT p.run, p.j, p.t - q.t AS lag, sum(p.a * q.a) AS s FROM ce p JOIN ce q ON p.run = q.run AND p.j = q.j AND p.t >= q.t GROUP BY 1, 2, 3), am AS (SELECT run, j, max(s) FILTER (lag >= 3) / max(s) FILTER (lag = 0) AS autocorr FROM ac GROUP BY 1, 2),
pw AS (SELECT run, j, k, any_value(n) AS n, sum(a * h * cos(u)) ** 2 + sum(a * h * sin(u)) ** 2 AS p FROM (SELECT run, j, n, k, a, 0.5 - 0.5 * cos(2 * pi() * t / (n - 1)) AS h, 2 * pi() * k * t / n AS u FROM ce, range(1, 200) z(k) WHERE k <= n // 2) GROUP BY 1, 2, 3),
pk AS (SELECT run, j, any_value(n) AS n, arg_max(k, p) AS top, sum(p) AS total FROM pw GROUP BY 1, 2)
SELECT am.run, CAST(am.j AS INTEGER) AS j, round(any_value(autocorr), 6) AS autocorr, round(sum(p) FILTER (k BETWEEN top - 1 AND top + 1) / any_value(total), 6) AS concentration, round(any_value(pk.n)::DOUBLE / any_value(top), 6) AS period FROM am JOIN pk ON pk.run = am.run AND pk.j = am.j JOIN pw ON pw.run = am.run AND pw.j = am.j GROUP BY am.run, am.j""",
    "motion_basic": duck("v_frames") + """, s0 AS (SELECT run, j, t, y, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM v_frames WHERE j IN (9, 10) WINDOW w AS (PARTITION BY run, j ORDER BY t)), s1 AS (SELECT *, sqrt(dx * dx + dy * dy) AS s FROM s0),
s2 AS (SELECT *, avg(s) OVER (PARTITION BY run, j) AS mean, median(s) OVER (PARTITION BY run, j) AS mid, lag(dx) OVER w AS pdx, lag(dy) OVER w AS pdy, lag(s) OVER w AS ps FROM s1 WINDOW w AS (PARTITION BY run, j ORDER BY t))
SELECT run, j, count(s) AS n, round(coalesce(sum(s), 0), 6) AS path, round(stddev_pop(s) / (avg(s) + 1e-8), 6) AS cv, round(CASE WHEN stddev_pop(s) < 1e-8 THEN 0 ELSE avg((s - mean) * (s - mean) * (s - mean)) / (stddev_pop(s) * stddev_pop(s) * stddev_pop(s)) END, 6) AS skew,
round(CASE WHEN max(mid) < 1e-8 THEN 1 ELSE avg(CASE WHEN s < 0.2 * mid THEN 1.0::DOUBLE WHEN s IS NOT NULL THEN 0 END) END, 6) AS pause,
round(coalesce(avg(CASE WHEN s > 0.25 * mean AND ps > 0.25 * mean THEN atan2(abs(pdx * dy - pdy * dx), pdx * dx + pdy * dy) END), 0), 6) AS turn, round(avg(y), 6) AS height FROM s2 GROUP BY run, j""",
}
