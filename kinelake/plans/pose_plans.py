"""Queries on geometry, resampling, windows, channels and graphs, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import pose as p
from kinelake.operators import windows as w
from kinelake.sources import views as v
from kinelake.sources.views import duck

#: v_frames has 21 joints, so its tree is the body without the hands.
TREE = [(a, b) for a, b in p.BODY_BONES if b < 21]
#: Left and right of every pair of joints that v_frames has: body, ears and eyes, knees and ankles.
PAIRS = [(5, 6), (7, 8), (9, 10), (11, 12), (1, 2), (3, 4), (13, 14), (15, 16)]


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def shoulder_norm(spark, d):
    return p.long_frames(p.shoulder_norm(v.v_frames(spark, d))).select("run", "t", "j", *_r("x", "y", "conf"))


def bone_lengths(spark, d):
    return p.bone_vectors(v.v_frames(spark, d), TREE).select("run", "t", "bone", *_r("length"))


def canonical_bones(spark, d):
    return p.canonical_bones(p.bone_vectors(v.v_frames(spark, d), TREE)).select("bone", *_r("length"))


def fore_factors(spark, d):
    return p.fore_factors(p.bone_vectors(v.v_frames(spark, d), TREE)).select("run", "t", "bone", *_r("r"))


def bone_normalize(spark, d):
    f = v.v_frames(spark, d)
    return p.long_frames(p.rebuilt(f, p.canonical_bones(p.bone_vectors(f, TREE)), TREE)).select("run", "t", "j", *_r("x", "y", "conf"))


def bone_normalize_fore(spark, d):
    f = v.v_frames(spark, d)
    return p.long_frames(p.rebuilt(f, p.canonical_bones(p.bone_vectors(f, TREE)), TREE, fore=True)).select("run", "t", "j", *_r("x", "y", "conf"))


def fore_ratios(spark, d):
    """By the median and by the 95th percentile."""
    f = v.v_frames(spark, d)
    both = [p.fore_ratios(f, TREE, a).withColumn("anchor", F.lit(a)) for a in ("median", "p95")]
    return both[0].unionByName(both[1]).select("run", "t", "j", "anchor", *_r("r"))


def fore_ratios_25(spark, d):
    """The ratios at 25 frames a second, as runs of 29.97 and of 25 give them."""
    r = p.fore_ratios(v.v_frames(spark, d), TREE).withColumn("fps", F.when(F.col("run") % 2 == 0, 29.97).otherwise(25.0))
    return p.resample_clamped(r, ["r"]).select("run", "j", "t", *_r("r"))


def raw_body(spark, d):
    f = v.v_frames(spark, d).withColumn("fps", F.when(F.col("run") % 3 == 0, 29.97).when(F.col("run") % 3 == 1, 23.976).otherwise(25.02))
    return p.raw_body(f).select("run", "j", "t", *_r("x", "y", "conf"))


def channels(spark, d):
    return p.channels(v.v_frames(spark, d), "body").select("run", "t", "j", *_r(*[c for names in p.BRANCHES.values() for c in names]))


def channels_still(spark, d):
    """Two branches, without confidence; joints bring their own ratios."""
    f = v.v_frames(spark, d)
    r = F.transform("joints", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["conf"].alias("conf"), (q["x"] * 2).alias("r")))
    return p.channels(f.withColumn("joints", r), "arm", ("bone", "pos"), drop_conf=True).select("run", "t", "j", *_r("x", "y", "conf", "bx", "by", "r", "dr"))


def pair_channels(spark, d):
    return p.pair_channels(v.v_frames(spark, d), PAIRS).select("run", "t", "pair", *_r("mx", "my", "dx", "dy", "dist", "conf", "d_mx", "d_my", "d_dx", "d_dy", "d_dist"))


def graph_edges(spark, d):
    """Of every joint set, with and without coordination, and of the pairs."""
    every = [p.graph_edges(spark, name, c).select(F.lit(name).alias("joint_set"), F.lit(c).alias("coordination"), "i", "j") for name in p.JOINT_SETS for c in (False, True)]
    every.append(p.pair_edges(spark).select(F.lit("pair").alias("joint_set"), F.lit(False).alias("coordination"), "i", "j"))
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


def graph_adjacency(spark, d):
    every = [p.normalized_adjacency(p.graph_edges(spark, name, c), len(js)).select(F.lit(name).alias("joint_set"), F.lit(c).alias("coordination"), "i", "j", *_r("w")) for name, js in p.JOINT_SETS.items() for c in (False, True)]
    every.append(p.normalized_adjacency(p.pair_edges(spark), 25).select(F.lit("pair").alias("joint_set"), F.lit(False).alias("coordination"), "i", "j", *_r("w")))
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


def elbow_angle(spark, d):
    return v.v_frames(spark, d).select("run", "t", F.round(p.elbow_angle(5, 7, 9), 6).alias("left"), F.round(p.elbow_angle(6, 8, 10), 6).alias("right"))


def window_starts(spark, d):
    s = v.v_segments(spark, d).select("run", "seg_idx", "a", "b")
    return s.select("run", "seg_idx", F.explode(w.window_starts(F.col("a"), F.col("b"), 75, 8, margin=5)).alias("start"))


def window_spans(spark, d):
    return w.windows(v.v_segments(spark, d).where("b - a >= 38"), 75, 8).select("run", "seg_idx", "start", "real_len")


def eval_windows_capped(spark, d):
    s = v.v_segments(spark, d).where("b - a >= 38").withColumn("rec", F.floor(F.col("run") / 8))
    return w.capped(w.windows(s, 75, 8), ["rec"], ["run", "seg_idx", "start"], 40).select("rec", "run", "seg_idx", "start")


def rescale_segments(spark, d):
    k = F.lit(25.0 / 29.97)
    return v.v_segments(spark, d).select("run", "seg_idx", F.rint(F.col("a") * k).cast("int").alias("a"), F.rint(F.col("b") * k).cast("int").alias("b"))


def mirror_crop(spark, d):
    """The source frame of every place of a window of 75 that starts with a segment; beyond its end the segment is reflected."""
    places = v.v_lengths(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(74))))
    return places.select("run", "seg_idx", "k", w.mirror_index(F.col("k"), F.col("n")).alias("i"))


def strip_frames(spark, d):
    s = v.v_segments(spark, d)
    n = F.col("b") - F.col("a")
    return s.select("run", "seg_idx", F.array_join(w.strip_indices(n, 8).cast("array<string>"), ",").alias("at"), F.round(F.element_at(w.sample_times(n / 25.0, 5), 3), 6).alias("mid"))


def resample_25(spark, d):
    return p.resample(p.long_frames(v.v_frames(spark, d)), 29.97).select("run", "j", "t", *_r("x", "y", "conf"))


def lowpass(spark, d):
    return p.lowpass(p.long_frames(v.v_frames(spark, d))).select("run", "j", "t", *_r("x", "y"))


def nearest_fill(spark, d):
    every = p.long_frames(v.v_frames(spark, d)).select("run", "j", "t", F.when(F.col("conf") >= 0.3, F.col("x")).alias("x"))
    return p.nearest_fill(every, "x", ("run", "j")).select("run", "j", "t", "filled")


def moving_average(spark, d):
    every = p.long_frames(v.v_frames(spark, d)).select("run", "j", "t", "x")
    return every.select("run", "j", "t", F.round(p.moving_average(every, "x", 15, ("run", "j")), 6).alias("x"))


def body_aligned(spark, d):
    return p.long_frames(p.aligned(v.v_frames(spark, d))).select("run", "t", "j", *_r("x", "y"))


QUERIES = {f.__name__: f for f in (shoulder_norm, bone_lengths, canonical_bones, fore_factors, bone_normalize, bone_normalize_fore, fore_ratios, fore_ratios_25, raw_body, resample_25, lowpass, nearest_fill, moving_average, channels, channels_still, pair_channels, graph_edges, graph_adjacency, body_aligned, elbow_angle, window_starts, window_spans, eval_windows_capped, rescale_segments, mirror_crop, strip_frames)}

_W = duck("v_frames") + ", wd AS (SELECT run, t, " + ", ".join(f"max({f}) FILTER (j = {j}) AS {f}{j}" for j in range(17) for f in ("x", "y", "conf")) + " FROM v_frames GROUP BY run, t)"


def _bone(b: int, parent: int, child: int) -> str:
    px, py = ("(x5 + x6) / 2", "(y5 + y6) / 2") if parent == p.ROOT else (f"x{parent}", f"y{parent}")
    fine = f"conf{child} >= 0.3" + ("" if parent == p.ROOT else f" AND conf{parent} >= 0.3")
    dx, dy = f"(x{child} - {px})", f"(y{child} - {py})"
    width = "sqrt((x5 - x6) * (x5 - x6) + (y5 - y6) * (y5 - y6))"
    return f"SELECT run, t, {b} AS bone, {dx} AS dx, {dy} AS dy, CASE WHEN {fine} THEN sqrt({dx} * {dx} + {dy} * {dy}) END AS length, CASE WHEN conf5 >= 0.3 AND conf6 >= 0.3 AND {width} > 1e-6 THEN {width} END AS width FROM wd"


_B = _W + ", bv AS (" + " UNION ALL ".join(_bone(b, *e) for b, e in enumerate(TREE)) + "), cb AS (SELECT bone, median(length / width) AS canon FROM bv GROUP BY bone)"
_G = [g for g in p.gauss_weights(25.0, 6.0)]
_TAPS = [(k, _G[abs(k)]) for k in range(1 - len(_G), len(_G))]
_at = lambda c, k: c if k == 0 else (f"lead({c}, {k}) OVER w" if k > 0 else f"lag({c}, {-k}) OVER w")
_lp = lambda c: "round((" + " + ".join(f"coalesce({_at(c, k)} * {g!r}::DOUBLE, 0)" for k, g in _TAPS) + ") / (" + " + ".join(f"CASE WHEN {_at(c, k)} IS NOT NULL THEN {g!r}::DOUBLE ELSE 0 END" for k, g in _TAPS) + f"), 6) AS {c}"
_UP = "CASE WHEN j IN (0, 5, 6) THEN ({c}5 + {c}6) / 2 " + " ".join(f"WHEN j = {c} THEN {{c}}{q}" for c, q in ((7, 5), (8, 6), (9, 7), (10, 8), (11, 5), (12, 6))) + " END"
_K = "(SELECT *, greatest(1, least(8, (b - a - 75) // 38 + 1)) AS k FROM s)"
_WIN = duck("v_segments") + f""", s AS (SELECT run, seg_idx, a, b FROM v_segments WHERE b - a >= 38),
win AS (SELECT run, seg_idx, b, a, CASE WHEN b - a - 75 <= 0 OR k = 1 THEN a ELSE a + CAST(round_even(i * ((b - a - 75)::DOUBLE / (k - 1)), 0) AS INTEGER) END AS start FROM {_K} x, (SELECT CAST(range AS INTEGER) AS i FROM range(8)) y WHERE i = 0 OR (b - a - 75 > 0 AND i < k))"""
_SCALED = ", sc AS (SELECT bv.run, t, bv.bone AS part, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-6 THEN dx / sqrt(dx * dx + dy * dy) ELSE 0 END * canon * {r} AS ux, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-6 THEN dy / sqrt(dx * dx + dy * dy) ELSE 0 END * canon * {r} AS uy FROM bv JOIN cb ON bv.bone = cb.bone{more})"
_REBUILT = ", pt(j, part) AS (VALUES " + ", ".join(f"({TREE[a][1]}, {b})" for a, b in p.root_paths(TREE)) + """), nw AS (SELECT run, t, j, sum(ux) AS x, sum(uy) AS y FROM sc JOIN pt ON sc.part = pt.part GROUP BY run, t, j)
SELECT f.run, f.t, f.j, round(coalesce(nw.x, 0), 6) AS x, round(coalesce(nw.y, 0), 6) AS y, round(CASE WHEN nw.j IS NOT NULL THEN conf ELSE 0 END, 6) AS conf FROM v_frames f LEFT JOIN nw ON f.run = nw.run AND f.t = nw.t AND f.j = nw.j"""
_RATIO = ", pa(anchor, q) AS (VALUES ('median', 0.5), ('p95', 0.95)), us AS (SELECT run, bone, 'median' AS anchor, quantile_cont(length / width, 0.5) AS u FROM bv GROUP BY 1, 2 UNION ALL SELECT run, bone, 'p95', quantile_cont(length / width, 0.95) FROM bv GROUP BY 1, 2), ch(bone, j) AS (VALUES " + ", ".join(f"({b}, {c})" for b, (_, c) in enumerate(TREE)) + """),
re AS (SELECT bv.run, t, j, us.anchor, CASE WHEN length / width IS NOT NULL AND u >= 1e-6 THEN least(greatest(length / width / u, 0.2), 2.0) END AS r FROM bv JOIN us ON bv.run = us.run AND bv.bone = us.bone JOIN ch ON ch.bone = bv.bone),
ra AS (SELECT f.run, f.t, f.j, pa.anchor, coalesce(r, 1.0) AS r FROM v_frames f CROSS JOIN pa LEFT JOIN re ON re.run = f.run AND re.t = f.t AND re.j = f.j AND re.anchor = pa.anchor)"""
_CLAMPED = """, src AS {source}, m AS (SELECT run, max(t) + 1 AS n, {fps} AS fps FROM v_frames GROUP BY run), l AS (SELECT *, CASE WHEN abs(fps - 25) < 0.05 THEN 1.0::DOUBLE ELSE fps / 25.0 END AS step, CAST(CASE WHEN abs(fps - 25) < 0.05 THEN n ELSE round_even(n * 25.0::DOUBLE / fps, 0) END AS INTEGER) AS total FROM m),
o AS (SELECT run, i, least(i * step, n - 1) AS pos FROM l, (SELECT CAST(range AS INTEGER) AS i FROM range(10000)) WHERE i < total)"""
_CHANNELS = f""", c0 AS (SELECT f.run, f.t, j, x, y, conf, x - {_UP.format(c='x')} AS bx, y - {_UP.format(c='y')} AS "by", {{r}} AS r FROM v_frames f JOIN wd ON f.run = wd.run AND f.t = wd.t WHERE j IN ({{js}})),
c1 AS (SELECT *, bx AS bdx, "by" AS bdy, coalesce(lead(x) OVER w - x, 0) AS vx, coalesce(lead(y) OVER w - y, 0) AS vy, coalesce(lead(x, 2) OVER w - x, 0) AS v2x, coalesce(lead(y, 2) OVER w - y, 0) AS v2y, coalesce(lead(r) OVER w - r, 0) AS dr FROM c0 WINDOW w AS (PARTITION BY run, j ORDER BY t)),
c2 AS (SELECT *, coalesce(lead(vx) OVER w - vx, 0) AS ax, coalesce(lead(vy) OVER w - vy, 0) AS ay FROM c1 WINDOW w AS (PARTITION BY run, j ORDER BY t))"""
_GRAPH = "WITH m(joint_set, pos, joint) AS (VALUES " + ", ".join(f"('{n}', {i}, {j})" for n, js in p.JOINT_SETS.items() for i, j in enumerate(js)) + """),
h AS (SELECT CASE WHEN k = 0 THEN 0 ELSE 4 * f + k END AS a, 4 * f + k + 1 AS b FROM range(5) x(f), range(4) y(k)),
ej AS (SELECT a, b, false AS extra FROM (VALUES (0, 5), (0, 6), (5, 6), (5, 7), (6, 8), (7, 9), (8, 10), (5, 11), (6, 12), (9, 91), (10, 112)) e(a, b) UNION ALL SELECT r + a, r + b, false FROM h, (VALUES (91), (112)) z(r) UNION ALL SELECT a, b, true FROM (VALUES (9, 10), (7, 8), (91, 112)) e(a, b)),
eg AS (SELECT DISTINCT s.joint_set, c AS coordination, least(s.pos, t.pos) AS i, greatest(s.pos, t.pos) AS j FROM ej JOIN m s ON s.joint = ej.a JOIN m t ON t.joint = ej.b AND t.joint_set = s.joint_set, (VALUES (false), (true)) x(c) WHERE c OR NOT extra
UNION ALL SELECT 'pair', false, a, b FROM (SELECT 4 + a AS a, 4 + b AS b FROM h UNION ALL FROM (VALUES (0, 1), (1, 2), (0, 3), (2, 4))))"""
ORACLES = {
    "shoulder_norm": _W + """, n AS (SELECT run, t, sqrt((x5 - x6) * (x5 - x6) + (y5 - y6) * (y5 - y6)) AS width, (x5 + x6) / 2 AS cx, (y5 + y6) / 2 AS cy FROM wd)
SELECT f.run, f.t, j, round((x - cx) / CASE WHEN width > 1e-6 THEN width ELSE 1 END, 6) AS x, round((y - cy) / CASE WHEN width > 1e-6 THEN width ELSE 1 END, 6) AS y, round(CASE WHEN width > 1e-6 THEN conf ELSE 0 END, 6) AS conf FROM v_frames f JOIN n ON f.run = n.run AND f.t = n.t""",
    "bone_lengths": _B + " SELECT run, t, bone, round(length, 6) AS length FROM bv",
    "canonical_bones": _B + " SELECT bone, round(canon, 6) AS length FROM cb",
    "fore_factors": _B + """, an AS (SELECT run, bone, quantile_cont(length / width, 0.95) AS anchor FROM bv GROUP BY 1, 2)
SELECT bv.run, t, bv.bone, round(CASE WHEN length / width IS NOT NULL AND anchor >= 1e-6 THEN least(greatest(length / width / anchor, 0.15), 1.15) ELSE 1.0 END, 6) AS r FROM bv JOIN an ON bv.run = an.run AND bv.bone = an.bone""",
    "bone_normalize": _B + _SCALED.format(r="1.0::DOUBLE", more="") + _REBUILT,
    "bone_normalize_fore": _B + ", an AS (SELECT run, bone, quantile_cont(length / width, 0.95) AS anchor FROM bv GROUP BY 1, 2)" + _SCALED.format(r="CASE WHEN length / width IS NOT NULL AND anchor >= 1e-6 THEN least(greatest(length / width / anchor, 0.15), 1.15) ELSE 1.0 END", more=" JOIN an ON bv.run = an.run AND bv.bone = an.bone") + _REBUILT,
    "fore_ratios": _B + _RATIO + " SELECT run, t, j, anchor, round(r, 6) AS r FROM ra",
    "fore_ratios_25": _B + _RATIO + _CLAMPED.format(fps="CASE WHEN run % 2 = 0 THEN 29.97::DOUBLE ELSE 25.0::DOUBLE END", source="(SELECT run, t, j, r FROM ra WHERE anchor = 'median')") + " SELECT o.run, f.j, o.i AS t, round(f.r + (pos - f.t) * coalesce(g.r - f.r, 0), 6) AS r FROM o JOIN src f ON f.run = o.run AND f.t = CAST(floor(pos) AS INTEGER) LEFT JOIN src g ON g.run = f.run AND g.j = f.j AND g.t = f.t + 1",
    "raw_body": duck("v_frames") + _CLAMPED.format(fps="CASE run % 3 WHEN 0 THEN 29.97::DOUBLE WHEN 1 THEN 23.976::DOUBLE ELSE 25.02::DOUBLE END", source="(SELECT * FROM v_frames WHERE j < 17)") + " SELECT o.run, f.j, o.i AS t, " + ", ".join(f"round(f.{c} + (pos - f.t) * coalesce(g.{c} - f.{c}, 0), 6) AS {c}" for c in ("x", "y", "conf")) + " FROM o JOIN src f ON f.run = o.run AND f.t = CAST(floor(pos) AS INTEGER) LEFT JOIN src g ON g.run = f.run AND g.j = f.j AND g.t = f.t + 1",
    "resample_25": duck("v_frames") + """, m AS (SELECT run, max(t) AS last, CAST(round_even(max(t) * (25.0::DOUBLE / 29.97::DOUBLE), 0) AS INTEGER) AS n FROM v_frames GROUP BY run),
o AS (SELECT run, last, n, i, i * last::DOUBLE / n AS pos FROM m, (SELECT CAST(range AS INTEGER) AS i FROM range(10000)) WHERE i <= n AND n > 0)
SELECT o.run, f.j, o.i AS t, round(f.x + (pos - f.t) * coalesce(g.x - f.x, 0), 6) AS x, round(f.y + (pos - f.t) * coalesce(g.y - f.y, 0), 6) AS y, round(f.conf + (pos - f.t) * coalesce(g.conf - f.conf, 0), 6) AS conf
FROM o JOIN v_frames f ON f.run = o.run AND f.t = least(CAST(floor(pos) AS INTEGER), last) LEFT JOIN v_frames g ON g.run = f.run AND g.j = f.j AND g.t = f.t + 1""",
    "lowpass": duck("v_frames") + f" SELECT run, j, t, {_lp('x')}, {_lp('y')} FROM v_frames WINDOW w AS (PARTITION BY run, j ORDER BY t)",
    "nearest_fill": duck("v_frames") + """, a AS (SELECT run, j, t, CASE WHEN conf >= 0.3 THEN x END AS x FROM v_frames)
SELECT a.run, a.j, a.t, (SELECT b.x FROM a b WHERE b.run = a.run AND b.j = a.j AND b.x IS NOT NULL ORDER BY abs(b.t - a.t), b.t LIMIT 1) AS filled FROM a""",
    "moving_average": duck("v_frames") + """, a AS (SELECT run, j, t, x, max(t) OVER (PARTITION BY run, j) AS last FROM v_frames)
SELECT a.run, a.j, a.t, round(sum(b.x) / 15, 6) AS x FROM a, (SELECT CAST(range AS INTEGER) - 7 AS k FROM range(15)) o JOIN a b ON b.run = a.run AND b.j = a.j AND b.t = greatest(0, least(a.last, a.t + k)) GROUP BY a.run, a.j, a.t""",
    "channels": _W + _CHANNELS.format(js="0, 5, 6, 7, 8, 9, 10, 11, 12", r="1.0::DOUBLE") + " SELECT run, t, j, " + ", ".join(f'round("{c}", 6) AS "{c}"' for names in p.BRANCHES.values() for c in names) + " FROM c2",
    "channels_still": _W + _CHANNELS.format(js="5, 6, 7, 8, 9, 10", r="2 * x") + " SELECT run, t, j, round(x, 6) AS x, round(y, 6) AS y, 0.0::DOUBLE AS conf, round(bx, 6) AS bx, round(\"by\", 6) AS \"by\", round(r, 6) AS r, round(dr, 6) AS dr FROM c2",
    "pair_channels": _W + ", pr AS (" + " UNION ALL ".join(f"SELECT run, t, {i} AS pair, x{a} + x{b} AS mx, y{a} - y{b} AS my, x{a} - x{b} AS dx, y{a} - y{b} AS dy, sqrt((x{a} - x{b}) * (x{a} - x{b}) + (y{a} - y{b}) * (y{a} - y{b})) AS dist, least(conf{a}, conf{b}) AS conf FROM wd" for i, (a, b) in enumerate(PAIRS)) + ") SELECT run, t, pair, round(conf, 6) AS conf, " + ", ".join(f"round({c}, 6) AS {c}, round(coalesce(lead({c}) OVER w - {c}, 0), 6) AS d_{c}" for c in ("mx", "my", "dx", "dy", "dist")) + " FROM pr WINDOW w AS (PARTITION BY run, pair ORDER BY t)",
    "graph_edges": _GRAPH + " SELECT joint_set, coordination, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM eg",
    "graph_adjacency": _GRAPH + """, n AS (SELECT joint_set, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT 'pair', 25), a AS (SELECT * FROM eg UNION SELECT joint_set, coordination, j, i FROM eg UNION SELECT n.joint_set, c, range, range FROM n, (VALUES (false), (true)) x(c), range(51) WHERE range < n.n AND NOT (n.joint_set = 'pair' AND c)),
g AS (SELECT joint_set, coordination, i, count(*) AS d FROM a GROUP BY ALL)
SELECT a.joint_set, a.coordination, CAST(a.i AS INTEGER) AS i, CAST(a.j AS INTEGER) AS j, round(1 / sqrt(g.d * h.d), 6) AS w FROM a JOIN g ON g.joint_set = a.joint_set AND g.coordination = a.coordination AND g.i = a.i JOIN g h ON h.joint_set = a.joint_set AND h.coordination = a.coordination AND h.i = a.j""",
    "body_aligned": _W + ", an AS (SELECT run, t, -atan2(y6 - y5, x6 - x5) AS a FROM wd) SELECT f.run, f.t, j, round(x * cos(a) - y * sin(a), 6) AS x, round(x * sin(a) + y * cos(a), 6) AS y FROM v_frames f JOIN an ON f.run = an.run AND f.t = an.t",
    "elbow_angle": _W + " SELECT run, t, " + ", ".join(f"round(acos(least(1.0, greatest(-1.0, ((x{s} - x{e}) * (x{h} - x{e}) + (y{s} - y{e}) * (y{h} - y{e})) / (sqrt((x{s} - x{e}) * (x{s} - x{e}) + (y{s} - y{e}) * (y{s} - y{e})) * sqrt((x{h} - x{e}) * (x{h} - x{e}) + (y{h} - y{e}) * (y{h} - y{e})) + 1e-8)))), 6) AS \"{n}\"" for n, s, e, h in (("left", 5, 7, 9), ("right", 6, 8, 10))) + " FROM wd",
    "window_starts": duck("v_segments") + """, m AS (SELECT run, seg_idx, a, b, least(5, greatest(0, b - a - 75) // 2) AS m FROM v_segments), n AS (SELECT run, seg_idx, a + m AS a, b - a - 2 * m - 75 AS span FROM m), s AS (SELECT *, greatest(1, least(8, CAST(floor(span / 38.0) AS INTEGER) + 1)) AS k FROM n)
SELECT run, seg_idx, CAST(CASE WHEN span <= 0 OR k = 1 THEN a ELSE a + CAST(round_even(i * (span::DOUBLE / (k - 1)), 0) AS INTEGER) END AS INTEGER) AS start FROM s, (SELECT CAST(range AS INTEGER) AS i FROM range(8)) y WHERE i = 0 OR (span > 0 AND i < k)""",
    "window_spans": _WIN + " SELECT run, seg_idx, start, least(75, b - a) AS real_len FROM win",
    "eval_windows_capped": _WIN + """, o AS (SELECT run // 8 AS rec, run, seg_idx, start, row_number() OVER (PARTITION BY run // 8 ORDER BY run, seg_idx, start) - 1 AS pos, count(*) OVER (PARTITION BY run // 8) AS n FROM win)
SELECT rec, run, seg_idx, start FROM o WHERE n <= 40 OR EXISTS (SELECT 1 FROM range(40) r(i) WHERE round_even(i * (n - 1)::DOUBLE / 39, 0) = pos)""",
    "rescale_segments": duck("v_segments") + " SELECT run, seg_idx, CAST(round_even(a * (25.0::DOUBLE / 29.97::DOUBLE), 0) AS INTEGER) AS a, CAST(round_even(b * (25.0::DOUBLE / 29.97::DOUBLE), 0) AS INTEGER) AS b FROM v_segments",
    "mirror_crop": duck("v_segments") + ", n AS (SELECT run, seg_idx, b - a AS n FROM v_segments) SELECT run, seg_idx, CAST(k AS INTEGER) AS k, CAST(CASE WHEN n = 1 THEN 0 ELSE least(k % (2 * (n - 1)), 2 * (n - 1) - k % (2 * (n - 1))) END AS INTEGER) AS i FROM n, range(75) r(k)",
    "strip_frames": duck("v_segments") + ", n AS (SELECT run, seg_idx, b - a AS n FROM v_segments) SELECT run, seg_idx, array_to_string(list_sort(list_distinct(list_transform(range(8), lambda i: least(CAST(floor((i + 0.5::DOUBLE) / 8 * n) AS INTEGER), n - 1)))), ',') AS at, round(2.5::DOUBLE * (n / 25.0::DOUBLE) / 5, 6) AS mid FROM n",
}
