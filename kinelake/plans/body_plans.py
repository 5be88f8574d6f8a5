"""Queries on 17-joint kernels, sampling, listings and probes, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import bodies, pose, probes, sampling
from kinelake.runtime import table
from kinelake.sources import listings
from kinelake.sources import views as v
from kinelake.sources.views import duck

W, H = 1280, 720


def _frames(spark, d):
    """v_frames in pixels."""
    j = F.transform("joints", lambda p: F.struct((640 + 900 * p["x"]).alias("x"), (360 + 900 * p["y"]).alias("y"), p["conf"].alias("conf")))
    return v.v_frames(spark, d).select("run", "t", j.alias("joints"))


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


def h36m_joints(spark, d):
    out = _frames(spark, d).select("run", "t", F.posexplode(bodies.h36m(F.col("joints"))).alias("j", "p")).select("run", "t", "j", "p.*")
    return _rounded(out, "x", "y", "conf")


def crop_scaled(spark, d):
    return _rounded(bodies.crop_scaled(pose.long_frames(_frames(spark, d)).select("run", "t", "j", "x", "y", "conf")), "x", "y", "conf")


def frame_size(spark, d):
    return bodies.frame_size(pose.long_frames(_frames(spark, d)))


def head_boxes(spark, d):
    return _frames(spark, d).select("run", "t", bodies.head_box(F.col("joints"), W, H).alias("b")).select("run", "t", "b.*")


def frontal_score(spark, d):
    return _rounded(v.v_frames(spark, d).select("run", "t", bodies.frontal_score(F.col("joints")).alias("score")), "score")


def random_windows(spark, d):
    return sampling.random_windows(v.v_segments(spark, d), 75, 4)


def round_robin_folds(spark, d):
    return sampling.round_robin_folds(table(spark, d, "orders").select(F.col("o_custkey").alias("session")), "session", 5)


def listing_lines(spark, d):
    body = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("duration"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("channel"), F.col("p_type").alias("uploader")))
    k = F.col("p_partkey") % 5
    line = F.when(k == 0, F.lit("")).when(k == 1, F.substring(body, 1, 9)).when(k == 2, F.replace(body, F.lit('"id"'), F.lit('"no"'))).otherwise(body)
    return listings.parsed(table(spark, d, "part"), line)


def oof_probs(spark, d):
    f = v.v_faces(spark, d).select("vec_id", F.col("video_id").alias("group"), (F.crc32(F.col("conductor").cast("string").cast("binary")) % 2).cast("int").alias("y"), F.col("emb").alias("features"))
    return probes.oof_probabilities(f).select("vec_id", "group", "y", "fold", "p")


QUERIES = {f.__name__: f for f in (h36m_joints, crop_scaled, frame_size, head_boxes, frontal_score, random_windows, round_robin_folds, listing_lines, oof_probs)}

_PX = duck("v_frames") + ", px AS (SELECT run, t, j, 640 + 900 * x AS x, 360 + 900 * y AS y, conf FROM v_frames)"
_MAP = ", ".join(f"({k}, {j})" for k, s in enumerate(bodies.H36M) for j in s)
_NEXT = "coalesce((SELECT min(s) FROM (SELECT CAST(unnest({0}) AS DOUBLE) AS s) WHERE s >= {1}), {1}, {2})"

ORACLES = {
    "h36m_joints": f"{_PX} SELECT run, t, k AS j, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(min(conf), 6) AS conf FROM px JOIN (VALUES {_MAP}) m(k, src) ON j = src GROUP BY run, t, k",
    "crop_scaled": f"""{_PX}, b AS (SELECT run, count(*) FILTER (conf <> 0) AS n, min(x) FILTER (conf <> 0) AS lx, max(x) FILTER (conf <> 0) AS hx, min(y) FILTER (conf <> 0) AS ly, max(y) FILTER (conf <> 0) AS hy FROM px GROUP BY run),
        s AS (SELECT *, greatest(hx - lx, hy - ly) AS sc FROM b)
        SELECT run, t, j, CASE WHEN n >= 4 AND sc > 0 THEN round(least(1.0, greatest(-1.0, 2 * ((x - (lx + hx - sc) / 2) / sc - 0.5))), 6) ELSE 0 END AS x,
          CASE WHEN n >= 4 AND sc > 0 THEN round(least(1.0, greatest(-1.0, 2 * ((y - (ly + hy - sc) / 2) / sc - 0.5))), 6) ELSE 0 END AS y,
          CASE WHEN n >= 4 AND sc > 0 THEN round(least(1.0, greatest(-1.0, conf)), 6) ELSE 0 END AS conf FROM px JOIN s USING (run)""",
    "frame_size": f"""{_PX}, m AS (SELECT run, max(x) FILTER (conf > 0.3) AS mx, max(y) FILTER (conf > 0.3) AS my FROM px GROUP BY run)
        SELECT run, {_NEXT.format(list(bodies.WIDTHS), 'mx', '1920.0::DOUBLE')} AS width, {_NEXT.format(list(bodies.HEIGHTS), 'my', '1080.0::DOUBLE')} AS height FROM m""",
    "head_boxes": f"""{_PX}, f AS (SELECT run, t, count(*) FILTER (j < 5 AND conf >= 0.3) AS n, avg(x) FILTER (j < 5 AND conf >= 0.3) AS cx, avg(y) FILTER (j < 5 AND conf >= 0.3) AS cy,
          max(x) FILTER (j < 5 AND conf >= 0.3) - min(x) FILTER (j < 5 AND conf >= 0.3) AS ex, max(y) FILTER (j < 5 AND conf >= 0.3) - min(y) FILTER (j < 5 AND conf >= 0.3) AS ey,
          CASE WHEN count(*) FILTER (j IN (5, 6) AND conf >= 0.3) = 2 THEN abs(max(x) FILTER (j = 5) - max(x) FILTER (j = 6))
               WHEN count(*) FILTER (j IN (1, 2) AND conf >= 0.3) = 2 THEN 2.5 * abs(max(x) FILTER (j = 1) - max(x) FILTER (j = 2)) END AS known FROM px GROUP BY run, t),
        s AS (SELECT *, coalesce(known, 2.0 * greatest(ex, ey, 1.0)) AS sc FROM f), h AS (SELECT *, sc * (0.5 + 0.6) AS hf FROM s),
        q AS (SELECT *, CAST(trunc(greatest(0, least({W - 1}, cx - hf))) AS INTEGER) AS x0, CAST(trunc(greatest(1, least({W}, cx + hf))) AS INTEGER) AS x1,
          CAST(trunc(greatest(0, least({H - 1}, cy - 1.2 * hf))) AS INTEGER) AS y0, CAST(trunc(greatest(1, least({H}, cy + 0.8 * hf))) AS INTEGER) AS y1 FROM h),
        g AS (SELECT *, n > 0 AND sc >= 0.04 * {H} AND x1 - x0 >= 2 AND y1 - y0 >= 2 AS ok FROM q)
        SELECT run, t, CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0, CASE WHEN ok THEN x1 END AS x1, CASE WHEN ok THEN y1 END AS y1 FROM g""",
    "frontal_score": f"{duck('v_frames')} SELECT run, t, round(product(conf), 6) AS score FROM v_frames WHERE j IN (0, 5, 6, 9, 10) GROUP BY run, t",
    "random_windows": f"""{duck('v_segments')}, s AS (SELECT *, greatest(1, b - a - 74) AS span FROM v_segments WHERE b > a),
        p AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY run ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(span) OVER (PARTITION BY run) AS total FROM s),
        u AS (SELECT run, total, CAST(range AS INTEGER) AS draw FROM (SELECT DISTINCT run, total FROM p), range(4)),
        w AS (SELECT run, draw, floor(CAST(CAST('0x' || substr(md5('17:' || run || ':' || draw), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 * total) AS place FROM u)
        SELECT p.run, draw, CAST(a + place - before AS INTEGER) AS start, CAST(least(75, b - a) AS INTEGER) AS real_len FROM p JOIN w ON p.run = w.run AND place >= before AND place < before + span""",
    "round_robin_folds": "SELECT session, CAST((row_number() OVER (ORDER BY md5('17:' || session), session) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT o_custkey AS session FROM orders)",
    "listing_lines": "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(p_size AS DOUBLE) AS duration, CAST(NULL AS BIGINT) AS view_count, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS channel, CAST(NULL AS VARCHAR) AS upload_date FROM part WHERE p_partkey % 5 > 2",
}
