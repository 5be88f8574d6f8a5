"""Queries on quality control, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import qc
from kinelake.sources import views as v
from kinelake.sources.views import duck


def _spikes(spark, d):
    return qc.with_spikes(qc.with_kinematics(v.v_frames(spark, d)))


def _segments(spark, d):
    return qc.clean_segments(_spikes(spark, d), min_seconds=0.16)


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


def qc_clean_segments(spark, d):
    return _segments(spark, d)


def wrist_speed(spark, d):
    return qc.with_kinematics(v.v_frames(spark, d)).select("run", "t", *_r("speed_l", "speed_r", "speed"))


def shoulder_jump(spark, d):
    return qc.with_kinematics(v.v_frames(spark, d)).select("run", "t", *_r("scale", "jump"))


def median3(spark, d):
    f = v.v_frames(spark, d)
    return f.select("run", "t", *[qc.median3(qc.joint(qc.LEFT_WRIST)[c]).alias(c) for c in ("x", "y")])


def jitter(spark, d):
    return qc.jitter(v.v_frames(spark, d)).select("run", *_r("jitter"))


def qc_summary(spark, d):
    s = qc.summary(_spikes(spark, d), _segments(spark, d))
    return s.select("run", "n_frames", "n_spikes", "kept_frames", "longest", *_r("drop_frac", "spike_rate", "max_speed", "max_jump", "low_conf_frac"))


def qc_dispositions(spark, d):
    return qc.summary(_spikes(spark, d), _segments(spark, d)).select("run", qc.disposition(F.col("longest"), keep_s=0.2).alias("disposition"))


def qc_review_samples(spark, d):
    return qc.review_samples(qc.summary(_spikes(spark, d), _segments(spark, d)), 3, 4).select("run", "why", *_r("max_speed"))


def preview_spans(spark, d):
    return qc.preview_spans(v.v_segments(spark, d).select("run", "a", "b"))


def frontal_spans(spark, d):
    return qc.true_spans(v.v_signal(spark, d), 1, 4)


QUERIES = {f.__name__: f for f in (qc_clean_segments, wrist_speed, shoulder_jump, median3, jitter, qc_summary, qc_dispositions, qc_review_samples, preview_spans, frontal_spans)}

_M3 = "CASE WHEN lag({c}) OVER w IS NULL OR lead({c}) OVER w IS NULL THEN {c} ELSE list_sort([lag({c}) OVER w, {c}, lead({c}) OVER w])[2] END"
_KIN = (
    duck("v_frames")
    + """,
flat AS (SELECT run, t, """
    + ", ".join(f"max({f}) FILTER (j = {j}) AS {n}_{f}" for n, j in (("lw", 9), ("rw", 10), ("ls", 5), ("rs", 6)) for f in ("x", "y", "conf"))
    + """ FROM v_frames GROUP BY run, t),
sm AS (SELECT *, """
    + ", ".join(f"{_M3.format(c=f'{n}_{f}')} AS {n}_{f}3" for n in ("lw", "rw", "ls", "rs") for f in ("x", "y"))
    + """, CASE WHEN ls_conf >= 0.3 AND rs_conf >= 0.3 THEN sqrt((ls_x - rs_x) * (ls_x - rs_x) + (ls_y - rs_y) * (ls_y - rs_y)) END AS width
  FROM flat WINDOW w AS (PARTITION BY run ORDER BY t)),
sc AS (SELECT *, CASE WHEN ls_conf >= 0.3 AND rs_conf >= 0.3 THEN sqrt((ls_x3 - rs_x3) * (ls_x3 - rs_x3) + (ls_y3 - rs_y3) * (ls_y3 - rs_y3)) END AS width3,
  median(width) OVER (PARTITION BY run) AS scale, count(*) OVER (PARTITION BY run) AS n FROM sm),
st AS (SELECT *, """
    + ", ".join(f"CASE WHEN {n}_conf >= 0.3 AND lag({n}_conf) OVER w >= 0.3 AND scale > 0 THEN sqrt(({n}_x3 - lag({n}_x3) OVER w) * ({n}_x3 - lag({n}_x3) OVER w) + ({n}_y3 - lag({n}_y3) OVER w) * ({n}_y3 - lag({n}_y3) OVER w)) / scale * 25.0::DOUBLE END AS speed_{n[0]}" for n in ("lw", "rw"))
    + """, CASE WHEN scale > 0 THEN abs(width3 - lag(width3) OVER w) / scale * 25.0::DOUBLE END AS jump, least(lw_conf, rw_conf) < 0.3 AS low_conf
  FROM sc WINDOW w AS (PARTITION BY run ORDER BY t)),
kin AS (SELECT *, greatest(speed_l, speed_r) AS speed FROM st),
sp AS (SELECT *, coalesce(speed > 25.0, false) OR coalesce(jump > 3.0, false) AS spike FROM kin),
isl AS (SELECT run, t, sum(CAST(spike AS INTEGER)) OVER (PARTITION BY run ORDER BY t) AS island FROM sp),
seg AS (SELECT run, min(t) AS a, max(t) + 1 AS b FROM isl GROUP BY run, island HAVING max(t) + 1 - min(t) >= 4),
summ AS (SELECT p.*, CAST(coalesce(k.kept, 0) AS BIGINT) AS kept_frames, coalesce(k.longest, 0) AS longest, 1 - coalesce(k.kept, 0)::DOUBLE / n_frames AS drop_frac, n_spikes / (n_frames / 25.0::DOUBLE) AS spike_rate
  FROM (SELECT run, count(*) AS n_frames, count(*) FILTER (spike) AS n_spikes, coalesce(max(speed), 0.0::DOUBLE) AS max_speed, coalesce(max(jump), 0.0::DOUBLE) AS max_jump, avg(CAST(low_conf AS INTEGER)) AS low_conf_frac FROM sp GROUP BY run) p
  LEFT JOIN (SELECT run, sum(b - a) AS kept, max(b - a) AS longest FROM seg GROUP BY run) k USING (run))
"""
)
ORACLES = {
    "qc_clean_segments": _KIN + "SELECT run, a, b FROM seg",
    "wrist_speed": _KIN + "SELECT run, t, round(speed_l, 6) AS speed_l, round(speed_r, 6) AS speed_r, round(speed, 6) AS speed FROM kin",
    "shoulder_jump": _KIN + "SELECT run, t, round(scale, 6) AS scale, round(jump, 6) AS jump FROM kin",
    "median3": _KIN + "SELECT run, t, lw_x3 AS x, lw_y3 AS y FROM sm",
    "jitter": duck("v_frames") + """, d AS (SELECT run, x - 2 * lag(x, 1) OVER w + lag(x, 2) OVER w AS dx, y - 2 * lag(y, 1) OVER w + lag(y, 2) OVER w AS dy, conf FROM v_frames WINDOW w AS (PARTITION BY run, j ORDER BY t))
SELECT run, round(coalesce(median(CASE WHEN conf >= 0.3 THEN sqrt(dx * dx + dy * dy) END), 0.0), 6) AS jitter FROM d GROUP BY run""",
    "qc_summary": _KIN + "SELECT run, n_frames, n_spikes, kept_frames, longest, round(drop_frac, 6) AS drop_frac, round(spike_rate, 6) AS spike_rate, round(max_speed, 6) AS max_speed, round(max_jump, 6) AS max_jump, round(low_conf_frac, 6) AS low_conf_frac FROM summ",
    "qc_dispositions": _KIN + "SELECT run, CASE WHEN longest >= 5 THEN 'keep' ELSE 'discard' END AS disposition FROM summ",
    "qc_review_samples": _KIN + """, wo AS (SELECT run, max_speed FROM summ ORDER BY max_speed DESC, run LIMIT 3),
nr AS (SELECT run, max_speed FROM summ WHERE run NOT IN (SELECT run FROM wo) ORDER BY abs(max_speed - 25.0), run LIMIT 4)
SELECT run, 'worst' AS why, round(max_speed, 6) AS max_speed FROM wo UNION ALL SELECT run, 'borderline', round(max_speed, 6) FROM nr""",
    "preview_spans": duck("v_segments") + """, b AS (SELECT run, a, b, row_number() OVER (PARTITION BY run ORDER BY b - a DESC, a) AS k FROM v_segments)
SELECT run, a + greatest(0, (b - a - 75) // 2) AS a, a + greatest(0, (b - a - 75) // 2) + least(b - a, 75) AS b FROM b WHERE k = 1""",
    "frontal_spans": duck("v_signal") + """, g AS (SELECT run, t, t - lag(t) OVER (PARTITION BY run ORDER BY t) - 1 AS gap FROM v_signal WHERE flag),
i AS (SELECT run, t, sum(CASE WHEN gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY t) AS island FROM g)
SELECT run, min(t) AS a, max(t) AS b FROM i GROUP BY run, island HAVING max(t) - min(t) + 1 >= 4""",
}
