"""Queries on review boards, year edits, pacing and padded windows, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import boards as b
from kinelake.operators import evaluate as e
from kinelake.runtime import table
from kinelake.sources import views as v
from kinelake.sources.views import duck

_YEARS = ("", " ", "1985", "1980s")


def _meta(spark, d):
    k = F.col("p_partkey")
    year = F.element_at(F.array(*map(F.lit, _YEARS)), (k % 4 + 1).cast("int"))
    title_year = (k % 90 + 1930).cast("string")
    return table(spark, d, "part").select(k.alias("ordinal"), F.col("p_brand").alias("conductor"), F.concat(F.lit("v"), (k % 700).cast("string")).alias("video_id"), F.col("p_name").alias("title"), title_year.alias("year_title"), year.alias("year_manual"))


def _edits(spark, d):
    k = F.col("s_suppkey")
    value = F.when(k % 3 == 0, (k % 200 + 1850).cast("string")).when(k % 3 == 1, F.concat((k % 10).cast("string"), F.lit("0s"))).otherwise("soon")
    return table(spark, d, "supplier").select(F.concat(F.lit("v"), (k * 13).cast("string")).alias("video_id"), value.alias("value"))


def meta_merge(spark, d):
    m = _meta(spark, d)
    old = m.where("ordinal % 5 <> 0").withColumn("year_manual", F.when(F.col("ordinal") % 7 == 0, "").otherwise(F.concat(F.lit("19"), (F.col("ordinal") % 90 + 10).cast("string"))))
    return b.merge_meta(m, old.select("video_id", "year_manual", "ordinal"))


def year_tab(spark, d):
    samples = _meta(spark, d).where("ordinal % 3 = 0").groupBy("conductor", "video_id").agg(F.min(F.format_string("%s(%02d)", "video_id", F.col("ordinal") % 9)).alias("stem"))
    return b.year_rows(_meta(spark, d), samples, "empty")


def year_edits(spark, d):
    return b.set_years(_meta(spark, d), _edits(spark, d))


def year_edit_errors(spark, d):
    return b.year_edit_errors(_meta(spark, d), _edits(spark, d))


def _board_rows(spark, d):
    k = F.col("p_partkey")
    verdict = F.element_at(F.array(*[F.lit(x) for x in ("accept", "hold ", "reject", "", "other")]), (k % 5 + 1).cast("int"))
    stem = F.format_string("k%d(%02d)", k, k % 30)
    crops = F.when(k % 4 == 0, "1.0-2.5;4.0-6.0").otherwise("")
    return table(spark, d, "part").select(k.alias("k"), stem.alias("stem"), F.concat(F.lit("k"), k.cast("string")).alias("video_id"), (k % 30).cast("string").alias("clip_num"), verdict.alias("verdict"), F.lit("9.5").alias("dur_s"), crops.alias("crops"))


def review_board(spark, d):
    rows = _board_rows(spark, d)
    at = lambda folder, every, name: rows.where(F.col("k") % every == 0).select(F.lit(folder).alias("folder"), name.alias("stem"))
    files = at("hold", 3, F.col("stem")).union(at("clips", 7, F.col("stem"))).union(at("clips", 2, F.concat("stem", F.lit("_c00")))).union(at("clips", 11, F.concat(F.lit("x"), "stem"))).union(at("clips", 13, F.lit("odd name")))
    return b.board(rows.drop("k"), files)


def pacing_waits(spark, d):
    n = (F.col("o_orderkey") % 12).cast("int")
    return table(spark, d, "orders").select("o_orderkey", b.batch_end(n, 5).alias("rests"), b.backoff(n, [60, 300, 900, 3600]).alias("wait_s"))


def local_hands(spark, d):
    rows = v.v_frames(spark, d).select("run", "t", F.posexplode(b.localize_hands(F.col("joints"), (9, 15), 5)).alias("j", "p"))
    return rows.select("run", "t", "j", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def _padded(signal):
    rows = signal.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("t", F.col("flag").cast("double").alias("x")))).alias("s"))
    x = F.transform("s", lambda p: p["x"])
    steps = F.transform(x, lambda a, i: F.coalesce(F.get(x, i + 1) - a, F.lit(0.0)))
    return rows.select("run", b.padded(steps, 32, 1.0).alias("p")).select("run", F.posexplode(F.arrays_zip("p.values", "p.mask")).alias("i", "p")).select("run", "i", F.col("p.values").alias("value"), F.col("p.mask").alias("mask"))


def padded_steps(spark, d):
    return _padded(v.v_signal(spark, d))


def _hits(spark, d):
    w = v.v_votes(spark, d)
    return w.select((F.col("run") % 5).alias("fold"), F.when(F.col("y") == 9, -1).otherwise(F.col("y")).alias("y"), (e.argmax(F.col("w")) == F.col("y")).alias("hit"), (F.col("win") % 3 == 0).alias("is_pad"))


def padded_tallies(spark, d):
    return b.padded_tallies(_hits(spark, d))


def fold_accuracy(spark, d):
    return b.fold_accuracy(_hits(spark, d)).select("folds", F.round("mean_acc", 6).alias("mean_acc"), F.round("pooled_acc", 6).alias("pooled_acc"))


QUERIES = {f.__name__: f for f in (meta_merge, year_tab, year_edits, year_edit_errors, review_board, pacing_waits, local_hands, padded_steps, padded_tallies, fold_accuracy)}

_M = "m AS (SELECT p_partkey AS ordinal, p_brand AS conductor, 'v' || (p_partkey % 700) AS video_id, p_name AS title, CAST(p_partkey % 90 + 1930 AS VARCHAR) AS year_title, ['', ' ', '1985', '1980s'][p_partkey % 4 + 1] AS year_manual FROM part)"
_E = """e AS (SELECT 'v' || (s_suppkey * 13) AS video_id, CASE s_suppkey % 3 WHEN 0 THEN CAST(s_suppkey % 200 + 1850 AS VARCHAR) WHEN 1 THEN (s_suppkey % 10) || '0s' ELSE 'soon' END AS value FROM supplier),
n AS (SELECT *, CASE WHEN value LIKE '%s' AND value <> 'soon' THEN CASE WHEN value[1] >= '3' THEN '19' || value WHEN value[1] <= '2' THEN '20' || value END WHEN try_cast(value AS INT) BETWEEN 1930 AND 2029 THEN value END AS norm FROM e)"""
_H = duck("v_votes") + ", h AS (SELECT run % 5 AS fold, CASE WHEN y = 9 THEN -1 ELSE y END AS y, list_position(w, list_max(w)) - 1 = y AS hit, win % 3 = 0 AS is_pad FROM v_votes)"
ORACLES = {
    "meta_merge": f"WITH {_M}, o AS (SELECT video_id, arg_max(CASE WHEN ordinal % 7 = 0 THEN '' ELSE '19' || (ordinal % 90 + 10) END, ordinal) AS kept FROM m WHERE ordinal % 5 <> 0 GROUP BY 1) SELECT ordinal, conductor, m.video_id, title, year_title, CASE WHEN coalesce(kept, '') <> '' THEN kept ELSE year_manual END AS year_manual FROM m LEFT JOIN o USING (video_id)",
    "year_tab": f"WITH {_M}, s AS (SELECT conductor, video_id, min(video_id || '(0' || (ordinal % 9) || ')') AS clip FROM m WHERE ordinal % 3 = 0 GROUP BY 1, 2) SELECT conductor, video_id, title, year_title, year_manual, clip, false AS filled FROM m JOIN s USING (conductor, video_id) WHERE trim(year_manual) = ''",
    "year_edits": f"WITH {_M}, {_E}, f AS (SELECT video_id, min(ordinal) AS ordinal FROM m GROUP BY 1), c AS (SELECT ordinal, norm FROM f JOIN n USING (video_id) WHERE norm IS NOT NULL) SELECT m.ordinal, conductor, video_id, title, year_title, coalesce(norm, year_manual) AS year_manual FROM m LEFT JOIN c USING (ordinal)",
    "year_edit_errors": f"WITH {_M}, {_E} SELECT video_id, value, CASE WHEN norm IS NULL THEN 'not a year' ELSE 'no such video' END AS error FROM n WHERE norm IS NULL OR video_id NOT IN (SELECT video_id FROM m)",
    "review_board": """WITH r AS (SELECT p_partkey AS k, 'k' || p_partkey || '(' || lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') || ')' AS stem FROM part)
        SELECT ['accept', 'hold', 'reject'][k % 5 + 1] AS verdict, stem, 'k' || k AS video_id, lpad(CAST(k % 30 AS VARCHAR), 2, '0') AS clip_num, '9.5' AS dur_s, CASE WHEN k % 4 = 0 THEN '1.0-2.5;4.0-6.0' ELSE '' END AS crops, false AS auto,
          CASE WHEN k % 3 = 0 OR k % 7 = 0 THEN stem WHEN k % 4 = 0 THEN stem || '_c00' END AS file, NOT (k % 3 = 0 OR k % 7 = 0) AS locked FROM r WHERE k % 5 < 3
        UNION ALL SELECT 'accept', 'x' || stem, 'xk' || k, lpad(CAST(k % 30 AS VARCHAR), 2, '0'), '', '', true, 'x' || stem, false FROM r WHERE k % 11 = 0""",
    "pacing_waits": "SELECT o_orderkey, o_orderkey % 12 IN (5, 10) AS rests, CAST(CASE o_orderkey % 12 WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 900 ELSE 3600 END AS DOUBLE) AS wait_s FROM orders",
    "local_hands": duck("v_frames") + ", h AS (SELECT *, CASE WHEN j BETWEEN 9 AND 13 THEN 9 WHEN j BETWEEN 15 AND 19 THEN 15 END AS w FROM v_frames) SELECT run, t, j, " + ", ".join(f"round({c} - coalesce(CASE w WHEN 9 THEN max({c}) FILTER (j = 9) OVER o WHEN 15 THEN max({c}) FILTER (j = 15) OVER o END, 0), 6) AS {c}" for c in "xy") + " FROM h WINDOW o AS (PARTITION BY run, t)",
    "padded_steps": duck("v_signal") + """, s AS (SELECT run, CAST(t AS INTEGER) AS i, CAST(coalesce(lead(flag::INT) OVER (PARTITION BY run ORDER BY t) - flag::INT, 0) AS DOUBLE) AS value FROM v_signal), n AS (SELECT run, count(*) AS n FROM s GROUP BY 1)
        SELECT run, i, value, 1 AS mask FROM s UNION ALL SELECT run, CAST(range AS INTEGER), 1.0::DOUBLE, 0 FROM n, range(32) WHERE range >= n""",
    "padded_tallies": f"{_H} SELECT y, count(*) FILTER (is_pad) AS pad_n, count(*) FILTER (is_pad AND hit) AS pad_ok, count(*) FILTER (NOT is_pad) AS unpad_n, count(*) FILTER (NOT is_pad AND hit) AS unpad_ok FROM h GROUP BY y",
    "fold_accuracy": f"{_H}, f AS (SELECT fold, count(*) FILTER (hit) AS ok, count(*) AS n FROM h GROUP BY 1) SELECT count(*) AS folds, round(avg(ok::DOUBLE / n), 6) AS mean_acc, round(sum(ok)::DOUBLE / sum(n)::DOUBLE, 6) AS pooled_acc FROM f",
}
