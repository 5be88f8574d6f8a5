"""Queries on streams and on the read-through cache, and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinelake.runtime import checkpoint_dir, table
from kinelake.sources.cache import read_through
from kinelake.streaming import events

WAITS = [60.0, 300.0, 900.0, 3600.0]
QUIET_S, LATE_S, LEAST = 6 * 3600, 600, 3


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}_{uuid.uuid4().hex}"


def _stream(spark, d):
    """The events table as a stream of files."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_counts(spark, d):
    """Events by hour and type."""
    folder = _folder(spark, "stream_counts")
    found = events.drain(events.windowed_counts(_stream(spark, d)), f"{folder}/out", f"{folder}/state", ["event_type", "start"])
    return found.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("total", 4).alias("total"))


def stream_limits(spark, d):
    """A cap of three events a day and back-off after high values in a row, for each user, as state of a stream."""
    folder = _folder(spark, "stream_limits")
    rows = _stream(spark, d).select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("value") > 10).alias("failed"))
    return events.drain(events.limits(rows, 3, WAITS), f"{folder}/out", f"{folder}/state").select("event_id", "n", "wait_us", "failures", "backoff_s")


def stream_islands(spark, d):
    """Stretches of three events or more of a user between values of 30 and above, closed by the next such value or by the watermark."""
    folder = _folder(spark, "stream_islands")
    rows = _stream(spark, d).select(F.col("user_id").alias("run"), "ts", "event_id", (F.col("value") >= 30).alias("flag"))
    return events.drain(events.islands(rows, LEAST, QUIET_S, f"{LATE_S} seconds"), f"{folder}/out", f"{folder}/state")


def feature_cache(spark, d):
    """Three passes through one cache: users whose number is even, all, all again; each user's features and whether they were there."""
    e = table(spark, d, "events").select("user_id", "value")
    path = _folder(spark, "features")
    extract = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("top"))
    out = None
    for number, rows in enumerate((e.where("user_id % 2 = 0"), e, e)):
        got = read_through(rows, ["user_id"], extract, path).select(F.lit(number).alias("pass"), "user_id", "n", "top", "hit")
        out = got if out is None else out.unionByName(got)
    return out


QUERIES = {f.__name__: f for f in (stream_counts, stream_limits, stream_islands, feature_cache)}
_LIMITS = """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, value > 10 AS failed FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n, lag(us, 2) OVER o AS nth,
             count(*) FILTER (NOT failed) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)),
f AS (SELECT *, count(*) FILTER (failed) OVER (PARTITION BY user_id, island ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM w)
SELECT event_id, n, CAST(CASE WHEN n < 3 THEN 0 ELSE greatest(0, coalesce(nth, us - 86400000000) + 86400000000 - us) END AS BIGINT) AS wait_us, failures,
       CAST(CASE failures WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 300 WHEN 3 THEN 900 ELSE 3600 END AS DOUBLE) AS backoff_s FROM f"""
ORACLES = {
    "stream_counts": "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_limits": _LIMITS,
    "stream_islands": f"""
WITH e AS (SELECT user_id AS run, epoch_us(ts) AS us, event_id, value >= 30 AS flag, row_number() OVER o - 1 AS t FROM events WINDOW o AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)),
i AS (SELECT *, count(*) FILTER (flag) OVER (PARTITION BY run ORDER BY t ROWS UNBOUNDED PRECEDING) AS island, max(us) OVER (PARTITION BY run) AS newest, max(us) OVER () AS latest FROM e),
s AS (SELECT run, island, min(t) AS a, max(t) + 1 AS b, max(newest) AS newest, max(latest) AS latest, max(island) AS mine FROM i GROUP BY run, island),
l AS (SELECT *, max(mine) OVER (PARTITION BY run) AS last FROM s)
SELECT run, a, b FROM l WHERE b - a >= {LEAST} AND (mine < last OR newest // 1000 + {QUIET_S * 1000} < latest // 1000 - {LATE_S * 1000})""",
    "feature_cache": """
WITH f AS (SELECT user_id, count(*) AS n, round(max(value), 6) AS top FROM events GROUP BY 1)
SELECT 0 AS pass, *, false AS hit FROM f WHERE user_id % 2 = 0 UNION ALL SELECT 1, *, user_id % 2 = 0 FROM f UNION ALL SELECT 2, *, true FROM f""",
}
