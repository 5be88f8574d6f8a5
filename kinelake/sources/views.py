"""Views that present the benchmark tables in the shapes the engine works on: frames, runs, segments, ledgers, votes.

Each view is a function of (spark, sf_dir); ``DUCK`` has the same view in DuckDB's dialect, as a common table expression
for oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.runtime import table

#: Joints per frame of v_frames.
JOINTS = 21

#: Order of a run's segments, and how many of them a task of v_lengths holds on average: no more runs than a dictionary of Parquet has room for (1 MB, 131,072 of them).
_SEGMENT_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
SEGMENTS_A_TASK = 125_000


def v_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, t, joints array<struct<x, y, conf>>): one row per frame, joints inside, so a frame is read whole or pruned by column."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    joint = lambda j: F.struct(F.get("e", 3 * j).alias("x"), F.get("e", 3 * j + 1).alias("y"), F.least(F.lit(1.0), 8 * F.abs(F.get("e", 3 * j + 2))).alias("conf"))
    return e.select(
        F.col("label").alias("run"),
        (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("t"),
        F.transform(F.sequence(F.lit(0), F.lit(JOINTS - 1)), joint).alias("joints"),
    )


def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    verdict = F.when(F.col("toxic") == 1, "skeljump").when(F.col("quality") == 1, "accept").otherwise("reject")
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(
        F.col("lang").alias("conductor"), F.col("source").alias("video_id"), F.col("doc_id").alias("run"), verdict.alias("verdict"),
        F.when(F.col("doc_id") % 7 == 0, "accept").otherwise("").alias("source_verdict"),
        F.when(F.col("doc_id") % 2 == 0, 25.0).otherwise(29.97).alias("fps"), F.col("n_chars").alias("n_frames"),
    )


def v_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("run").orderBy(*_SEGMENT_ORDER)
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), *_SEGMENT_ORDER,
        (F.col("l_quantity") * 6).cast("int").alias("len"), ((F.col("l_tax") * 100).cast("int") + 1).alias("gap"), (F.col("l_returnflag") == "R").alias("contaminated"),
    )
    before = F.coalesce(F.sum(F.col("len") + F.col("gap")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("run", (F.row_number().over(order) - 1).alias("seg_idx"), before.cast("int").alias("a"), "len", "contaminated")
    return placed.select("run", "seg_idx", "a", (F.col("a") + F.col("len")).alias("b"), "contaminated")


def v_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, seg_idx, n): segments by their length, for what makes many rows of each. Tasks are as many as the segments ask for: sized by what they read, they would be few, and each would write far too much."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), *_SEGMENT_ORDER, (F.col("l_quantity") * 6).cast("int").alias("n"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // SEGMENTS_A_TASK))
    return rows.repartition(tasks, "run").select("run", (F.row_number().over(W.partitionBy("run").orderBy(*_SEGMENT_ORDER)) - 1).alias("seg_idx"), "n")


def v_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.col("text"), 256).alias("h"))
    low = d.groupBy("lang", "h").agg(F.min("doc_id").alias("vid_a"), F.count("*").alias("n")).where("n > 1")
    return d.join(low, ["lang", "h"]).where("doc_id <> vid_a").select(F.col("lang").alias("conductor"), "vid_a", F.col("doc_id").alias("vid_b"), F.lit("same").alias("verdict"))


def v_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.element_at(F.array(F.lit(" - II"), F.lit(" (1/2)"), F.lit(", III")), (F.col("p_partkey") % 3 + 1).cast("int"))
    title = F.concat("p_name", F.lit(": Symphony No. "), (F.col("p_size") % 3).cast("string"), tail)
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("conductor"), F.col("p_partkey").alias("video_id"), title.alias("title"))


def v_titles_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, z = (1950 + F.col("p_size")).cast("string"), (2001 + F.col("p_size") % 20).cast("string")
    y1 = (1951 + F.col("p_size")).cast("string")
    k = F.col("p_partkey") % 4
    tail = F.when(k == 0, F.concat(F.lit(" ("), y, F.lit(")"))).when(k == 1, F.concat(F.lit(" live "), y, F.lit(" remaster "), z)).when(k == 2, F.concat(F.lit(" "), y, F.lit(" vs "), y1)).otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("conductor"), F.col("p_partkey").alias("video_id"), F.concat("p_name", tail).alias("title"))


def v_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 11 = 0").select(F.col("p_brand").alias("conductor"), F.col("p_partkey").alias("video_id"), F.concat(F.lit("g_"), "p_type").alias("group"))


def v_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    per = o.groupBy("o_custkey").agg(F.min("y").alias("yr"), F.round(F.avg("o_totalprice"), 6).alias("score"))
    return per.join(c, per.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("conductor"), F.col("o_custkey").alias("video_id"), "yr", "score")


_LEDGER_VERDICT = "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'hold' ELSE '' END"


def v_ledger(spark: SparkSession, sf_dir: str, old: bool) -> DataFrame:
    """(conductor, video_id, run, source_verdict, verdict, preview, judged_at): a new scan, or the ledger before it."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 0" if old else "o_orderkey % 3 <> 0")
    verdict = F.expr(_LEDGER_VERDICT) if old else F.when(F.col("o_orderkey") % 7 == 0, "accept").otherwise("")
    return o.select(
        F.col("o_orderpriority").alias("conductor"), F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("run"),
        F.when(F.col("o_orderstatus") == "F", "accept").otherwise("").alias("source_verdict"), verdict.alias("verdict"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("old" if old else "new"), F.col("o_orderkey").cast("string"))).otherwise("").alias("preview"),
        F.when(F.length(verdict) > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("judged_at"),
    )


def v_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (F.row_number().over(order) - 1).alias("t"), (F.col("value") > 10).alias("flag"))


def v_repertoire(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_returnflag")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return i.join(p, i.l_partkey == p.p_partkey).select(
        (F.col("l_suppkey") % 5).alias("conductor"), F.col("l_orderkey").alias("video_id"), F.col("p_name").alias("piece"), F.when(F.col("l_returnflag") == "R", "doc").otherwise("live").alias("type")
    ).distinct()


def v_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("conductor"), (F.col("vec_id") % 20).alias("video_id"), "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("emb"))


def v_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conductor, video_id, win, y, p array<double>): probability rows of ten classes for every window, integer weights out of their sum."""
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # ten plain expressions: what takes elements out of the array needs no array at all
    w = F.array(*[((F.col("l_partkey") * (k + 3) + F.col("l_suppkey") * 7 + F.col("l_linenumber") * k) % 97 + 1).cast("double") for k in range(10)])
    i = i.select((F.col("l_orderkey") % 5).alias("conductor"), F.floor(F.col("l_orderkey") / 20).alias("video_id"), F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("win"), (F.col("l_orderkey") % 10).cast("int").alias("y"), w.alias("w"), "l_partkey", "l_suppkey")
    return i.select("conductor", "video_id", "run", "win", "l_partkey", "l_suppkey", "y", "w")


DUCK = {
    "v_frames": "v_frames AS (SELECT run, t, j, CAST(e[3*j+1] AS DOUBLE) AS x, CAST(e[3*j+2] AS DOUBLE) AS y, least(1.0, 8 * abs(CAST(e[3*j+3] AS DOUBLE))) AS conf FROM (SELECT label AS run, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS t, embedding AS e FROM embeddings) f, (SELECT CAST(range AS INTEGER) AS j FROM range(21)) g)",
    "v_runs": "v_runs AS (SELECT lang AS conductor, source AS video_id, d.doc_id AS run, CASE WHEN toxic = 1 THEN 'skeljump' WHEN quality = 1 THEN 'accept' ELSE 'reject' END AS verdict, CASE WHEN d.doc_id % 7 = 0 THEN 'accept' ELSE '' END AS source_verdict, CASE WHEN d.doc_id % 2 = 0 THEN 25.0::DOUBLE ELSE 29.97::DOUBLE END AS fps, n_chars AS n_frames FROM labels l JOIN documents d ON l.doc_id = d.doc_id)",
    "v_segments": "v_segments AS (SELECT run, seg_idx, a, a + len AS b, contaminated FROM (SELECT l_orderkey AS run, CAST(row_number() OVER w - 1 AS INTEGER) AS seg_idx, CAST(coalesce(sum(CAST(l_quantity * 6 AS INTEGER) + CAST(trunc(l_tax * 100) AS INTEGER) + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS a, CAST(l_quantity * 6 AS INTEGER) AS len, l_returnflag = 'R' AS contaminated FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)))",
    "v_dup_pairs": "v_dup_pairs AS (SELECT lang AS conductor, vid_a, doc_id AS vid_b, 'same' AS verdict FROM (SELECT lang, doc_id, min(doc_id) OVER (PARTITION BY lang, text) AS vid_a FROM documents) WHERE doc_id <> vid_a)",
    "v_titles": "v_titles AS (SELECT p_brand AS conductor, p_partkey AS video_id, p_name || ': Symphony No. ' || (p_size % 3) || CASE p_partkey % 3 WHEN 0 THEN ' - II' WHEN 1 THEN ' (1/2)' ELSE ', III' END AS title FROM part)",
    "v_titles_years": "v_titles_years AS (SELECT p_brand AS conductor, p_partkey AS video_id, p_name || CASE p_partkey % 4 WHEN 0 THEN ' (' || (1950 + p_size) || ')' WHEN 1 THEN ' live ' || (1950 + p_size) || ' remaster ' || (2001 + p_size % 20) WHEN 2 THEN ' ' || (1950 + p_size) || ' vs ' || (1951 + p_size) ELSE '' END AS title FROM part)",
    "v_groups": "v_groups AS (SELECT p_brand AS conductor, p_partkey AS video_id, 'g_' || p_type AS \"group\" FROM part WHERE p_partkey % 11 = 0)",
    "v_recordings": "v_recordings AS (SELECT c_mktsegment AS conductor, o_custkey AS video_id, CAST(min(year(o_orderdate)) AS INTEGER) AS yr, round(avg(o_totalprice), 6) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)",
    "v_ledger_new": "v_ledger_new AS (SELECT o_orderpriority AS conductor, o_custkey AS video_id, o_orderkey AS run, CASE WHEN o_orderstatus = 'F' THEN 'accept' ELSE '' END AS source_verdict, CASE WHEN o_orderkey % 7 = 0 THEN 'accept' ELSE '' END AS verdict, CASE WHEN o_orderkey % 2 = 0 THEN 'new' || o_orderkey ELSE '' END AS preview, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS judged_at FROM orders WHERE o_orderkey % 3 <> 0)",
    "v_ledger_old": f"v_ledger_old AS (SELECT o_orderpriority AS conductor, o_custkey AS video_id, o_orderkey AS run, CASE WHEN o_orderstatus = 'F' THEN 'accept' ELSE '' END AS source_verdict, {_LEDGER_VERDICT} AS verdict, CASE WHEN o_orderkey % 2 = 0 THEN 'old' || o_orderkey ELSE '' END AS preview, CASE WHEN {_LEDGER_VERDICT} <> '' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS judged_at FROM orders WHERE o_orderkey % 4 <> 0)",
    "v_signal": "v_signal AS (SELECT user_id AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS t, value > 10 AS flag FROM events)",
    "v_repertoire": "v_repertoire AS (SELECT DISTINCT l_suppkey % 5 AS conductor, l_orderkey AS video_id, p_name AS piece, CASE WHEN l_returnflag = 'R' THEN 'doc' ELSE 'live' END AS type FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "v_faces": "v_faces AS (SELECT label AS conductor, vec_id % 20 AS video_id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS emb FROM embeddings)",
    "v_votes": "v_votes AS (SELECT l_orderkey % 5 AS conductor, l_orderkey // 20 AS video_id, l_orderkey AS run, l_linenumber AS win, l_partkey, l_suppkey, CAST(l_orderkey % 10 AS INTEGER) AS y, list_transform(range(10), lambda k: CAST((l_partkey * (k + 3) + l_suppkey * 7 + l_linenumber * k) % 97 + 1 AS DOUBLE)) AS w FROM lineitem)",
}


def duck(*names: str) -> str:
    """WITH clause of the named views."""
    return "WITH RECURSIVE " + ",\n".join(DUCK[n] for n in names)
