"""Queries on file listings, source fallback and ledger rows, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinelake.operators import scans
from kinelake.runtime import table


def _clips(spark, d):
    """(conductor, key, vid, num, stem) from parts."""
    num = F.lpad((F.col("p_partkey") % 7 + 1).cast("string"), 2, "0")
    vid = F.concat(F.lit("v"), (F.floor(F.col("p_partkey") / 3)).cast("string"))
    return table(spark, d, "part").select(F.col("p_brand").alias("conductor"), F.col("p_partkey").alias("key"), vid.alias("vid"), num.alias("num"), F.format_string("%s(%s)", vid, num).alias("stem"))


def clip_samples(spark, d):
    k = F.col("key") % 4
    stem = F.when(k == 0, F.concat("stem", F.lit("_c01"))).when(k == 1, F.col("vid")).otherwise(F.col("stem"))
    return scans.clip_samples(_clips(spark, d).select("conductor", stem.alias("stem")))


def source_fallback(spark, d):
    c = _clips(spark, d)
    named = lambda folder, every, stem: c.where(F.col("key") % every == 0).select("conductor", F.lit(folder).alias("folder"), stem.alias("stem"))
    files = named("hold", 7, F.col("stem")).union(named("clips", 3, F.col("stem"))).union(named("raw", 2, F.concat(F.lit("take "), F.col("key").cast("string"), F.lit(" ["), F.col("vid"), F.lit("]"))))
    i = table(spark, d, "lineitem").where("l_linenumber <= 3").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.col("l_quantity").cast("double").alias("start_sec"))
    spans = i.join(c.where("key % 5 <> 0"), i.l_partkey == c.key).select("conductor", F.col("vid").alias("video_id"), F.col("num").alias("clip_num"), "line_no", "start_sec", (F.col("start_sec") + 5).alias("end_sec"))
    rows = c.select("conductor", "key", F.col("vid").alias("video_id"), F.col("num").alias("clip_num"))
    return scans.resolve_sources(rows, files, spans)


def run_rows(spark, d):
    k = F.col("o_orderkey")
    span = lambda a, b: F.struct(F.lit(a).cast("long").alias("a"), b.cast("long").alias("b"))
    one, two = k % 97, k % 61
    q = F.struct(F.when(k % 2 == 0, 25.0).otherwise(29.97).alias("fps"), F.lit(500).alias("n_frames"), (one + two).alias("kept_frames"), F.array(span(0, one), span(100, 100 + two)).alias("segments"))
    clip = F.format_string("c%s(%s).mp4", F.col("o_custkey").cast("string"), F.lpad((k % 30).cast("string"), 2, "0"))
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("conductor"), k.alias("run"), F.concat(F.lit("runs/"), k.cast("string")).alias("run_dir"), clip.alias("source_clip"), F.when(k % 11 != 0, q).alias("qc"))
    n = F.explode(F.sequence(F.lit(0), F.lit(29)))
    c = table(spark, d, "customer").select("c_custkey", n.alias("n")).withColumn("m", (F.col("c_custkey") + F.col("n")) % 4).where("m < 3")
    verdict = F.when(F.col("m") == 0, "accept").when(F.col("m") == 1, "reject").otherwise("hold")
    return scans.run_rows(runs, c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("video_id"), F.col("n").cast("string").alias("clip_num"), verdict.alias("verdict")))


QUERIES = {f.__name__: f for f in (clip_samples, source_fallback, run_rows)}

_CLIPS = "WITH c AS (SELECT p_brand AS conductor, p_partkey AS key, 'v' || (p_partkey // 3) AS vid, lpad(CAST(p_partkey % 7 + 1 AS VARCHAR), 2, '0') AS num FROM part), k AS (SELECT *, vid || '(' || num || ')' AS stem FROM c)"
ORACLES = {
    "clip_samples": f"{_CLIPS} SELECT conductor, vid AS video_id, min(stem) AS stem FROM k WHERE key % 4 > 1 GROUP BY conductor, vid",
    "source_fallback": f"""{_CLIPS},
        s AS (SELECT conductor, vid, num, max(struct_pack(line_no := l_orderkey * 10 + l_linenumber, start_sec := CAST(l_quantity AS DOUBLE))) AS s FROM lineitem JOIN k ON l_partkey = key WHERE l_linenumber <= 3 AND key % 5 <> 0 GROUP BY ALL),
        h AS (SELECT DISTINCT conductor, stem FROM k WHERE key % 7 = 0), w AS (SELECT DISTINCT conductor, stem FROM k WHERE key % 3 = 0),
        r AS (SELECT conductor, vid, min('take ' || key || ' [' || vid || ']') AS raw FROM k WHERE key % 2 = 0 GROUP BY ALL),
        f AS (SELECT k.*, s.s, r.raw, CASE WHEN h.stem IS NOT NULL THEN 'hold' WHEN w.stem IS NOT NULL THEN 'clips' WHEN s.s IS NOT NULL AND r.raw IS NOT NULL THEN 'raw' END AS folder
          FROM k LEFT JOIN h USING (conductor, stem) LEFT JOIN w USING (conductor, stem) LEFT JOIN s USING (conductor, vid, num) LEFT JOIN r USING (conductor, vid))
        SELECT conductor, key, vid AS video_id, num AS clip_num, folder, CASE WHEN folder = 'raw' THEN raw WHEN folder IS NOT NULL THEN vid || '(' || num || ')' END AS name,
          CASE WHEN folder = 'raw' THEN s.start_sec END AS start_sec, CASE WHEN folder = 'raw' THEN s.start_sec + 5 END AS end_sec FROM f""",
    "run_rows": """WITH o AS (SELECT o_orderpriority AS conductor, o_orderkey AS k, o_custkey AS cust, o_orderkey % 30 AS num, o_orderkey % 11 <> 0 AS qc, CASE WHEN o_orderkey % 2 = 0 THEN 25.0::DOUBLE ELSE 29.97::DOUBLE END AS fps,
          greatest(o_orderkey % 97, o_orderkey % 61) AS longest, o_orderkey % 97 + o_orderkey % 61 AS kept FROM orders),
        d AS (SELECT c_custkey AS cust, range AS num, (c_custkey + range) % 4 AS m FROM customer, range(30))
        SELECT conductor, 'c' || o.cust AS video_id, CAST(o.num AS VARCHAR) AS clip_num, k AS run, 'runs/' || k AS run_dir, CASE WHEN qc THEN printf('%.3f', fps) ELSE '' END AS fps,
          CASE WHEN qc THEN '500' ELSE '' END AS n_frames, CASE WHEN qc THEN CAST(kept AS VARCHAR) ELSE '' END AS kept_frames, CASE WHEN qc THEN printf('%.2f', longest / fps) ELSE '' END AS longest_seg_s,
          CASE WHEN NOT qc THEN 'no_qc' WHEN longest > 0 AND longest >= 2.0 * fps THEN 'keep' ELSE 'discard' END AS disposition, CASE WHEN m = 0 THEN 'accept' ELSE '' END AS source_verdict,
          '' AS verdict, '' AS preview, '' AS judged_at FROM o LEFT JOIN d ON o.cust = d.cust AND o.num = d.num WHERE m IS NULL OR m <> 1""",
}
