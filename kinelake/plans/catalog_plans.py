"""Queries on the catalog, titles and ledgers, and their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kinelake.functions import text
from kinelake.operators import curation as c
from kinelake.operators import sessions as s
from kinelake.runtime import ship, table
from kinelake.sources import views as v
from kinelake.sources.views import duck


def accepted_runs(spark, d):
    return c.accepted(v.v_runs(spark, d)).select("conductor", "video_id", "run", "fps")


def ood_antijoin(spark, d):
    ood = table(spark, d, "documents").where("n_chars < 200").select(F.col("lang").alias("conductor"), F.col("source").alias("video_id"))
    return c.without(c.accepted(v.v_runs(spark, d)), ood, ["conductor", "video_id"]).select("conductor", "video_id", "run")


def segment_blacklist(spark, d):
    seg = v.v_segments(spark, d)
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("conductor"), F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("run"), F.when(F.col("o_orderkey") % 2 == 0, 25.0).otherwise(29.97).alias("fps"))
    return c.usable_segments(runs, seg, seg.where("contaminated").select("run", "seg_idx"), 38)


def footage_quality(spark, d):
    """Frames and footage-weighted confidence per video."""
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("run"), F.floor("o_totalprice").cast("long").alias("conf"))
    return c.footage(runs, v.v_segments(spark, d)).select("video_id", "footage", F.round("quality", 6).alias("quality"))


def _clusters(spark, d):
    e = v.v_dup_pairs(spark, d).where("verdict = 'same'")
    pair = lambda x: F.struct("conductor", F.col(x).alias("v"))
    found = c.components(e.select(pair("vid_a").alias("a"), pair("vid_b").alias("b")))
    return found.select(F.col("node.conductor").alias("conductor"), F.col("node.v").alias("video_id"), F.col("component.v").alias("component"))


def duplicate_clusters(spark, d):
    return _clusters(spark, d)


def duplicate_drop(spark, d):
    videos = table(spark, d, "documents").select(F.col("lang").alias("conductor"), F.col("doc_id").alias("video_id"), F.col("n_chars").alias("footage"), (F.col("doc_id") % 5).alias("quality"))
    return c.duplicate_drop(videos, _clusters(spark, d))


def ledger_merge(spark, d):
    return c.merge_ledger(v.v_ledger(spark, d, False), v.v_ledger(spark, d, True))


def ledger_interleave(spark, d):
    return c.interleaved(v.v_ledger(spark, d, False)).select("conductor", "video_id", "run", "round", "position")


def _ledger_scored(spark, d):
    return v.v_ledger(spark, d, True).select("run", "verdict", F.when(F.col("run") % 3 == 0, F.format_string("%.4f", F.col("run") % 997 / 997.0)).alias("model_p"), F.when(F.col("run") % 2 == 0, F.col("run") % 89 / 89.0).alias("rescore_p90"))


def review_queue(spark, d):
    """Every pending row with its position, as is done by default."""
    return c.review_queue(_ledger_scored(spark, d)).select("position", "run", "model_p")


def review_queue_accepts(spark, d):
    """All rows, judged ones too, the least probable rejects first."""
    return c.review_queue(_ledger_scored(spark, d), only_pending=False, accept_first=True).select("position", "run", "model_p")


def undo_pick(spark, d):
    return c.undo_pick(v.v_ledger(spark, d, True))


def undo_reset(spark, d):
    return c.undo(v.v_ledger(spark, d, True))


def model_apply(spark, d):
    """Judged rows already have a probability from before, which stays."""
    scores = table(spark, d, "orders").where("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("run"), ((F.col("o_orderkey") % 1009) / 1009.0).alias("p"))
    rows = v.v_ledger(spark, d, True).select("conductor", "run", "verdict", "preview", F.when(F.col("run") % 5 == 0, "0.1234").otherwise("").alias("model_p"))
    return c.apply_model(rows, scores, 0.9)


def record_verdicts(spark, d):
    """Every third run's verdict is given anew or taken back."""
    verdict = F.element_at(F.array(*map(F.lit, ("accept", "reject", ""))), (F.floor(F.col("run") / 3) % 3 + 1).cast("int"))
    changes = v.v_ledger(spark, d, True).where("run % 3 = 0").select("conductor", "run", verdict.alias("verdict"))
    return c.record_verdicts(v.v_ledger(spark, d, True), changes, F.lit("2026-01-02T03:04:05"))


def record_clip_verdicts(spark, d):
    """Clips are named by video and number with or without leading zeros; a verdict without crops clears them."""
    clips = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("v"), (F.col("p_partkey") % 900).cast("string")).alias("video_id"), (F.col("p_partkey") % 12).cast("string").alias("clip_num"), F.lit("hold").alias("verdict"), F.when(F.col("p_partkey") % 2 == 0, "1.00-2.00").otherwise("").alias("crops"))
    changes = clips.where("k % 900 = k AND k % 4 = 0").select("video_id", F.lpad("clip_num", 2, "0").alias("clip_num"), F.lit("accept").alias("verdict"), F.when(F.col("k") % 8 == 0, "3.00-4.00").alias("crops"))
    return c.record_clip_verdicts(clips, changes)


def write_read(spark, d):
    """A ledger written in each format and read back."""
    from kinelake.runtime import checkpoint_dir

    out, name = None, f"{checkpoint_dir(spark)}/ledger_{uuid.uuid4().hex}"
    for fmt in ("parquet", "orc", "json", "csv"):
        path = c.write_table(v.v_ledger(spark, d, True).select("conductor", "run", "verdict"), f"{name}_{fmt}", fmt)
        back = spark.read.schema("conductor string, run long, verdict string").format(fmt).option("header", True).load(path).select("run", F.coalesce("verdict", F.lit("")).alias("verdict"), F.lit(fmt).alias("fmt"))
        out = back if out is None else out.unionByName(back)
    return out.groupBy("fmt", "verdict").agg(F.count("*").alias("n"), F.sum("run").alias("runs"))


def first_year(spark, d):
    k = F.col("p_partkey")
    m = table(spark, d, "part").select(k.alias("video_id"), F.when(k % 3 == 0, F.concat((1900 + k % 120).cast("string"), F.lit("s "))).when(k % 3 == 1, " soon").alias("year_manual"), F.when(k % 2 == 0, F.concat(F.lit(" "), (1950 + k % 60).cast("string"), F.lit("-05"))).otherwise("").alias("year_desc"), (1960 + k % 50).cast("string").alias("year_title"))
    return m.select("video_id", text.first_year(F.col("year_manual"), F.col("year_desc"), F.when(F.col("video_id") % 5 != 0, F.col("year_title"))).alias("year"))


def metadata_gate(spark, d):
    p = table(spark, d, "part")
    why = c.metadata_gate(F.col("p_name"), F.col("p_brand"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")), F.when(F.col("p_partkey") % 4 != 0, F.floor("p_retailprice").cast("int")), ["A", "e"], ["steel"], 5, 45, 1000)
    return p.select("p_partkey", why.alias("why"))


def failure_class(spark, d):
    said = F.concat(F.lit("ERROR: "), F.element_at(F.array(*[F.lit(x) for x in ("HTTP Error 429: Too Many Requests", "Private video", "Connection reset by peer", "Video unavailable. Sign in to confirm")]), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return table(spark, d, "orders").select("o_orderkey", c.failure_class(said).alias("kind"))


def rolling_cap_wait(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return c.rolling_cap_wait(e, 3).select("event_id", "n", "wait_us")


def title_normalize(spark, d):
    return v.v_titles(spark, d).select("video_id", text.normalize_title(F.col("title")).alias("norm"))


def work_numbers(spark, d):
    return v.v_titles(spark, d).select("video_id", F.array_join(text.work_numbers(F.col("title")).cast("array<string>"), ",").alias("nums"))


def sessions_exact(spark, d):
    t = v.v_titles(spark, d)
    return s.sessions(t, s.title_edges(t, None))


def sessions_fuzzy(spark, d):
    ship(spark)
    t = v.v_titles(spark, d)
    return s.sessions(t, s.title_edges(t))


def merge_overrides(spark, d):
    t = v.v_titles(spark, d)
    return s.sessions(t, s.title_edges(t, None).union(s.merge_edges(v.v_groups(spark, d))))


def year_strict(spark, d):
    return v.v_titles_years(spark, d).select("video_id", text.year_strict(F.col("title")).alias("year"))


def year_ranked(spark, d):
    """Titles of all kinds, some after the video's upload, some without a year of upload."""
    k = F.col("video_id")
    tails = ["", " recorded op 1985", " op 1985-03-04", " live 1990", " no. 1950 [1971]", " 3 May 1966 (1970)"]
    t = v.v_titles_years(spark, d).withColumn("title", F.concat("title", F.element_at(F.array(*map(F.lit, tails)), (k % 6 + 1).cast("int"))))
    t = t.select("video_id", text.year_ranked(F.col("title"), F.when(k % 5 == 0, 1980).when(k % 5 == 1, 2026), F.lit(2026)).alias("g"))
    return t.select("video_id", "g.year", "g.confidence")


def era_bucket(spark, d):
    y = 1950 + F.col("p_size")
    return table(spark, d, "part").select("p_partkey", text.era_bucket(y, y, ["1950s", "1960s~70s", "1980s", "1990s~10s"]).alias("era"))


def year_span(spark, d):
    raw = F.when(F.col("p_partkey") % 4 == 0, (1925 + F.col("p_size")).cast("string")).when(F.col("p_partkey") % 4 == 1, F.concat(((F.col("p_size") % 10) * 10).cast("string"), F.lit("s"))).when(F.col("p_partkey") % 4 == 2, F.concat((1920 + F.col("p_size") * 2).cast("string"), F.lit("s"))).otherwise("")
    t = table(spark, d, "part").select("p_partkey", raw.alias("raw"))
    span = text.year_span(F.col("raw"))
    return t.select("p_partkey", text.normalize_year_input(F.col("raw")).alias("norm"), span["lo"].alias("lo"), span["hi"].alias("hi"))


def video_ids(spark, d):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat("p_name", F.lit(" [AbC-_"), F.lpad(k.cast("string"), 6, "0"), F.lit("].mp4"))).when(k % 3 == 1, F.concat(F.lit("vid"), F.lpad(k.cast("string"), 8, "0"), F.lit(".mp4"))).otherwise("Mendelssohn.mp4")
    stem = F.concat(F.lit("v"), k.cast("string"), F.lit("("), F.lpad((k % 40).cast("string"), 2, "0"), F.when(k % 5 == 0, "").otherwise(")"), F.when(k % 2 == 0, "_c01").otherwise(""))
    t = table(spark, d, "part").select("p_partkey", text.video_id(name).alias("id"), text.clip_stem(stem).alias("s"))
    return t.select("p_partkey", "id", F.col("s.video_id").alias("clip"), F.col("s.num").alias("num"))


def crops(spark, d):
    q = F.col("p_size")
    raw = F.concat((q + 10).cast("string"), F.lit("-"), (q + 20).cast("string"), F.lit(";"), q.cast("string"), F.lit("-"), (q * 2 - 5).cast("string"), F.lit(";x-1"))
    span = text.http_range(F.concat(F.lit("bytes="), F.when(q % 3 == 0, "").otherwise(q.cast("string")), F.lit("-"), F.when(q % 4 == 0, "").otherwise((q * 2).cast("string"))), F.lit(60))
    return table(spark, d, "part").select("p_partkey", text.format_crops(text.parse_crops(raw)).alias("crops"), span["a"].alias("a"), span["z"].alias("z"))


QUERIES = {f.__name__: f for f in (accepted_runs, ood_antijoin, segment_blacklist, footage_quality, duplicate_clusters, duplicate_drop, ledger_merge, ledger_interleave, review_queue, review_queue_accepts, undo_pick, undo_reset, model_apply, record_verdicts, record_clip_verdicts, write_read, first_year, metadata_gate, failure_class, rolling_cap_wait, title_normalize, work_numbers, sessions_exact, sessions_fuzzy, merge_overrides, year_strict, year_ranked, era_bucket, year_span, video_ids, crops)}

_ACC = "acc AS (SELECT * FROM v_runs WHERE verdict = 'accept' OR source_verdict = 'accept')"
_DUP = duck("v_dup_pairs") + """, e AS (SELECT conductor, vid_a AS a, vid_b AS b FROM v_dup_pairs UNION SELECT conductor, vid_b, vid_a FROM v_dup_pairs),
r AS (SELECT conductor, a AS n, a AS m FROM e UNION SELECT r.conductor, r.n, e.b FROM r JOIN e ON r.conductor = e.conductor AND r.m = e.a),
cl AS (SELECT conductor, n AS video_id, min(m) AS component FROM r GROUP BY 1, 2) """
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '\\(\\s*\\d\\s*/\\s*\\d\\s*\\)', ' ', 'g'), '\\b(?:mvmt|movement|mov)\\.?\\s*\\d+(?:\\s*&\\s*\\d+)*\\b', ' ', 'g'), '\\b(?:part|pt)\\.?\\s*\\d+\\b', ' ', 'g'), '\\d+\\s*악장', ' ', 'g'), ',\\s*[ivx]+\\b', ' ', 'g'), '\\s-\\s[ivx]+\\b', ' ', 'g'), '\\b[ivx]{1,4}\\b', ' ', 'g'), '[^a-z0-9가-힣 ]', ' ', 'g'), ' +', ' ', 'g'))"
_SESS = f""", t AS (SELECT conductor, video_id, {_NORM} AS norm FROM v_titles), e0 AS (SELECT conductor, video_id AS b, min(video_id) OVER (PARTITION BY conductor, norm) AS a FROM t WHERE norm <> ''{{more}}),
e AS (SELECT conductor, a, b FROM e0 WHERE a <> b UNION SELECT conductor, b, a FROM e0 WHERE a <> b),
r AS (SELECT conductor, video_id AS n, video_id AS m FROM t UNION SELECT r.conductor, r.n, e.b FROM r JOIN e ON r.conductor = e.conductor AND r.m = e.a)
SELECT conductor, n AS video_id, min(m) AS session FROM r GROUP BY 1, 2"""
_QUEUE = ", q AS (SELECT run, verdict, CASE WHEN run % 3 = 0 THEN printf('%.4f', run % 997 / 997.0::DOUBLE) END AS model_p, CASE WHEN run % 2 = 0 THEN run % 89 / 89.0::DOUBLE END AS p90 FROM v_ledger_old)"
ORACLES = {
    "accepted_runs": duck("v_runs") + f", {_ACC} SELECT conductor, video_id, run, fps FROM acc",
    "ood_antijoin": duck("v_runs") + f", {_ACC} SELECT conductor, video_id, run FROM acc WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE n_chars < 200 AND d.lang = conductor AND d.source = video_id)",
    "segment_blacklist": duck("v_segments") + """, x AS (SELECT o_orderpriority AS conductor, o_custkey AS video_id, run, seg_idx, CAST(round_even(a * (25.0::DOUBLE / CASE WHEN run % 2 = 0 THEN 25.0::DOUBLE ELSE 29.97::DOUBLE END), 0) AS INTEGER) AS a,
CAST(round_even(b * (25.0::DOUBLE / CASE WHEN run % 2 = 0 THEN 25.0::DOUBLE ELSE 29.97::DOUBLE END), 0) AS INTEGER) AS b FROM v_segments JOIN orders ON o_orderkey = run WHERE NOT contaminated) SELECT * FROM x WHERE b - a >= 38""",
    "footage_quality": duck("v_segments") + """, p AS (SELECT run, sum(b - a) AS frames FROM v_segments GROUP BY run)
SELECT o_custkey AS video_id, CAST(sum(frames) AS BIGINT) AS footage, round(CAST(sum(CAST(floor(o_totalprice) AS BIGINT) * frames) AS DOUBLE) / CAST(sum(frames) AS DOUBLE), 6) AS quality FROM p JOIN orders ON o_orderkey = run GROUP BY 1""",
    "duplicate_clusters": _DUP + "SELECT * FROM cl",
    "duplicate_drop": _DUP + """, p AS (SELECT cl.*, n_chars, row_number() OVER (PARTITION BY conductor, component ORDER BY n_chars DESC, doc_id % 5 DESC, doc_id) AS k, count(*) OVER (PARTITION BY conductor, component) AS n FROM cl JOIN documents ON doc_id = video_id AND lang = conductor)
SELECT conductor, video_id, component FROM p WHERE n >= 2 AND k > 1""",
    "ledger_merge": duck("v_ledger_new", "v_ledger_old") + """ SELECT coalesce(n.conductor, o.conductor) AS conductor, coalesce(n.run, o.run) AS run, coalesce(n.video_id, o.video_id) AS video_id, coalesce(n.source_verdict, o.source_verdict) AS source_verdict,
CASE WHEN n.run IS NULL THEN o.verdict ELSE coalesce(nullif(o.verdict, ''), n.verdict, '') END AS verdict, CASE WHEN n.run IS NULL THEN o.preview ELSE coalesce(nullif(n.preview, ''), o.preview, '') END AS preview,
CASE WHEN o.run IS NOT NULL THEN o.judged_at ELSE n.judged_at END AS judged_at FROM v_ledger_new n FULL JOIN v_ledger_old o ON n.conductor = o.conductor AND n.run = o.run WHERE n.run IS NOT NULL OR o.verdict <> ''""",
    "ledger_interleave": duck("v_ledger_new") + """, k AS (SELECT conductor, video_id, run, CAST(row_number() OVER (PARTITION BY conductor, video_id ORDER BY run) AS INTEGER) AS round FROM v_ledger_new)
SELECT *, row_number() OVER (ORDER BY round, conductor, video_id) AS position FROM k""",
    "review_queue": duck("v_ledger_old") + _QUEUE + " SELECT row_number() OVER (ORDER BY model_p IS NULL, CAST(model_p AS DECIMAL(6,4)) DESC NULLS LAST, coalesce(p90, -1), run) AS position, run, model_p FROM q WHERE verdict = ''",
    "review_queue_accepts": duck("v_ledger_old") + _QUEUE + " SELECT row_number() OVER (ORDER BY model_p IS NULL, CAST(model_p AS DECIMAL(6,4)), coalesce(p90, -1), run) AS position, run, model_p FROM q",
    "undo_pick": duck("v_ledger_old") + " SELECT conductor, video_id, run, judged_at FROM v_ledger_old WHERE verdict <> '' AND source_verdict = '' ORDER BY judged_at DESC, conductor DESC, video_id DESC, run DESC LIMIT 1",
    "undo_reset": duck("v_ledger_old") + """, u AS (SELECT run FROM v_ledger_old WHERE verdict <> '' AND source_verdict = '' ORDER BY judged_at DESC, conductor DESC, video_id DESC, run DESC LIMIT 1)
SELECT conductor, video_id, run, source_verdict, CASE WHEN run IN (FROM u) THEN '' ELSE verdict END AS verdict, preview, CASE WHEN run IN (FROM u) THEN '' ELSE judged_at END AS judged_at FROM v_ledger_old""",
    "model_apply": duck("v_ledger_old") + """, x AS (SELECT l.*, CASE WHEN l.run % 5 = 0 THEN '0.1234' ELSE '' END AS before, CASE WHEN o_orderkey IS NOT NULL THEN (l.run % 1009) / 1009.0::DOUBLE END AS p FROM v_ledger_old l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1) o ON o_orderkey = l.run)
SELECT conductor, run, CASE WHEN verdict = '' AND p >= 0.9 THEN 'reject' ELSE verdict END AS verdict, preview, CASE WHEN verdict = '' AND p IS NOT NULL THEN printf('%.4f', p) ELSE before END AS model_p, CASE WHEN verdict = '' AND p >= 0.9 THEN 'auto' ELSE '' END AS model_auto FROM x""",
    "record_verdicts": duck("v_ledger_old") + """ SELECT conductor, video_id, run, source_verdict, CASE WHEN run % 3 = 0 THEN ['accept', 'reject', ''][run // 3 % 3 + 1] ELSE verdict END AS verdict, preview,
CASE WHEN run % 3 = 0 THEN CASE WHEN run // 3 % 3 = 2 THEN '' ELSE '2026-01-02T03:04:05' END ELSE judged_at END AS judged_at FROM v_ledger_old""",
    "record_clip_verdicts": """WITH c AS (SELECT p_partkey AS k, p_partkey % 900 AS v, p_partkey % 12 AS n FROM part), ch AS (SELECT v, n, k % 8 = 0 AS cut FROM c WHERE k < 900 AND k % 4 = 0)
SELECT k, 'v' || c.v AS video_id, CAST(c.n AS VARCHAR) AS clip_num, CASE WHEN ch.v IS NOT NULL THEN 'accept' ELSE 'hold' END AS verdict, CASE WHEN ch.cut THEN '3.00-4.00' WHEN ch.v IS NOT NULL THEN '' WHEN k % 2 = 0 THEN '1.00-2.00' ELSE '' END AS crops FROM c LEFT JOIN ch ON c.v = ch.v AND c.n = ch.n""",
    "write_read": duck("v_ledger_old") + " SELECT fmt, verdict, count(*) AS n, CAST(sum(run) AS BIGINT) AS runs FROM v_ledger_old, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) f(fmt) GROUP BY 1, 2",
    "first_year": "SELECT p_partkey AS video_id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1900 + p_partkey % 120 WHEN p_partkey % 2 = 0 THEN 1950 + p_partkey % 60 WHEN p_partkey % 5 <> 0 THEN 1960 + p_partkey % 50 END AS INTEGER) AS year FROM part",
    "metadata_gate": """WITH p AS (SELECT p_partkey, lower(p_name) AS t, lower(p_brand) AS c, CASE WHEN p_partkey % 9 <> 0 THEN p_size END AS dur, CASE WHEN p_partkey % 4 <> 0 THEN CAST(floor(p_retailprice) AS INTEGER) END AS views FROM part)
SELECT p_partkey, CASE WHEN dur < 5 THEN 'too_short(' || dur || 's)' WHEN dur > 45 THEN 'too_long(' || dur || 's)' WHEN contains(t, 'steel') THEN 'exclude_term' WHEN NOT (contains(t, 'a') OR contains(t, 'e') OR contains(c, 'a') OR contains(c, 'e')) THEN 'no_alias_in_title' WHEN views < 1000 THEN 'low_views(' || views || ')' ELSE 'ok' END AS why FROM p""",
    "failure_class": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'block' WHEN 1 THEN 'permanent' WHEN 2 THEN 'transient' ELSE 'block' END AS kind FROM orders",
    "rolling_cap_wait": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events),
w AS (SELECT event_id, us, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS n, lag(us, 2) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nth FROM e)
SELECT event_id, n, CASE WHEN n < 3 THEN 0 ELSE greatest(0, nth + 86400000000 - us) END AS wait_us FROM w""",
    "title_normalize": duck("v_titles") + f" SELECT video_id, {_NORM} AS norm FROM v_titles",
    "work_numbers": duck("v_titles") + f" SELECT video_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({_NORM}, '\\d+'), lambda x: CAST(x AS BIGINT)))), ',') AS nums FROM v_titles",
    "sessions_exact": duck("v_titles") + _SESS.replace("{more}", ""),
    "merge_overrides": duck("v_titles", "v_groups") + _SESS.replace("{more}", ' UNION ALL SELECT conductor, video_id, min(video_id) OVER (PARTITION BY conductor, "group") FROM v_groups'),
    "year_strict": duck("v_titles_years") + " SELECT p_partkey AS video_id, CASE WHEN p_partkey % 4 = 0 THEN 1950 + p_size END AS year FROM part",
    "year_ranked": """WITH x AS (SELECT p_partkey AS k, 1950 + p_size AS y, CASE WHEN p_partkey % 5 = 0 THEN 1980 ELSE 2026 END AS cap FROM part),
c AS (SELECT k, cap, CASE WHEN k % 4 = 1 THEN [y] ELSE [] END || CASE k % 6 WHEN 1 THEN [1985] WHEN 3 THEN [1990] WHEN 5 THEN [1966] ELSE [] END AS strong, CASE WHEN k % 4 = 0 THEN [y] ELSE [] END || CASE k % 6 WHEN 4 THEN [1971] WHEN 5 THEN [1970] ELSE [] END AS weak FROM x),
m AS (SELECT k, list_min(list_filter(strong, lambda v: v <= cap)) AS s, list_min(list_filter(weak, lambda v: v <= cap)) AS w FROM c)
SELECT k AS video_id, CAST(coalesce(s, w) AS INTEGER) AS year, CASE WHEN s IS NOT NULL THEN 'context' WHEN w IS NOT NULL THEN 'weak' ELSE '' END AS confidence FROM m""",
    "era_bucket": "SELECT p_partkey, CASE WHEN p_size < 10 THEN '1950s' WHEN p_size < 30 THEN '1960s~70s' WHEN p_size < 40 THEN '1980s' WHEN p_size < 70 THEN '1990s~10s' END AS era FROM part",
    "year_span": """WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, 1925 + p_size AS y, CASE WHEN (p_size % 10) * 10 >= 30 THEN 1900 ELSE 2000 END + (p_size % 10) * 10 AS d2, 1920 + p_size * 2 AS d4, p_size FROM part),
n AS (SELECT p_partkey, CASE WHEN k = 0 THEN CASE WHEN y BETWEEN 1930 AND 2029 THEN CAST(y AS VARCHAR) END WHEN k = 1 THEN CASE WHEN p_size % 10 <> 0 AND d2 + 9 <= 2029 THEN d2 || 's' END WHEN k = 2 THEN CASE WHEN d4 % 10 = 0 AND d4 >= 1930 AND d4 + 9 <= 2029 THEN d4 || 's' END ELSE '' END AS norm FROM p)
SELECT p_partkey, norm, CAST(left(nullif(norm, ''), 4) AS INTEGER) AS lo, CAST(left(nullif(norm, ''), 4) AS INTEGER) + CASE WHEN norm LIKE '%s' THEN 9 ELSE 0 END AS hi FROM n""",
    "video_ids": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'AbC-_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') WHEN 1 THEN 'vid' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') END AS id, CASE WHEN p_partkey % 5 <> 0 THEN 'v' || p_partkey END AS clip, CASE WHEN p_partkey % 5 <> 0 THEN lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0') END AS num FROM part",
    "crops": """WITH p AS (SELECT p_partkey, p_size AS q, CASE WHEN p_size % 3 <> 0 THEN p_size END AS a, CASE WHEN p_size % 4 <> 0 THEN p_size * 2 END AS z FROM part),
f AS (SELECT *, CASE WHEN a IS NULL THEN greatest(60 - z, 0) ELSE a END AS x, CASE WHEN a IS NULL OR z IS NULL THEN 59 ELSE least(z, 59) END AS y FROM p)
SELECT p_partkey, CASE WHEN q * 2 - 5 > q THEN printf('%.2f-%.2f;', q::DOUBLE, (q * 2 - 5)::DOUBLE) ELSE '' END || printf('%.2f-%.2f', (q + 10)::DOUBLE, (q + 20)::DOUBLE) AS crops,
CAST(CASE WHEN (a IS NOT NULL OR z > 0) AND x <= y AND x < 60 THEN x END AS BIGINT) AS a, CAST(CASE WHEN (a IS NOT NULL OR z > 0) AND x <= y AND x < 60 THEN y END AS BIGINT) AS z FROM f""",
}
