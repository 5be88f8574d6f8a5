"""Curation of the catalog: accept filters, exclusions, duplicate clusters, ledgers, review order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.ranges import running
from kinelake.runtime import cut

LEDGER_KEY = ["conductor", "run"]


def accepted(runs: DataFrame, only: list | None = None) -> DataFrame:
    """Rows accepted themselves or through their source clip, of the named conductors."""
    kept = runs.where((F.col("verdict") == "accept") | (F.col("source_verdict") == "accept"))
    return kept.where(F.col("conductor").isin(only)) if only else kept


def rescale(x: Column, fps: Column, target: float = 25.0) -> Column:
    """A native frame number at the target rate, half-even."""
    return F.rint(x * (F.lit(target) / fps)).cast("int")


def usable_segments(runs: DataFrame, segments: DataFrame, blacklist: DataFrame, min_frames: int) -> DataFrame:
    """Segments of runs that aren't blacklisted by (run, seg_idx), rescaled to the target rate, of at least min_frames; runs without any drop out."""
    clean = segments.join(blacklist, ["run", "seg_idx"], "left_anti")
    at25 = clean.join(runs.select("conductor", "video_id", "run", "fps"), "run").select("conductor", "video_id", "run", "seg_idx", rescale(F.col("a"), F.col("fps")).alias("a"), rescale(F.col("b"), F.col("fps")).alias("b"))
    return at25.where(F.col("b") - F.col("a") >= min_frames)


def without(rows: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Anti-join on keys; blank or null keys in the exclusion list exclude nothing."""
    return rows.join(excluded.select(*keys).dropna().distinct(), keys, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(a, b): smallest label by neighbours, then by jumping to the label's label, until nothing changes.

    Each round is cut to the checkpoint folder; labels reach over 2^k steps in about k rounds.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", F.least("component", "m").alias("c"))
        jump = step.join(labels.select(F.col("node").alias("c"), F.col("component").alias("cc")), "c", "left").select("node", F.least("c", "cc").alias("component"))
        now = cut(jump)
        if now.join(labels, ["node", "component"], "left_anti").isEmpty():
            return now
        labels = now


def duplicate_drop(videos: DataFrame, clusters: DataFrame) -> DataFrame:
    """Videos to drop: in each cluster with two or more present videos, all but the one with most footage, then quality, then the smaller id."""
    present = videos.join(clusters, ["conductor", "video_id"])
    per = W.partitionBy("conductor", "component")
    ranked = present.withColumn("rank", F.row_number().over(per.orderBy(F.desc("footage"), F.desc("quality"), "video_id"))).withColumn("n", F.count("*").over(per))
    return ranked.where("n >= 2 AND rank > 1").select("conductor", "video_id", "component")


def merge_ledger(new: DataFrame, old: DataFrame) -> DataFrame:
    """A re-scan never erases a human verdict: old verdicts and stamps win, new previews win; old rows that the scan lacks stay only if judged."""
    n, o = new.alias("n"), old.alias("o")
    both = n.join(o, LEDGER_KEY, "full_outer")
    seen, known = F.col("n.verdict").isNotNull(), F.col("o.verdict").isNotNull()
    first = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b), F.lit(""))
    merged = both.where(seen | (F.trim("o.verdict") != "")).select(
        *LEDGER_KEY, F.coalesce("n.video_id", "o.video_id").alias("video_id"), F.coalesce("n.source_verdict", "o.source_verdict").alias("source_verdict"),
        F.when(~seen, F.col("o.verdict")).otherwise(first("o.verdict", "n.verdict")).alias("verdict"),
        F.when(~seen, F.col("o.preview")).otherwise(first("n.preview", "o.preview")).alias("preview"),
        F.when(known, F.col("o.judged_at")).otherwise(F.col("n.judged_at")).alias("judged_at"),
    )
    return merged


def interleaved(rows: DataFrame) -> DataFrame:
    """rows with ``round`` and ``position``: the k-th runs of all recordings before any (k+1)-th. Positions come from counts per round and conductor, not from one global window over rows."""
    ranked = rows.withColumn("round", F.row_number().over(W.partitionBy("conductor", "video_id").orderBy("run")))
    sizes = ranked.groupBy("round", "conductor").count()
    order = W.orderBy("round", "conductor").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("round", "conductor", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("_before"))
    within = F.row_number().over(W.partitionBy("round", "conductor").orderBy("video_id"))
    return ranked.withColumn("_within", within).join(before, ["round", "conductor"]).withColumn("position", (F.col("_before") + F.col("_within")).cast("long")).drop("_before", "_within")


def review_queue(rows: DataFrame, only_pending: bool = True, accept_first: bool = False) -> DataFrame:
    """rows with their ``position``: model-scored ones first, most probable rejects first (accept_first: last); then by rescore_p90, blanks in front; then the run.

    Positions come from ranges of that order and counts per range, not from one window over all rows.
    """
    p = F.try_to_number("model_p", F.lit("9.9999"))
    kept = rows.where("trim(coalesce(verdict, '')) = ''") if only_pending else rows
    order = [F.coalesce(p if accept_first else -p, F.lit(9).cast("decimal(5,4)")), F.coalesce(F.col("rescore_p90"), F.lit(-1.0)), F.col("run")]
    return running(kept, order, {"position": F.lit(1).cast("long")}).withColumn("position", F.col("position") + 1)


def footage(runs: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, footage, quality): frames in the segments of a video's runs(video_id, run, conf), and their mean conf weighted by frames."""
    per = segments.groupBy("run").agg(F.sum(F.col("b") - F.col("a")).alias("frames"))
    return per.join(runs, "run").groupBy("video_id").agg(F.sum("frames").alias("footage"), F.try_divide(F.sum(F.col("conf") * F.col("frames")), F.sum("frames")).alias("quality"))


def undo_pick(ledger: DataFrame) -> DataFrame:
    """The one row that an undo resets: of judged rows that didn't inherit their verdict, the latest stamp; without any stamp, the largest key."""
    judged = ledger.where("trim(verdict) <> '' AND trim(source_verdict) = ''")
    key = F.struct(F.coalesce("judged_at", F.lit("")), "conductor", "video_id", "run")
    return judged.agg(F.max_by(F.struct("conductor", "video_id", "run", "judged_at"), key).alias("r")).select("r.*")


def undo(ledger: DataFrame) -> DataFrame:
    """The ledger with its latest human verdict and stamp taken back; the pick is one row."""
    pick = undo_pick(ledger).select("conductor", "video_id", "run", F.lit(True).alias("_undo"))
    both = ledger.join(F.broadcast(pick), ["conductor", "video_id", "run"], "left")
    blank = lambda c: F.when(F.col("_undo"), "").otherwise(F.col(c)).alias(c)
    return both.select(*[blank(c) if c in ("verdict", "judged_at") else c for c in ledger.columns])


def apply_model(rows: DataFrame, scores: DataFrame, threshold: float | None, tag: str = "auto") -> DataFrame:
    """Pending rows get model_p (four digits), and a tagged reject at or above the threshold (None: no rejects); judged rows keep every column as it is."""
    blank = [F.lit("").alias(c) for c in ("model_p", "model_auto") if c not in rows.columns]
    both = rows.select("*", *blank).join(scores.select("run", F.col("p").alias("_p")), "run", "left")
    pending = (F.trim(F.coalesce("verdict", F.lit(""))) == "") & F.col("_p").isNotNull()
    auto = pending & (F.lit(False) if threshold is None else F.col("_p") >= threshold)
    made = {"verdict": F.when(auto, "reject").otherwise(F.col("verdict")), "model_p": F.when(pending, F.format_string("%.4f", "_p")).otherwise(F.col("model_p")), "model_auto": F.when(auto, tag).otherwise(F.col("model_auto"))}
    return both.select(*[made[c].alias(c) if c in made else c for c in [*rows.columns, *(c for c in ("model_p", "model_auto") if c not in rows.columns)]])


# fixed values: what a run or a clip may be judged as; blank takes a verdict back
VERDICTS = ("", "accept", "reject", "skeljump", "hold")


def valid_verdict(verdict: Column, allowed: tuple[str, ...] = VERDICTS) -> Column:
    """The verdict itself; an error for any other value, null too."""
    return F.when(verdict.isin(*allowed), verdict).otherwise(F.raise_error(F.concat(F.lit("invalid verdict: "), F.coalesce(verdict, F.lit("null")))).cast("string"))


def record_verdicts(ledger: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """ledger with the verdicts of changes(conductor, run, verdict), stamped now, or with no stamp where blank. An unknown verdict or run is an error."""
    made = changes.select(*LEDGER_KEY, valid_verdict(F.col("verdict")).alias("_verdict"), F.lit(True).alias("_new"))
    both = ledger.withColumn("_old", F.lit(True)).join(made, LEDGER_KEY, "full_outer")
    known = F.when(F.col("_old"), F.col("_new")).otherwise(F.raise_error(F.concat(F.lit("no such run: "), F.col("run").cast("string"))).cast("boolean"))
    set_to = {"verdict": F.col("_verdict"), "judged_at": F.when(F.col("_verdict") == "", "").otherwise(now)}
    both = both.withColumn("_hit", known)
    return both.select(*[F.when(F.col("_hit"), set_to[c]).otherwise(F.col(c)).alias(c) if c in set_to else c for c in ledger.columns])


def record_clip_verdicts(clips: DataFrame, changes: DataFrame) -> DataFrame:
    """clips(video_id, clip_num, verdict, crops, ...) with changes(video_id, clip_num, verdict, crops) on every row of the clip; null crops clear what was there. An unknown verdict or clip is an error."""
    number = F.lpad(F.trim(F.col("clip_num").cast("string")), 2, "0")
    keys = [F.trim("video_id").alias("_video"), number.alias("_number")]
    made = changes.select(*keys, valid_verdict(F.col("verdict")).alias("_verdict"), F.coalesce("crops", F.lit("")).alias("_crops"), F.lit(True).alias("_new"))
    both = clips.select("*", *keys, F.lit(True).alias("_old")).join(made, ["_video", "_number"], "full_outer")
    known = F.when(F.col("_old"), F.col("_new")).otherwise(F.raise_error(F.concat(F.lit("no such clip: "), F.col("_video"))).cast("boolean"))
    both = both.withColumn("_hit", known)
    return both.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in ("verdict", "crops") else c for c in clips.columns])


def metadata_gate(title: Column, channel: Column, duration: Column, views: Column, aliases: list[str], exclude: list[str], low: int, high: int, min_views: int) -> Column:
    """The first reason that fails, else ok; unknown durations and counts pass."""
    any_in = lambda terms, *cols: F.coalesce(*[F.lit(None).cast("boolean")], F.lit(False)) if not terms else _any([F.contains(F.lower(c), F.lit(t.lower())) for c in cols for t in terms])
    return (
        F.when(duration < low, F.format_string("too_short(%ds)", duration)).when(duration > high, F.format_string("too_long(%ds)", duration))
        .when(any_in(exclude, title), "exclude_term").when(~any_in(aliases, title, channel), "no_alias_in_title")
        .when(views < min_views, F.format_string("low_views(%d)", views)).otherwise("ok")
    )


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c, F.lit(False))
    return out


# fixed values: what a downloader says when it is blocked, and when a video is gone for good
BLOCKED = ["http error 429", "sign in to confirm", "not a bot", "confirm your age", "this video may be inappropriate", "too many requests"]
GONE = [
    "private video", "video unavailable", "has been removed", "members-only", "this video is not available",
    "account associated with this video has been terminated", "video is no longer available", "copyright",
]


def failure_class(stderr: Column) -> Column:
    s = F.lower(stderr)
    return F.when(_any([F.contains(s, F.lit(m)) for m in BLOCKED]), "block").when(_any([F.contains(s, F.lit(m)) for m in GONE]), "permanent").otherwise("transient")


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows updated by changes on keys, others inserted; columns that either lacks are null there."""
    names = [*rows.columns, *[c for c in changes.columns if c not in rows.columns]]
    left, right = rows.select("*", F.lit(True).alias("_old")), changes.select("*", F.lit(True).alias("_new"))
    both = left.alias("l").join(right.alias("r"), keys, "full_outer")
    pick = lambda c: F.when(F.col("_new"), F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")) if c in rows.columns and c in changes.columns else F.col(c)
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in names])


def rolling_cap_wait(events: DataFrame, cap: int, window_s: int = 86_400) -> DataFrame:
    """events(key, ts) with the seconds to wait at each event for fewer than cap events in the last window (its start excluded)."""
    us = F.unix_micros("ts")
    span = W.partitionBy("key").orderBy(us).rangeBetween(-(window_s * 1_000_000 - 1), 0)
    inside = events.withColumn("n", F.count("*").over(span))
    order = W.partitionBy("key").orderBy(us, "event_id")
    nth = F.lag(us, cap - 1).over(order)
    return inside.withColumn("wait_us", F.when(F.col("n") < cap, F.lit(0)).otherwise(F.greatest(F.lit(0), nth + window_s * 1_000_000 - us)))


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Overwrite a table in one of Spark's formats; the commit protocol makes it atomic."""
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)
    return path
