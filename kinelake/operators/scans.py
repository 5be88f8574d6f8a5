"""From listings of files and scanned runs to rows: sample clips, sources with fallback, ledger rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions.text import clip_stem

MIN_SEGMENT_S = 2.0


def clip_samples(files: DataFrame) -> DataFrame:
    """(conductor, video_id, stem): the first whole clip of every video in files(conductor, stem); crops and malformed stems are no samples."""
    whole = files.where(~F.col("stem").rlike(r"_c\d{2}$")).withColumn("_c", clip_stem(F.col("stem"))).where("_c IS NOT NULL")
    return whole.groupBy("conductor", F.col("_c.video_id").alias("video_id")).agg(F.min("stem").alias("stem"))


def resolve_sources(rows: DataFrame, files: DataFrame, spans: DataFrame) -> DataFrame:
    """rows(conductor, video_id, clip_num, ...) with where a clip is read from: folder, name, start_sec, end_sec; all null if nowhere.

    files(conductor, folder, stem): a clip in hold comes before one in clips, both read whole; else the first raw file whose
    name has [video_id], at the last of spans(conductor, video_id, clip_num, line_no, start_sec, end_sec).
    """
    stem = F.format_string("%s(%s)", F.trim("video_id"), F.lpad(F.trim("clip_num"), 2, "0"))
    have = lambda folder: files.where(F.col("folder") == folder).select("conductor", F.col("stem").alias("_stem")).distinct().withColumn(f"_{folder}", F.lit(True))
    last = spans.groupBy("conductor", F.col("video_id").alias("_vid"), F.col("clip_num").alias("_num")).agg(F.max(F.struct("line_no", "start_sec", "end_sec")).alias("_span"))
    tags = F.array_distinct(F.regexp_extract_all(F.col("stem"), F.lit(r"\[([^\]]+)\]"), F.lit(1)))
    raw = files.where("folder = 'raw'").select("conductor", "stem", F.explode(tags).alias("_vid")).groupBy("conductor", "_vid").agg(F.min("stem").alias("_raw"))
    keyed = rows.withColumn("_stem", stem).withColumn("_vid", F.trim("video_id")).withColumn("_num", F.lpad(F.trim("clip_num"), 2, "0"))
    found = keyed.join(have("hold"), ["conductor", "_stem"], "left").join(have("clips"), ["conductor", "_stem"], "left")
    found = found.join(last, ["conductor", "_vid", "_num"], "left").join(raw, ["conductor", "_vid"], "left")
    cut = F.col("_span").isNotNull() & F.col("_raw").isNotNull()
    folder = F.when(F.col("_hold"), "hold").when(F.col("_clips"), "clips").when(cut, "raw")
    name = F.when(folder == "raw", F.col("_raw")).when(folder.isNotNull(), F.col("_stem"))
    part = lambda c: F.when(folder == "raw", F.col(f"_span.{c}")).alias(c)
    return found.select(*rows.columns, folder.alias("folder"), name.alias("name"), part("start_sec"), part("end_sec"))


def run_rows(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ledger rows of runs(conductor, run, run_dir, source_clip, qc struct<fps, n_frames, kept_frames, segments>), awaiting a verdict.

    Runs of clips that decisions(video_id, clip_num, verdict) reject are left out, accepts are inherited; a run without qc
    is no_qc, with blank figures. clip_num has no leading zeros. A malformed clip name has null ids and no decision.
    """
    clip = clip_stem(F.regexp_replace("source_clip", r"\.mp4$", ""))
    r = runs.withColumn("_c", clip).withColumn("video_id", F.col("_c.video_id")).withColumn("clip_num", F.col("_c.num").try_cast("long").cast("string"))
    d = decisions.select("video_id", "clip_num", F.col("verdict").alias("_verdict"))
    r = r.join(d, ["video_id", "clip_num"], "left").where("coalesce(_verdict, '') <> 'reject'")
    longest = F.coalesce(F.array_max(F.transform("qc.segments", lambda s: s["b"] - s["a"])), F.lit(0))
    figure = lambda text: F.when(F.col("qc").isNull(), "").otherwise(text)
    state = F.when(F.col("qc").isNull(), "no_qc").when((longest > 0) & (longest >= MIN_SEGMENT_S * F.col("qc.fps")), "keep").otherwise("discard")
    return r.select(
        "conductor", "video_id", "clip_num", "run", "run_dir",
        figure(F.format_string("%.3f", F.col("qc.fps").cast("double"))).alias("fps"),
        figure(F.col("qc.n_frames").cast("string")).alias("n_frames"), figure(F.col("qc.kept_frames").cast("string")).alias("kept_frames"),
        figure(F.format_string("%.2f", longest / F.col("qc.fps").cast("double"))).alias("longest_seg_s"),
        state.alias("disposition"), F.when(F.col("_verdict") == "accept", "accept").otherwise("").alias("source_verdict"),
        F.lit("").alias("verdict"), F.lit("").alias("preview"), F.lit("").alias("judged_at"),
    )
