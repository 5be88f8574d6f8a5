"""Review boards and year edits: tables of rows in, tables of rows out; no file is moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.text import clip_stem, normalize_year_input, parse_crops

VERDICTS = ("accept", "hold", "reject")


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def merge_meta(new: DataFrame, old: DataFrame) -> DataFrame:
    """new(video_id, year_manual, ...) with the years that old(video_id, year_manual, ordinal) holds; its last row of a video counts, whatever the conductor."""
    kept = old.groupBy("video_id").agg(F.max_by("year_manual", "ordinal").alias("_kept"))
    year = F.coalesce(F.nullif(F.col("_kept"), F.lit("")), F.col("year_manual")).alias("year_manual")
    return new.join(kept, "video_id", "left").select(*[year if c == "year_manual" else F.col(c) for c in new.columns])


def year_rows(meta: DataFrame, samples: DataFrame, view: str = "clips", conductor: str | None = None) -> DataFrame:
    """meta(conductor, video_id, title, year_title, year_manual) with each recording's sample clip, those without a year first.

    view: clips (recordings that have one), empty (of these, such as lack a year) or all.
    """
    if view not in ("clips", "empty", "all"):
        raise ValueError(f"no view {view!r}")
    rows = meta.where(F.col("conductor") == conductor) if conductor else meta
    joined = rows.join(samples.select("conductor", "video_id", F.col("stem").alias("clip")), ["conductor", "video_id"], "left" if view == "all" else "inner")
    filled = joined.withColumn("filled", ~_blank("year_manual"))
    shown = filled.where(~F.col("filled")) if view == "empty" else filled
    return shown.orderBy("filled", "conductor", "title").select("conductor", "video_id", "title", "year_title", "year_manual", "clip", "filled")


def set_years(meta: DataFrame, edits: DataFrame) -> DataFrame:
    """meta(ordinal, video_id, year_manual, ...) after edits(video_id, value): the first row of a video takes the normalized value; a value that is no year changes nothing."""
    fine = edits.select(F.col("video_id").alias("_vid"), normalize_year_input(F.col("value")).alias("_value")).where("_value IS NOT NULL")
    firsts = meta.groupBy(F.trim("video_id").alias("_vid")).agg(F.min("ordinal").alias("_first"))
    changed = firsts.join(fine, "_vid").select(F.col("_first").alias("ordinal"), "_value")
    year = F.coalesce("_value", "year_manual").alias("year_manual")
    return meta.join(changed, "ordinal", "left").select(*[year if c == "year_manual" else F.col(c) for c in meta.columns])


def year_edit_errors(meta: DataFrame, edits: DataFrame) -> DataFrame:
    """(video_id, value, error) of the edits that set_years can't apply."""
    known = meta.select(F.trim("video_id").alias("video_id"), F.lit(True).alias("_known")).distinct()
    checked = edits.join(known, "video_id", "left")
    error = F.when(normalize_year_input(F.col("value")).isNull(), "not a year").when(F.col("_known").isNull(), "no such video")
    return checked.select("video_id", "value", error.alias("error")).where("error IS NOT NULL")


def crop_names(stem: Column, crops: Column) -> Column:
    """Names of a clip's cut pieces, from _c00 on."""
    return F.transform(crops, lambda _, i: F.concat(stem, F.format_string("_c%02d", i)))


def board(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(verdict, stem, video_id, clip_num, dur_s, crops, auto, file, locked) of every judged row, and of clips that no row names, which count as accepted.

    rows(stem, video_id, clip_num, verdict, dur_s, crops); files(folder: hold or clips, stem). A row's file is in hold, else
    in clips; else its first cut piece, which locks it, as nothing at all does.
    """
    have = lambda folder, name: files.where(F.col("folder") == folder).select(F.col("stem").alias(f"_at_{name}"), F.lit(True).alias(name)).distinct()
    judged = rows.withColumn("verdict", F.trim(F.coalesce("verdict", F.lit("")))).where(F.col("verdict").isin(*VERDICTS))
    piece = F.try_element_at(crop_names(F.col("stem"), parse_crops(F.col("crops"))), F.lit(1))
    at = judged.withColumn("_piece", piece)
    for folder, name, key in (("hold", "held", "stem"), ("clips", "there", "stem"), ("clips", "cut", "_piece")):
        at = at.join(have(folder, name), F.col(key) == F.col(f"_at_{name}"), "left")
    whole = F.col("held").isNotNull() | F.col("there").isNotNull()
    file = F.when(whole, F.col("stem")).when(F.col("cut").isNotNull(), F.col("_piece"))
    number = F.trim("clip_num")
    tiles = at.select("verdict", "stem", F.trim("video_id").alias("video_id"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number).alias("clip_num"), "dur_s", "crops", F.lit(False).alias("auto"), file.alias("file"), (~whole).alias("locked"))
    loose = files.where((F.col("folder") == "clips") & ~F.col("stem").rlike(r"_c\d{2}$")).join(rows.select("stem"), "stem", "left_anti").withColumn("_c", clip_stem(F.col("stem"))).where("_c IS NOT NULL")
    more = loose.select(F.lit("accept").alias("verdict"), "stem", F.col("_c.video_id").alias("video_id"), F.col("_c.num").alias("clip_num"), F.lit("").alias("dur_s"), F.lit("").alias("crops"), F.lit(True).alias("auto"), F.col("stem").alias("file"), F.lit(False).alias("locked"))
    return tiles.unionByName(more).orderBy("verdict", "stem")


def batch_end(done: Column, size: int) -> Column:
    return (done > 0) & (done % size == 0)


def backoff(blocks: Column, waits: list[float]) -> Column:
    """The wait after so many blocks in a row, the last one for more; for none, too, the last."""
    at = F.least(blocks, F.lit(len(waits)))
    return F.element_at(F.array(*[F.lit(float(x)) for x in waits]), F.when(at <= 0, -1).otherwise(at).cast("int"))


def localize_hands(joints: Column, wrists: tuple[int, ...] = (91, 112), size: int = 21) -> Column:
    """array<struct<x, y, conf>> with the joints of each hand relative to its wrist, the hand's first joint."""

    def one(p: Column, i: Column) -> Column:
        root = F.lit(None)
        for w in wrists:
            root = F.when((i >= w) & (i < w + size), F.get(joints, F.lit(w))).otherwise(root)
        moved = F.struct((p["x"] - root["x"]).alias("x"), (p["y"] - root["y"]).alias("y"), p["conf"].alias("conf"))
        return F.when(root.isNotNull(), moved).otherwise(p)

    return F.transform(joints, one)


def padded(values: Column, length: int, neutral: float = 0.0) -> Column:
    """struct<values, mask>: a channel that ends before length goes on with its neutral value, masked out; differences are taken before."""
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(values))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(values)), F.array_repeat(F.lit(0), missing))
    return F.struct(F.concat(values, F.array_repeat(F.lit(float(neutral)), missing)).alias("values"), mask.alias("mask"))


def padded_tallies(hits: DataFrame) -> DataFrame:
    """(y, pad_n, pad_ok, unpad_n, unpad_ok) of hits(y, hit, is_pad); classes that weren't trained (y < 0) have their own row."""
    pad, hit = F.col("is_pad"), F.col("hit")
    counts = {"pad_n": pad, "pad_ok": pad & hit, "unpad_n": ~pad, "unpad_ok": ~pad & hit}
    return hits.groupBy("y").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def fold_accuracy(hits: DataFrame) -> DataFrame:
    """(folds, mean_acc, pooled_acc) of hits(fold, hit): the mean over folds, each of one weight, beside the accuracy of all rows."""
    per = hits.groupBy("fold").agg(F.count_if("hit").alias("ok"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("folds"), F.avg(F.col("ok") / F.col("n")).alias("mean_acc"), (F.sum("ok") / F.sum("n")).alias("pooled_acc"))
