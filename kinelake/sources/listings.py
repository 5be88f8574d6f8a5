"""Search results in JSON lines: blank, broken and nameless lines are skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, title string, duration double, view_count long, channel string, uploader string, upload_date string"


def parsed(lines: DataFrame, line: Column) -> DataFrame:
    """(id, title, duration, view_count, channel, upload_date); the uploader stands in for a missing or blank channel, a missing title or channel is blank."""
    r = lines.select(F.from_json(line, SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).select("r.*").where("id <> ''")
    some = lambda *cols: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit(""))
    return r.select("id", some("title").alias("title"), "duration", "view_count", some("channel", "uploader").alias("channel"), "upload_date")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path), F.col("value"))
