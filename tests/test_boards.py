"""Worked examples of review boards, year edits and padding."""

import pytest
from pyspark.sql import functions as F

from kinelake.operators import boards as b


def test_year_edits_hit_the_first_row_only(spark):
    meta = spark.createDataFrame([(0, "a", "1960"), (1, "a", ""), (2, "b", None)], "ordinal int, video_id string, year_manual string")
    edits = spark.createDataFrame([("a", "80s"), ("b", "1850"), ("c", "1985")], "video_id string, value string")
    assert {r.ordinal: r.year_manual for r in b.set_years(meta, edits).collect()} == {0: "1980s", 1: "", 2: None}
    assert {tuple(r) for r in b.year_edit_errors(meta, edits).collect()} == {("b", "1850", "not a year"), ("c", "1985", "no such video")}


def test_merge_keeps_manual_years(spark):
    old = spark.createDataFrame([("a", "1970", 0), ("a", "1971", 1), ("b", "", 2)], "video_id string, year_manual string, ordinal int")
    new = spark.createDataFrame([("a", "", "x"), ("b", "1999", "y"), ("c", None, "z")], "video_id string, year_manual string, title string")
    assert {r.video_id: r.year_manual for r in b.merge_meta(new, old).collect()} == {"a": "1971", "b": "1999", "c": None}


def test_year_rows_views(spark):
    meta = spark.createDataFrame([("k", "a", "t", "", "1960"), ("k", "b", "s", "", " "), ("l", "c", "r", "", None)], "conductor string, video_id string, title string, year_title string, year_manual string")
    samples = spark.createDataFrame([("k", "a", "a(01)"), ("k", "b", "b(01)")], "conductor string, video_id string, stem string")
    ids = lambda **kw: [r.video_id for r in b.year_rows(meta, samples, **kw).collect()]
    assert ids() == ["b", "a"] and ids(view="empty") == ["b"] and ids(view="all") == ["b", "c", "a"] and ids(view="all", conductor="l") == ["c"]
    with pytest.raises(ValueError):
        b.year_rows(meta, samples, view="none")


def test_board_states(spark):
    rows = spark.createDataFrame([("a(01)", "a", "1", "accept", "9", ""), ("b(01)", "b", "1", "hold", "9", "1-2"), ("c(01)", "c", "1", "reject", "9", ""), ("d(01)", "d", "1", None, "9", "")], "stem string, video_id string, clip_num string, verdict string, dur_s string, crops string")
    files = spark.createDataFrame([("hold", "a(01)"), ("clips", "a(01)"), ("clips", "b(01)_c00"), ("clips", "d(01)"), ("clips", "e(02)"), ("clips", "odd")], "folder string, stem string")
    got = {r.stem: (r.verdict, r.clip_num, r.auto, r.file, r.locked) for r in b.board(rows, files).collect()}
    assert got == {"a(01)": ("accept", "01", False, "a(01)", False), "b(01)": ("hold", "01", False, "b(01)_c00", True), "c(01)": ("reject", "01", False, None, True), "e(02)": ("accept", "02", True, "e(02)", False)}


def test_padding_and_pacing(spark):
    one = spark.range(1)
    r = one.select(b.padded(F.array(F.lit(2.0), F.lit(3.0)), 4, 1.0).alias("p"), b.padded(F.array(F.lit(2.0)), 1).alias("q")).first()
    assert (r.p.values, r.p.mask, r.q.values, r.q.mask) == ([2.0, 3.0, 1.0, 1.0], [1, 1, 0, 0], [2.0], [1])
    n = spark.range(0, 5).select(b.backoff(F.col("id"), [1, 2, 3]).alias("w"), b.batch_end(F.col("id"), 2).alias("e")).collect()
    assert [x.w for x in n] == [3.0, 1.0, 2.0, 3.0, 3.0] and [x.e for x in n] == [False, False, True, False, True]
