"""Titles, years, ids, crops: column functions on text."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: marks of movements and parts, in the order in which they go
MOVEMENTS = [
    r"\(\s*\d\s*/\s*\d\s*\)",
    r"\b(?:mvmt|movement|mov)\.?\s*\d+(?:\s*&\s*\d+)*\b",
    r"\b(?:part|pt)\.?\s*\d+\b",
    r"\d+\s*악장",
    r",\s*[ivx]+\b",
    r"\s-\s[ivx]+\b",
]
# fixed values: composers that keep works with equal numbers apart
COMPOSERS = [
    "beethoven", "mahler", "brahms", "tchaikovsky", "bruckner", "mozart", "haydn", "dvorak", "dvořák", "shostakovich", "berlioz", "wagner", "verdi",
    "ravel", "debussy", "stravinsky", "mendelssohn", "schubert", "schumann", "sibelius", "rossini", "bizet", "elgar", "prokofiev", "rachmaninoff",
    "bartok", "bartók", "copland", "gershwin", "orff", "puccini", "smetana", "liszt", "grieg", "weber", "mascagni", "reinecke",
]
# fixed values: years, and the words and months near one that make it a recording's
YEAR_MIN, YEAR_MAX, RANKED_MIN = 1930, 2029, 1940
STRICT_YEAR = r"(?<!\d)(?:19[3-9]\d|20[0-2]\d)(?!\d)"
CONTEXT = "recorded|recording|live|concert|filmed|taped|aufnahme|aufgenommen|enregistr|registrazione|grabado|실황|녹음|녹화|공연|연주"
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
YEAR = r"(19[4-9]\d|20[0-2]\d)"


def normalize_title(title: Column) -> Column:
    """Lower case without movement marks, Roman numerals or punctuation; single spaces."""
    t = F.lower(title)
    for pattern in MOVEMENTS:
        t = F.regexp_replace(t, f"(?U){pattern}", " ")
    t = F.regexp_replace(t, r"(?U)\b[ivx]{1,4}\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9가-힣 ]", " "), " +", " "))


def work_numbers(title: Column) -> Column:
    """Sorted distinct numbers of the normalized title."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(normalize_title(title), F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("long"))))


def _folded(text: Column) -> Column:
    return F.translate(text, "řó", "ro")


def composer_set(normalized: Column) -> Column:
    names = F.array(*[F.lit(c.replace("ř", "r").replace("ó", "o")) for c in COMPOSERS])
    return F.array_distinct(F.filter(names, lambda c: F.contains(_folded(normalized), c)))


def ratio_bound(a: Column, b: Column) -> Column:
    """What title_ratio can't exceed: twice the characters that both have, in any order, over all; 0 where the lengths alone exclude more."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(a, c), count(b, c))))
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2.0 * shared / (F.length(a) + F.length(b)))


def title_ratio(a: Column, b: Column) -> Column:
    """Share of matching blocks of two normalized titles, in the argument order given."""

    @F.pandas_udf("double")
    def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def year_strict(title: Column) -> Column:
    """The one year from 1930 to 2029 in a title that no remaster stands next to; null unless exactly one."""
    bare = F.regexp_replace(title, rf"(?iU)remaster\w*\s*{STRICT_YEAR}|{STRICT_YEAR}(?=\s*remaster)", " ")
    years = F.array_distinct(F.regexp_extract_all(bare, F.lit(f"({STRICT_YEAR})"), F.lit(1)))
    return F.when(F.size(years) == 1, F.get(years, F.lit(0)).cast("int"))


# fixed values: patterns of a catalog number and of dates; only the last of them can begin inside a catalog number
OPUS = rf"(?i)(?:op\.?|no\.?|k\.?|bwv|d\.)\s*{YEAR}"


def year_ranked(text: Column, upload_year: Column, this_year: Column | None = None) -> Column:
    """struct<year, confidence>: the earliest valid year next to a recording word or in a date, else in brackets.

    What begins inside a catalog number is no year. Years after upload_year don't count, where it is null or 0 those after
    this_year (the current year unless given).
    """
    latest = F.coalesce(F.nullif(upload_year, F.lit(0)), F.year(F.current_date()) if this_year is None else this_year)
    ranked = {
        "context": [rf"(?i)(?:{CONTEXT})[^.\n]{{0,60}}?{YEAR}", rf"(?i)\b\d{{1,2}}\s+(?:{MONTHS})[a-z]*\.?,?\s+{YEAR}\b", rf"(?i)\b(?:{MONTHS})[a-z]*\.?\s+\d{{1,2}},?\s+{YEAR}\b", rf"\b{YEAR}-\d{{2}}-\d{{2}}\b"],
        "weak": [rf"[(\[]\s*{YEAR}\s*[)\]]"],
    }

    def first(patterns: list[str]) -> Column:
        source = lambda p: F.regexp_replace(text, OPUS, " ") if p.startswith(rf"\b{YEAR}") else text
        years = F.transform(F.concat(*[F.regexp_extract_all(source(p), F.lit(p), F.lit(1)) for p in patterns]), lambda y: y.cast("int"))
        return F.array_min(F.filter(years, lambda y: (y >= RANKED_MIN) & (y <= latest)))

    strong, weak = first(ranked["context"]), first(ranked["weak"])
    return F.struct(F.coalesce(strong, weak).alias("year"), F.when(strong.isNotNull(), "context").when(weak.isNotNull(), "weak").otherwise("").alias("confidence"))


def bucket_range(name: Column) -> Column:
    """struct<lo, hi> of an era name such as 1990s or 1960s~70s; a two-digit end rolls into the next century where it must."""
    start, end = F.try_to_number(F.nullif(F.regexp_extract(name, r"^(\d{4})s(?:~(\d{2,4})s)?$", 1), F.lit("")), F.lit("9999")).cast("int"), F.try_to_number(F.nullif(F.regexp_extract(name, r"^(\d{4})s(?:~(\d{2,4})s)?$", 2), F.lit("")), F.lit("9999")).cast("int")
    century = end + F.floor(start / 100).cast("int") * 100
    last = F.when(end.isNull(), start).when(end >= 100, end).when(century < start, century + 100).otherwise(century)
    return F.when(start.isNotNull(), F.struct(start.alias("lo"), (last + 9).cast("int").alias("hi")))


def era_bucket(lo: Column, hi: Column, names: list[str]) -> Column:
    """The first bucket that holds the whole span."""
    out = None
    for n in names:
        r = bucket_range(F.lit(n))
        fits = (r["lo"] <= lo) & (hi <= r["hi"])
        out = F.when(fits, n) if out is None else out.when(fits, n)
    return out


def normalize_year_input(s: Column) -> Column:
    """'1985', or '1980s' ('80s' too); empty stays empty, anything else or out of range is null."""
    t = F.trim(s)
    digits = F.nullif(F.regexp_extract(t, r"(?i)^(\d{2}|\d{4})s$", 1), F.lit(""))
    n = digits.cast("int")
    decade = F.when(F.length(digits) == 2, n + F.when(n >= YEAR_MIN % 100, 1900).otherwise(2000)).otherwise(n)
    fine = (decade % 10 == 0) & (decade >= YEAR_MIN) & (decade + 9 <= YEAR_MAX)
    year = F.when(t.rlike(r"^\d{4}$"), t).cast("int")
    return F.when(t == "", "").when(t.rlike(r"^\d{4}$"), F.when(year.between(YEAR_MIN, YEAR_MAX), t)).when(fine, F.concat(decade.cast("string"), F.lit("s")))


def year_span(s: Column) -> Column:
    n = F.nullif(normalize_year_input(s), F.lit(""))
    y = F.regexp_extract(n, r"^(\d{4})", 1).cast("int")
    return F.when(n.isNotNull(), F.struct(y.alias("lo"), (y + F.when(F.endswith(n, F.lit("s")), 9).otherwise(0)).alias("hi")))


def first_year(*columns: Column) -> Column:
    """The first of the columns that begins with a year once trimmed of blanks and a final s; as an int."""
    return F.coalesce(*[F.regexp_extract(F.regexp_replace(F.trim(c), "s+$", ""), r"^(\d{4})", 1).try_cast("int") for c in columns])


def video_id(filename: Column) -> Column:
    """The last bracketed id of 11 characters, else a stem of 11 that doesn't look like a word."""
    bracketed = F.regexp_extract_all(filename, F.lit(r"\[([A-Za-z0-9_-]{11})\]"), F.lit(1))
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    return F.when(F.size(bracketed) > 0, F.element_at(bracketed, -1)).when(stem.rlike("^[A-Za-z0-9_-]{11}$") & ~stem.rlike("^[A-Z]?[a-z]+$"), stem)


def clip_stem(name: Column) -> Column:
    """struct<video_id, num> of 'vid(07)', with or without a crop suffix '_c01'; null if malformed."""
    p = r"^(.+)\((\d+)\)(?:_c\d{2})?$"
    return F.when(name.rlike(p), F.struct(F.regexp_extract(name, p, 1).alias("video_id"), F.regexp_extract(name, p, 2).alias("num")))


def parse_crops(text: Column) -> Column:
    """array<struct<s, e>> of 's-e;s-e', by start; parts that aren't two numbers in order are dropped."""
    part = lambda p: F.struct(F.split(p, "-", 2)[0].try_cast("double").alias("s"), F.get(F.split(p, "-", 2), F.lit(1)).try_cast("double").alias("e"))
    return F.array_sort(F.filter(F.transform(F.split(text, ";"), part), lambda c: c["e"] > c["s"]))


def format_crops(crops: Column) -> Column:
    return F.array_join(F.transform(crops, lambda c: F.concat(F.format_string("%.2f", c["s"]), F.lit("-"), F.format_string("%.2f", c["e"]))), ";")


def http_range(header: Column, size: Column) -> Column:
    """struct<a, z> (inclusive) of 'bytes=a-z' clamped to the size; null if malformed, empty or beyond it."""
    p = r"^bytes=(\d*)-(\d*)$"
    a, z = F.regexp_extract(header, p, 1).try_cast("long"), F.regexp_extract(header, p, 2).try_cast("long")
    first, last = F.when(a.isNull(), F.greatest(size - z, F.lit(0))).otherwise(a), F.when(a.isNull() | z.isNull(), size - 1).otherwise(F.least(z, size - 1))
    return F.when(header.rlike(p) & (a.isNotNull() | (z > 0)) & (first <= last) & (first < size), F.struct(first.alias("a"), last.alias("z")))
