"""Sessions: recordings whose titles name the same performance, and merges of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions import text
from kinelake.operators.curation import components


def _prefixes(titles: DataFrame, similarity: float) -> DataFrame:
    """(conductor, norm, pair, prefix): each title's rarest tokens, so many that alike titles have one in common.

    A ratio of s between lengths n and m means at least s (n + m) / 2 characters in blocks that stand in both titles, and
    m >= s n / (2 - s). So titles share s n / (2 - s) characters (pair false), counted with repeats. Between two blocks lies a
    character that is in none, so there are at most n + m - 2 M + 1 blocks of M characters, and alike titles share
    (1.5 s - 1) (n + m) - 1 pairs of neighbours (pair true). Sorted by rarity, two titles that share T tokens have one in common
    among all but the last T - 1 of each. Tokens are given by their hash: equal hashes can only add a candidate. Neighbours serve where they bind, characters where a partner may be too short for that.
    """
    s, n = similarity, F.length("norm")
    chars = F.ceil(s * n / (2 - s) - 1e-9).cast("int")
    pairs = F.ceil((1.5 * s - 1) * 2 * n / (2 - s) - 1 - 1e-9).cast("int")
    short = shortest_paired(s)
    at = F.sequence(F.lit(1), n)
    one = F.struct(F.lit(False).alias("pair"), (n - chars + 1).alias("keep"), F.transform(at, lambda i: F.substring("norm", i, F.lit(1))).alias("tokens"))
    two = F.struct(F.lit(True).alias("pair"), (n - pairs).alias("keep"), F.slice(F.transform(at, lambda i: F.substring("norm", i, F.lit(2))), 1, F.greatest(n - 1, F.lit(0))).alias("tokens"))
    if short is None:
        schemes = F.array(one)
    else:
        schemes = F.filter(F.array(F.when(n <= short * (2 - s) / s, one), F.when(n >= short, two)), lambda c: c.isNotNull())
    each = titles.select("conductor", "norm", F.explode(schemes).alias("c")).select("conductor", "norm", "c.pair", "c.keep", F.explode("c.tokens").alias("token"))
    counted = each.groupBy("conductor", "norm", "pair", "keep", "token").count()
    numbered = counted.select("conductor", "norm", "pair", "keep", "token", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("nth"))
    often = numbered.groupBy("pair", "token", "nth").agg(F.count("*").alias("often"))
    ranked = numbered.join(often, ["pair", "token", "nth"]).groupBy("conductor", "norm", "pair", "keep").agg(F.sort_array(F.collect_list(F.struct("often", "token", "nth"))).alias("all"))
    return ranked.select("conductor", "norm", "pair", F.transform(F.slice("all", 1, F.col("keep")), lambda t: F.xxhash64(t["token"], t["nth"])).alias("prefix"))


def shortest_paired(similarity: float) -> int | None:
    """The least length at which alike titles must share a pair of neighbouring characters; None where they need not."""
    per = (1.5 * similarity - 1) * 2 / (2 - similarity)
    return max(2, int(1 / per + 1e-9) + 1) if per > 1e-9 else None


def title_candidates(titles: DataFrame, similarity: float) -> DataFrame:
    """Pairs (conductor, nums, norm_a, low_a, high_a, composers_a, ..._b) with low_a < low_b of titles(conductor, nums, norm, low, high, composers) that may have the similarity.

    Each pair comes once, by the first token that both prefixes have; a title meets only those that share a rare token with it, the number set and enough length.
    """
    s, short = similarity, shortest_paired(similarity)
    held = titles.join(_prefixes(titles, s), ["conductor", "norm"]).withColumn("token", F.explode("prefix"))
    l, r = (held.select("conductor", "nums", "pair", "token", *[F.col(c).alias(f"{c}_{k}") for c in ("norm", "low", "high", "composers", "prefix")]) for k in "ab")
    n, m = F.length("norm_a"), F.length("norm_b")
    first = F.get(F.array_intersect("prefix_a", "prefix_b"), F.lit(0)) == F.col("token")
    near = (n * s <= m * (2 - s) + 1e-9) & (m * s <= n * (2 - s) + 1e-9)
    once = F.lit(True) if short is None else F.col("pair") | (F.least(n, m) < short)
    return l.join(r, ["conductor", "nums", "pair", "token"]).where("low_a < low_b").where(near & once).where(first).drop("pair", "token", "prefix_a", "prefix_b")


def title_edges(titles: DataFrame, similarity: float | None = 0.8) -> DataFrame:
    """(conductor, a, b): pairs of one conductor with equal number sets, no disjoint composers and alike titles (None: equal ones; else above 0).

    Equal titles are first taken together, so that copies of a title make a star and not all their pairs; the others meet in
    an index of their rarest tokens (``title_candidates``), which loses no pair. An edge may come twice.
    """
    if similarity is not None and not 0 < similarity <= 1:
        raise ValueError(f"similarity: above 0 and at most 1, not {similarity}")
    n = text.normalize_title(F.col("title"))
    named = titles.select("conductor", "video_id", n.alias("norm"), text.work_numbers(F.col("title")).alias("nums")).where("norm <> ''")
    same = named.groupBy("conductor", "norm").agg(F.min("video_id").alias("low"), F.max("video_id").alias("high"), F.first("nums").alias("nums"))
    stars = named.join(same.select("conductor", "norm", "low"), ["conductor", "norm"]).where("video_id <> low").select("conductor", F.col("low").alias("a"), F.col("video_id").alias("b"))
    if similarity is None:
        return stars
    kept = same.withColumn("composers", text.composer_set(F.col("norm")))
    apart = (F.size("composers_a") > 0) & (F.size("composers_b") > 0) & ~F.arrays_overlap("composers_a", "composers_b")
    likely = title_candidates(kept, similarity).where(~apart).where(text.ratio_bound(F.col("norm_a"), F.col("norm_b")) >= similarity)
    # the ratio depends on which title comes first; equal titles may stand on both sides of another
    forth, back = F.struct(F.col("norm_a").alias("x"), F.col("norm_b").alias("y")), F.struct(F.col("norm_b").alias("x"), F.col("norm_a").alias("y"))
    orders = likely.select("conductor", "low_a", "low_b", F.explode(F.when(F.col("low_b") < F.col("high_a"), F.array(forth, back)).otherwise(F.array(forth))).alias("o"))
    alike = orders.where(text.title_ratio(F.col("o.x"), F.col("o.y")) >= similarity)
    return stars.union(alike.select("conductor", F.col("low_a").alias("a"), F.col("low_b").alias("b")))


def sessions(titles: DataFrame, edges: DataFrame) -> DataFrame:
    """(conductor, video_id, session): the smallest id of the component; ids without an edge are their own session."""
    found = components(edges.select(F.struct("conductor", F.col("a").alias("v")).alias("a"), F.struct("conductor", F.col("b").alias("v")).alias("b")))
    flat = found.select(F.col("node.conductor").alias("conductor"), F.col("node.v").alias("video_id"), F.col("component.v").alias("session"))
    return titles.select("conductor", "video_id").join(flat, ["conductor", "video_id"], "left").select("conductor", "video_id", F.coalesce("session", "video_id").alias("session"))


def merge_edges(groups: DataFrame) -> DataFrame:
    """Members of a forced group as a star around its smallest id."""
    low = groups.groupBy("conductor", "group").agg(F.min("video_id").alias("a"))
    return groups.join(low, ["conductor", "group"]).where("video_id <> a").select("conductor", "a", F.col("video_id").alias("b")).distinct()
