"""Mixing sources to target weights by capped water-filling, with DataFrame functions alone.

Each source may be repeated at most MAX_EPOCHS times; what a clamped source can't take is shared among the others in
proportion to their weights until no target is above its cap. That fixed point is found in one pass over the sources in
the order of cap / weight: a prefix of them is clamped, and the rest has one common level.

A source's target gives every document ``whole`` repetitions and a seeded part of the documents one more. That part is
a prefix of the documents in the order of a seeded hash, up to the missing number of words; the document at its end
takes the words that are still missing (so a source's taken words miss its target by less than one word). The prefix is
found over hash ranges first and ordered only inside the one range where it ends, so no source is ever sorted whole.

Defined results: a null text has size 0; a null source is a source, the last one; a source of size 0 takes nothing;
equal hashes (repeated ids) are ordered by size, then by a hash of the text, and rows alike in all three are taken one after the
other, so that no word of a target is lost on them; rows keep their multiplicity; extra columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.functions.ranges import running
from kinelake.runtime import cut

#: Weights of the sources in code-point order, repeating; the mix has SHARE of all words; a source is read MAX_EPOCHS times at most.
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2, 17
#: Rows that a hash range has about; it is named by as many hexadecimal digits of the hash as that takes.
RANGE_ROWS = 20_000
#: Up to this number of sources their targets (one row each) are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def words_in(text: Column) -> Column:
    """Number of words: every word with the white space around it is replaced by one character, which needs no array of them."""
    short = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.length(short)).otherwise(0).cast("long")


def water_fill(sources: DataFrame, words: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """sources(source, weight, source_size, ...) with ``target``; one row per source. words: what the mix is to have. Running totals go by ranges of the order, so a source per site is as good as three."""
    cap = F.col("source_size").cast("double") * F.lit(float(max_epochs))
    capped = sources.withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    whole = capped.agg(F.sum("weight")).first()[0] or 0.0
    summed = running(capped, [F.col("_ratio"), F.col("source").isNull(), F.col("source")], {"_caps": F.col("_cap"), "_weights": F.col("weight")})
    leveled = summed.withColumn("_level", (F.lit(float(words)) - F.col("_caps")) / (F.lit(float(whole)) - F.col("_weights"))).withColumn("_open", F.col("_ratio") >= F.col("_level"))
    first = leveled.agg(F.min(F.when(F.col("_open"), F.struct("_ratio", "_level")))).first()[0]
    target = F.col("_cap") if first is None else F.when(F.col("_open"), F.least(F.col("weight") * F.lit(first["_level"]), F.col("_cap"))).otherwise(F.col("_cap"))
    return leveled.withColumn("target", target).drop("_cap", "_ratio", "_caps", "_weights", "_level", "_open")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from sized(source, size); only totals come to the driver."""
    per = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    words = float(per.agg(F.sum("source_size")).first()[0] or 0) * share
    numbered = running(per, [F.col("source").isNull(), F.col("source")], {"_at": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    return water_fill(numbered.withColumn("weight", weight).drop("_at"), words, max_epochs)


def _hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def source_plan(sized: DataFrame, digits: int = 3, **targets) -> DataFrame:
    """One row per source: source_size, target, whole repetitions, and where the prefix with one more ends: at (end_hash, end_size, end_mark), whose end_copies rows get end_more words together.

    sized(source, hash, size, mark). Sizes of hash ranges come first, then an order inside the one range per source that holds the end.
    """
    ranges = sized.withColumn("bucket", F.substring("hash", 1, digits)).groupBy("source", "bucket").agg(F.sum("size").alias("range_size"))
    ranges = cut(ranges)
    sources = source_targets(ranges.select("source", F.col("range_size").alias("size")), **targets)
    quota = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    sources = cut(sources.withColumn("missing", quota - F.col("whole") * F.col("source_size")).drop("weight"))
    before = lambda c, by: F.coalesce(F.sum(c).over(W.partitionBy("source").orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    named = sources.select(F.col("source").alias("s"), "missing")
    ends = ranges.withColumn("before", before("range_size", ["bucket"])).join(named, F.col("source").eqNullSafe(F.col("s")))
    ends = ends.where((F.col("before") <= F.col("missing")) & (F.col("before") + F.col("range_size") > F.col("missing"))).select("s", "bucket", (F.col("missing") - F.col("before")).alias("left"))
    inside = sized.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.substring("hash", 1, digits) == F.col("bucket")))
    alike = inside.groupBy("source", "hash", "size", "mark").agg(F.count("*").alias("copies"), F.first("left").alias("left"))
    alike = alike.withColumn("here", F.col("copies") * F.col("size"))
    alike = alike.withColumn("rest", F.col("left") - before("here", ["hash", "size", "mark"])).where((F.col("rest") >= 0) & (F.col("rest") < F.col("here")))
    end = alike.select(F.col("source").alias("s"), F.col("hash").alias("end_hash"), F.col("size").alias("end_size"), F.col("mark").alias("end_mark"), F.col("copies").alias("end_copies"), F.col("rest").alias("end_more"))
    return sources.join(end, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "missing")


def _digits(rows: int) -> int:
    """Digits of the hash by which rows fall into ranges of RANGE_ROWS or fewer."""
    return max(1, min(8, math.ceil(math.log(max(1, rows) / RANGE_ROWS, 16))))


def _one_by_one(alike: DataFrame) -> DataFrame:
    """alike(end, size, end_more, ...), rows that are the same within an end: each takes its words until end_more are taken. Rows are counted by partition, and only within a partition one by one."""
    held = cut(alike.withColumn("row", F.monotonically_increasing_id())).withColumn("part", F.shiftright("row", 33))
    per = held.groupBy("end", "part").agg(F.count("*").alias("n"))
    per = per.select(F.col("end").alias("e"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(W.partitionBy("end").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    placed = held.join(per, (F.col("end") == F.col("e")) & (F.col("part") == F.col("p")))
    at = F.col("earlier") + F.row_number().over(W.partitionBy("end", "part").orderBy("row")) - 1
    return placed.withColumn("more", F.greatest(F.lit(0), F.least(F.col("size"), F.col("end_more") - at * F.col("size")))).drop("row", "part", "e", "p", "earlier")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), seed: int = SEED, **targets) -> DataFrame:
    """(id, source, size, source_size, target, taken, *keep) of every document; keep: further columns of docs, for which the texts are read a second time."""
    more = [c for c in keep if c not in (id_col, source_col)]
    mark = F.xxhash64(F.lit(seed), F.col(text_col)).alias("mark")
    rows = docs.select(F.col(id_col), F.col(source_col).alias("source"), _hash(id_col, seed).alias("hash"), mark, F.explode(F.array(words_in(F.col(text_col)))).alias("size"), *[F.col(c).alias(f"keep_{c}") for c in more])
    # the generator keeps the optimizer from counting words again for each use of size
    sized = cut(rows.select(id_col, "source", "hash", "size", "mark"))
    plan = cut(source_plan(sized, _digits(sized.count()), **targets))
    held = plan.agg(F.count("*").alias("n"), F.max("end_copies").alias("copies")).first()
    if held.n <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    planned = (rows if more else sized).join(plan.withColumnRenamed("source", "planned"), F.col("source").eqNullSafe(F.col("planned")))
    place, end = F.struct("hash", "size", "mark"), F.struct(F.col("end_hash").alias("hash"), F.col("end_size").alias("size"), F.col("end_mark").alias("mark"))
    once_more = F.when(F.col("end_hash").isNull(), 0).when(place < end, F.col("size")).when(place == end, F.col("end_more")).otherwise(0)
    dealt = planned.withColumn("more", once_more)
    if (held.copies or 0) > 1:  # several rows are the end of a source
        at_end = F.coalesce((place == end) & (F.col("end_copies") > 1), F.lit(False))
        alike = planned.where(at_end).withColumn("end", F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")), "hash", "size", "mark"))
        dealt = dealt.where(~at_end).unionByName(_one_by_one(alike).drop("end"))
    taken = (F.col("whole") * F.col("size") + F.col("more")).cast("long")
    return dealt.select(id_col, "source", "size", "source_size", "target", taken.alias("taken"), *[F.col(f"keep_{c}").alias(c) for c in more])


def repetitions(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """mixed(..., text, size, taken) -> a row for each repetition that the mix takes; a fraction of a document has its first words, with the white space between them."""
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    part = (F.col("taken") - whole * F.col("size")).cast("int")
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    first = F.array_join(F.slice(pieces, F.lit(1), part), "")
    texts = F.concat(F.array_repeat(F.col(text_col), whole), F.when(part > 0, F.array(first)).otherwise(F.array().cast("array<string>")))
    return mixed.withColumn("_texts", texts).withColumn(text_col, F.explode("_texts")).drop("_texts")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS INT) % 3 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio,
        (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT arg_min(level, ratio) AS fill FROM r WHERE ratio >= level),
t AS (SELECT source, source_size, CASE WHEN fill IS NULL OR ratio < level THEN cap ELSE least(weight * fill, cap) END AS target FROM r LEFT JOIN l ON true),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
m AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS whole FROM q),
x AS (SELECT d.doc_id, d.size, m.source_size, m.target, m.whole, m.quota - m.whole * m.source_size
        - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, remaining)) AS BIGINT) AS taken FROM x
"""
