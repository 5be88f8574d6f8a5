"""Identity by vectors, and the decisions that build on it.

Mean similarities come from a class's sum of unit vectors; where single pairs count they are made within a class only, as products of blocks dealt over a grid of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.operators.qc import LEFT_SHOULDER, LEFT_WRIST, NOSE, RIGHT_SHOULDER, RIGHT_WRIST, joint
from kinelake.runtime import cut, ship

# fixed values: bands and limits of the decisions
MIN_CONF, MIN_FACES, CENTRE_BAND, MIN_SHOULDER, MAX_ANGLE, EDGE, HAND_CUT = 0.3, 3, 0.55, 0.08, 30.0, 0.02, 0.30
#: Rows of a class that meet as one block where all its pairs are needed.
BLOCK_ROWS = 1000
FRONTAL, CROP, IDENTITY, MIN_FRONTAL = (0.25, 0.15), (0.70, 0.50), (0.30, 0.12), 3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is nearly zero."""
    na, nb = norm(a), norm(b)
    return F.when((na < 1e-9) | (nb < 1e-9), 0.0).otherwise(dot(a, b) / (na * nb))


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-9))
    return F.transform(a, lambda x: x / n)


def centroids(faces: DataFrame) -> DataFrame:
    """(conductor, centroid): the mean of unit vectors, made a unit again; one partial aggregate per component."""
    u = faces.select("conductor", F.posexplode(unit(F.col("emb"))).alias("k", "x"))
    mean = u.groupBy("conductor", "k").agg(F.avg("x").alias("m"))
    whole = mean.groupBy("conductor").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("c"))
    return whole.select("conductor", unit(F.col("c")).alias("centroid"))


def blocks(rows: DataFrame, name: str, value: str, rows_each: int = BLOCK_ROWS) -> DataFrame:
    """(conductor, block, blocks, <name>_m, <name>_v): rows(conductor, v, value) of a class dealt by hash to so many blocks that each has about rows_each; vectors v as a matrix. Rows of no class take no part."""
    ship(rows.sparkSession)
    sizes = rows.groupBy("conductor").agg(F.ceil(F.count("*") / rows_each).cast("int").alias("blocks"))
    numbered = rows.withColumn("_id", F.monotonically_increasing_id()).join(sizes, "conductor")
    held = numbered.groupBy("conductor", F.pmod(F.xxhash64("_id"), F.col("blocks")).cast("int").alias("block")).agg(F.max("blocks").alias("blocks"), F.collect_list(F.struct("v", value)).alias("r"))
    m = F.transform("r", lambda r: r["v"])
    return cut(held.select("conductor", "block", "blocks", m.alias(f"{name}_m"), F.transform("r", lambda r: r[value]).alias(f"{name}_v")))


def block_pairs(a: DataFrame, b: DataFrame, partial: Callable[[pd.Series], pd.DataFrame], columns: str) -> DataFrame:
    """(conductor, columns) of partial(pair) for each block of a with each block of b of its class.

    The pairs of a class are a grid of cells, H x H with H the root of its blocks: a block of a goes to a row of cells, one of b to a column, so
    copies are H and tasks H^2 however large the class; a task streams its pairs.
    """
    side = lambda blocks: F.greatest(F.lit(1), F.ceil(F.sqrt(blocks)).cast("int"))
    most = a.groupBy("conductor").agg(F.max("blocks").alias("n")).unionByName(b.groupBy("conductor").agg(F.max("blocks").alias("n"))).groupBy("conductor").agg(side(F.max("n")).alias("h"))
    every = F.sequence(F.lit(0), F.col("h") - 1)
    left = a.join(most, "conductor").withColumn("i", F.col("block") % F.col("h")).withColumn("j", F.explode(every)).drop("block", "blocks", "h")
    right = b.join(most, "conductor").withColumn("j", F.col("block") % F.col("h")).withColumn("i", F.explode(every)).drop("block", "blocks", "h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, pair in batch.iterrows():
                made = partial(pair)
                made.insert(0, "conductor", pair.conductor)
                yield made

    pairs = left.join(right, ["conductor", "i", "j"]).drop("i", "j")
    return pairs.mapInPandas(run, f"conductor {a.schema['conductor'].dataType.simpleString()}, {columns}")


def _unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows at unit length, nearly zero ones zero."""
    x = np.stack(m).astype(float)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(n < 1e-9, 0.0, x / np.maximum(n, 1e-9))


def match_scores(probes: DataFrame, references: DataFrame) -> DataFrame:
    """(vec_id, score): per probe(conductor, vec_id, emb) the highest cosine to its class's references(conductor, emb), as products of blocks."""

    def partial(pair: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"vec_id": pair.a_v, "score": (_unit_rows(pair.a_m) @ _unit_rows(pair.b_m).T).max(1)})

    a = blocks(probes.select("conductor", F.col("emb").alias("v"), "vec_id"), "a", "vec_id")
    b = blocks(references.select("conductor", F.col("emb").alias("v"), F.lit(0).alias("one")), "b", "one")
    return block_pairs(a, b, partial, "vec_id long, score double").groupBy("vec_id").agg(F.max("score").alias("score"))


def unit_faces(faces: DataFrame) -> DataFrame:
    """(conductor, vec_id, video_id, u): unit vectors."""
    return faces.select("conductor", "vec_id", "video_id", unit(F.col("emb")).alias("u"))


def class_sums(units: DataFrame) -> DataFrame:
    """(conductor, total, n): the sum of a class's unit vectors, one partial aggregate per component."""
    each = units.select("conductor", F.posexplode("u").alias("k", "x")).groupBy("conductor", "k").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return each.groupBy("conductor").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("total"), F.max("n").alias("n"))


def loo_scores(faces: DataFrame) -> DataFrame:
    """(conductor, i, score): mean cosine to the other members; 0 for a class of one. A mean of products is the product with the sum, so no pairs are made."""
    u = unit_faces(faces)
    both = u.join(class_sums(u), "conductor")
    others = F.try_divide(dot(F.col("u"), F.col("total")) - dot(F.col("u"), F.col("u")), F.col("n") - 1)
    return both.select("conductor", F.col("vec_id").alias("i"), F.coalesce(others, F.lit(0.0)).alias("score"))


def dominant_cluster(faces: DataFrame, threshold: float) -> DataFrame:
    """(conductor, medoid, member): members at or above the threshold to the medoid, the vector of highest mean cosine (ties: smaller id)."""
    u = unit_faces(faces)
    mean = u.join(class_sums(u), "conductor").select("conductor", "vec_id", "u", F.round(dot(F.col("u"), F.col("total")) / F.col("n"), 9).alias("m"))
    medoid = mean.groupBy("conductor").agg(F.max_by(F.struct(F.col("vec_id").alias("medoid"), F.col("u").alias("best")), F.struct("m", -F.col("vec_id"))).alias("b")).select("conductor", "b.*")
    near = u.join(medoid, "conductor").where(dot(F.col("u"), F.col("best")) >= threshold)
    return near.select("conductor", "medoid", F.col("vec_id").alias("member"))


def cross_video_cluster(faces: DataFrame, threshold: float) -> DataFrame:
    """Per class the seed whose neighbours span most videos, then are most (ties: smaller id), with those counts.

    Neighbours are counted over all pairs of a class, as the method asks, as products of blocks; what leaves a pair of blocks are counts by seed and video.
    """
    u = unit_faces(faces)
    seeds = blocks(u.select("conductor", F.col("u").alias("v"), "vec_id"), "a", "vec_id")
    others = blocks(u.select("conductor", F.col("u").alias("v"), "video_id"), "b", "video_id")

    def partial(pair: pd.Series) -> pd.DataFrame:
        near = np.stack(pair.a_m) @ np.stack(pair.b_m).T >= threshold
        videos, of = np.unique(np.asarray(pair.b_v), return_inverse=True)
        counts = near.astype(np.int64) @ np.eye(len(videos), dtype=np.int64)[of]
        row, at = np.nonzero(counts)
        return pd.DataFrame({"i": np.asarray(pair.a_v)[row], "video_id": videos[at], "n": counts[row, at]})

    found = block_pairs(seeds, others, partial, "i long, video_id long, n long")
    per = found.groupBy("conductor", "i", "video_id").agg(F.sum("n").alias("n")).groupBy("conductor", "i").agg(F.count("*").alias("videos"), F.sum("n").alias("members"))
    best = F.max_by(F.struct("i", "videos", "members"), F.struct("videos", "members", -F.col("i")))
    return per.groupBy("conductor").agg(best.alias("b")).select("conductor", F.col("b.i").alias("seed"), "b.videos", "b.members")


def select_diverse(faces: DataFrame, k: int, min_score: float, duplicate: float = 0.95) -> DataFrame:
    """(conductor, vec_id, rank): greedily the best-scored vector, then whichever is farthest from those taken (ties: the better score, then the smaller id), near-copies left out.

    faces(conductor, vec_id, emb, score). Every round takes one vector of each class by an aggregate and brings all vectors' highest similarity to those
    taken up to date, so a class is as many tasks as it has rows for; rounds are k small jobs.
    """
    u = faces.where(F.col("score") >= min_score).select("conductor", "vec_id", "score", unit(F.col("emb")).alias("u"))
    rows = cut(u.withColumn("near", F.lit(None).cast("double")))
    taken = None
    for rank in range(1, k + 1):
        order = F.struct(-F.round(F.coalesce("near", F.lit(-2.0)), 12), "score", -F.col("vec_id"))
        free = rows.where(F.coalesce(F.col("near"), F.lit(-2.0)) < duplicate)
        best = cut(free.groupBy("conductor").agg(F.max_by(F.struct("vec_id", "u"), order).alias("b")).select("conductor", F.col("b.vec_id").alias("vec_id"), F.col("b.u").alias("taken")))
        picked = best.select("conductor", "vec_id", F.lit(rank).alias("rank"))
        taken = picked if taken is None else taken.unionByName(picked)
        if rank == k or best.isEmpty():
            break
        own = best.withColumnRenamed("vec_id", "own")  # one row per class
        similar = F.when(F.col("vec_id") == F.col("own"), F.lit(2.0)).otherwise(dot(F.col("u"), F.col("taken")))
        rows = cut(rows.join(own, "conductor").select("conductor", "vec_id", "score", "u", F.greatest("near", similar).alias("near")))
    return taken.select("conductor", "vec_id", "rank")


def frontal_reasons(width: float) -> Column:
    """array<string> of what keeps a frame from being frontal; empty: it is."""
    sure = lambda j: joint(j)["conf"] >= MIN_CONF
    lx, rx = joint(LEFT_SHOULDER)["x"], joint(RIGHT_SHOULDER)["x"]
    span, middle = F.abs(lx - rx), (lx + rx) / 2
    angle = F.degrees(F.atan(2 * F.abs(joint(NOSE)["x"] - middle) / F.greatest(span, F.lit(1e-6))))
    half = CENTRE_BAND / 2
    found = F.array(
        F.when(~(sure(LEFT_WRIST) & sure(RIGHT_WRIST)), "wrist not visible"), F.when(span < MIN_SHOULDER * width, "person too small"),
        F.when(~middle.between(width * (0.5 - half), width * (0.5 + half)), "off center"),
        F.when(~sure(NOSE), "nose not visible").when(angle > MAX_ANGLE, "face not frontal"),
    )
    return F.when(~(sure(LEFT_SHOULDER) & sure(RIGHT_SHOULDER)), F.array(F.lit("shoulder not visible"))).otherwise(F.array_compact(found))


def in_frame(joints: Column, width: float, height: float) -> Column:
    """Whether all joints of an array are sure and inside the frame's safe box."""
    m = EDGE * min(width, height)
    return F.forall(joints, lambda p: (p["conf"] >= MIN_CONF) & p["x"].between(m, width - m) & p["y"].between(m, height - m))


def hand_kept(joints: Column, width: float, height: float) -> Column:
    """False if too large a share of a hand's sure joints lies outside the safe box; a hand without sure joints passes."""
    m = EDGE * min(width, height)
    present = F.filter(joints, lambda p: p["conf"] >= MIN_CONF)
    cut = F.filter(present, lambda p: ~(p["x"].between(m, width - m) & p["y"].between(m, height - m)))
    return (F.size(present) == 0) | (F.size(cut) / F.greatest(F.size(present), F.lit(1)) < HAND_CUT)


def band(value: Column, limits: tuple[float, float]) -> Column:
    return F.when(value >= limits[0], "accept").when(value >= limits[1], "hold").otherwise("reject")


def decide(frontal: Column, n_frontal: Column | None, identity: Column, crop: Column, identity_enabled: bool = True) -> Column:
    """struct<decision, reasons>: any reject rejects, any hold holds; a crop alone never rejects, unknown identity holds. identity_enabled: False leaves identity out; n_frontal: None doesn't count frames."""
    f = band(frontal, FRONTAL) if n_frontal is None else F.when(n_frontal < MIN_FRONTAL, "reject").otherwise(band(frontal, FRONTAL))
    i, c = F.when(identity.isNull(), "hold").otherwise(band(identity, IDENTITY)), band(crop, CROP)
    bands = F.array(f, *[i][: int(identity_enabled)], F.when(c == "reject", "hold").otherwise(c))
    decision = F.when(F.array_contains(bands, "reject"), "reject").when(F.array_contains(bands, "hold"), "hold").otherwise("accept")
    said = F.concat_ws(
        ";", F.format_string("frontal=%.2f(%s)", frontal, f), F.when(F.lit(not identity_enabled), "id=off").when(identity.isNull(), "id=none(hold)").otherwise(F.format_string("id=%.2f(%s)", identity, i)), F.format_string("crop=%.2f(%s)", crop, c)
    )
    return F.struct(decision.alias("decision"), said.alias("reasons"))


def aggregate_match(scores: DataFrame, min_faces: int = MIN_FACES) -> DataFrame:
    """Median score per video, null where it has too few faces."""
    return scores.groupBy("video_id").agg(F.count("score").alias("n"), F.median("score").alias("m")).select("video_id", F.when(F.col("n") >= min_faces, F.col("m")).alias("score"))


def best_index(scores: Column) -> Column:
    """Place of the highest non-null score, the first of equal ones; null if all are."""
    return F.when(F.array_max(scores).isNotNull(), F.array_position(scores, F.array_max(scores)) - 1).cast("int")
