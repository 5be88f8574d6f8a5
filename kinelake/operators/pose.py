"""Geometry of frames: normalization, bones, resampling, smoothing, channels, joint graphs.

Joint sets and trees are static tables; what needs only a frame's own joints is array expressions inside the row, what
needs neighbouring frames is window functions over (run, joint).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators.qc import MIN_CONF, norm2

ROOT = -1
# fixed values: the body part of the bone tree, as (parent, child); the hands follow from a rule
BODY_BONES = [(ROOT, 5), (ROOT, 6), (5, 7), (7, 9), (6, 8), (8, 10), (9, 91), (10, 112), (ROOT, 0), (ROOT, 11), (ROOT, 12)]
# fixed values: joint sets; a hand is 21 joints from its root on
ARM = [5, 6, 7, 8, 9, 10]
JOINT_SETS = {"arm": ARM, "body_nf": [*ARM, 11, 12], "body": [0, *ARM, 11, 12], "hand": list(range(91, 133)), "both": [0, *ARM, 11, 12, *range(91, 133)], "both_nf": [*ARM, 11, 12, *range(91, 133)]}
LEFT_HAND, RIGHT_HAND = 91, 112


def hand_bones(root: int) -> list[tuple[int, int]]:
    """Five fingers of four joints each: a chain from the root."""
    return [(root if k == 0 else root + 4 * f + k, root + 4 * f + k + 1) for f in range(5) for k in range(4)]


BONES = [*BODY_BONES, *hand_bones(LEFT_HAND), *hand_bones(RIGHT_HAND)]
_PAIRS = [(5, 6), (7, 8), (9, 10), (11, 12), *[(LEFT_HAND + i, RIGHT_HAND + i) for i in range(21)]]


def long_frames(frames: DataFrame) -> DataFrame:
    """(run, t, j, x, y, conf)."""
    return frames.select("run", "t", F.posexplode("joints").alias("j", "p")).select("run", "t", "j", "p.x", "p.y", "p.conf")


def _j(i: int) -> Column:
    return F.get("joints", F.lit(i))


def shoulder_norm(frames: DataFrame) -> DataFrame:
    """Joints relative to the shoulder midpoint, in shoulder widths; a frame without width keeps its scale and loses all confidence."""
    ls, rs = _j(5), _j(6)
    width = norm2(ls["x"] - rs["x"], ls["y"] - rs["y"])
    ok = width > 1e-6
    by = F.when(ok, width).otherwise(1.0)
    cx, cy = (ls["x"] + rs["x"]) / 2, (ls["y"] + rs["y"]) / 2
    moved = F.transform("joints", lambda p: F.struct(((p["x"] - cx) / by).alias("x"), ((p["y"] - cy) / by).alias("y"), F.when(ok, p["conf"]).otherwise(0.0).alias("conf")))
    return frames.withColumn("joints", moved)


def bone_vectors(frames: DataFrame, bones: list[tuple[int, int]], min_conf: float = MIN_CONF) -> DataFrame:
    """(run, t, bone, dx, dy, length, width): length null unless both ends are sure; width is the frame's shoulder width, null unless sure. One array per frame, exploded once."""
    ls, rs = _j(5), _j(6)
    cx, cy = (ls["x"] + rs["x"]) / 2, (ls["y"] + rs["y"]) / 2
    width = norm2(ls["x"] - rs["x"], ls["y"] - rs["y"])
    sure = (ls["conf"] >= min_conf) & (rs["conf"] >= min_conf) & (width > 1e-6)

    def one(b: int, parent: int, child: int) -> Column:
        px, py = (cx, cy) if parent == ROOT else (_j(parent)["x"], _j(parent)["y"])
        dx, dy = _j(child)["x"] - px, _j(child)["y"] - py
        fine = _j(child)["conf"] >= min_conf
        fine = fine if parent == ROOT else fine & (_j(parent)["conf"] >= min_conf)
        return F.struct(F.lit(b).alias("bone"), dx.alias("dx"), dy.alias("dy"), F.when(fine, norm2(dx, dy)).alias("length"))

    every = F.array(*[one(b, p, c) for b, (p, c) in enumerate(bones)])
    return frames.select("run", "t", F.when(sure, width).alias("width"), F.explode(every).alias("v")).select("run", "t", "v.bone", "v.dx", "v.dy", "v.length", "width")


def canonical_bones(vectors: DataFrame) -> DataFrame:
    """Per bone the median length in shoulder widths over all frames of all runs."""
    return vectors.groupBy("bone").agg(F.median(F.col("length") / F.col("width")).alias("length"))


def fore_factors(vectors: DataFrame) -> DataFrame:
    """(run, t, bone, r): length in shoulder widths over the run's 95th percentile, within [0.15, 1.15]; 1 where it can't be judged."""
    rel = F.col("length") / F.col("width")
    anchor = F.percentile(rel, F.lit(0.95)).over(W.partitionBy("run", "bone"))
    fine = rel.isNotNull() & (anchor >= 1e-6)
    return vectors.select("run", "t", "bone", F.when(fine, F.least(F.greatest(rel / anchor, F.lit(0.15)), F.lit(1.15))).otherwise(1.0).alias("r"))


def root_paths(bones: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(bone, ancestor-or-self bone) of every bone: a joint's place is the sum over this path."""
    into = {c: b for b, (_, c) in enumerate(bones)}
    out = []
    for b, (p, _) in enumerate(bones):
        out.append((b, b))
        while p != ROOT:
            out.append((b, into[p]))
            p = bones[into[p]][0]
    return out


def rebuilt(frames: DataFrame, canonical: DataFrame, bones: list[tuple[int, int]], fore: bool = False) -> DataFrame:
    """Frames redrawn around the origin with canonical(bone, length) lengths along the bones' own directions; joints outside the tree are 0, confidence too.

    fore: each bone is drawn as short as it looks in the frame, by its fore_factors. A joint's place is the sum of its
    root path, so nothing but the run's anchors (an array per run) comes from other frames.
    """
    lengths = {r.bone: r.length or 0.0 for r in canonical.select("bone", "length").collect()}  # a row per bone
    ls, rs = _j(5), _j(6)
    cx, cy = (ls["x"] + rs["x"]) / 2, (ls["y"] + rs["y"]) / 2
    width = norm2(ls["x"] - rs["x"], ls["y"] - rs["y"])
    sure = (ls["conf"] >= MIN_CONF) & (rs["conf"] >= MIN_CONF) & (width > 1e-6)
    if fore:
        vectors = bone_vectors(frames, bones)
        anchors = vectors.groupBy("run", "bone").agg(F.percentile(F.col("length") / F.col("width"), F.lit(0.95)).alias("anchor")).where("anchor >= 1e-6")
        frames = frames.join(anchors.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("bone", "anchor"))).alias("_anchors")), "run", "left")

    def part(b: int, parent: int, child: int) -> Column:
        px, py = (cx, cy) if parent == ROOT else (_j(parent)["x"], _j(parent)["y"])
        dx, dy = _j(child)["x"] - px, _j(child)["y"] - py
        full, by = norm2(dx, dy), F.lit(float(lengths.get(b, 0.0)))
        if fore:
            seen = sure & (_j(child)["conf"] >= MIN_CONF)
            seen = seen if parent == ROOT else seen & (_j(parent)["conf"] >= MIN_CONF)
            look = F.when(seen, full / width / F.col("_anchors")[F.lit(b)])
            by = by * F.when(look.isNotNull(), F.least(F.greatest(look, F.lit(0.15)), F.lit(1.15))).otherwise(1.0)
        unit = lambda d: F.when(full > 1e-6, d / full).otherwise(0.0)
        return F.struct((unit(dx) * by).alias("x"), (unit(dy) * by).alias("y"))

    parts = frames.withColumn("_parts", F.array(*[part(b, p, c) for b, (p, c) in enumerate(bones)]))
    paths: dict[int, list[int]] = {}
    into = {c: b for b, (_, c) in enumerate(bones)}
    for b, way in root_paths(bones):
        paths.setdefault(bones[b][1], []).append(way)
    table = F.create_map(*[x for joint, way in sorted(paths.items()) for x in (F.lit(joint), F.array(*[F.lit(w) for w in way]))])
    along = lambda i, c: F.aggregate(table[i], F.lit(0.0), lambda s, b: s + F.get("_parts", b)[c])
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "conf")])
    joints = F.transform("joints", lambda p, i: F.when(i.isin(*into), F.struct(along(i, "x").alias("x"), along(i, "y").alias("y"), p["conf"].alias("conf"))).otherwise(zero))
    return parts.withColumn("joints", joints).drop("_parts", "_anchors")


def fore_ratios(frames: DataFrame, bones: list[tuple[int, int]], anchor: str = "median") -> DataFrame:
    """(run, t, j, r) of every joint: the bone that ends in it, in shoulder widths, over the run's median (or p95) length, within [0.2, 2]; 1 where it can't be judged."""
    rel = F.col("length") / F.col("width")
    usual = F.percentile(rel, F.lit(0.5 if anchor == "median" else 0.95)).over(W.partitionBy("run", "bone"))
    child = F.element_at(F.array(*[F.lit(c) for _, c in bones]), F.col("bone") + 1)
    found = bone_vectors(frames, bones).select("run", "t", child.alias("j"), F.when(rel.isNotNull() & (usual >= 1e-6), F.least(F.greatest(rel / usual, F.lit(0.2)), F.lit(2.0))).alias("r"))
    every = frames.select("run", "t", F.explode(F.sequence(F.lit(0), F.size("joints") - 1)).alias("j"))
    return every.join(found, ["run", "t", "j"], "left").select("run", "t", "j", F.coalesce("r", F.lit(1.0)).alias("r"))


def resample_clamped(long: DataFrame, columns: list[str], target: float = 25.0) -> DataFrame:
    """(run, j, t, columns) of long(run, j, t, fps, columns) at the target rate: round(frames * target / fps) of them, linear, the last frame held beyond its time. A rate within 0.05 of the target stays."""
    w = W.partitionBy("run", "j")
    spanned = long.select("*", (F.max("t").over(w) + 1).alias("n"), *[F.lead(c).over(w.orderBy("t")).alias(f"{c}1") for c in columns])
    same = F.abs(F.col("fps") - target) < 0.05
    step = F.when(same, 1.0).otherwise(F.col("fps") / target)
    total = F.when(same, F.col("n")).otherwise(F.rint(F.col("n") * F.lit(target) / F.col("fps"))).cast("int")
    place = lambda i: F.least(i * step, F.col("n") - 1)
    near = F.sequence(F.greatest(F.lit(0), F.floor(F.col("t") / step).cast("int") - 1), F.greatest(F.lit(0), F.when(F.col("t") == F.col("n") - 1, total).otherwise(F.ceil((F.col("t") + 1) / step).cast("int") + 1)))
    mine = F.filter(near, lambda i: (i < total) & (F.floor(place(i)) == F.col("t")))
    found = spanned.withColumn("i", F.explode(mine)).withColumn("f", place(F.col("i")) - F.col("t"))
    lerp = lambda c: F.col(c) + F.when(F.col(f"{c}1").isNull(), 0.0).otherwise(F.col("f") * (F.col(f"{c}1") - F.col(c)))
    return found.select("run", "j", F.col("i").alias("t"), *[lerp(c).alias(c) for c in columns])


def raw_body(frames: DataFrame, joints: int = 17) -> DataFrame:
    """(run, j, t, x, y, conf) of the first joints of frames(run, t, fps, joints) at 25 frames a second."""
    first = frames.select("run", "t", "fps", F.posexplode(F.slice("joints", 1, joints)).alias("j", "p")).select("run", "t", "fps", "j", "p.x", "p.y", "p.conf")
    return resample_clamped(first, ["x", "y", "conf"])


def resample(long: DataFrame, fps: float, target: float = 25.0) -> DataFrame:
    """(run, j, t, x, y, conf) at the target rate: round((T - 1) * target / fps) + 1 frames, linear, ends kept."""
    w = W.partitionBy("run", "j")
    spanned = long.select("*", F.max("t").over(w).alias("last"), *[F.lead(c).over(w.orderBy("t")).alias(f"{c}1") for c in ("x", "y", "conf")])
    new = F.rint(F.col("last") * F.lit(target / fps)).cast("int")
    # the output frames whose source place lies in [t, t + 1)
    place = lambda i: i * F.col("last").cast("double") / new
    every = F.filter(F.sequence(F.greatest(F.lit(0), F.floor(F.col("t") * F.lit(target / fps)).cast("int") - 2), F.least(new, F.ceil((F.col("t") + 1) * F.lit(target / fps)).cast("int") + 2)), lambda i: F.least(F.floor(place(i)), F.col("last")) == F.col("t"))
    found = spanned.where(new > 0).withColumn("i", F.explode(every)).withColumn("f", place(F.col("i")) - F.col("t"))
    lerp = lambda c: F.when(F.col(f"{c}1").isNull(), F.col(c)).otherwise(F.col(c) + F.col("f") * (F.col(f"{c}1") - F.col(c)))
    single = spanned.where(new <= 0).where("t = 0").select("run", "j", F.lit(0).alias("t"), "x", "y", "conf")
    return found.select("run", "j", F.col("i").alias("t"), lerp("x").alias("x"), lerp("y").alias("y"), lerp("conf").alias("conf")).unionByName(single)


def gauss_weights(fps: float, cutoff: float) -> list[float]:
    """Weights of offsets 0, 1, ... of the low-pass kernel."""
    sigma = fps / (2 * math.pi * cutoff)
    return [math.exp(-0.5 * (k / sigma) ** 2) for k in range(max(round(3 * sigma), 1) + 1)]


def lowpass(long: DataFrame, fps: float = 25.0, cutoff: float = 6.0) -> DataFrame:
    """x and y smoothed over time by a Gaussian cut at its radius; at the ends the weights that are left are renormalized."""
    w = W.partitionBy("run", "j").orderBy("t")
    weights = gauss_weights(fps, cutoff)
    taps = [(k, weights[abs(k)]) for k in range(1 - len(weights), len(weights))]
    at = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w)

    def smooth(c: str) -> Column:
        top, low = F.lit(0.0), F.lit(0.0)
        for k, g in taps:
            v = F.col(c) if k == 0 else at(c, k)
            top, low = top + F.coalesce(v * F.lit(g), F.lit(0.0)), low + F.when(v.isNotNull(), F.lit(g)).otherwise(F.lit(0.0))
        return top / low

    return long.select("run", "j", "t", smooth("x").alias("x"), smooth("y").alias("y"), "conf")


def nearest_fill(rows: DataFrame, value: str, by: tuple[str, ...] = ("run",)) -> DataFrame:
    """``value`` where null taken from the nearest frame that has one, the earlier of two equally near."""
    # both frames grow from their first row on: a frame that shrinks towards the end is read anew for every row
    back, ahead = (W.partitionBy(*by).orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc("t"), F.desc("t")))
    at = F.when(F.col(value).isNotNull(), F.col("t"))
    b, a = F.last(at, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(ahead)
    vb, va = F.last(value, ignorenulls=True).over(back), F.last(value, ignorenulls=True).over(ahead)
    return rows.withColumn("filled", F.when(b.isNull(), va).when(a.isNull(), vb).when(F.col("t") - b <= a - F.col("t"), vb).otherwise(va))


def moving_average(rows: DataFrame, value: str, window: int, by: tuple[str, ...] = ("run",)) -> Column:
    """Centred mean over a window with repeated ends: what lies beyond an end counts as that end; an even window reaches one frame less ahead, one of 1 or less changes nothing."""
    if window <= 1:
        return F.col(value).cast("double")
    half, ahead = window // 2, window - 1 - window // 2
    w, whole = W.partitionBy(*by).orderBy("t"), W.partitionBy(*by).orderBy("t").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    inside = w.rowsBetween(-half, ahead)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    n = F.count("*").over(W.partitionBy(*by))
    before, after = F.greatest(F.lit(0), half - F.col("t")), F.greatest(F.lit(0), F.col("t") + ahead - (n - 1))
    return (F.sum(value).over(inside) + before * first + after * last) / window


#: Branches in the order in which they come, with their channels.
BRANCHES = {"pos": ("x", "y", "conf"), "vel": ("vx", "vy", "v2x", "v2y"), "acc": ("ax", "ay"), "bonedir": ("bdx", "bdy"), "bone": ("bx", "by", "r", "dr")}


def parents(joint_set: str) -> dict[int, int]:
    """The parent of each joint of a set, within it; a joint whose parent the set lacks is its own."""
    joints = JOINT_SETS[joint_set]
    up = {0: 5, 6: 5, 7: 5, 8: 6, 9: 7, 10: 8, 11: 5, 12: 6, LEFT_HAND: 9, RIGHT_HAND: 10}
    up |= {c: p for root in (LEFT_HAND, RIGHT_HAND) for p, c in hand_bones(root)}
    return {j: up[j] if up.get(j, j) in joints and j in up else j for j in joints}


def channels(frames: DataFrame, joint_set: str, use: tuple[str, ...] = tuple(BRANCHES), drop_conf: bool = False) -> DataFrame:
    """(run, t, j, the channels of the branches in use, in the order of BRANCHES) of frames(run, t, joints array<struct<x, y, conf, [r]>>).

    Differences are forward and 0 where they'd leave the run. The bone of nose and shoulders starts in the shoulders'
    middle, others' in their parent, all inside the frame's row; r is 1 where joints have none. drop_conf: confidence is 0.
    """
    if unknown := set(use) - set(BRANCHES):
        raise ValueError(f"unknown branches {sorted(unknown)}")
    up = parents(joint_set)
    has_r = "r" in frames.schema["joints"].dataType.elementType.names
    middle = {c: (_j(5)[c] + _j(6)[c]) / 2 for c in "xy"}

    def one(j: int) -> Column:
        start = middle if j in (0, 5, 6) else {c: _j(up[j])[c] for c in "xy"}
        p = _j(j)
        return F.struct(
            F.lit(j).alias("j"), p["x"].alias("x"), p["y"].alias("y"), (F.lit(0.0) if drop_conf else p["conf"]).alias("conf"),
            (p["x"] - start["x"]).alias("bx"), (p["y"] - start["y"]).alias("by"), (p["r"] if has_r else F.lit(1.0)).alias("r"),
        )

    rows = frames.select("run", "t", F.explode(F.array(*[one(j) for j in JOINT_SETS[joint_set]])).alias("p")).select("run", "t", "p.*")
    w = W.partitionBy("run", "j").orderBy("t")
    diff = lambda c, lag: F.coalesce(F.lead(c, lag).over(w) - F.col(c), F.lit(0.0))
    moved = rows.select("*", *[diff(c, lag).alias(n) for n, c, lag in (("vx", "x", 1), ("vy", "y", 1), ("v2x", "x", 2), ("v2y", "y", 2), ("dr", "r", 1))], F.col("bx").alias("bdx"), F.col("by").alias("bdy"))
    moved = moved.select("*", diff("vx", 1).alias("ax"), diff("vy", 1).alias("ay"))
    return moved.select("run", "t", "j", *[c for b, names in BRANCHES.items() if b in use for c in names])


def pair_channels(frames: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(run, t, pair, mirror_x, mirror_y, dx, dy, dist, conf and the forward differences of the first five)."""
    def one(i: int, a: int, b: int) -> Column:
        l, r = _j(a), _j(b)
        dx, dy = l["x"] - r["x"], l["y"] - r["y"]
        return F.struct(F.lit(i).alias("pair"), (l["x"] + r["x"]).alias("mx"), dy.alias("my"), dx.alias("dx"), dy.alias("dy"), norm2(dx, dy).alias("dist"), F.least(l["conf"], r["conf"]).alias("conf"))

    rows = frames.select("run", "t", F.explode(F.array(*[one(i, a, b) for i, (a, b) in enumerate(pairs)])).alias("p")).select("run", "t", "p.*")
    w = W.partitionBy("run", "pair").orderBy("t")
    names = ("mx", "my", "dx", "dy", "dist")
    return rows.select("*", *[F.coalesce(F.lead(c).over(w) - F.col(c), F.lit(0.0)).alias(f"d_{c}") for c in names])


#: Values of a channel that say nothing was seen: a ratio of 1 is the usual length, a ratio of 0 would be a bone that is gone.
NEUTRAL = {"r": 1.0}


def padded_channels(rows: DataFrame, length: int, joint: str = "j", neutral: bool = True) -> DataFrame:
    """rows of channels or pair_channels, t from 0, with ``mask`` 1, and for every frame from a run's end up to length a row with mask 0.

    Channels are made before, so that no difference crosses the end. In the rows added every channel has its neutral value
    (``NEUTRAL``, else 0); with neutral false all are 0. A run of length frames or more stays as it is.
    """
    names = [c for c in rows.columns if c not in ("run", "t", joint)]
    ends = rows.groupBy("run", joint).agg((F.max("t") + 1).alias("n")).where(F.col("n") < length)
    values = [F.lit(NEUTRAL.get(c, 0.0) if neutral else 0.0).alias(c) for c in names]
    added = ends.select("run", F.explode(F.sequence(F.col("n"), F.lit(length - 1))).alias("t"), joint, *values, F.lit(0).alias("mask"))
    return rows.select("run", "t", joint, *names, F.lit(1).alias("mask")).unionByName(added)


# fixed values: pairs that hold both sides together, and the tree of pairs (shoulders, elbows, wrists, hips, then the hands)
COORDINATION = [(9, 10), (7, 8), (LEFT_HAND, RIGHT_HAND)]
PAIR_BODY = [(0, 1), (1, 2), (0, 3), (2, 4)]


def graph_edges(spark: SparkSession, joint_set: str, coordination: bool = False) -> DataFrame:
    """(i, j) with i < j: positions in the set of the parents' edges, nose to right shoulder, and on demand both sides' wrists, elbows and hands."""
    joints = JOINT_SETS[joint_set]
    every = [*parents(joint_set).items(), (0, 6), *(COORDINATION if coordination else [])]
    rows = sorted({tuple(sorted((joints.index(a), joints.index(b)))) for a, b in every if a in joints and b in joints and a != b})
    return spark.createDataFrame(rows, "i int, j int")


def pair_edges(spark: SparkSession) -> DataFrame:
    """(i, j) of the tree of the 25 pairs: four of the body and 21 of the hands."""
    hand = [(4 + p, 4 + c) for p, c in hand_bones(0)]
    return spark.createDataFrame([*PAIR_BODY, *hand], "i int, j int")


def normalized_adjacency(edges: DataFrame, n: int) -> DataFrame:
    """(i, j, w) of D^-1/2 (A + I) D^-1/2."""
    own = edges.sparkSession.range(n).select(F.col("id").cast("int").alias("i"), F.col("id").cast("int").alias("j"))
    a = edges.select("i", "j").union(edges.select("j", "i")).union(own).distinct()
    degree = a.groupBy("i").agg(F.count("*").alias("d"))
    both = a.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    return both.select("i", "j", (1 / F.sqrt(F.col("d") * F.col("dj"))).alias("w"))


def aligned(frames: DataFrame) -> DataFrame:
    """Every frame turned about the origin so that the line from left to right shoulder is level."""
    a = -F.atan2(_j(6)["y"] - _j(5)["y"], _j(6)["x"] - _j(5)["x"])
    c, s = F.cos(a), F.sin(a)
    return frames.withColumn("joints", F.transform("joints", lambda p: F.struct((p["x"] * c - p["y"] * s).alias("x"), (p["x"] * s + p["y"] * c).alias("y"), p["conf"].alias("conf"))))


def elbow_angle(shoulder: int, elbow: int, wrist: int) -> Column:
    ax, ay = _j(shoulder)["x"] - _j(elbow)["x"], _j(shoulder)["y"] - _j(elbow)["y"]
    bx, by = _j(wrist)["x"] - _j(elbow)["x"], _j(wrist)["y"] - _j(elbow)["y"]
    cosine = (ax * bx + ay * by) / (norm2(ax, ay) * norm2(bx, by) + 1e-8)
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
