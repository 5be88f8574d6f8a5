"""Hard negatives by dual-tree search: rows of other labels whose products with an anchor come close to its positives'.

Candidates go into shards of SHARD_ROWS, anchors into blocks of BLOCK_ROWS; either becomes a binary tree of balls, cut by
label while a node has several, then at the median between two far points. For a node of anchors with centre a and radius
s and one of candidates with centre c and radius t, every product lies within a.c +- (|a| t + |c| s + s t). A pair of nodes
whose interval lies under what each anchor in it still asks for, or over all their ceilings, goes at once with the whole group
of anchors, as does one whose labels can't match; pairs are taken in falling order of their upper ends, the larger node
of one is split, and pairs of leaves are scored as matrix products. Intervals are floating point with a margin, scores are whole numbers, so
results are exact.

An anchor has lanes, each with a floor, a ceiling and the best k so far. First one lane finds its positives among rows
of its label; then a lane for each different positive score p finds negatives within [low p, p] among the other labels. Blocks
meet shards in cells of a grid, G x H tasks: a shard goes to H cells, a block to G, with H : G set so that the copies of either
take like room; no copies of rows but those, and nothing but counts comes to the driver. Within a cell a block passes all its shards in a row and carries its lanes.

Defined results: null ids and labels, and vectors that are null or hold null or non-finite components, take no part; an empty
vector does, its products are 0; shorter vectors count as filled up with zeros. Every row with an anchor's id is an anchor of its own, and every
row but itself a candidate, whatever its id; equal anchors are searched once and returned as often as they occur. Higher scores
come first, then smaller ids; an anchor without positives, or a positive without negatives, has no rows; an empty table gives
none. Only the id, label and vector columns are read. A vector whose squared length (after scaling) exceeds 2^61 raises an error.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.runtime import cut, ship

SHARD_ROWS, BLOCK_ROWS, LEAF = 4096, 2048, 64
#: Bytes of vectors in a shard or block, whatever its rows.
TREE_BYTES = 8 << 20
SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: Negatives score at least LOW hundredths of their positive.
LOW = 80
#: Stands for no score yet, and for a lane that nothing can enter.
NONE, CLOSED = -(1 << 62), 1 << 62


def integer_rows(rows: DataFrame, id_col: str, label: Column, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, v array<long>) of the rows that take part."""
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"))
    fine = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + (F.abs(x.cast("double") * scale) + 1) * (F.abs(x.cast("double") * scale) + 1))
    return fine.select("id", "label", F.when(square <= float(1 << 61), scaled).otherwise(F.raise_error(F.lit("a vector is too long for products of 62 bits")).cast("array<bigint>")).alias("v"))


def build(vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> dict:
    """A tree: the order of rows and, per node, its stretch of them, its children (-1: a leaf), centre, radius, least and greatest label."""
    points = vectors.astype(float)
    order = np.argsort(labels, kind="stable")
    nodes: list[list] = []

    def grow(start: int, end: int) -> int:
        me, rows = len(nodes), order[start:end]
        centre = points[rows].mean(0)
        radius = math.sqrt(float(((points[rows] - centre) ** 2).sum(1).max(initial=0.0)))
        node = [start, end, -1, -1, centre, radius, int(labels[rows].min()), int(labels[rows].max())]
        nodes.append(node)
        if end - start <= leaf:
            return me
        if node[6] != node[7]:  # rows are still in the order of labels: cut between two of them, near the middle
            changes = np.flatnonzero(labels[rows][1:] != labels[rows][:-1]) + 1
            middle = start + int(changes[np.argmin(np.abs(changes - len(rows) // 2))])
        else:
            one = points[rows[((points[rows] - centre) ** 2).sum(1).argmax()]]
            other = points[rows[((points[rows] - one) ** 2).sum(1).argmax()]]
            order[start:end] = rows[np.argsort(points[rows] @ (other - one), kind="stable")]
            middle = (start + end) // 2
        node[2], node[3] = grow(start, middle), grow(middle, end)
        return me

    if len(order):
        grow(0, len(order))
    of = lambda i, kind: np.array([n[i] for n in nodes], kind)
    centres = np.array([n[4] for n in nodes]).reshape(len(nodes), vectors.shape[1])
    return {
        "order": order, "start": of(0, int), "end": of(1, int), "left": of(2, int), "right": of(3, int), "least": of(6, np.int64), "most": of(7, np.int64),
        "centre": centres, "length": np.sqrt((centres**2).sum(1)), "radius": of(5, float) * (1 + 1e-9),
    }


def _narrow(v: np.ndarray) -> np.ndarray:
    """In the smallest type of whole numbers that holds them."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    return v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _matrix(vectors: list) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    made = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(made, vectors, strict=True):
        row[: len(v)] = v
    return made


def plant(rows: pd.DataFrame, leaf: int = LEAF) -> bytes:
    """rows(id, label, v, ...) as a tree with all columns in its order; v as a matrix."""
    vectors, labels = _matrix(rows.v.tolist()), rows.label.to_numpy(np.int64)
    tree = build(vectors, labels, leaf)
    order = tree.pop("order")
    held = {c: rows[c].to_numpy()[order] for c in rows.columns if c != "v"}
    return pickle.dumps({"tree": tree, "vectors": _narrow(vectors[order]), "columns": held}, protocol=5)


def trees(rows: DataFrame, most: int, most_bytes: int = TREE_BYTES, leaf: int = LEAF) -> DataFrame:
    """rows(id, label, v, ...) -> (number, tree binary): every row is in one tree, of at most `most` rows of its partition (by number and by bytes once filled up to its widest)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        count = width = 0
        for b in batches:
            at = 0
            sizes = b.v.map(len).to_numpy()
            while at < len(b):
                widths = np.maximum(np.maximum.accumulate(sizes[at:]), width)
                number = count + np.arange(1, len(b) - at + 1)
                fits = int(((number <= most) & ((number * widths * 8 <= most_bytes) | (number == 1))).sum())
                if fits:
                    held.append(b.iloc[at : at + fits])
                    count, width, at = count + fits, int(widths[fits - 1]), at + fits
                if at < len(b):
                    yield pd.DataFrame({"tree": [plant(pd.concat(held), leaf)]})
                    held, count, width = [], 0, 0
        if held:
            yield pd.DataFrame({"tree": [plant(pd.concat(held), leaf)]})

    return cut(rows.mapInPandas(run, "tree binary").select(F.monotonically_increasing_id().alias("number"), "tree"))


class Lanes:
    """What the anchors of a block ask for: floors and ceilings (anchors x lanes) and the best k so far."""

    def __init__(self, floors: np.ndarray, ceilings: np.ndarray, k: int):
        self.worst, self.ceilings = floors.copy(), ceilings
        self.scores = np.full((*floors.shape, k), NONE)
        self.ids = np.full((*floors.shape, k), np.iinfo(np.int64).max)

    def take(self, anchors: np.ndarray, products: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None) -> None:
        """Enter products (anchors x candidates) where allowed."""
        worst, ceilings = self.worst[anchors], self.ceilings[anchors]
        ok = (products[:, None, :] >= worst[:, :, None]) & (products[:, None, :] <= ceilings[:, :, None])
        if allowed is not None:
            ok &= allowed[:, None, :]
        which, lane = np.nonzero(ok.any(2))
        if not len(which):
            return
        k, row = self.scores.shape[2], anchors[which]
        s = np.concatenate([self.scores[row, lane], np.where(ok[which, lane], products[which], NONE)], axis=1)
        i = np.concatenate([self.ids[row, lane], np.broadcast_to(ids, (len(which), len(ids)))], axis=1)
        i[s == NONE] = np.iinfo(np.int64).max
        best = np.lexsort((i, -s), axis=1)[:, :k]
        self.scores[row, lane], self.ids[row, lane] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        self.worst[row, lane] = np.maximum(self.worst[row, lane], self.scores[row, lane][:, -1])


def search(block: dict, shard: dict, lanes: Lanes, same: bool, seen: list[int] | None = None) -> None:
    """Enter the shard's rows of the same label (or of others) into the lanes of the block's anchors. seen: gets the number of products computed."""
    a, c = block["tree"], shard["tree"]
    left, right = block["vectors"], shard["vectors"]
    width = max(left.shape[1], right.shape[1])  # components that either hasn't are zeros
    at, to = a["centre"][:, : c["centre"].shape[1]], c["centre"][:, : a["centre"].shape[1]]
    share = min(left.shape[1], right.shape[1])
    left, right = left[:, :share], right[:, :share]
    reach = float((a["length"].max(initial=0) + a["radius"].max(initial=0)) * (c["length"].max(initial=0) + c["radius"].max(initial=0)))
    kind = float if reach < 2.0**52 else np.int64  # floating point products are whole numbers below that
    margin = 1e-9 * (1 + reach) * max(1, width) ** 0.5
    own, ids, labels = block["columns"]["label"], shard["columns"]["id"], shard["columns"]["label"]

    def interval(i: np.ndarray | int, j: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        middle = (at[i] * to[j]).sum(-1)
        slack = a["length"][i] * c["radius"][j] + c["length"][j] * a["radius"][i] + a["radius"][i] * c["radius"][j] + margin
        return middle - slack, middle + slack

    def wanted(i: int, j: int, low: float, high: float) -> bool:
        rows = slice(a["start"][i], a["end"][i])
        return high >= lanes.worst[rows].min() and low <= lanes.ceilings[rows].max()

    def matches(i: int, j: int) -> bool:
        if same:
            return bool(a["least"][i] <= c["most"][j] and c["least"][j] <= a["most"][i])
        return not (a["least"][i] == a["most"][i] == c["least"][j] == c["most"][j])

    heap: list[tuple[float, float, int, int]] = []

    def push(pairs: list[tuple[int, int]]) -> None:
        for i, j in pairs:
            if matches(i, j):
                low, high = interval(i, j)
                if wanted(i, j, low, high):
                    heapq.heappush(heap, (-float(high), float(low), i, j))

    if len(a["start"]) and len(c["start"]):
        push([(0, 0)])
    while heap:
        high, low, i, j = heapq.heappop(heap)
        if not wanted(i, j, low, -high):
            continue
        leaf_a, leaf_c = a["left"][i] < 0, c["left"][j] < 0
        if leaf_a and leaf_c:
            mine, theirs = slice(a["start"][i], a["end"][i]), slice(c["start"][j], c["end"][j])
            product = (left[mine].astype(kind) @ right[theirs].astype(kind).T).astype(np.int64)
            if seen is not None:
                seen[0] += product.size
            pure = a["least"][i] == a["most"][i] and c["least"][j] == c["most"][j]
            allowed = None if pure else (own[mine][:, None] == labels[theirs]) == same
            lanes.take(np.arange(a["start"][i], a["end"][i]), product, ids[theirs], allowed)
        elif leaf_c or (not leaf_a and a["radius"][i] * c["length"][j] >= c["radius"][j] * a["length"][i]):
            push([(int(a["left"][i]), j), (int(a["right"][i]), j)])
        else:
            push([(i, int(c["left"][j])), (i, int(c["right"][j]))])


def grid(blocks: int, shards: int, tasks: int) -> tuple[int, int]:
    """(G, H), G H near tasks: a block goes to G cells, a shard to H; copies of either take like room."""
    h = max(1, min(blocks, round(math.sqrt(tasks * blocks / max(1, shards)))))
    return max(1, min(shards, -(-tasks // h))), h


def meet(blocks: DataFrame, shards: DataFrame, k: int, same: bool, tasks: int) -> DataFrame:
    """(key, lane, id, score): for every lane of every anchor in blocks its best k in each column of cells.

    Anchors have the columns key and, as floors and ceilings, lists of one number per lane.
    """
    g, h = grid(blocks.count(), shards.count(), tasks)
    left = blocks.select(F.col("number").alias("block"), F.col("tree").alias("anchors"), F.pmod("number", F.lit(h)).alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long"))).alias("g"))
    right = shards.select(F.col("tree").alias("candidates"), F.pmod(F.xxhash64("number"), F.lit(g)).alias("g"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(h - 1).cast("long"))).alias("h"))

    def found(block: dict, lanes: Lanes) -> Iterator[pd.DataFrame]:
        for at in range(0, len(lanes.scores), 1000):
            row, lane, place = np.nonzero(lanes.scores[at : at + 1000] != NONE)
            row += at
            yield pd.DataFrame({"key": block["columns"]["key"][row], "lane": lane, "id": lanes.ids[row, lane, place], "score": lanes.scores[row, lane, place]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = block = lanes = None
        for b in batches:
            for n, mine, theirs in zip(b.block, b.anchors, b.candidates, strict=True):
                if n != number:
                    if block is not None:
                        yield from found(block, lanes)
                    number, block = n, pickle.loads(mine)
                    lists = [block["columns"][c].tolist() for c in ("floors", "ceilings")]
                    width = max(map(len, lists[0]))
                    floors, ceilings = (np.array([[*x, *[closed] * (width - len(x))] for x in made], np.int64) for made, closed in zip(lists, (CLOSED, -CLOSED), strict=True))
                    lanes = Lanes(floors, ceilings, k)
                search(block, pickle.loads(theirs), lanes, same)
        if block is not None:
            yield from found(block, lanes)

    pairs = left.join(right.hint("merge"), ["g", "h"]).select("block", "anchors", "candidates")
    return pairs.mapInPandas(run, "key long, lane int, id long, score long")


def _blocks(anchors: DataFrame, rows: int, leaf: int) -> DataFrame:
    """Anchors of like labels share a block."""
    number = max(1, -(-anchors.count() // rows))
    return trees(anchors.repartitionByRange(number, "label", F.xxhash64("key")), rows, leaf=leaf)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF, tasks: int | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of anchors(id, label, v), which are rows of rows(id, label, v) too."""
    tasks = tasks or 2 * rows.sparkSession.sparkContext.defaultParallelism
    shards = trees(rows, shard_rows, leaf=leaf)
    itself = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    own = cut(anchors.groupBy("id", "label", "v").agg(F.count("*").alias("times")).select(F.monotonically_increasing_id().alias("key"), "id", "label", "v", "times", itself.alias("itself")))
    ask = own.select("key", "label", "v", F.array(F.lit(NONE + 1)).alias("floors"), F.array(F.lit(CLOSED)).alias("ceilings"))
    near = meet(_blocks(ask, block_rows, leaf), shards, positives + 1, True, tasks).select("key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    order, whole = W.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id"), W.partitionBy("key")
    near = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives + 1).join(own.select("key", "id", "itself"), "key")
    # of an anchor's entries one is itself: one with its id and its product with itself, and of equal entries any will do
    mine = F.min(F.when((F.col("positive_id") == F.col("id")) & (F.col("positive_score") == F.col("itself")), F.col("at"))).over(whole)
    near = near.withColumn("mine", F.coalesce(mine, F.lit(positives + 1))).where("at != mine")
    pairs = cut(near.select("key", "at", "positive_id", "positive_score"))
    scores = pairs.where("positive_score >= 0").groupBy("key").agg(F.sort_array(F.collect_set("positive_score")).alias("ceilings"))
    floors = F.transform("ceilings", lambda p: F.ceil(F.lit(low) * p.cast("decimal(28,0)") / 100).cast("long"))
    lanes = cut(own.select("key", "label", "v").join(scores, "key").select("key", "label", "v", floors.alias("floors"), "ceilings"))
    found = meet(_blocks(lanes, block_rows, leaf), shards, negatives, False, tasks)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("key", "lane").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= negatives)
    named = lanes.select("key", F.posexplode("ceilings").alias("lane", "positive_score"))
    result = pairs.join(named, ["key", "positive_score"]).join(found, ["key", "lane"]).join(own.select("key", F.col("id").alias("anchor_id"), "times"), "key")
    result = result.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return result.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_dual_tree(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = integer_rows(table, "vec_id", label, "embedding")
    return hard_negatives(rows, rows.where("id % 100 = 0"))


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rowno, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rowno, a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
      FROM v a JOIN v b ON a.id % 100 = 0 AND a.rowno <> b.rowno),
p AS (SELECT *, row_number() OVER (PARTITION BY rowno ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.rowno, p.place ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.rowno = p.rowno AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
"""
