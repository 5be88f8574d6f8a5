"""Exact top-k by inner product: best-first search in M-trees.

Rows go into shards of SHARD_ROWS; each shard is bulk-loaded into an M-tree of pages. Inner product isn't a metric, so a
vector x gets one more component sqrt(R^2 - |x|^2), with R the largest norm of its shard; between such vectors and a
query (with 0 there) Euclidean distance d falls as the product rises: d^2 = R^2 + |q|^2 - 2 q.x. A page holds its entries'
pivots, covering radii and distances to the page's own pivot; what the stored distances exclude by the triangle
inequality is never computed. Bounds are floating point with a margin, scores are integers, so results are exact.

BATCH queries go down a tree together: a page is taken when it is the nearest of those open for any of them, with the
queries that can still gain from it, and its products are one matrix product. Queries are broadcast in blocks of
QUERY_BYTES, each against all shards: sending blocks to shards as rows would shuffle every shard once per block. A
partition keeps its k best per query over all its shards, so the bound from one prunes the next, down to whole shards.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do null ids; an empty vector
takes part, all its products are 0; shorter vectors count as padded with 0; ties go to the smaller id. Every row with a
query's id is a query of its own, its candidates are all rows but itself, whatever their ids; fewer than k candidates give
fewer rows; an empty table gives none. Only the id and vector columns are read. A vector whose squared length (after
scaling) exceeds 2^62, so that products might not fit 63 bits, raises an error.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.runtime import cut, ship

SHARD_ROWS, PAGE, SCALE = 4096, 64, 1024
#: Bytes of queries that are broadcast at once, and queries that go down a tree together.
QUERY_BYTES, BATCH = 16 << 20, 512
#: Stands for no score yet.
NONE = -np.iinfo(np.int64).max


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine = rows.where(v.isNotNull() & whole & F.col(id_col).isNotNull())
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x.cast("double") * scale) * (x.cast("double") * scale))
    checked = F.when(square <= float(1 << 62), scaled.cast("array<bigint>")).otherwise(F.raise_error(F.lit("a vector is too long for products of 63 bits")).cast("array<bigint>"))
    return fine.select(F.col(id_col).cast("long").alias("id"), checked.alias("v"))


def build(ids: np.ndarray, vectors: np.ndarray, page: int = PAGE) -> dict:
    """An M-tree of a shard. Pages: dicts with pivot positions, radii, distances to the parent and either children or rows."""
    ids, vectors = np.asarray(ids), np.asarray(vectors)
    norms = (vectors.astype(float) ** 2).sum(1)
    top = norms.max()
    points = np.column_stack([vectors.astype(float), np.sqrt(np.maximum(0.0, top - norms))])
    pages: list[dict] = []
    random = np.random.default_rng(len(ids))

    def distances(to: int, of: np.ndarray) -> np.ndarray:
        return np.sqrt(((points[of] - points[to]) ** 2).sum(1))

    def load(rows: np.ndarray, pivot: int) -> int:
        me = len(pages)
        pages.append({})
        if len(rows) <= page:
            pages[me] = {"leaf": True, "rows": rows, "parent": distances(pivot, rows)}
            return me
        pivots = np.sort(random.choice(rows, min(page, -(-len(rows) // page) + 1), replace=False))
        nearest = np.argmin(np.stack([distances(p, rows) for p in pivots]), axis=0)
        parts = [(p, rows[nearest == i]) for i, p in enumerate(pivots)]
        if max(len(r) for _, r in parts) > 0.9 * len(rows):  # copies, or one dense ball: even parts by distance
            order = rows[np.argsort(distances(pivots[0], rows), kind="stable")]
            parts = [(r[len(r) // 2], r) for r in np.array_split(order, min(page, -(-len(rows) // page)))]
        parts = [(p, r) for p, r in parts if len(r)]
        ps = np.array([p for p, _ in parts])
        radius = np.array([distances(p, r).max() for p, r in parts])
        pages[me] = {"leaf": False, "pivots": ps, "radius": radius, "parent": distances(pivot, ps), "children": [load(r, p) for p, r in parts]}
        return me

    root = 0
    load(np.arange(len(ids)), root)
    return {"ids": ids, "vectors": vectors, "points": points, "top": top, "pages": pages, "root": root, "reach": distances(root, np.arange(len(ids))).max()}


def _width(vectors: np.ndarray, width: int) -> np.ndarray:
    return vectors[:, :width] if vectors.shape[1] >= width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def search_all(tree: dict, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, seen: list[int] | None = None) -> None:
    """Bring scores and ids (a row per query; NONE where there is none yet), the best first, up to the tree's rows. seen: gets the number of products computed."""
    points, pages, vectors = tree["points"], tree["pages"], tree["vectors"]
    k = scores.shape[1]
    q = _width(queries, vectors.shape[1])  # components that a query has beyond the tree's meet zeros
    at = np.column_stack([q.astype(float), np.zeros(len(q))])
    lengths, norms = (at**2).sum(1), (points**2).sum(1)
    square = tree["top"] + lengths
    margin = 1e-6 * (1 + square) ** 0.5
    exact = float(np.sqrt(tree["top"] * max(1.0, lengths.max(initial=0.0)))) < 2.0**52  # then floating point products are whole numbers
    left, right = (at[:, :-1], vectors.astype(float)) if exact else (q, vectors)

    def reach(of: np.ndarray) -> np.ndarray:
        """Rows farther than this can't be among the best of these queries."""
        last = scores[of, -1].astype(float)
        return np.where(scores[of, -1] == NONE, np.inf, np.sqrt(np.maximum(0.0, square[of] - 2.0 * last)) + margin[of] + 1e-7 * np.sqrt(np.abs(last)))

    def far(of: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, lengths[of, None] + norms[rows] - 2.0 * (at[of] @ points[rows].T)))

    everyone, number = np.arange(len(q)), count()
    limit = reach(everyone)
    to_root = far(everyone, np.array([tree["root"]]))[:, 0]
    low = np.maximum(0.0, to_root - tree["reach"])
    heap = [(float(low.min(initial=0.0)), next(number), 0, everyone, low, to_root)] if len(q) else []
    while heap:
        _, _, page, who, low, to_pivot = heapq.heappop(heap)
        can = low <= limit[who]
        who, low, to_pivot, page = who[can], low[can], to_pivot[can], pages[page]
        if not len(who):
            continue
        near = np.abs(to_pivot[:, None] - page["parent"]) <= limit[who, None] + (0.0 if page["leaf"] else page["radius"])
        mine, entries = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(mine):
            continue
        who, low, near = who[mine], low[mine], near[np.ix_(mine, entries)]
        if page["leaf"]:
            rows = page["rows"][entries]
            product = left[who] @ right[rows].T
            if seen is not None:
                seen[0] += product.size
            product = product.astype(np.int64)
            gains = np.flatnonzero((product >= scores[who, -1][:, None]).any(1))
            if len(gains):
                who = who[gains]
                s = np.concatenate([scores[who], product[gains]], axis=1)
                i = np.concatenate([ids[who], np.broadcast_to(tree["ids"][rows], (len(who), len(rows)))], axis=1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                scores[who], ids[who] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                limit[who] = reach(who)
            continue
        d = far(who, page["pivots"][entries])
        bound = np.maximum(low[:, None], d - page["radius"][entries])
        open_ = near & (bound <= limit[who, None])
        for e in np.flatnonzero(open_.any(0)).tolist():
            go = open_[:, e]
            heapq.heappush(heap, (float(bound[go, e].min()), next(number), page["children"][entries[e]], who[go], bound[go, e], d[go, e]))


def search(tree: dict, query: np.ndarray, k: int, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """(score, id) of the k best of the tree's rows for one query."""
    scores, ids = np.full((1, k), NONE), np.full((1, k), np.iinfo(np.int64).max)
    search_all(tree, np.asarray(query, np.int64)[None, :], scores, ids, seen)
    return [(s, i) for s, i in zip(scores[0].tolist(), ids[0].tolist(), strict=True) if s != NONE]


def _matrix(vectors: list) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), width)
    return np.array([np.pad(np.asarray(v, np.int64), (0, width - len(v))) for v in vectors])


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors(id, v) -> a row (tree binary, n) per shard; every row is in one."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        held: list = []

        def tree() -> pd.DataFrame:
            made = build(np.array(ids[:shard_rows], np.int64), _matrix(held[:shard_rows]))
            del made["points"]  # follows from the vectors
            return pd.DataFrame({"tree": [pickle.dumps(made, protocol=5)], "n": [len(made["ids"])]})

        for b in batches:
            ids += b.id.tolist()
            held += b.v.tolist()
            while len(ids) >= shard_rows:
                yield tree()
                del ids[:shard_rows], held[:shard_rows]
        if ids:
            yield tree()

    return vectors.mapInPandas(run, "tree binary, n long")


def load(blob: bytes) -> dict:
    tree = pickle.loads(blob)
    norms = (tree["vectors"].astype(float) ** 2).sum(1)
    tree["points"] = np.column_stack([tree["vectors"].astype(float), np.sqrt(np.maximum(0.0, tree["top"] - norms))])
    return tree


def top_k(shards: DataFrame, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row of queries(id, v), which are rows of the shards too, against all other rows.

    Equal query rows are searched once. The k + 1 best of all rows are found; a query's own row is an entry with its id and
    its product with itself, and of equal entries any will do.
    """
    spark = shards.sparkSession
    ship(spark)
    queries = cut(queries.groupBy("id", "v").agg(F.count("*").alias("times")))
    total = queries.agg(F.sum(8 * F.size("v") + 24)).first()[0] or 0
    blocks = max(1, -(-total // query_bytes))
    found = []
    for number in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == number).collect()
        shared = spark.sparkContext.broadcast((np.array([r.id for r in part], np.int64), np.array([r.times for r in part], np.int64), _matrix([r.v for r in part])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, times, q = shared.value
            scores, ids = np.full((len(q), k + 1), NONE), np.full((len(q), k + 1), np.iinfo(np.int64).max)
            for b in batches:
                for blob in b.tree:
                    tree = load(blob)
                    for at in range(0, len(q), BATCH):
                        search_all(tree, q[at : at + BATCH], scores[at : at + BATCH], ids[at : at + BATCH])
            itself = (q * q).sum(1)
            for at in range(0, len(q), 1000):
                row, place = np.nonzero(scores[at : at + 1000] != NONE)
                row += at
                yield pd.DataFrame({"query": row, "query_id": own[row], "times": times[row], "itself": itself[row], "vec_id": ids[row, place], "score": scores[row, place]})

        near = shards.select("tree").mapInPandas(run, "query long, query_id long, times long, itself long, vec_id long, score long")
        order, whole = W.partitionBy("query").orderBy(F.desc("score"), "vec_id"), W.partitionBy("query")
        best = near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
        own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("itself")), F.col("at"))).over(whole)
        best = best.withColumn("own", F.coalesce(own, F.lit(k + 1))).where(F.col("at") != F.col("own"))
        rank = F.when(F.col("at") > F.col("own"), F.col("at") - 1).otherwise(F.col("at"))
        ranked = best.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", rank.alias("rank"), "vec_id", "score")
        found.append(ranked if blocks == 1 else cut(ranked))
    return reduce(DataFrame.unionByName, found)


def op7_mtree(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = integer_vectors(rows, "vec_id", "embedding")
    return top_k(cut(index(vectors)), vectors.where("id % 100 = 0"), 10)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS rowno, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.rowno, a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rowno <> b.rowno),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY rowno ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
