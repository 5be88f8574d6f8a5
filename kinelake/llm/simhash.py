"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits, one for each bit that is set in over half the shingle hashes. To link all fingerprints within
4 bits, each is cut in two segments of 32 bits: one segment differs in at most 2 bits, so the balls of radius 1 around
both fingerprints' segments share a value. Every distinct fingerprint enters the table under the 33 values of each ball;
fingerprints that meet under a value are verified by their complete distance. A value's fingerprints are linked by a
spanning forest, found breadth-first, never by all their pairs. Values with more than SPLIT_AT fingerprints take another
exact way: two fingerprints are within 4 bits exactly if the balls of radius 2 over all 64 bits share a point, and a
point has at most 2,081 fingerprints.

Defined results: null and wordless texts have fingerprint zero, which links like any other; rows with a null id have a
fingerprint and count for no component's smallest id (null if there is no other); repeated ids keep their rows; an empty
table gives an empty result; only the id and text columns are read; ids are cast to long (one that is no number fails under
ANSI mode and is null without it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.components import connected_components, join_hot, with_lowest, with_value
from kinelake.runtime import cut, ship, tidy

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Distinct fingerprints under one table value that one task links (16 bytes each).
SPLIT_AT = 20_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits of a whole text; words are split at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:z], SEED) for a, z in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        block = np.array(hashes[at : at + (1 << 16)], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    return kept.mapInArrow(tidy(run), f"`{id_col}` long, fp long")


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph that links fps within radius bits; fps distinct, unsigned."""
    a, b, rest = [], [], fps
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                a += [int(at)] * len(found)
                b += found.tolist()
                frontier.extend(found)
                rest = rest[~near]
    return a, b


def _probe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under the 33 values of both segments' balls; a value's lowest bit beyond 32 names the segment."""
    flips = np.concatenate(([0], np.uint64(1) << np.arange(32, dtype=np.uint64))).astype(np.uint64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 4096):
            fp = fps[at : at + 4096]
            keys = np.concatenate([((half[:, None] ^ flips) | np.uint64(seg << 32)).ravel() for seg, half in ((0, fp & np.uint64(0xFFFFFFFF)), (1, fp >> np.uint64(32)))])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.concatenate([np.repeat(fp, 33)] * 2).view(np.int64))], names=["key", "fp"])


def _linked(batches: Iterator[pa.RecordBatch], radius: int, split_at: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> edges (a, b); the fingerprints of a value that has too many come as (fp, null)."""

    def out(a: list[int], b: list[int | None]) -> pa.RecordBatch:
        signed = [np.array(a, np.uint64).view(np.int64), None]
        return pa.RecordBatch.from_arrays([pa.array(signed[0]), pa.array([None] * len(b), pa.int64()) if b and b[0] is None else pa.array(np.array(b, np.uint64).view(np.int64))], names=["a", "b"])

    key, held, large = None, [], False
    for batch in batches:
        keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        fps = fps.view(np.uint64)
        if not len(keys):
            continue
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        ea, eb = [], []
        ends = np.flatnonzero(np.diff(cuts) > 1) if len(cuts) > 2 else np.arange(len(cuts) - 1)
        for i in sorted({0, len(cuts) - 2, *ends.tolist()}):
            run = fps[cuts[i] : cuts[i + 1]]
            if keys[cuts[i]] != key:
                if held and not large:
                    a, b = _forest(np.concatenate(held), radius)
                    ea, eb = ea + a, eb + b
                key, held, large = keys[cuts[i]], [], False
            held.append(run)
            if large or sum(map(len, held)) > split_at:
                yield out(np.concatenate(held).tolist(), [None] * sum(map(len, held)))
                held, large = [], True
        if ea:
            yield out(ea, eb)
    if held and not large:
        a, b = _forest(np.concatenate(held), radius)
        if a:
            yield out(a, b)


def _ball_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate(([np.uint64(0)], one, one[i] ^ one[j]))
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 64):
            fp = fps[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], names=["key", "fp"])


def links(fps: DataFrame, radius: int = RADIUS, split_at: int = SPLIT_AT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of fps(fp) whose components are those of all links within radius (at most 4) bits."""
    if radius != RADIUS:
        raise ValueError("two segments with balls of radius 1, and points within 2 bits, are exact for 4 bits only")
    ship(fps.sparkSession)
    distinct = fps.select("fp").distinct()
    rows = distinct.mapInArrow(tidy(_probe_rows), "key long, fp long")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidy(lambda b: _linked(b, radius, split_at)), "a long, b long").distinct())
    near = found.where("b IS NOT NULL")
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp"))
    if crowded.isEmpty():
        return near
    points = crowded.mapInArrow(tidy(_ball_points), "key long, fp long").groupBy("key").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
    stars = points.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return near.unionByName(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id reachable over links of at most radius bits."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    least = fps.groupBy("fp").agg(F.min(id_col).alias("low"))
    tied = with_lowest(connected_components(links(fps, radius))).withColumnRenamed("node", "fp")
    linked = least.join(tied, "fp")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    named = with_value(linked.select("fp", "component"), lowest, node="fp").select("fp", "component_id")
    # a fingerprint without a link is a component of its own; where all ids of a component are null, so is its low
    own = least.join(named, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return join_hot(fps, cut(own), ["fp"]).select(id_col, "fp", "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
