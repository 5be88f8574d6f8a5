"""Near copies by true similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are texts whose fingerprints the SimHash operator finds equal or links, over five-word shingles (of two linked
fingerprints with many texts, one text each stands for them), and what shares a MinHash band. SimHash alone
can't give right results here: at a similarity of 0.8 two 64-bit fingerprints differ in about 10 bits, so its 4 bits find
one pair in twenty or thirty, and a radius that finds them all (18 bits) makes candidates of one unrelated pair in
several thousand. There are 24 bands of 5 minima each, so a pair at exactly 0.8 shares a band with a probability of
0.99993, at 0.9 of 1 - 1e-9; that is the only place where a pair can be missed. Bands with the same texts count once.
Every candidate is verified. Those that hang together go to one task, each text once; where they have more than LARGE
shingles each band goes to a task of its own, and a band that is larger still is cut in parts and every two parts meet in
one task. There, a spanning forest of all links is found breadth-first with exact similarities from an inverted index of
the texts not yet reached; no group is cut short.

Defined results: texts of up to five words have one shingle, the whole text; null and wordless texts are alike; words are
split at ASCII white space, A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.llm.components import connected_components, counted, with_lowest, with_value
from kinelake.llm.simhash import fingerprints, links
from kinelake.runtime import cut, ship, tidy

SHINGLE, SEED, BANDS, ROWS = 5, 42, 24, 5
#: Similar enough: NUM / DEN.
NUM, DEN = 4, 5
#: Shingles of connected candidates that one task takes, and what one counts for: a text that repeats itself has few shingles and many bytes.
LARGE, SHINGLE_BYTES = 1_000_000, 30

_rng = np.random.default_rng(SEED)
_XOR = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles; never empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:z], SEED) for a, z in spans), np.uint64, n - SHINGLE + 1))


def _minima(found: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):  # bounded memory for very long texts
        low = np.minimum(low, ((found[at : at + 1024] ^ _XOR) * _ODD).min(1))
    return low


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, n, key): n is the size in shingles, by number or length, whichever is more; a key for each band."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, lows = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, BANDS, ROWS), np.uint64)
        for i, text in enumerate(batch.column(1)):
            found = shingles(text.as_py())
            sizes[i], lows[i] = max(len(found), len(text.as_py() or "") // SHINGLE_BYTES), _minima(found).reshape(BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), lows.shape[:2])
        for j in range(ROWS):
            key = (key ^ lows[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            key = key ^ (key >> np.uint64(29))
        node = batch.column(0).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, BANDS)), pa.array(np.repeat(sizes, BANDS)), pa.array(key.ravel().view(np.int64))], names=["node", "n", "key"])


def forest(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges (positions) of a spanning forest of the graph that links sets of similarity NUM / DEN or more."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    rest = np.ones(len(sets), bool)
    a, b, built, frontier = [], [], None, []
    while rest.any():
        if not frontier:
            frontier = [int(rest.argmax())]
            rest[frontier[0]] = False
        left = np.flatnonzero(rest)
        if not len(left):
            break
        if built is None or 2 * len(left) < len(built):
            built = left
            tokens = np.concatenate([sets[i] for i in left])
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], np.repeat(np.arange(len(left)), sizes[left])[order]
        at = frontier.pop()
        low, high = np.searchsorted(tokens, sets[at], "left"), np.searchsorted(tokens, sets[at], "right")
        n = high - low
        hits = owners[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        both = np.bincount(hits, minlength=len(built))
        near = built[(DEN * both >= NUM * (sizes[at] + sizes[built] - both)) & rest[built]]
        rest[near] = False
        a += [at] * len(near)
        b += near.tolist()
        frontier += near.tolist()
    return a, b


def _links(group: pa.Table) -> pa.Table:
    node = group.column("node").to_numpy()
    a, b = forest([shingles(t.as_py()) for t in group.column("text")])
    return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})


def components(texts: DataFrame, large: int = LARGE) -> DataFrame:
    """(node, component) of every row of texts(node, text), distinct in node, that has a near copy; component is the smallest node reachable."""
    ship(texts.sparkSession)
    keys = cut(texts.select("node", "text").mapInArrow(tidy(_bands), "node long, n long, key long"))
    per = keys.groupBy("key").agg(F.count("*").alias("many"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("mix")).where("many > 1")
    shared = with_value(keys, per, key="key")  # a key with a third of all texts is dealt over tasks
    members = cut(shared.select(F.xxhash64("many", "low", "mix").alias("band"), "low", "node", "n").distinct())
    members = members.unionByName(_by_fingerprint(texts))
    edges = members.select(F.col("low").alias("a"), F.col("node").alias("b"))
    tied = cut(with_lowest(connected_components(edges)))
    size = members.groupBy("node").agg(F.max("n").alias("n")).join(tied, "node")
    whole = size.groupBy("component").agg(F.sum("n").alias("total")).select("component", (F.col("total") <= large).alias("whole"))
    put = with_value(tied, whole)
    alone = put.where("whole").select("node", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("component").alias("at"))
    banded = members.select("band", "node", "n").distinct().join(put.where("NOT whole").select("node"), "node")
    parts = banded.groupBy("band").agg(F.ceil(F.greatest(F.sum("n"), F.lit(1)) / F.lit(max(1, large))).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")).cast("int")
    paired = with_value(banded, parts, key="band").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    apart = paired.select("node", (F.least("mine", "other") + 1).alias("i"), (F.greatest("mine", "other") + 1).alias("j"), F.col("band").alias("at"))
    groups = texts.select("node", "text").join(counted(alone.unionByName(apart)), "node").groupBy("at", "i", "j")
    return with_lowest(connected_components(groups.applyInArrow(_links, "a long, b long").distinct()))


def _by_fingerprint(texts: DataFrame) -> DataFrame:
    """(band, low, node, n) of candidates by the SimHash operator's five-word fingerprints: texts of one fingerprint, and the smallest texts of two linked ones; n is bounded by the bytes of a text."""
    fps = cut(fingerprints(texts, "node", "text", SHINGLE))
    per = cut(fps.groupBy("fp").agg(F.min("node").alias("low"), F.count("*").alias("many")))
    same = with_value(fps, per.where("many > 1").select("fp", "low"), key="fp").select(F.col("low").alias("band"), "low", "node")
    low = lambda side: per.select(F.col("fp").alias(side), F.col("low").alias(f"low_{side}"))
    linked = links(fps).join(low("a"), "a").join(low("b"), "b").select(F.xxhash64("low_a", "low_b").alias("band"), F.col("low_a").alias("low"), F.explode(F.array("low_a", "low_b")).alias("node"))
    found = counted(same.unionByName(linked))
    return cut(texts.select("node", F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 6).alias("n")).join(found, "node").select("band", "low", "node", "n"))
