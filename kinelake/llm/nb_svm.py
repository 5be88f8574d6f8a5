"""Text quality by a support vector machine over n-grams that are scaled by their naive Bayes log-count ratios.

A text's features are the indicators of its n-grams: 1 to 3 code points; 1 and 2 words; and 1 to 3 word shapes (length up
to 8, case and kind of the first code point, a last code point that is no letter or digit, whether the word is the one
before it). Each is hashed to one of FEATURES numbers; n-grams that fall together are one. Over all labelled rows feature
f has the log-count ratio r(f) = log((p(f) / sum p) / (q(f) / sum q)), p and q being 1 plus the numbers of rows of label 1
and 0 that have it. A row's vector holds r(f) where it has f and 0 elsewhere, at unit length, and a linear machine with
hinge loss is fitted to such vectors by dual coordinate descent. Its margin becomes a probability by a logistic curve,
fitted to margins of FOLDS machines on rows they haven't seen, weighted so that labels have their shares of all rows.

The ratios count every labelled row, in one shuffle of the texts by id and one aggregate of FEATURES keys. The machines fit
on a bounded sample, about PER_LABEL rows of each label (those whose ids have the smallest hashes; 8 KB a row at most, half
of that as a rule), each machine in a task of its own.

Defined results: a null or empty text has no features, its margin is the bias; an id counts once, with its smallest text
and one label, and ids with contradicting labels teach nothing; null ids and labels other than 0 and 1 teach nothing, and
null ids are never held out; with only one label, or none, every score is (rows of label 1 + 1) / (rows + 2); repeated rows
stay; only the id, text and label columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.runtime import cut, ship, tidy

BITS = 16
FEATURES = 1 << BITS
#: Features whose counts share a row, and the columns of those rows.
BLOCK, SUMS = 1024, ["block", "ones", "zeros", "y", "x"]
#: Rows of each label that the machines learn from.
PER_LABEL, FOLDS = 3000, 3
THRESHOLD = 0.3

_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_kinds: list[np.ndarray] = []


def _kind() -> np.ndarray:
    """Of each code point: 0 white space, 1 lower case, 2 other letters, 3 digit, 4 anything else."""
    if not _kinds:
        one = lambda c: 0 if c.isspace() else 1 if c.islower() else 2 if c.isalpha() else 3 if c.isdigit() else 4
        _kinds.append(np.fromiter((one(chr(c)) for c in range(0x110000)), np.uint8, 0x110000))
    return _kinds[0]


def _grams(units: np.ndarray, most: int, family: int) -> list[np.ndarray]:
    """Features of every 1 to most units in a row; families of n-grams hash apart."""
    found, h = [], (units + np.uint32(family + 1)) * _A
    for n in range(1, min(most, len(units)) + 1):
        if n > 1:
            h = ((h[:-1] ^ h[:-1] >> np.uint32(15)) + units[n - 1 :]) * _B
        found.append((h >> np.uint32(32 - BITS)).astype(np.uint16))
    return found


def features(text: str | None) -> np.ndarray:
    """The sorted features of a whole text."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = _grams(points, 3, 0)
    kind = _kind()[points]
    inside = np.zeros(len(points) + 2, bool)
    np.not_equal(kind, 0, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(starts):
        # a word's hash is the sum of its code points times powers of an odd number, from its start
        length, origin = ends - starts, starts[0]
        at = np.arange(origin, len(points)) - np.repeat(starts, np.diff(starts, append=len(points)))
        powers = np.cumprod(np.full(int(at.max()) + 1, _B, np.uint32), dtype=np.uint32)
        mixed = (points[origin:] + np.uint32(1)) * _A
        mixed = (mixed ^ mixed >> np.uint32(16)) * powers[at] * inside[origin + 1 : -1]
        words = np.add.reduceat(mixed, starts - origin, dtype=np.uint32)
        tail = points[ends - 1] * (kind[ends - 1] == 4)
        same = np.zeros(len(words), bool)
        np.logical_and(words[1:] == words[:-1], length[1:] == length[:-1], out=same[1:])
        shapes = np.minimum(length, 8) + 16 * kind[starts] + 128 * same + 256 * tail
        found += _grams(words, 2, 1) + _grams(shapes.astype(np.uint32), 3, 2)
    every = np.concatenate(found)
    every.sort(kind="stable")
    return every[np.append(True, every[1:] != every[:-1])].astype(np.int64)


def log_count_ratios(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Of every feature, from the numbers of rows of label 1 and of label 0 that have it."""
    p, q = ones + 1.0, zeros + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def scaled(rows: list[np.ndarray], ratios: np.ndarray) -> list[np.ndarray]:
    """The rows' values, at unit length (zero where all ratios are)."""
    made = []
    for x in rows:
        v = ratios[x]
        length = math.sqrt(float(v @ v))
        made.append(v / length if length else v)
    return made


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 40, tolerance: float = 1e-3) -> np.ndarray:
    """Weights, the bias last, of the linear hinge-loss machine; y is +1 or -1; both labels weigh alike.

    Each step maximizes the dual in one row's multiplier; it ends when an epoch moves none by more than tolerance.
    """
    n, positive = len(rows), int((y > 0).sum())
    limit = np.where(y > 0, n / (2 * max(1, positive)), n / (2 * max(1, n - positive))) * cost
    w, bias, alpha, random = np.zeros(FEATURES), 0.0, np.zeros(n), np.random.default_rng(7)
    square = [float(v @ v) + 1.0 for v in values]
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(n).tolist():
            x, v, s = rows[i], values[i], float(y[i])
            now = min(max(alpha[i] + (1.0 - s * (float(w[x] @ v) + bias)) / square[i], 0.0), limit[i])
            step = now - alpha[i]
            if step:
                w[x] += step * s * v
                bias += step * s
                alpha[i] = now
                moved = max(moved, abs(step))
        if moved < tolerance:
            break
    return np.append(w, bias)


def logistic_curve(margins: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a m + b))) of label 1: Newton's method, targets drawn in by one row each (so separable margins have an end)."""
    ones, zeros = weights[y > 0].sum(), weights[y <= 0].sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    at = np.array([1.0, math.log((ones + 1) / (zeros + 1))])
    x = np.column_stack([margins, np.ones(len(margins))])

    def loss(to: np.ndarray) -> float:
        z = x @ to
        return float((weights * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        gradient = x.T @ (weights * (p - target))
        hessian = (x * (weights * np.maximum(p * (1 - p), 1e-12))[:, None]).T @ x + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(at[0], 0.0)), float(at[1])


def _packed(x: np.ndarray) -> bytes:
    """Features as 2 bytes each or, where that takes more, as FEATURES bits."""
    if 2 * len(x) < FEATURES // 8:
        return x.astype(np.uint16).tobytes()
    return np.packbits(np.bincount(x, minlength=FEATURES).astype(bool)).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint16).astype(np.int64) if len(b) < FEATURES // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8)))


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, y, text) of the rows to learn from, an id once."""
    learns = F.col("id").isNotNull() & ~held_out(F.col("id"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(learns & F.col("y").isin(0, 1))
    marks = marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").select("id", "y")
    # grouped first: an id with a third of all rows leaves each task as one row, and the join reuses the grouping
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(learns).groupBy("id").agg(F.min("text").alias("text"))
    return texts.join(marks, "id").select("id", "y", "text")


def counts_and_sample(texts: DataFrame, chosen: Column) -> DataFrame:
    """In one pass over texts(id, y, text): (block, ones, zeros), each task's counts of BLOCK features in a row, and (y, x), packed features, of the chosen rows."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES), np.int32)
        for b in batches:
            sampled: list[tuple[int, bytes]] = []
            for y, text, kept in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                x = features(text.as_py())
                counts[y, x] += 1
                if kept:
                    sampled.append((y, _packed(x)))
            none = pa.nulls(len(sampled), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(sampled), pa.int32()), none, none, pa.array([y for y, _ in sampled], pa.int32()), pa.array([x for _, x in sampled], pa.binary())], names=SUMS)
        blocks = [i for i in range(FEATURES // BLOCK) if counts[:, i * BLOCK : (i + 1) * BLOCK].any()]
        lists = [pa.array([counts[y, i * BLOCK : (i + 1) * BLOCK] for i in blocks], pa.list_(pa.int32())) for y in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *lists, pa.nulls(len(blocks), pa.int32()), pa.nulls(len(blocks), pa.binary())], names=SUMS)

    return texts.select("y", "text", chosen.alias("kept")).mapInArrow(tidy(run), "block int, ones array<int>, zeros array<int>, y int, x binary")


def feature_counts(passed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of label 1 and of label 0 that have each feature, over all tasks; FEATURES rows at most come to the driver."""
    each = passed.where("block IS NOT NULL").select("block", F.posexplode(F.arrays_zip("ones", "zeros")).alias("at", "n"))
    rows = each.groupBy("block", "at").agg(F.sum("n.ones").alias("ones"), F.sum("n.zeros").alias("zeros")).collect()
    ones, zeros = np.zeros(FEATURES), np.zeros(FEATURES)
    for r in rows:
        ones[r.block * BLOCK + r.at], zeros[r.block * BLOCK + r.at] = r.ones, r.zeros
    return ones, zeros


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> dict:
    """A model of the label, from the rows of docs that labels mark and that aren't held out."""
    spark = docs.sparkSession
    counts = {r.y: r["count"] for r in labelled_texts(docs, labels, id_col, id_col, label_col).groupBy("y").count().collect()}  # ids alone
    if len(counts) < 2:
        return {"prior": (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)}
    ring = 1 << 30
    bound = F.when(F.col("y") == 1, int(ring * min(1.0, per_label / counts[1]))).otherwise(int(ring * min(1.0, per_label / counts[0])))
    passed = cut(counts_and_sample(labelled_texts(docs, labels, id_col, text_col, label_col), F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(ring)) < bound))
    ratios = log_count_ratios(*feature_counts(passed))
    sample = sorted((r.y, bytes(r.x)) for r in passed.where("x IS NOT NULL").select("y", "x").collect())
    if len({y for y, _ in sample}) < 2:
        return {"prior": (counts[1] + 1) / (counts[0] + counts[1] + 2)}
    shared = spark.sparkContext.broadcast((sample, ratios))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fold in b.column(0).to_pylist():
                held, r = shared.value
                rows, y = [_unpacked(x) for _, x in held], np.array([2 * y - 1 for y, _ in held])
                values, fold_of = scaled(rows, r), np.arange(len(rows)) % FOLDS
                mine = np.flatnonzero(fold_of != fold)
                w = dual_coordinate_descent([rows[i] for i in mine], [values[i] for i in mine], y[mine])
                rest = np.flatnonzero(fold_of == fold)
                margins = np.array([float(w[:-1][rows[i]] @ values[i]) + w[-1] for i in rest])
                yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([w.tobytes()], pa.binary()), pa.array([margins.tobytes()], pa.binary())], names=["fold", "w", "margins"])

    machines = spark.createDataFrame([(i,) for i in range(FOLDS + 1)], "fold int").repartition(FOLDS + 1)  # the last leaves no row out
    found = {r.fold: (np.frombuffer(bytes(r.w)), np.frombuffer(bytes(r.margins))) for r in machines.mapInArrow(tidy(fit), "fold int, w binary, margins binary").collect()}
    shared.destroy()
    y, margins = np.array([y for y, _ in sample]), np.zeros(len(sample))
    for fold in range(FOLDS):
        margins[np.arange(len(sample)) % FOLDS == fold] = found[fold][1]
    drawn = np.bincount(y, minlength=2)
    a, b = logistic_curve(margins, y, np.where(y == 1, counts[1] / drawn[1], counts[0] / drawn[0]))
    return {"ratios": ratios, "weights": found[FOLDS][0], "curve": (a, b)}


def margin(model: dict, x: np.ndarray) -> float:
    r = model["ratios"][x]
    length = math.sqrt(float(r @ r))
    return (float(model["weights"][:-1][x] @ r) / length if length else 0.0) + float(model["weights"][-1])


def probability(model: dict, text: str | None) -> float:
    """Of label 1."""
    if "prior" in model:
        return model["prior"]
    a, b = model["curve"]
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, a * margin(model, features(text)) + b))))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([probability(shared.value, t.as_py()) for t in b.column(1)], pa.float64())], names=[id_col, "score"])

    return source.mapInArrow(tidy(run), source.select(id_col).schema.add("score", "double"))


def op11_nb_svm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
