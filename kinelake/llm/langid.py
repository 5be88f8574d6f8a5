"""Language identification in two levels: the family first, then linear support vector machines between its languages, one versus one.

Features are counts of character trigrams of the lower-cased text, everything but letters a space, hashed to DIMENSIONS
(trigrams that fall together count together) and taken to square root and unit length. The family has the highest margin
of one-versus-rest machines; within it every pair of languages has a machine, and votes decide (ties: the larger sum of
margins, then the name). All machines are trained here, by dual coordinate descent, each in a task of its own on the
executors, on a bounded sample of labelled rows: at most about PER_LANGUAGE of each language and SAMPLE_ROWS in all (the
languages share alike). The rows are those whose ids have the smallest hashes, one for each id (the smallest text), so the
sample is the same in every run. Sampled vectors are kept as half-precision numbers (11 bits of each component).

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text when there is nothing to learn
from; a null id is never held out nor learned from; languages without a family are a family of their own; rows keep their
multiplicity; only id, text and (for training) language are read; an empty table gives an empty result; more languages than
half of SAMPLE_ROWS raise ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.runtime import ship, tidy

DIMENSIONS, UNKNOWN = 4096, "und"
#: Labelled rows that the machines learn from: of a language, and in all (8 KB each).
PER_LANGUAGE, SAMPLE_ROWS = 600, 10_000
#: Families of common languages; others stand alone.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def vector(text: str | None) -> np.ndarray | None:
    """Unit feature vector of a whole text; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _letters()[points]
    if not kept.any():
        return None
    a = np.concatenate(([32], np.where(kept, points, 32), [32])).astype(np.uint32)
    a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]  # runs of spaces count once
    h = (a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    x = np.sqrt(np.bincount(h >> np.uint32(20), minlength=DIMENSIONS).astype(np.float32))
    return x / np.linalg.norm(x)


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 30) -> np.ndarray:
    """Weights, the bias last, of the linear machine with hinge loss; y is +1 or -1."""
    n = len(x)
    x = np.column_stack([x, np.ones(n, np.float32)]).astype(np.float32)
    # classes of unequal size weigh alike
    limit = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum()))) * cost
    w, alpha, square, random = np.zeros(x.shape[1]), np.zeros(n), np.einsum("ij,ij->i", x, x).astype(float), np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(n):
            step = (1 - y[i] * (w @ x[i])) / square[i]
            now = min(max(alpha[i] + step, 0.0), limit[i])
            if now != alpha[i]:
                w += (now - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(now - alpha[i]))
                alpha[i] = now
        if moved < 1e-3:
            break
    return w


def _machine(x: np.ndarray, names: np.ndarray, family: np.ndarray, a: str, b: str | None) -> np.ndarray:
    """Family a against the rest (b is None), or language a against b."""
    if b is None:
        return train_svm(x, np.where(family == a, 1, -1))
    rows = (names == a) | (names == b)
    return train_svm(x[rows], np.where(names[rows] == a, 1, -1))


def fit(x: np.ndarray, langs: list[str], spark: SparkSession) -> dict:
    """The two levels of machines from rows of features (half precision) and their languages; each machine is a task."""
    family = [_FAMILY.get(n, n) for n in langs]
    families = sorted(set(family))
    members = {f: sorted({n for n, g in zip(langs, family, strict=True) if g == f}) for f in families}
    wanted = [(f, None) for f in families] if len(families) > 1 else []
    wanted += [pair for m in members.values() for pair in combinations(m, 2)]
    model = {"families": families, "members": members, "top": np.zeros((0, DIMENSIONS + 1)), "pairs": {}}
    if not wanted:
        return model
    shared = spark.sparkContext.broadcast((x.astype(np.float16), langs, family))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is None:
                half, langs, family = shared.value
                held = half.astype(np.float32), np.array(langs, dtype=object), np.array(family, dtype=object)
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b], pa.string()), pa.array([_machine(*held, a, b).astype(np.float32).tobytes()], pa.binary())], names=["a", "b", "w"])

    machines = spark.createDataFrame(wanted, "a string, b string").repartition(min(len(wanted), 2000))
    found = {(r.a, r.b): np.frombuffer(bytes(r.w), np.float32) for r in machines.mapInArrow(tidy(run), "a string, b string, w binary").collect()}
    shared.destroy()
    if len(families) > 1:
        model["top"] = np.stack([found[f, None] for f in families])
    model["pairs"] = {k: w for k, w in found.items() if k[1] is not None}
    return model


def decide(members: list[str], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
    """(language, its least margin) of the duels' margins, above 0 for the first: most votes, then the larger sum of margins, then the name."""
    votes, sums, least = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0), dict.fromkeys(members, math.inf)
    for (a, b), m in margins.items():
        votes[a if m >= 0 else b] += 1
        for lang, s in ((a, m), (b, -m)):
            sums[lang] += s
            least[lang] = min(least[lang], s)
    lang = min(members, key=lambda n: (-votes[n], -sums[n], n))
    return lang, least[lang]


def predict(model: dict, x: np.ndarray | None) -> tuple[str, float]:
    """(language, score): score is the product of the logistic margins of the family and of the weakest duel of the language."""
    if x is None or not model["families"]:
        return UNKNOWN, 0.0
    logistic = lambda m: 1 / (1 + math.exp(-max(-30.0, min(30.0, 4 * m))))
    family, score, top = model["families"][0], 1.0, model["top"]
    if len(top):
        margin = top[:, :-1] @ x + top[:, -1]
        best, second = np.argsort(-margin, kind="stable")[:2]
        family, score = model["families"][best], logistic(float(margin[best] - margin[second]) / 2)
    members = model["members"][family]
    duels = {(a, b): float((w := model["pairs"][a, b])[:-1] @ x + w[-1]) for a, b in combinations(members, 2)}
    lang, least = decide(members, duels)
    return lang, score * (logistic(least) if len(members) > 1 else 1.0)


def held_out(id_col: Column) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> dict:
    """A model from the rows that aren't held out and have a language; vectors, not texts, come to the driver, SAMPLE_ROWS of them on average at most (80 MB)."""
    ship(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = known.groupBy("lang").count().limit(SAMPLE_ROWS).collect()
    if not counts:
        return fit(np.zeros((0, DIMENSIONS), np.float16), [], docs.sparkSession)
    if 2 * len(counts) > SAMPLE_ROWS:
        raise ValueError("too many languages for the sample")
    ring, share = 1 << 30, min(per_language, SAMPLE_ROWS // len(counts))
    bounds = docs.sparkSession.createDataFrame([(r.lang, int(ring * min(1.0, share / r["count"]))) for r in counts], "lang string, bound long")
    chosen = known.join(F.broadcast(bounds), "lang").where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(ring)) < F.col("bound")).select("id", "text", "lang")
    # an id counts once for a language, so that one with a third of all rows can't fill the driver
    sample = chosen.groupBy("id", "lang").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(lang, x.astype(np.float16).tobytes()) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (x := vector(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], names=["lang", "x"])

    rows = sorted(sample.select("text", "lang").mapInArrow(tidy(run), "lang string, x binary").collect(), key=lambda r: (r.lang, bytes(r.x)))
    x = np.array([np.frombuffer(bytes(r.x), np.float16) for r in rows], np.float16).reshape(len(rows), DIMENSIONS)
    return fit(x, [r.lang for r in rows], docs.sparkSession)


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, text or other columns in keep, lang_pred, score) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [id_col, *[c for c in keep if c != id_col]]
    at = columns.index(text_col) if text_col in columns else len(columns)
    source = docs.select(*columns, *([] if text_col in columns else [text_col]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [predict(shared.value, vector(t.as_py())) for t in b.column(at)]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(columns))], *made], names=[*columns, "lang_pred", "score"])

    schema = source.select(*columns).schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(tidy(run), schema)


def op10_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
