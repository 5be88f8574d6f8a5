"""Whitening of embeddings with exact covariances: digit-slice matrix products, then an eigendecomposition.

A vector becomes whole numbers x = floor(64 c) + 1000000. The fit list is each distinct x once: n vectors with sums S. What
is multiplied is the centred z = n x - S, whole as well, and z'z is computed exactly: z is split into limbs of LIMB_BITS
bits, z = sum over i of limb_i 2^(LIMB_BITS i), and the product of two limb matrices of BLOCK rows stays below 2^53, so
float64 BLAS gives it exactly. Products of equal order i + j are added as 64-bit numbers within a task, merged as decimals by
Spark, and recombined as big integers: sum of z'z = n^3 V, V being x's covariance with divisor n. V's quotients are rounded
once, and its eigenvectors are the components. One aggregate over the fit list gives n and S, one the products, one the
covariance of the whitened fit list, centred before multiplying too; only matrices of a width's square come to the driver.

Defined results: vectors that are null or hold null or non-finite entries go, whatever their id; a null id stays, as do repeated rows
(a row each, with equal values); the widest vector sets the width, shorter ones count as filled up with zeros, an empty one
as all zeros; fewer than `top` dimensions give as many components; components whose variance is below RANK of V's trace
have no direction of their own and are left out (so a single distinct vector, or an empty table, gives no rows);
identity_error is over the components that are left. Entries beyond 2^46 raise an error, as do more than 2^40 distinct
vectors (decimals of 38 digits hold sums below that). deviation is exact, as a decimal of 38 digits (null beyond). Only the id and vector
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructType

from kinelake.runtime import cut, ship, tidy

SCALE, SHIFT, TOP = 64, 1_000_000, 16
#: BLOCK rows of products of two limbs sum to less than 2^53.
LIMB_BITS, BLOCK = 20, 4096
#: Share of the trace under which a variance is rounding alone.
RANK = 1e-12
_WHOLE = DecimalType(38, 0)


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x array<long>) of the rows that take part, all of one width."""
    v = F.col(vector_col)
    fine = rows.where(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))).select(F.col(id_col).alias("id"), v.alias("v"))
    widest = fine.agg(F.max(F.size("v"))).first()[0] or 0
    moved = F.transform("v", lambda c: (F.floor(c.cast("double") * scale) + shift).cast("long"))
    checked = F.when(F.forall("v", lambda c: F.abs(c.cast("double") * scale) < float(1 << 46)), moved).otherwise(F.raise_error(F.lit("an entry is too long for exact products")).cast("array<bigint>"))
    filled = F.concat(checked, F.array_repeat(F.lit(shift).cast("long"), F.lit(widest) - F.size("v")))
    return fine.select("id", F.when(F.size("v") == widest, checked).otherwise(filled).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all lists of one length, as a matrix."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def limbs(z: np.ndarray, bits: int = LIMB_BITS) -> list[np.ndarray]:
    """float64 matrices with z = sum of limb_i 2^(bits i), each within +-2^(bits - 1); z is int64 or whole Python numbers."""
    found, half, full = [], 1 << (bits - 1), 1 << bits
    while True:
        low = ((z + half) % full) - half
        found.append(low.astype(float))
        z = (z - low) // full
        if not z.any():
            return found


def products(z: np.ndarray, bits: int = LIMB_BITS, block: int = BLOCK) -> dict[int, np.ndarray]:
    """Exact sums of limb products by order: z'z = sum over k of result[k] 2^(bits k)."""
    total: dict[int, np.ndarray] = {}
    for at in range(0, len(z), block):
        parts = limbs(z[at : at + block], bits)
        for i, a in enumerate(parts):
            for j, b in enumerate(parts[: i + 1]):
                made = (a.T @ b).astype(np.int64)
                made = made if i == j else made + made.T
                total[i + j] = total[i + j] + made if i + j in total else made
    return total


def recombined(total: dict[int, np.ndarray], bits: int = LIMB_BITS) -> np.ndarray:
    """The orders' sums as one matrix of Python's whole numbers."""
    return sum(made.astype(object) << (bits * k) for k, made in total.items())


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exact: int64 where it fits, whole Python numbers else."""
    fits = n * int(np.abs(x).max(initial=0)) < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62
    return n * x - np.array(sums, np.int64) if fits else n * x.astype(object) - np.array(sums, object)


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


def size_and_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """n and the sums of fit(x) by dimension; a row of each task for each dimension is merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for b in batches:
            x = matrix(b.column(0))
            high, low = (x >> 24).sum(0).astype(object), (x & (1 << 24) - 1).sum(0).astype(object)
            n, sums = n + len(x), (high << 24) + low + (0 if sums is None else sums)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), _decimals([n, *sums])], names=["i", "v"])

    schema = StructType().add("i", "integer").add("v", _WHOLE)
    found = {r.i: int(r.v) for r in fit.mapInArrow(tidy(run), schema).groupBy("i").agg(F.sum("v").alias("v")).collect()}
    return found.get(-1, 0), [found[i] for i in range(len(found) - 1)]


def gram(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The exact matrix of z'z over fit(x), z = n x - sums."""

    def packed(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, made in total.items():
            rows, columns = np.tril_indices(len(made))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), pa.array(rows.astype(np.int32)), pa.array(columns.astype(np.int32)), _decimals(made[rows, columns].tolist())], names=["k", "i", "j", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        blocks = 0
        for b in batches:
            for at in range(0, len(b), BLOCK):
                for k, made in products(centred(matrix(b.column(0).slice(at, BLOCK)), n, sums)).items():
                    total[k] = total[k] + made if k in total else made
                blocks += 1
                if blocks % 64 == 0:  # 64 products of 2^53, a few of each order, are within 63 bits
                    yield from packed(total)
                    total = {}
        yield from packed(total)

    schema = StructType().add("k", "integer").add("i", "integer").add("j", "integer").add("v", _WHOLE)
    total: dict[int, np.ndarray] = {}
    for r in fit.mapInArrow(tidy(run), schema).groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
        made = total.setdefault(r.k, np.zeros((len(sums), len(sums)), object))
        made[r.i, r.j] = made[r.j, r.i] = int(r.v)
    return recombined(total)


def components(product: np.ndarray, n: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, a column each; their variances; their shares of the trace) from the exact matrix n^3 V."""
    cube = n**3
    covariance = np.array([[v / cube for v in row] for row in product], float)  # whole numbers divide with one rounding
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:top]
    trace = sum(int(product[i, i]) for i in range(len(product))) / cube
    order = order[values[order] > RANK * trace] if trace else order[:0]
    directions = vectors[:, order]
    biggest = np.abs(directions).argmax(0) if len(order) else np.zeros(0, int)
    directions = directions * np.sign(directions[biggest, np.arange(len(order))])
    return directions, values[order], values[order] / trace if trace else values[order]


def whitened(x: np.ndarray, model: dict) -> np.ndarray:
    """x - S/n on each component, over the root of its variance."""
    return (centred(x, model["n"], model["sums"]).astype(float) / model["n"]) @ (model["directions"] / np.sqrt(model["values"]))


def identity_error(fit: DataFrame, model: dict) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    width = len(model["values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros(width), np.zeros((width, width))
        for b in batches:
            w = whitened(matrix(b.column(0)), model)
            sums, squares = sums + w.sum(0), squares + w.T @ w
        i, j = np.tril_indices(width)
        rows, columns, values = np.append(i, np.full(width, -1)), np.append(j, np.arange(width)), np.append(squares[i, j], sums)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(columns.astype(np.int32)), pa.array(values)], names=["i", "j", "v"])

    found = {(r.i, r.j): r.v for r in fit.mapInArrow(tidy(run), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    n = model["n"]
    # the mean is 0 but for rounding, as z is centred; what is left of it is taken off
    return max(abs(v / n - found[-1, i] / n * (found[-1, j] / n) - (i == j)) for (i, j), v in found.items() if i >= 0)


def fit_whitening(vectors: DataFrame, top: int = TOP) -> dict:
    """The model of vectors(x): n, sums, directions, values, explained, identity_error."""
    ship(vectors.sparkSession)
    fit = cut(vectors.select("x").distinct())
    n, sums = size_and_sums(fit)
    if n > 1 << 40:
        raise ValueError("too many distinct vectors for exact sums of 38 digits")
    if not n or not sums:
        return {"n": n, "sums": sums, "directions": np.zeros((0, 0)), "values": np.zeros(0), "explained": np.zeros(0), "identity_error": 0.0}
    directions, values, explained = components(gram(fit, n, sums), n, top)
    model = {"n": n, "sums": sums, "directions": directions, "values": values, "explained": explained}
    return model | {"identity_error": identity_error(fit, model) if len(values) else 0.0}


def whiten(vectors: DataFrame, model: dict) -> DataFrame:
    """(id, component, n, deviation decimal, whitened, explained, identity_error): a row for each of vectors(id, x) and component."""
    ship(vectors.sparkSession)
    shared, width = vectors.sparkSession.sparkContext.broadcast(model), len(model["values"])
    id_type = vectors.schema["id"].dataType
    schema = StructType().add("id", id_type).add("component", "integer").add("n", "long").add("deviation", _WHOLE).add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            x = matrix(b.column(1))
            z = centred(x, model["n"], model["sums"])
            if z.dtype != object and x.shape[1] * float(np.abs(z).max(initial=0)) ** 2 >= 2.0**62:
                z = z.astype(object)
            deviation = (z * z).sum(1).tolist()
            each = np.repeat(np.arange(len(x)), width)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model["n"], np.int64)),
                    _decimals(deviation).take(pa.array(each)),
                    pa.array(whitened(x, model).reshape(-1)),
                    pa.array(np.tile(model["explained"], len(x))),
                    pa.array(np.full(len(each), model["identity_error"])),
                ],
                names=schema.names,
            )

    return vectors.select("id", "x").mapInArrow(tidy(run), schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """A deviation beyond 63 bits (about 10^8 distinct vectors) is null here; whiten() has it in full."""
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    found = whiten(vectors, fit_whitening(vectors)).withColumnRenamed("id", "vec_id")
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
