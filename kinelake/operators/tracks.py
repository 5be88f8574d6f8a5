"""Features of both arms' motion per run that survive a change of viewpoint, and random convolution features of windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinelake.operators.features import EPS, autocorrelation_peak, population_skew, spectrum_peak
from kinelake.operators.pose import aligned, elbow_angle
from kinelake.operators.qc import LEFT_SHOULDER, LEFT_WRIST, RIGHT_SHOULDER, RIGHT_WRIST, joint, norm2
from kinelake.runtime import ship, tidy

ARMS = {"l": (LEFT_SHOULDER, 7, LEFT_WRIST), "r": (RIGHT_SHOULDER, 8, RIGHT_WRIST)}


def arms(frames: DataFrame, by: str = "run") -> DataFrame:
    """(by, t, and for each side x, y, dx, dy, s of the wrist, elbow angle, shoulder middle and width) of frames turned level; steps lead to the frame."""
    level = aligned(frames.withColumnRenamed(by, "run")) if by != "run" else aligned(frames)
    w = W.partitionBy("run").orderBy("t")
    flat = level.select(
        "run", "t", *[joint(wrist)[c].alias(f"{c}_{n}") for n, (_, _, wrist) in ARMS.items() for c in "xy"], *[elbow_angle(*j).alias(f"elbow_{n}") for n, j in ARMS.items()],
        ((joint(LEFT_SHOULDER)["y"] + joint(RIGHT_SHOULDER)["y"]) / 2).alias("mid"), F.abs(joint(RIGHT_SHOULDER)["x"] - joint(LEFT_SHOULDER)["x"]).alias("width"),
    )
    steps = flat.select("*", *[(F.col(f"{c}_{n}") - F.lag(f"{c}_{n}").over(w)).alias(f"d{c}_{n}") for n in ARMS for c in "xy"])
    steps = steps.select("*", *[norm2(F.col(f"dx_{n}"), F.col(f"dy_{n}")).alias(f"s_{n}") for n in ARMS])
    return steps.withColumnRenamed("run", by) if by != "run" else steps


def coordination(steps: DataFrame, by: str = "run") -> DataFrame:
    """(by, corr, vrange_ratio, path_ratio, active_ratio, cv_l, cv_r) of arms(): left against right, aggregates only."""
    whole = W.partitionBy(by)
    some = steps.withColumn("mid_r", F.median("s_r").over(whole))
    flat = (F.stddev_pop("y_l") < EPS) | (F.stddev_pop("y_r") < EPS)
    extent = lambda n: F.max(f"y_{n}") - F.min(f"y_{n}")
    path = lambda n: F.coalesce(F.sum(f"s_{n}"), F.lit(0.0))
    active = F.when(F.col("s_l").isNotNull(), (F.col("s_l") > F.col("mid_r") * (1 + 1e-9) + EPS).cast("double"))
    cv = lambda n: F.coalesce(F.stddev_pop(f"s_{n}") / (F.avg(f"s_{n}") + EPS), F.lit(0.0))
    return some.groupBy(by).agg(
        F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop("y_l", "y_r"), F.stddev_pop("y_l") * F.stddev_pop("y_r"))).alias("corr"),
        (extent("l") / (extent("l") + extent("r") + EPS)).alias("vrange_ratio"), (path("l") / (path("l") + path("r") + EPS)).alias("path_ratio"),
        F.coalesce(F.avg(active), F.lit(0.0)).alias("active_ratio"), cv("l").alias("cv_l"), cv("r").alias("cv_r"),
    )


def phase(left: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """(largest cross-correlation, the lag where it is over the right side's period, at most 1)."""
    a, b = left - left.mean(), right - right.mean()
    n = len(a)
    size = 1 << (2 * n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    by_lag = np.concatenate([full[size - n + 1 :], full[:n]]) / (a.std() * b.std() * n + EPS)
    lag = abs(int(np.argmax(np.round(by_lag, 12))) - (n - 1))
    return float(by_lag.max()), min(lag / (spectrum_peak(right)[1] + EPS), 1.0)


def phases(steps: DataFrame, by: str = "run") -> DataFrame:
    """(by, xcorr, phase_lag, autocorr_l, autocorr_r, spec_l, spec_r) of arms(); a run's two tracks (16 bytes a frame) are in one task's memory."""
    ship(steps.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        left, right = pdf.y_l.to_numpy(), pdf.y_r.to_numpy()
        xcorr, lag = phase(left, right)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "xcorr": [xcorr], "phase_lag": [lag], "autocorr_l": [autocorrelation_peak(left)], "autocorr_r": [autocorrelation_peak(right)], "spec_l": [spectrum_peak(left)[0]], "spec_r": [spectrum_peak(right)[0]]})

    kind = dict(steps.dtypes)[by]
    return steps.select(by, "t", "y_l", "y_r").groupBy(by).applyInPandas(run, f"`{by}` {kind}, xcorr double, phase_lag double, autocorr_l double, autocorr_r double, spec_l double, spec_r double")


#: The twelve features in their order.
ROBUST = ("corr", "xcorr", "phase_lag", "vrange_ratio", "path_ratio", "active_ratio", "autocorr_l", "autocorr_r", "spec_l", "spec_r", "cv_l", "cv_r")


def view_robust(frames: DataFrame, by: str = "run") -> DataFrame:
    """(by, the ROBUST features) of frames(by, t, joints)."""
    steps = arms(frames, by)
    return coordination(steps, by).join(phases(steps, by), by).select(by, *ROBUST)


def rich_motion(frames: DataFrame, by: str = "run") -> DataFrame:
    """(by, and for each side elbow mean and deviation, turn rate, pause share, vertical ratio, speed skew, wrist height in shoulder widths)."""
    w, whole = W.partitionBy(by).orderBy("t"), W.partitionBy(by)
    steps = arms(frames, by)
    steps = steps.select("*", *[f.over(whole).alias(a) for n in ARMS for f, a in ((F.avg(f"s_{n}"), f"mean_{n}"), (F.median(f"s_{n}"), f"median_{n}"))], *[F.lag(f"{c}_{n}").over(w).alias(f"p{c}_{n}") for n in ARMS for c in ("dx", "dy", "s")])

    def side(n: str) -> list[Column]:
        c = lambda x: F.col(f"{x}_{n}")
        fast = (c("s") > 0.25 * (c("mean") + EPS)) & (c("ps") > 0.25 * (c("mean") + EPS))
        turn = F.atan2(F.abs(c("pdx") * c("dy") - c("pdy") * c("dx")), c("pdx") * c("dx") + c("pdy") * c("dy"))
        sx, sy = F.stddev_pop(f"dx_{n}"), F.stddev_pop(f"dy_{n}")
        return [
            F.avg(f"elbow_{n}").alias(f"elbow_mean_{n}"), F.stddev_pop(f"elbow_{n}").alias(f"elbow_std_{n}"), F.coalesce(F.avg(F.when(fast, turn)), F.lit(0.0)).alias(f"turn_{n}"),
            F.when(F.coalesce(F.max(f"median_{n}"), F.lit(0.0)) < EPS, 1.0).otherwise(F.avg((c("s") < 0.2 * c("median")).cast("double"))).alias(f"pause_{n}"),
            F.coalesce(sy / (sx + sy + EPS), F.lit(0.0)).alias(f"vertical_{n}"), F.coalesce(population_skew(f"s_{n}"), F.lit(0.0)).alias(f"skew_{n}"),
            ((F.avg(f"y_{n}") - F.avg("mid")) / (F.avg("width") + EPS)).alias(f"height_{n}"),
        ]

    return steps.groupBy(by).agg(*[c for n in ARMS for c in side(n)])


def track_windows(frames: DataFrame, joints: tuple[int, ...], length: int, stride: int) -> DataFrame:
    """(run, start, x array<array<double>>): the channels x and y of each joint over every window of length frames; a frame belongs to at most length / stride windows."""
    first = F.greatest(F.lit(0), F.ceil((F.col("t") - length + 1) / stride).cast("int"))
    parts = frames.select("run", "t", F.array(*[joint(j)[c] for j in joints for c in "xy"]).alias("v"), F.explode(F.sequence(first, F.floor(F.col("t") / stride).cast("int"))).alias("w"))
    rows = parts.groupBy("run", (F.col("w") * stride).alias("start")).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s")).where(F.size("s") == length)
    return rows.select("run", "start", F.transform(F.sequence(F.lit(0), F.lit(2 * len(joints) - 1)), lambda k: F.transform("s", lambda f: F.get(f["v"], k))).alias("x"))


#: Nine taps, of which three weigh 2 and the others -1: positions of the three in each of the 84 kernels.
HIGH = np.array(list(combinations(range(9), 3)))


def dilations_for(length: int, most: int = 32, least_output: float = 0.5) -> list[int]:
    """Whole powers spread from 1 up to where a kernel still leaves the given share of the length."""
    top = max(1, min((length - 1) // 8, int(length * (1 - least_output)) // 8))
    n = max(1, min(most, int(np.log2(top)) + 1))
    return sorted({max(1, int(2.0**e)) for e in np.linspace(0, np.log2(top), n)})


@dataclass
class Rocket:
    """What transforms windows: dilations, the channels of each kernel, and biases (84, B) per dilation."""

    dilations: list[int]
    channels: np.ndarray
    biases: list[np.ndarray]


def responses(x: np.ndarray, channels: np.ndarray, dilation: int) -> np.ndarray:
    """(84, length - 8 * dilation) responses of one window x (channels, length); a kernel sums its channels."""
    summed = channels @ x
    n = x.shape[1] - 8 * dilation
    taps = np.stack([summed[:, i * dilation : i * dilation + n] for i in range(9)])
    high = taps[HIGH, np.arange(84)[:, None]].sum(1)
    return 3.0 * high - taps.sum(0)


def fit_rocket(windows: DataFrame, n_features: int = 10_000, seed: int = 0, sample: int = 256, keys: tuple[str, ...] = ("run", "start")) -> Rocket:
    """Biases are quantiles of the responses of ``sample`` windows, those with the smallest hashes (the bounded sample of the fit).

    Every kernel has a random subset of the channels, of any size alike. n_features is met to the nearest number of biases per kernel and dilation.
    """
    held = [np.array(r.x) for r in windows.select(F.xxhash64(*keys).alias("h"), *keys, "x").orderBy("h", *keys).limit(sample).collect()]
    if not held:
        raise ValueError("no windows to fit on")
    n_channels, length = held[0].shape
    dilations, random = dilations_for(length), np.random.default_rng(seed)
    order = np.argsort(random.random((84, n_channels)), axis=1)
    channels = (order < random.integers(1, n_channels + 1, (84, 1))).astype(float)
    quantiles = np.linspace(0, 1, max(1, round(n_features / (84 * len(dilations)))) + 2)[1:-1]
    biases = [np.quantile(np.concatenate([responses(x, channels, d) for x in held], axis=1), quantiles, axis=1).T for d in dilations]
    return Rocket(dilations, channels, biases)


def ppv(x: np.ndarray, model: Rocket) -> np.ndarray:
    """Shares of responses above each bias: dilations, then kernels, then biases."""
    out = []
    for d, b in zip(model.dilations, model.biases, strict=True):
        r = np.sort(responses(x, model.channels, d), axis=1)
        above = np.stack([r.shape[1] - np.searchsorted(row, bias, side="right") for row, bias in zip(r, b, strict=True)])
        out.append((above / r.shape[1]).ravel())
    return np.concatenate(out)


def rocket_features(windows: DataFrame, model: Rocket, keys: tuple[str, ...] = ("run", "start"), block: int = 32) -> DataFrame:
    """(keys, ppv array<double>) of every window; windows are rows, so nothing is shuffled. Features are a hundred times the size of their window, so a batch's are made and sent `block` windows at a time."""
    ship(windows.sparkSession)
    shared = windows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), block):
                part = b.iloc[at : at + block]
                yield part[list(keys)].assign(ppv=[ppv(np.array(x.tolist()), shared.value) for x in part.x])

    schema = windows.select(*keys).schema.add("ppv", T.ArrayType(T.DoubleType()))
    return windows.select(*keys, "x").mapInPandas(tidy(run), schema)
