"""Motion features of a run's or window's wrist tracks: native where aggregates suffice, grouped pandas where spectra are needed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinelake.operators.qc import norm2

EPS = 1e-8


def population_skew(x: str) -> Column:
    return F.when(F.stddev_pop(x) < EPS, 0.0).otherwise(F.skewness(x))


def speed_features(track: DataFrame, by: str = "run") -> DataFrame:
    """(by, n, path, cv, skew, pause, turn, height) of track(by, t, x, y); speeds are lengths of one-frame steps."""
    w = W.partitionBy(by).orderBy("t")
    steps = track.select(by, "t", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy"), F.col("y"))
    steps = steps.select("*", norm2(F.col("dx"), F.col("dy")).alias("s"))
    whole = W.partitionBy(by)
    steps = steps.select("*", F.avg("s").over(whole).alias("mean"), F.median("s").over(whole).alias("mid"), *[F.lag(c).over(w).alias(f"p{c}") for c in ("dx", "dy", "s")])
    fast = (F.col("s") > 0.25 * F.col("mean")) & (F.col("ps") > 0.25 * F.col("mean"))
    turn = F.atan2(F.abs(F.col("pdx") * F.col("dy") - F.col("pdy") * F.col("dx")), F.col("pdx") * F.col("dx") + F.col("pdy") * F.col("dy"))
    return steps.groupBy(by).agg(
        F.count("s").alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("path"), (F.stddev_pop("s") / (F.avg("s") + EPS)).alias("cv"), population_skew("s").alias("skew"),
        F.when(F.max("mid") < EPS, 1.0).otherwise(F.avg((F.col("s") < 0.2 * F.col("mid")).cast("double"))).alias("pause"),
        F.coalesce(F.avg(F.when(fast, turn)), F.lit(0.0)).alias("turn"), F.avg("y").alias("height"),
    )


def autocorrelation_peak(x: np.ndarray, min_lag: int = 3) -> float:
    """Largest normalized autocorrelation from min_lag on; 0 for a flat or too short track."""
    x = x - x.mean()
    if x.std() < EPS or len(x) <= min_lag:
        return 0.0
    size = 1 << (2 * len(x) - 1).bit_length()
    power = np.abs(np.fft.rfft(x, size)) ** 2
    acf = np.fft.irfft(power, size)[: len(x)]
    return float(acf[min_lag:].max() / acf[0])


def spectrum_peak(x: np.ndarray) -> tuple[float, float]:
    """(share of power at the peak and its neighbours, period in frames) of a Hann-windowed track, the mean left out. A flat track has no peak and its own length as period; fewer than three frequencies, or hardly any power, give no share."""
    x = x - x.mean()
    power = (np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2)[1:]
    if x.std() < EPS or not len(power):
        return 0.0, float(len(x))
    at = int(np.argmax(power))
    share = power[max(0, at - 1) : at + 2].sum() / power.sum() if len(power) >= 3 and power.sum() >= EPS else 0.0
    return float(share), len(x) / (at + 1)


def spectral_features(track: DataFrame, by: str = "run") -> DataFrame:
    """(by, autocorr, concentration, period) of track(by, t, y)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t").y.to_numpy()
        share, period = spectrum_peak(y)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "autocorr": [autocorrelation_peak(y)], "concentration": [share], "period": [period]})

    kind = dict(track.dtypes)[by]
    return track.groupBy(by).applyInPandas(run, f"{by} {kind}, autocorr double, concentration double, period double")
