"""Tumbling summaries and the three rhythm analyses on sliding windows."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("patient_id", "signal_type")


def tumbling(samples: DataFrame, seconds: int = 60, expected: int = 60) -> DataFrame:
    """``(patient_id, signal_type, window, window_start, n, median, sd, completeness)`` of each base window.

    Exact median; the sample deviation, 0 for one sample; completeness is n of the expected samples, at most 1.
    """
    share = F.least(F.lit(1.0), F.count("*") / F.lit(float(expected))) if expected > 0 else F.lit(0.0)
    rows = samples.groupBy(*KEY, F.window("timestamp", f"{seconds} seconds").alias("window"))
    out = rows.agg(F.count("*").alias("n"), F.median("value").alias("median"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"), share.alias("completeness"))
    return out.select(*KEY, "window", F.col("window.start").alias("window_start"), "n", "median", "sd", "completeness")


def cosinor_fit(t: Column, y: Column, period: float = 24.0) -> dict[str, Column]:
    """Mergeable aggregates for least squares of y = M + A cos(2 pi t / period + phase)."""
    theta = t * (2 * math.pi / period)
    c, s = F.cos(theta), F.sin(theta)
    cc, ss, cs = F.covar_pop(c, c), F.covar_pop(s, s), F.covar_pop(c, s)
    cy, sy, yy = F.covar_pop(c, y), F.covar_pop(s, y), F.covar_pop(y, y)
    return {"cc": cc, "ss": ss, "cs": cs, "cy": cy, "sy": sy, "yy": yy, "mc": F.avg(c), "ms": F.avg(s), "my": F.avg(y), "n": F.count("*")}


def cosinor(points: DataFrame, by: list[str | Column], t: Column, y: Column) -> DataFrame:
    """``by``, n, mesor, amplitude, acrophase, r2. A flat series has a null r2; singular ones have nulls throughout."""
    sums = points.groupBy(*by).agg(*[x.alias(k) for k, x in cosinor_fit(t, y).items()])
    det = F.nullif(F.expr("cc * ss - cs * cs"), F.lit(0.0))
    sums = sums.withColumn("b1", F.expr("cy * ss - sy * cs") / det).withColumn("b2", F.expr("sy * cc - cy * cs") / det)
    left = [c for c in sums.columns if c not in ("cc", "ss", "cs", "cy", "sy", "yy", "mc", "ms", "my", "n", "b1", "b2")]
    return sums.select(*left, "n", F.expr("my - b1 * mc - b2 * ms").alias("mesor"), F.hypot("b1", "b2").alias("amplitude"), F.atan2(-F.col("b2"), F.col("b1")).alias("acrophase"), F.expr("(b1 * cy + b2 * sy) / nullif(yy, 0)").alias("r2"))


def cosinor_metrics(base: DataFrame, hours: int = 24, hop_hours: int = 1, bins_per_day: int = 1440, coverage: float = 0.5) -> DataFrame:
    """``(patient_id, signal_type, window_end, n, mesor, amplitude, acrophase, r2)`` of each sliding window with enough points."""
    slid = base.where(~F.isnan("median")).withColumn("slide", F.window("window", f"{hours} hours", f"{hop_hours} hours"))
    t = F.unix_millis("window_start") / F.lit(3.6e6)
    fit = cosinor(slid, [*KEY, "slide"], t, F.col("median"))
    least = max(3.0, coverage * hours * bins_per_day / 24)
    return fit.where(F.col("n") >= least).select(*KEY, F.col("slide.end").alias("window_end"), "n", "mesor", "amplitude", "acrophase", "r2")


def filled_windows(base: DataFrame, days: int = 5, hop: str = "1 day", seconds: int = 3600, coverage: float = 0.7) -> DataFrame:
    """``(patient_id, signal_type, window_end, i, x)``: each long window's grid, gaps filled with the mean of what is there."""
    n = days * 86_400 // seconds
    at = ((F.unix_seconds("window_start") - F.unix_seconds("slide.start")) / seconds).cast("int")
    slid = base.where(~F.isnan("median")).withColumn("slide", F.window("window", f"{days} days", hop)).groupBy(*KEY, "slide")
    have = slid.agg(F.count("*").alias("present"), F.avg("median").alias("mean"), F.map_from_entries(F.collect_list(F.struct(at.alias("i"), "median"))).alias("points")).where(F.col("present") >= coverage * n)
    grid = have.select(*KEY, F.col("slide.end").alias("window_end"), "mean", "points", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    return grid.select(*KEY, "window_end", "i", F.coalesce(F.try_element_at("points", F.col("i")), F.col("mean")).alias("x"))


def stability(filled: DataFrame, bins_per_day: int, by: tuple[str, ...] = (*KEY, "window_end")) -> DataFrame:
    """``by``, is_stability, iv_variab of complete grids: two levels of sums, and differences of neighbours. No spread: null and 0."""
    from pyspark.sql import Window

    step = F.col("x") - F.lag("x").over(Window.partitionBy(*by).orderBy("i"))
    rows = filled.withColumn("step", step).withColumn("bin", F.col("i") % bins_per_day)
    bins = rows.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum(F.col("step") * F.col("step")).alias("d"))
    total = bins.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("d").alias("d"), F.sum(F.col("s") / F.col("n")).alias("m1"), F.sum((F.col("s") / F.col("n")) ** 2).alias("m2"), F.count("*").alias("p"))
    spread = F.expr("q - s * s / n")
    flat = spread <= 1e-12 * F.greatest(F.lit(1e-300), F.col("q"))
    between = F.expr("m2 - 2 * m1 * s / n + p * (s / n) * (s / n)")
    return total.select(*by, F.when(~flat, F.col("n") * between / (F.lit(bins_per_day) * spread)).alias("is_stability"), F.when(flat, 0.0).otherwise(F.col("n") * F.col("d") / ((F.col("n") - 1) * spread)).alias("iv_variab"))


# -- wavelet: a Morlet bank in the frequency domain


@lru_cache(maxsize=32)
def bank(n: int, dt: float, omega0: float, low: float, high: float, voices: int) -> tuple[np.ndarray, np.ndarray]:
    """(periods, response of each scale at each frequency bin)."""
    k = np.arange(n)
    omega = 2 * np.pi * np.where(k <= n / 2, k, k - n) / (n * dt)
    periods = low * 2.0 ** (np.arange(math.floor(voices * math.log2(high / low)) + 1) / voices)
    scale = periods[:, None] * (omega0 + math.sqrt(2 + omega0**2)) / (4 * math.pi)
    gauss = np.exp(-0.5 * (scale * omega[None, :] - omega0) ** 2)
    return periods, np.where(omega > 0, np.sqrt(2 * np.pi * scale / dt) * np.pi**-0.25 * gauss, 0.0)


@lru_cache(maxsize=32)
def band_weights(n: int, dt: float, omega0: float, low: float, high: float, voices: int, band_low: float, band_high: float) -> tuple[np.ndarray, np.ndarray]:
    """(total, in-band) sums of squared responses at each bin."""
    periods, psi = bank(n, dt, omega0, low, high, voices)
    inside = (periods >= band_low) & (periods <= band_high)
    return (psi**2).sum(axis=0), (psi[inside] ** 2).sum(axis=0)


def band_index(x: np.ndarray, dt: float, omega0: float = 6.0, low: float = 0.5, high: float = 48.0, voices: int = 8, band: tuple[float, float] = (20.0, 28.0)) -> float:
    """The in-band share of wavelet power by one transform (Parseval); 0 without power."""
    power = np.abs(np.fft.fft(x - x.mean())) ** 2
    total, inside = band_weights(len(x), dt, omega0, low, high, voices, *band)
    whole = float(power @ total)
    return float(power @ inside) / whole if whole > 1e-20 * max(1.0, float(x @ x)) else 0.0


def scalogram(x: np.ndarray, dt: float, omega0: float = 6.0, low: float = 0.5, high: float = 48.0, voices: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(periods, power of each scale at each time); circular, of the demeaned series."""
    periods, psi = bank(len(x), dt, omega0, low, high, voices)
    return periods, np.abs(np.fft.ifft(np.fft.fft(x - x.mean())[None, :] * psi, axis=1)) ** 2


def spectral_weights(spark, n: int, dt: float, omega0: float, low: float, high: float, voices: int, band: tuple[float, float]) -> DataFrame:
    """``(k, w_total, w_band)`` for positive bins that weigh at all; n / 2 rows at most, a fixed size for a window length."""
    total, inside = band_weights(n, dt, omega0, low, high, voices, *band)
    rows = [(k, float(total[k]), float(inside[k])) for k in range(1, n // 2 + 1) if total[k] > 1e-12 * total.max()]
    return spark.createDataFrame(rows, "k int, w_total double, w_band double")


def band_index_sql(filled: DataFrame, n: int, dt: float = 1.0, omega0: float = 6.0, low: float = 2.0, high: float = 48.0, voices: int = 8, band: tuple[float, float] = (20.0, 28.0)) -> DataFrame:
    """``(patient_id, signal_type, window_end, cri)`` without Python: bins join the grid, sums of cosines and sines give the power."""
    by = [*KEY, "window_end"]
    weights = F.broadcast(spectral_weights(filled.sparkSession, n, dt, omega0, low, high, voices, band))
    angle = F.col("k") * F.col("i") * (2 * math.pi / n)
    bins = filled.join(weights).groupBy(*by, "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("c"), F.sum(F.col("x") * F.sin(angle)).alias("s"), F.first("w_total").alias("w_total"), F.first("w_band").alias("w_band"))
    power = F.col("c") * F.col("c") + F.col("s") * F.col("s")
    sums = bins.groupBy(*by).agg(F.sum(power * F.col("w_band")).alias("inside"), F.sum(power * F.col("w_total")).alias("total"))
    return sums.select(*by, F.when(F.col("total") > 1e-12, F.col("inside") / F.col("total")).otherwise(0.0).alias("cri"))


LONG = "patient_id string, signal_type string, window_end timestamp, cri double, is_stability double, iv_variab double"


def long_windows(base: DataFrame, days: int = 5, hop_hours: int = 1, seconds: int = 60, coverage: float = 0.7, omega0: float = 6.0, low: float = 0.5, high: float = 48.0, voices: int = 8, band: tuple[float, float] = (20.0, 28.0), chunk_days: int = 7, isiv: bool = True) -> DataFrame:
    """Wavelet index and stability of every long window, hop by hop, without a copy of each row for each window.

    A key's series is cut into chunks of ``chunk_days``; a chunk's task also gets the ``days`` before it, so rows move at most
    ``1 + days / chunk_days`` times (a hop-by-hop expansion: ``24 * days / hop_hours`` times) and a long history isn't one task's.
    """
    n, per_day = days * 86_400 // seconds, 86_400 // seconds
    hop, width, chunk = hop_hours * 3600, days * 86_400, chunk_days * 86_400
    at = F.unix_seconds("window_start")
    # a window that ends in (c * chunk, (c + 1) * chunk] belongs to chunk c; row t is in windows that end in (t, t + width]
    rows = base.where(~F.isnan("median")).select(*KEY, at.alias("t"), "median")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("t") / chunk), F.ceil((F.col("t") + width) / chunk) - 1)))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        t, v = part["t"].to_numpy(), part["median"].to_numpy()
        first = max(key[2] * chunk, int(t[0]))
        ends = np.arange((first // hop + 1) * hop, min((key[2] + 1) * chunk, int(t[-1]) + width) + 1, hop)
        out = []
        for e in ends.tolist():
            a, b = np.searchsorted(t, [e - width, e])
            if b - a < coverage * n or b == a:
                continue
            x = np.full(n, v[a:b].mean())
            x[(t[a:b] - (e - width)) // seconds] = v[a:b]
            cri = band_index(x, seconds / 3600, omega0, low, high, voices, band)
            is_, iv = stability_of(x, per_day) if isiv else (None, None)
            out.append((key[0], key[1], pd.Timestamp(e, unit="s"), cri, is_, iv))
        return pd.DataFrame(out, columns=["patient_id", "signal_type", "window_end", "cri", "is_stability", "iv_variab"])

    return rows.groupBy(*KEY, "chunk").applyInPandas(run, LONG)


def stability_of(x: np.ndarray, per_day: int) -> tuple[float | None, float]:
    """(interdaily stability, intradaily variability); (None, 0) without spread."""
    n = len(x)
    if per_day < 1 or n < 2 * per_day:
        raise ValueError("stability needs two whole days")
    spread = float(((x - x.mean()) ** 2).sum())
    if spread == 0:
        return None, 0.0
    day = np.arange(n) % per_day
    means = np.bincount(day, x, per_day) / np.bincount(day, minlength=per_day)
    return float(n * ((means - x.mean()) ** 2).sum() / (per_day * spread)), float(n * (np.diff(x) ** 2).sum() / ((n - 1) * spread))


def scalogram_rows(filled: DataFrame, dt: float = 1.0, omega0: float = 6.0, low: float = 2.0, high: float = 48.0, voices: int = 8, columns: int = 900) -> DataFrame:
    """``(patient_id, signal_type, window_end, period, i, power)`` of each window, every step-th time so that at most ``columns`` remain."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        periods, power = scalogram(part["x"].to_numpy(), dt, omega0, low, high, voices)
        keep = np.arange(0, len(part), max(1, -(-len(part) // columns)))
        p, i = np.meshgrid(np.arange(len(periods)), keep, indexing="ij")
        return pd.DataFrame({"patient_id": key[0], "signal_type": key[1], "window_end": key[2], "period": periods[p.ravel()], "i": i.ravel(), "power": power[p.ravel(), i.ravel()]})

    return filled.groupBy(*KEY, "window_end").applyInPandas(run, "patient_id string, signal_type string, window_end timestamp, period double, i int, power double")


def global_spectrum(filled: DataFrame, dt: float = 1.0, omega0: float = 6.0, low: float = 2.0, high: float = 48.0, voices: int = 8) -> DataFrame:
    """``(patient_id, signal_type, window_end, period, power)``: a scalogram's mean over time, without it: by Parseval, from one transform."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("i")["x"].to_numpy()
        periods, psi = bank(len(x), dt, omega0, low, high, voices)
        power = (np.abs(np.fft.fft(x - x.mean())[None, :] * psi) ** 2).sum(axis=1) / len(x) ** 2
        return pd.DataFrame({"patient_id": key[0], "signal_type": key[1], "window_end": key[2], "period": periods, "power": power})

    return filled.groupBy(*KEY, "window_end").applyInPandas(run, "patient_id string, signal_type string, window_end timestamp, period double, power double")


def series_scalogram(base: DataFrame, seconds: int = 60, omega0: float = 6.0, low: float = 0.5, high: float = 48.0, voices: int = 8, columns: int = 900, least: int = 60) -> DataFrame:
    """``(patient_id, signal_type, window_end, period, i, power)`` of each whole series of at least ``least`` base windows.

    One grid from the first to the last base window, gaps filled with the mean; every step-th time so that at most ``columns``
    remain. window_end is the end of the last base window, i a place in the grid. A transform needs its series in one task.
    """
    rows = base.where(~F.isnan("median")).select(*KEY, F.unix_seconds("window_start").alias("t"), "median")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        t, v = part["t"].to_numpy(), part["median"].to_numpy()
        n = int(t.max() - t.min()) // seconds + 1
        keep = np.arange(0, n, -(-n // columns)) if len(t) >= least else np.arange(0)
        x = np.full(n, v.mean())
        x[(t - t.min()) // seconds] = v
        periods, psi = bank(n, seconds / 3600, omega0, low, high, voices)
        spectrum = np.fft.fft(x - x.mean())
        power = np.array([np.abs(np.fft.ifft(spectrum * p)[keep]) ** 2 for p in psi])
        return pd.DataFrame({"patient_id": key[0], "signal_type": key[1], "window_end": pd.Timestamp(int(t.max()) + seconds, unit="s"), "period": np.repeat(periods, len(keep)), "i": np.tile(keep, len(periods)), "power": power.ravel()})

    return rows.groupBy(*KEY).applyInPandas(run, "patient_id string, signal_type string, window_end timestamp, period double, i int, power double")


METRICS = ("patient_id", "signal_type", "method", "window_end", "mesor", "amplitude", "acrophase", "r2", "cri", "is_stability", "iv_variab")


def as_metrics(rows: DataFrame, method: str) -> DataFrame:
    """The tagged union's columns; those that a method lacks are null, and so are NaNs."""
    have = dict(rows.dtypes)
    out = [F.lit(method).alias(c) if c == "method" else (F.col(c) if c in METRICS[:4] else F.when(~F.isnan(c), F.col(c)).alias(c)) if c in have else F.lit(None).cast("double").alias(c) for c in METRICS]
    return rows.select(*out)


def metrics_union(cosinor_rows: DataFrame, cri_rows: DataFrame, isiv_rows: DataFrame) -> DataFrame:
    return as_metrics(cosinor_rows, "cosinor").unionByName(as_metrics(cri_rows.select(*KEY, "window_end", "cri"), "cwt")).unionByName(as_metrics(isiv_rows.select(*KEY, "window_end", "is_stability", "iv_variab"), "isiv"))
