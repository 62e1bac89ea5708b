"""Synthetic series with known rhythms and disruptions, and their ground truth."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.functions import scalars as S
from diurna.schema import SIGNALS

# Mesor, amplitude, peak hour and noise of each signal.
BASELINES = {"HR": (70.0, 8.0, 15.0, 2.5), "ABP_SYS": (120.0, 10.0, 18.0, 4.0), "ABP_DIA": (75.0, 6.0, 18.0, 3.0), "SPO2": (97.0, 0.8, 14.0, 0.4), "RR": (16.0, 2.0, 15.0, 1.0)}
START = "2026-06-01 00:00:00"
KINDS = ("amplitude_drop", "phase_shift", "fragmentation")
DISRUPTION = "patients array<string>, signals array<string>, type string, start_hour double, end_hour double, magnitude double, ramp_hours double, bout_hours double"


@dataclass
class Scenario:
    """What to generate; unknown keys of a file are ignored."""

    name: str = "adhoc"
    patients: int = 3
    sim_hours: float = 24.0
    rate_hz: float = 1.0
    noise_correlation: float = 0.0
    missingness_rate: float = 0.0
    artifact_rate: float = 0.0
    drift_sd: float = 0.0
    amplitude_scale: tuple[float, float] = (1.0, 1.0)
    disruptions: list[tuple] = field(default_factory=list)

    @staticmethod
    def from_yaml(text: str) -> Scenario:
        import yaml

        d = yaml.safe_load(text) or {}
        f = d.get("fidelity") or {}
        rows = []
        for x in d.get("disruptions") or []:
            if str(x.get("type", "")).lower() not in KINDS:
                raise ValueError(f"{x.get('type')!r} is no kind of disruption")
            bout = float(x.get("boutHours", 0.5))
            rows.append((list(x.get("patients") or ["all"]), list(x.get("signals") or ["all"]), x["type"].lower(), float(x.get("startHour", 0)), float(x.get("endHour", 0)), float(x.get("magnitude", 0)), float(x.get("rampHours", 0)), bout if bout > 0 else 0.5))
        return Scenario(d.get("name", "adhoc"), int(d.get("patients", 3)), float(d.get("simHours", 24)), float(d.get("rateHz", 1)), float(f.get("noiseCorrelation", 0)), float(f.get("missingnessRate", 0)), float(f.get("artifactRate", 0)), float(f.get("driftSd", 0)), (float(f.get("amplitudeScaleMin", 1)), float(f.get("amplitudeScaleMax", 1))), rows)


def progress(h: Column) -> Column:
    """How far a disruption (its columns beside h) is in force at hour h: a trapezoid over [start, end)."""
    rising, falling = (h - F.col("start_hour")) / F.col("ramp_hours"), (F.col("end_hour") - h) / F.col("ramp_hours")
    ramp = F.when(F.col("ramp_hours") <= 0, 1.0).when(h < F.col("start_hour") + F.col("ramp_hours"), rising).when(h > F.col("end_hour") - F.col("ramp_hours"), falling).otherwise(1.0)
    return F.when((h >= F.col("start_hour")) & (h < F.col("end_hour")), S.clamp(ramp, 0.0, 1.0)).otherwise(0.0)


def effects(h: Column, amplitude: Column) -> dict[str, Column]:
    """A disruption's factor on the amplitude, change of phase and added term."""
    p, m = progress(h), F.col("magnitude")
    factor = F.when(F.col("type") == "amplitude_drop", 1 - p * (1 - m)).when(F.col("type") == "fragmentation", 1 - p * 0.5 * m).otherwise(1.0)
    phase = F.when(F.col("type") == "phase_shift", -p * m * (2 * math.pi / 24)).otherwise(0.0)
    gate = F.signum(F.sin(h * (2 * math.pi) / F.when(F.col("bout_hours") > 0, F.col("bout_hours")).otherwise(0.5)))
    return {"factor": factor, "phase": phase, "added": F.when(F.col("type") == "fragmentation", p * amplitude * m * gate).otherwise(0.0)}


def series_table(spark: SparkSession, scenario: Scenario, seed: int = 42) -> DataFrame:
    """One row for each patient and signal with its own rhythm: jittered defaults, drawn from the series' own seed."""
    people = spark.range(1, scenario.patients + 1).select(F.col("id").cast("int").alias("p"))
    rows = [(k, n, lo, hi, *BASELINES[n]) for k, (n, _, lo, hi) in enumerate(SIGNALS)]
    kinds = spark.createDataFrame(rows, "ordinal int, signal_type string, low double, high double, mesor double, amplitude double, peak double, noise_sd double")
    rows = people.crossJoin(F.broadcast(kinds)).withColumn("seed", S.mixed_seed(F.lit(seed).cast("long"), F.col("p"), F.col("ordinal"), 0))
    lo, hi = scenario.amplitude_scale

    def jitter(parts):
        for part in parts:
            g = np.array([np.random.default_rng(int(s) & (2**63 - 1)).normal(size=4) for s in part["seed"]]).reshape(len(part), 4)
            scale = np.array([np.random.default_rng((int(s) + 7) & (2**63 - 1)).uniform(lo, hi) if lo < hi else lo for s in part["seed"]])
            yield pd.DataFrame({"patient_id": ["P%04d" % p for p in part["p"]], "signal_type": part["signal_type"], "seed": part["seed"], "low": part["low"], "high": part["high"], "mesor": part["mesor"] * (1 + 0.05 * g[:, 0]), "amplitude": part["amplitude"] * np.maximum(0, 1 + 0.15 * g[:, 1]) * scale, "acrophase": -2 * np.pi * part["peak"] / 24 + 0.2 * g[:, 2], "noise_sd": part["noise_sd"]})

    return rows.mapInPandas(jitter, "patient_id string, signal_type string, seed long, low double, high double, mesor double, amplitude double, acrophase double, noise_sd double")


def disruption_table(spark: SparkSession, scenario: Scenario) -> DataFrame:
    return spark.createDataFrame(scenario.disruptions, DISRUPTION)


def matched(series: DataFrame, disruptions: DataFrame) -> DataFrame:
    """Each series with each disruption that names it; a scenario's disruptions are a handful."""
    return series.join(F.broadcast(disruptions), S.matches_any(F.col("patients"), F.col("patient_id")) & S.matches_any(F.col("signals"), F.col("signal_type")))


def samples(spark: SparkSession, scenario: Scenario, seed: int = 42) -> DataFrame:
    """Samples of every series. The noise is a recursion in time, so a series is made in order, in one task."""
    start = int((datetime.fromisoformat(START) - datetime(1970, 1, 1)).total_seconds())
    steps = math.floor(scenario.sim_hours * 3600 * scenario.rate_hz + 0.5)
    series = series_table(spark, scenario, seed)
    both = matched(series, disruption_table(spark, scenario)).groupBy("patient_id", "signal_type").agg(F.collect_list(F.struct("type", "start_hour", "end_hour", "magnitude", "ramp_hours", "bout_hours")).alias("d"))
    rows = series.join(both, ["patient_id", "signal_type"], "left").repartition("patient_id", "signal_type")
    corr = min(0.999, max(0.0, scenario.noise_correlation))

    def make(parts):
        for part in parts:
            for r in part.itertuples():
                rng = np.random.default_rng((int(r.seed) + 13) & (2**63 - 1))
                sim = np.arange(steps) / (3600 * scenario.rate_hz)
                hours = start / 3600 + sim
                noise = recursion(rng.normal(size=steps) * math.sqrt(1 - corr**2), corr)
                drift = recursion(rng.normal(size=steps) * scenario.drift_sd, 0.999) if scenario.drift_sd > 0 else 0.0
                amp, phase, added = np.full(steps, r.amplitude), np.full(steps, r.acrophase), np.zeros(steps)
                for d in r.d if r.d is not None else ():
                    p = trapezoid(sim, d["start_hour"], d["end_hour"], d["ramp_hours"])
                    if d["type"] == "amplitude_drop":
                        amp *= 1 - p * (1 - d["magnitude"])
                    elif d["type"] == "fragmentation":
                        amp *= 1 - 0.5 * p * d["magnitude"]
                        added += p * r.amplitude * d["magnitude"] * np.sign(np.sin(2 * np.pi * sim / d["bout_hours"]))
                    else:
                        phase += p * (-2 * np.pi * d["magnitude"] / 24)
                v = np.clip(r.mesor + amp * np.cos(2 * np.pi * hours / 24 + phase) + added + drift + r.noise_sd * noise, r.low, r.high)
                bad = rng.random(steps) < scenario.artifact_rate
                v = np.where(bad, np.where(rng.random(steps) < 0.5, 0.0, 1.5 * r.high), v)
                keep = np.flatnonzero(rng.random(steps) >= scenario.missingness_rate)
                for at in range(0, len(keep), 100_000):
                    k = keep[at : at + 100_000]
                    micros = np.floor((start + sim[k] * 3600) * 1e6 + 0.5).astype("datetime64[us]")
                    yield pd.DataFrame({"patient_id": r.patient_id, "signal_type": r.signal_type, "timestamp": pd.Series(micros).dt.tz_localize("UTC"), "value": v[k]})

    units = F.create_map(*[F.lit(x) for n, u, _, _ in SIGNALS for x in (n, u)])
    return rows.mapInPandas(make, "patient_id string, signal_type string, timestamp timestamp, value double").withColumn("unit", F.element_at(units, F.col("signal_type")))


def trapezoid(h: np.ndarray, start: float, end: float, ramp: float) -> np.ndarray:
    p = np.ones_like(h) if ramp <= 0 else np.where(h < start + ramp, (h - start) / ramp, np.where(h > end - ramp, (end - h) / ramp, 1.0))
    return np.where((h >= start) & (h < end), np.clip(p, 0, 1), 0.0)


def recursion(x: np.ndarray, a: float) -> np.ndarray:
    """y[i] = a y[i - 1] + x[i], block by block: in a block y[i] / a^i is a running sum."""
    if a == 0:
        return x.astype(float)
    block = max(1, min(1024, int(200 / -math.log(a)) if a < 1 else 1024))
    powers = a ** np.arange(block + 1)
    out = np.empty(len(x))
    y = 0.0
    for k in range(0, len(x), block):
        part = x[k : k + block]
        n = len(part)
        out[k : k + n] = powers[:n] * np.cumsum(part / powers[:n]) + y * powers[1 : n + 1]
        y = out[k + n - 1]
    return out


def ground_truth(spark: SparkSession, scenario: Scenario, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(parameters of each series, events of each series and disruption)."""
    series = series_table(spark, scenario, seed)
    start = F.lit(START).cast("timestamp")
    at = lambda h: F.timestamp_micros(F.unix_micros(start) + S.round_half_up(F.col(h) * 3.6e9))
    params = F.to_json(F.struct(F.col("ramp_hours").alias("rampHours"), F.col("bout_hours").alias("boutHours")))
    events = matched(series, disruption_table(spark, scenario)).select("patient_id", "signal_type", F.col("type").alias("event_type"), at("start_hour").alias("start_time"), at("end_hour").alias("end_time"), "magnitude", params.alias("params_json"))
    return series.select("patient_id", "signal_type", "mesor", "amplitude", "acrophase", "noise_sd"), events
