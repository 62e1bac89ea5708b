import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators import lighting, rhythm


def fit(spark, t, y):
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, y, strict=True)], "t double, y double")
    return rhythm.cosinor(rows, [F.lit(1).alias("g")], F.col("t"), F.col("y")).first()


def test_cosinor_recovers_a_clean_rhythm(spark):
    t = np.arange(48)
    r = fit(spark, t, 70 + 8 * np.cos(2 * np.pi * t / 24 - 2 * np.pi * 15 / 24))
    assert r.mesor == pytest.approx(70, abs=1e-6) and r.amplitude == pytest.approx(8, abs=1e-6) and r.r2 == pytest.approx(1, abs=1e-6)
    assert math.cos(r.acrophase) == pytest.approx(math.cos(2 * math.pi * 15 / 24), abs=1e-6)


def test_cosinor_flat_and_noisy(spark):
    r = fit(spark, np.arange(48), np.full(48, 100.0))
    assert r.amplitude == pytest.approx(0, abs=1e-9) and r.r2 is None
    t = np.arange(1440) / 60
    r = fit(spark, t, 70 + 8 * np.cos(2 * np.pi * t / 24) + np.random.default_rng(0).normal(size=1440))
    assert abs(r.amplitude - 8) < 0.5 and abs(r.mesor - 70) < 0.2 and r.r2 > 0.9


def day(n, hours, phase=0.0):
    return np.cos(2 * np.pi * np.arange(n) / 60 / hours + phase)


def test_band_index_separates_periods():
    n = 7200
    day24, day12 = rhythm.band_index(day(n, 24), 1 / 60), rhythm.band_index(day(n, 12), 1 / 60)
    assert day24 > 0.3 and day12 < 0.1 and day24 > 3 * day12
    noisy = rhythm.band_index(day(n, 24) + np.random.default_rng(1).normal(size=n) * 3, 1 / 60)
    assert noisy < day24
    assert day24 == pytest.approx(0.866564, abs=1e-6)
    assert rhythm.band_index(np.full(2880, 97.0), 1 / 60) == 0


def test_one_transform_equals_the_scalogram():
    r = np.random.default_rng(2)
    for x in (day(2880, 24), day(2880, 12), day(2880, 24) * 0.3 + r.normal(size=2880), r.normal(size=2880)):
        for band in ((20.0, 28.0), (10.0, 14.0)):
            periods, power = rhythm.scalogram(x, 1 / 60)
            inside = (periods >= band[0]) & (periods <= band[1])
            assert rhythm.band_index(x, 1 / 60, band=band) == pytest.approx(power[inside].sum() / power.sum(), abs=1e-9)


# Published band-power indices of four signals (n 4320, 12 voices).
GOLDEN = {"s24": 0.858073, "s12": 0.000000, "s24_12": 0.762732}


def test_golden_indices():
    n = 4320
    signals = {"s24": day(n, 24), "s12": day(n, 12), "s24_12": day(n, 24) + 0.5 * day(n, 12)}
    for name, x in signals.items():
        assert rhythm.band_index(x, 1 / 60, voices=12) == pytest.approx(GOLDEN[name], abs=1e-6)
    periods, power = rhythm.scalogram(signals["s24"], 1 / 60, voices=12)
    assert len(periods) == 80
    assert abs(math.log2(periods[power.mean(axis=1).argmax()] / 24)) <= 1 / 12


def test_global_spectrum_is_the_scalogram_s_mean(spark):
    x = day(120, 24) * 3 + np.random.default_rng(4).normal(size=120)
    filled = spark.createDataFrame([("p", "HR", 0, i, float(v)) for i, v in enumerate(x)], "patient_id string, signal_type string, window_end long, i int, x double").withColumn("window_end", F.timestamp_seconds("window_end"))
    periods, power = rhythm.scalogram(x, 1.0, low=2.0)
    got = rhythm.global_spectrum(filled).toPandas()
    assert np.allclose(got.period, periods) and np.allclose(got.power, power.mean(axis=1))


def test_stability():
    i = np.arange(168)
    s, v = rhythm.stability_of(np.cos(2 * np.pi * i / 24), 24)
    assert s == pytest.approx(1, abs=1e-6) and v < 0.2
    s, v = rhythm.stability_of(np.random.default_rng(0).normal(size=168), 24)
    assert s < 0.5 and v > 1
    assert rhythm.stability_of(np.full(168, 3.0), 24) == (None, 0.0)
    with pytest.raises(ValueError):
        rhythm.stability_of(np.ones(30), 24)


def test_stability_frames_equal_the_kernel(spark):
    r = np.random.default_rng(1)
    x = {k: r.normal(50, 5, 120) for k in ("a", "b")} | {"flat": np.full(120, 7.25)}
    rows = spark.createDataFrame([(k, i, float(v)) for k, xs in x.items() for i, v in enumerate(xs)], "k string, i int, x double")
    for row in rhythm.stability(rows, 24, ("k",)).collect():
        s, v = rhythm.stability_of(x[row.k], 24)
        assert row.iv_variab == pytest.approx(v, rel=1e-9) and (row.is_stability is None if s is None else row.is_stability == pytest.approx(s, rel=1e-9))


def test_light_schedule(spark):
    p = spark.createDataFrame([("a", -2 * math.pi * 15 / 24, 0.9), ("b", -2 * math.pi * 3 / 24, 0.1), ("c", 0.5, None)], "patient_id string, acrophase double, strength double")
    rows = lighting.schedule(p, 48).collect()
    assert len(rows) == 144
    for r in rows:
        assert 0 <= r.peak_hour < 24 and 0.05 <= r.intensity <= 1 and 2300 <= r.cct <= 6500 and len(r.hex) == 7
    top = {r.patient_id: r.hour for r in lighting.brightest(lighting.schedule(p, 48)).collect()}
    assert top["a"] == 15 and top["b"] == 3
    low = lambda k: min(r.intensity for r in rows if r.patient_id == k)
    assert low("b") < low("a")
    with pytest.raises(ValueError):
        lighting.schedule(p, 0)


def test_window_summaries(spark):
    rows = [("p", "x", 0, v) for v in (1.0, 2.0, 3.0, 4.0)] + [("p", "x", 60, v) for v in (5.0, 1.0, 3.0)] + [("q", "x", 0, 9.0)]
    df = spark.createDataFrame(rows, "patient_id string, signal_type string, s long, value double").withColumn("timestamp", F.timestamp_seconds("s"))
    got = {(r.patient_id, r.window_start.minute): r for r in rhythm.tumbling(df, 60, 4).collect()}
    assert got["p", 0].median == 2.5 and got["p", 0].sd == pytest.approx(math.sqrt(5 / 3), abs=1e-12) and got["p", 0].completeness == 1
    assert got["p", 1].median == 3 and got["p", 1].completeness == 0.75
    assert got["q", 0].sd == 0


def test_long_windows_in_chunks_equal_whole_series(spark):
    r = np.random.default_rng(4)
    have = np.flatnonzero(r.random(24 * 40) > 0.2)
    have = have[(have < 300) | (have > 420)]
    rows = [("p", "x", int(h) * 3600, float(50 + 5 * np.cos(2 * np.pi * h / 24) + r.normal())) for h in have]
    base = spark.createDataFrame(rows, "patient_id string, signal_type string, s long, median double").withColumn("window_start", F.timestamp_seconds("s"))
    a, b = ({x.window_end: x for x in rhythm.long_windows(base, 5, 6, 3600, 0.7, low=2.0, chunk_days=c).collect()} for c in (3, 1000))
    assert a.keys() == b.keys() and len(a) > 50
    for k, x in a.items():
        assert (x.cri, x.is_stability, x.iv_variab) == pytest.approx((b[k].cri, b[k].is_stability, b[k].iv_variab))
