import json
import os
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from diurna.operators import generate, rhythm, status, validate
from diurna.schema import SIGNALS, TABLES, Settings
from diurna.sources import sinks, vitals
from diurna.streaming import job

T0 = datetime(2026, 6, 1, tzinfo=timezone.utc)


def line(patient="P0001", signal="HR", seconds=0, value=70.0, **more):
    body = {"patientId": patient, "signalType": signal, "timestamp": (T0 + timedelta(seconds=seconds)).isoformat().replace("+00:00", "Z"), "value": value, "unit": "bpm", **more}
    return json.dumps({k: v for k, v in body.items() if v is not None})


def lines_frame(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_json_lines(spark):
    got = vitals.decode_json(lines_frame(spark, [line(), line(futureField="x"), "garbage", line(signal="XX"), line(patient=None), line(value=None), "{}"]))
    assert sorted(r.value for r in got.collect()) == [0.0, 70.0, 70.0]
    back = sinks.json_lines(got).first()
    assert back.key == "P0001" and json.loads(back.value)["timestamp"].startswith("2026-06-01T00:00:00")


def test_validation_splits_without_loss(spark):
    rows = [("P", s, v) for s, _, lo, hi in SIGNALS for v in (lo, hi, lo - 0.1, hi + 0.1, float("nan"), None)] + [("P", "??", 1.0)]
    df = spark.createDataFrame(rows, "patient_id string, signal_type string, value double").withColumn("timestamp", F.lit(T0)).withColumn("unit", F.lit("u"))
    dim = vitals.signal_dimension(spark)
    good, bad = validate.valid(df, dim), validate.dead_letters(df, dim)
    assert good.count() == 10 and bad.count() == 21
    assert {r.reason for r in bad.where("signal_type = 'HR'").collect()} == {"out_of_range[20.0,300.0]"}


def test_settings():
    s = Settings.from_env({"CWT_DAYS": " 7 ", "HOP_HOURS": "", "ENABLE_ISIV": "false", "CWT_OMEGA0": "5.5"})
    assert (s.cwt_days, s.hop_hours, s.enable_isiv, s.cwt_omega0) == (7, 1, False, 5.5)
    assert Settings().bins_per_day == 1440
    with pytest.raises(ValueError):
        Settings(cwt_days=1)


def test_replay(spark):
    from diurna.plans.queries import DEVICE_ROWS
    from diurna.schema import DEVICE_CSV

    got = vitals.replay(spark.createDataFrame(DEVICE_ROWS, DEVICE_CSV), "7").collect()
    assert [r.signal_type for r in got] == ["HR", "SPO2", "ABP_DIA"]
    assert vitals.replay(spark.createDataFrame(DEVICE_ROWS, DEVICE_CSV), "7", 1).count() == 1


def test_store(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path))
    row = ("p", "HR", T0, 1.0, 2.0, 0.5)
    make = lambda *rows: spark.createDataFrame(list(rows), TABLES["agg_1min"])
    store.upsert("agg_1min", make(row))
    store.upsert("agg_1min", make(row))
    store.upsert("agg_1min", make((*row[:3], float("nan"), 3.0, 0.5), ("q", *row[1:])))
    got = {r.patient_id: r for r in store.read("agg_1min").collect()}
    assert len(got) == 2 and got["p"].median is None and got["p"].sd == 3
    run = lambda note: spark.createDataFrame([("r", "e", "s", 1, None, T0, note)], TABLES["experiment_runs"])
    store.insert_absent("experiment_runs", run("first"))
    store.insert_absent("experiment_runs", run("second"))
    assert [r.notes for r in store.read("experiment_runs").collect()] == ["first"]
    dead = spark.createDataFrame([("p", "HR", T0, 1.0, "bpm", "x")], "patient_id string, signal_type string, event_time timestamp, value double, unit string, reason string")
    for batch in (0, 1, 1):
        store.append_dead_letters(dead, batch)
    assert store.dead_letters().count() == 2


SCENARIO = """
name: drop
patients: 2
simHours: 96
rateHz: 0.005
unknown: 1
fidelity: {noiseCorrelation: 0.6, artifactRate: 0.01, missingnessRate: 0.05}
disruptions:
  - {patients: [P0001], signals: [hr], type: amplitude_drop, startHour: 48, endHour: 96, magnitude: 0.2, rampHours: 2}
"""


def test_scenario_and_generator(spark):
    s = generate.Scenario.from_yaml(SCENARIO)
    assert s.patients == 2 and s.disruptions[0][6:] == (2.0, 0.5)
    a, b = (sorted(map(tuple, generate.samples(spark, s, 1).collect())) for _ in range(2))
    assert a == b and 0.9 * 17280 < len(a) < 17280
    params, events = generate.ground_truth(spark, s, 1)
    assert params.count() == 10
    e = events.collect()
    assert [(r.patient_id, r.signal_type, r.event_type) for r in e] == [("P0001", "HR", "amplitude_drop")] and json.loads(e[0].params_json) == {"rampHours": 2.0, "boutHours": 0.5}
    df = generate.samples(spark, s, 1)
    bad = validate.dead_letters(df, vitals.signal_dimension(spark)).count()
    assert 0.005 * len(a) < bad < 0.02 * len(a)
    base = rhythm.tumbling(validate.valid(df, vitals.signal_dimension(spark)), 3600, 18)
    fits = rhythm.cosinor_metrics(base, 24, 1, 24, 0.5).where("signal_type = 'HR'").toPandas()
    end = pd.Timestamp("2026-06-05")
    last = fits[fits.window_end == end].set_index("patient_id").amplitude
    first = fits[fits.window_end == pd.Timestamp("2026-06-02 12:00")].set_index("patient_id").amplitude
    assert last["P0001"] < 0.45 * first["P0001"] and last["P0002"] > 0.7 * first["P0002"]
    with pytest.raises(ValueError):
        generate.Scenario.from_yaml("disruptions: [{type: other}]")


def test_missing_everything_and_artifacts(spark):
    s = generate.Scenario(patients=1, sim_hours=1, rate_hz=0.1, missingness_rate=1.0)
    assert generate.samples(spark, s).count() == 0


def test_status_rules(spark):
    def rows(patient, amplitudes, r2, cri=None):
        out = [(patient, "HR", "cosinor", T0 + timedelta(hours=i), 70.0, a, 0.1, r2, None, None, None) for i, a in enumerate(amplitudes)]
        return out + [(patient, "HR", "cwt", T0, None, None, None, None, cri, None, None)]

    data = rows("good", [8.0] * 12, 0.9) + rows("weak", [8.0] * 12, 0.4) + rows("lost", [8.0] * 12, 0.1) + rows("fell", [8.0] * 6 + [4.0] * 6, 0.9) + rows("fell_far", [8.0] * 6 + [1.0] * 6, 0.9) + rows("none", [], None) + rows("index", [], None, 0.2)
    got = {r.patient_id: (r.level, r.label) for r in status.status(spark.createDataFrame(data, TABLES["circadian_metrics"])).collect()}
    assert got == {"good": ("good", "Rhythm preserved"), "weak": ("warn", "Rhythm weak"), "lost": ("crit", "Rhythm disrupted"), "fell": ("warn", "Rhythm weakened"), "fell_far": ("crit", "Rhythm disrupted"), "none": ("none", "No rhythm metrics"), "index": ("crit", "Rhythm disrupted")}


def write_files(folder, batches):
    folder.mkdir()
    for k, lines in enumerate(batches):
        path = folder / f"{k:03d}.txt"
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # files are read in order of their times


def test_streaming_equals_batch(spark, tmp_path):
    r = np.random.default_rng(0)
    lines = [[line(p, "HR", 600 * i, float(70 + 8 * np.cos(2 * np.pi * i / 144) + r.normal())) for p in ("a", "b") for i in range(72 * k, 72 * k + 72)] for k in range(8)]
    lines[7].append(line("a", "HR", 5, 75.0))  # far behind the watermark
    lines[4].append(line("a", "HR", 600 * 300, 1000.0))
    write_files(tmp_path / "in", lines)
    settings = Settings(window_seconds=1800, hop_hours=1, expected_samples_per_min=1)
    store = sinks.Store(spark, str(tmp_path / "store"))
    dim = vitals.signal_dimension(spark)
    for _ in range(2):  # a second run finds nothing new
        stream = vitals.with_event_time(vitals.json_stream(spark, str(tmp_path / "in"), 2), settings)
        for q in job.run_job(stream, dim, store, settings, str(tmp_path / "checkpoint"), available_now=True):
            q.awaitTermination()
    batch = vitals.json_files(spark, str(tmp_path / "in")).where("timestamp <> timestamp'2026-06-01 00:00:05'")
    base = rhythm.tumbling(validate.valid(batch, dim), 1800, 30)
    mark = F.lit(T0 + timedelta(seconds=600 * 575 - 5))
    want = {(x.patient_id, x.window_start): x.median for x in base.where(F.col("window.end") <= mark).collect()}
    got = {(x.patient_id, x.window_start): x.median for x in store.read("agg_1min").collect()}
    assert got == pytest.approx(want)
    fits = rhythm.cosinor_metrics(base.where(F.col("window.end") <= mark), 24, 1, 48, 0.5).where(F.col("window_end") <= mark).collect()
    stored = {(x.patient_id, x.window_end): x.amplitude for x in store.read("circadian_metrics").where("method = 'cosinor'").collect()}
    assert stored == pytest.approx({(x.patient_id, x.window_end): x.amplitude for x in fits})
    assert store.dead_letters().count() == 1


def test_long_window_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    r = np.random.default_rng(1)
    hours = [h for h in range(24 * 9) if not 100 <= h < 118]
    lines = [[line(p, "HR", 3600 * h, float(70 + 8 * np.cos(2 * np.pi * h / 24) + r.normal())) for p in ("a", "b") for h in hours[54 * k : 54 * k + 54]] for k in range(4)]
    write_files(tmp_path / "in", lines)
    settings = Settings(window_seconds=3600, cwt_days=2, hop_hours=6, cwt_min_period_hours=2)
    stream = vitals.with_event_time(vitals.json_stream(spark, str(tmp_path / "in"), 1), settings)
    out = job.long_window_stream(job.summaries(stream, settings), settings)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(x.patient_id, x.window_end): x.cri for x in spark.read.schema(rhythm.LONG).parquet(str(tmp_path / "out")).collect()}
    base = rhythm.tumbling(vitals.json_files(spark, str(tmp_path / "in")), 3600, 60)
    want = {(x.patient_id, x.window_end): x.cri for x in rhythm.long_windows(base, 2, 6, 3600, 0.7, low=2.0).collect()}
    assert len(got) >= 20 and all(got[k] == pytest.approx(want[k]) for k in got)
    last = max(k[1] for k in got)
    assert {k for k in want if k[1] <= last} == set(got)


def test_supervisor():
    calls = []

    class Query:
        def awaitTermination(self):
            calls.append(1)
            if len(calls) < 3:
                raise RuntimeError

    assert job.supervise(Query, 3, 0) == 2
    calls.clear()
    with pytest.raises(RuntimeError):
        job.supervise(lambda: (_ for _ in ()).throw(RuntimeError()), 1, 0)
