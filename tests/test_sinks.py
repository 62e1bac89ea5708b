"""Keyed stores and statements, paced and golden output, file sources, supervision and its settings."""

import os
from datetime import timedelta

import numpy as np
import pytest

from diurna.operators import generate, rhythm
from diurna.schema import TABLES, Settings
from diurna.sources import sinks, vitals
from diurna.streaming import job

from .test_flow import T0, line, write_files


def test_a_merge_writes_only_the_days_it_touches(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path), keep=2)
    make = lambda *rows: spark.createDataFrame([("p", "HR", T0 + timedelta(days=d), v, 0.0, 1.0) for d, v in rows], TABLES["agg_1min"])
    store.upsert("agg_1min", make((0, 1.0), (1, 2.0), (2, 3.0)))
    before = store.parts("agg_1min")
    assert sorted(before) == ["20260601", "20260602", "20260603"]
    opened = store.read("agg_1min")
    store.upsert("agg_1min", make((1, 5.0)))
    after = store.parts("agg_1min")
    assert after["20260601"] == before["20260601"] and len(after["20260602"]) == 2
    assert sorted(r.median for r in opened.collect()) == [1, 2, 3]  # a reader of the older version
    assert sorted(r.median for r in store.read("agg_1min").collect()) == [1, 3, 5]
    store.upsert("agg_1min", make((1, 6.0)))
    assert len(store.parts("agg_1min")["20260602"]) == 2
    assert sorted(r.median for r in store.read("agg_1min").collect()) == [1, 3, 6]


def test_upsert_statement():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in ("ground_truth_params", "new"):
        key = ", primary key (patient_id, signal_type)" if name != "new" else ""
        db.sql(f"create table {name} (patient_id varchar, signal_type varchar, mesor double, amplitude double, acrophase double, noise_sd double{key})")
    db.sql("insert into ground_truth_params values ('a', 'HR', 1, 1, 1, 1), ('b', 'HR', 2, 2, 2, 2)")
    db.sql("insert into new values ('b', 'HR', 9, 9, 9, 9), ('c', 'HR', 3, 3, 3, 3)")
    for _ in range(2):  # a replayed batch changes nothing
        db.sql(sinks.upsert_sql("ground_truth_params", "new"))
    assert db.sql("select patient_id, mesor from ground_truth_params order by 1").fetchall() == [("a", 1), ("b", 9), ("c", 3)]


def test_paced_replay(spark):
    df = spark.createDataFrame([("p", "HR", T0 + timedelta(seconds=s), 1.0, "bpm") for s in (0, 10, 59, 60, 200)], "patient_id string, signal_type string, timestamp timestamp, value double, unit string")
    now, slept, sent = [0.0], [], []

    def sleep(s):
        slept.append(round(s, 6))
        now[0] += s

    n = sinks.paced(df, lambda rows: sent.append(rows.count()), speed=30, slice_seconds=60, clock=lambda: now[0], sleep=sleep)
    assert n == 4 and sent == [3, 1, 0, 1] and slept == [2, 2, 2]
    sent.clear()
    assert sinks.paced(df, lambda rows: sent.append(rows.count())) == 1 and sent == [5]
    assert sinks.paced(df.limit(0), sent.append, 1.0) == 0


def test_golden_files(spark, tmp_path):
    spectrum = spark.createDataFrame([("s1", 2.0, 0.5), ("s1", 4.0, 1.25e-9), ("s2", 2.0, 7.0)], "signal string, period double, power double")
    index = spark.createDataFrame([("s1", 0.8580731), ("s2", 0.0)], "signal string, cri double")
    for name, df in zip(("a", "b"), sinks.golden_csv(spectrum, index), strict=True):
        df.write.option("header", True).csv(str(tmp_path / name))
    wide, cri = vitals.golden(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(map(tuple, wide.select("period", "s1", "s2").collect()), key=str) == [(2.0, 0.5, 7.0), (4.0, 1.25e-9, None)]
    assert {r.signal: r.cri for r in cri.collect()} == {"s1": 0.858073, "s2": 0.0}


def test_device_file(spark, tmp_path):
    (tmp_path / "d.csv").write_text('c_time_stamp_numeric,c_label,c_sub_label,c_value,c_unit_label,p_patnr\n2025-06-01 00:00:00.000 +02:00,x,HF,71,bpm,7\n2025-06-01 00:00:01 +02:00,TEMP,,37,C,7\n2025-06-01 00:00:02 +02:00,"ABP-S",,120,mmHg,8\n')
    got = vitals.dispositions(vitals.device_csv(spark, str(tmp_path / "d.csv")), "7").collect()
    assert [r.disposition for r in got] == ["ok", "unmapped", "filtered"]
    assert [r.signal_type for r in vitals.replay(vitals.device_csv(spark, str(tmp_path / "d.csv"))).collect()] == ["HR", "ABP_SYS"]


def test_examples_stand_in(spark):
    none = spark.createDataFrame([], "patient_id string, acrophase double, r2 double, cri double")
    assert {r.patient_id for r in vitals.or_examples(none).collect()} == {"P-early", "P-noon", "P-late"}
    one = spark.createDataFrame([("x", 0.0, 1.0, 1.0)], none.schema)
    assert vitals.or_examples(one).collect() == one.collect()


def test_messages_read_back(spark, tmp_path):
    """What the producer would send, read as a stream of values as from a topic."""
    df = spark.createDataFrame([("p", "HR", T0 + timedelta(seconds=s), 60.0 + s, "bpm") for s in range(5)], "patient_id string, signal_type string, timestamp timestamp, value double, unit string")
    sinks.json_lines(df).select("value").write.text(str(tmp_path / "topic"))
    stream = vitals.json_stream(spark, str(tmp_path / "topic"))
    q = stream.writeStream.format("memory").queryName("messages").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("messages").collect())) == sorted(map(tuple, df.collect()))


def test_recursion():
    x = np.random.default_rng(0).normal(size=5000)
    for a in (0.0, 0.01, 0.6, 0.999):
        want, y = [], 0.0
        for v in x:
            y = a * y + v
            want.append(y)
        assert np.allclose(generate.recursion(x, a), want, atol=1e-9)


def test_decaying_golden():
    n = 4320
    i = np.arange(n)
    x = (1 - 0.8 * i / (n - 1)) * np.cos(2 * np.pi * i / 60 / 24)
    assert rhythm.band_index(x, 1 / 60, voices=12) == pytest.approx(0.781500, abs=1e-6)  # published


def test_job_is_supervised_and_counts_dropped_rows(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    lines = [[line("a", "HR", 1800 * h, 70.0 + h % 7) for h in range(48 * k, 48 * k + 48)] for k in range(3)]
    lines[2].append(line("a", "HR", 7, 75.0))  # far behind the watermark
    write_files(tmp_path / "in", lines)
    settings = Settings(window_seconds=3600, cwt_days=2, cwt_min_period_hours=2, expected_samples_per_min=1, restart_attempts=1, restart_delay_seconds=0, checkpoint_dir=str(tmp_path / "c"), state_backend="rocksdb")
    store = sinks.Store(spark, str(tmp_path / "store"))
    stream = vitals.with_event_time(vitals.json_stream(spark, str(tmp_path / "in"), 1), settings)
    starts = job.job_queries(stream, vitals.signal_dimension(spark), store, settings, available_now=True)
    started, failing = {}, [True]

    def remembered(name, start):
        def run():
            if name == "cosinor" and failing:
                failing.clear()
                raise RuntimeError("lost")
            started[name] = start()
            return started[name]

        return run

    restarts = job.serve({n: remembered(n, s) for n, s in starts.items()}, settings)
    assert restarts == {"dead_letter": 0, "agg_1min": 0, "cosinor": 1, "long_windows": 0}
    assert job.dropped_rows(started["agg_1min"]) == 1
    assert {r.method for r in store.read("circadian_metrics").select("method").distinct().collect()} == {"cosinor", "cwt", "isiv"}
    assert sorted(os.listdir(tmp_path / "c")) == ["agg_1min", "cosinor", "dead_letter", "long_windows"]
    for wrong in (Settings(state_backend="other", checkpoint_dir="x"), Settings()):
        with pytest.raises(ValueError):
            job.job_queries(stream, vitals.signal_dimension(spark), store, wrong)
