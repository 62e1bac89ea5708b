"""The streaming job stores all three methods, those of the batch operators."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from diurna.operators import rhythm, validate
from diurna.schema import Settings
from diurna.sources import sinks, vitals
from diurna.streaming import job

from .test_flow import T0, line, write_files


def test_job_stores_long_windows(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    r = np.random.default_rng(4)
    lines = [[line("a", "HR", 3600 * h, float(70 + 8 * np.cos(2 * np.pi * h / 24) + r.normal())) for h in range(48 * k, 48 * k + 48)] for k in range(2)]
    write_files(tmp_path / "in", lines)
    settings = Settings(window_seconds=3600, cwt_days=2, hop_hours=6, cwt_min_period_hours=2, expected_samples_per_min=1)
    dim, store = vitals.signal_dimension(spark), sinks.Store(spark, str(tmp_path / "store"))
    stream = vitals.with_event_time(vitals.json_stream(spark, str(tmp_path / "in"), 1), settings)
    for q in job.run_job(stream, dim, store, settings, str(tmp_path / "checkpoint"), available_now=True):
        q.awaitTermination()
    mark = T0 + timedelta(hours=95, seconds=-5)
    base = rhythm.tumbling(validate.valid(vitals.json_files(spark, str(tmp_path / "in")), dim), 3600, 60).where(F.col("window.end") <= F.lit(mark))
    want = rhythm.long_windows(base, 2, 6, 3600, 0.7, low=2.0).where(F.col("window_end") <= F.lit(mark)).collect()
    stored = store.read("circadian_metrics").collect()
    assert {x.method for x in stored} == {"cosinor", "cwt", "isiv"}
    assert {x.window_end: x.cri for x in stored if x.method == "cwt"} == pytest.approx({x.window_end: x.cri for x in want})
    assert {x.window_end: x.iv_variab for x in stored if x.method == "isiv"} == pytest.approx({x.window_end: x.iv_variab for x in want})
    fits = rhythm.cosinor_metrics(base, 24, 6, 24, 0.5).where(F.col("window_end") <= F.lit(mark)).collect()
    assert {x.window_end: x.amplitude for x in stored if x.method == "cosinor"} == pytest.approx({x.window_end: x.amplitude for x in fits})
