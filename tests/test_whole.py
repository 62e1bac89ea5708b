"""Registered queries do the whole job: against their SQL, or against brute force."""

import os
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from diurna.operators import rhythm

from .test_entry import rows

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def differing(spark, folder, names):
    """Names of queries whose rows aren't those of their SQL; and how many rows they have."""
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{folder}/events.parquet'")
    queries, sql = entry.queries(), entry.oracle_sql()
    differ, n = [], {}
    for name in names:
        df = queries[name](spark, folder)
        found = db.execute(sql[name])
        columns = [c[0] for c in found.description]
        want = rows(columns, [tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in found.fetchall()])
        got = rows(df.columns, df.collect())
        n[name] = len(got)
        if sorted(df.columns) != sorted(columns) or got != want:
            differ.append(name)
    return differ, n


@needs_data
def test_scalar_functions_over_every_event(spark):
    differ, n = differing(spark, DATA, ["scalar_functions"])
    assert not differ and n["scalar_functions"] == spark.read.parquet(f"{DATA}/events.parquet").count() > 500


LONG_QUERIES = ("q3_metrics", "q6_scalogram", "light_ceiling", "night_intervals", "long_windows", "band_index", "stability", "gap_fill", "scalogram", "metrics_table", "q5_overview", "q7_light", "q12_index", "q14_stability", "q18_index", "q19_status", "q20_tiles")


@pytest.fixture(scope="module")
def week(spark, tmp_path_factory):
    """Events of one patient: 6 days of two signals, an hour in nine missing."""
    folder = tmp_path_factory.mktemp("week")
    r = np.random.default_rng(3)
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h, minutes=5)
    data = [(h, at(h), 2, kind, float(np.round(40 + 9 * np.cos(2 * np.pi * h / 24) + r.normal(), 2))) for kind in ("view", "click") for h in range(144) if h % 9]
    pd.DataFrame(data, columns=["event_id", "ts", "user_id", "event_type", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(folder / "events.parquet")
    return str(folder)


def test_long_windows_end_every_hour(spark, week):
    differ, n = differing(spark, week, LONG_QUERIES)
    assert not differ
    ends = sum(sum(e - 120 <= h < e and h % 9 > 0 for h in range(144)) >= 84 for e in range(300))
    assert n["long_windows"] == 2 * ends and n["gap_fill"] == 2 * ends * 120


def test_q6_scalogram_of_the_whole_series(spark, week):
    got = entry.queries()["q6_scalogram"](spark, week).toPandas()
    events = pd.read_parquet(f"{week}/events.parquet").query("event_type == 'view'")
    assert set(got.window_end) == {int(pd.Timestamp("2024-01-07").timestamp() * 1000)} and len(got) == 37 * 143
    n = 143  # hour 0 is missing
    x = np.full(n, events.value.mean())
    x[events.event_id.to_numpy() - 1] = events.value
    spectrum = [(x * np.exp(-2j * np.pi * k * np.arange(n) / n)).sum() for k in range(1, n // 2 + 1)]
    for period, i in ((2.0, 0), (16.0, 100), (2.0 * 2 ** (29 / 8), 7), (32.0, 142)):
        s = period * (6 + 38**0.5) / (4 * np.pi)
        w = sum(c * (2 * np.pi * s) ** 0.5 * np.pi**-0.25 * np.exp(-0.5 * (s * 2 * np.pi * k / n - 6) ** 2) * np.exp(2j * np.pi * k * i / n) for k, c in enumerate(spectrum, 1)) / n
        row = got[(got.i == i) & np.isclose(got.period, period, atol=1e-5)]
        assert row.power.item() == pytest.approx(abs(w) ** 2, abs=1e-3)


def test_series_scalogram_thins_and_skips_short_series(spark):
    t0 = datetime(2024, 1, 1)
    base = spark.createDataFrame([(p, "HR", t0 + timedelta(hours=h), float(h % 24)) for p, n in (("a", 1000), ("b", 59)) for h in range(n)], "patient_id string, signal_type string, window_start timestamp, median double")
    got = rhythm.series_scalogram(base, 3600, low=2.0).toPandas()
    assert set(got.patient_id) == {"a"} and sorted(set(got.i)) == list(range(0, 1000, 2))


@needs_data
def test_replay_of_every_event_in_order(spark):
    got = entry.queries()["replay_all"](spark, DATA).toPandas()
    e = pd.read_parquet(f"{DATA}/events.parquet")
    who = "P" + (e.user_id % 2 + 1).astype(str).str.zfill(4)
    want = pd.DataFrame({"patient_id": who, "signal_type": e.event_type, "timestamp": e.ts.astype("datetime64[ms]").astype("int64"), "us": e.ts.astype("datetime64[us]").astype("int64"), "value": e.value})
    want = want.sort_values(["us", "patient_id", "signal_type", "value"]).drop(columns="us")
    assert len(got) == len(e) > 100
    assert list(got.itertuples(index=False, name=None)) == list(want.itertuples(index=False, name=None))
