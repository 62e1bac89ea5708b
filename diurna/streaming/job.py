"""The streaming job: validate, summarize, analyse, store."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from diurna.operators import rhythm, validate
from diurna.schema import Settings
from diurna.sources.sinks import Store


def summaries(samples: DataFrame, settings: Settings) -> DataFrame:
    """Base windows of a watermarked stream; rows behind the watermark are dropped."""
    per_window = settings.expected_samples_per_min * settings.window_seconds // 60
    return rhythm.tumbling(samples, settings.window_seconds, per_window)


def cosinor_stream(base: DataFrame, settings: Settings) -> DataFrame:
    """Sliding fits over base windows: the second stateful stage, in append mode."""
    return rhythm.cosinor_metrics(base, settings.cosinor_hours, settings.hop_hours, settings.bins_per_day, settings.cosinor_min_coverage)


class LongWindows(StatefulProcessor):
    """Rolling long windows: a buffer of base windows, and one timer at the next hop.

    A batch may move the watermark over many hops, so an expired timer emits every hop up to it. Rows older than any window to
    come are evicted; a key whose buffer is empty has no timer, so keys expire.
    """

    def __init__(self, settings: Settings):
        self.s = settings

    def init(self, handle) -> None:
        self.handle = handle
        self.points = handle.getMapState("points", "t long", "v double")
        self.next = handle.getValueState("next", "hop long")

    def _hop(self) -> int:
        return self.s.hop_hours * 3600

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part[~part["median"].isna()]
            for t, v in zip(part["t"].tolist(), part["median"].tolist(), strict=True):
                self.points.updateValue((t,), (v,))
                first = t if first is None else min(first, t)
        if first is not None and not self.next.exists():
            hop = (first // self._hop() + 1) * self._hop()
            self.next.update((hop,))
            self.handle.registerTimer(hop * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, hop, width = self.s, self._hop(), self.s.cwt_days * 86_400
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        at = self.next.get()[0]
        have = sorted((k[0], v[0]) for k, v in self.points.iterator())
        t, v = np.array([x[0] for x in have], np.int64), np.array([x[1] for x in have])
        n, per_day = width // s.window_seconds, s.bins_per_day
        out = []
        while at <= mark and len(t) and at <= t[-1] + width:
            a, b = np.searchsorted(t, [at - width, at])
            if b > a and b - a >= s.cwt_min_coverage * n:
                x = np.full(n, v[a:b].mean())
                x[(t[a:b] - (at - width)) // s.window_seconds] = v[a:b]
                cri = rhythm.band_index(x, s.window_seconds / 3600, s.cwt_omega0, s.cwt_min_period_hours, s.cwt_max_period_hours, s.cwt_voices, (s.band_low_hours, s.band_high_hours))
                is_, iv = rhythm.stability_of(x, per_day) if s.enable_isiv else (None, None)
                out.append((key[0], key[1], pd.Timestamp(at, unit="s"), cri, is_, iv))
            at += hop
        for k in t[t < at - width].tolist():
            self.points.removeKey((k,))
        if len(t) and t[-1] >= at - width:
            self.next.update((at,))
            self.handle.registerTimer(at * 1000)
        else:
            self.next.clear()
        if out:
            yield pd.DataFrame(out, columns=["patient_id", "signal_type", "window_end", "cri", "is_stability", "iv_variab"])

    def close(self) -> None:
        pass


def long_window_stream(base: DataFrame, settings: Settings) -> DataFrame:
    """Wavelet index and stability of every hop that the watermark has passed."""
    rows = base.where(~F.isnan("median")).select("patient_id", "signal_type", F.unix_seconds("window_start").alias("t"), "median", F.window_time("window").alias("time"))
    return rows.groupBy("patient_id", "signal_type").transformWithStateInPandas(LongWindows(settings), outputStructType=rhythm.LONG, outputMode="Append", timeMode="EventTime")


def long_metrics(rows: DataFrame, settings: Settings) -> DataFrame:
    """Long windows as rows of the methods cwt and isiv."""
    cwt = rhythm.as_metrics(rows.select("patient_id", "signal_type", "window_end", "cri"), "cwt")
    return cwt.unionByName(rhythm.as_metrics(rows.select("patient_id", "signal_type", "window_end", "is_stability", "iv_variab"), "isiv")) if settings.enable_isiv else cwt


STATE = "spark.sql.streaming.stateStore.providerClass"
PROVIDERS = {name: f"org.apache.spark.sql.execution.streaming.state.{kind}" for name, kind in (("rocksdb", "RocksDBStateStoreProvider"), ("hashmap", "HDFSBackedStateStoreProvider"))}


def configure(spark: SparkSession, settings: Settings) -> None:
    """The session's state store, and its parallelism if the settings ask for more than the default."""
    if settings.state_backend not in PROVIDERS:
        raise ValueError(f"state_backend must be one of {', '.join(PROVIDERS)}")
    spark.conf.set(STATE, PROVIDERS[settings.state_backend])
    if settings.parallelism > 1:
        spark.conf.set("spark.sql.shuffle.partitions", str(settings.parallelism))


def job_queries(samples: DataFrame, signals: DataFrame, store: Store, settings: Settings, checkpoint: str = "", available_now: bool = False) -> dict[str, Callable[[], StreamingQuery]]:
    """What starts each of the job's queries over a watermarked stream; each batch merges by key, so a replayed batch changes nothing.

    Fits and long windows are two streams of one table: their union, merged by key (which holds the method).
    """
    checkpoint = checkpoint or settings.checkpoint_dir
    if not checkpoint:
        raise ValueError("the job needs a checkpoint folder: an argument, or checkpoint_dir")
    configure(samples.sparkSession, settings)
    good = validate.valid(samples, signals)
    base = summaries(good, settings)

    def start(rows: DataFrame, name: str, sink: Callable[[DataFrame, int], None]) -> Callable[[], StreamingQuery]:
        def run() -> StreamingQuery:
            writer = rows.writeStream.queryName(name).option("checkpointLocation", f"{checkpoint}/{name}").foreachBatch(sink).outputMode("append")
            return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{settings.checkpoint_interval_ms} milliseconds")).start()

        return run

    return {
        "dead_letter": start(validate.dead_letters(samples, signals), "dead_letter", lambda rows, k: store.append_dead_letters(rows, k)),
        "agg_1min": start(base, "agg_1min", lambda rows, k: store.upsert("agg_1min", rows)),
        "cosinor": start(cosinor_stream(base, settings), "cosinor", lambda rows, k: store.upsert("circadian_metrics", rhythm.as_metrics(rows, "cosinor"))),
        "long_windows": start(long_window_stream(base, settings), "long_windows", lambda rows, k: store.upsert("circadian_metrics", long_metrics(rows, settings))),
    }


def run_job(samples: DataFrame, signals: DataFrame, store: Store, settings: Settings, checkpoint: str = "", available_now: bool = False) -> list[StreamingQuery]:
    """Start the job's queries, without supervision."""
    return [start() for start in job_queries(samples, signals, store, settings, checkpoint, available_now).values()]


def serve(starts: dict[str, Callable[[], StreamingQuery]], settings: Settings) -> dict[str, int]:
    """Run queries to their end, each supervised; how often each was started again. One that gives up ends the job with its error."""
    with ThreadPoolExecutor(len(starts)) as pool:
        ends = {name: pool.submit(supervise, start, settings.restart_attempts, settings.restart_delay_seconds) for name, start in starts.items()}
        return {name: end.result() for name, end in ends.items()}


def dropped_rows(query: StreamingQuery) -> int:
    """Rows behind the watermark that a query's stateful operators have dropped, over its recent progress."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])


def supervise(start: Callable[[], StreamingQuery], attempts: int = 3, delay_seconds: float = 10.0) -> int:
    """Run a query to its end, starting it again after failures; how often it was started again."""
    for k in range(attempts + 1):
        try:
            start().awaitTermination()
            return k
        except Exception:
            if k == attempts:
                raise
            time.sleep(delay_seconds)
    return attempts
