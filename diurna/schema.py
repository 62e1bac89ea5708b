"""Schemas, the signal dimension and settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import types as T

# Name, unit, least and greatest plausible value. The order is the signals' ordinal.
SIGNALS = (
    ("HR", "bpm", 20.0, 300.0),
    ("ABP_SYS", "mmHg", 30.0, 300.0),
    ("ABP_DIA", "mmHg", 10.0, 200.0),
    ("SPO2", "%", 50.0, 100.0),
    ("RR", "breaths/min", 3.0, 60.0),
)
SIGNAL_DDL = "signal_type string, unit string, min_plausible double, max_plausible double"

# Device labels, normalized, and their signals.
DEVICE_LABELS = {
    "HR": "HR", "HRECG": "HR", "PULSE": "HR", "HF": "HR", "PULS": "HR",
    "ABPS": "ABP_SYS", "NBPS": "ABP_SYS", "ARTS": "ABP_SYS",
    "ABPD": "ABP_DIA", "NBPD": "ABP_DIA", "ARTD": "ABP_DIA",
    "SPO2": "SPO2", "SAO2": "SPO2",
    "RR": "RR", "RESP": "RR", "AWRR": "RR", "AF": "RR",
}

# Normal ranges for shading.
NORMAL_RANGES = (("HR", 60.0, 100.0), ("ABP_SYS", 90.0, 140.0), ("ABP_DIA", 60.0, 90.0), ("SPO2", 94.0, 100.0), ("RR", 12.0, 20.0))

SAMPLE_JSON = T.StructType().add("patientId", "string").add("signalType", "string").add("timestamp", "timestamp").add("value", "double").add("unit", "string")
VITALS = "patient_id string, signal_type string, timestamp timestamp, value double, unit string"
DEVICE_CSV = ", ".join(f"{c} string" for c in ("c_time_stamp_numeric", "c_label", "c_sub_label", "c_value", "c_unit_label", "p_patnr"))
TABLES = {
    "agg_1min": "patient_id string, signal_type string, window_start timestamp, median double, sd double, completeness float",
    "circadian_metrics": "patient_id string, signal_type string, method string, window_end timestamp, mesor double, amplitude double, acrophase double, r2 double, cri double, is_stability double, iv_variab double",
    "ground_truth_events": "patient_id string, signal_type string, event_type string, start_time timestamp, end_time timestamp, magnitude double, params_json string",
    "ground_truth_params": "patient_id string, signal_type string, mesor double, amplitude double, acrophase double, noise_sd double",
    "experiment_runs": "run_id string, experiment string, scenario string, seed long, git_tag string, started_at timestamp, notes string",
    "dead_letter": "id long, patient_id string, signal_type string, event_time timestamp, value double, unit string, reason string, received_at timestamp",
}
KEYS = {
    "agg_1min": ("patient_id", "signal_type", "window_start"),
    "circadian_metrics": ("patient_id", "signal_type", "method", "window_end"),
    "ground_truth_events": ("patient_id", "signal_type", "event_type", "start_time"),
    "ground_truth_params": ("patient_id", "signal_type"),
    "experiment_runs": ("run_id",),
}


@dataclass(frozen=True)
class Settings:
    """Every setting has an environment variable of its name in capitals; a blank one means the default."""

    kafka_bootstrap: str = "localhost:9092"
    kafka_topic: str = "vitals-raw"
    kafka_group: str = "rhythm-pipeline"
    jdbc_url: str = ""
    jdbc_user: str = ""
    jdbc_password: str = ""
    window_seconds: int = 60
    expected_samples_per_min: int = 60
    max_out_of_orderness_seconds: int = 5
    idle_seconds: int = 60  # a global watermark needs no idleness rule
    parallelism: int = 1  # spark.sql.shuffle.partitions decides
    cosinor_hours: int = 24
    cwt_days: int = 5
    hop_hours: int = 1
    cwt_omega0: float = 6.0
    cwt_voices: int = 8
    cwt_min_period_hours: float = 0.5
    cwt_max_period_hours: float = 48.0
    band_low_hours: float = 20.0
    band_high_hours: float = 28.0
    cosinor_min_coverage: float = 0.5
    cwt_min_coverage: float = 0.7
    enable_isiv: bool = True
    checkpoint_interval_ms: int = 30_000
    checkpoint_dir: str = ""
    state_backend: str = "rocksdb"
    restart_attempts: int = 3
    restart_delay_seconds: int = 10
    jdbc_batch_size: int = 500

    def __post_init__(self) -> None:
        if self.window_seconds < 1 or 3600 % self.window_seconds and self.window_seconds % 3600:
            raise ValueError("window_seconds must divide an hour or be whole hours")
        if self.enable_isiv and self.cwt_days < 2:
            raise ValueError("stability needs cwt_days >= 2")

    @property
    def bins_per_day(self) -> int:
        return 86_400 // self.window_seconds

    @staticmethod
    def from_env(env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        found = {}
        for f in fields(Settings):
            text = (env.get(f.name.upper()) or "").strip()
            if text:
                kind = type(f.default)
                found[f.name] = text.lower() == "true" if kind is bool else kind(text)
        return Settings(**found)
