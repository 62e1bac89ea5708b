"""Plausibility: valid samples and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _judged(samples: DataFrame, signals: DataFrame) -> DataFrame:
    # a closed dimension: one row for each kind of signal
    bounds = F.broadcast(signals.select("signal_type", "min_plausible", "max_plausible"))
    ok = F.coalesce(F.col("value").between(F.col("min_plausible"), F.col("max_plausible")), F.lit(False))
    return samples.join(bounds, "signal_type", "left").withColumn("ok", ok)


def valid(samples: DataFrame, signals: DataFrame) -> DataFrame:
    """Samples within their signal's bounds, both included; NaN and null aren't."""
    return _judged(samples, signals).where("ok").select(samples.columns)


def dead_letters(samples: DataFrame, signals: DataFrame) -> DataFrame:
    """The others, with a reason."""
    reason = F.coalesce(F.format_string("out_of_range[%.1f,%.1f]", "min_plausible", "max_plausible"), F.lit("unknown_signal"))
    reason = F.when(F.col("min_plausible").isNull(), "unknown_signal").otherwise(reason)
    return _judged(samples, signals).where("not ok").select("patient_id", "signal_type", F.col("timestamp").alias("event_time"), "value", "unit", reason.alias("reason"))
