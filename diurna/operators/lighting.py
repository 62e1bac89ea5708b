"""Light schedules from a rhythm's phase and strength."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.functions import scalars as S

# Weak and strong ends of the night's floor, and of colour temperature by day and by night.
NIGHT_FLOOR = (0.05, 0.25)
CCT_DAY = (6500.0, 5000.0)
CCT_NIGHT = (2300.0, 2700.0)


def peak_hour(acrophase: Column) -> Column:
    """Hour of the day of the rhythm's peak, in [0, 24)."""
    return F.pmod(-acrophase * (24 / (2 * math.pi)), F.lit(24.0))


def strength(*figures: Column) -> Column:
    """The first figure that is there (none: 0), between 0 and 1."""
    return S.clamp(F.coalesce(*figures, F.lit(0.0)), 0.0, 1.0)


def schedule(patients: DataFrame, steps: int = 96, clamp_kelvin: bool = True) -> DataFrame:
    """``patients (patient_id, acrophase, strength)`` to a row for each step of the day."""
    if steps < 1:
        raise ValueError("steps must be positive")
    s = S.clamp(F.coalesce("strength", F.lit(0.0)), 0.0, 1.0)
    rows = patients.select("patient_id", peak_hour(F.col("acrophase")).alias("peak_hour"), s.alias("strength"), F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    hour = F.col("step") * (24.0 / steps)
    shape = 0.5 * (1 + F.cos((hour - F.col("peak_hour")) * (2 * math.pi / 24)))
    floor = S.lerp(*NIGHT_FLOOR, F.col("strength"))
    night = S.lerp(*CCT_NIGHT, F.col("strength"))
    rows = rows.withColumn("hour", hour).withColumn("intensity", floor + (1 - floor) * shape).withColumn("cct", night + (S.lerp(*CCT_DAY, F.col("strength")) - night) * shape)
    red, green, blue = S.kelvin_rgb(F.col("cct"), clamp_kelvin)
    return rows.withColumn("hex", F.concat(F.lit("#"), *(S.hex_byte(c) for c in (red, green, blue)))).withColumn("at", S.hour_text(F.col("hour"))).withColumn("rgb", F.concat(F.lit("rgb("), F.concat_ws(",", *(F.floor(c).cast("string") for c in (red, green, blue))), F.lit(")")))


def brightest(rows: DataFrame) -> DataFrame:
    """Each patient's brightest step, the first of equals."""
    return rows.groupBy("patient_id").agg(F.min_by("hour", F.struct(-F.col("intensity"), F.col("hour"))).alias("hour"), F.max("intensity").alias("intensity"))
