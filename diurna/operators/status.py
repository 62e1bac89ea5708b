"""Rhythm status and the figures beside it, from stored metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("patient_id", "signal_type")


def latest(metrics: DataFrame, value: str, method: str) -> DataFrame:
    """Each series' last value that isn't null or NaN."""
    ok = F.col(value).isNotNull() & ~F.isnan(value)
    return metrics.where((F.col("method") == method) & ok).groupBy(*KEY).agg(F.max_by(value, "window_end").alias(value))


# each figure and the method that gives it
FIGURES = {"amplitude": "cosinor", "acrophase": "cosinor", "r2": "cosinor", "cri": "cwt", "is_stability": "isiv", "iv_variab": "isiv"}


def latest_figures(metrics: DataFrame) -> DataFrame:
    """``latest`` of every figure beside each other, in one pass; null where a series has none."""

    def last(value: str, method: str) -> Column:
        ok = (F.col("method") == method) & F.col(value).isNotNull() & ~F.isnan(value)
        return F.max_by(value, F.when(ok, F.col("window_end"))).alias(value)

    return metrics.groupBy(*KEY).agg(*[last(v, m) for v, m in FIGURES.items()])


def upper_median(values: Column) -> Column:
    """The middle of the sorted values, the upper one of two."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def amplitude_slices(metrics: DataFrame) -> DataFrame:
    """Upper medians of the first third and the last sixth (three at least) of each series' amplitudes, and their number."""
    rows = metrics.where((F.col("method") == "cosinor") & F.col("amplitude").isNotNull() & ~F.isnan("amplitude"))
    w = Window.partitionBy(*KEY)
    rows = rows.withColumn("i", F.row_number().over(w.orderBy("window_end"))).withColumn("n", F.count("*").over(w))
    first, last = F.greatest(F.lit(3), F.floor(F.col("n") / 3)), F.greatest(F.lit(3), F.floor(F.col("n") / 6))
    sides = rows.groupBy(*KEY).agg(F.max("n").alias("n_amplitudes"), F.collect_list(F.when(F.col("i") <= first, F.col("amplitude"))).alias("a"), F.collect_list(F.when(F.col("i") > F.col("n") - last, F.col("amplitude"))).alias("b"))
    return sides.select(*KEY, "n_amplitudes", upper_median(F.col("a")).alias("base"), upper_median(F.col("b")).alias("current"))


def status(metrics: DataFrame) -> DataFrame:
    """``(patient_id, signal_type, level, label, fit, decline)``; the first rule that holds decides."""
    rows = latest_figures(metrics).join(amplitude_slices(metrics), [*KEY], "left")
    fit = F.coalesce("r2", "cri")
    decline = F.when(F.col("n_amplitudes") >= 8, F.when(F.col("base") > 0, 1 - F.col("current") / F.col("base")).otherwise(0.0))
    rows = rows.withColumn("fit", fit).withColumn("decline", decline)
    cases = [
        ("n_amplitudes is null and fit is null", "none", "No rhythm metrics"),
        ("fit < 0.3", "crit", "Rhythm disrupted"),
        ("decline >= 0.65", "crit", "Rhythm disrupted"),
        ("decline >= 0.4", "warn", "Rhythm weakened"),
        ("fit < 0.5", "warn", "Rhythm weak"),
    ]
    level, label = F.lit("good"), F.lit("Rhythm preserved")
    for rule, a, b in reversed(cases):
        level, label = F.when(F.expr(rule), a).otherwise(level), F.when(F.expr(rule), b).otherwise(label)
    return rows.select(*KEY, level.alias("level"), label.alias("label"), "fit", "decline")
