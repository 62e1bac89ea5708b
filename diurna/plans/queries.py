"""Named queries over an events table, and DuckDB SQL for each.

Samples: event types are signals, users are dealt to two patients; base windows are hours, so a day has 24 bins. Times are
epoch milliseconds; doubles are rounded to 4 decimals on both sides, moved by 1e-9 first since means of short decimals often lie on a tie.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from diurna.functions import scalars as S
from diurna.operators import generate, lighting, rhythm, status, validate
from diurna.schema import NORMAL_RANGES
from diurna.sources import sinks, vitals
from diurna.sources.shared import shared_root

HOUR, PER_DAY, DAYS = 3600, 24, 5
KEY = ["patient_id", "signal_type"]
ONE = "patient_id = 'P0001' and signal_type = 'view'"
Query = Callable[[SparkSession, str], DataFrame]


def ms(c: str) -> Column:
    return F.unix_millis(c).alias(c)


def r4(*names: str) -> list:
    return [F.round(F.col(c) + 1e-9, 4).alias(c) for c in names]


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return vitals.events(spark, d)


def _signals(spark: SparkSession) -> DataFrame:
    return vitals.signal_dimension(spark, vitals.EVENT_SIGNALS)


def _base(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.tumbling(validate.valid(_samples(spark, d), _signals(spark)), HOUR, 3)


def _cosinor(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.cosinor_metrics(_base(spark, d), 24, 1, PER_DAY, 0.5)


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.filled_windows(_base(spark, d), DAYS, "1 hour", HOUR, 0.7)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    long = _long(spark, d)
    return rhythm.metrics_union(_cosinor(spark, d), long, long)


def _long(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.long_windows(_base(spark, d), DAYS, 1, HOUR, 0.7, low=2.0)


def _truth(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    kinds = [(["all"], ["Click", "view"], "amplitude_drop", 48.0, 200.0, 0.25, 12.0, 0.5), (["p0001"], ["ALL"], "phase_shift", 240.0, 400.0, 6.0, 24.0, 0.5), (["P0002", "P9"], ["error"], "fragmentation", 400.0, 500.0, 0.8, 0.0, 1.5)]
    series = spark.createDataFrame([(f"P000{p}", s) for p in (1, 2) for s in ("click", "error", "purchase", "signup", "view")], "patient_id string, signal_type string")
    return series, spark.createDataFrame(kinds, generate.DISRUPTION)


def dead_letter(spark: SparkSession, d: str) -> DataFrame:
    return validate.dead_letters(_samples(spark, d), _signals(spark)).select(*KEY, ms("event_time"), "value", "unit", "reason")


def tumbling_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).select(*KEY, ms("window_start"), "n", *r4("median", "sd", "completeness"))


def cosinor(spark: SparkSession, d: str) -> DataFrame:
    return _cosinor(spark, d).select(*KEY, ms("window_end"), "n", *r4("mesor", "amplitude", "r2"), *[F.round(f(F.col("acrophase")), 4).alias(n) for f, n in ((F.cos, "cos_phase"), (F.sin, "sin_phase"))])


def gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).select(*KEY, ms("window_end"), "i", *r4("x"))


def stability(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.stability(_filled(spark, d), PER_DAY).select(*KEY, ms("window_end"), *r4("is_stability", "iv_variab"))


def band_index(spark: SparkSession, d: str) -> DataFrame:
    return rhythm.band_index_sql(_filled(spark, d), DAYS * PER_DAY).select(*KEY, ms("window_end"), *r4("cri"))


def long_windows(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).select(*KEY, ms("window_end"), *r4("cri", "is_stability", "iv_variab"))


def _spectra(filled: DataFrame) -> DataFrame:
    return rhythm.global_spectrum(filled).select(*KEY, ms("window_end"), F.round("period", 6).alias("period"), F.round("power", 3).alias("power"))


def scalogram(spark: SparkSession, d: str) -> DataFrame:
    """Global spectrum of each long window: mean power over time for each period."""
    return _spectra(_filled(spark, d))


def _last_filled(spark: SparkSession, d: str) -> DataFrame:
    """The last long window of each series."""
    filled = _filled(spark, d)
    return filled.join(filled.groupBy(*KEY).agg(F.max("window_end").alias("window_end")), [*KEY, "window_end"])


def spectrum_share(spark: SparkSession, d: str) -> DataFrame:
    """Peak period and in-band share of each global spectrum."""
    s = scalogram(spark, d).groupBy(*KEY, "window_end")
    inside = F.sum(F.when(F.col("period").between(20, 28), F.col("power")).otherwise(0.0))
    return s.agg(F.min_by("period", F.struct(-F.col("power"), F.col("period"))).alias("peak_period"), F.round(F.when(F.sum("power") > 0, inside / F.sum("power")).otherwise(0.0), 4).alias("share"))


def spectrum_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of each series' last spectrum with the patient's other signals' ones."""
    last = _spectra(_last_filled(spark, d))
    a, b = last.alias("a"), last.alias("b")
    pairs = a.join(b, (F.col("a.patient_id") == F.col("b.patient_id")) & (F.col("a.period") == F.col("b.period")) & (F.col("a.signal_type") < F.col("b.signal_type")))
    return pairs.groupBy(F.col("a.patient_id").alias("patient_id"), F.col("a.signal_type").alias("signal_a"), F.col("b.signal_type").alias("signal_b")).agg(F.round(F.corr("a.power", "b.power"), 3).alias("shape_corr"))


def metrics_table(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select(*KEY, "method", ms("window_end"), *r4("mesor", "amplitude", "acrophase", "r2", "cri", "is_stability", "iv_variab"))


def profile(spark: SparkSession, d: str) -> DataFrame:
    days = (F.max(F.unix_millis("timestamp")) - F.min(F.unix_millis("timestamp"))) / 86_400_000
    return _samples(spark, d).groupBy("signal_type").agg(F.count("*").alias("n"), F.countDistinct("patient_id").alias("n_patients"), F.min(F.unix_millis("timestamp")).alias("first"), F.max(F.unix_millis("timestamp")).alias("last"), F.round(days, 4).alias("span_days"), F.count_if(F.col("value") > 100).alias("n_high"))


def difference(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("window_start")
    return _base(spark, d).withColumn("step", F.col("median") - F.lag("median").over(w)).where("step is not null").select(*KEY, ms("window_start"), *r4("step"))


def phase_profile(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).groupBy(*KEY, F.hour("window_start").alias("hour")).agg(F.round(F.avg("median") + 1e-9, 4).alias("mean"), F.count("*").alias("n"))


def replay_all(spark: SparkSession, d: str) -> DataFrame:
    """The whole replay in order of time, as without ``--limit``."""
    return _samples(spark, d).orderBy("timestamp", "patient_id", "signal_type", "value").select(*KEY, ms("timestamp"), "value")


def replay_order(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of the replay, as with ``--limit 100``."""
    return replay_all(spark, d).limit(100)


def stride(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(*KEY)
    rows = _base(spark, d).withColumn("i", F.row_number().over(w.orderBy("window_start")) - 1).withColumn("n", F.count("*").over(w))
    return rows.where(F.col("i") % F.greatest(F.lit(1), F.ceil(F.col("n") / 90)) == 0).select(*KEY, ms("window_start"), *r4("median"))


def q1_patients(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).groupBy("patient_id").agg(F.to_json(F.array_sort(F.collect_set("signal_type"))).alias("signals"))


def q2_medians(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).where("patient_id = 'P0001' and signal_type = 'view'").orderBy("window_start").select(F.unix_millis("window_start").alias("t"), F.round(F.col("median") + 1e-9, 4).alias("value"), *r4("completeness"))


def q3_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics_table(spark, d).where(ONE).orderBy("method", "window_end").select("method", F.col("window_end").alias("t"), "mesor", "amplitude", "acrophase", "r2", "cri", "is_stability", "iv_variab")


def _events_table(spark: SparkSession) -> DataFrame:
    series, kinds = _truth(spark)
    at = lambda c: (F.lit(1_704_067_200_000) + F.col(c) * 3_600_000).cast("long")
    params = F.to_json(F.struct(F.col("ramp_hours").alias("rampHours"), F.col("bout_hours").alias("boutHours")))
    return generate.matched(series, kinds).select(*KEY, F.col("type").alias("event_type"), at("start_hour").alias("start_time"), at("end_hour").alias("end_time"), "magnitude", params.alias("params_json"))


def q4_truth(spark: SparkSession, d: str) -> DataFrame:
    return _events_table(spark).where("patient_id = 'P0001' and signal_type = 'view'").orderBy("start_time")


def q5_overview(spark: SparkSession, d: str) -> DataFrame:
    """The five sets of one series' overview as a tagged union: median, cosinor, cri, isiv, ground_truth."""
    medians = _base(spark, d).where(ONE).select(F.lit("median").alias("part"), F.unix_millis("window_start").alias("t"), *r4("median", "completeness"))
    m = metrics_table(spark, d).where(ONE)
    metrics = m.select(F.when(F.col("method") == "cwt", "cri").otherwise(F.col("method")).alias("part"), F.col("window_end").alias("t"), "amplitude", "r2", "acrophase", "mesor", "cri", "is_stability", "iv_variab")
    truth = _events_table(spark).where(ONE).select(F.lit("ground_truth").alias("part"), F.col("start_time").alias("t"), "event_type", "end_time", "magnitude")
    return medians.unionByName(metrics, allowMissingColumns=True).unionByName(truth, allowMissingColumns=True)


def q6_scalogram(spark: SparkSession, d: str) -> DataFrame:
    """The whole stored series, from its first base window to its last; window_end is the end of the last."""
    b = _base(spark, d).where("patient_id = 'P0001' and signal_type = 'view'")
    return rhythm.series_scalogram(b, HOUR, low=2.0).select(ms("window_end"), F.round("period", 6).alias("period"), "i", F.round("power", 3).alias("power"))


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return status.latest_figures(_metrics(spark, d)).where("acrophase is not null")


def q7_light(spark: SparkSession, d: str) -> DataFrame:
    """The light schedule of the dashboard's endpoint: strength is the index alone, 0 where there is none."""
    p = _latest(spark, d).where("signal_type = 'view'").select("patient_id", "acrophase", lighting.strength(F.col("cri")).alias("strength"))
    rows = lighting.schedule(p, 48, clamp_kelvin=False)
    return rows.select("patient_id", "step", *[F.round(c, 3).alias(c) for c in ("hour", "peak_hour")], F.round("intensity", 4).alias("intensity"), F.round("strength", 4).alias("cri"), F.round("cct", 0).alias("cct"), "rgb")


def light_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """The demonstration page's schedule: fits joined to indices, and where a series has no index its R2 stands in."""
    m = _metrics(spark, d)
    fits = status.latest(m, "acrophase", "cosinor").join(status.latest(m, "r2", "cosinor"), KEY, "left")
    p = fits.join(status.latest(m, "cri", "cwt"), KEY, "left").where("signal_type = 'view'")
    rows = lighting.schedule(p.select("patient_id", "acrophase", lighting.strength(F.col("cri"), F.col("r2")).alias("strength")), 48)
    return rows.select("patient_id", "step", F.round("intensity", 4).alias("intensity"), F.round("strength", 4).alias("strength"))


def night_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Nights, 18:00 to 06:00, that shade each series' span; the first may begin before it."""
    day, evening = 86_400, 18 * HOUR
    span = _base(spark, d).groupBy(*KEY).agg(F.unix_seconds(F.min("window_start")).alias("a"), (F.unix_seconds(F.max("window_start")) + HOUR).alias("b"))
    first = F.floor(F.col("a") / day) * day + evening
    span = span.withColumn("first", F.when(first > F.col("a"), first - day).otherwise(first))
    nights = span.select(*KEY, "b", F.explode(F.sequence(F.col("first"), F.col("b") - 1, F.lit(day))).alias("n"))
    return nights.select(*KEY, (F.col("n") * 1000).alias("night_start"), (F.col("n") * 1000 + 12 * HOUR * 1000).alias("night_end"))


def q8_patients(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).select("patient_id").distinct().orderBy("patient_id")


def q9_signals(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).select("signal_type").distinct().orderBy("signal_type")


def q10_panel(spark: SparkSession, d: str) -> DataFrame:
    return _base(spark, d).where("patient_id = 'P0001' and window_start between timestamp '2024-01-05' and timestamp '2024-01-12'").orderBy("signal_type", "window_start").select("signal_type", ms("window_start"), *r4("median"))


def _panel(method: str, *cols: str) -> Query:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return metrics_table(spark, d).where((F.col("method") == method) & F.col("window_end").between(1_704_412_800_000, 1_705_017_600_000)).select(*KEY, "window_end", *cols)

    return q


def q15_latest(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(F.desc("window_end"))
    rows = _cosinor(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return rows.select(*KEY, ms("window_end"), F.round(F.col("amplitude").cast("decimal(38,18)"), 2).cast("double").alias("amplitude"), F.round(F.col("r2").cast("decimal(38,18)"), 3).cast("double").alias("r2"))


def q16_disruptions(spark: SparkSession, d: str) -> DataFrame:
    return _events_table(spark).orderBy("start_time", "patient_id", "signal_type")


def q17_phase(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("patient_id").orderBy(F.desc("window_end"))
    rows = _cosinor(spark, d).where("signal_type = 'view'").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return rows.select("patient_id", *r4("acrophase", "r2"))


def q18_index(spark: SparkSession, d: str) -> DataFrame:
    return status.latest(_metrics(spark, d), "cri", "cwt").where("signal_type = 'view'").select("patient_id", *r4("cri"))


def q19_status(spark: SparkSession, d: str) -> DataFrame:
    return status.status(_metrics(spark, d)).select(*KEY, "level", "label", *r4("fit", "decline"))


def q20_tiles(spark: SparkSession, d: str) -> DataFrame:
    out = status.latest_figures(_metrics(spark, d)).where("amplitude is not null")
    span = _base(spark, d).groupBy(*KEY).agg(F.round((F.max(F.unix_millis("window_start")) - F.min(F.unix_millis("window_start"))) / 86_400_000, 4).alias("span_days"))
    return out.join(span, KEY).select(*KEY, *r4("amplitude", "r2", "cri", "is_stability", "iv_variab"), F.round(lighting.peak_hour(F.col("acrophase")), 2).alias("peak_hour"), "span_days")


def overlay(spark: SparkSession, d: str) -> DataFrame:
    """Fits that end within a disruption of their series."""
    m = cosinor(spark, d).select(*KEY, "window_end", "amplitude")
    e = _events_table(spark).select(*KEY, "event_type", "start_time", "end_time")
    return m.join(F.broadcast(e), KEY).where("window_end >= start_time and window_end < end_time").select(*KEY, "event_type", "window_end", "amplitude")


def shaded(spark: SparkSession, d: str) -> DataFrame:
    """Hours of each day part: night is 18:00 to 06:00."""
    night = (F.hour("window_start") >= 18) | (F.hour("window_start") < 6)
    return _base(spark, d).groupBy(*KEY, F.when(night, "night").otherwise("day").alias("part")).agg(F.count("*").alias("n"), F.round(F.avg("median") + 1e-9, 4).alias("mean"))


def truth_effects(spark: SparkSession, d: str) -> DataFrame:
    """What disruptions do to each series, hour by hour: factors multiply, phases and terms add."""
    series, kinds = _truth(spark)
    hours = spark.range(0, 720).select(F.col("id").cast("double").alias("h"))
    e = generate.effects(F.col("h"), F.lit(8.0))
    rows = generate.matched(series, kinds).join(F.broadcast(hours), (F.col("h") >= F.col("start_hour")) & (F.col("h") < F.col("end_hour")))
    factor = F.aggregate(F.collect_list(e["factor"]), F.lit(1.0), lambda a, x: a * x)
    return rows.groupBy(*KEY, "h").agg(F.round(factor, 4).alias("factor"), F.round(F.sum(e["phase"]), 4).alias("phase"), F.round(F.sum(e["added"]), 4).alias("added"))


def upsert(spark: SparkSession, d: str) -> DataFrame:
    """Daily medians, then the same table merged with corrections for one signal and a new key."""
    days = _samples(spark, d).groupBy(*KEY, F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top"))
    new = days.where("signal_type = 'view'").withColumn("top", F.col("top") + 1).unionByName(days.where("signal_type = 'click'").withColumn("signal_type", F.lit("tap")))
    return sinks.merged(days, new, ("patient_id", "signal_type", "day")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def insert_absent(spark: SparkSession, d: str) -> DataFrame:
    have = _samples(spark, d).where("signal_type <> 'view'").select(*KEY).distinct()
    return sinks.absent(have, _samples(spark, d).select(*KEY).distinct(), ("patient_id", "signal_type"))


DEVICE_ROWS = [
    ("2025-06-01 00:00:00.000 +02:00", "x", "HF", "71", "bpm", "7"), ("2025-06-01 00:00:01 +02:00", "SpO2", " ", " 97.5 ", "%", "7"), ("2025-06-01 00:00:02.5 +02:00", None, "ABP-S", "120", "mmHg", "8"),
    ("2025-06-01 00:00:03 +02:00", "TEMP", None, "37", "C", "7"), ("2025-06-01 00:00:04 +02:00", None, "", "1", "", "7"), ("2025-06-01 00:00:05 +02:00", "RR", None, "abc", "", "7"),
    ("x", "AWRR", None, "14", "", "7"), ("2025-06-01 00:00:07.123456 +00:00", "art d", None, "61", "mmHg", "7"), ("2025-06-01 00:00:08 +02:00", "temp", "", "", "C", "8"), ("2025-06-01 00:00:09 +02:00", "Pulse", None, None, "", "7"),
]


def _device(spark: SparkSession) -> DataFrame:
    from diurna.schema import DEVICE_CSV

    return vitals.dispositions(spark.createDataFrame(DEVICE_ROWS, DEVICE_CSV), "7")


def device_dispositions(spark: SparkSession, d: str) -> DataFrame:
    return _device(spark).groupBy("disposition").agg(F.count("*").alias("n"), F.sum(F.unix_millis("timestamp")).alias("times"))


def unmapped_labels(spark: SparkSession, d: str) -> DataFrame:
    return _device(spark).where("disposition = 'unmapped'").groupBy("raw_label").agg(F.count("*").alias("n")).orderBy("raw_label")


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    v = F.col("value")
    return e.select(
        "event_id", S.normalize_label(F.concat(F.col("event_type"), F.lit(" -x_9"))).alias("label"), S.clamp(v, 10.0, 50.0).alias("clamped"), F.round(S.lerp(2.0, 5.0, v / 100), 4).alias("lerped"),
        F.pmod(F.round(v, 0).cast("long") - 100, F.lit(24)).alias("modulo"), S.round_half_up(v).alias("half_up"), S.hop_start(F.unix_millis(F.col("ts").cast("timestamp")), 3_600_000).alias("hop"),
        S.hour_text(F.pmod(v, F.lit(24.0))).alias("hhmm"), S.hex_byte(v).alias("hex"), S.html_escape(F.concat(F.lit("<a&b>"), F.col("event_type"))).alias("html"), S.patient_name(F.col("user_id").cast("int")).alias("name"),
        S.fixed(v, 2).alias("fixed"), S.mixed_seed(F.col("user_id"), F.col("event_id"), F.lit(2), 7).alias("seed"), F.rint(v / 7).cast("long").alias("rint"), F.signum(v - 20).cast("int").alias("sign"), S.spaces_for_underscores(F.lit("a_b")).alias("words"),
    )


def colours(spark: SparkSession, d: str) -> DataFrame:
    k = spark.range(0, 50).select((F.lit(800.0) + F.col("id") * 250.0).alias("kelvin"))
    names = ("red", "green", "blue")
    clamped, free = (zip(S.kelvin_rgb(F.col("kelvin"), c), names, strict=True) for c in (True, False))
    return k.select("kelvin", *[F.round(c, 3).alias(n) for c, n in clamped], *[F.round(c, 3).alias(f"free_{n}") for c, n in free])


def normal_ranges(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(NORMAL_RANGES), "signal_type string, low double, high double")


def period_grid(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.posexplode(S.log_grid(2.0, 48.0, 8)).alias("j", "period")).select("j", F.round("period", 6).alias("period"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a watermarked stream of samples."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")  # a pattern matches one file as well as a folder of them
    s = e.select(S.patient_name((F.col("user_id") % 2 + 1).cast("int")).alias("patient_id"), F.col("event_type").alias("signal_type"), F.col("ts").cast("timestamp").alias("timestamp"), "value", F.lit("count").alias("unit"))
    return s.withWatermark("timestamp", "5 seconds")


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """The stream's base windows, over the events in one run: all that the final watermark has passed."""
    import uuid

    at = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    s = _event_stream(spark, d)
    base = rhythm.tumbling(validate.valid(s, _signals(spark)), HOUR, 3).select(*KEY, "window_start", "n", "median", "sd", "completeness")
    q = base.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(base.schema).parquet(f"{at}/out").select(*KEY, ms("window_start"), "n", *r4("median", "sd", "completeness"))


def golden_spectra(spark: SparkSession, d: str) -> DataFrame:
    """The last spectrum of each of a patient's signals, written as golden CSV, read again and pivoted: a column for each signal."""
    import uuid

    rows = _spectra(_last_filled(spark, d).where("patient_id = 'P0001'")).select(F.col("signal_type").alias("signal"), "period", "power")
    index = rows.groupBy("signal").agg((F.sum(F.when(F.col("period").between(20, 28), F.col("power")).otherwise(0.0)) / F.sum("power")).alias("cri"))
    at = f"{shared_root(spark)}/golden-{uuid.uuid4().hex}"
    for name, text in zip(("spectrum", "cri"), sinks.golden_csv(rows, index), strict=True):
        text.write.option("header", True).csv(f"{at}/{name}")
    wide, _ = vitals.golden(spark, f"{at}/spectrum", f"{at}/cri")
    return wide.select(F.round("period", 6).alias("period"), *[F.round(n, 3).alias(n) if n in wide.columns else F.lit(None).cast("double").alias(n) for n, *_ in vitals.EVENT_SIGNALS])


def stream_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The whole streaming job over the events in one run: the stored metrics of the three methods."""
    import uuid

    from diurna.schema import Settings
    from diurna.streaming import job

    at = f"{shared_root(spark)}/job-{uuid.uuid4().hex}"
    settings = Settings(window_seconds=HOUR, cwt_days=DAYS, cwt_min_period_hours=2.0)
    store = sinks.Store(spark, f"{at}/store")
    keep = spark.conf.get(job.STATE, None)
    try:
        starts = job.job_queries(_event_stream(spark, d), _signals(spark), store, settings, f"{at}/state", available_now=True)
        job.serve(starts, settings)
    finally:
        spark.conf.set(job.STATE, keep) if keep else spark.conf.unset(job.STATE)
    return store.read("circadian_metrics").select(*KEY, "method", ms("window_end"), *r4("mesor", "amplitude", "r2", "cri", "is_stability", "iv_variab"))


def queries() -> dict[str, Query]:
    named = (
        dead_letter, tumbling_aggregate, cosinor, gap_fill, stability, band_index, long_windows, scalogram, spectrum_share, spectrum_correlation, metrics_table, profile, difference, phase_profile, replay_all, replay_order, stride,
        q1_patients, q2_medians, q3_metrics, q4_truth, q5_overview, q6_scalogram, q7_light, light_ceiling, night_intervals, q8_patients, q9_signals, q10_panel, q15_latest, q16_disruptions, q17_phase, q18_index, q19_status, q20_tiles,
        overlay, shaded, truth_effects, upsert, insert_absent, device_dispositions, unmapped_labels, scalar_functions, colours, normal_ranges, period_grid, stream_tumbling, stream_metrics, golden_spectra,
    )
    out: dict[str, Query] = {f.__name__: f for f in named}
    out |= {"q11_amplitude": _panel("cosinor", "amplitude"), "q12_index": _panel("cwt", "cri"), "q13_fit": _panel("cosinor", "r2"), "q14_stability": _panel("isiv", "is_stability", "iv_variab")}
    return out


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The whole path on a small table: split, hourly summaries of all events as one series, sliding fits."""
    s = _samples(spark, d).withColumn("patient_id", F.lit("all"))
    base = rhythm.tumbling(validate.valid(s, _signals(spark)).withColumn("signal_type", F.lit("any")), HOUR, 3)
    return rhythm.cosinor_metrics(base, 24, 1, PER_DAY, 0.5).select(*KEY, ms("window_end"), "n", *r4("mesor", "amplitude", "r2"))
