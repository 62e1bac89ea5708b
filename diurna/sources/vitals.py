"""Sources of samples: JSON lines from files, streams or Kafka, device CSV exports, event tables, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.functions import scalars as S
from diurna.schema import DEVICE_CSV, SAMPLE_JSON, SIGNAL_DDL, SIGNALS, TABLES, Settings
from diurna.sources.sinks import INDEX_CSV, SPECTRUM_CSV


def signal_dimension(spark: SparkSession, rows=SIGNALS) -> DataFrame:
    return spark.createDataFrame(list(rows), SIGNAL_DDL)


def decode_json(lines: DataFrame, signals: tuple[str, ...] = tuple(s[0] for s in SIGNALS)) -> DataFrame:
    """Samples of a ``value`` column. Malformed lines, unknown signals and rows without key or time go; unknown fields don't matter.

    A missing value reads as 0.0, so that validation rejects it visibly.
    """
    x = F.from_json(F.col("value").cast("string"), SAMPLE_JSON, {"mode": "PERMISSIVE"})
    rows = lines.select(x.alias("x")).select(F.col("x.patientId").alias("patient_id"), F.col("x.signalType").alias("signal_type"), F.col("x.timestamp").alias("timestamp"), F.coalesce("x.value", F.lit(0.0)).alias("value"), F.col("x.unit").alias("unit"))
    return rows.where(F.col("patient_id").isNotNull() & F.col("timestamp").isNotNull() & F.col("signal_type").isin(*signals))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    return decode_json(spark.read.text(path))


def json_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    return decode_json((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path))


def kafka_stream(spark: SparkSession, settings: Settings) -> DataFrame:  # pragma: no cover - needs a broker and its connector
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", settings.kafka_bootstrap).option("subscribe", settings.kafka_topic)
    return decode_json(stream.option("kafka.group.id", settings.kafka_group).option("startingOffsets", "earliest").load())


def with_event_time(samples: DataFrame, settings: Settings) -> DataFrame:
    """The watermark: greatest time seen less the allowed disorder."""
    return samples.withWatermark("timestamp", f"{settings.max_out_of_orderness_seconds} seconds")


def device_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(DEVICE_CSV).csv(path)


def dispositions(rows: DataFrame, patient: str | None = None) -> DataFrame:
    """Device rows with ``signal_type, timestamp, value, raw_label`` and what becomes of them.

    Checked in this order: label, patient, value, time.
    """
    label = S.first_non_blank(F.col("c_sub_label"), F.col("c_label"))
    out = rows.withColumn("raw_label", F.coalesce(label, F.lit("(blank)"))).withColumn("signal_type", S.signal_of_label(label)).withColumn("value", S.parse_double(F.col("c_value"))).withColumn("timestamp", S.parse_offset_time(F.col("c_time_stamp_numeric")))
    other = F.coalesce(F.trim("p_patnr") != patient, F.lit(True)) if patient else F.lit(False)
    what = F.when(F.col("signal_type").isNull(), "unmapped").when(other, "filtered").when(F.col("value").isNull(), "badValue").when(F.col("timestamp").isNull(), "badTime").otherwise("ok")
    return out.withColumn("disposition", what)


def replay(rows: DataFrame, patient: str | None = None, limit: int = 0) -> DataFrame:
    """Samples of device rows in order of time; the first ``limit``, 0 for all."""
    ok = dispositions(rows, patient).where("disposition = 'ok'").select(F.trim("p_patnr").alias("patient_id"), "signal_type", "timestamp", "value", F.col("c_unit_label").alias("unit"))
    ordered = ok.orderBy("timestamp", "patient_id", "signal_type", "value")
    return ordered.limit(limit) if limit else ordered


# Ranges that stand in for plausibility where an event table stands in for a feed.
EVENT_SIGNALS = (("click", "count", 1.0, 200.0), ("error", "count", 1.0, 150.0), ("purchase", "count", 2.0, 180.0), ("signup", "count", 1.0, 160.0), ("view", "count", 0.5, 170.0))


def events(spark: SparkSession, sf_dir: str, patients: int = 2) -> DataFrame:
    """An events table as samples: event types are signals, users are dealt to ``patients``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    who = S.patient_name((F.col("user_id") % patients + 1).cast("int"))
    return e.select(who.alias("patient_id"), F.col("event_type").alias("signal_type"), F.col("ts").cast("timestamp").alias("timestamp"), "value", F.lit("count").alias("unit"))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def golden(spark: SparkSession, spectrum: str, index: str) -> tuple[DataFrame, DataFrame]:
    """(a row for each period with a column for each signal's power, indices) of CSV files with headers."""
    read = lambda path, schema: spark.read.option("header", True).schema(schema).csv(path)
    return read(spectrum, SPECTRUM_CSV).groupBy("period").pivot("signal").agg(F.first("power")), read(index, INDEX_CSV)


def jdbc_table(spark: SparkSession, settings: Settings, name: str) -> DataFrame:  # pragma: no cover - needs a database
    return spark.read.format("jdbc").options(url=settings.jdbc_url, dbtable=name, user=settings.jdbc_user, password=settings.jdbc_password).load()


# Illustrative patients for an empty store: acrophase in radians, R2, band-power index.
EXAMPLES = (("P-early", -1.8, 0.85, 0.80), ("P-noon", -3.2, 0.60, 0.45), ("P-late", -4.6, 0.35, 0.15))


def or_examples(latest: DataFrame) -> DataFrame:
    """``(patient_id, acrophase, r2, cri)``, or illustrative rows if there are none."""
    if latest.head(1):
        return latest
    return latest.sparkSession.createDataFrame(list(EXAMPLES), "patient_id string, acrophase double, r2 double, cri double")
