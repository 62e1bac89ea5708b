"""Sinks: keyed merges of tables, appends, insert-if-absent, JSON lines, formatted CSV."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.schema import KEYS, TABLES, Settings


def merged(old: DataFrame, new: DataFrame, keys: tuple[str, ...], order: Column | None = None) -> DataFrame:
    """old with new's rows put in or replaced by key; of several new rows with a key the last by ``order``.

    Mergeable aggregation with partial sums, so a key with many rows isn't gathered.
    """
    new = new.withColumn("_o", order if order is not None else F.lit(0)).withColumn("_n", F.lit(1))
    rows = old.withColumn("_o", F.lit(None).cast(new.schema["_o"].dataType)).withColumn("_n", F.lit(0)).unionByName(new)
    values = [c for c in old.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct("_n", "_o", F.xxhash64(*values)))
    return rows.groupBy(*keys).agg(last.alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values]).select(old.columns)


def absent(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """new's rows whose key old lacks."""
    return new.join(old.select(*keys), [*keys], "left_anti")


def conform(rows: DataFrame, table: str) -> DataFrame:
    """A table's columns and types; NaN becomes null."""
    schema = rows.sparkSession.createDataFrame([], TABLES[table]).schema
    have = set(rows.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        if f.name in have and f.dataType.simpleString() in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(f.name))
    return rows.select(*cols)


# the column whose day parts a table; tables without one are a single part
DAYS = {"agg_1min": "window_start", "circadian_metrics": "window_end", "ground_truth_events": "start_time"}


class Store:
    """Parquet tables below a folder, in parts by day. A merge writes new versions of the parts that it touches, and no others.

    A version counts once its writer has committed it, so readers see whole versions. Of each part the latest ``keep`` versions
    stay, for readers that have opened an older one.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._lock = threading.RLock()  # several queries merge into a table: one at a time reads a version and writes the next
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def parts(self, name: str) -> dict[str, list[str]]:
        """The folders of each part's versions, oldest first."""
        out: dict[str, list[str]] = {}
        for version in self._list(f"{self.root}/{name}"):
            inside = self._list(f"{self.root}/{name}/{version}")
            for part in inside if "_SUCCESS" in inside else ():
                if part.startswith("part="):
                    out.setdefault(part[5:], []).append(f"{self.root}/{name}/{version}/{part}")
        return out

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(*folders) if folders else self.spark.createDataFrame([], TABLES[name])

    def read(self, name: str) -> DataFrame:
        return self._read(name, [versions[-1] for versions in self.parts(name).values()])

    def _part(self, name: str) -> Column:
        return F.coalesce(F.date_format(DAYS[name], "yyyyMMdd"), F.lit("none")) if name in DAYS else F.lit("all")

    def _merge(self, name: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        with self._lock:
            rows = rows.persist()  # a batch: read once for its days and once for its rows
            have = self.parts(name)
            days = [r[0] for r in rows.select(self._part(name).alias("part")).distinct().collect()]
            old = self._read(name, [have[d][-1] for d in days if d in have])
            number = 1 + max((int(v.split("-")[1]) for v in self._list(f"{self.root}/{name}")), default=-1)
            merge(old, rows).withColumn("part", self._part(name)).write.partitionBy("part").parquet(f"{self.root}/{name}/v-{number:012d}-{uuid.uuid4().hex[:8]}")
            rows.unpersist()
            for d in days:
                for gone in have.get(d, [])[: -(self.keep - 1) or None]:
                    self._fs.delete(self._path(gone), True)

    def upsert(self, name: str, rows: DataFrame, order: Column | None = None) -> None:
        self._merge(name, conform(rows, name), lambda old, new: merged(old, new, KEYS[name], order))

    def insert_absent(self, name: str, rows: DataFrame) -> None:
        self._merge(name, conform(rows, name), lambda old, new: old.unionByName(absent(old, new, KEYS[name])))

    def append_dead_letters(self, rows: DataFrame, batch: int = 0) -> None:
        """Rejects with surrogate ids; a batch that is replayed replaces its own rows."""
        path = f"{self.root}/dead_letter_log/batch={batch}"
        conform(rows.withColumn("id", F.monotonically_increasing_id()).withColumn("received_at", F.current_timestamp()), "dead_letter").write.mode("overwrite").parquet(path)

    def dead_letters(self) -> DataFrame:
        return self.spark.read.schema(TABLES["dead_letter"] + ", batch long").option("basePath", f"{self.root}/dead_letter_log").parquet(f"{self.root}/dead_letter_log")


def upsert_sql(name: str, staging: str) -> str:
    """The statement that merges a staging table's rows into a table by its key."""
    columns = [c.split()[0] for c in TABLES[name].split(", ")]
    keys = KEYS[name]
    sets = ", ".join(f"{c} = excluded.{c}" for c in columns if c not in keys)
    return f"insert into {name} ({', '.join(columns)}) select {', '.join(columns)} from {staging} on conflict ({', '.join(keys)}) do update set {sets}"


def jdbc_upsert(rows: DataFrame, settings: Settings, name: str) -> None:  # pragma: no cover - needs a database
    """A keyed merge: executors write a staging table in batches, then one statement merges it, so a replayed batch changes nothing."""
    staging = f"{name}_{uuid.uuid4().hex[:8]}"
    options = {"url": settings.jdbc_url, "user": settings.jdbc_user, "password": settings.jdbc_password}
    conform(rows, name).write.format("jdbc").options(**options, dbtable=staging, batchsize=settings.jdbc_batch_size).mode("overwrite").save()
    link = rows.sparkSession.sparkContext._jvm.java.sql.DriverManager.getConnection(settings.jdbc_url, settings.jdbc_user, settings.jdbc_password)
    try:
        with_statement = link.createStatement()
        with_statement.executeUpdate(upsert_sql(name, staging))
        with_statement.executeUpdate(f"drop table {staging}")
    finally:
        link.close()


# The producer's settings.
PRODUCER = {"kafka.acks": "1", "kafka.linger.ms": "20", "kafka.batch.size": str(64 * 1024)}


def kafka(samples: DataFrame, settings: Settings) -> None:  # pragma: no cover - needs a broker and its connector
    """Samples as messages of the settings' topic."""
    json_lines(samples).write.format("kafka").options(**PRODUCER, **{"kafka.bootstrap.servers": settings.kafka_bootstrap, "topic": settings.kafka_topic}).save()


def paced(samples: DataFrame, write: Callable[[DataFrame], None], speed: float = 0.0, slice_seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> int:
    """Write samples slice by slice of their time, each when it is due at ``speed`` times real time; 0: all at once. The number of slices.

    A slice is one distributed write; the driver only waits between them.
    """
    if speed <= 0:
        write(samples)
        return 1
    at = F.unix_micros("timestamp") / F.lit(1e6)
    span = samples.agg(F.min(at), F.max(at)).first()
    if span[0] is None:
        return 0
    began = clock()
    n = int((span[1] - span[0]) // slice_seconds) + 1
    for k in range(n):
        if (due := began + k * slice_seconds / speed - clock()) > 0:
            sleep(due)
        low = span[0] + k * slice_seconds
        write(samples.where((at >= low) & (at < low + slice_seconds)))
    return n


def json_lines(samples: DataFrame) -> DataFrame:
    """``(key, value)`` messages; the key is the patient."""
    time = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.struct(F.col("patient_id").alias("patientId"), F.col("signal_type").alias("signalType"), time.alias("timestamp"), "value", "unit")
    return samples.select(F.col("patient_id").alias("key"), F.to_json(body).alias("value"))


SPECTRUM_CSV, INDEX_CSV = "signal string, period double, power double", "signal string, cri double"


def golden_csv(spectrum: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spectra with 8 decimals of the mantissa, indices with 6 decimals, as text."""
    return spectrum.select("signal", "period", F.format_string("%.8e", "power").alias("power")), index.select("signal", F.format_string("%.6f", "cri").alias("cri"))
