"""Shared pieces of the training-data operators: the shared scratch folder, Arrow mapping, connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.sources.shared import shared_root


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_LIVE: dict[str, None] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; what is still there is removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/diurna/{name}-{uuid.uuid4().hex}"
    if not _LIVE:
        atexit.register(forget, spark)
    _LIVE[path] = None
    return path


def forget(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove scratch folders, all of them by default."""
    for path in list(_LIVE) if paths is None else paths:
        if path in _LIVE:
            with contextlib.suppress(Exception):  # the session may be gone
                drop_path(spark, path)
            _LIVE.pop(path, None)


@contextlib.contextmanager
def owned() -> Iterator[list[str]]:
    """The scratch folders made inside, in a list that is filled at the end."""
    before, made = set(_LIVE), []
    yield made
    made += [p for p in _LIVE if p not in before]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for t in tables:
        forget(t.sparkSession, [t._scratch])


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files whose frames are gone, before the next large exchange."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"}  # Spark's default, or what small_batches set last


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Long texts: bound the rows of an Arrow batch in this session, unless its user has set another bound than the default."""
    for key, ours in _BATCH.items():
        if spark.conf.get(key, "10000") in ("10000", ours):
            spark.conf.set(key, str(rows))
            _BATCH[key] = str(rows)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def fitted(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object | None:
    """What ``fit`` makes of a bounded table, in one task, so that the driver holds the result alone; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(held).combine_chunks()))], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column of one chunk."""
    flat = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    offsets = np.asarray(flat.offsets)
    return flat.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


@contextlib.contextmanager
def set_aside(docs: DataFrame, names: tuple[str, ...]) -> Iterator[tuple[DataFrame, Callable[[DataFrame], DataFrame]]]:
    """docs with columns of these names renamed, and what gives docs' own columns back."""
    other = {c: f"own {i} {c}" for i, c in enumerate(docs.columns) if c.lower() in names}
    yield docs.withColumnsRenamed(other), lambda df: df.select(*[F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for the graph with edges a-b, in memory, by minimum labels with pointer jumping."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(edges: DataFrame) -> DataFrame:
    """Each task replaces its edges by stars with the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nodes, roots = forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            keep = nodes != roots
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= 2 * FEW:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return edges.mapInArrow(run, "u long, v long")


FEW = 1 << 20  # links that one task may finish: 16 MB


def _mark(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` links to ``(u, v)`` with v the smallest id reachable from u, for each u that isn't that id itself.

    Tasks contract their own links to stars first. If at most ``FEW`` links are left then, one task finishes them. Else large-star
    and small-star steps alternate until nothing changes: each step is a mergeable minimum and a join whose large side Spark
    may split, so a hub isn't gathered in one task; each round is a stored table.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = stored(_contract(e).distinct(), "links")
    mark = _mark(e)
    if not mark[0]:
        return e
    if mark[0] <= FEW:
        out = stored(_contract(e.coalesce(1)), "links")
        discard(e)
        return out
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        old, e = e, stored(small, "links")
        discard(old)
        now = _mark(e)
        if now == mark:
            return e
        mark = now
