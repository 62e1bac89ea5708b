"""Near-duplicate embeddings by PCA-ordered, tiled comparison.

Rows are compared only with rows of an equal, non-null label and equal length. Identical vectors of a label are one class
from the start. The principal axes of all unit vectors (a Spark sum of second moments, as large as dim squared) order
the coordinates. Classes are dealt to cells of the leading coordinate, large cells to tiles of bounded size; two unit
vectors with cosine >= t differ by at most sqrt(2 - 2t) in it, so only tiles of near cells meet, through a Spark
equi-join. In a pair of tiles, products of leading dimensions accumulate chunk by chunk; by Cauchy-Schwarz the rest adds
at most the product of the suffix norms, and a pair is given up once that can't reach the threshold. Survivors are
verified by the plain cosine in double precision.

A pair of tiles returns a link count for each class and a star forest, not its links. Vectors that are null, empty, zero or
hold null or non-finite components, and rows without id or label, link with nothing. Rows that repeat an id are rows
like others for the counts and one node of the graph. A cosine equal to the threshold (a tie) links. A table without rows
gives none; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TILE = 1024
CELL = 0.05
CHUNK = 16
SLACK = 1e-9  # of rounding in rotated products


def valid(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """``(vec_id, label, dim, v)`` of the rows that may link."""
    v = F.col("v")
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and size(v) > 0")
    rows = rows.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.where(F.exists(v, lambda x: x != 0)).select("vec_id", "label", F.size(v).alias("dim"), "v")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vector, an orthogonal matrix whose columns are the principal axes, strongest first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                x = unit(matrix(batch.column(1).filter(pa.array(dims == d))))
                x1 = np.hstack([x, np.ones((len(x), 1))])
                held[d] = held.get(d, 0) + x1.T @ x1
        for d, m in held.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(m.ravel())], names=["dim", "i", "j", "x"])

    sums = classes.select("dim", "v").mapInArrow(moments, "dim int, i int, j int, x double").groupBy("dim", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    axes = {}
    for d, part in sums.groupby("dim"):
        m = np.zeros((d + 1, d + 1))
        m[part["i"], part["j"]] = part["x"]
        mean = m[:d, d] / m[d, d]
        values, basis = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))
        axes[int(d)] = np.ascontiguousarray(basis[:, np.argsort(values)[::-1]])
    return axes


def linked(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of rows of a and b with cosine >= threshold."""
    x, y = unit(a) @ axes, unit(b) @ axes
    d = x.shape[1]
    rest_x = np.sqrt(np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1])
    rest_y = np.sqrt(np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1])
    c = min(CHUNK, d)
    part = x[:, :c] @ y[:, :c].T
    if c < d:
        bound = part + rest_x[:, c, None] * rest_y[None, :, c]
        i, j = np.nonzero(bound >= threshold - SLACK)
    else:
        i, j = np.nonzero(part >= threshold - SLACK)
    total = part[i, j]
    while c < d and len(i):
        n = min(c + CHUNK, d)
        total = total + np.einsum("ij,ij->i", x[i, c:n], y[j, c:n])
        c = n
        left = rest_x[i, c] * rest_y[j, c] if c < d else 0.0
        ok = total + left >= threshold - SLACK
        i, j, total = i[ok], j[ok], total[ok]
    if not len(i):
        return i, j
    # the same scale for both keeps the cosine and avoids overflow
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    exact = np.einsum("ij,ij->i", a[i], b[j]) / (np.sqrt((a * a).sum(axis=1))[i] * np.sqrt((b * b).sum(axis=1))[j])
    ok = exact >= threshold
    return i[ok], j[ok]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = TILE, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of vectors."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = vectors.sparkSession
    rows = common.stored(valid(vectors, id, vector, label), "vectors")
    classes = common.stored(rows.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).withColumn("class", F.xxhash64("label", "v", "node")), "classes")
    axes = spark.sparkContext.broadcast(principal_axes(classes))
    reach = int(np.ceil(np.sqrt(max(0.0, 2 - 2 * threshold)) / CELL + 1e-6))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column(0).to_numpy()
        cell = np.zeros(len(dims), np.int32)
        for d in np.unique(dims).tolist():
            x = unit(matrix(batch.column(1).filter(pa.array(dims == d)))) @ axes.value[d][:, 0]
            cell[dims == d] = np.floor(x / CELL)
        return pa.RecordBatch.from_arrays([pa.array(cell), *[batch.column(i) for i in range(len(batch.columns))]], names=["cell", *batch.schema.names])

    kind = classes.schema["label"].dataType.simpleString()
    placed = common.map_batches(classes.select("dim", "v", "label", "node", "n", "class"), place, f"cell int, dim int, v array<double>, label {kind}, node long, n long, class long")
    placed = common.stored(placed, "cells")
    parts = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    tiles = placed.join(parts, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("class", "node"), F.col("parts")).cast("int"))
    # dealt by part as well: a frequent cell's tiles are as many tasks' work
    place = ["label", "dim", "cell", "part"]
    tiles = tiles.repartition(*place).groupBy(*place).agg(F.collect_list(F.struct("class", "node", "n", "v")).alias("rows"), F.first("parts").alias("parts"))
    tiles = common.stored(tiles, "tiles")
    there = tiles.select("label", "dim", F.col("cell").alias("cell_a"), F.col("part").alias("part_a"), F.col("rows").alias("rows_a"), F.explode(F.sequence(F.col("cell"), F.col("cell") + reach)).alias("cell"))
    sizes = tiles.select("label", "dim", "cell", "parts").distinct()
    there = there.join(sizes, ["label", "dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").where("cell > cell_a or part >= part_a")
    pairs = there.join(tiles.drop("parts"), place).select("dim", "rows_a", "rows", ((F.col("cell") == F.col("cell_a")) & (F.col("part") == F.col("part_a"))).alias("same"))

    def unpack(rows: pa.ListScalar) -> tuple[np.ndarray, ...]:
        s = rows.values
        return s.field(0).to_numpy(), s.field(1).to_numpy(), s.field(2).to_numpy(), matrix(s.field(3))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ca, na, wa, a = unpack(batch.column(1)[k])
                cb, nb, wb, b = unpack(batch.column(2)[k])
                same = batch.column(3)[k].as_py()
                i, j = linked(a, b, axes.value[batch.column(0)[k].as_py()], threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                more_a = np.bincount(i, wb[j], len(ca)).astype(np.int64)
                more_b = np.bincount(j, wa[i], len(cb)).astype(np.int64)
                u, v = common.forest(na[i], nb[j])
                u, v = u[u != v], v[u != v]
                both = np.concatenate([na[more_a > 0], nb[more_b > 0]])
                more = np.concatenate([more_a[more_a > 0], more_b[more_b > 0]])
                of = np.concatenate([np.zeros(len(u), np.int64), ca[more_a > 0], cb[more_b > 0]])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([True, False], [len(u), len(both)])), pa.array(np.concatenate([u, both])), pa.array(np.concatenate([v, more])), pa.array(of)], names=["link", "a", "b", "class"])

    with common.batches_of(spark, 16):  # a row is a pair of tiles
        found = common.stored(pairs.mapInArrow(compare, "link boolean, a long, b long, class long"), "found")
    roots = common.connected_components(found.where("link").select(F.col("a").alias("u"), F.col("b").alias("v")))
    counts = found.where("not link").groupBy(F.col("a").alias("node"), "class").agg(F.sum("b").alias("more"))
    per_class = classes.join(counts, ["node", "class"], "left").select("label", "v", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), "node")
    # a row's node is its own id; the class links it to the smallest id of its copies
    own = rows.join(per_class, ["label", "v"]).select("vec_id", "node", "n_links")
    linked_rows = own.join(roots.withColumnRenamed("u", "node").withColumnRenamed("v", "root"), "node", "left").select("vec_id", "n_links", F.coalesce("root", "node").alias("component_id"))
    rest = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    v = F.col("v")
    bad = F.col("vec_id").isNull() | F.col("label").isNull() | F.coalesce(F.size(v) <= 0, F.lit(True)) | F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    lone = rest.where(bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_rows.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
