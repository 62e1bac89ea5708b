"""Exact top-k inner products by a threshold algorithm over sorted per-dimension lists.

Each component becomes floor(scale * x) in double precision; the score is the integer inner product. All rows are dealt to
blocks of bounded size. In a block each dimension has its list of rows in order of value; for a query the lists are
read from the end its sign favours, to growing depths. Rows met for the first time are scored in full. No unseen row can
score above the sum of the query's components times the values at the current depth, so a query stops once that bound
is below its k-th score (equal: it goes on, a smaller id may come). The blocks' winners are merged by a ranked window.

Components stay doubles until a block knows how large they are: products are exact in doubles, else in 64-bit integers, else
in integers of any size. A score that no 64-bit integer holds ranks by its exact value and is returned as the nearest one that does.

Vectors that are null or empty or hold null or non-finite components take no part; vectors of another length than the
query's are no candidates for it. Rows without an id take no part. Rows that repeat an id are candidates like others (and
queries like others: a query id that occurs n times is one query, with its smallest row), but none for a query of their own id.
Ties go to the smaller id; of rows that repeat id and score each counts. Tables without rows, and queries without candidates,
give none; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 16_384
TILE = 8192  # queries that meet a block in one task
DEPTHS = 4  # each round reads so many times as deep as the last


def quantized(vectors: DataFrame, scale: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, q array<double>, dim)`` of the rows that take part; q holds whole numbers."""
    v = F.col("v")
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.select("vec_id", F.transform(v, lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale)).alias("q"), F.size(v).alias("dim"))


def whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, as integers of any size."""
    return np.array([int(c) for c in x.ravel()], object).reshape(x.shape)


class Lists:
    """The sorted lists of one block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows.astype(np.float64)
        self.order = np.argsort(rows, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(self.rows.T, self.order, axis=1)
        self.largest = float(np.abs(rows).max()) if rows.size else 0.0

    def products(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products, of the least kind of number that holds them."""
        most = self.largest * float(np.abs(q).max(initial=0)) * len(q)
        if most < 2.0**52:
            return (rows @ q).astype(np.int64)
        if most < 2.0**62:
            return rows.astype(np.int64) @ q.astype(np.int64)
        return whole(rows) @ whole(q)

    def top(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows of other ids."""
        n, q = len(self.ids), q.astype(np.float64)
        dims = np.flatnonzero(q)
        up = q[dims] > 0
        seen = np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), self.products(self.rows[:0], q)
        depth = 16
        while True:
            depth = min(depth, n) if len(dims) else n
            if depth >= n:
                new = np.flatnonzero(~seen)
            else:
                met = np.zeros(n, bool)
                met[self.order[dims[up], n - depth :]] = True
                met[self.order[dims[~up], :depth]] = True
                new = np.flatnonzero(met & ~seen)
            seen[new] = True
            new = new[self.ids[new] != own]
            s = self.products(self.rows[new], q)
            if len(scores) >= k:
                keep = s >= scores.min()
                new, s = new[keep], s[keep]
            ids, scores = np.concatenate([ids, self.ids[new]]), np.concatenate([scores, s])
            best = np.lexsort((ids, -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
            ids, scores = ids[best], scores[best]
            if depth >= n:
                return ids, scores
            edge = np.where(up, self.sorted[dims, n - depth], self.sorted[dims, depth - 1])
            if len(scores) == k and self.products(edge[None, :], q[dims])[0] < scores[-1]:
                return ids, scores
            depth *= DEPTHS


def rank_key(score: int) -> tuple[int, str]:
    """Sorts scores that no 64-bit integer holds: above or below all others, then by digits."""
    if -(1 << 63) <= score < 1 << 63:
        return 0, ""
    return (1, f"{score:0100d}") if score > 0 else (-1, f"{10**100 + score:0100d}")


def _rows(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("vec_id").to_numpy()
    flat = batch.column("q").combine_chunks()
    values = flat.flatten().to_numpy() if isinstance(flat, pa.Array) else np.concatenate([c.flatten().to_numpy() for c in flat.chunks])
    return ids, values.reshape(len(ids), -1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = BLOCK, tile: int = TILE, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of queries the k best rows of vectors of another id."""
    base = common.stored(quantized(vectors, scale, id, vector), "vectors")
    asked = quantized(queries, scale, id, vector)
    asked = common.stored(asked.groupBy("vec_id").agg(F.min(F.struct("dim", "q")).alias("x")).select("vec_id", "x.q", "x.dim"), "queries")
    dims = base.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dims = dims.join(asked.groupBy("dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "dim")
    # each block of rows meets each tile of queries in a task of its own, so neither side grows with the tables
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = base.join(dims, "dim").select("dim", F.pmod(F.xxhash64("vec_id", F.xxhash64("q")), F.col("blocks")).cast("int").alias("block"), every("tiles").alias("tile"), "vec_id", "q")
    right = asked.join(dims, "dim").select("dim", every("blocks").alias("block"), F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int").alias("tile"), "vec_id", "q")

    def search(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and wanted.num_rows:
            lists = Lists(*_rows(rows))
            for own, q in zip(*_rows(wanted), strict=True):
                for i, x in zip(*(c.tolist() for c in lists.top(int(own), q, k)), strict=True):
                    out.append((int(own), i, min(max(x, -(1 << 63)), (1 << 63) - 1), *rank_key(x)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score", "side", "digits"])

    at = ("dim", "block", "tile")
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(search, "query_id long, vec_id long, score long, side int, digits string")
    best = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("digits"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
