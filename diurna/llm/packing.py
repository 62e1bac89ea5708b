"""Variable-capacity best-fit packing of documents into sequences.

A sequence costs its length, its attention (quadratic: at ``attention`` tokens as much as the rest) and ``overhead``. Without
the quadratic part the longest length would always be best, since two bins can share one of twice the size; with it short
documents belong into short sequences, unless too much of those stays empty.

Documents longer than the largest permitted length are cut into pieces of that length and a rest. Pieces are dealt to
groups of bounded size by hash of document, text and place, so a group is packed in one task whatever the input's size. In a
group pieces go in descending order to the open bin with the least room that still fits. If none fits, a bin is opened whose
size costs least for each token that it can be expected to hold: the pieces still to place are laid into each permitted size in
turn, and the size they leave it at after downsizing is what it costs. This plan is compared with those that
prefer one size throughout, and the group's cheapest plan is taken. In the end each bin is downsized to the smallest
permitted length that holds its contents.

Null and empty texts have length 0 and take no room: they have a row with no bin. Very long texts are cut as above, nothing is
dropped. Repeated rows are packed one by one. Pieces of equal length go in order of document and place. A table without rows
gives none; columns other than doc_id and those that ``length`` reads play no part.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
ATTENTION = 8192
GROUP = 8192


def price(size: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return size + size * size / attention + overhead


def expected(first: int, room: int, rest: np.ndarray, sums: np.ndarray, k: int) -> int:
    """Tokens in a bin with a piece of length first and so much room left, if rest[k:] (descending) is laid into it in order."""
    total = first
    while room > 0 and k < len(rest):
        k = max(k, int(np.searchsorted(-rest, -room)))  # the longest that fits
        if k == len(rest) or not rest[k]:
            break
        j = max(k + 1, int(np.searchsorted(sums, sums[k] + room, "right")) - 1)  # and what fits right after it
        total, room, k = total + int(sums[j] - sums[k]), room - int(sums[j] - sums[k]), j
    return total


def plan(lengths: np.ndarray, order: np.ndarray, sizes: list[int], prices: list[float], prefer: int | None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each length, place in its bin, contents of each bin); ``prefer``: the size to open where it fits, else by expected cost."""
    rest = lengths[order]
    sums = np.concatenate([[0], np.cumsum(rest)])
    open_bins: list[tuple[int, int]] = []  # (room, bin), ascending
    used: list[int] = []
    bins, starts = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    known: dict[int, tuple[int, int]] = {}  # choices hold until a 64th of the pieces has been placed
    step = max(1, len(rest) // 64)
    for i, k in enumerate(order.tolist()):
        n = int(lengths[k])
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            if prefer is not None:
                room = sizes[max(bisect_left(sizes, n), bisect_left(sizes, prefer))]
            elif n in known and known[n][1] + step > i:
                room = known[n][0]
            else:
                held = [(expected(n, c - n, rest, sums, i + 1), c) for c in sizes[bisect_left(sizes, n) :]]
                room = min(held, key=lambda h: (prices[bisect_left(sizes, h[0])] / h[0], h[1]))[1]
                known[n] = (room, i)
            b = len(used)
            used.append(0)
        bins[k], starts[k] = b, used[b]
        used[b] += n
        if room > n:
            insort(open_bins, (room - n, b))
    return bins, starts, used


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each length, place in its bin, capacity of each bin); lengths are positive and at most the largest capacity."""
    sizes = sorted(set(capacities))
    prices = [price(c, overhead, attention) for c in sizes]
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    plans = [plan(lengths, order, sizes, prices, prefer) for prefer in (None, *sizes)]
    bins, starts, used = min(plans, key=lambda p: sum(prices[bisect_left(sizes, u)] for u in p[2]))
    return bins, starts, np.array([sizes[bisect_left(sizes, u)] for u in used], np.int64)


def pack(docs: DataFrame, length: Column, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, attention: int = ATTENTION, group: int = GROUP) -> DataFrame:
    """``(doc_id, piece, piece_start, length, bin_id, bin_capacity, bin_start)``: one row for each piece.

    ``length``: each document's tokens (null: 0). bin_id is unique over all groups; piece_start is the piece's place in its
    document, bin_start its place in the bin.
    """
    if not capacities or min(capacities) < 1 or overhead < 0 or attention < 1:
        raise ValueError("capacities and attention must be positive, overhead must not be negative")
    top = max(capacities)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("place"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top) - 1, F.lit(0))))).select(
        "doc_id", "place", F.col("piece").cast("long").alias("piece"), (F.col("piece") * top).cast("long").alias("piece_start"), F.least(F.col("n") - F.col("piece") * top, F.lit(top)).cast("long").alias("length")
    )
    pieces = common.stored(pieces, "pieces")
    groups = max(1, -(-pieces.where("length > 0").count() // group))
    dealt = pieces.where("length > 0").withColumn("part", F.pmod(F.xxhash64("doc_id", "place", "piece"), F.lit(groups)).cast("long"))
    schema = "doc_id long, piece long, piece_start long, length long, bin_id long, bin_capacity long, bin_start long"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "place", "piece"]).reset_index(drop=True)
        bins, starts, final = best_fit(rows["length"].to_numpy(), capacities, overhead, attention)
        base = int(rows["part"].iloc[0]) << 24
        return pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64"), "piece": rows["piece"], "piece_start": rows["piece_start"], "length": rows["length"], "bin_id": base + bins, "bin_capacity": final[bins], "bin_start": starts})

    packed = dealt.groupBy("part").applyInPandas(run, schema)
    none = F.lit(None).cast("long")
    return packed.unionByName(pieces.where("length = 0").select("doc_id", "piece", "piece_start", "length", none.alias("bin_id"), none.alias("bin_capacity"), none.alias("bin_start")))
