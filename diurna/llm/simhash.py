"""SimHash near-duplicates: Hamming links between fingerprints, pruned by pivot distance tables.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, word shingles joined by spaces, XXH64 (seed 42)
of each shingle, a bit set if over half the hashes have it. A null or empty text has fingerprint zero and links like any other.

Links: two fingerprints within ``radius`` bits agree on at least k of ``radius + k`` blocks of bits, so each distinct
fingerprint is dealt to one bucket for each choice of k blocks; k grows with the number of fingerprints, so that buckets stay
small, and changes no result. In a bucket a table of Hamming distances to fixed reference
fingerprints ("pivots") is kept; by the triangle inequality two fingerprints whose distances to any pivot differ by more
than ``radius`` can't link. Survivors are verified by the exact distance. Equal fingerprints (exact copies above all)
are one class from the start, large buckets are dealt in tiles, and each task returns stars, not all pairs. Very long texts are
hashed whole. Repeated rows are rows of one class. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 42
PIVOTS = 24
TILE = 2048
BITS = 64
NO_ID = 1 << 62  # from here on: stand-ins for classes whose rows all lack an id


def shingle_hashes(raw: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence if it has fewer words."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size) - 1
    begin = (end - size + 1)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], SEED) for i, j in zip(begin, end[shingle - 1 :].tolist(), strict=True)), np.uint64, len(begin))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half the hashes; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(raw: bytes | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text."""
    return majority(shingle_hashes(raw, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(doc_id, fp long)`` for each row."""
    common.small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in common.raw_texts(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return common.map_batches(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, fp long")


def blocks(radius: int, agree: int = 2) -> list[tuple[int, int]]:
    """(lowest bit, bits) of radius + agree blocks."""
    n = radius + agree
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(n)]


def pivots() -> np.ndarray:
    return np.random.default_rng(20240601).integers(0, 2**64, PIVOTS, np.uint64, endpoint=False)


def distance_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int16)


def near(x: int, fps: np.ndarray, table: np.ndarray, own: np.ndarray, radius: int) -> np.ndarray:
    """Places of fps within radius of x, whose row of pivot distances is own. Pivot by pivot, then exactly."""
    at = np.flatnonzero(np.abs(table[:, 0] - own[0]) <= radius)
    for k in range(1, table.shape[1]):
        if len(at) < 4:
            break
        at = at[np.abs(table[at, k] - own[k]) <= radius]
    return at[np.bitwise_count(fps[at] ^ x) <= radius]


def stars(fps: np.ndarray, radius: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fps, or of those between places left (True) and the others, breadth first.

    A fingerprint that has been reached is compared no more, so a dense group costs little over its size.
    """
    refs = pivots()
    table = distance_table(fps, refs)
    side = np.zeros(len(fps), bool) if left is None else left
    a: list[int] = []
    b: list[int] = []
    if left is None:
        pools = {False: np.arange(len(fps))}
    else:
        pools = {False: np.flatnonzero(~left), True: np.flatnonzero(left)}
    reached = np.zeros(len(fps), bool)
    for seed in range(len(fps)):
        if reached[seed]:
            continue
        reached[seed] = True
        queue = [seed]
        while queue:
            x = queue.pop()
            key = bool(side[x]) if left is None else not side[x]
            pool = pools[key]
            pool = pool[~reached[pool]]
            pools[key] = pool
            if not len(pool):
                continue
            hit = pool[near(fps[x], fps[pool], table[pool], table[x], radius)]
            reached[hit] = True
            queue += hit.tolist()
            a += [x] * len(hit)
            b += hit.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _small(keys: np.ndarray, which: np.ndarray, fps: np.ndarray, radius: int, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in runs of equal keys, all small: each pair once, in its first bucket."""
    table = distance_table(fps, pivots())
    cut = blocks(radius, agree)
    bit = 1 << np.arange(len(cut))
    first = np.full(1 << len(cut), -1)
    for i, chosen in enumerate(combinations(range(len(cut)), agree)):
        first[bit[list(chosen)].sum()] = i
    a, b = [], []
    step = 1
    at = np.arange(len(keys) - 1)
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        i = at
        for k in range(PIVOTS):
            i = i[np.abs(table[i, k] - table[i + step, k]) <= radius]
        x = fps[i] ^ fps[i + step]
        ok = np.bitwise_count(x) <= radius
        i, x = i[ok], x[ok]
        if len(i):
            equal = np.stack([(x >> np.uint64(lo)) & np.uint64((1 << n) - 1) == 0 for lo, n in cut])
            chosen = equal & (np.cumsum(equal, axis=0) <= agree)
            own = first[bit @ chosen] == which[i]
            a.append(i[own])
            b.append(i[own] + step)
        step += 1
    empty = np.zeros(0, np.int64)
    return np.concatenate(a) if a else empty, np.concatenate(b) if b else empty


def _link_sorted(radius: int, agree: int):
    """Over rows sorted by bucket (key, tile): links as (u, v)."""

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def handle(key: np.ndarray, tile: np.ndarray, side: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = fp.view(np.uint64)
        edge = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
        begin = np.concatenate([[0], edge])
        end = np.concatenate([edge, [len(key)]])
        big = end - begin > 64
        for i, j in zip(begin[big].tolist(), end[big].tolist(), strict=True):
            own = side[i:j]
            x, y = stars(fp[i:j], radius, own == 1 if own.any() else None)
            if len(x):
                yield out(node[i:j][x], node[i:j][y])
        rest = ~np.repeat(big, end - begin)
        if rest.any():
            k, f, n, s = key[rest], fp[rest], node[rest], side[rest]
            run = np.repeat(np.arange(len(begin)), end - begin)[rest]
            x, y = _small(run, k & 127, f, radius, agree)
            ok = (s[x] != s[y]) | (tile[rest][x] < 0) | (tile[rest][x] % 2 == 0)
            if ok.any():
                yield out(n[x[ok]], n[y[ok]])

    return _by_bucket(handle)


def _by_bucket(handle):
    """Over rows sorted by their first two columns: handle for whole runs of these, many at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(batch.num_columns)])
            size += batch.num_rows
            if size < 100_000:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            if len(last):
                cut = last[-1] + 1
                yield from handle(*[c[:cut] for c in cols])
                cols = [c[cut:] for c in cols]
            held, size = [cols], len(cols[0])
        if size:
            yield from handle(*[np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def links(classes: DataFrame, radius: int = 4, tile: int = TILE, agree: int | None = None) -> DataFrame:
    """``(u, v)``: links with the same components as all pairs of ``classes (fp, node)`` within radius bits.

    ``agree``: how many blocks name a bucket, 2 to 4; by default the fewest whose buckets hold eight fingerprints or so.
    """
    if not 1 <= radius <= 4:
        raise ValueError("radius must be between 1 and 4")
    if agree is None:
        n = classes.count()
        agree = next((k for k in (2, 3) if n <= 8 << BITS * k // (radius + k)), 4)
    buckets = []
    for i, chosen in enumerate(combinations(blocks(radius, agree), agree)):
        key = F.lit(0).cast("long")
        for low, n in chosen:
            key = F.shiftleft(key, n).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1)))
        buckets.append(F.shiftleft(key, 7).bitwiseOR(F.lit(i).cast("long")))
    rows = classes.select("fp", "node", F.explode(F.array(*buckets)).alias("key"))
    return dealt(rows, tile).mapInArrow(_link_sorted(radius, agree), "u long, v long")


def dealt(rows: DataFrame, tile: int) -> DataFrame:
    """``(key, tile, side, fp, node, others)`` sorted by bucket; buckets of more than ``tile`` rows come in pairs of tiles."""
    others = [c for c in rows.columns if c not in ("key", "fp", "node")]
    large = common.stored(rows.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("parts")), "buckets")
    if large.head(1):  # such a bucket is dealt in pairs of tiles
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        rows = rows.join(large, "key", "left").withColumn("part", F.when(F.col("parts").isNotNull(), part))
        other = F.explode(F.when(F.col("part").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("key", "fp", "node", "part", "parts", other.alias("other"), *others)
        low, high = F.least("part", "other"), F.greatest("part", "other")
        # twice the pair's number; odd: only links between the two tiles
        number = (low * F.col("parts") + high) * 2 + F.when(low != high, 1).otherwise(0)
        rows = rows.select("key", F.coalesce(number, F.lit(-1)).cast("long").alias("tile"), F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"), "fp", "node", *others)
    else:
        rows = rows.select("key", F.lit(-1).cast("long").alias("tile"), F.lit(0).alias("side"), "fp", "node", *others)
    return rows.repartition(F.col("key"), F.col("tile")).sortWithinPartitions("key", "tile")


def components(docs: DataFrame, radius: int = 4, shingle: int = 4, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id, n_class)`` for each row of docs.

    component_id is the smallest doc_id reachable by links. Rows without a doc_id keep their fingerprint's component,
    null if no row in it has an id. Rows that repeat a doc_id are rows like others; extra columns are ignored.
    """
    prints = common.stored(fingerprints(docs, shingle, text, id), "fingerprints")
    stand_in = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("fp"), 3)
    classes = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_class")).select("fp", "n_class", F.coalesce("low", stand_in).alias("node")), "classes")
    roots = common.connected_components(links(classes, radius))
    named = classes.join(roots.withColumnRenamed("u", "node"), "node", "left").select("fp", "n_class", F.coalesce("v", "node").alias("component_id"))
    named = named.withColumn("component_id", F.when(F.col("component_id") < NO_ID, F.col("component_id")))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_class")


def dedup(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id (of repeated rows, one).

    Of rows without an id whose group has none either, one for each fingerprint stays.
    """
    found = components(docs, radius, shingle)
    firsts = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(firsts, "doc_id", "left_semi")
    counts = common.stored(named.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if counts.head(1):
        named = named.dropDuplicates(["doc_id"])
    lone = found.where("component_id is null").select("fingerprint").distinct()
    nameless = docs.where("doc_id is null")
    if lone.head(1) and nameless.head(1):
        extra = nameless.withColumn("_fp", F.lower(F.lpad(F.hex(fingerprint_column(nameless, shingle)), 16, "0")))
        extra = extra.join(lone.withColumnRenamed("fingerprint", "_fp"), "_fp", "left_semi").dropDuplicates(["_fp"]).drop("_fp")
        named = named.unionByName(extra.select(named.columns))
    return named.select(docs.columns)


def fingerprint_column(docs: DataFrame, shingle: int = 4):
    """The fingerprint as a column expression over ``text``, for the rare rows without an id."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t.encode() if t is not None else None, shingle) for t in texts], np.uint64).view(np.int64))

    return of(docs["text"])
