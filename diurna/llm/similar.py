"""Near copies by similarity: texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

SimHash links (``simhash.links``: fingerprints within four bits, pruned by pivot distance tables) name the obvious pairs; each
is verified on its whole texts. They find few of the pairs close to the threshold, so an exact search completes them:

* two sets x, y that are similar enough share one of the first ``n - ceil(t n) + 1`` members of each, in any order that is
  the same for all sets. The order here puts members that few documents have first, so boilerplate is hardly ever in such
  a prefix. Which members are frequent is counted over all documents; the list of them is bounded, and only costs depend on it.
* Documents that share a prefix member form a group. Not all its pairs are made: each round holds the group's members
  against a few centres, those nearest to the start of the order first, leaves out what is already linked to a centre and
  what sizes or places in the order exclude, and verifies the others on whole texts. Rounds end when no group has two
  components left whose members haven't met. No pair at the threshold or above is lost (but for equal 64-bit hashes).

Texts of one shingle set are one class from the start, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash
from .words import shingle_sets

HOT = 1 << 17  # frequent shingles whose order is by count
COUNTED = 1 << 22  # shingles counted at once in a task
ENOUGH = 100  # the last round may make so many pairs for each member of a group
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """docs with ``id`` (nulls last), ``row`` (of its text) and ``text``, its own columns renamed away."""
    own = [F.col(c).alias(f"d_{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*own, F.col("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("row"))


def frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of at most ``HOT`` frequent shingles.

    Tasks count blocks of ``COUNTED`` shingles, equal sets once, and report those that two sets of a block have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["token", "n"])

        for batch in batches:
            for s in shingle_sets(common.raw_texts(batch.column(0)), shingle):
                name = xxhash.xxh3_128_digest(s.tobytes())
                if name in seen:
                    continue
                seen.add(name)
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield flush()
                    held, seen, size = [], set(), 0
        if size:
            yield flush()

    counts = common.stored(texts.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    level = F.floor(F.log2("n") * 4).cast("int")
    sizes = counts.groupBy(level.alias("level")).count().collect()  # four levels for each power of two
    least, total = 0, 0
    for r in sorted(sizes, reverse=True):
        total += r["count"]
        if total > HOT:
            least = r["level"] + 1
            break
    got = counts.where(level >= least).toArrow()
    common.discard(counts)
    token, n = (got.column(i).to_numpy() for i in range(2))
    order = np.argsort(token.view(np.uint64))
    return token.view(np.uint64)[order], n[order]


def prefix_size(n: np.ndarray | int, threshold: float):
    """How many members of a set of n must be looked at: two similar sets share one of them."""
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1 if isinstance(n, np.ndarray) else n - int(np.ceil(threshold * n - 1e-9)) + 1


def sketches(rows: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``(id, row, one, two, fp, n, prefix)`` of each row: its shingle set's name, fingerprint, size and prefix."""
    token, count = frequent(rows, shingle)
    hot = rows.sparkSession.sparkContext.broadcast((token, count))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        token, count = hot.value
        names, fps, sizes, prefixes = [], [], [], []
        for s in shingle_sets(common.raw_texts(batch.column(2)), shingle):
            n = len(s)
            sizes.append(n)
            names.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
            fps.append(simhash.majority(s))
            if len(token) and n:
                at = np.minimum(np.searchsorted(token, s), len(token) - 1)
                often = np.where(token[at] == s, count[at], 0)
                if often.any():
                    s = s[np.argsort(often, kind="stable")]
            prefixes.append(s[: prefix_size(n, threshold) if n else 0].view(np.int64))
        name = np.array(names).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))], names=["id", "row", "one", "two", "fp", "n", "prefix"])

    return common.map_batches(rows.select("id", "row", "text"), run, "id long, row long, one long, two long, fp long, n int, prefix array<long>")


def _bounded(threshold: float):
    """Whether sizes and places of a shared member allow the similarity: over columns n, at and c_n, c_at."""
    need = F.ceil((F.col("n") + F.col("c_n")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    return F.least(F.col("n") - F.col("at"), F.col("c_n") - F.col("c_at")) >= need


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """Of the pairs ``(u, v)`` those whose ``texts (node, text)`` have at least the similarity."""
    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    both = both.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        made: dict[int, np.ndarray] = {}
        for ids, column in ((u, 2), (v, 3)):
            _, first = np.unique(ids, return_index=True)
            for k, s in zip(ids[first].tolist(), shingle_sets(common.raw_texts(batch.column(column).take(pa.array(first))), shingle), strict=True):
                made[k] = s
        ok = []
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            x, y = made[a], made[b]
            # both are sorted and distinct
            together = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((together[1:] == together[:-1]).sum())
            ok.append(shared >= threshold * (len(together) - shared))
        return batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return common.map_batches(both.select("u", "v", "text_u", "text_v"), run, "u long, v long")


def groups(docs: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """``(id, row, first_id, first_row)``: for each ``(id, row)`` of docs, with repeats, the first row of its group."""
    if not 0.5 <= threshold <= 1:
        raise ValueError("threshold must be between 0.5 and 1")
    with common.owned() as made:
        out = _groups(docs, threshold, shingle)
    common.forget(docs.sparkSession, [p for p in made if p != out._scratch])
    return out


def _groups(docs: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = keyed(docs).select("id", "row", "text")
    drawn = common.stored(sketches(rows, shingle, threshold), "sketches")
    best = F.min(F.struct("id", "row")).alias("best")
    classes = drawn.groupBy("one", "two").agg(best, F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = common.stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered once, since it is stored

    postings = classes.select("node", "n", F.posexplode("prefix").alias("at", "token"))
    busy = common.stored(postings.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token"), "tokens")
    common.release(spark)
    meetings = common.stored(postings.join(busy, "token", "left_semi").select("token", "node", "n", "at"), "meetings")
    common.release(spark)
    near = common.stored(simhash.links(classes.groupBy("fp").agg(F.min("node").alias("node")), radius=4), "near")
    # texts of one fingerprint are linked to the least of them
    equal = classes.join(classes.groupBy("fp").agg(F.min("node").alias("v"), F.count("*").alias("c")).where("c > 1"), "fp").where("node <> v").select(F.col("node").alias("u"), "v")
    first = common.stored(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(equal.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct(), "pairs")

    wanted = meetings.select("node").unionByName(first.select(F.col("u").alias("node"))).unionByName(first.select(F.col("v").alias("node"))).distinct()
    wanted = classes.select("node", F.col("best.id").alias("id"), F.col("best.row").alias("row")).join(wanted, "node", "left_semi")
    texts = common.stored(rows.join(wanted, ["id", "row"]).groupBy("node").agg(F.min("text").alias("text")), "texts")
    common.release(spark)

    linked = common.stored(verified(first, texts, threshold, shingle), "linked")
    done, found = first, linked
    roots = common.connected_components(found)
    offset, centres = 0, 1
    while True:
        named = meetings.join(roots.withColumnRenamed("u", "node"), "node", "left").select("token", "node", "n", "at", F.coalesce("v", "node").alias("root"))
        named = common.stored(named, "named")
        parts = named.groupBy("token", "root").count().groupBy("token").agg(F.sum("count").alias("size"), F.max_by("root", F.struct("count", "root")).alias("main"), F.max("count").alias("most"), F.count("*").alias("roots")).where("roots > 1")
        parts = common.stored(parts, "parts")
        sums = parts.agg(F.sum((F.col("size") - F.col("most")) * F.col("size")).alias("pairs"), F.max("size").alias("size"), F.count("*").alias("tokens"), F.sum(F.col("size") - F.col("most")).alias("rest")).first()
        left = named.join(parts.select("token", "main"), "token")
        # one centre for each member first: most groups are one component then, and the others' pairs are few
        last = not sums["size"] or offset > 0 and sums["pairs"] <= ENOUGH * meetings.count()
        if last:
            chosen = left.where("root <> main")
        else:
            rank = F.row_number().over(Window.partitionBy("token").orderBy("at", F.xxhash64("node"), "node"))
            chosen = left.withColumn("rank", rank).where((F.col("rank") > offset) & (F.col("rank") <= offset + centres))
        chosen = chosen.select("token", *[F.col(c).alias(f"c_{c}") for c in ("node", "n", "at", "root")])
        pairs = left.join(chosen, "token").where("root <> c_root").where(_bounded(threshold))
        pairs = pairs.select(F.greatest("node", "c_node").alias("u"), F.least("node", "c_node").alias("v")).distinct()
        pairs = common.stored(pairs.join(done, ["u", "v"], "left_anti"), "pairs")
        if pairs.head(1):
            more = common.stored(verified(pairs, texts, threshold, shingle), "linked")
            found, done = found.unionByName(more), done.unionByName(pairs)
            roots = common.connected_components(found)
        common.discard(named, parts)
        common.release(spark)
        offset, centres = offset + centres, centres * 4
        if last or sums["size"] <= offset:
            break
    where = classes.join(roots.withColumnRenamed("u", "node"), "node", "left").select("one", "two", "best", F.coalesce("v", "node").alias("root"))
    firsts = where.groupBy("root").agg(F.min("best").alias("first"))
    where = where.join(firsts, "root").select("one", "two", "first")
    out = drawn.select("id", "row", "one", "two").join(where, ["one", "two"]).select("id", "row", F.col("first.id").alias("first_id"), F.col("first.row").alias("first_row"))
    return common.stored(out, "groups")


def dedup_similar(docs: DataFrame, threshold: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs with one row of each group of similar texts: that of the smallest doc_id, nulls last.

    Links chain, so a group may hold texts that are less similar than the threshold. Null and empty texts, and texts without
    words, have the same, empty set: they are one group. Of rows that repeat id and text one stays; of rows that share an id
    but not the text each is a row of its own. Very long texts are read whole. An empty table gives an empty one. Other
    columns, whatever their names, are kept as they are.
    """
    found = groups(docs, threshold, shingle)
    gone = common.stored(found.where("id <> first_id or row <> first_row").select("id", "row").distinct(), "gone")
    twice = common.stored(found.groupBy("id", "row").count().where("count > 1").select("id", "row"), "repeated")
    common.discard(found)
    rows = keyed(docs).drop("text")
    kept = rows.join(gone, ["id", "row"], "left_anti")
    if twice.head(1):
        kept = kept.join(twice, ["id", "row"], "left_anti").unionByName(kept.join(twice, ["id", "row"], "left_semi").dropDuplicates(["id", "row"]))
    return kept.select(*[F.col(f"d_{i}").alias(c) for i, c in enumerate(docs.columns)])
