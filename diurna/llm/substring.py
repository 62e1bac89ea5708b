"""Substring deduplication by a compacted graph of token k-mers.

A window is ``window`` consecutive words of one document. A word is removed if a window that covers it, taken as a word
sequence, also starts in a document with a smaller doc_id.

Equal texts are one class first: each window of a copy also starts in the class's smallest document, so a later copy
loses all its words if it has a whole window, and none otherwise. Only the class's first document goes on.

Edges of the graph are the ``anchor``-word k-mers that are the least (by hash, leftmost) of some window: equal windows
have equal edges at equal offsets, so only edges that occur in two documents can carry a repeated window. The windows
around one edge that share it as their least k-mer form one nonbranching path, identified by its first and last window;
paths compact to one row, with all places of one text where the path occurs (a word repeated m times has about m windows and
one path), and Spark joins settle them:

* a path that occurs in a smaller document is repeated as a whole, all its windows with it;
* where an edge has several paths (a branch: the border of a shared passage, an edited word), the words at the source
  coordinates of one occurrence of each path are read again, and its windows are compared one by one.

Hashes only name what may be equal. The words at each source's coordinates are read again, and a span is removed only if its own
words have the same BLAKE2b digest (128 bits) as the source's; so equal hashes of different words remove nothing.

Text moves twice (to the sources' coordinates and to the spans that are removed), windows only at branches. Rows with
a null doc_id are neither source nor target: nothing is removed from them. Rows that repeat a doc_id are one document
for the rule and separate rows in the result. Null or empty texts have no words. Very long texts are read whole; a table
without rows gives none. Columns of other names than those added are returned as they came.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import mix, runs, word_hashes

WINDOW, ANCHOR = 50, 16
_CHUNK = 1 << 20  # bytes handled at once; a longer text is handled alone
_BASES = [np.uint64(int(x) | 1) for x in np.random.default_rng(78).integers(1 << 62, 1 << 63, 2, np.uint64)]
ALL = -1  # as a span's number of windows: each word of a text that has a window


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


class Words:
    """Hashes of the words of several texts, end to end."""

    def __init__(self, texts: list[bytes]):
        cut = [t.split() for t in texts]
        size = [len(w) for w in cut]
        self.n = sum(size)
        self.first = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        self.doc = np.repeat(np.arange(len(texts)), size)
        self.hashes = np.concatenate([word_hashes(w) for w in cut]) if cut else np.zeros(0, np.uint64)


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values."""
    done, best = 1, key
    while done * 2 <= width:
        best = np.minimum(best[:-done], best[done:])
        done *= 2
    return np.minimum(best[: len(best) - (width - done)], best[width - done :]) if done < width else best


def paths(texts: list[bytes], window: int, anchor: int):
    """(text, first word, windows, edge hash, path hash) of each path, as arrays."""
    w = Words(texts)
    empty = np.zeros(0, np.int64)
    if w.n < window:
        return empty, empty, empty, empty, empty
    edge, whole = runs(w.hashes, anchor, window)
    n = w.n - window + 1
    least = np.empty(n, np.int64)
    for at in range(0, n, 1 << 23):
        # 40 bits of the hash, then the place: the leftmost of the least
        key = edge[at : at + (1 << 23) + window - anchor] & np.uint64(0xFFFFFFFFFF000000)
        key |= np.arange(len(key), dtype=np.uint64)
        part = sliding_least(key, window - anchor + 1) & np.uint64(0xFFFFFF)
        least[at : at + (1 << 23)] = part[: 1 << 23].astype(np.int64) + at
    ok = np.flatnonzero(w.doc[:n] == w.doc[window - 1 :])
    if not len(ok):
        return empty, empty, empty, empty, empty
    at = least[ok]
    new = np.concatenate([[True], (ok[1:] != ok[:-1] + 1) | (at[1:] != at[:-1]) | (w.doc[ok[1:]] != w.doc[ok[:-1]])])
    begin = np.flatnonzero(new)
    count = np.diff(np.concatenate([begin, [len(ok)]]))
    first = ok[begin]
    doc = w.doc[first]
    # a path has fewer windows than a window has words, so its first and last window name all its words; the edge's offset
    # belongs to its identity: windows are numbered from its start
    path = mix(whole[first] * _BASES[0] + mix(whole[first + count - 1] + count.astype(np.uint64) * np.uint64(64) + (at[begin] - first).astype(np.uint64)) * _BASES[1])
    return doc, first - w.first[doc], count, edge[at[begin]].view(np.int64), path.view(np.int64)


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, t in enumerate(texts):
        if size and size + len(t) > _CHUNK:
            yield i, j
            i, size = j, 0
        size += len(t) + 1
    if size:
        yield i, len(texts)


def gathered(doc: np.ndarray, start: np.ndarray, edge: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """(index of each path's first occurrence in its text, starts of the further ones, ascending; null if there are none)."""
    order = np.lexsort((start, path, edge, doc))
    d, e, p = doc[order], edge[order], path[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (e[1:] != e[:-1]) | (p[1:] != p[:-1])])
    more = np.diff(np.append(np.flatnonzero(new), len(order))) - 1
    offsets = np.concatenate([[0], np.cumsum(more)]).astype(np.int32)
    return order[new], pa.ListArray.from_arrays(pa.array(offsets), pa.array(start[order[~new]].astype(np.int32)), mask=pa.array(more == 0))


def path_rows(keyed: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(edge, path, doc_id, row, start, n, again)`` of each path of keyed (doc_id, row, text), one row for each text that has it.

    start is its first place in the text, again holds the further ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [t or b"" for t in common.raw_texts(batch.column(2))]
            for i, j in _pieces(texts):
                doc, start, count, edge, path = paths(texts[i:j], window, anchor)
                if len(doc):
                    at, again = gathered(doc, start, edge, path)
                    own = doc[at]
                    yield pa.RecordBatch.from_arrays([pa.array(edge[at]), pa.array(path[at]), pa.array(ids[i:j][own]), pa.array(rows[i:j][own]), pa.array(start[at].astype(np.int32)), pa.array(count[at].astype(np.int32)), again], names=["edge", "path", "doc_id", "row", "start", "n", "again"])

    return keyed.mapInArrow(run, "edge long, path long, doc_id long, row long, start int, n int, again array<int>")


def _at_sources(window: int):
    """Over (doc_id, row, text, spans of (a, b, start, n, branch)): the digest of each span's words; of branches each window's too."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[tuple] = []
        ids, spans = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        for doc_id, text, own in zip(ids, common.raw_texts(batch.column(2)), spans, strict=True):
            words = text.split() if text else []
            for s in own:
                a, b, start, n = s["a"], s["b"], s["start"], s["n"]
                out.append((a, b, -1, digest(words[start : start + n - 1 + window]), doc_id))
                if s["branch"]:
                    out += [(a, b, o, digest(words[start + o : start + o + window]), doc_id) for o in range(n)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["a", "b", "place", "words", "doc_id"]) if out else None

    return run


def copies(keyed: DataFrame) -> DataFrame:
    """``(doc_id, row)`` of rows whose text a smaller document has as well."""
    names = common.stored(keyed.where("doc_id is not null and length(text) > 0").select("doc_id", "row", F.sha2("text", 256).alias("name")), "names")
    first = names.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    out = common.stored(names.join(first, "name").where("doc_id > low").select("doc_id", "row").distinct(), "copies")
    common.discard(names)
    return out


def removals(keyed: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``(doc_id, row, spans)``; spans: (start, n, again, mask, words) of paths to remove, mask null for all their windows, words the source's digest."""
    spark = keyed.sparkSession
    if not 2 <= window - anchor + 1 <= 63 or anchor < 1:
        raise ValueError("window - anchor must be between 1 and 62")
    gone = copies(keyed)
    rest = keyed.where("doc_id is not null").join(gone, ["doc_id", "row"], "left_anti").select("doc_id", "row", "text")
    found = common.stored(path_rows(rest, window, anchor), "found")
    shared = common.stored(found.groupBy("edge").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("edge"), "edges")
    common.release(spark)
    kept = common.stored(found.join(shared, "edge", "left_semi"), "paths")
    common.discard(found, shared)
    common.release(spark)
    # paths' names are joined, never their pairs: a path's texts meet its one source
    classes = kept.groupBy("edge", "path").agg(F.min(F.struct("doc_id", "row", "start", "n")).alias("at"), F.max("doc_id").alias("high"))
    classes = common.stored(classes.select(F.col("edge").alias("a"), F.col("path").alias("b"), "at", "high"), "classes")
    branches = common.stored(classes.groupBy("a").count().where("count > 1").select("a", F.lit(True).alias("branch")), "branches")
    there = classes.join(branches, "a", "left").select("a", "b", "at", F.coalesce("branch", F.lit(False)).alias("branch"), "high").where("branch or high > at.doc_id").drop("high")
    there = there.groupBy("at.doc_id", "at.row").agg(F.collect_list(F.struct("a", "b", "at.start", "at.n", "branch")).alias("spans"))
    sources = rest.join(there, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("doc_id", "row", "text", "spans")
    read = common.stored(common.map_batches(sources, _at_sources(window), "a long, b long, place int, words binary, doc_id long"), "read")
    common.release(spark)
    windows = read.where("place >= 0")
    low = windows.groupBy("a", "words").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("a", "words", "low")
    masks = windows.join(low, ["a", "words"]).where("low < doc_id").groupBy("a", "b").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    names = read.where("place < 0").select("a", "b", F.col("doc_id").alias("low"), "words")
    # stored, so that the join with the paths has two plain exchanges and Spark may split its large partitions
    twice = classes.where("high > at.doc_id").select("a", "b", F.lit(True).alias("twice"))
    settled = names.join(masks, ["a", "b"], "left").join(twice, ["a", "b"], "left").where("twice or mask is not null")
    settled = common.stored(settled.select(F.col("a").alias("edge"), F.col("b").alias("path"), "low", "words", "mask"), "settled")
    common.discard(read, classes, branches)
    common.release(spark)
    out = kept.join(settled, ["edge", "path"]).where("doc_id > low or mask is not null")
    later = F.col("doc_id") > F.col("low")
    out = out.select("doc_id", "row", F.struct("start", "n", "again", F.when(~later, F.col("mask")).alias("mask"), F.when(later, F.col("words")).alias("words")).alias("span"))
    every = F.struct(F.lit(0).alias("start"), F.lit(ALL).alias("n"), F.lit(None).cast("array<int>").alias("again"), F.lit(None).cast("long").alias("mask"), F.lit(None).cast("binary").alias("words"))
    return out.unionByName(gone.select("doc_id", "row", every.alias("span"))).groupBy("doc_id", "row").agg(F.collect_set("span").alias("spans"))


def _cover(words: list[bytes], spans: list[dict], window: int) -> np.ndarray:
    """Which words are removed."""
    delta = np.zeros(len(words) + 1, np.int32)
    for span in spans:
        n, m = span["n"], span["mask"]
        if n == ALL:
            if len(words) >= window:
                delta[0] += 1
            continue
        for s in (span["start"], *(span.get("again") or ())):
            if m is None:
                if digest(words[s : s + n - 1 + window]) == span["words"]:
                    delta[s] += 1
                    delta[s + n - 1 + window] -= 1
            else:
                for o in range(n):
                    if m >> o & 1:
                        delta[s + o] += 1
                        delta[s + o + window] -= 1
    return np.cumsum(delta[:-1]) > 0


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = True) -> DataFrame:
    """docs with ``n_words, n_removed, kept_sha256``, and with texts ``kept_text``: the kept words joined by one space.

    Columns of these names in docs are replaced; other columns stay.
    """
    common.small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    with common.owned() as made:
        spans = common.stored(removals(keyed, window, anchor), "spans")
    common.forget(docs.sparkSession, [p for p in made if p != spans._scratch])
    common.release(docs.sparkSession)
    added = ["n_words", "n_removed", "kept_sha256", *["kept_text"] * texts]
    others = [c for c in docs.columns if c not in added and (c != "text" or texts)]
    left = docs.select(*[F.col(c).alias(f"d_{i}") for i, c in enumerate(others)], "text", F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_row"))
    joined = left.join(spans.select(F.col("doc_id").alias("k_id"), F.col("row").alias("k_row"), "spans"), ["k_id", "k_row"], "left")
    joined = joined.select(*[f"d_{i}" for i in range(len(others))], "text", "spans")
    schema = docs.select(*others).schema
    for i, f in enumerate(schema.fields):
        f.name = f"d_{i}"
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")):
        schema = schema.add(name, kind)
    if texts:
        schema = schema.add("kept_text", "string")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, digest, kept_text = [], [], [], []
        spans = batch.column(len(others) + 1)
        for i, t in enumerate(common.raw_texts(batch.column(len(others)))):
            words = t.split() if t else []
            kept = words
            own = spans[i]
            if own.is_valid and words:
                gone = _cover(words, own.as_py(), window)
                kept = list(compress(words, (~gone).tolist()))
            line = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(line).hexdigest())
            if texts:
                kept_text.append(None if t is None else line)
        cols = [batch.column(i) for i in range(len(others))] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)]
        if texts:
            cols.append(common.binary(kept_text).cast(pa.string()))
        return pa.RecordBatch.from_arrays(cols, names=schema.names)

    out = common.map_batches(joined, run, schema)
    return out.select(*[F.col(f"d_{i}").alias(c) for i, c in enumerate(others)], *added)
