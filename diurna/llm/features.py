"""Hashed words and structure statistics of whole texts, and bounded samples of labelled rows."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LETTERS = np.zeros(256, bool)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1] = _LETTERS[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_MARKS = [ord(c) for c in "!?#$%&*.,"]
STATS = ("bias", "log_bytes", "log_words", "word_length", "upper", "digit", "space", "mark", *(f"char_{chr(c)}" for c in _MARKS), "distinct", "line_length", "line_repeats", "top_word")
_CACHE: dict[bytes, int] = {}


def hashed(words: set[bytes], bits: int) -> np.ndarray:
    """Places of distinct words among 2^bits; the cache of hashes is bounded."""
    if len(_CACHE) > 150_000:
        _CACHE.clear()
    get, mask, out = _CACHE.get, (1 << bits) - 1, []
    for w in words:
        h = get(w)
        if h is None:
            h = _CACHE[w] = zlib.crc32(w)
        out.append(h & mask)
    return np.unique(np.array(out, np.int64))


def stats(raw: bytes, words: list[bytes]) -> np.ndarray:
    """Structure statistics, each of about unit size."""
    n = max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(count[_LETTERS].sum()))
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    distinct = len(set(words))
    out = [1.0, np.log1p(len(raw)) / 10, np.log1p(len(words)) / 8, min(4.0, (len(raw) - count[_SPACE].sum()) / m / 8), count[_UPPER].sum() / letters, min(1.0, 5 * count[_DIGIT].sum() / n), count[_SPACE].sum() / n * 4]
    out.append(min(1.0, (n - letters - count[_SPACE].sum() - count[_DIGIT].sum()) / n * 4))
    out += [min(1.0, 4 * count[c] / m) for c in _MARKS]
    out += [distinct / m, min(2.0, m / max(1, len(lines)) / 20), 1 - len(set(lines)) / max(1, len(lines)), 1 / max(1, distinct)]
    return np.array(out, np.float64)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, out_fold: int, rows: int) -> DataFrame:
    """Up to ``rows`` documents with their label as ``y``, one for each text: those of the least hashes.

    Only rows whose crc32(doc_id as text) mod ``fold`` isn't ``out_fold`` are ever labelled here.
    """
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(crc != out_fold)
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    picked = known.groupBy("doc_id").agg(F.max("y").alias("y")).join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n_chars.alias("n_chars"))
    # picked: at most `rows` short rows by construction; of rows that repeat an id one is learned from
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "n_chars", "y")).alias("x")).select("doc_id", "x.text", "x.n_chars", "x.y")


def held_out(fold: int, out_fold: int):
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold))
    return F.coalesce(crc == out_fold, F.lit(False))
