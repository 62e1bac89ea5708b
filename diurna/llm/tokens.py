"""Token ids of whole texts in flat binary files.

A part is two files. ``part-N.bin``: the ids of its documents end to end, unsigned little-endian, two bytes each if the
vocabulary fits, else four. ``part-N.idx``: the magic ``DITK``, version and bytes per id as unsigned 32-bit integers, the number
of documents as unsigned 64-bit, then a flag for each document (1: its doc_id is null), padding to 8 bytes, the doc_ids
(signed 64-bit) and the offsets of the documents' first ids in the part, one more than there are documents (unsigned 64-bit).

Parts hold ascending ranges of doc_id (nulls first; rows that repeat an id are ordered by a hash of their text), so a
document's start in the whole is its part's base, a prefix sum over the parts' sizes, plus its offset. Files are
written under a temporary name and renamed: a task that runs twice leaves one complete part. Readers map the files
into memory where the folder is a local path; elsewhere they read the index and, through Arrow's file systems, the ranges of ids
that they need.

Each document ends with ``end_id``; null and empty texts are the end id alone; very long texts are encoded whole. Repeated rows
are documents like others. A table without rows gives no parts. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC, VERSION = b"DITK", 1
SPAN = 1 << 20  # ids that a reader holds at once, more only for a longer document
CACHE = 1_400_000  # segments whose ids a worker keeps
MARKS = "!#$%&*,.;:?"
# where one of these occurs, white space isn't single or not plain (or the mark for cuts is there)
ODD = ("  ", " \n", "\n ", "\n\n", "\0", *(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"))
WORD = re.compile(r" ?\S+")
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Ids as bytes, through the tokenizers library, with a bounded cache of segments.

    A byte-level tokenizer cuts a text before every single space that a non-space follows, and nothing it does looks
    across such a cut, so the segments between are encoded once each and put together.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.cache: dict[str, bytes] = {}
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        # otherwise texts are encoded whole
        self.line = self.encode_line()
        self.cuts = self.line >= 0 and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])

    def encode_line(self) -> int:
        ids = self.tokenizer.encode("\n", add_special_tokens=False).ids
        return ids[0] if len(ids) == 1 else -1

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """As encode_all, for words without white space but for one space in front: joined by lines, whose end is a token of its own."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(ids == self.line)
        if len(ends) != len(words) - 1:  # never seen; whole again
            return self.encode_all(words)
        raw, width = ids.tobytes(), self.width
        ends = (ends * width).tolist()
        return [raw[i:j] for i, j in zip([0, *(e + width for e in ends)], [*ends, len(raw)], strict=True)]

    def segments(self, text: str) -> list[str]:
        """Cut before each single space and around each single line end, if non-spaces stand on both sides."""
        if text and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ODD):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        out = [""]
        for p in text.split(" "):
            if p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        # the first part has no space in front
        out[0 if out[0] else 1] = out[0 if out[0] else 1][1:]
        return [s for s in out if s]

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of segments that the cache lacks. Marks behind a letter are a token's start, so such endings are encoded apart."""
        split: list[tuple[str, str, str]] = []
        need: dict[str, None] = {}
        for s in missing:
            core = s.rstrip(MARKS)
            if len(core) < len(s) and core and core[-1].isalpha():
                tail = s[len(core) :]
                split.append((s, core, tail))
                for x in (core, tail):
                    if x not in self.cache:
                        need[x] = None
            else:
                need[s] = None
        words = list(filter(WORD.fullmatch, need))
        rest = need.keys() - set(words)
        fresh: dict[str, bytes] = {}
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            fresh.update(zip(part, self.encode_words(part), strict=True))
        if rest:
            others = list(rest)
            fresh.update(zip(others, self.encode_all(others), strict=True))
        get = self.cache.get
        for s, core, tail in split:
            fresh[s] = (fresh.get(core) or get(core)) + (fresh.get(tail) or get(tail))
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.encode_all(texts)
        cut = [self.segments(t) for t in texts]
        known = self.cache
        known.update(self.learn(set(chain.from_iterable(cut)).difference(known)))
        out = [b"".join(map(known.__getitem__, segments)) for segments in cut]
        if len(known) > CACHE:  # what came twice in the latest texts stays
            self.cache = {s: known[s] for s, n in Counter(chain.from_iterable(cut)).items() if n > 1}
        return out


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _uri(folder: str) -> str:
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def index_bytes(ids: np.ndarray, flags: bytes, sizes: np.ndarray, width: int) -> bytes:
    head = MAGIC + np.array([VERSION, width], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes() + flags
    head += b"\0" * (-len(head) % 8)
    offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.uint64))]).astype("<u8")
    return head + ids.astype("<i8").tobytes() + offsets.tobytes()


class Part:
    """One part: mapped into memory, or read by ranges where that isn't possible."""

    def __init__(self, folder: str, name: str):
        files, base = _open(folder)

        def view(suffix: str) -> np.ndarray:
            path = f"{base}/{name}.{suffix}"
            if isinstance(files, fs.LocalFileSystem):
                return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
            with files.open_input_file(path) as f:
                return np.frombuffer(f.read(), np.uint8)

        head = view("idx")
        if bytes(head[:4]) != MAGIC:
            raise ValueError(f"{folder}/{name}.idx isn't an index of token ids")
        version, width = head[4:12].view("<u4").tolist()
        if version != VERSION:
            raise ValueError(f"version {version} of {folder}/{name}.idx isn't known")
        n = int(head[12:20].copy().view("<u8")[0])
        self.null = head[20 : 20 + n].astype(bool)
        at = 20 + n + -(20 + n) % 8
        self.doc_ids = head[at : at + 8 * n].view("<i8")
        self.offsets = head[at + 8 * n : at + 16 * n + 8].view("<u8")
        self.width = width
        self.file = None if isinstance(files, fs.LocalFileSystem) else files.open_input_file(f"{base}/{name}.bin")
        if self.file is None:
            self.ids = view("bin").view(f"<u{width}")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def documents(self, a: int, b: int) -> np.ndarray:
        """The ids of documents a to b - 1, end to end."""
        i, j = int(self.offsets[a]), int(self.offsets[b])
        if self.file is None:
            return self.ids[i:j]
        return np.frombuffer(self.file.read_at((j - i) * self.width, i * self.width), f"<u{self.width}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, parts: int | None = None) -> DataFrame:
    """Write docs' token ids below ``folder``; ``(part, name, n_docs, n_tokens, base)`` of each part, as a stored table."""
    spark = docs.sparkSession
    common.small_batches(spark, 1000)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    rows = rows.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = encoder(tokenizer)
        end = np.array([end_id], code.dtype).tobytes()
        part = TaskContext.get().partitionId()
        name = f"part-{part:05d}"
        files, base = _open(_uri(folder))
        files.create_dir(base, recursive=True)
        trial = f"{base}/_{name}-{uuid.uuid4().hex}"
        ids, sizes, flags = array("q"), array("q"), bytearray()
        with files.open_output_stream(f"{trial}.bin") as out:
            for batch in batches:
                ids.frombytes(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
                flags += np.asarray(batch.column(0).is_null()).astype(np.uint8).tobytes()
                for line in code.encode([t or "" for t in batch.column(1).to_pylist()]):
                    out.write(line + end)
                    sizes.append(len(line) // code.width + 1)
        if not ids:
            files.delete_file(f"{trial}.bin")
            return
        with files.open_output_stream(f"{trial}.idx") as out:
            out.write(index_bytes(np.frombuffer(ids, np.int64), bytes(flags), np.frombuffer(sizes, np.int64), code.width))
        for suffix in ("bin", "idx"):
            files.move(f"{trial}.{suffix}", f"{base}/{name}.{suffix}")
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([name]), pa.array([len(ids)]), pa.array([sum(sizes)])], names=["part", "name", "n_docs", "n_tokens"])

    done = common.stored(rows.mapInArrow(run, "part long, name string, n_docs long, n_tokens long"), "parts")
    # prefix sums by a join of each part with the parts before it would be quadratic; a part is one row, and there are as many as tasks
    sizes = sorted(map(tuple, done.collect()))
    bases = np.concatenate([[0], np.cumsum([s[3] for s in sizes])]).astype(int).tolist()
    return spark.createDataFrame([(*s, b) for s, b in zip(sizes, bases, strict=False)], "part long, name string, n_docs long, n_tokens long, base long")


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(doc_id, n_tokens)`` of each row: its ids and one for its end; 0 for a null or empty text."""
    common.small_batches(docs.sparkSession, 1000)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = encoder(tokenizer)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = [len(line) // code.width + 1 if t else 0 for t, line in zip(texts, code.encode(texts), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long")


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files."""
    parts = manifest.repartition(max(1, manifest.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions"))), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                part = Part(_uri(folder), name)
                at = 0
                while at < len(part):
                    # some documents at a time: as many as hold SPAN ids, one at least
                    end = max(at + 1, min(at + 10_000, int(np.searchsorted(part.offsets, part.offsets[at] + np.uint64(SPAN), "right")) - 1, len(part)))
                    offsets = part.offsets[at : end + 1].astype(np.int64)
                    ids = part.documents(at, end)
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in itertools.pairwise((offsets - offsets[0]).tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(part.doc_ids[at:end]), mask=np.array(part.null[at:end])), pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    at = end

    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
