"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct segments (a text cut before each run of spaces: no piece reaches across such a cut, which is checked
when a model is loaded) are concatenated and indexed by a suffix array, made by prefix doubling to the longest piece's length. Every piece
is binary-searched for its range of occurrences; the ranges expand to edges (begin, end, score), sorted by position. Then the edges are
relaxed:

* a unigram model's edges by dynamic programming: the best sum of scores from the left (``relax_best_sum``);
* a merge (BPE) model's edges by merging, since its result isn't the best sum: in each round every segment joins the two
  adjacent symbols whose union is the edge of best score, leftmost first (``relax_merges``), all segments at once.

Characters without a piece become byte pieces, or the unknown id if the model has none. Decoding turns ids into text again.
Null and empty texts have no ids; very long texts are encoded whole; repeated rows are rows like others; a table without rows
gives none; other columns, whatever their names, play no part. Decoding gives the text that the model saw: its own mark for a
space, U+2581, comes back as a space.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
CACHE = 1_000_000  # segments whose ids a worker keeps
MARKS = "!#$%&*,.;:?"
_MODELS: dict[str, Model] = {}


def suffix_array(codes: np.ndarray, width: int) -> np.ndarray:
    """Places in order of their suffixes' first ``width`` or more codes; prefix doubling."""
    rank = codes.astype(np.int64) + 1
    done = 1
    order = np.argsort(rank, kind="stable")
    while done < width:
        ahead = np.zeros_like(rank)
        ahead[:-done] = rank[done:] if done < len(rank) else 0
        key = rank * (int(rank.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        rank = np.empty_like(rank)
        rank[order] = new
        done *= 2
        if new[-1] == len(rank):
            break
    return order


class Model:
    """Pieces, their scores and the special ids of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.unknown = sp.unk_id()
        self.byte = np.full(256, -1, np.int64)
        normal: list[tuple[str, int]] = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((p, i))
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.ids = np.array([i for _, i in normal], np.int64)
        self.score = np.array([sp.get_score(i) for i in range(n)])
        self.texts = [p for p, _ in normal]
        self.single = {p: i for p, i in normal if len(p) == 1}
        self.longest = max(map(len, self.texts))
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.texts)
        self.lines = not any("\n" in p for p in self.texts)
        behind = {b for p in self.texts for a, b in pairwise(p) if a.isalpha()}
        self.marks = "".join(c for c in MARKS if c not in behind)
        # a merge model scores by rank: whole numbers, none twice
        normal_scores = self.score[[i for p, i in normal if len(p) > 1]]
        self.merges = bool(len(normal_scores)) and bool(np.all(normal_scores == np.round(normal_scores)))
        alphabet = sorted({c for p in self.texts for c in p})
        self.code = {c: k + 1 for k, c in enumerate(alphabet)}
        self.length = np.array([len(p) for p in self.texts], np.int64)
        self.matrix = np.zeros((len(self.texts), self.longest), np.int32)
        for k, p in enumerate(self.texts):
            self.matrix[k, : len(p)] = [self.code[c] for c in p]
        self.cache: dict[str, bytes] = {}

    # -- the lattice

    def edges(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, begins of segments, edge keys, edge ids) of concatenated segments; key = begin * (longest + 1) + length."""
        get = self.code.get
        codes = np.array([c for s in segments for c in (*[get(x, 0) for x in s], 0)], np.int32)
        size = np.array([len(s) + 1 for s in segments], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        order = suffix_array(codes, self.longest)
        padded = np.concatenate([codes, np.zeros(self.longest, np.int32)])
        n, many = len(order), len(self.texts)
        span = np.arange(self.longest)
        inside = span[None, :] < self.length[:, None]

        def place(after: bool) -> np.ndarray:
            """For each piece, how many suffixes are below it (after: not above it), read to its length."""
            low, high = np.zeros(many, np.int64), np.full(many, n, np.int64)
            while True:
                go = np.flatnonzero(low < high)
                if not len(go):
                    return low
                mid = (low[go] + high[go]) // 2
                there = padded[order[mid][:, None] + span[None, :]]
                mine = self.matrix[go]
                differ = (there != mine) & inside[go]
                at = differ.argmax(axis=1)
                rows = np.arange(len(go))
                same = ~differ[rows, at]
                below = there[rows, at] < mine[rows, at]
                right = np.where(same, after, below)
                low[go] = np.where(right, mid + 1, low[go])
                high[go] = np.where(right, high[go], mid)

        first, last = place(False), place(True)
        count = last - first
        which = np.repeat(np.arange(many), count)
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at = order[np.repeat(first, count) + inner]
        key = at * (self.longest + 1) + self.length[which]
        by = np.argsort(key, kind="stable")
        return codes, begin, key[by], self.ids[which[by]]

    # -- relaxing

    def relax_merges(self, segments: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each segment its symbols (begin, length, id or -1), by merging."""
        codes, begin, keys, ids = self.edges(segments)
        wide = self.longest + 1
        owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        at = np.concatenate([np.arange(b, b + len(s)) for b, s in zip(begin.tolist(), segments, strict=True)]) if segments else np.zeros(0, np.int64)
        size = np.ones(len(at), np.int64)
        score = self.score[ids]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def look(a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = np.where(n < wide, a * wide + n, -1)
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return k, keys[k] == key

        best = np.full(max(0, len(at) - 1), -np.inf)
        if len(at) > 1 and len(keys):
            k, ok = look(at[:-1], size[:-1] + size[1:])
            best = np.where(ok & (owner[1:] == owner[:-1]), score[k], -np.inf)
        while len(best) and len(keys):
            live = np.flatnonzero(best > -np.inf)
            if not len(live):
                break
            # the first best pair of each segment
            seg = owner[live]
            edge = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            top = np.maximum.reduceat(best[live], edge)
            hit = live[best[live] == np.repeat(top, np.diff(np.concatenate([edge, [len(live)]])))]
            hit = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])]
            size[hit] += size[hit + 1]
            keep = np.ones(len(at), bool)
            keep[hit + 1] = False
            # segments without a merge this round are finished
            active = np.zeros(len(segments), bool)
            active[owner[hit]] = True
            on = active[owner]
            if not on.all():
                rest = keep & ~on
                done.append((owner[rest], at[rest], size[rest]))
                keep &= on
            moved = np.cumsum(keep) - 1
            changed = moved[hit]
            at, size, owner = at[keep], size[keep], owner[keep]
            old = np.concatenate([best, [-np.inf]])[keep][:-1] if len(at) else best[:0]
            best = old
            if len(at) > 1:
                best[owner[1:] != owner[:-1]] = -np.inf
                near = np.unique(np.concatenate([changed, changed - 1]))
                near = near[(near >= 0) & (near < len(best))]
                k, ok = look(at[near], size[near] + size[near + 1])
                best[near] = np.where(ok & (owner[near] == owner[near + 1]), score[k], -np.inf)
        done.append((owner, at, size))
        owner, at, size = (np.concatenate(c) for c in zip(*done, strict=True))
        by = np.argsort(at, kind="stable")
        owner, at, size = owner[by], at[by], size[by]
        if len(keys):
            k, ok = look(at, size)
            own = np.where(ok, ids[k], -1)
        else:
            own = np.full(len(at), -1)
        out: list[list[tuple[int, int, int]]] = [[] for _ in segments]
        for o, a, n, i in zip(owner.tolist(), (at - begin[owner] if len(at) else at).tolist(), size.tolist(), own.tolist(), strict=True):
            out[o].append((a, n, i))
        return out

    def relax_best_sum(self, segments: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each segment the symbols of the best sum of scores; an unknown character costs 10 below the least score."""
        _, begin, keys, ids = self.edges(segments)
        wide = self.longest + 1
        unknown = float(self.score[self.ids].min()) - 10
        out = []
        for b, s in zip(begin.tolist(), segments, strict=True):
            best = [0.0] + [-np.inf] * len(s)
            back: list[tuple[int, int]] = [(0, -1)] * (len(s) + 1)
            lo, hi = np.searchsorted(keys, [b * wide, (b + len(s)) * wide])
            own: dict[int, list[tuple[int, int]]] = {}
            for key, i in zip(keys[lo:hi].tolist(), ids[lo:hi].tolist(), strict=True):
                own.setdefault(key // wide - b, []).append((key % wide, i))
            for a in range(len(s)):
                steps = own.get(a, [])
                if not any(n == 1 for n, _ in steps):
                    steps = [*steps, (1, -1)]
                for n, i in steps:
                    value = best[a] + (self.score[i] if i >= 0 else unknown)
                    if value > best[a + n]:
                        best[a + n], back[a + n] = value, (a, i)
            symbols, e = [], len(s)
            while e:
                a, i = back[e]
                symbols.append((a, e - a, i))
                e = a
            out.append(symbols[::-1])
        return out

    # -- texts

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids as 32-bit little-endian bytes."""
        if not segments:
            return []
        symbols = (self.relax_merges if self.merges else self.relax_best_sum)(segments)
        out = []
        for s, row in zip(segments, symbols, strict=True):
            ids: list[int] = []
            for a, n, i in row:
                if i >= 0:
                    ids.append(i)
                elif self.byte[0] >= 0:
                    ids += self.byte[list(s[a : a + n].encode())].tolist()
                elif not ids or ids[-1] != self.unknown:
                    ids.append(self.unknown)
            out.append(np.array(ids, "<u4").tobytes())
        return out

    def segments(self, text: str) -> list[str]:
        """A normalized text's segments: cut before each run of spaces, and around line ends if no piece has one."""
        if not self.cuts:
            return [text]
        if SPACE + SPACE not in text and "\0" not in text:
            text = text.replace(SPACE, "\0" + SPACE)
            if self.lines:
                text = text.replace("\n", "\0\n\0")
            return list(filter(None, text.split("\0")))
        parts = text.split(SPACE)
        out = [parts[0]] if parts[0] else []
        run = ""
        for p in parts[1:]:
            run += SPACE
            if p:
                out.append(run + p)
                run = ""
        if run:
            out.append(run)
        return out

    def learn(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of segments that the cache lacks. No piece has such a mark behind a letter, so such endings are encoded apart."""
        split: list[tuple[str, str, str]] = []
        need: dict[str, None] = {}
        for s in missing:
            core = s.rstrip(self.marks)
            if len(core) < len(s) and core and core[-1].isalpha():
                tail = s[len(core) :]
                split.append((s, core, tail))
                for x in (core, tail):
                    if x not in self.cache:
                        need[x] = None
            else:
                need[s] = None
        fresh: dict[str, bytes] = {}
        part: list[str] = []
        size = 0
        for s in need:
            part.append(s)
            size += len(s) + 1
            if size > 1_000_000:
                fresh.update(zip(part, self.encode_segments(part), strict=True))
                part, size = [], 0
        fresh.update(zip(part, self.encode_segments(part), strict=True))
        for s, core, tail in split:
            fresh[s] = (fresh[core] if core in fresh else self.cache[core]) + (fresh[tail] if tail in fresh else self.cache[tail])
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as the library gives them."""
        cut = [self.segments(self.sp.normalize(t)) if t else [] for t in texts]
        known = self.cache
        known.update(self.learn(set(chain.from_iterable(cut)).difference(known)))
        out = [b"".join(map(known.__getitem__, segments)) for segments in cut]
        if len(known) > CACHE:  # what came twice in the latest texts stays
            self.cache = {s: known[s] for s, n in Counter(chain.from_iterable(cut)).items() if n > 1}
        return out


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """``(doc_id, n_tokens, ids_crc32, round_trip)`` of each document, with ``ids`` the ids as well.

    ids_crc32: of the ids as little-endian unsigned 32-bit integers. round_trip: decoding gives the text back (U+2581 as a space).
    """
    common.small_batches(docs.sparkSession, 1000)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        lines = m.encode(texts)
        arrays = [np.frombuffer(x, "<u4") for x in lines]
        table = decode_table(m)
        back = [decode_fast(m, table, a) == t.replace(SPACE, " ") for a, t in zip(arrays, texts, strict=True)]
        cols = [batch.column(0), pa.array([len(a) for a in arrays], pa.int64()), pa.array([zlib.crc32(x) for x in lines], pa.int64()), pa.array(back)]
        names = ["doc_id", "n_tokens", "ids_crc32", "round_trip"]
        if ids:
            cols.append(pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * ids
    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def decode_table(m: Model) -> list[bytes]:
    """Each id's bytes."""
    if not hasattr(m, "table"):
        m.table = [bytes([int(p[3:-1], 16)]) if m.sp.is_byte(i) else b"" if m.sp.is_control(i) else p.encode() for i, p in enumerate(m.names)]
    return m.table


def decode_fast(m: Model, table: list[bytes], ids: np.ndarray) -> str:
    text = b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` of rows ``(doc_id, ids)``; null ids give a null text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(path)
        table = decode_table(m)
        texts = [None if i is None else decode_fast(m, table, np.array(i, np.int64)) for i in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return common.map_batches(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, text string")
