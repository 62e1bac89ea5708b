"""Words of texts as 64-bit hashes, and hashes of runs of words.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. A word's hash is its XXH64; a run's hash mixes the hashes of its halves
at every level, so no sum over the words could cancel out.
"""

from __future__ import annotations

import numpy as np
import xxhash

_LIMIT = 500_000
_ODD = [np.uint64(int(x) | 1) for x in np.random.default_rng(77).integers(1 << 62, 1 << 63, 16, np.uint64)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_CACHE = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 of each word; the cache of hashes is bounded."""
    if len(_CACHE) > _LIMIT:
        _CACHE.clear()
    return np.fromiter(map(_CACHE.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads each input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def both(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """The hash of two things one after the other."""
    return mix(a * _ODD[level] + b * _ODD[level + 8])


def runs(hashes: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size the hash of each so many consecutive words, by halves: powers of two first, then those that make up the size."""
    found: list[np.ndarray | None] = [None] * len(sizes)
    done = [0] * len(sizes)
    level, power = 0, hashes
    while True:
        for i, size in enumerate(sizes):
            if size >> level & 1:
                part = power[done[i] : max(0, len(hashes) - size + 1) + done[i]]
                found[i] = part if found[i] is None else both(found[i], part, level)
                done[i] += 1 << level
        if all(d == size for d, size in zip(done, sizes, strict=True)):
            return [mix(x + np.uint64(size)) for x, size in zip(found, sizes, strict=True)]
        step = 1 << level
        power = both(power[:-step], power[step:], level)
        level += 1


def shingle_sets(texts: list[bytes | None], shingle: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles, A-Z lower-cased; of the whole sequence if it has fewer words."""
    cut = [t.lower().split() if t else [] for t in texts]
    size = [len(w) for w in cut]
    hashes = [word_hashes(w) for w in cut]
    at = np.concatenate([[0], np.cumsum(size)]).tolist()
    all_runs = runs(np.concatenate(hashes), shingle)[0] if hashes else np.zeros(0, np.uint64)
    out = []
    for i, n in enumerate(size):
        own = all_runs[at[i] : at[i] + n - shingle + 1] if n >= shingle else runs(hashes[i], n)[0] if n else hashes[i]
        own = np.sort(own)
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
    return out
