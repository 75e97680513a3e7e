"""Words and word shingles of whole texts as 64-bit hashes, a block of texts at a time.

A word is a maximal run of bytes outside {0x20, 0x09-0x0D}. Blocks hold about a
megabyte, so the memory needed does not depend on how many or how long texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: One odd multiplier for each place in a shingle.
_PLACE = [(0xD6E8FEB86659FD93 * pow(0xC2B2AE3D27D4EB4F, i, 1 << 64) | 1) % (1 << 64) for i in range(64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def _hash_block(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word; ``breaks`` are places where a text begins."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    cut[1:n] = space[:-1]
    cut[breaks] = True
    begin = np.flatnonzero(cut[:n] & ~space)
    cut[1:n] = space[1:]
    cut[breaks] = True
    end = np.flatnonzero(cut[1:] & ~space) + 1
    size = max(BLOCK, 1 << (n - 1).bit_length())
    total = np.cumsum((data.astype(U) + U(1)) * _powers(_BASE, size)[:n], dtype=U)
    value = total[end - 1]
    inner = begin > 0
    value[inner] -= total[begin[inner] - 1]
    value *= _powers(_INVERSE, size)[begin]
    return mix(value + (end - begin).astype(U) * U(0xA24BAED4963EE407)), begin, end


def word_blocks(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (first, last, hashes, ends, lengths) for texts first..last-1.

    ``hashes`` and ``lengths`` (bytes) are of the words in order; ``ends`` has
    last-first+1 offsets into them, one text after another.
    """
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
        if offsets[j] - offsets[i] <= 2 * block:
            base = offsets[i]
            hashes, begin, end = _hash_block(data[base : offsets[j]], offsets[i:j] - base)
            yield i, j, hashes, np.append(np.searchsorted(begin, offsets[i:j] - base), len(begin)), end - begin
        else:  # one text larger than a block: pieces that end at white space
            parts, lengths, at = [], [], offsets[i]
            while at < offsets[j]:
                to = min(at + block, offsets[j])
                while to < offsets[j] and not (stops := np.flatnonzero(SPACE[data[at:to]])).size:
                    to = min(to + block, offsets[j])
                if to < offsets[j]:
                    to = at + stops[-1] + 1
                hashes, begin, end = _hash_block(data[at:to], np.zeros(1, np.int64))
                parts.append(hashes)
                lengths.append(end - begin)
                at = to
            hashes = np.concatenate(parts)
            yield i, j, hashes, np.array([0, len(hashes)]), np.concatenate(lengths)
        i = j


def shingles(hashes: np.ndarray, ends: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and the number of the text of each.

    A text of 1 to k-1 words has one shingle of all its words; one without words none.
    """
    counts = np.diff(ends)
    n = len(hashes)
    text = np.repeat(np.arange(len(counts)), counts)
    long = max(0, n - k + 1)
    value = np.zeros(long, U)
    for i in range(k):
        value += hashes[i : i + long] * U(_PLACE[i])
    whole = text[:long] == text[k - 1 :] if long else np.zeros(0, bool)
    value, owner = value[whole], text[:long][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = counts[short].astype(U) * U(_PLACE[k])
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] += hashes[ends[short[has]] + i] * U(_PLACE[i])
        value, owner = np.concatenate([value, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    return mix(value), owner


#: Bits of a shingle's hash that stay beside the number of its text.
KEPT = 44


def multisets(value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (text number above, 44 bits of hash below) and their counts."""
    key = (owner.astype(U) << U(KEPT)) | (value >> U(64 - KEPT))
    key.sort()
    if not len(key):
        return key, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.diff(np.append(first, len(key)))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """For each of n texts of a and its namesake of b: sum of minima over sum of maxima; 0 if neither has shingles."""
    (ka, ca), (kb, cb) = a, b
    weight = np.bincount((ka >> U(KEPT)).astype(np.int64), ca, n) + np.bincount((kb >> U(KEPT)).astype(np.int64), cb, n)
    both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    common = np.bincount((both >> U(KEPT)).astype(np.int64), np.minimum(ca[ia], cb[ib]), n)
    return np.divide(common, weight - common, out=np.zeros(n), where=weight > 0)
