"""Order MinHash sketches and banded alignment of word shingles."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import xxhash

from pixelloom.llm.bpe import Numbered
from pixelloom.llm.common import held

WORD = re.compile(r"\w+")
SHINGLE = 5
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, keeping those of recurring words up to a bounded number."""

    def __init__(self, keep: int = 300_000):
        self.keep = keep
        self.known = Numbered(lambda w: xxhash.xxh3_64_intdigest(w.encode(errors="replace")))

    def of(self, text: str) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known.clear()
        words = WORD.findall(text.lower())
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def word_hashes() -> WordHashes:
    return held(("hashes",), WordHashes)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words, in text order; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    width = min(SHINGLE, n)
    out = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k]
    return mixed(out + np.uint64(width))


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence number mixed in, so that repeats differ."""
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    index = np.arange(len(s))
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(s) else np.zeros(0, bool)
    nth = index - np.maximum.accumulate(np.where(first, index, 0))
    if not nth.any():
        return s
    out = s.copy()
    out[order] = mixed(ranked + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return out


def order_minhash(s: np.ndarray, functions: int, sample: int = 2) -> np.ndarray:
    """For each hash function, a hash of the ``sample`` least labelled shingles, in text order."""
    marked = labelled(s)
    seeds = mixed(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty(functions, np.uint64)
    n = len(s)
    take = min(sample, n)
    rows = max(1, (1 << 18) // max(n, 1))  # functions at a time: bounded memory for the longest texts
    for low in range(0, functions, rows):
        seed = seeds[low : low + rows]
        rank = (marked[None, :] ^ seed[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        rank ^= rank >> np.uint64(32)
        rank *= np.uint64(0x94D049BB133111EB)
        if take < n:
            at = np.sort(np.argpartition(rank, take - 1, axis=1)[:, :take], axis=1)
        else:
            at = np.tile(np.arange(n), (len(seed), 1))
        h = np.zeros(len(seed), np.uint64)
        for k in range(take):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + marked[at[:, k]])
        out[low : low + rows] = h
    return out


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many values two sequences share at their starts, and at their ends behind that."""
    least = min(len(a), len(b))
    unlike = np.flatnonzero(a[:least] != b[:least])
    first = int(unlike[0]) if len(unlike) else least
    left = least - first
    unlike = np.flatnonzero(a[::-1][:left] != b[::-1][:left])
    return first, int(unlike[0]) if len(unlike) else left


def dense_common(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence, bit-parallel: a row of the table is one integer of len(b) bits."""
    values, at = np.unique(b, return_inverse=True)
    order, edge = np.argsort(at, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(at))])
    bits = np.zeros(len(b), np.uint8)
    masks: dict[int, int] = {}
    codes = np.searchsorted(values, a)
    known = values[np.minimum(codes, len(values) - 1)] == a
    every = (1 << len(b)) - 1
    row = every
    for code in codes[known].tolist():
        if (mask := masks.get(code)) is None:
            own = order[edge[code] : edge[code + 1]]
            bits[own] = 1
            mask = masks[code] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            bits[own] = 0
        hit = row & mask
        row = ((row + hit) | (row - hit)) & every
    return len(b) - row.bit_count()


def alignment(a: np.ndarray, b: np.ndarray, least: float) -> int:
    """Length of the longest common subsequence of two shingle sequences, or 0 where it falls below ``least`` anyway.

    Texts whose in-order overlap reaches ``least`` differ by at most a known number
    of insertions and deletions, so only equal shingles within that band of the diagonal
    are looked up. Their number is counted before they are listed: where texts repeat
    themselves so much that there are many, a bit-parallel table of the same length takes over. Memory thus
    follows the texts' lengths, not the product of their repeats.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    if min(n, m) < need:
        return 0
    band = n + m - 2 * need
    first, last = common_ends(a, b)
    ends = first + last
    a, b = a[first : n - last], b[first : m - last]
    n, m = len(a), len(b)
    if not n or not m:
        return ends if ends >= need else 0
    # Positions of each value in b are a run of sorted (value, position) keys; the band cuts a part of it.
    values, at = np.unique(b, return_inverse=True)
    keys = at * (m + 1) + np.arange(m)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    code = np.minimum(np.searchsorted(values, a), len(values) - 1)
    rows = np.flatnonzero(values[code] == a)
    if len(rows) + ends < need:
        return 0
    base = code[rows] * (m + 1)
    low = np.searchsorted(keys, base + np.maximum(rows - band, 0), "left")
    high = np.searchsorted(keys, base + np.minimum(rows + band, m - 1), "right")
    hits = np.maximum(high - low, 0)
    if int((hits > 0).sum()) + ends < need:
        return 0
    total = int(hits.sum())
    if total > 8 * (n + m):
        found = dense_common(a, b) + ends
        return found if found >= need else 0
    cols = order[np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(total)]
    rows = np.repeat(rows, hits)
    # Longest increasing run of columns, rows ascending and columns descending within a row.
    seq = cols[np.lexsort((-cols, rows))]
    if len(seq) == len(np.unique(rows)) and (np.diff(seq) > 0).all():
        return len(seq) + ends
    tails: list[int] = []
    for c in seq.tolist():
        k = bisect_left(tails, c)
        if k == len(tails):
            tails.append(c)
        else:
            tails[k] = c
    return len(tails) + ends


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """In-order Jaccard similarity of two shingle sequences: common over all; 1 for two empty ones; 0 when below ``least``."""
    if not len(a) and not len(b):
        return 1.0
    common = alignment(a, b, least)
    value = common / (len(a) + len(b) - common)
    return value if value >= least - 1e-12 else 0.0
