"""Sets of word shingles as sorted 64-bit hashes, for a block of texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.int32)
_LOWER[0x41:0x5B] += 32
#: A word's hash adds up a random number for each byte at each place; beyond PLACES the numbers are multiplied by one of the place's round.
PLACES = 64
_RANDOM = np.random.default_rng(20_240_229)
_TABLE = _RANDOM.integers(0, 1 << 64, (PLACES, 256), np.uint64).ravel()
_ROUNDS = _RANDOM.integers(0, 1 << 63, 1024, np.uint64) * np.uint64(2) + np.uint64(1)
#: A longer run of bytes is cut at white space and hashed part by part.
SLICE = 1_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of ``raw``; ``begins``: where texts begin."""
    n = len(raw)
    white = _SPACE[raw]
    new = np.ones(n, bool)  # a word starts after white space or at a text's start
    new[1:] = white[:-1]
    new[begins] = True
    start = np.flatnonzero(new & ~white)
    last = np.ones(n, bool)
    last[:-1] = white[1:]
    last[begins[begins > 0] - 1] = True
    stop = np.flatnonzero(last & ~white) + 1
    size = stop - start
    place = np.arange(n, dtype=np.int32)
    origin = np.zeros(n, np.int32)
    origin[start] = start
    place -= np.maximum.accumulate(origin)
    value = _TABLE[((place & (PLACES - 1)) << 8) | _LOWER[raw]]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        turn = (place[far] // PLACES).astype(np.uint64)
        value[far] = mixed(value[far]) * _ROUNDS[turn % np.uint64(len(_ROUNDS))] * (turn // np.uint64(len(_ROUNDS)) * np.uint64(2) + np.uint64(1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    return mixed(sums[stop] - sums[start] + size.astype(np.uint64)), start


def word_hashes(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, how many words each text has). Words: runs of bytes that aren't white space, A-Z lower-cased.

    More than SLICE bytes are hashed in slices that end at white space, so memory beyond the hashes
    does not grow with the length of a text (a single word is never cut).
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    begins = begins[begins < len(raw)]
    hashes, starts, a = [], [], 0
    while a < len(raw):
        b = a + SLICE
        while b < len(raw) and not (held := np.flatnonzero(_SPACE[raw[b : b + SLICE]])).size:
            b += SLICE
        b = b + int(held[0]) if b < len(raw) else len(raw)
        inside = begins[(begins >= a) & (begins < b)] - a
        h, s = _words(raw[a:b], inside)
        hashes.append(h)
        starts.append(s + a)
        a = b
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(start, ends), prepend=0)


def sets(data: bytes, ends: np.ndarray, k: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles; a shorter text is one shingle, one without words none."""
    words, counts = word_hashes(data, ends)
    key = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for i in range(k):
        key = mixed(key * np.uint64(31) + padded[i : i + len(words)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(key[at : at + n - k + 1]))
        elif n:
            short = np.full(1, n, np.uint64)
            for w in words[at : at + n]:
                short = mixed(short * np.uint64(37) + w)
            out.append(short)
        else:
            out.append(key[:0])
        at += n
    return out
