"""Hashes of words, shingles and signatures of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes \x20 and \x09-\x0D separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and how many words each text has."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    space = IS_SPACE[joined]
    word = ~space
    start = np.flatnonzero(word[1:] & space[:-1]) + 1 if len(word) else np.empty(0, np.int64)
    if len(word) and word[0]:
        start = np.concatenate([[0], start])
    counts = np.diff(np.searchsorted(start, ends_of_texts, "left"), prepend=0)
    if not len(start):
        return np.empty(0, np.uint64), counts
    signs = joined[word].astype(np.uint64) + np.uint64(1)
    end = np.flatnonzero(space[1:] & word[:-1]) + 1
    length = end - start
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = np.arange(len(signs)) - np.repeat(first, length)
    powers = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
    sums = np.add.reduceat(signs * powers[place], first)
    return mix(sums ^ (length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), counts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its word shingles; fewer words are one shingle."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    for n in counts.tolist():
        own = words[at : at + n]
        at += n
        if n == 0:
            out.append(own)
            continue
        k = min(width, n)
        rolled = np.full(n - k + 1, (k * int(_BASE)) % 2**64, np.uint64)
        for i in range(k):
            rolled = mix(rolled * np.uint64(3) + own[i : n - k + 1 + i])
        out.append(np.unique(rolled))
    return out


def permutations(count: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd factors and offsets of `count` permutations of the unsigned integers of a kind."""
    numbers = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _BASE)
    return (numbers[:count] | np.uint64(1)).astype(kind), numbers[count:].astype(kind)


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """Keys of each signature's bands of `rows` values: one column a band. Bands never share keys on purpose."""
    bands = values.shape[1] // rows
    keys = np.empty((len(values), bands), np.int64)
    for b in range(bands):
        key = np.full(len(values), ((b + 1) * int(_BASE)) % 2**64, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(5) + values[:, b * rows + r].astype(np.uint64))
        keys[:, b] = key.view(np.int64)
    return keys
