"""Hashes of words and of word shingles for many texts at once, in numpy.

A word is a maximal run without ASCII white space; its hash is polynomial over its UTF-8 bytes, taken
from one running sum over all texts of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """Finalisation of 64-bit hashes (uint64)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        pair = []
        for base in (_BASE, inverse):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _powers = (pair[0], pair[1])
    return _powers


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in UTF-8 bytes."""
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span, the same wherever the span stands."""
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def packed(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about `most` bytes; texts are parted by one blank."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    lo = 0
    while lo < len(raw):
        hi, size = lo, 0
        while hi < len(raw) and (hi == lo or size + len(raw[hi]) < most):
            size += len(raw[hi]) + 1
            hi += 1
        offsets = np.zeros(hi - lo + 1, dtype=np.int64)
        np.cumsum([len(r) + 1 for r in raw[lo:hi]], out=offsets[1:])
        yield lo, hi, np.frombuffer(b" ".join(raw[lo:hi]) + b" ", dtype=np.uint8), offsets
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first word of each text, and the number of words at the end)."""
    starts, ends = word_spans(data)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


def windows(words: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(window hashes, text of each): all runs of `size` words; a shorter text has one window of all its words."""
    n = len(words)
    lengths = np.diff(first)
    parts, owners = [], []
    if n >= size:
        h = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : n - size + 1 + k]
        owner = np.searchsorted(first, np.arange(n - size + 1), "right") - 1
        whole = np.arange(n - size + 1) + size <= first[owner + 1]
        parts.append(mix(h[whole]))
        owners.append(owner[whole])
    for i in np.flatnonzero((lengths > 0) & (lengths < size)):
        h = int(lengths[i])
        for w in words[first[i] : first[i + 1]].tolist():
            h = (h * 0x165667B19E3779F9 + w) & 0xFFFFFFFFFFFFFFFF
        parts.append(mix(np.array([h], dtype=np.uint64)))
        owners.append(np.array([i]))
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return hashes[order], owner[order]


def bags(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, count) of the distinct windows of each text, sorted."""
    if not len(hashes):
        return owner, hashes, np.zeros(0, dtype=np.int64)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return o[at], h[at], np.diff(np.append(at, len(h)))
