"""Hashed shingle sets of many texts at once, on their UTF-8 bytes.

Words are runs of anything but ASCII blanks, with A-Z lower-cased. A word's hash
is a polynomial over its bytes modulo 2**64, taken from running sums, then mixed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time (a longer word or text is taken whole).
STRIDE = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLAIN = _VALUE.copy()
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRIDE + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _UNDO)]
    return _powers


def poly_hashes(data: np.ndarray, first: np.ndarray, stop: np.ndarray, value: np.ndarray = _PLAIN) -> np.ndarray:
    """A hash of the bytes in each [first, stop)."""
    power, undo = _tables(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * power[: len(data)], dtype=np.uint64)])
    return mix((sums[stop] - sums[first]) * undo[first] + (stop - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word. ``ends``: first byte of each text and the end."""
    solid = ~_BLANK[data]
    if not solid.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[ends] = True
    before = np.concatenate([[False], solid[:-1]]) & ~cut[:-1]
    after = np.concatenate([solid[1:], [False]]) & ~cut[1:]
    first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after)
    return poly_hashes(data, first, last + 1, _VALUE), np.searchsorted(ends, first, side="right") - 1


def text_blocks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, first byte of each text and the end) of a string column; null is empty."""
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + STRIDE, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _texts_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As word_hashes; a text much longer than STRIDE is hashed in stretches that end at a blank."""
    if len(data) <= 2 * STRIDE:
        return word_hashes(data, ends)
    out, lo = [], 0  # one long text
    while lo < len(data):
        hi = min(len(data), lo + STRIDE)
        while hi < len(data) and not _BLANK[data[hi]]:
            more = np.flatnonzero(_BLANK[data[hi : hi + STRIDE]])
            hi = hi + int(more[0]) if len(more) else min(len(data), hi + STRIDE)
        out.append(word_hashes(data[lo:hi], np.array([0, hi - lo]))[0])
        lo = hi
    h = np.concatenate(out)
    return h, np.zeros(len(h), np.int64)


def shingle_sets(col: pa.Array, width: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of each text, a list for each run of texts."""
    for lo, hi, data, ends in text_blocks(col):
        w, owner = _texts_words(data, ends)
        n = np.bincount(owner, minlength=hi - lo)
        first = np.concatenate([[0], np.cumsum(n)])
        h = np.full(max(0, len(w) - width + 1), width, np.uint64)
        for k in range(width):
            h = mix(h * np.uint64(_BASE) + w[k : k + len(h)])
        sets = []
        for i, k in enumerate(n.tolist()):
            if k >= width:
                sets.append(np.unique(h[first[i] : first[i + 1] - width + 1]))
            elif k:
                x = np.array([k], np.uint64)
                for j in range(first[i], first[i + 1]):
                    x = mix(x * np.uint64(_BASE) + w[j : j + 1])
                sets.append(x)
            else:
                sets.append(np.zeros(0, np.uint64))
        yield sets
