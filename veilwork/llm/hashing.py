"""64-bit hashes of words and word windows of many texts at once (numpy on Arrow buffers)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(77)
_SYMBOL = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**62)) * 2 + 1
_WORD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column (no nulls), and the offsets of its rows."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word of texts that lie one after the other in `data`, A-Z lower-cased."""
    low, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data, offsets = LOWER[data[low:low + n]], offsets - low
    visible = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = visible.copy(), visible.copy()
    first[1:] &= ~visible[:-1] | edge[1:-1]
    last[:-1] &= ~visible[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * power[:n], out=sums[1:])
    return np.searchsorted(offsets, s, "right") - 1, mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))


def slices(offsets: np.ndarray, most: int = 1 << 22) -> list[tuple[int, int]]:
    """Ranges of rows with about `most` bytes, a longer text alone."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def shingles(text: np.ndarray, word: np.ndarray, n_texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of `size` words, as sorted (text number, hash); a shorter text is one window as a whole."""
    if not len(word):
        return text, word
    counts = np.bincount(text, minlength=n_texts)
    n = max(0, len(word) - size + 1)
    whole = text[:n] == text[size - 1:]
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += word[k:k + n] * _WORD[k]
    t, h = text[:n][whole], mix(h[whole])
    short = (counts[text] < size)
    if short.any():
        st, sw = text[short], word[short]
        begin = np.flatnonzero(np.concatenate(([True], st[1:] != st[:-1])))
        place = np.arange(len(st)) - np.repeat(begin, np.diff(np.append(begin, len(st))))
        total = np.add.reduceat(sw * _WORD[place], begin)
        t = np.concatenate((t, st[begin]))
        h = np.concatenate((h, mix(total ^ (counts[st[begin]].astype(np.uint64) + np.uint64(1)))))
    order = np.lexsort((h, t))
    t, h = t[order], h[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    return t[new], h[new]
