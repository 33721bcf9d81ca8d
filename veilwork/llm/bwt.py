"""Burrows-Wheeler transforms of small string collections and their merge by interleave refinement (numpy)."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of strings joined with their end marks (0); end marks are ordered by place, so all suffixes differ."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:-step or None] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 512) + ahead
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if n == 0 or new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, transform) of one shard; the symbol before a string's start is its end mark."""
    order = suffix_order(symbols)
    return order, symbols[order - 1]


def merged_intervals(shards: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the shards' transforms; returns suffixes in merged order (place in the joined shards) and interval numbers.

    The interleave says for each merged rank which shard its suffix is from.  One refinement moves every suffix one symbol
    to the left by a stable sort of the preceding symbols, so after k of them the merged order is right for the first k
    symbols.  A bound between neighbours appears in the refinement in which their first k symbols begin to differ, so
    after `depth` refinements the suffixes between two bounds have a common prefix of at least `depth` symbols.
    No suffix is compared again.
    """
    parts = [transform(s) for s in shards]
    starts = np.cumsum([0] + [len(s) for s in shards[:-1]])
    places = np.concatenate([p[0] + at for p, at in zip(parts, starts)])
    before = np.concatenate([p[1] for p in parts])
    kind = np.uint8 if len(shards) <= 256 else np.uint16
    shard = np.repeat(np.arange(len(shards), dtype=kind), [len(s) for s in shards])
    n_ends = sum(int((s == 0).sum()) for s in shards)
    end_shards = np.repeat(np.arange(len(shards), dtype=kind), [int((s == 0).sum()) for s in shards])
    interleave, block = shard, np.zeros(len(shard), np.int32)
    symbol = np.empty_like(before)
    for _ in range(depth):
        symbol[np.argsort(interleave, kind="stable")] = before
        moved = np.argsort(symbol, kind="stable")
        symbols, blocks = symbol[moved], block[moved]
        interleave = interleave[moved]
        interleave[:n_ends] = end_shards  # suffixes that are end marks only stay in the order of their strings
        bound = np.empty(len(shard), bool)
        bound[:1] = False
        bound[1:] = (symbols[1:] != symbols[:-1]) | (blocks[1:] != blocks[:-1])
        bound[1:n_ends + 1] = True
        block = np.cumsum(bound, dtype=np.int32)
    merged = np.empty_like(places)
    merged[np.argsort(interleave, kind="stable")] = places
    return merged, block
