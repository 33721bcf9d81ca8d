"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least max(least, 2 * q) words long, that neither neighbour extends.

* Periods below `SHORT` come from direct lag scans: the equal words at lag q form stretches of at least m = max(least - q, q), so
  looking at every m-th word meets each of them.
* Longer periods come in scales [Q, 2Q).  Grams of k = Q / 4 words are hashed, and a gram is an anchor when it is the least of a
  window of 3Q / 4 grams.  Inside a run the windows repeat at period distance, so equal anchors less than 2Q apart seed it.  A gram
  that itself has a period up to k / 2 is no anchor, which keeps equal anchors k / 2 apart; the runs of lower scales tell which these
  are.  If the whole period of a run is such a stretch, the run joins two neighbouring runs A and B of one period d, and the
  lags that bring B's words onto A's (q0, q0 + d, ...) seed it.
* Every seed is extended to both sides by comparing words, so a seed that is wrong costs time and changes nothing.

Texts are taken in slices of some megabytes, each word numbered by a dictionary of its slice (equal numbers are equal words);
one mark between two texts, found nowhere else, keeps them apart.  A long text is a slice of its own and costs about 12 bytes for
each of its bytes (numbers, anchors in chunks, vocabulary).

Edge cases: null and empty texts, and texts without words, have no runs and the collapsed text ''; each row is a document, also
with a repeated or null id; an empty table gives an empty result.  Input columns are carried only if named, in the struct
`carried`, so their names can't clash.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.hashing import mix, powers

SHORT, LEAST = 64, 12
SLICE, PIECE, CHUNK = 1 << 22, 1 << 20, 1 << 19
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_EDGE, _LOOK = 8, 7


class Vocabulary(dict):
    """Numbers new words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def word_numbers(raw: bytes, vocabulary: Vocabulary) -> array:
    """The numbers of a text's words, taken in pieces so that few words exist as objects at a time."""
    out, at = array("i"), 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        out.extend(map(vocabulary.__getitem__, raw[at:end].split()))
        at = end
    return out


# ---- extension
def _ahead(x: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on (i < j)."""
    done, step = 0, 16
    while (m := min(step, len(x) - j - done)) > 0:
        differ = x[i + done:i + done + m] != x[j + done:j + done + m]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + m, min(2 * step, CHUNK)
    return done


def _behind(x: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j (i < j)."""
    done, step = 0, 16
    while (m := min(step, i - done)) > 0:
        differ = (x[i - done - m:i - done] != x[j - done - m:j - done])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return done + k
        done, step = done + m, min(2 * step, CHUNK)
    return done


def _is_smallest(u: np.ndarray) -> bool:
    """Whether u is no repetition of a shorter part."""
    n, rest, p = len(u), len(u), 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            if np.array_equal(u[n // p:], u[:-(n // p)]):
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def _settle(x: np.ndarray, lags: np.ndarray, places: np.ndarray, least: int, found: set) -> None:
    """Extend the seeds (word place equals word place + lag) and keep the stretches that are runs."""
    order = np.lexsort((places, lags))
    lag, end = -1, -1
    for q, i in zip(lags[order].tolist(), places[order].tolist()):
        if (q == lag and i < end) or x[i] != x[i + q]:
            continue
        begin = i - _behind(x, i, i + q)
        lag, end = q, i + _ahead(x, i, i + q)
        length = end - begin + q
        if length >= max(least, 2 * q) and _is_smallest(x[begin:begin + q]):
            found.add((begin, length, q))


# ---- seeds
def _short_periods(x: np.ndarray, longest: int, least: int, found: set) -> None:
    for q in range(1, min(SHORT - 1, longest // 2) + 1):
        step = max(least - q, q)
        hit = np.flatnonzero(x[_EDGE:len(x) - q - _EDGE:step] == x[_EDGE + q:len(x) - _EDGE:step]) * step + _EDGE
        if not len(hit):
            continue
        reach = np.ones(len(hit), np.int64)
        for way in (1, -1):  # most chance hits end within a few words
            alive = np.ones(len(hit), bool)
            for t in range(1, _LOOK + 1):
                alive &= x[hit + way * t] == x[np.minimum(hit + way * t + q, len(x) - 1)]
                reach += alive
        hit = hit[reach >= min(step, _LOOK + 1)]
        _settle(x, np.full(len(hit), q), hit, least, found)


def _window(h: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each w neighbours."""
    op = np.minimum if least else np.maximum
    fill = np.uint64(2**64 - 1 if least else 0)
    n = len(h)
    blocks = np.full(-(-n // w) * w, fill, np.uint64)
    blocks[:n] = h
    blocks = blocks.reshape(-1, w)
    left = op.accumulate(blocks, axis=1).reshape(-1)
    right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(right[:n - w + 1], left[w - 1:n])


def _anchors(x: np.ndarray, k: int, w: int, periodic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams of k words that are the least of some window of w; periodic grams are left out."""
    places, hashes = [], []
    n, none = len(x) - k + 1, np.uint64(2**64 - 1)
    for low in range(0, max(n, 0), CHUNK):
        a, b = max(0, low - w), min(n, low + CHUNK + w)
        power, inverse = powers(b + k - a)
        sums = np.zeros(b + k - a, np.uint64)
        np.cumsum(mix(x[a:b + k - 1].astype(np.uint64)) * power[:b + k - 1 - a], out=sums[1:])
        h = mix((sums[k:] - sums[:-k]) * inverse[:b - a])
        h[periodic[a:b]] = none
        padded = np.concatenate((np.full(w - 1, none), h, np.full(w - 1, none)))
        chosen = (_window(_window(padded, w, True), w, False) == h) & (h != none)
        at = np.flatnonzero(chosen[low - a:low - a + CHUNK]) + low - a
        places.append(at + a)
        hashes.append(h[at])
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _neighbours(x: np.ndarray, runs: np.ndarray, low: int, high: int) -> tuple[list, list]:
    """Seeds of runs with periods in [low, high) that join two touching runs of one shorter period."""
    lags, places = [], []
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    end = runs[:, 0] + runs[:, 1]
    touching = np.flatnonzero((runs[1:, 2] == runs[:-1, 2]) & (runs[1:, 0] <= end[:-1]))
    for t in touching.tolist():
        (a, n, d), (b, m, _) = runs[t].tolist(), runs[t + 1].tolist()
        root = x[b:b + d]
        turn = next((j for j in (a + n - 2 * d + np.flatnonzero(x[a + n - 2 * d:a + n - d] == root[0])).tolist()
                     if np.array_equal(x[j:j + d], root)), None)
        if turn is None:
            continue
        first = (b - turn) % d
        q = np.arange(first + -(-(low - first) // d) * d, min(high, n + 2 * d, m + 2 * d), d)
        lags += q.tolist()
        places += np.maximum(a, b - q).tolist()
    return lags, places


def runs_of(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs in texts that lie one after the other in x, the longest first, with marks between."""
    found: set = set()
    longest = int(lengths[0]) if len(lengths) else 0
    _short_periods(x, longest, least, found)
    low = SHORT
    while 2 * low <= longest:
        texts = int(np.searchsorted(-lengths, -2 * low, "right"))  # the texts that can hold such a period
        part = x[:int(starts[texts - 1] + lengths[texts - 1])]
        k, w = low // 4, 3 * low // 4
        known = np.array([r for r in found if r[2] <= k // 2 and r[0] < len(part)], np.int64).reshape(-1, 3)
        change = np.zeros(len(part) + 2, np.int32)
        wide = known[known[:, 1] >= k]
        np.add.at(change, wide[:, 0], 1)
        np.add.at(change, wide[:, 0] + wide[:, 1] - k + 1, -1)
        places, hashes = _anchors(part, k, w, np.cumsum(change)[:max(0, len(part) - k + 1)] > 0)
        order = np.lexsort((places, hashes))
        places, hashes = places[order], hashes[order]
        lags, seeds = _neighbours(part, known, low, 2 * low)
        step = 1
        while step < len(places):
            near = (hashes[step:] == hashes[:-step]) & (places[step:] - places[:-step] < 2 * low)
            if not near.any():
                break
            at = np.flatnonzero(near & (places[step:] - places[:-step] >= low))
            lags += (places[at + step] - places[at]).tolist()
            seeds += places[at].tolist()
            step += 1
        _settle(part, np.array(lags, np.int64), np.array(seeds, np.int64), least, found)
        low *= 2
    return np.array(sorted(found), np.int64).reshape(-1, 3)


# ---- texts
def describe(texts: Sequence[bytes], least: int = LEAST) -> list[tuple[np.ndarray, bytes]]:
    """For each text its runs (start, length, period), by start and period, and its words without the repeated parts."""
    vocabulary = Vocabulary()
    numbers = [np.frombuffer(word_numbers(t, vocabulary), np.int32) for t in texts]
    names = list(vocabulary)
    order = sorted(range(len(texts)), key=lambda i: -len(numbers[i]))
    lengths = np.array([len(numbers[i]) for i in order], np.int64)
    starts = _EDGE + np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64) if len(order) else lengths
    x = -np.arange(1, int(lengths.sum()) + len(order) + 2 * _EDGE + 1, dtype=np.int32)  # a number below zero stands once
    for k, i in enumerate(order):
        x[starts[k]:starts[k] + lengths[k]] = numbers[i]
    runs = runs_of(x, starts, lengths, least)
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(order) + 1))
    out: list = [None] * len(texts)
    for k, i in enumerate(order):
        mine = runs[bounds[k]:bounds[k + 1]] - [starts[k], 0, 0]
        if not len(mine):
            out[i] = mine, b" ".join(_named(numbers[i], names))
            continue
        change = np.zeros(len(numbers[i]) + 1, np.int32)
        np.add.at(change, mine[:, 0] + mine[:, 2], 1)
        np.add.at(change, mine[:, 0] + mine[:, 1], -1)
        out[i] = mine[np.lexsort((mine[:, 2], mine[:, 0]))], b" ".join(_named(numbers[i][np.cumsum(change)[:-1] == 0], names))
    return out


def _named(numbers: np.ndarray, names: list[bytes]) -> Iterator[bytes]:
    """Joined words, some thousand at a time."""
    for at in range(0, len(numbers), 1 << 16):
        yield b" ".join(map(names.__getitem__, numbers[at:at + (1 << 16)].tolist()))


def find_runs(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text", least: int = LEAST) -> DataFrame:
    """Struct `carried`, runs (array of start, length, period; by start, then period), collapsed (the words outside repeated
    parts, joined by spaces)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
        low, size = 0, 0
        for i in range(len(column)):
            n = len(column[i].as_buffer())
            if i > low and size + n > SLICE:
                yield low, i
                low, size = i, 0
            size += n
        if low < len(column):
            yield low, len(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                got = describe([v.as_py() for v in batch.column(1)[low:high]], least)
                ends = np.concatenate(([0], np.cumsum([len(r) for r, _ in got]))).astype(np.int32)
                every = np.concatenate([r for r, _ in got])
                runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(
                    [pa.array(every[:, k], pa.int64()) for k in range(3)], fields=list(run_type)))
                collapsed = pa.array([t for _, t in got], pa.large_binary()).cast(pa.large_string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], runs, collapsed.cast(pa.string())],
                                                 ["carried", "runs", "collapsed"])

    kind = rows.schema["carried"].dataType.simpleString()
    return rows.mapInArrow(run, f"carried {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
