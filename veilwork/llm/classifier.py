"""Quality classifier by Bradley-Terry ranking.

A text has a vector of numbers: how often each of some hashed words and hashed runs of three bytes occur, and what shape its
characters, words and lines have.  Of a good and a bad document the good one should win: weights are learned from such pairs by
logistic loss on the difference of their vectors.  A document's strength is the product with the weights; the threshold is the
quantile of the training strengths that leaves the labelled share of good documents above it, and the score is a logistic curve
that takes the value `cut` there.

Only a bounded sample of labelled rows is fitted (`max_labels`, the rows with the least hashes); every document is scored.

Edge cases: null and empty texts get the score of a text without words; null labels are not learned from, of repeated
labels of a document the greatest counts; a null id is not held out; without labels of both kinds all scores are `cut`;
an empty table gives an empty result.  Extra columns are not carried.  Texts of any length are read whole, STEP bytes at a time
(a word longer than that counts as several), so that memory beside the text is a few numbers a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import Store
from veilwork.llm.hashing import LOWER, mix, text_buffer, word_hashes

_CLASSES = [range(65, 91), range(97, 123), range(48, 58), [10], [32, 9, 11, 12, 13], range(128, 256), [33], [63], [44, 46, 59, 58],
            [35], [42], [36], [37], [38], [124], [60, 62], [34, 39, 40, 41, 91, 93, 123, 125], [61, 95, 64, 47, 92, 43, 45, 126, 94, 96]]
_GROUPS = np.zeros((256, len(_CLASSES)))
for _k, _codes in enumerate(_CLASSES):
    _GROUPS[list(_codes), _k] = 1
N_SHAPE = 2 * len(_CLASSES) + 9
#: Buckets of words and of runs of three bytes (a power of two each).
BUCKETS = 256
N_FEATURES = N_SHAPE + 2 * BUCKETS
#: How much a hashed number counts beside one of shape before anything is learned.
HASHED = 0.1
STEP = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"#*$%&!|")] = True
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def chunks(data: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most `step` bytes that end behind a blank where there is one."""
    low = 0
    while low < len(data):
        high = min(low + step, len(data))
        if high < len(data):
            gaps = np.flatnonzero(_BLANK[data[low:high]])
            high = low + int(gaps[-1]) + 1 if len(gaps) else high
        yield low, high
        low = high


def distinct(hashes: np.ndarray) -> int:
    ordered = np.sort(hashes)
    return int(np.count_nonzero(ordered[1:] != ordered[:-1])) + 1 if len(ordered) else 0


def features(data: np.ndarray, step: int = STEP) -> np.ndarray:
    """Shares of character classes (and their roots), shapes of words and lines, roots of the shares of hashed words and runs."""
    counts, runs = np.zeros(256), np.zeros(BUCKETS)
    hashes, lines, breaks, marked, lone = [], [], 0, 0, 0
    for low, high in chunks(data, step):
        part = data[low:high]
        counts += np.bincount(part, minlength=256)
        _, h = word_hashes(part, np.array([0, len(part)]))
        visible = ~_BLANK[part]
        first, last = visible.copy(), visible.copy()
        first[1:] &= ~visible[:-1]
        last[:-1] &= ~visible[1:]
        marked += int((last & _MARK[part]).sum())
        lone += int((first & last).sum())
        line = np.cumsum(part == 10)
        hashes.append(h)
        lines.append(line[first] + breaks)
        breaks += int(line[-1])
        code = LOWER[data[max(0, low - 2):high]].astype(np.uint32)  # runs across two parts count in the second
        code = ((code[:-2] << 16 | code[1:-1] << 8 | code[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(24)
        runs += np.bincount(code, minlength=BUCKETS)
    w = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    line = np.concatenate(lines) if lines else np.zeros(0, np.int64)
    words, n = len(w), max(1, len(w))
    begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if words else np.zeros(0, np.int64)
    m, repeat, same = max(1, len(begin)), 0.0, 0.0
    if words:
        place = np.arange(words) - np.repeat(begin, np.diff(np.append(begin, words)))
        texts = np.add.reduceat(mix(w + place.astype(np.uint64) * _ODD[0]), begin)
        same = 1 - distinct(texts) / m
    if words > 2:
        triples = mix(w[:-2] * _ODD[0] + w[1:-1] * _ODD[1] + w[2:] * _ODD[2])
        repeat = 1 - distinct(triples) / (words - 2)
    share = counts @ _GROUPS / max(1, len(data))
    hashed = np.bincount((w >> np.uint64(56)).astype(np.int64), minlength=BUCKETS)
    return np.concatenate((share, np.sqrt(share), [
        np.log1p(words), np.log1p(len(begin)), distinct(w) / n, same, repeat, marked / n, lone / n,
        len(data) / n / 10, float(not words)], np.sqrt(hashed / n), np.sqrt(runs / max(1, len(data) - 2))))


def matrix(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(column)
    out = np.zeros((len(column), N_FEATURES), np.float32)
    for i in range(len(column)):
        out[i] = features(data[offsets[i]:offsets[i + 1]])
    return out


def centred(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    z[:, N_SHAPE:] *= HASHED
    return z


def fit(x: np.ndarray, good: np.ndarray, pairs: int = 200_000, rounds: int = 400, penalty: float = 1e-4,
        seed: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of the ranking learned from random pairs of a good and a bad row."""
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-9
    z = centred(x, mean, scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    win = rng.choice(np.flatnonzero(good), pairs)
    lose = rng.choice(np.flatnonzero(~good), pairs)
    weights, speed = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for step in range(rounds):
        rows = slice(step * 4_000 % pairs, step * 4_000 % pairs + 4_000)
        diff = z[win[rows]] - z[lose[rows]]
        miss = 1 / (1 + np.exp(np.clip(diff @ weights, -30, 30)))
        speed = 0.9 * speed + miss @ diff / len(diff) - penalty * weights
        weights = weights + 0.1 * speed
    return mean, scale, weights


def held_out(key: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
             folds: int = 5, fold: int = 0, cut: float = 0.3, max_labels: int = 20_000) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if the score is at least `cut`)."""
    store = Store(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), body.alias("text"))
    chosen = (labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull())
              .where(~held_out(F.col(f"`{key}`"), folds, fold))
              .groupBy(F.col(f"`{key}`").alias("doc_id")).agg(F.max(f"`{label}`").cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    chosen = store.keep(chosen, "labels")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            ends = pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1))), batch.column(1)], ["x", "label"])

    # at most max_labels distinct ids are broadcast, and one vector for each comes back: of repeated ids the text of the least hash
    sample = (rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label")).select("text", "label"))
    sample = sample.mapInArrow(describe, "x array<float>, label int")
    got = sample.toArrow()
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES)
    good = got.column("label").to_numpy() > 0
    if good.any() and not good.all():
        order = np.lexsort(x.T)  # the same model whatever the order of the tasks
        x, good = x[order], good[order]
        mean, scale, weights = fit(x, good)
        strength = centred(x, mean, scale) @ weights
        threshold = float(np.quantile(strength, 1 - good.mean()))
    else:
        mean, scale, weights, threshold = np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0
    shift = np.log(cut / (1 - cut))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = centred(matrix(batch.column(2)), mean, scale) @ weights - threshold
            p = np.where(s == 0, cut, np.where(s > 0, np.maximum(cut, 1 / (1 + np.exp(-np.clip(s + shift, -700, 700)))),
                         np.minimum(np.nextafter(cut, 0), 1 / (1 + np.exp(-np.clip(s + shift, -700, 700))))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= cut).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text").mapInArrow(
        score, f"doc_id {kind}, held_out boolean, score double, predicted int")
