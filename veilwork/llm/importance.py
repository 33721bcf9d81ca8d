"""Target-distribution importance resampling: hashed n-gram weights, then a distributed quickselect.

1. Every task counts the hashed features of its texts in one array of `buckets` numbers; arrays add up, for the rows and for the
   target.  A bucket's gain is the log ratio of both shares (with one added to each bucket).
2. Every row is scored by that array: the mean gain of its features, plus a Gumbel draw from its id, so that the highest scores are a
   sample without replacement in proportion to the weights.
3. The k-th highest key (score, id, row) is found without sorting: random pivot keys from the rows still in question, exact counts of
   the rows between and at the pivots, and on with the interval that holds the k-th, which shrinks some 30 times a round.
4. Only the rows up to that key are sorted, by ranges, and numbered by the counts of the ranges before.

The driver holds the two arrays (`buckets` numbers), a round's pivots and a count per sorted range; no group of rows meets in a task
unless its keys follow one another, and keys are unique.

Edge cases: a null text has no words; a null id draws as the text 'null' and comes after all ids in ties; each row is a document, and
of rows alike in score and id the order is that of the rows; a target without words gives the rows' own distribution a weight near
zero everywhere, an empty table an empty result.  Input columns aren't carried, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.common import Store, partitions

BUCKETS, PIVOTS, PIECE, SHIFTED = 10_000, 31, 1 << 20, 256
#: A-Z to a-z; every ASCII character that is no letter or digit to a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _shift_tables() -> np.ndarray:
    """For n < SHIFTED and each byte of a checksum: what it becomes by n more zero bytes.  crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""
    step = np.zeros(256, np.uint32)
    for value in range(256):
        c = value
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        step[value] = c
    out = np.zeros((SHIFTED, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, SHIFTED):
        out[n] = (out[n - 1] >> 8) ^ step[out[n - 1] & 255]
    return out


_SHIFT = _shift_tables().reshape(-1)


def pairs_checksums(words: list[bytes], alone: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of 'a b' for words a, b that follow each other, from their own checksums and sizes."""
    first, size = _shifted(alone[:-1], np.int64(1)) ^ np.uint32(zlib.crc32(b" ")), sizes[1:]
    out = _shifted(first, np.minimum(size, SHIFTED - 1)) ^ alone[1:]
    for i in np.flatnonzero(size >= SHIFTED).tolist():
        out[i] = zlib.crc32(words[i] + b" " + words[i + 1])
    return out


def _shifted(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sums), np.uint32)
    for k in range(4):
        out ^= _SHIFT[size * 1024 + k * 256 + ((sums >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64)]
    return out


def feature_buckets(raw: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their features) of a text, piece by piece; features are words and pairs of words that follow each other."""
    raw, at, last = raw.translate(_PLAIN), 0, []
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        words = last + raw[at:end].split()
        at, new = end, len(words) - len(last)
        if not new:
            continue
        alone = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        yield new, np.concatenate((alone[len(last):], pairs_checksums(words, alone, sizes))) % np.uint32(buckets)
        last = words[-1:]


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (v.as_py() for v in column)


def bucket_counts(rows: DataFrame, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in _texts(batch.column(0)):
                for _, b in feature_buckets(raw, buckets):
                    total += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    sums = _bodies(rows, text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in sums.collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def _bodies(rows: DataFrame, text: str, *others: Column) -> DataFrame:
    return rows.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"), *others)


def gains(rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target and rows for each bucket, rounded down."""
    up = (target + 1).astype(float) * float(rows.sum() + len(rows))
    down = (rows + 1).astype(float) * float(target.sum() + len(rows))
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def scored(rows: DataFrame, gain: np.ndarray, key: str, text: str, seed: int) -> DataFrame:
    """doc_id, n_features, n_words, weight, score; row numbers the rows."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in _texts(batch.column(0)):
                n_words = n = total = 0
                for w, b in feature_buckets(raw, len(gain)):
                    n_words, n, total = n_words + w, n + len(b), total + int(gain[b].sum())
                out.append((n, n_words, total // n if n else 0))
            numbers = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column(1), *numbers], ["doc_id", "n_features", "n_words", "weight"])

    df = _bodies(rows, text, F.col(f"`{key}`").alias("doc_id"))
    kind = df.schema["doc_id"].dataType.simpleString()
    df = df.mapInArrow(weigh, f"doc_id {kind}, n_features long, n_words long, weight long")
    label = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(label.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return df.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())


# ---- selection
_KEY = ("score", "no_id", "doc_id", "row")


def _key() -> Column:
    """Ascending: highest score, then smallest id (null last), then first row."""
    return F.struct((-F.col("score")).alias("score"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")


def kth_key(keys: DataFrame, k: int, n: int, pivots: int = PIVOTS) -> tuple:
    """The k-th least value (from 1) of the struct column `key`, unique in its n rows."""
    kind = keys.schema["key"].dataType
    literal = lambda v: F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(v, kind.fields)])
    low = high = None
    for turn in range(10 * n.bit_length() + 10):
        active = keys
        if low is not None:
            active = active.where(F.col("key") > literal(low))
        if high is not None:
            active = active.where(F.col("key") < literal(high))
        drawn = active.orderBy(F.xxhash64(F.col("key.row"), F.lit(turn))).limit(pivots).collect()
        at = sorted((tuple(r["key"]) for r in drawn), key=lambda v: tuple((x is not None, x) if i == 2 else x for i, x in enumerate(v)))
        below = F.size(F.filter(F.array(*map(literal, at)), lambda p: p < F.col("key")))
        equal = F.exists(F.array(*map(literal, at)), lambda p: p == F.col("key"))
        counts = {(r[0], r[1]): r[2] for r in active.groupBy(below.alias("b"), equal.alias("e")).count().collect()}
        for i in range(len(at) + 1):  # the interval before pivot i, then pivot i itself
            inside = counts.get((i, False), 0)
            if k <= inside:
                low, high = (at[i - 1] if i else low), (at[i] if i < len(at) else high)
                break
            k -= inside
            if k == 1 and i < len(at):
                return at[i]
            k -= 1
    raise RuntimeError("the keys changed between two rounds")


def numbered(rows: DataFrame, store: Store, order: list[Column]) -> DataFrame:
    """Adds rank 1, 2, ... in the given order (unique): ranges are sorted by themselves, and start after the counts of those before."""
    n = max(1, partitions(rows.sparkSession))
    parts = store.keep(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    before, starts = 0, []
    for part, count in sorted(tuple(r) for r in parts.groupBy("part").count().collect()):  # a row per range
        starts.append((part, before))
        before += count
    start = rows.sparkSession.createDataFrame(starts, "part int, before long")
    place = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return parts.withColumn("place", place).join(F.broadcast(start), "part").withColumn(
        "rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def resample(rows: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, key: str = "doc_id",
             text: str = "text", target_text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank (null: not drawn) of every row; `percent` of the rows with at least
    `least_words` words are drawn."""
    store = Store(rows.sparkSession)
    gain = gains(bucket_counts(rows, text, buckets), bucket_counts(target, target_text, buckets))
    every = store.keep(scored(rows, gain, key, text, seed), "scores")
    fit = every.where(F.col("n_words") >= least_words)
    n = fit.count()
    k = percent * n // 100
    if not k:
        return every.drop("row").withColumn("rank", F.lit(None).cast("long"))
    last = kth_key(fit.select(_key().alias("key")), k, n)
    kind = fit.select(_key().alias("key")).schema["key"].dataType
    bound = F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(last, kind.fields)])
    drawn = (F.col("n_words") >= least_words) & (_key() <= bound)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    winners = numbered(every.where(drawn), store, order)
    others = every.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return winners.unionByName(others).drop("row")
