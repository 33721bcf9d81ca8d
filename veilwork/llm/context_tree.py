"""Language-model scores by context-tree weighting.

A text is its bytes (A-Z lower-cased) and an end mark.  A byte is eight binary decisions; each of the 255 decisions has a tree of
contexts, the bytes before, from none up to `depth`.  A node mixes, half and half, the Krichevsky-Trofimov estimate of its own
counts with the product of its children, so a prediction is a mixture of the estimates of all depths on its path, weighted by
how well they explained the training texts:

    p(node) = w * kt(node) + (1 - w) * p(child on the path),    w = P_kt / (2 * P_node);    an unseen node predicts 1/2.

1. Every part of the corpus lists its distinct grams (context and byte) with their training counts; the lists meet by the
   last two context bytes, where the nodes below are built and summed up for their parents.
2. The nodes of depth 0 and 1 (65 280 at most) are weighted on the driver.
3. The same buckets answer each part's grams with their log-probability; parts meet their answers and sum them by document.

The grams of one part in one bucket travel as one row: sorted, as differences, byte by byte of equal rank, compressed.  A gram
then takes three to four bytes of disk instead of eleven.

Word counts for the unigram base travel the same way.  Nothing that grows with the corpus is broadcast or collected.

Edge cases: null text is empty (its end mark is still predicted); each row is a document, also with a repeated or null id, and a
null id is not held out; without training texts every decision has probability 1/2; an empty table gives an empty result.
Extra columns are not carried.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import Store
from veilwork.llm.hashing import LOWER, slices, text_buffer, word_hashes

END = 255  # never a byte of UTF-8: end mark, and the context before a text
END_WORD = np.uint64(0)
#: Text bytes of a part; at least PARTS of them.
PART_BYTES, PARTS = 16 << 20, 16
#: Rows of a bucket.
BUCKET_ROWS = 400_000
#: Bytes that are worked on at once.
STEP = 1 << 20


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series above 8, recurrence below."""
    low = x < 8
    y = np.where(low, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if low.any():
        z = x[low]
        out[low] -= np.log(np.prod([z + k for k in range(8)], axis=0))
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log-probability of any sequence with these counts under the Krichevsky-Trofimov estimator."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def decisions(symbol: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """(decision number 1 to 255, outcome) of one of the eight decisions of bytes."""
    return (1 << bit) | (symbol >> (8 - bit)), (symbol >> (7 - bit)) & 1


class Level:
    """Nodes of one depth: `node` (context * 256 + decision, sorted), counts, log P_node, own weight, estimate of a one."""

    def __init__(self, context: np.ndarray, symbol: np.ndarray, count: np.ndarray, below: Level | None, depth: int):
        node, outcome = zip(*(decisions(symbol, b) for b in range(8)))
        node = np.concatenate([context * 256 + n for n in node])
        outcome, weight = np.concatenate(outcome), np.tile(count.astype(float), 8)
        self.node, place = np.unique(node, return_inverse=True)
        self.ones = np.bincount(place, weight * outcome, len(self.node))
        self.zeros = np.bincount(place, weight, len(self.node)) - self.ones
        product = None
        if below is not None:
            parent = (below.node >> 16) * 256 + (below.node & 255) if depth else below.node & 255
            product = np.bincount(np.searchsorted(self.node, parent), below.log_p, len(self.node))
        self.weigh(product)

    def weigh(self, product: np.ndarray | None) -> None:
        own = log_kt(self.zeros, self.ones)
        self.log_p = own if product is None else np.logaddexp(own, product) - np.log(2)
        self.weight = np.exp(np.minimum(0.0, own - np.log(2) - self.log_p)) if product is not None else np.ones(len(own))
        self.one = (self.ones + 0.5) / (self.zeros + self.ones + 1)

    def mix(self, node: np.ndarray, outcome: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        if not len(self.node):
            return np.full(len(node), 0.5)
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        own = np.where(outcome == 1, self.one[at], 1 - self.one[at])
        return np.where(self.node[at] == node, self.weight[at] * own + (1 - self.weight[at]) * deeper, 0.5)


def context(gram: np.ndarray, length: int, depth: int) -> np.ndarray:
    """The `length` latest context bytes of grams (latest byte first, then the older ones, then the symbol)."""
    return gram >> (8 * (depth - length + 1))


def levels(gram: np.ndarray, count: np.ndarray, depth: int, least: int) -> dict[int, Level]:
    """Levels depth..least of the trees of these grams."""
    out: dict[int, Level] = {}
    for d in range(depth, least - 1, -1):
        pair = (context(gram, d, depth) << 8) | (gram & 255)
        pair, place = np.unique(pair, return_inverse=True)
        total = np.bincount(place, count, len(pair))
        out[d] = Level(pair >> 8, pair & 255, total, out.get(d + 1), d)
    return out


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, gram) of every byte and end mark of texts that lie one after the other."""
    low, n, texts = int(offsets[0]), int(offsets[-1] - offsets[0]), len(offsets) - 1
    lengths = np.diff(offsets)
    spread = np.full(n + depth * (texts + 1), END, np.uint8)
    text = np.repeat(np.arange(texts), lengths)
    spread[np.arange(n) + depth * (text + 1)] = LOWER[data[low:low + n]]
    owner = np.repeat(np.arange(texts), lengths + 1)
    at = np.arange(n + texts) + depth * (owner + 1) - owner
    for k in range(0, len(at), STEP):
        here = at[k:k + STEP]
        first = int(here[0]) - depth
        part = spread[first:int(here[-1]) + 1].astype(np.int64)
        m = len(part) - depth
        key = part[depth - 1:depth - 1 + m].copy()
        for back in range(2, depth + 1):
            key = (key << 8) | part[depth - back:depth - back + m]
        key = (key << 8) | part[depth:]
        yield owner[k:k + STEP], key[here - first - depth]


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the words of texts, and of an end for each."""
    text, word = word_hashes(data, offsets)
    m = len(offsets) - 1
    return np.concatenate((text, np.arange(m))), np.concatenate((word, np.full(m, END_WORD))).view(np.int64)


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each stands in training texts."""
    every = np.unique(keys)
    some, n = np.unique(keys[train], return_counts=True)
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, some)] = n
    return every, count


def counted_grams(gram: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of grams, which leave a bit for `train`, by one sort of numbers."""
    both = np.sort((gram << 1) | train)
    first = starts(both >> 1)
    return both[first] >> 1, np.add.reduceat(both & 1, first) if len(first) else both


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key; the lists are sorted, so the stable sort only merges them."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    first = starts(key[order])
    return key[order[first]], np.add.reduceat(n[order], first) if len(first) else n


def starts(key: np.ndarray) -> np.ndarray:
    """Where the groups of equal keys begin."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """`np.searchsorted` of many keys in any order; in sorted order a search stays near the one before."""
    order, out = np.argsort(wanted), np.empty(len(wanted), np.int64)
    out[order] = np.searchsorted(keys, wanted[order])
    return out


def packed(values: np.ndarray) -> bytes:
    """Numbers as bytes of equal rank, one rank after the other, compressed: sorted or small numbers take few bytes."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, size: int, dtype: type) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(raw, size * wide, "zstd", asbytes=True), np.uint8).reshape(wide, size)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(size)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys; differences wrap around."""
    return packed(np.diff(keys.view(np.uint64), prepend=np.uint64(0)))


def unpacked_keys(raw: bytes, size: int) -> np.ndarray:
    return np.cumsum(unpacked(raw, size, np.uint64), dtype=np.uint64).view(np.int64)


GRAMS = "kind int, b int, part int, size int, keys binary, counts binary"


def gather(depth: int, buckets: int):
    """Distinct grams (kind 0) and words (kind 1) of the parts that a task reads: columns part, train, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = defaultdict(list)
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            part, train = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(edges[:-1], edges[1:]):
                for i, j in slices(offsets[a:b + 1], STEP) if b > a else []:
                    here, learn = offsets[a + i:a + j + 1], train[a + i:a + j]
                    for text, key in grams(data, here, depth):
                        found[int(part[a]), 0].append(counted_grams(key, learn[text]))
                    text, word = tokens_of(data, here)
                    found[int(part[a]), 1].append(counted(word, learn[text]))
                for kind in (0, 1):  # keep the lists short
                    if len(found[int(part[a]), kind]) > 12:
                        found[int(part[a]), kind] = [merged(found[int(part[a]), kind])]
        while found:
            (p, kind), lists = found.popitem()
            if lists:
                key, n = merged(lists)
                deal = context(key, 2, depth) if kind == 0 else key
                b = ((deal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(b, kind="stable")  # keys of a bucket stay sorted
                key, n, b = key[order], n[order], b[order]
                first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
                ends = np.r_[first[1:], len(b)]
                for low in range(0, len(first), 1_000):
                    pieces = list(zip(first[low:low + 1_000].tolist(), ends[low:low + 1_000].tolist()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(pieces), pa.int32()), pa.array([int(b[i]) for i, _ in pieces], pa.int32()),
                         pa.array([p] * len(pieces), pa.int32()), pa.array([j - i for i, j in pieces], pa.int32()),
                         pa.array([packed_keys(key[i:j]) for i, j in pieces], pa.binary()),
                         pa.array([packed(n[i:j]) for i, j in pieces], pa.binary())], ["kind", "b", "part", "size", "keys", "counts"])
    return run


def opened(table: pa.Table, kind: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(part, keys, counts) of the rows of a kind."""
    columns = (table.column(c).to_pylist() for c in ("kind", "part", "size", "keys", "counts"))
    return [(p, unpacked_keys(k, size), unpacked(n, size, np.int64)) for which, p, size, k, n in zip(*columns) if which == kind]


def sums_for_parents(depth: int):
    """Per last context byte and decision: counts, and the sum of log P_node of its children (the nodes of depth 2)."""
    def bucket(table: pa.Table) -> pa.Table:
        seen = [(k[n > 0], n[n > 0]) for _, k, n in opened(table, 0)]
        if not sum(len(k) for k, _ in seen):
            return pa.table({"node": pa.array([], pa.int64()), **{c: pa.array([], pa.float64()) for c in ("zeros", "ones", "log_p")}})
        top = levels(*merged(seen), depth, 2)[2]
        parent, place = np.unique((top.node >> 16) * 256 + (top.node & 255), return_inverse=True)
        return pa.table({"node": parent, **{c: np.bincount(place, v, len(parent)) for c, v in (
            ("zeros", top.zeros), ("ones", top.ones), ("log_p", top.log_p))}})
    return bucket


class Top:
    """The nodes of depth 1 and 0, weighted with what the buckets summed up."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("node")
        self.one = self._level(*(rows.column(c).to_numpy() for c in ("node", "zeros", "ones", "log_p")))
        node, place = np.unique(self.one.node & 255, return_inverse=True)
        self.root = self._level(node, *(np.bincount(place, v, len(node)) for v in (self.one.zeros, self.one.ones, self.one.log_p)))

    @staticmethod
    def _level(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, product: np.ndarray) -> Level:
        level = Level.__new__(Level)
        level.node, level.zeros, level.ones = node, zeros, ones
        level.weigh(product)
        return level


def log10_p(key: np.ndarray, tree: dict[int, Level], top: Top, depth: int) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    out = np.zeros(len(key))
    for bit in range(8):
        number, outcome = decisions(key & 255, bit)
        p = np.full(len(key), 0.5)
        for d in range(depth, 1, -1):
            p = tree[d].mix(context(key, d, depth) * 256 + number, outcome, p)
        p = top.one.mix(context(key, 1, depth) * 256 + number, outcome, p)
        out += np.log10(top.root.mix(number, outcome, p))
    return out


ANSWER = "part int, kind int, size long, keys binary, reply binary"


def answers(depth: int, top: Top):
    """Per part: log10 of its grams' probabilities (kind 0), training counts of words that other parts have too (kind 1);
    per bucket the number of training tokens (kind 2) and of distinct ones (kind 3) as sizes."""
    def bucket(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for which in (0, 1):
            rows = opened(table, which)
            if not rows:
                continue
            every, count = merged([(k, n) for _, k, n in rows])
            if which == 0:
                seen = count > 0
                value = log10_p(every, levels(every[seen], count[seen], depth, 2), top, depth).astype(np.float32)
                out += [(p, 0, len(k), packed_keys(k), packed(value[np.searchsorted(every, k)])) for p, k, _ in rows]
            else:
                for p, k, local in rows:
                    n = count[np.searchsorted(every, k)]
                    elsewhere = n != local
                    out.append((p, 1, int(elsewhere.sum()), packed_keys(k[elsewhere]), packed(n[elsewhere])))
                out += [(-1, 2, int(count.sum()), b"", b""), (-1, 3, int((count > 0).sum()), b"", b"")]
        return pa.table({c: pa.array([r[j] for r in out], t) for j, (c, t) in enumerate(
            (("part", pa.int32()), ("kind", pa.int32()), ("size", pa.int64()), ("keys", pa.binary()), ("reply", pa.binary())))})
    return bucket


def replies_of(known: pa.Table, kind: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and what was answered to them."""
    rows = [r for r in zip(*(known.column(c).to_pylist() for c in ("kind", "size", "keys", "reply"))) if r[0] == kind and r[1]]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, dtype)
    key = np.concatenate([unpacked_keys(k, size) for _, size, k, _ in rows])
    order = np.argsort(key, kind="stable")
    return key[order], np.concatenate([unpacked(r, size, dtype) for _, size, _, r in rows])[order]


def _words(docs: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in docs.to_batches():
        data, offsets = text_buffer(batch.column("text"))
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for i, j in slices(offsets, STEP):
            text, word = tokens_of(data, offsets[i:j + 1])
            yield text, word, train[i:j]


def add_up(depth: int, tokens: float, distinct: float):
    """Sums by document of a part: columns doc_id, held_out, text, and the part's answers."""
    def part(docs: pa.Table, known: pa.Table) -> pa.Table:
        gram_key, gram_p = replies_of(known, 0, np.float32)
        other_key, other_n = replies_of(known, 1, np.int64)
        own: list[tuple[np.ndarray, np.ndarray]] = []  # the part's own training counts of words
        for text, word, learn in _words(docs):
            own.append(counted(word, learn[text]))
            own = [merged(own)] if len(own) > 12 else own
        word_key, word_n = merged(own) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        word_n[np.searchsorted(word_key, other_key)] = other_n
        rows = []
        for batch in docs.to_batches():
            data, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets, STEP):
                here, m = offsets[i:j + 1], j - i
                score = np.zeros(m)
                for text, gram in grams(data, here, depth):
                    score += np.bincount(text, gram_p[places(gram_key, gram)], m)
                text, word = tokens_of(data, here)
                c = word_n[places(word_key, word)]
                rows.append((np.bincount(text, minlength=m), np.bincount(text, c > 0, m).astype(np.int64), np.full(m, int(tokens)),
                             np.bincount(text, np.log10((c + 1) / (tokens + distinct + 1)), m), score,
                             -score * np.log2(10) / np.maximum(1, np.diff(here))))
        columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0)] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(),
                         *(pa.array(c, t) for c, t in zip(columns, kinds))],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
    return part


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, depth: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte; `depth` is 2 to 6."""
    spark = docs.sparkSession
    store = Store(spark)
    kind = docs.schema[key].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds == fold, F.lit(False))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    parts = max(PARTS, -(-size // PART_BYTES))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), held.alias("held_out"), body.alias("text"))
    have = rows.rdd.getNumPartitions()
    if have >= parts:
        part = F.pmod(F.spark_partition_id(), F.lit(parts))
    else:  # each partition makes several parts
        cuts = -(-parts // have)
        part = F.spark_partition_id() * cuts + F.pmod(F.xxhash64("doc_id", "text"), F.lit(cuts))
    rows = store.keep(rows.withColumn("part", part.cast("int")).sortWithinPartitions("part"), "texts")
    buckets = max(PARTS, -(-size // (BUCKET_ROWS * 12)))
    found = store.keep(rows.select("part", (~F.col("held_out")).alias("train"), "text").mapInArrow(
        gather(depth, buckets), GRAMS), "grams")
    top = Top(found.where("kind = 0").groupBy("b")
              .applyInArrow(sums_for_parents(depth), "node long, zeros double, ones double, log_p double")
              .groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_p").alias("log_p"))
              .toArrow())  # 65 280 rows at most
    store.clean()
    replies = store.keep(found.groupBy("b").applyInArrow(answers(depth, top), ANSWER), "answers")
    store.drop(found)
    store.clean()
    totals = {r[0]: float(r[1]) for r in replies.where("part = -1").groupBy("kind").agg(F.sum("size")).collect()}
    return rows.groupBy("part").cogroup(replies.where("part >= 0").groupBy("part")).applyInArrow(
        add_up(depth, totals.get(2, 0.0), totals.get(3, 0.0)),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "bits_per_byte double")
