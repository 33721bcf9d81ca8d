"""Removal of repeated passages: bytes inside a string of `width` bytes that also starts earlier in the corpus.

Windows of `width` bytes are dealt out by their minimizer, the least hashed gram inside them, so equal windows always meet.
Consecutive windows with the same minimizer form a run, and runs with the same digest are wholly equal:

1. a task scans its texts, keeps the first of equal runs, and reports the later ones as covered;
2. runs meet by minimizer; of equal ones the first stays, the later ones are covered;
3. where different runs share a minimizer, their spans are fetched and trimmed to the parts whose window hashes repeat;
   equal parts are settled like runs, and of parts that overlap otherwise the Burrows-Wheeler transforms are built shard
   by shard and merged by interleave refinement: intervals with a common prefix of `width` bytes cover all but their
   first window;
4. covered bytes are joined back to the texts by document.

Only step 3 needs suffixes, and only for text near passages that repeat in part.  A minimizer with very many different
runs (a passage that many documents share) is found in a first scan; its windows are dealt out one by one under their
own hash, so no task gathers such a group.

Order: smaller doc_id first (null last), then the hash of the text, then the place.  Rows with the same doc_id and text
are one document and get the same result.  Null text is empty; an empty table gives an empty result; texts of any length
are scanned in overlapping slices.  Extra columns are carried only if named.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.bwt import merged_intervals
from veilwork.llm.common import Store

GRAM = 32
#: Text bytes that are scanned at once; the scan takes about 100 bytes of memory for each.
SLICE = 1 << 20
#: A minimizer is a hot one when a task's batch has so many different runs of it.
HOT_RUNS = 32
#: Hot minimizers that tasks are told of at most (8 bytes each), the most frequent ones; others stay in their buckets.
BOUND = 500_000
#: Bytes of spans whose transforms are merged at once, and of a shard.
MERGE_BYTES, SHARD_BYTES = 1 << 21, 1 << 18
#: Text bytes for each bucket of minimizers.
BUCKET_BYTES = 24 << 20
LAST = np.int64(2**63 - 1)
_rng = np.random.default_rng(20240229)
_SYMBOL = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**62)) * 2 + 1
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def runs(data: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(document, place in `data`, windows, minimizer, digest) of each run; texts are data[start:start + length]."""
    gram = min(GRAM, width)
    enough = length >= width
    doc, start, length = doc[enough], start[enough], length[enough]
    if not len(doc):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    low, n = int(start[0]), int(start[-1] + length[-1])
    data, start, n = data[low:n], start - low, n - low
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * power[:n], out=sums[1:])
    mixed = _mix((sums[gram:] - sums[:n - gram + 1]) * inverse[:n - gram + 1])
    least = (mixed & ~np.uint64(0xFFFFFF)) | np.arange(len(mixed), dtype=np.uint64)
    grams, have = width - gram + 1, 1
    while 2 * have <= grams:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < grams:
        least = np.minimum(least[:have - grams], least[grams - have:])
    ok = np.zeros(len(least) + 1, np.int8)
    np.add.at(ok, start, 1)
    np.add.at(ok, start + length - width + 1, -1)
    ok = np.cumsum(ok[:-1]).astype(bool)
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    last = ok.copy()
    last[:-1] &= ~ok[1:] | (least[1:] != least[:-1])
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    anchor = (least[s] & np.uint64(0xFFFFFF)).astype(np.int64)
    digest = (sums[e + width] - sums[s]) * inverse[s]
    digest = _mix(digest + _mix((e - s).astype(np.uint64) * np.uint64(2048) + (anchor - s).astype(np.uint64)))
    return doc[np.searchsorted(start, s, "right") - 1], s + low, e - s + 1, mixed[anchor], digest


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of a short text, unrelated to minimizers."""
    n = len(data)
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * power[:n], out=sums[1:])
    return _mix(((sums[width:] - sums[:n - width + 1]) * inverse[:n - width + 1]) ^ np.uint64(0x5DEECE66D))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column, and the offsets of its rows."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, starts, lengths) that fill about SLICE bytes; a longer text comes in slices that overlap."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        if j == i + 1 and offsets[j] - offsets[i] > SLICE:
            step = SLICE - width + 1
            for at in range(int(offsets[i]), int(offsets[j]) - width + 1, step):
                yield np.array([i]), np.array([at]), np.array([min(SLICE, int(offsets[j]) - at)])
        else:
            yield np.arange(i, j), offsets[i:j].astype(np.int64), np.diff(offsets[i:j + 1]).astype(np.int64)
        i = j


def batch_runs(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """m, d, doc, q, n of the runs of a batch (columns doc, th, text); q is the text's hash and the place."""
    data, offsets = text_buffer(batch.column(2))
    ids = batch.column(0).fill_null(int(LAST)).to_numpy()
    hashes = batch.column(1).to_numpy()
    found = [runs(data, *s, width) for s in slices(offsets, width)] or [runs(data, *(np.zeros(0, np.int64),) * 3, width)]
    doc, at, n, m, d = (np.concatenate(x) for x in zip(*found))
    return m, d, ids[doc], (hashes[doc] << 32) | (at - offsets[doc]), n


def later(m: np.ndarray, d: np.ndarray, doc: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by (m, d, doc, q), whether each is the first of its (m, d), and whether it is another, later place."""
    order = np.lexsort((q, doc, d, m))
    m, d, doc, q = m[order], d[order], doc[order], q[order]
    first = np.ones(len(m), bool)
    first[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
    head = np.maximum.accumulate(np.where(first, np.arange(len(m)), 0))
    return order, first, (doc != doc[head]) | (q != q[head])


def spans(doc: np.ndarray, q: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of [q, end) by document; q and end carry the text's hash in their upper half."""
    order = np.lexsort((end, q, doc))
    doc, q, end = doc[order], q[order], end[order]
    if not len(doc):
        return doc, q, end
    group = np.cumsum(np.concatenate(([True], (doc[1:] != doc[:-1]) | (q[1:] >> 32 != q[:-1] >> 32))))
    reach, place = end.copy(), end & 0xFFFFFFFF
    reach = np.maximum.accumulate(group * (np.int64(1) << 33) + place) & 0xFFFFFFFF
    new = np.ones(len(doc), bool)
    new[1:] = (group[1:] != group[:-1]) | ((q[1:] & 0xFFFFFFFF) > reach[:-1])
    at = np.flatnonzero(new)
    stop = np.concatenate((at[1:], [len(doc)])) - 1
    return doc[at], q[at], (end[stop] >> 32 << 32) | reach[stop]


RUN = "b int, m long, d long, doc long, q long, n long"
NAMES = ["b", "m", "d", "doc", "q", "n"]


def _rows(b, m, d, doc, q, n) -> pa.RecordBatch:
    signed = [np.asarray(x).astype(np.uint64).view(np.int64) if np.asarray(x).dtype == np.uint64 else np.asarray(x, np.int64)
              for x in (m, d, doc, q, n)]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(b, np.int32)), *map(pa.array, signed)], NAMES)


def _covered(doc, q, n, width) -> pa.RecordBatch | None:
    """Covered bytes as rows with a negative n."""
    doc, q, end = spans(doc, q, q + n - 1 + width)
    zero = np.zeros(len(doc), np.int64)
    return _rows(zero, zero, zero, doc, q, q - end) if len(doc) else None


def count_hot(width: int) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, d, *_ = batch_runs(batch, width)
            order = np.lexsort((d, m))
            m, d = m[order], d[order]
            new = np.ones(len(m), bool)
            new[1:] = (m[1:] != m[:-1]) | (d[1:] != d[:-1])
            values, counts = np.unique(m[new], return_counts=True)
            heavy = counts > HOT_RUNS
            yield pa.RecordBatch.from_arrays([pa.array(values[heavy].view(np.int64)), pa.array(counts[heavy])], ["m", "n"])
    return scan


def scan_runs(width: int, buckets: int, hot: np.ndarray) -> Callable:
    """Step 1.  Runs of hot minimizers fall into their windows."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, d, doc, q, n = batch_runs(batch, width)
            is_hot = np.isin(m, hot)
            if is_hot.any():
                data, offsets = text_buffer(batch.column(2))
                row = {k: i for i, k in reversed([*enumerate(zip(
                    batch.column(0).fill_null(int(LAST)).to_pylist(), batch.column(1).to_pylist()))])}
                parts = []
                for a, b, c in zip(doc[is_hot].tolist(), q[is_hot].tolist(), n[is_hot].tolist()):
                    at = int(offsets[row[a, b >> 32]]) + (b & 0xFFFFFFFF)
                    parts.append(window_hashes(data[at:at + c - 1 + width], width))
                cut = np.concatenate(parts)
                k = n[is_hot]
                inner = np.arange(len(cut)) - np.repeat(np.cumsum(k) - k, k)
                m = np.concatenate((m[~is_hot], cut))
                d = np.concatenate((d[~is_hot], np.zeros(len(cut), np.uint64)))
                doc = np.concatenate((doc[~is_hot], np.repeat(doc[is_hot], k)))
                q = np.concatenate((q[~is_hot], np.repeat(q[is_hot], k) + inner))
                n = np.concatenate((n[~is_hot], np.ones(len(cut), np.int64)))
            order, first, again = later(m, d, doc, q)
            m, d, doc, q, n = (x[order] for x in (m, d, doc, q, n))
            yield _rows((m[first] % np.uint64(buckets)).astype(np.int32), m[first], d[first], doc[first], q[first], n[first])
            part = _covered(doc[again], q[again], n[again], width)
            if part is not None:
                spread = pa.array((np.arange(part.num_rows) % buckets).astype(np.int32))
                yield pa.RecordBatch.from_arrays([spread, *part.columns[1:]], NAMES)
    return scan


def meet(width: int) -> Callable:
    """Step 2: covered bytes (n < 0), and the first runs of minimizers with several different runs."""
    def bucket(table: pa.Table) -> pa.Table:
        b, m, d, doc, q, n = (table.column(c).to_numpy() for c in NAMES)
        known = n < 0
        done = [(doc[known], q[known], q[known] - n[known])]
        m, d, doc, q, n = (x[~known] for x in (m, d, doc, q, n))
        order, first, again = later(m, d, doc, q)
        m, d, doc, q, n = (x[order] for x in (m, d, doc, q, n))
        done.append((doc[again], q[again], q[again] + n[again] - 1 + width))
        m, d, doc, q, n = (x[first] for x in (m, d, doc, q, n))
        same = np.zeros(len(m), bool)
        same[1:] = m[1:] == m[:-1]
        same[:-1] |= same[1:]
        cd, cq, ce = spans(*map(np.concatenate, zip(*done)))
        k, zero = int(same.sum()), np.zeros(len(cd), np.int64)
        return pa.Table.from_batches([_rows(zero, zero, zero, cd, cq, cq - ce),
                                      _rows(np.full(k, b[0] if len(b) else 0), m[same], d[same], doc[same], q[same], n[same])])
    return bucket


def shared_parts(text: Sequence[bytes], width: int) -> tuple[np.ndarray, ...]:
    """The parts of the spans whose windows have a hash that occurs twice: (span, offset, windows, digest) of each.

    Only these can hold repeats, and parts with equal digests are equal as a whole.
    """
    data = np.frombuffer(b"".join(text), np.uint8)
    lengths = np.array([len(t) for t in text])
    starts = np.cumsum(lengths) - lengths
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SYMBOL[data] * power[:len(data)], out=sums[1:])
    k = lengths - width + 1
    at = np.repeat(starts - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
    span = np.repeat(np.arange(len(text)), k)
    window = _mix((sums[at + width] - sums[at]) * inverse[at])
    order = np.argsort(window, kind="stable")
    twin = window[order[1:]] == window[order[:-1]]
    shared = np.zeros(len(at) + 1, bool)
    shared[order[1:][twin]] = shared[order[:-1][twin]] = True
    first, last = shared[:-1].copy(), shared[:-1].copy()
    first[1:] &= ~shared[:-2] | (span[1:] != span[:-1])
    last[:-1] &= ~shared[1:-1] | (span[1:] != span[:-1])
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    digest = _mix((sums[at[e] + width] - sums[at[s]]) * inverse[at[s]] + (e - s).astype(np.uint64))
    return span[s], at[s] - starts[span[s]], e - s + 1, digest


def merge_shards(width: int) -> Callable:
    """Step 3: covered bytes of the spans of a bucket (columns m, doc, q, span)."""
    def bucket(table: pa.Table) -> pa.Table:
        m, doc, q = (table.column(c).to_numpy() for c in ("m", "doc", "q"))
        order = np.argsort(m, kind="stable")
        m, doc, q = m[order], doc[order], q[order]
        text = table.column("span").take(pa.array(order)).to_pylist()
        out = [(doc[:0], q[:0], q[:0])]
        for lo, hi in groups(m, [len(t) for t in text], SLICE):
            span, offset, n, digest = shared_parts(text[lo:hi], width)
            span += lo
            pm, pd, pq = m[span], doc[span], q[span] + offset
            sort, first, again = later(pm, digest, pd, pq)
            span, offset, n, pm, pd, pq = (x[sort] for x in (span, offset, n, pm, pd, pq))
            out.append((pd[again], pq[again], pq[again] + n[again] - 1 + width))
            span, offset, n, pm, pd, pq = (x[first] for x in (span, offset, n, pm, pd, pq))
            several = np.zeros(len(pm), bool)
            several[1:] = pm[1:] == pm[:-1]
            several[:-1] |= several[1:]
            span, offset, n, pm, pd, pq = (x[several] for x in (span, offset, n, pm, pd, pq))
            part = [text[i][a:a + c - 1 + width] for i, a, c in zip(span.tolist(), offset.tolist(), n.tolist())]
            for a, b in groups(pm, [len(t) + 1 for t in part], MERGE_BYTES):
                out.append(repeated(pd[a:b], pq[a:b], part[a:b], width))
        cd, cq, ce = spans(*map(np.concatenate, zip(*out)))
        zero = np.zeros(len(cd), np.int64)
        return pa.Table.from_batches([_rows(zero, zero, zero, cd, cq, cq - ce)])
    return bucket


def groups(m: np.ndarray, lengths: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows (sorted by m) that hold whole minimizers and, if it takes more than one, at most `most` bytes."""
    if not len(m):
        return
    size = np.concatenate(([0], np.cumsum(lengths)))
    edges = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1], [True])))
    i = 0
    while i < len(edges) - 1:
        j = i + 1
        while j < len(edges) - 1 and size[edges[j + 1]] - size[edges[i]] <= most:
            j += 1
        yield int(edges[i]), int(edges[j])
        i = j


def repeated(doc: np.ndarray, q: np.ndarray, text: Sequence[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(document, start, end) of windows that also start earlier, from the merged transforms of the texts' shards."""
    shards, part, size = [], [], 0
    for t in text:
        part.append(np.append(np.frombuffer(t, np.uint8) + np.uint8(1), np.uint8(0)))  # UTF-8 has no byte 255
        size += len(t) + 1
        if size >= SHARD_BYTES:
            shards.append(np.concatenate(part))
            part, size = [], 0
    if part:
        shards.append(np.concatenate(part))
    place, block = merged_intervals(shards, width)
    lengths = np.array([len(t) + 1 for t in text])
    starts = np.cumsum(lengths) - lengths
    alone = np.ones(len(block) + 1, bool)
    alone[1:-1] = block[1:] != block[:-1]
    shared = ~(alone[:-1] & alone[1:])
    place, block = place[shared], block[shared]
    string = np.searchsorted(starts, place, "right") - 1
    doc, q = doc[string], q[string] + place - starts[string]
    order = np.lexsort((q, doc, block))
    doc, q, block = doc[order], q[order], block[order]
    first = np.ones(len(doc), bool)
    first[1:] = block[1:] != block[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0)) if len(doc) else first.astype(int)
    again = (doc != doc[head]) | (q != q[head])
    return doc[again], q[again], q[again] + width


def text_hash(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF))


def by_document(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per document with its list of rows; q splits into the text's hash and the place."""
    place = F.col("q").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at")
    return rows.groupBy("doc", F.shiftright("q", 32).alias("th")).agg(
        F.collect_list(F.struct(place, *columns)).alias("list"))


def covered_bytes(docs: DataFrame, store: Store, width: int) -> DataFrame:
    """doc, q, n (negative): the bytes to remove; `docs` has doc (never null), th, text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    heavy = store.keep(docs.mapInArrow(count_hot(width), "m long, n long").groupBy("m").agg(F.sum("n").alias("n")), "hot")
    hot = np.array([r[0] for r in heavy.orderBy(F.desc("n"), "m").limit(BOUND).collect()], np.int64).view(np.uint64)
    met = store.keep(docs.mapInArrow(scan_runs(width, buckets, hot), RUN)
                     .groupBy("b").applyInArrow(meet(width), RUN), "met")
    partly = met.where("n > 0")
    if partly.isEmpty():
        return met
    wanted = by_document(partly, "n", "m", "b")
    fetched = docs.join(wanted, ["doc", "th"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            rows = [(w["b"], w["m"], d, h << 32 | w["at"], data[o + w["at"]:o + w["at"] + w["n"] - 1 + width].tobytes())
                    for d, h, o, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets.tolist(),
                                           batch.column(3).to_pylist()) for w in ws]
            for k in range(0, len(rows), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[k:k + 100_000]),
                                                    (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["b", "m", "doc", "q", "span"])

    pieces = fetched.select("doc", "th", "text", "list").mapInArrow(fetch, "b int, m long, doc long, q long, span binary")
    merged = store.keep(pieces.groupBy("b").applyInArrow(merge_shards(width), RUN), "merged")
    return met.where("n < 0").unionByName(merged)


def remove_repeats(docs: DataFrame, carry: Sequence[str] = ("doc_id",), key: str = "doc_id", text: str = "text",
                   width: int = 100) -> DataFrame:
    """Struct `carried`, n_bytes, n_removed, n_spans, kept_sha256, kept_text (without characters that lost a byte)."""
    store = Store(docs.sparkSession)
    kept = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(int(LAST))).alias("doc"), text_hash(kept).alias("th"),
                       kept.alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"))
    cover = covered_bytes(rows.select("doc", "th", "text"), store, width)
    full = rows.join(by_document(cover, F.expr("-n AS n")), ["doc", "th"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            out = []
            for a, b, gone in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2).to_pylist()):
                raw, left, at, spans_, end = data[a:b].tobytes(), [], 0, 0, -1
                for s, n in sorted((x["at"], x["n"]) for x in gone or ()):
                    if s > end:
                        spans_ += 1
                        left.append(raw[at:s])
                    end = at = max(end, s + n)
                left = b"".join([*left, raw[at:]])
                out.append((b - a, b - a - len(left), spans_, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(
                    zip(*out) if out else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))],
                ["carried", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    kind = rows.schema["carried"].dataType.simpleString()
    return full.select("carried", "text", "list").mapInArrow(
        cut, f"carried {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
