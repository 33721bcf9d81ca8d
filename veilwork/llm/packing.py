"""Best-fit packing of token sequences in bulk-synchronous rounds.

Lengths and gaps are whole numbers up to the capacity, so the range-sorted lists of pieces and of gaps are kept as runs of
equal size (at most `capacity` of them, at any corpus size).  A round sweeps both lists from large to small: a piece goes
to its successor, the smallest gap that holds it; pieces that want the same gap are told apart by their rank in the run;
the gaps shrink, and the next round begins.  When no gap holds any piece, the longest ones open new sequences.

The rows never meet: each piece learns its rank in its run from counts per partition, and finds its place in the table of
moves, whose size depends on the capacity alone.

Edge cases: a null text is an empty document (its end mark only); each row is a document, also with a repeated or null
doc_id; an empty table gives an empty result; texts of any length are encoded in slices at safe places.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.common import Store, small

#: Words whose ids a worker remembers at most, in two generations: the older one is forgotten when the newer is full.
CACHE_WORDS = 600_000
SLICE = 1 << 20
#: Fixed value: how byte-level BPE falls into pre-tokens, which are encoded independently.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_beside = re.compile(r" \s|\s | $|[\x1c-\x1f]")


def byte_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a byte-level BPE file as bytes to ids; in the file, bytes without a glyph stand 256 and more higher."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    glyphs = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    glyphs |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in glyphs)}
    return {bytes(glyphs[c] for c in t): i for t, i in vocabulary.items() if all(c in glyphs for c in t) and t != "<|endoftext|>"}


class Encoder:
    """Token ids of a byte-level BPE file of the tokenizers library, as little-endian 32-bit bytes.

    A single space before a visible character always starts a new pre-token, so a text falls into words (each with its
    leading space) that are encoded independently and remembered.  Unknown words are merged by tiktoken with the file's
    own vocabulary, which gives the same ids several times faster; texts with other runs of spaces, or with the string of an
    added token (which stands for its own id), go to the tokenizers library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.merge = tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=byte_ranks(path),
                                       special_tokens={}).encode_ordinary
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.new) > CACHE_WORDS // 2:
            self.new, self.old = {}, self.new
        new, old, merge = self.new, self.old, self.merge
        for w in words.difference(new):
            new[w] = old.get(w) or array("I", merge(w)).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    @staticmethod
    def slices(text: str) -> Iterator[str]:
        """Slices of about SLICE characters; each but the first starts with a space that starts a word."""
        at = 0
        while len(text) - at > SLICE:
            cut = text.find(" ", at + SLICE)
            while cut > 0 and (cut + 1 >= len(text) or text[cut + 1].isspace() or text[cut - 1].isspace()):
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        yield text[at:]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for k in range(0, len(texts), 64):
            cut = [[(s, self.apart(s)) for s in self.slices(t)] for t in texts[k:k + 64]]
            self.learn(set().union(*(ws for x in cut for _, ws in x if ws)))
            known = self.new.__getitem__
            for x in cut:
                yield b"".join(self.whole(s) if ws is None else b"".join(map(known, ws)) for s, ws in x)

    def apart(self, text: str) -> list[str] | None:
        """The text as words with their leading spaces; None if a space stands beside other white space, or for added tokens."""
        if _beside.search(text) or any(t in text for t in self.added):
            return None
        out = [" " + w for w in text.split(" ")]
        if text[:1] == " ":
            return out[1:]
        out[0] = out[0][1:]
        return out if text else []


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Moves (length, first rank, first sequence, offset), each good up to the next first rank, and the sequences used."""
    left, rank = dict(counts), defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    moves, used = [], 0

    def place(length: int, n: int, first: int, gap: int, into: dict) -> None:
        moves.append((length, rank[length], first, capacity - gap))
        rank[length] += n
        left[length] -= n
        if gap > length:
            into[gap - length].append((first, n))

    def open_for(length: int, n: int) -> None:
        nonlocal used
        place(length, n, used, capacity, gaps)
        used += n

    for length in sorted(left, reverse=True):
        if 2 * length > capacity and left[length]:  # no two of these share a sequence
            open_for(length, left[length])
    while any(left.values()):
        shrunk: dict[int, list[tuple[int, int]]] = defaultdict(list)
        stack: list[tuple[int, int, int]] = []
        before = len(moves)
        for size in sorted({*(x for x in gaps if gaps[x]), *(x for x in left if left[x])}, reverse=True):
            stack += [(size, f, n) for f, n in gaps.get(size, ())]
            while left.get(size) and stack:
                gap, first, n = stack.pop()
                k = min(n, left[size])
                place(size, k, first, gap, shrunk)
                if k < n:
                    stack.append((gap, first + k, n - k))
        gaps = shrunk
        for gap, first, n in stack:
            gaps[gap].append((first, n))
        if len(moves) == before:
            longest = max(x for x in left if left[x])
            open_for(longest, -(-left[longest] // (capacity // longest)))
    return moves, used


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    store = Store(docs.sparkSession)
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encoder = TaskContext.get().partitionId(), defaultdict(int), Encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            texts, rows = batch.column(1), []
            for i, ids in enumerate(encoder.encode(texts.to_pylist())):
                ids += end
                for p, (start, length) in enumerate(piece_bounds(len(ids) // 4, capacity)):
                    rows.append(i)
                    out.append((p, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            if out:
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, zip(*out), types)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    pieces = store.keep(source.mapInArrow(
        tokenize, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, part int, nth long"), "pieces")
    counts = store.keep(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    moves, _ = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity)
    table = np.array(sorted(moves) or [(0, 0, 0, 0)], np.int64)
    keys = (table[:, 0] << 44) + table[:, 1]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(table[row, 2] + rank - table[row, 1]), pa.array(table[row, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    first = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    offsets = store.keep(counts.select("part", "length", first.alias("before")), "offsets")
    ranked = pieces.join(small(offsets), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(locate, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, "
                                     "sequence_id long, offset long")
