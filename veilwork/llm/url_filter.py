"""URL filter by a sorted digest array.

Blocked strings are hosts ("example.org") or hosts with a path prefix ("example.org/es/").  Their 64-bit xxhash keys lie
sorted in a file with the full strings behind them; a task maps the file into memory, probes all keys of a batch by binary
search at once, and confirms each hit on the stored string, so a collision of keys can't block anything.  A URL is probed
under its host and every parent domain, alone and with each prefix of its path that ends in a slash, and the whole path, as far
as these are no longer than the longest entry.  Hosts are compared without case, paths with it.

`read_blocklist` reads the usual formats of such lists: plain hosts and URLs, hosts files, and host rules of ad blockers;
`known_blocklist` is the small list that is shipped, with more files added to it.

Files of up to SHARD_BYTES strings go to every task as one broadcast; a longer list is dealt out by key into shards, and the
distinct probes travel to the shard of their key.

Edge cases: null URL or none with "://": host and path are empty and nothing is blocked; each row is judged, also with a
repeated or null id; an empty list blocks nothing; an empty table gives an empty result.  Extra columns are not carried.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.common import Store, small

SHARD_BYTES = 16 << 20


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def probes_of(host: str, path: str, longest: int) -> list[str]:
    """What a URL is looked up under; nothing longer than the longest entry of the list."""
    if not host:
        return []
    start = max(0, len(host) - longest)  # shorter ends of the host can be entries
    hosts = [host[k:] for k in range(start, len(host)) if k == 0 or host[k - 1] == "."]
    cuts = [k + 1 for k, c in enumerate(path[:longest]) if c == "/"]
    if path and not path.endswith("/"):
        cuts.append(len(path))
    return [p for h in hosts for p in (h, *(h + path[:k] for k in cuts if len(h) + k <= longest)) if len(p) <= longest]


def entry_of(entry: Column) -> Column:
    """An entry of the list as URLs are looked up: the host in lower case, the path as it is."""
    host = F.regexp_extract(entry, "^[^/]*", 0)
    return F.concat(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(entry, "(?s)^[^/]*(.*)$", 1))


def read_blocklist(lines: DataFrame, column: str = "value") -> DataFrame:
    """Column `entry` of distinct entries from the lines of list files (as spark.read.text gives them).

    Read are `host`, `host/path`, `scheme://host/path`, `0.0.0.0 host` or `127.0.0.1 host`, and `||host^`.  Comments (# and ! at the
    start, # after a blank), empty and null lines, ports, queries and rules that aren't of these forms (exceptions, wildcards,
    options) give nothing or are left off.
    """
    line = F.trim(F.regexp_replace(F.col(f"`{column}`"), r"(^|[ \t])[#!].*$|[\r\t]", " "))
    line = F.regexp_replace(line, r"^(0\.0\.0\.0|127\.0\.0\.1|::1?) +", "")
    line = F.regexp_replace(F.regexp_replace(line, r"^\|\|(.*)\^$", "$1"), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    line = F.regexp_replace(F.regexp_replace(line, r"[?#].*$", ""), r"^([^/:]*):[0-9]*", "$1")
    return lines.select(entry_of(line).alias("entry")).where(r"entry rlike '^[^ /*|@^$]+(/[^ *|^$]*)?$'").distinct()


def known_blocklist(spark: SparkSession, files: Sequence[str] = (), folder: str | Path = Path(__file__).parent / "url_lists") -> DataFrame:
    """The shipped list (short, read here) and the lists in `files` (any size and number, read by Spark from shared storage)."""
    shipped = [(line,) for file in sorted(Path(folder).glob("*.txt")) for line in file.read_text().splitlines()]
    lines = spark.createDataFrame(shipped, "value string")
    return read_blocklist(lines.unionByName(spark.read.text(list(files))) if files else lines)


class DigestArray:
    """Sorted keys, offsets and strings in one file that is mapped into memory."""

    def __init__(self, strings: Sequence[bytes]):
        keys = np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)
        order = np.argsort(keys, kind="stable")
        kept = [strings[i] for i in order.tolist()]
        self.n = len(kept)
        with tempfile.NamedTemporaryFile(delete=False) as f:
            f.write(keys[order].tobytes())
            f.write(np.cumsum([0, *map(len, kept)], dtype=np.int64).tobytes())
            f.write(b"".join(kept) + b"\0")
            self.name = f.name
        self.keys = np.memmap(self.name, np.uint64, "r", 0, (self.n,)) if self.n else np.zeros(0, np.uint64)
        self.offsets = np.memmap(self.name, np.int64, "r", 8 * self.n, (self.n + 1,))
        self.text = np.memmap(self.name, np.uint8, "r", 16 * self.n + 8)
        os.unlink(self.name)  # the maps stay valid

    def find(self, probes: Sequence[bytes]) -> np.ndarray:
        """Whether each probe is one of the strings."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, keys)
        out = np.zeros(len(probes), bool)
        hit = np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, max(0, self.n - 1))] == keys)) if self.n else []
        for i in hit:
            k = int(at[i])
            while k < self.n and self.keys[k] == keys[i] and not out[i]:
                out[i] = self.text[self.offsets[k]:self.offsets[k + 1]].tobytes() == probes[i]
                k += 1
        return out


def judge_all(strings: Sequence[bytes]):
    """Batches with host and path last: a column `blocked` is added."""
    longest = max((len(s.decode()) for s in strings), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(strings)
        for batch in batches:
            pairs = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()))
            probes = [[p.encode() for p in probes_of(h, t, longest)] for h, t in pairs]
            distinct = list({p for ps in probes for p in ps})
            found = {p for p, ok in zip(distinct, array.find(distinct)) if ok}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([any(p in found for p in ps) for ps in probes], pa.bool_())],
                [*batch.schema.names, "blocked"])
    return run


def _shard(probes: pa.Table, listed: pa.Table) -> pa.Table:
    array = DigestArray([s.encode() for s in listed.column("s").to_pylist()])
    texts = probes.column("s").to_pylist()
    ok = array.find([t.encode() for t in texts])
    return pa.table({"s": pa.array([t for t, k in zip(texts, ok) if k], pa.string())})


def blocked_urls(pages: DataFrame, blocklist: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`pages` (any columns, with host and path) with the column `blocked`; `blocklist` has a column `entry`."""
    spark = pages.sparkSession
    store = Store(spark)
    listed = store.keep(blocklist.select(entry_of(F.col("entry")).alias("s")).where("s <> ''").distinct(), "list")
    size, longest = listed.agg(F.coalesce(F.sum(F.octet_length("s") + 24), F.lit(0)), F.coalesce(F.max(F.length("s")), F.lit(0))).first()
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema]
    if size <= shard_bytes:
        strings = [r[0].encode() for r in listed.collect()]
        return pages.mapInArrow(judge_all(strings), ", ".join([*kinds, "blocked boolean"]))
    shards = -(-size // shard_bytes)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, probes = [], []
            for i, (h, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                ps = probes_of(h, t, longest)
                rows += [i] * len(ps)
                probes += ps
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(probes, pa.string())],
                                             ["row", "s"])

    marked = store.keep(pages.withColumn("row", F.monotonically_increasing_id()), "pages")
    looked = store.keep(marked.select("row", "host", "path").mapInArrow(expand, "row long, s string"), "probes")
    key = lambda d: d.select(F.pmod(F.xxhash64("s"), F.lit(shards)).alias("k"), "s")
    found = store.keep(key(looked.select("s").distinct()).groupBy("k").cogroup(key(listed.toDF("s")).groupBy("k"))
                       .applyInArrow(_shard, "s string"), "found")
    rows = looked.join(small(found), "s").select("row").distinct().withColumn("hit", F.lit(True))
    return marked.join(rows, "row", "left").select(*pages.columns, F.coalesce("hit", F.lit(False)).alias("blocked"))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule (allow or block, host, path) that fits; null if none does."""
    kind = "struct<rule:string,verdict:string>"
    out = F.when(F.lit(False), F.lit(None).cast(kind))
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = out.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")).cast(kind))
    return out


def filter_urls(pages: DataFrame, blocklist: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id",
                url: str = "url", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict: the rule's, else block if the list has the URL, its host or a prefix."""
    u = F.col(f"`{url}`")
    parts = pages.select(F.col(f"`{key}`").alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"))
    judged = blocked_urls(parts, blocklist, shard_bytes).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(
        F.col("fit.verdict"), F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
