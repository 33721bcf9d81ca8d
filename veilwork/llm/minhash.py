"""Near-duplicate detection: MinHash signatures joined through an inverted index of their coordinates.

1. Texts with equal shingle sets are one class; a class has a signature of 32 coordinates.
2. Classes are posted under their coordinate-value pairs.  A pair of classes is a candidate when at least 12 coordinates
   collide (at a similarity of 0.75, 24 are expected; fewer than 12 happen about twice in a million).
3. Prefix merging: two classes with 12 collisions share one of the 21 rarest pairs of each, so a class is posted under
   those only, and frequent pairs are skipped.  Collisions are counted on the whole signatures in the list.  Long lists
   are cut into chunks, and chunk is held against chunk.
4. A list reports a spanning forest of its candidates, not the pairs; the components of all forests are clusters, and
   every candidate pair lies in one cluster.
5. Links are confirmed on the full shingle sets of a cluster, again chunk by chunk: first each chunk of two different
   cuts in itself, which joins most copies, then chunk against chunk where a cluster still has several components.

Edge cases: no text or no words: empty set, linked with nothing; fewer than five words: the whole sequence as one shingle; each
row is a document; a null doc_id sorts last and can be a component's id only if all are null; rows with the same doc_id and
text are the same document and kept alike; an empty table gives an empty result.  Extra columns are carried only if named.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.common import Store, shuffled, small
from veilwork.llm.components import components
from veilwork.llm.hashing import mix, shingles, slices, text_buffer, word_hashes

COORDINATES, MATCHES, CHUNK, STRIPE = 32, 12, 256, 8_192
#: Bytes of text that are hashed at a time; the hashing needs some 40 bytes for each.
SLICE = 1 << 20
_rng = np.random.default_rng(6)
_A = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def batch_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, text numbers, shingles), slice by slice."""
    data, offsets = text_buffer(column)
    for i, j in slices(offsets, SLICE):
        t, h = shingles(*word_hashes(data, offsets[i:j + 1]), j - i)
        yield i, j - i, t, h


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, th, text to doc_id, th, n, cls, sig."""
    for batch in batches:
        counts, digests, sigs = [], [], []
        for _, rows, t, h in batch_sets(batch.column(2)):
            n = np.bincount(t, minlength=rows)
            has, begin = n > 0, np.flatnonzero(np.concatenate((np.ones(min(1, len(t)), bool), t[1:] != t[:-1])))
            digest, sig = np.zeros(rows, np.uint64), np.zeros((rows, COORDINATES), np.int32)
            if len(begin):
                digest[has] = mix(np.add.reduceat(mix(h ^ np.uint64(0x9E3779B97F4A7C15)), begin) + n[has].astype(np.uint64))
                for k in range(COORDINATES):
                    sig[has, k] = np.minimum.reduceat((h * _A[k]) >> np.uint64(33), begin).astype(np.int32)
            counts.append(n)
            digests.append(digest)
            sigs.append(sig)
        if counts:
            flat = np.concatenate(sigs).reshape(-1)
            ends = np.arange(0, len(flat) + 1, COORDINATES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(counts).astype(np.int64)),
                 pa.array(np.concatenate(digests).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["doc_id", "th", "n", "cls", "sig"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns cls, text to cls, set (sorted 64-bit hashes)."""
    for batch in batches:
        for i, rows, t, h in batch_sets(batch.column(1)):
            ends = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=rows)))).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, rows), pa.array([h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())],
                ["cls", "set"])


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of a symmetric boolean matrix: (members, their least member)."""
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(near)))
    return other, label[other]


def blocks_of(table: pa.Table, names: list[str]) -> Iterator[tuple[np.ndarray, tuple[int, ...]]]:
    """Row numbers of the groups of a bucket, by class, so that forests of the same classes have the same edges."""
    keys = [table.column(k).to_numpy() for k in names]
    order = np.lexsort((table.column("cls").to_numpy(), *keys[::-1]))
    keys = [k[order] for k in keys]
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    edges = np.flatnonzero(new).tolist()
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield order[lo:hi], tuple(int(k[lo]) for k in keys)


def edges_table(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    x, y = (np.concatenate(c) for c in zip(*pairs, (np.zeros(0, np.int64),) * 2))
    ends = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
    return pa.table({"a": pa.array(ends[0]), "b": pa.array(ends[1])})


def collisions(table: pa.Table) -> pa.Table:
    """Counts collisions in lists of postings (columns c, v, part, other, cls, sig); a forest of each list's candidates."""
    cls = table.column("cls").to_numpy()
    sig = np.array(table.column("sig").combine_chunks().flatten()).reshape(-1, COORDINATES)
    out = []
    for rows, _ in blocks_of(table, ["c", "v", "part", "other"]):
        if len(rows) > 1:
            s = sig[rows]
            near = np.zeros((len(rows), len(rows)), bool)
            for k in range(0, len(rows), 64):
                near[k:k + 64] = (s[k:k + 64, None, :] == s[None, :, :]).sum(2, dtype=np.uint8) >= MATCHES
            x, y = forest(near)
            out.append((cls[rows[x]], cls[rows[y]]))
    return edges_table(out)


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[place] > 1  # others are in one set only
    owner, place = owner[shared], place[shared]
    number = np.cumsum(times > 1) - 1
    place = number[place]
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, STRIPE):
        a, b = np.searchsorted(place, (lo, lo + STRIPE))
        has = np.zeros((len(sets), STRIPE), np.float32)
        has[owner[a:b], place[a:b] - lo] = 1
        out += has @ has.T
    return out


def confirm(percent: int, with_components: bool):
    """Links on full sets inside blocks (columns root, part, other, cls, set): a forest of each block's links."""
    def bucket(table: pa.Table) -> pa.Table:
        cls = table.column("cls").to_numpy()
        comp = table.column("comp").to_numpy() if with_components else cls
        out = []
        for rows, _ in blocks_of(table, ["root", "part", "other"]):
            if len(rows) > 1 and (comp[rows] != comp[rows[0]]).any():
                sets = [np.frombuffer(x, np.uint64) for x in table.column("set").take(pa.array(rows)).to_pylist()]
                n, both = np.array([len(x) for x in sets]), common(sets)
                x, y = forest(100 * both >= percent * (n[:, None] + n[None, :] - both))
                out.append((cls[rows[x]], cls[rows[y]]))
        return edges_table(out)
    return bucket


def chunk_pairs(df: DataFrame, n: Column, number: Column) -> DataFrame:
    """Rows of groups of n rows, once for every pair of chunks (part <= other) that their own chunk is in."""
    chunks = F.ceil(n / CHUNK).cast("int")
    df = df.withColumn("home", F.pmod(number, chunks).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return df.withColumn("part", F.least("home", "chunk")).withColumn("other", F.greatest("home", "chunk"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    store = Store(spark)
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(plain).alias("th"), plain.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = store.keep(rows.mapInArrow(signatures, f"doc_id {kind}, th long, n long, cls long, sig array<int>"), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = store.keep(signed.where("n > 0").groupBy("cls").agg(F.min(order).alias("rep"), F.first("sig").alias("sig")),
                         "classes")
    tokens = classes.select("cls", F.posexplode("sig").alias("c", "v"))
    shared = store.keep(tokens.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    mine = W.partitionBy("cls")
    posted = tokens.join(small(shared), ["c", "v"]).select(
        "cls", "c", "v", "n", F.row_number().over(mine.orderBy("n", "c")).alias("rank"),
        F.count(F.lit(1)).over(mine).alias("m")).where(F.col("rank") <= F.col("m") - MATCHES + 1)
    # long lists are cut into chunks, and all pairs of chunks are compared
    listed = chunk_pairs(posted.join(shuffled(classes.select("cls", "sig")), "cls"), F.col("n"), F.xxhash64("cls"))
    listed = store.keep(listed.select("c", "v", "part", "other", "cls", "sig"), "postings")
    bucket = F.pmod(F.xxhash64("c", "v", "part", "other"), F.lit(max(1, listed.count() // 40_000))).alias("k")
    near = store.keep(listed.select(bucket, "*").groupBy("k").applyInArrow(collisions, "a long, b long"), "candidates")
    clusters = components(near, store)
    store.drop(listed, near)
    # the sets of the classes that have a candidate
    many = clusters.count()
    sized = clusters.join(small(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n")), many), "root")
    members = store.keep(small(sized, many).join(classes.select(F.col("cls").alias("id"), "rep"), "id")
                         .select("root", F.col("id").alias("cls"), "n", "rep.doc_id", "rep.th"), "members")
    texts = rows.alias("r").join(small(members, many).alias("e"), F.col("r.th").eqNullSafe(F.col("e.th"))
                                 & F.col("r.doc_id").eqNullSafe(F.col("e.doc_id")))
    sets = store.keep(texts.select("e.cls", "r.text").mapInArrow(full_sets, "cls long, set binary"), "sets")
    sets_by_class = sets.groupBy("cls").agg(F.first("set").alias("set"))  # repeated rows give a set twice

    def links(blocks: DataFrame, with_components: bool) -> DataFrame:
        blocks = store.keep(blocks, "blocks")
        k = F.pmod(F.xxhash64("root", "part", "other"), F.lit(max(1, blocks.count() // 4_000))).alias("k")
        full = shuffled(blocks).join(sets_by_class, "cls").select(k, *blocks.columns, "set")
        return store.keep(full.groupBy("k").applyInArrow(confirm(percent, with_components), "a long, b long"), "links")

    chunk = lambda salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.ceil(F.col("n") / CHUNK)).cast("int")
    once = members.select("root", chunk(0).alias("part"), F.lit(0).alias("other"), "cls")
    again = members.where(F.col("n") > CHUNK).select("root", chunk(1).alias("part"), F.lit(-1).alias("other"), "cls")
    first = links(once.unionByName(again), False)
    placed = members.where(F.col("n") > CHUNK).join(small(components(first, store).toDF("cls", "c"), many), "cls", "left").select(
        "root", "cls", "n", F.coalesce("c", "cls").alias("comp"))
    mixed = placed.groupBy("root").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("root")
    rest = chunk_pairs(placed.join(small(mixed, many // CHUNK), "root"), F.col("n"), F.xxhash64("cls", F.lit(0))).where("part < other")
    more = links(rest.select("root", "part", "other", "cls", "comp"), True)
    final = components(first.unionByName(more), store)
    named = classes.select("cls", "rep").join(small(final.withColumnRenamed("id", "cls"), many), "cls", "left").select(
        "cls", "rep", F.coalesce("root", "cls").alias("comp"))
    heads = named.groupBy("comp").agg(F.min("rep").alias("head"))
    groups = store.keep(named.join(heads, "comp").select("cls", "head"), "groups")
    some = signed.where("n > 0").join(shuffled(groups), "cls").select(
        "doc_id", "th", F.col("n").alias("n_shingles"), F.col("head.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))).alias("kept"))
    none = signed.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"),
                                        F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return some.unionByName(none)


def without_near_duplicates(docs: DataFrame, columns: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the named columns."""
    good = near_duplicates(docs, key, text).where("kept").select("doc_id", "th").distinct()
    plain = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = docs.select(F.col(f"`{key}`").alias("_id"), F.xxhash64(plain).alias("_th"), *[F.col(f"`{c}`") for c in columns])
    return (marked.join(good, marked["_id"].eqNullSafe(good["doc_id"]) & (marked["_th"] == good["th"]), "left_semi")
            .dropDuplicates(["_id", "_th"]).select(*columns))
