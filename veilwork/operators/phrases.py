"""Large phrase lists: word n-grams meet the list in an equi-join.

For lists too long for one regex.  A phrase begins and ends with a word character and is
compared case-blind, as a whole, between word breaks.

A word and a gap are 64-bit hashes, and the key of n words rolls on from the key of n - 1.  A word stays a
candidate only if some phrase begins with it.  Keys meet in the join, then the text of the words is compared
with the phrase, so equal keys of different texts do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.functions import marks as M

#: A list is broadcast up to this many rows and characters; a longer one meets the text in a shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 20_000_000
#: Candidates of one key that go to one task of that shuffle; more are dealt over copies of the phrase.
HOT_KEY = 200_000


def _words(text: str) -> str:
    """SQL: the pieces of a text, each a word, a closing mark, and what stands behind it."""
    return f"split(regexp_replace({text}, '(?U)\\\\w+', {M.quote(f'{M.OPEN}$0{M.CLOSE}')}), '{M.OPEN}')"


def phrase_keys(phrases: DataFrame) -> DataFrame:
    """``(phrase, phrase_ix, words, first, key)``: each distinct phrase in lower case with its keys."""
    if "phrase_ix" not in phrases.columns:
        phrases = phrases.withColumn("phrase_ix", -F.length("phrase"))
    df = phrases.groupBy(F.lower("phrase").alias("phrase")).agg(F.min("phrase_ix").alias("phrase_ix"))
    df = df.withColumn("__p", F.expr(_words("phrase"))).where(
        f"size(__p) > 1 AND __p[0] = '' AND endswith(__p[size(__p) - 1], '{M.CLOSE}')")
    df = df.withColumn("__w", F.expr(M.pieces("__p")))
    df = df.withColumn("__h", F.expr(f"transform(__w, p -> xxhash64({M.head('p')}))"))
    rolled = (f"aggregate(sequence(1, size(__h)), __h[0], (k, j) -> CASE WHEN j = size(__h) THEN k "
              f"ELSE xxhash64(k, {M.tail('__w[j - 1]')}, __h[j]) END)")
    return df.select("phrase", "phrase_ix", F.size("__w").alias("words"), F.expr("__h[0]").alias("first"), F.expr(rolled).alias("key"))


def places(lengths: pa.Array) -> pa.Array:
    """For the lengths of each row's pieces the place of each piece: the sum of those before it."""
    sizes = np.asarray(lengths.flatten(), dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.asarray(pc.fill_null(pc.list_value_length(lengths), 0), dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = ends[:-1] - np.repeat(ends[bounds[:-1]], counts)
    mask = pa.array(np.asarray(lengths.is_null())) if lengths.null_count else None
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(at, pa.int32()), mask=mask)


def word_rows(rows: DataFrame, longest: int, row_id: str, text: str) -> DataFrame:
    """``(row_id, start, first, p0, p1, ...)``: one row per word, with its piece and those behind it (null at the end)."""
    df = rows.select(row_id, F.expr(_words(f"`{text}`")).alias("__p"))
    # the first piece stands before all words and has no mark
    df = df.withColumn("__at", F.arrow_udf(places, "array<int>")(F.expr("transform(__p, p -> length(p) - 1)")))
    shifted = ", ".join(f"slice(__p, {j + 2}, greatest(size(__p) - {j + 1}, 0))" for j in range(longest))
    names = ", ".join(f"p{j}" for j in range(longest))
    df = df.selectExpr(row_id, f"inline(arrays_zip(slice(__at, 2, size(__at) - 1), {shifted})) AS (at, {names})")
    return df.selectExpr(row_id, "at + 1 AS start", f"xxhash64(lower({M.head('p0')})) AS first", *names.split(", "))


def word_grams(words: DataFrame, lengths: list[int], row_id: str) -> DataFrame:
    """``(row_id, start, end, key, gram)``: the n-grams that begin at each word.

    A row carries keys only; the text and the end of a gram are worked out from its pieces where they are used.
    """
    keys, pieces = {1: "first"}, [f"p{j}" for j in range(lengths[-1])]
    df = words
    for n in range(2, lengths[-1] + 1):
        keys[n] = f"__k{n}"
        df = df.withColumn(keys[n], F.expr(f"CASE WHEN p{n - 1} IS NOT NULL THEN xxhash64({keys[n - 1]}, {M.tail(f'p{n - 2}')}, "
                                           f"xxhash64(lower({M.head(f'p{n - 1}')}))) END"))
    made = ", ".join(f"named_struct('n', {n}, 'key', {keys[n]})" for n in lengths)
    df = df.selectExpr(row_id, "start", *pieces, f"inline(array({made}))").where("key IS NOT NULL")
    grams, ends = [], []
    for n in lengths:
        before = "".join(f"lower({M.head(p)}), {M.tail(p)}, " for p in pieces[:n - 1])
        grams.append(f"WHEN {n} THEN concat({before}lower({M.head(pieces[n - 1])}))")
        ends.append(f"WHEN {n} THEN start + {''.join(f'length({p}) - 1 + ' for p in pieces[:n - 1])}length({M.head(pieces[n - 1])})")
    return df.selectExpr(row_id, "start", f"CASE n {' '.join(ends)} END AS end", "key", f"CASE n {' '.join(grams)} END AS gram")


def phrase_spans(rows: DataFrame, phrases: DataFrame, row_id: str = "row_id",
                 text: str = "text") -> DataFrame:
    """The leftmost, non-overlapping phrase spans of each row: ``(row_id, start, end)``.

    Where several phrases start at one place, the first of the list (``phrase_ix``) wins;
    a list without that column prefers the longest.
    """
    from veilwork.plans.redaction import keep_once
    phrases = keep_once(phrase_keys(phrases))
    size = phrases.groupBy("words").agg(F.count("*").alias("n"), F.sum(F.length("phrase")).alias("chars")).collect()
    if not size:                                        # a row per phrase length: a handful
        return rows.select(row_id, F.lit(0).alias("start"), F.lit(0).alias("end")).where(F.lit(False))
    few = sum(r.n for r in size) <= BROADCAST_ROWS and sum(r.chars for r in size) <= BROADCAST_CHARS
    hint = F.broadcast if few else (lambda df: df)
    lengths = sorted(r.words for r in size)
    found = word_rows(rows, lengths[-1], row_id, text)
    found = word_grams(found.join(hint(phrases.select("first").distinct()), "first", "left_semi"), lengths, row_id)
    hits = _spread_join(found, phrases, row_id) if not few else found.join(F.broadcast(phrases.select("key", "phrase", "phrase_ix")), "key")
    # an equality would become a key of the join, worked out for every gram; this looks only at those whose keys met
    hits = hits.where("startswith(gram, phrase) AND startswith(phrase, gram)").select(row_id, "start", "phrase_ix", "end")
    # sorted rows stream through the choice, so a row may have any number of hits
    ordered = hits.repartition(row_id).sortWithinPartitions(row_id, "start", "phrase_ix").select(row_id, "start", "end")
    return ordered.mapInArrow(leftmost, ordered.schema)


def _spread_join(found: DataFrame, phrases: DataFrame, row_id: str) -> DataFrame:
    """Join by key; keys with many candidates, as counted, are dealt over copies of their phrase."""
    counts = found.join(phrases.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("__n"))
    from veilwork.plans.redaction import keep_once
    hot = keep_once(counts.where(F.col("__n") > HOT_KEY).select("key", F.ceil(F.col("__n") / HOT_KEY).cast("int").alias("__copies")))
    if hot.isEmpty():
        return found.join(phrases.select("key", "phrase", "phrase_ix"), "key")
    # a row for each HOT_KEY candidates at most; broadcast only if that is few
    hint = F.broadcast if hot.count() <= BROADCAST_ROWS else (lambda df: df)
    found = found.join(hint(hot), "key", "left").withColumn(
        "__salt", F.coalesce(F.pmod(F.xxhash64(row_id, "start"), F.col("__copies")), F.lit(0)).cast("int")).drop("__copies")
    copies = phrases.select("key", "phrase", "phrase_ix").join(hint(hot), "key", "left").withColumn(
        "__salt", F.explode(F.expr("sequence(0, coalesce(__copies, 1) - 1)"))).drop("__copies")
    return found.join(copies, ["key", "__salt"])


def leftmost(batches):
    """Of spans in order, each that begins in a new row or at or after the end of the last one taken."""
    row, pos = None, 0
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        rows, starts, ends = batch.columns
        none = np.asarray(rows.is_null())
        same = np.asarray(pc.fill_null(pc.equal(rows[1:], rows[:-1]), False)) | (none[1:] & none[:-1])
        line = np.concatenate([[0], np.cumsum(~same)]) << 32
        starts, ends = line + np.asarray(starts), line + np.asarray(ends)
        behind = np.searchsorted(starts, ends).tolist()          # the next span that may be taken
        i = int(np.searchsorted(starts, pos)) if rows[0].as_py() == row else 0
        taken = []
        while i < n:
            taken.append(i)
            i = behind[i]
        if taken and line[taken[-1]] == line[-1]:
            pos = int(ends[taken[-1]] - line[-1])
        row = rows[n - 1].as_py()
        yield batch.take(pa.array(taken, pa.int64()))
