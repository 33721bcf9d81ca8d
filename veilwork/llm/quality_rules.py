"""Quality rules: document heuristics and cross-document line frequency, in DataFrame functions only.

Lines are normalised (letters and digits, lower case) and hashed.  Per host the operator counts the distinct documents
that hold a line; lines above the limit are boilerplate, and a document that keeps too few of its words without them is
rejected as depleted.

Documents are distinct when their whole texts differ.  So a text that was copied a thousand times counts once, and its lines
aren't taken for boilerplate; removing copies is left to the deduplication stages.  Near copies are distinct documents.

Edge cases: a null text has no words and fails the base rules; a null host is a host of its own; each row is a document,
also with a repeated or null doc_id; an empty table gives an empty result.  Input columns are carried only if named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import Store, small, word_chars, words

SYMBOLS = "#*$%&|<>"


def repeated_window_words(tri: Column) -> Column:
    """Words inside three-word windows that occur twice or more; `tri` holds the windows in order."""
    ordered = F.array_sort(F.transform(tri, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    # bind the sorted array once, then keep windows that equal a neighbour
    twins = F.transform(F.array(ordered), lambda s: F.filter(
        s, lambda e, k: F.coalesce(F.when(k > 0, e["t"] == F.get(s, k - 1)["t"]), F.lit(False))
        | F.coalesce(e["t"] == F.get(s, k + 1)["t"], F.lit(False))))[0]
    starts = F.array_sort(F.transform(twins, lambda e: e["i"]))
    covered = F.transform(F.array(starts), lambda p: F.aggregate(
        F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))),
                   lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3))),
        F.lit(0), lambda acc, x: acc + x))[0]
    return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0)).otherwise(covered)


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def facts(docs: DataFrame, carry: Sequence[str], text: str, host: str) -> DataFrame:
    """Per document: the base columns, a hash of its text, and its distinct normal lines with the words each accounts for."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"), F.col(f"`{host}`").alias("host"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    df = df.withColumn("w", words(F.col("text"))).withColumn("n_words", F.size("w").cast("long"))
    tri = F.when(F.size("w") >= 3, F.transform(
        F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))),
        lambda x, i: F.concat_ws(" ", x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))
    ).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("tri", tri)
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda ln: word_chars(ln) > 0))
    parts = F.filter(F.transform("lines", lambda ln: F.struct(normal_line(ln).alias("s"), F.size(words(ln)).alias("w"))),
                     lambda e: e["s"] != "")
    return df.select(
        "carried", "host", "n_words", word_chars(F.col("text")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("tri")).cast("long").alias("n_repeat_words"),
        F.xxhash64("text").alias("text_hash"),
        F.transform(parts, lambda e: F.struct(F.xxhash64(e["s"]).alias("h"), e["w"].alias("w"))).alias("parts"),
        F.monotonically_increasing_id().alias("row"))


def quality_rules(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text", host: str = "source",
                  min_words: int = 50, max_repeat: float = 0.5, line_limit: int = 20, min_left: float = 0.2) -> DataFrame:
    """Carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept.

    A line is removed when more than `line_limit` distinct documents of its host hold it.  A document is rejected when under
    `min_left` of its words are left, or when it fails the base rules.
    """
    store = Store(docs.sparkSession)
    base = store.keep(facts(docs, carry, text, host), "facts")
    lines = base.select("host", "text_hash", F.explode(F.array_distinct("parts.h")).alias("h"))
    frequent = store.keep(lines.distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
                          .where(F.col("n") > line_limit).select("host", "h"), "frequent")
    hits = base.select("row", "host", "n_words", F.explode("parts").alias("p")).alias("a").join(
        small(frequent).alias("b"), F.col("a.host").eqNullSafe(F.col("b.host")) & (F.col("a.p.h") == F.col("b.h")))
    removed = hits.groupBy("row").agg(F.sum("p.w").cast("long").alias("n_removed_words"))
    out = base.join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < min_left * F.col("n_words")
    return out.select("carried.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), "n_removed_words", (~failed & ~depleted).alias("kept"))
