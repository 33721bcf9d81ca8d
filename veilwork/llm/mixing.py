"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id and text.  A source takes all its documents a whole number of times, and those
whose hash is below a threshold once more.  The threshold is found without sorting: sizes are summed by source and hash
bucket, the bucket where the budget runs out is split by the next twelve bits, and so on until it holds one document.
What is left of the budget is offered again, by the same search, to the documents that still fit into it (nested
thresholds), so that one long document at the boundary can't leave a source far from its target.

Edge cases: null text counts 0 words; a null source is a source, last in order; rows with the same id and text have the
same hash and are taken together; sources without words and empty tables take nothing.  Extra columns are carried only
if named.  The per-source state (one row per source, as the weights) is the only thing the driver holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.common import Store, words

HASH_BITS, STEP_BITS = 60, 12
ALL = 1 << HASH_BITS


def document_hash(key: Column, text: Column) -> Column:
    plain = F.concat(F.coalesce(key.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("-")))
    return F.conv(F.substring(F.md5(plain), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, cap: float) -> list[float]:
    """Budgets in proportion to the weights, held at `cap` times the size, the excess given to the others by weight."""
    total = share * sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i])
    level, full, weight = 0.0, 0.0, float(sum(weights))
    for i in order:  # the level is the greatest that results from holding the first k sources at their cap
        if weight > 0:
            level = max(level, (total - full) / weight)
        full, weight = full + cap * sizes[i], weight - weights[i]
    return [min(cap * s, level * w) for s, w in zip(sizes, weights)]


@dataclass
class Search:
    """One source's search for the hash below which its documents fit into `budget`."""

    budget: int
    prefix: int = 0
    below: int = 0
    found: int | None = None


def thresholds(eligible: DataFrame, budgets: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each source number: the threshold and the sum of sizes below it.  `eligible` has columns s, size, h."""
    spark = eligible.sparkSession
    state = {s: Search(b) for s, b in budgets.items()}
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        open_ = [(s, x.prefix, x.budget - x.below) for s, x in state.items() if x.found is None]
        if not open_:
            break
        at = F.broadcast(spark.createDataFrame(open_, "s int, prefix long, rest long"))  # a row per source
        inside = eligible.join(at, "s").where(F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        hist = inside.groupBy("s", "rest", F.shiftright("h", shift).alias("b")).agg(
            F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
        run = hist.withColumn("upto", F.sum("n").over(W.partitionBy("s").orderBy("b")))
        edge = run.where(F.col("upto") > F.col("rest")).groupBy("s").agg(
            F.min(F.struct("b", "upto", "n", "docs")).alias("e"))
        fits = run.where(F.col("upto") <= F.col("rest")).groupBy("s").agg(F.max("upto").alias("sum"))
        for r in edge.join(fits, "s", "full").collect():
            x = state[r["s"]]
            if r["e"] is None:  # all fit, which only happens at the first step
                x.found, x.below = ALL, x.below + r["sum"]
            else:
                x.below += r["e"]["upto"] - r["e"]["n"]
                x.prefix = r["e"]["b"]
                if r["e"]["docs"] == 1 or shift == 0:
                    x.found = r["e"]["b"] << shift
    return {s: (ALL if x.found is None else x.found, x.below) for s, x in state.items()}


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
        carry: Sequence[str] = ("doc_id",), key: str = "doc_id", text: str = "text", source: str = "source",
        rounds: int = 3) -> DataFrame:
    """Struct `carried`, source, size, source_size, target, copies, taken: how often the mix takes each document."""
    spark = docs.sparkSession
    store = Store(spark)
    col = lambda c: F.col(f"`{c}`")
    base = store.keep(docs.select(
        F.struct(*[col(c) for c in carry]).alias("carried"), col(source).alias("source"),
        F.coalesce(F.size(words(col(text))), F.lit(0)).cast("long").alias("size"),
        document_hash(col(key), col(text)).alias("h")), "sizes")
    totals = {r[0]: r[1] for r in base.groupBy("source").agg(F.sum("size")).collect()}
    names = sorted((s for s in totals if s is not None), key=lambda s: s.encode()) + [None] * (None in totals)
    sizes = [totals[s] for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share, cap)
    whole = [int(t // s) if s else 0 for t, s in zip(goal, sizes)]
    rest = {i: int(t - w * s + 1e-6) for i, (t, w, s) in enumerate(zip(goal, whole, sizes))}
    plan = spark.createDataFrame([(i, *x) for i, x in enumerate(zip(names, sizes, goal, whole))],
                                 "s int, name string, source_size long, target double, whole int")
    numbered = base.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("name"))).drop("name")  # a row per source
    once_more = F.lit(False)
    for k in range(rounds):
        limit = dict(rest)
        eligible = numbered.where(~once_more & (F.col("size") > 0))
        if k:
            eligible = eligible.where(F.col("size") <= F.element_at(_by_source(limit), F.col("s")))
        found = thresholds(eligible.select("s", "size", "h"), {s: b for s, b in rest.items() if b > 0})
        below = {s: found[s][0] if s in found else 0 for s in rest}
        rest = {s: b - (found[s][1] if s in found else 0) for s, b in rest.items()}
        take = F.col("h") < F.element_at(_by_source(below), F.col("s"))
        if k:
            take = take & (F.col("size") <= F.element_at(_by_source(limit), F.col("s")))
        once_more = once_more | take
        if not any(rest.values()):
            break
    copies = F.col("whole") + F.when(once_more, 1).otherwise(0)
    return numbered.select("carried", "source", "size", "source_size", "target", copies.alias("copies"),
                           (copies * F.col("size")).cast("long").alias("taken"))


def _by_source(values: dict[int, int]) -> Column:
    return F.create_map(*[F.lit(x) for s, v in (values or {0: 0}).items() for x in (s, v)]).cast("map<int,bigint>")
