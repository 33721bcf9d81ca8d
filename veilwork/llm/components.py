"""Connected components of an edge table by contraction: no row leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import Store, small


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(id, root) for every end of the edges a, b; root is the least id of its component.

    Each round hooks every root to its least neighbour below it, flattens these hooks by pointer jumping, and contracts
    the edges; a round leaves at most half of the roots that still have an edge.  There are no more hooks than edges.
    """
    live = store.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .where("a < b").distinct(), "edges")
    labels = store.keep(live.select(F.explode(F.array("a", "b")).alias("id")).distinct()
                        .withColumn("root", F.col("id")), "labels")
    while n := live.count():
        hooks = store.keep(live.groupBy(F.col("b").alias("r")).agg(F.min("a").alias("p")), "hooks")
        while True:
            above = small(hooks.select(F.col("r").alias("p"), F.col("p").alias("pp")), n)
            jumped = store.keep(hooks.join(above, "p", "left")
                                .select("r", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("more")), "jump")
            store.drop(hooks)
            hooks, more = jumped.drop("more"), not jumped.where("more").isEmpty()
            hooks.kept_at = jumped.kept_at
            if not more:
                break
        before, old = labels, live
        labels = store.keep(labels.join(small(hooks, n), labels["root"] == hooks["r"], "left")
                            .select("id", F.coalesce("p", "root").alias("root")), "labels")
        ha, hb = small(hooks.toDF("a", "pa"), n), small(hooks.toDF("b", "pb"), n)
        live = store.keep(live.join(ha, "a", "left").join(hb, "b", "left")
                          .select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
                          .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                          .distinct(), "edges")
        store.drop(before, old, hooks)
    return labels
