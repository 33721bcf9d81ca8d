"""Gradient-boosted trees over small whole-number features, grown from histograms that Spark sums.

Rows are distinct feature vectors with the weight of their positive and negative examples.  For each level of a tree one query sums
gradients and curvatures of the logistic loss by (node, feature, value); the driver reads these sums (at most nodes x features x
values rows) and picks the splits.  A model is SQL text, so scoring is a Column like any other.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Node:
    """A leaf with a value, or a split: rows with feature <= bound go left."""

    value: float = 0.0
    feature: str | None = None
    bound: int = 0
    left: "Node | None" = None
    right: "Node | None" = None

    def sql(self, leaf) -> str:
        if self.feature is None:
            return leaf(self)
        return f"CASE WHEN {self.feature} <= {self.bound} THEN {self.left.sql(leaf)} ELSE {self.right.sql(leaf)} END"


@dataclass
class Model:
    prior: float
    trees: list[Node]

    def margin(self) -> str:
        return " + ".join([repr(self.prior), *(f"({t.sql(lambda n: repr(n.value))})" for t in self.trees)])

    def probability(self) -> Column:
        return F.expr(f"1 / (1 + exp(-({self.margin()})))")


def _best_split(sums: dict, features: Sequence[str], penalty: float, least: float) -> tuple | None:
    """(gain, feature, bound, left value, right value) of {feature: {value: (gradient, curvature)}}."""
    best = None
    for f in features:
        bins = sorted(sums[f].items())
        g_all, h_all = (sum(v[k] for _, v in bins) for k in (0, 1))
        g = h = 0.0
        for value, (dg, dh) in bins[:-1]:
            g, h = g + dg, h + dh
            if min(h, h_all - h) < least:
                continue
            gain = g * g / (h + penalty) + (g_all - g) ** 2 / (h_all - h + penalty) - g_all * g_all / (h_all + penalty)
            if gain > 1e-6 and (best is None or round(gain, 9) > best[0]):
                best = (round(gain, 9), f, value, -g / (h + penalty), -(g_all - g) / (h_all - h + penalty))
    return best


def fit(vectors: DataFrame, features: Sequence[str], trees: int = 12, depth: int = 3, rate: float = 0.4, penalty: float = 1.0,
        least: float = 0.5) -> Model:
    """A model from a written table of distinct vectors: int columns `features`, double columns pos and neg (weights).

    The table is read by one task, so it must be bounded, as distinct vectors of small values are.
    """
    vectors = vectors.coalesce(1)
    pos, neg = vectors.agg(F.sum("pos"), F.sum("neg")).first()
    if not pos or not neg:
        return Model(0.0 if not pos and not neg else math.copysign(4.0, (pos or 0) - (neg or 0)), [])
    model = Model(round(math.log(pos / neg), 6), [])
    pairs = ", ".join(f"{k}, {f}" for k, f in enumerate(features))
    for _ in range(trees):
        root = Node()
        open_ = [root]
        rows = vectors.withColumn("p", model.probability()).selectExpr("*", "pos * (p - 1) + neg * p AS g", "(pos + neg) * p * (1 - p) AS h")
        for _ in range(depth):
            number = {id(n): k for k, n in enumerate(open_)}
            place = root.sql(lambda n: str(number.get(id(n), -1)))
            sums: dict = defaultdict(lambda: defaultdict(dict))
            for r in (rows.selectExpr(f"{place} AS node", "g", "h", f"stack({len(features)}, {pairs}) AS (f, b)").where("node >= 0")
                      .groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()):
                sums[r["node"]][features[r["f"]]][r["b"]] = (r["g"], r["h"])
            grown = []
            for k, node in enumerate(open_):
                split = _best_split(sums[k], features, penalty, least) if k in sums else None
                if split is None:
                    continue
                _, node.feature, node.bound, low, high = split
                node.left, node.right = Node(round(rate * low, 6)), Node(round(rate * high, 6))
                grown += [node.left, node.right]
            open_ = grown
            if not open_:
                break
        if root.feature is None:
            break
        model.trees.append(root)
    return model
