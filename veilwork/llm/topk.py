"""Exact top-k inner products by best-first search in M-trees.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the greatest norm, and queries a zero: then the nearest vectors in the
Euclidean metric are those with the greatest inner product.  Rows are dealt out to subtrees by their nearest of a few pivots; a
task builds one subtree, whose pages hold routing entries (pivot, covering radius, distance to the parent) and leaf entries
(vector, distance to the parent).  A block of queries walks a subtree together: the page with the least possible distance to any
of them comes first, entries that the stored parent distances exclude for all of them are left out before a distance is
computed, and a leaf's other entries are scored by one matrix product with the queries that still need the page.  The walk
ends when no page can hold a better row for any query.  Bounds are kept with a margin for rounding, scores are exact integers.

Queries are a stated set.  A first bound comes from the pivots' own scores; a query is sent only to subtrees whose covering radius
does not exclude it by that bound.  Building a subtree costs about a hundredth of a block's products, so each block builds its own.
Equal vectors are one entry with its k + 1 least ids (a row never competes with itself), kept by a rank that Spark limits in
every task before the shuffle, so a vector that a third of all rows share is one entry and no list grows.

Edge cases: null vectors, null or non-finite components, and null ids take no part; shorter vectors count as padded with
zeros; repeated rows count once, and rows with the query's id are its own; an empty table gives an empty result.  Columns other
than `key` and `vector` are never read, so extra columns may have any name.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.common import Store

LEAF, FANOUT, SUBTREE, BLOCK, PIVOTS = 256, 16, 6_000, 4_096, 1_024
LEAST = np.iinfo(np.int64).min


def quantised(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id, v (array of long) of the rows that take part."""
    v = F.col(f"`{vector}`")
    good = v.isNotNull() & F.col(f"`{key}`").isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return rows.where(F.coalesce(good, F.lit(False))).select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def spread_out(points: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """Row numbers of `count` points far from each other: each the farthest of a few drawn ones from those before."""
    drawn = rng.choice(len(points), min(len(points), 16 * count), replace=False)
    x = points[drawn]
    chosen, away = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(drawn)):
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, ((x - x[chosen[-1]]) ** 2).sum(1))
    return drawn[chosen]


def build(points: np.ndarray, slack: float, rng: np.random.Generator) -> list[dict]:
    """Pages of an M-tree over augmented points, the root first; a routing entry names its page."""
    pages: list[dict] = []

    def grow(rows: np.ndarray, pivot: np.ndarray) -> tuple[int, float]:
        """Page number and covering radius around the pivot."""
        at, place = np.sqrt(((points[rows] - pivot) ** 2).sum(1)), len(pages)
        pages.append({})
        if len(rows) <= LEAF:
            pages[place] = {"leaf": True, "rows": rows, "parent": at}
        else:
            heads = points[rows[spread_out(points[rows], min(FANOUT, -(-len(rows) // LEAF)), rng)]]
            near = np.argmin((heads ** 2).sum(1)[None, :] - 2 * points[rows] @ heads.T, 1)
            if (near == near[0]).all():  # equal heads: split by number
                near = np.arange(len(rows)) * len(heads) // len(rows)
            used = np.unique(near)
            below = [grow(rows[near == j], heads[j]) for j in used]
            pages[place] = {"leaf": False, "pivots": heads[used], "page": [b[0] for b in below],
                            "radius": np.array([b[1] for b in below]),
                            "parent": np.sqrt(((heads[used] - pivot) ** 2).sum(1))}
        return place, float(at.max()) + slack

    if len(points):
        grow(np.arange(len(points)), points.mean(0))
        pages[0]["pivot"] = points.mean(0)
    return pages


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each row of `a` to each row of `b`."""
    return np.sqrt(np.maximum((a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :] - 2 * a @ b.T, 0))


class Best:
    """The k best (score, id) of each query of a block, and the distance beyond which no row can enter."""

    def __init__(self, q: np.ndarray, own: np.ndarray, bound: np.ndarray, k: int, top: float, slack: float):
        self.q, self.own, self.k, self.top, self.slack = q, own, k, top, slack
        self.norm = (q.astype(float) ** 2).sum(1)
        self.least = bound.copy()  # rows below it are surely not among the best
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.limit = reach(self.norm, self.least, top, slack)

    def offer(self, asked: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[i, j] is that of query asked[i] and row ids[j]."""
        at, row = np.nonzero((scores >= self.least[asked][:, None]) & (ids[None, :] != self.own[asked][:, None]))
        if not len(at):
            return
        held = np.isin(self.query, asked[at])
        query = np.concatenate([self.query[held], asked[at]])
        score, found = np.concatenate([self.score[held], scores[at, row]]), np.concatenate([self.id[held], ids[row]])
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        size = np.diff(np.r_[first, len(query)])
        rank = np.arange(len(query)) - np.repeat(first, size)
        full = first[size >= self.k]
        self.least[query[full]] = score[full + self.k - 1]
        self.limit[query[full]] = reach(self.norm[query[full]], self.least[query[full]], self.top, self.slack)
        keep = rank < self.k
        self.query, self.score, self.id = (np.concatenate([x[~held], y[keep]]) for x, y in (
            (self.query, query), (self.score, score), (self.id, found)))


def reach(norm: np.ndarray, score: np.ndarray, top: float, slack: float) -> np.ndarray:
    """Distance between queries of these squared norms and rows of these scores, with the margin."""
    return np.where(score == LEAST, np.inf, np.sqrt(np.maximum(norm + top - 2 * score.astype(float), 0)) + slack)


def products(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole-number rows whose squared norms are `most` at most: by floats where those are exact."""
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2.0 ** 52 else a @ b.T


def search(pages: list[dict], exact: np.ndarray, ids: list[list[int]], best: Best) -> int:
    """Offers `best` every row that can be among its queries' k best; returns how many scores were computed."""
    most = max(best.top, float(best.norm.max()))
    aug = np.hstack([best.q.astype(float), np.zeros((len(best.q), 1))])
    start = apart(aug, pages[0]["pivot"][None, :])[:, 0]
    tick, done = 0, 0
    queue = [(0.0, 0, 0, np.arange(len(aug)), np.zeros(len(aug)), start)]
    while queue:
        _, _, place, who, low, dist = heapq.heappop(queue)
        need = low <= best.limit[who]
        who, dist = who[need], dist[need]
        if not len(who):
            continue
        page, limit = pages[place], best.limit[who] + 2 * best.slack
        if page["leaf"]:
            may = (np.abs(dist[:, None] - page["parent"][None, :]) <= limit[:, None]).any(0)
            rows = page["rows"][may]
            done += len(who) * len(rows)
            scores = products(best.q[who], exact[rows], most)
            copies = np.repeat(np.arange(len(rows)), [len(ids[r]) for r in rows])
            best.offer(who, scores[:, copies], np.array([i for r in rows for i in ids[r]], np.int64))
            continue
        may = np.abs(dist[:, None] - page["parent"][None, :]) - page["radius"][None, :] <= limit[:, None]
        entries = np.flatnonzero(may.any(0))
        d = apart(aug[who], page["pivots"][entries])
        least = np.maximum(d - page["radius"][entries] - 2 * best.slack, 0)
        for j, entry in enumerate(entries):
            go = may[:, entry] & (least[:, j] <= best.limit[who])
            if go.any():
                tick += 1
                heapq.heappush(queue, (float(least[go, j].min()), tick, page["page"][entry], who[go], least[go, j], d[go, j]))
    return done


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of floor(scale * x), ties to the smaller id."""
    store = Store(vectors.sparkSession)
    data = quantised(vectors, key, vector, scale)
    entries = store.keep(_entries(data, k), "entries")
    asked = store.keep(quantised(queries, key, vector, scale).distinct().withColumn("n", F.xxhash64("id", "v")), "queries")
    count, width = entries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not count or asked.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    asked_width, asked_top = asked.agg(F.max(F.size("v")), F.max(norm)).first()
    width, top = max(width, asked_width), float(entries.agg(F.max(norm)).first()[0])
    most = max(top, float(asked_top))
    slack = 1e-6 * (1.0 + np.sqrt(most))

    def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        lengths, values = pc.list_value_length(column).to_numpy(), pc.list_flatten(column).to_numpy()
        out = np.zeros((len(column), width), np.int64)
        out[np.arange(width)[None, :] < lengths[:, None]] = values
        return out

    def augmented(x: np.ndarray) -> np.ndarray:
        return np.hstack([x.astype(float), np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])

    sample = entries.orderBy(F.xxhash64("v"), "v").limit(min(PIVOTS, -(-count // SUBTREE) * 8)).collect()  # routing only
    heads = np.array([list(r["v"]) + [0] * (width - len(r["v"])) for r in sample], np.int64)
    head_ids = np.array([i for r in sample for i in r["ids"]], np.int64)
    head_rows = np.repeat(np.arange(len(sample)), [len(r["ids"]) for r in sample])
    routes = augmented(heads[:max(1, -(-count // SUBTREE))])

    def route(batches):
        """Each entry's nearest pivot and its distance."""
        for batch in batches:
            away = apart(augmented(matrix(batch.column(0))), routes)
            near = np.argmin(away, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away.min(1))], ["v", "ids", "s", "away"])

    def bounds(scores: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The k-th best score among the sampled entries, or the least integer."""
        scores = np.where(head_ids[None, :] == own[:, None], LEAST, scores[:, head_rows])
        return np.partition(scores, -k, 1)[:, -k] if scores.shape[1] >= k else np.full(len(own), LEAST)

    def first_bound(radius: np.ndarray):
        """Per query: the first bound, and the pivots whose rows it can't exclude."""
        def run(batches):
            for batch in batches:
                q = matrix(batch.column(1))
                least = bounds(products(q, heads, most), batch.column(0).to_numpy())
                limit = reach((q.astype(float) ** 2).sum(1), least, top, 2 * slack)
                near = apart(np.hstack([q.astype(float), np.zeros((len(q), 1))]), routes) - radius[None, :] <= limit[:, None]
                to = pa.array([np.flatnonzero(n).tolist() for n in near], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least), to], ["id", "v", "n", "bound", "to"])
        return run

    def answer(queries: pa.Table, rows: pa.Table) -> pa.Table:
        names = ("query_id", "n", "vec_id", "score")
        if not len(rows) or not len(queries):
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        exact, ids = matrix(rows.column("v")), rows.column("ids").to_pylist()
        pages = build(augmented(exact), slack, np.random.default_rng(len(rows)))
        own, n, bound = (queries.column(c).to_numpy() for c in ("id", "n", "bound"))
        best = Best(matrix(queries.column("v")), own, bound, k, top, slack)
        search(pages, exact, ids, best)
        return pa.table(dict(zip(names, (own[best.query], n[best.query], best.id, best.score))))

    routed = store.keep(entries.mapInArrow(route, "v array<long>, ids array<long>, s int, away double"), "routed")
    # a pivot with many rows is cut into several subtrees; one row per pivot, PIVOTS at most
    sizes = routed.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / (2 * SUBTREE)).cast("int").alias("cuts"), F.max("away").alias("radius"))
    radius = np.full(len(routes), -np.inf)
    measured = sizes.collect()
    for r in measured:
        radius[r["s"]] = r["radius"] + slack
    sizes = F.broadcast(vectors.sparkSession.createDataFrame([(r["s"], r["cuts"]) for r in measured], "s int, cuts int"))
    routed = routed.join(sizes, "s").withColumn("t", F.pmod(F.xxhash64("v"), F.col("cuts")).cast("int"))
    blocks = -(-asked.count() // BLOCK)
    keyed = asked.mapInArrow(first_bound(radius), "id long, v array<long>, n long, bound long, to array<int>").withColumn(
        "k", F.pmod("n", F.lit(blocks)).cast("int"))
    every = keyed.withColumn("s", F.explode("to")).join(sizes, "s").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    every = every.select("s", "t", "k", "id", "v", "n", "bound")
    spread = routed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("s", "t", "k", "v", "ids")
    found = every.groupBy("s", "t", "k").cogroup(spread.groupBy("s", "t", "k")).applyInArrow(
        answer, "query_id long, n long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "n").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _entries(data: DataFrame, k: int) -> DataFrame:
    """Distinct vectors, each with its k + 1 least ids; the rank is limited in every task before rows are shuffled."""
    rank = F.row_number().over(W.partitionBy(F.xxhash64("v"), "v").orderBy("id"))
    least = data.distinct().withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
