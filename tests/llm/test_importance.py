"""Importance resampling against its definition, the selection against sorting, edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from veilwork.llm import importance, queries
from veilwork.llm.importance import feature_buckets, kth_key, numbered, pairs_checksums, resample
from veilwork.llm.common import Store

SF = "/root/testdata/sf0.001"


def test_query_by_the_contract(spark):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()]
    docs, target = [r[:2] for r in read("documents")], [r[1] for r in read("benchmark")]
    got = queries.op13_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(plain.resampled(docs, target))


def test_edges_ties_and_repeated_rows(spark):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choice(["Ab", "cd", "é", "x9", "t" * 300]) for _ in range(n))
    rows = [(i, text(rnd.choice([3, 19, 20, 60]))) for i in range(150)]
    rows += [(None, text(40)), (None, text(40)), (None, None), (7, ""), (8, "--")] + [(5, "one two " * 15)] * 9
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score int, row int").repartition(4)
    goal = spark.createDataFrame([("ab cd ab",), (None,)], "text string")
    want = plain.resampled(rows, ["ab cd ab", None])
    got = resample(df, goal).drop("n_words").collect()
    cut = lambda rs: sorted(((*r[:4], r[4] is None) for r in rs), key=str)
    assert cut(map(tuple, got)) == cut(want)
    assert sorted(r.rank for r in got if r.rank) == list(range(1, sum(r[4] is not None for r in want) + 1))
    by_rank = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)]
    assert by_rank == sorted(by_rank)
    assert resample(df.limit(0), goal).count() == 0
    assert {r.rank for r in resample(df.where("doc_id < 3"), goal.limit(0)).collect()} <= {None, 1}


@pytest.mark.parametrize("pivots", [1, 4, 31])
def test_selection_equals_sorting(spark, pivots):
    rnd = random.Random(pivots)
    rows = [(rnd.randrange(5), rnd.choice([None, 1, 2, 3]), i) for i in range(120)]
    keys = spark.createDataFrame(rows, "score long, doc_id long, row long").select(importance._key().alias("key"))
    want = sorted(((-s, d is None, d, i) for s, d, i in rows), key=lambda v: (v[0], v[1], v[2] or 0, v[3]))
    for k in (1, 37, 120):
        assert tuple(kth_key(keys, k, len(rows), pivots)) == want[k - 1]


def test_numbers_follow_the_order(spark):
    df = spark.range(500).select(F.xxhash64("id").alias("h"))
    got = numbered(df, Store(spark), [F.col("h")]).collect()
    assert [r.h for r in sorted(got, key=lambda r: r["rank"])] == sorted(r.h for r in got) and {r["rank"] for r in got} == set(range(1, 501))


def test_checksums_of_pairs_and_pieces(monkeypatch):
    rnd = random.Random(1)
    words = [bytes(rnd.randrange(97, 123) for _ in range(rnd.choice([1, 5, 255, 256, 400]))) for _ in range(200)]
    want = [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]
    alone, sizes = np.array([zlib.crc32(w) for w in words], np.uint32), np.array(list(map(len, words)))
    assert pairs_checksums(words, alone, sizes).tolist() == want
    text = "Été 9x,a_b\x7fc 日本 " * 40
    whole = sorted(np.concatenate([b for _, b in feature_buckets(text.encode())]).tolist())
    monkeypatch.setattr(importance, "PIECE", 10)
    pieces = list(feature_buckets(text.encode()))
    assert sorted(np.concatenate([b for _, b in pieces]).tolist()) == whole and sum(n for n, _ in pieces) == 240
