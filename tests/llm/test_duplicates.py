"""Near duplicates and repeated passages against plain versions."""

import random

import pytest

from tests.llm import plain
from veilwork.llm import common, minhash, suffix_dedup

WORDS = [f"w{i}" for i in range(3000)]


def near_copies(seed):
    rnd, texts = random.Random(seed), []
    shared = " ".join(rnd.choice(WORDS) for _ in range(40))
    for _ in range(40):
        base = [rnd.choice(WORDS) for _ in range(rnd.choice([3, 6, 30, 120, 300]))]
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            t = " ".join(w)
            t = t.upper() if rnd.random() < .3 else t
            texts.append(shared + "\n" + t if rnd.random() < .4 else t)
    base = [rnd.choice(WORDS) for _ in range(200)]
    for _ in range(80):
        w = list(base)
        for _ in range(rnd.randint(0, 9)):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        texts.append(" ".join(w))
    return [*enumerate([*texts, "", None, " \n", "a", "A", "b", "É é", "é É"])]


@pytest.mark.parametrize("chunk", [256, 16])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    docs = near_copies(chunk)
    df = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, cls int, th string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in plain.near_groups(docs).items()}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == sorted([("3", "3", True)] * 2 + [("None", "3", False)] * 2 + [("4", "4", True), ("None", "None", True)])
    kept = minhash.without_near_duplicates(df, ["doc_id", "text"]).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept if r.text) == [("3", "a b c d e f")]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_broadcast_counted_tables_only(spark, monkeypatch):
    plans, keep = [], common.Store.keep

    def watched(store, df, name="t"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(store, df, name)

    monkeypatch.setattr(common.Store, "keep", watched)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)  # no table counts as small, though all files are
    monkeypatch.setattr(minhash, "CHUNK", 16)
    docs = near_copies(7)
    found = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()}
    assert got == {d: (n, c, d == c) for d, (n, c) in plain.near_groups(docs).items()}
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 10 and not [p for p in plans if "Broadcast" in p]


def passages(seed, n=90):
    rnd, docs = random.Random(seed), []
    letter = lambda k: "".join(rnd.choice("abcdé ") for _ in range(k))
    base = [letter(400) for _ in range(6)]
    for i in range(n):
        t = ""
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, 250)
            t += rnd.choice(base)[at:at + rnd.randint(20, 300)] if rnd.random() < .6 else letter(rnd.randint(1, 150))
        docs.append((i, None if i == 5 else t + "xy" * rnd.randint(10, 200) if i % 17 == 0 else t))
    return docs


@pytest.mark.parametrize("width, hot", [(40, 32), (40, 1), (100, 32)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, width, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    docs = passages(width + hot)
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, doc int").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(df, width=width).select(
        "carried.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text").collect()}
    want = {d: (*x[:4], x[4].decode("utf-8", "ignore")) for d, x in plain.without_repeats(docs, width).items()}
    assert got == want


def test_repeated_rows_are_one_document_and_null_ids_come_last(spark):
    text = "".join(chr(97 + (i * i) % 26) for i in range(130))
    df = spark.createDataFrame([(7, text), (7, text), (None, text), (2, "")], "doc_id long, text string")
    got = sorted((str(r.carried.doc_id), r.n_removed) for r in suffix_dedup.remove_repeats(df, width=50).collect())
    assert got == [("2", 0), ("7", got[1][1]), ("7", got[1][1]), ("None", 130)] and got[1][1] < 130
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_scan_for_runs_takes_little_memory():
    import tracemalloc
    import numpy as np
    import pyarrow as pa
    from veilwork.llm import suffix_dedup as S
    rnd = np.random.default_rng(5)
    texts = [rnd.integers(97, 123, 4_000, np.uint8).tobytes().decode() for _ in range(2_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_000)), pa.array(range(2_000)), pa.array(texts)], ["doc", "th", "text"])
    S._powers.clear()
    tracemalloc.start()
    try:
        S.batch_runs(batch, 100)
        assert tracemalloc.get_traced_memory()[1] < 160 << 20
    finally:
        tracemalloc.stop()
        S._powers.clear()
