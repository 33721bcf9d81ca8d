"""Periodic runs against every lag of small texts, the query against the contract's digests, edge cases."""

import hashlib
import random

import pytest

from tests.llm import plain
from veilwork.llm import periodic_runs, queries
from veilwork.llm.periodic_runs import describe, find_runs, word_numbers, Vocabulary

SF = "/root/testdata/sf0.001"


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def some_words(rnd):
    def words(n, letters):
        return [rnd.choice(letters) for _ in range(n)]

    kind = rnd.randrange(9)
    if kind == 0:
        return words(rnd.randrange(500), "ab")
    if kind == 1:
        return fibonacci(rnd.randrange(900))
    if kind == 2:
        return [str(i.bit_count() % 2) for i in range(rnd.randrange(900))]
    if kind == 3:
        return (words(rnd.randrange(1, 200), "abcdefgh") * 9)[:rnd.randrange(700)]
    if kind == 4:  # periods inside periods
        inner = list("ab") * rnd.randrange(1, 60) + ["a"] * rnd.randrange(3)
        return ((inner * rnd.randrange(1, 4) + words(1, "abc")) * rnd.randrange(1, 5))[:900]
    if kind == 5:  # two runs of one period that touch
        d = words(rnd.randrange(1, 9), "abc")
        a, b = ((d * 200)[rnd.randrange(9):][:rnd.randrange(1, 400)] for _ in range(2))
        return a + b + a[:rnd.randrange(len(a) + 1)]
    if kind == 6:
        return words(rnd.randrange(600), list(map(str, range(1000))))
    if kind == 7:
        return [x for _ in range(8) for x in words(rnd.randrange(1, 150), "abcd") * rnd.randrange(1, 4)][:900]
    u = (words(rnd.randrange(1, 8), "ab") * 100)[:rnd.randrange(64, 260)]  # a long period that is itself periodic
    return words(rnd.randrange(5), "ab") + u + u + words(rnd.randrange(5), "abz")


@pytest.mark.parametrize("seed", range(6))
def test_equals_every_lag(seed):
    rnd = random.Random(seed)
    for _ in range(15):
        texts = [some_words(rnd) for _ in range(rnd.randrange(1, 6))]
        for w, (got, rest) in zip(texts, describe([" ".join(w).encode() for w in texts])):
            want = plain.runs(w)
            assert [tuple(map(int, r)) for r in got] == want
            assert rest.decode() == plain.collapsed(w, want)


def test_chunks_and_pieces_change_nothing(monkeypatch):
    rnd = random.Random(9)
    texts = [some_words(rnd) for _ in range(12)] + [[str(i * i % 997) for i in range(400)] * 3]
    raw = [" \n".join(w).encode() for w in texts]
    whole = [(r.tolist(), t) for r, t in describe(raw)]
    monkeypatch.setattr(periodic_runs, "CHUNK", 50)
    monkeypatch.setattr(periodic_runs, "PIECE", 30)
    assert [(r.tolist(), t) for r, t in describe(raw)] == whole
    assert word_numbers(b"a\x0bbb  a\x1c", Vocabulary()).tolist() == [0, 1, 2]


def test_a_very_long_text(spark):
    period = [f"w{i * 7919 % 65537}" for i in range(60_000)]
    text = " ".join(period * 3 + ["end"])
    got = find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got.runs] == [(0, 180_000, 60_000)] and got.collapsed == " ".join(period + ["end"])


def test_query_by_the_contract(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op12_periodic_runs(spark, SF).collect()
    assert len(got) == len(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        w = plain.repeated_from_some_word(plain.words(docs[r.doc_id]), r.doc_id)
        if len(w) > 700:
            continue
        want = plain.runs(w)
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in want)) and r.collapsed_sha256 == sha(plain.collapsed(w, want))


def test_edges(spark):
    rows = [(None, None), (1, ""), (1, " \t\n"), (2, "a " * 30), (2, "a " * 30), (3, "x")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, runs int").repartition(3)
    got = sorted(((r.carried.doc_id, r.carried.runs, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(df, ["doc_id", "runs"]).collect()), key=str)
    assert got == sorted([(None, 7, [], ""), (1, 7, [], ""), (1, 7, [], ""), (2, 7, [(0, 30, 1)], "a"), (2, 7, [(0, 30, 1)], "a"), (3, 7, [], "x")], key=str)
    assert find_runs(df.limit(0)).count() == 0
    planted = queries.with_periods(df.drop("runs")).collect()
    assert sorted(map(str, planted)) == sorted(str(r) for r in df.drop("runs").collect()) or len(planted) == len(rows)
