"""Context-tree scores against a plain recursive version."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from veilwork.llm import context_tree


def plain_scores(rows, depth):
    """{row number: (n_tokens, n_known, train_tokens, base, score)} by definition, one decision at a time."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = defaultdict(lambda: [0, 0])
    words = Counter()

    def steps(t):
        raw = lower(t or "").encode()
        data = bytes([255]) * depth + raw + b"\xff"
        for k in range(depth, len(data)):
            for bit in range(8):
                yield data[k - depth:k], (1 << bit) | (data[k] >> (8 - bit)), (data[k] >> (7 - bit)) & 1

    def tokens(t):
        return [*lower(t or "").encode().split(), None]

    for (_, t), h in zip(rows, held):
        if not h:
            words.update(tokens(t))
            for ctx, number, bit in steps(t):
                for d in range(depth + 1):
                    counts[ctx[depth - d:], number][bit] += 1
    children = defaultdict(list)
    for ctx, number in counts:
        if ctx:
            children[ctx[1:], number].append((ctx, number))
    memo = {}

    def log_p(node):
        if node not in memo:
            a, b = counts[node]
            own = math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
            if len(node[0]) == depth:
                memo[node] = own, own
            else:
                below = sum(log_p(c)[1] for c in children[node])
                top = max(own, below)
                memo[node] = own, top + math.log(math.exp(own - top) / 2 + math.exp(below - top) / 2)
        return memo[node]

    def predict(ctx, number, bit, d=0):
        node = (ctx[depth - d:], number)
        if node not in counts:
            return .5
        a, b = counts[node]
        own = ((b if bit else a) + .5) / (a + b + 1)
        if d == depth:
            return own
        o, p = log_p(node)
        w = math.exp(o - math.log(2) - p)
        return w * own + (1 - w) * predict(ctx, number, bit, d + 1)

    n, v = sum(words.values()), len(words)
    return [(len(tokens(t)), sum(w in words for w in tokens(t)), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens(t)),
             sum(math.log10(predict(*s)) for s in steps(t))) for _, t in rows]


@pytest.mark.parametrize("depth", [2, 3])
def test_scores_equal_the_definition(spark, depth):
    rnd = random.Random(depth)
    rows = [(i, "".join(rnd.choice("abAB é\n") for _ in range(rnd.choice([1, 7, 40])))) for i in range(30)]
    rows += [(40, None), (41, ""), (None, "ab ab"), (7, rows[7][1]), (42, "zzz \t zz")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    got = context_tree.score(df, depth=depth).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted([(r.doc_id, round(r.score, 6), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=key)
    want = sorted([(i, round(p[4], 6), p[0], p[1], p[2], round(p[3], 6)) for (i, _), p in zip(rows, plain_scores(rows, depth))], key=key)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-5)


def test_without_training_texts_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = context_tree.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert row.held_out and row.n_known == 0 and row.train_tokens == 0
    assert row.score == pytest.approx(3 * 8 * math.log10(.5))
    assert context_tree.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_held_out_texts_are_compressed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = context_tree.score(docs).where("held_out AND n_tokens > 50").groupBy().avg("bits_per_byte").first()
    assert r[0] < 2.7


def test_packed_numbers_come_back():
    rng = random.Random(9)
    for size in (0, 1, 5, 3000):
        keys = context_tree.np.array(sorted({rng.randrange(-2**63, 2**63) for _ in range(size)}), context_tree.np.int64)
        assert (context_tree.unpacked_keys(context_tree.packed_keys(keys), size) == keys).all()
        values = context_tree.np.array([rng.gauss(0, 9) for _ in range(size)], context_tree.np.float32)
        assert (context_tree.unpacked(context_tree.packed(values), size, context_tree.np.float32) == values).all()


def test_grams_are_counted_by_one_sort():
    import numpy as np
    from veilwork.llm import context_tree as C
    rnd = np.random.default_rng(3)
    key, train = rnd.integers(0, 1 << 56, 500)[rnd.integers(0, 500, 4_000)], rnd.random(4_000) < 0.8
    want = C.counted(key, train)
    halves = [C.counted_grams(key[:1_500], train[:1_500]), C.counted_grams(key[1_500:], train[1_500:])]
    for got in (C.counted_grams(key, train), C.merged(halves)):
        assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(got, want))
    assert np.array_equal(C.places(want[0], key), np.searchsorted(want[0], key))
    assert all(len(x) == 0 for x in C.counted_grams(key[:0], train[:0]) + C.merged([(key[:0], key[:0])]))
