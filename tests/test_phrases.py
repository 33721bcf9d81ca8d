"""The phrase join against one regex, broadcast and spread; running sums; long rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilwork.functions import marks as M
from veilwork.operators import phrases as P


def plain(text, phrases):
    """Leftmost spans; at one place the longest phrase."""
    pattern = re.compile(r"\b(?:" + "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p))) + r")\b", re.I)
    return [m.span() for m in pattern.finditer(text)]


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_ROWS": 0}, {"BROADCAST_ROWS": 3, "HOT_KEY": 20}])
def test_equals_one_regex(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(P, k, v)
    rnd = random.Random(5)
    words = ["the", "The", "a", "é", "x9", "of", "under_score"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ", ", "\n", "-"]) for _ in range(rnd.randrange(60))) for _ in range(80)]
    texts += ["", "the", " the", None]
    phrases = ["the", "the a", "a the of", "x9-a", "of\nthe", "é é", "The A", "under_score of the a", "nowhere", "the, a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").repartition(3)
    got = {}
    for r in P.phrase_spans(rows, spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect():
        got.setdefault(r.row_id, []).append((r.start, r.end))
    assert got == {i: spans for i, t in enumerate(texts) if t and (spans := plain(t, phrases))}


def test_equal_keys_of_other_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(P, "word_grams", lambda words, lengths, row_id, f=P.word_grams: f(words, lengths, row_id).withColumn("key", F.lit(1).cast("long")))
    monkeypatch.setattr(P, "phrase_keys", lambda phrases, f=P.phrase_keys: f(phrases).withColumn("key", F.lit(1).cast("long")))
    rows = spark.createDataFrame([(1, "one two three"), (2, "two one")], "row_id long, text string")
    phrases = spark.createDataFrame([("one two",), ("three",)], "phrase string")
    assert sorted(map(tuple, P.phrase_spans(rows, phrases).collect())) == [(1, 0, 7), (1, 8, 13)]


def test_order_of_the_list_and_empty_lists(spark):
    rows = spark.createDataFrame([(1, "one two three")], "row_id long, text string")
    listed = spark.createDataFrame([("one", 0), ("one two", 1), ("?", 2)], "phrase string, phrase_ix long")
    assert [tuple(r) for r in P.phrase_spans(rows, listed).collect()] == [(1, 0, 3)]
    assert P.phrase_spans(rows, listed.limit(0)).count() == 0 and P.phrase_spans(rows.limit(0), listed).count() == 0


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_ROWS": 0}])
def test_hits_stream_in_batches_and_keys_alone_are_joined(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(P, k, v)
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 40))) for _ in range(30)]
    phrases = ["a", "a b", "b c d", "c", "d a"]
    rows = spark.createDataFrame([*enumerate(texts), (None, "b a b, c")], "row_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        spans = P.phrase_spans(rows, spark.createDataFrame([(p,) for p in phrases], "phrase string"))
        got = sorted(tuple(r) for r in spans.where("row_id IS NOT NULL").collect())
        none = sorted(tuple(r)[1:] for r in spans.where("row_id IS NULL").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == [(i, *span) for i, t in enumerate(texts) for span in plain(t, phrases)]
    assert none == plain("b a b, c", phrases)
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "gram" in plan and not re.search(r"gram#\d+ = phrase#|phrase#\d+ = gram#", plan)


def test_a_row_of_many_words(spark):
    n = 100_000
    rows = spark.createDataFrame([(1, "ab cd " * (n // 2))], "row_id long, text string")
    phrases = spark.createDataFrame([("cd",), ("ab cd ab",)], "phrase string")
    got = sorted(tuple(r)[1:] for r in P.phrase_spans(rows, phrases).collect())
    assert got[:3] == [(0, 8), (9, 11), (12, 20)] and len(got) == n // 2 and got[-1] == (6 * (n // 2) - 3, 6 * (n // 2) - 1)


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1023, 1024, 1025, 5000])
def test_running_sums(spark, n):
    got = spark.range(1).select(F.expr(M.running(f"transform(slice(sequence(1, {n + 1}), 1, {n}), x -> cast(x AS int))")).alias("r")).first().r
    assert got == [i * (i + 1) // 2 for i in range(n)]
