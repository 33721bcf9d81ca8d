"""Personal data: strict formats against plain patterns, other formats and look-alikes, boosting, edge and long texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from veilwork.llm import boosting, pii, queries
from veilwork.llm.common import Store

PERSONAL = [
    "mail john.doe (at) mail (dot) com now", "write jane [at] mail.org today", "bob9 at example dot com", "kim @ foo.com please",
    "x my ip fe80::1a2b:3c4d ok", "call (212) 555-0123 now", "tel 212 555 0187 x", "(030) 1234 567 is", "0049 30 1234567",
    "+49 30 1234567", "card 4012.8888.8888.1881", "4012-8888-8888-1882", "pay with 4012888888881882 in", "call 555-0123",
    "+1 (826) 555-4081 190.137.223.204 du", "fax: 212.555.0187", "7536784127813050 4845168114407329", "my email is a.b@c.de."]
OTHER = [
    "at 12:30:45 today", "on 2024-01-02 10:20:30 x", "apples @ 1.99 each", "look at the dot matrix", "order 4012888888881882 shipped",
    "isbn 978-3-16-148410-0", "pi 3.14159265358979323", 'token="5d190bd7c06284de91015a36974748794293dd8a"', "1 234 567 890 123",
    "version 1.2.3.4567", "id 123456789012", "1700000000000", "serial 123-456-7890", "years 1999 2000 2001 2002 2003", "score 10:9:8",
    "a 123456789012345678901234567890 b", "$ 1 000 000 000", "0000000", "cells 10 20 30 40 50 60 70"]
LONG = ["1" * 200_000, "a" * 200_000, "+" * 100_000 + "1", "((((" * 30_000, "1 " * 100_000, "1." * 60_000, "a@" * 60_000, "a.a@b." * 20_000, "@" * 90_000,
        "ab cd " * 30_000 + "x.y@z.org", "+1" + " ()" * 50_000 + "2", "a at " * 30_000 + "b dot c", "1:" * 50_000, "::" * 50_000, "a dot " * 30_000]


@pytest.fixture(scope="module")
def found(spark):
    """Spans by text number of: real documents, drawn strings, the lists above, edge rows."""
    rnd = random.Random(11)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    alphabet = ["1", "2", "00", "25", "4012888888881881", "+", "(", ")", " ", "-", ".", "@", "a", "b.c", "%", "é", "\n", "😀", "+1 (826) 555-4081"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(600)]
    texts += ["a@b.cc@d.ee", "a@b.c%x@d.e", "9.1.2.3.4", "256.1.1.1 1.1.1.1.1", "010.000.1.0001", "+12+345678901", "4012 8888-88881881", None, ""]
    at = len(texts)
    texts += PERSONAL + OTHER + LONG
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a@b.cc", "x", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, rid int").repartition(4)
    got = pii.personal_data(df, ["doc_id", "kind"]).collect()
    assert len(got) == len(rows) and {r.carried.kind for r in got} == {"x"}
    assert [[(s.start, s.kind, s.end) for s in r.spans] for r in got if r.carried.doc_id is None] == [[(0, "email", 6)]] * 2
    return texts, at, {r.carried.doc_id: r.spans for r in got if r.carried.doc_id is not None}


def test_strict_hits_equal_plain_patterns(found):
    texts, at, spans = found
    for i, t in enumerate(texts):
        if i < at + len(PERSONAL) + len(OTHER) or len(t) < 50_000:
            assert [(s.start, s.kind_no, s.end) for s in spans[i] if s.base] == plain.personal_base(t), t


def test_long_texts_have_their_strict_hits(found):
    texts, at, spans = found
    want = {"1." * 10: [(8 * i, 1, 8 * i + 7) for i in range(15_000)], ("ab cd " * 4)[:20]: [(180_000, 0, 180_009)]}
    for i in range(at + len(PERSONAL) + len(OTHER), len(texts)):
        if texts[i][:20] in want:
            assert [(s.start, s.kind_no, s.end) for s in spans[i] if s.base] == want[texts[i][:20]]


def test_other_formats_are_added_and_look_alikes_left(found):
    texts, at, spans = found
    assert [t for i, t in enumerate(texts[at:at + len(PERSONAL)], at) if not spans[i]] == []
    low = at + len(PERSONAL)
    assert [t for i, t in enumerate(texts[low:low + len(OTHER)], low) if spans[i]] == []
    both = spans[at + PERSONAL.index("+1 (826) 555-4081 190.137.223.204 du")]
    assert [(s.kind, s.start, s.end, s.base) for s in both] == [("phone", 0, 17, False), ("ip", 18, 33, True)]


def test_spans_are_ordered_and_none_covers_an_added_one(found):
    for spans in found[2].values():
        assert [(s.start, s.kind_no) for s in spans] == sorted((s.start, s.kind_no) for s in spans)
        for s in spans[:200]:
            assert s.base or not any(o != s and o.start <= s.start and s.end <= o.end for o in spans)


def test_query_digests(spark, monkeypatch):
    monkeypatch.setattr(pii, "fit", lambda vectors, features: boosting.Model(-9.0, []))  # nothing added: the strict part alone
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op11_pii(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        base = plain.personal_base(docs[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in base)
        assert (r.base_sha256, r.spans) == (hashlib.sha256(text.encode()).hexdigest(), text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[1] == k for b in base) for k in range(4)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_data(none, n_examples=500).count() == 0


def test_boosting_finds_a_rule_and_repeats_itself(spark):
    rows = [(a, b, c, 5.0 * ((a > 3) != (b > 1)), 5.0 * ((a > 3) == (b > 1))) for a in range(6) for b in range(4) for c in range(3)]
    store = Store(spark)
    table = store.keep(spark.createDataFrame(rows, "a int, b int, c int, pos double, neg double"))
    model = boosting.fit(table, ["a", "b", "c"], trees=6, depth=2)
    assert model == boosting.fit(table, ["a", "b", "c"], trees=6, depth=2)
    wrong = table.where((model.probability() > 0.5) != (F.col("pos") > 0))
    assert wrong.count() == 0 and all(t.feature in "ab" for t in model.trees)
    assert boosting.fit(table.where("pos > 0"), ["a"]).trees == [] and boosting.fit(table.limit(0), ["a"]).prior == 0


def test_held_out_examples_are_told_apart(spark):
    store = Store(spark)
    df = pii.labelled(pii.made_examples(spark, 3_000))
    kinds = {r.kind: (r.good, r.bad) for r in df.groupBy("kind").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()}
    assert set(kinds) == set(pii.KINDS) and all(a and b for a, b in kinds.values())
    none = df.select(*pii.FEATURES).limit(0)
    model, least = pii.learn(none, store, 3_000)
    new = pii.labelled(pii.made_examples(spark, 6_000).where("rid >= 3000"))
    scored = new.select("kind", "label", (model.probability() >= F.element_at(F.create_map(*[F.lit(x) for p in least.items() for x in p]), F.col("kind"))).alias("hit"))
    r = scored.agg(F.sum(F.expr("int(hit AND label = 1)")).alias("tp"), F.sum(F.expr("int(hit)")).alias("p"), F.sum("label").alias("all")).first()
    assert r.tp > 0.85 * r.p and r.tp > 0.85 * r["all"]
