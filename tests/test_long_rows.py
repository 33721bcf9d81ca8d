"""Long rows: every shipped pattern, many hits, and phrase lists of any size."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veilwork import RedactionJob, RuleSet
from veilwork.functions import marks as M
from veilwork.functions.text import sub_until_stable
from veilwork.operators.detect import detect
from veilwork.rules import shipped
from veilwork.rules.ruleset import compile_pattern


@pytest.mark.parametrize("modality", ["text", "voice"])
@pytest.mark.parametrize("words", ["Word ", "twenty one ", "7 "])
def test_every_shipped_pattern_survives_a_hundred_thousand_words(spark, modality, words):
    df = spark.createDataFrame([(1, "12 " + words * 100_000)], "row_id long, text string")
    for d in RuleSet().detectors(modality, 4):
        if d.kind == "pattern":
            assert detect(df, [d]).select(F.size("occ")).first()[0] >= 0


@pytest.mark.parametrize("text, hit", [
    ("5 Main Street", "5 Main Street"), ("12 Old Mill Road Park Avenue N E", "12 Old Mill Road Park Avenue N E"), ("8 A Street", ""),
    ("6 Main STreetfoo", "6 Main STreet"), ("3 Park Park", "3 Park Park"), ("4 Foo a Street", ""), ("9 Long Crossroads x", "9 Long Crossroads ")])
def test_address_takes_the_last_suffix(spark, text, hit):
    assert spark.range(1).select(F.regexp_extract(F.lit(text), "(?i)" + shipped.address(), 0)).first()[0] == hit


def test_many_hits_in_one_row(spark):
    rule = compile_pattern(0, "N", r"\d+", "")
    df = spark.createDataFrame([(1, "[A-1] " + "7 x " * 50_000)], "row_id long, text string")
    assert detect(df, [rule]).select(F.size("occ")).first()[0] == 50_000


def test_spans_out_of_order_overlapping_or_outside(spark):
    df = spark.createDataFrame([("hello world", [(6, 11, "B"), (0, 5, "A"), (3, 7, "C"), (20, 30, "D")])],
                               "t string, s array<struct<start:int,end:int,label:string>>")
    got = df.select(M.mark_spans("t", "s")).first()[0]
    assert got == f"{M.OPEN}A{M.MID}hello{M.CLOSE} {M.OPEN}B{M.MID}world{M.CLOSE}"


def test_substitution_runs_until_stable(spark):
    df = spark.createDataFrame([("(" * 50 + "x" + ")" * 50,), ("x",), (None,)], "text string")
    got = sub_until_stable(df, "text", r"^\((.*)\)$", "$1").collect()
    assert [(r.text, r.text_rounds) for r in got] == [("x", 50), ("x", 0), (None, 0)]


@pytest.mark.parametrize("fillers", [10, 3_000])
@pytest.mark.parametrize("extra, text, hit", [
    ({}, "in the U.S. a colour", ["U.S.", "colour"]), ({"add-wordbreak": False}, "xredx", ["red"]), ({}, "xredx red", ["red"]),
    ({"prematch": {"regex": "my "}}, "my red, a red", ["my red"]), ({"flags": []}, "Red red", ["red"])])
def test_phrase_lists_mean_the_same_at_any_size(spark, tmp_path, fillers, extra, text, hit):
    path = tmp_path / "phrases.csv"
    special = ["U\\.S\\.", "colou?r"] if "U.S." in text else ["red"]
    path.write_text("phrase\n" + "\n".join(special + [f"filler{i}" for i in range(fillers)]) + "\n")
    rules = RuleSet({"redaction-order": ["THING"], "level": {"own": ["THING"]}, "entities": {"THING": {"redactor": {
        "model-class": "phraselist", "text": {"phrase-filename": str(path), "add-wordbreak": "U.S." not in text, **extra}}}}})
    table, log = RedactionJob(rules, level="own").run(spark.createDataFrame([(1, "c", text)], "row_id long, conversation_id string, text string"))
    assert sorted(r.value for r in log.collect()) == sorted(hit)


def test_whole_benchmark_texts_are_the_phrase_list(spark, tmp_path):
    import random
    import re
    from collections import Counter

    from veilwork.catalog import QUERIES
    rnd = random.Random(8)
    text = lambda k, n: "".join(rnd.choice(["A", "b", "c", "d", "e"]) + str(rnd.randrange(n)) + rnd.choice([" ", " ", ", "]) for _ in range(k))
    bench, docs = [text(12, 9) for _ in range(3)] + [None, "one"], [(i, text(80, 12)) for i in range(20)] + [(20, None), (21, "one  One")]
    phrases = set()
    for t in filter(None, bench):
        for n in range(3):
            phrases |= {m[1].lower() for m in re.finditer(rf"\b(?=(\w+(?: \w+){{{n}}})\b)", t)}
    assert {len(p.split(" ")) for p in phrases} == {1, 2, 3}
    either = re.compile(r"\b(?:" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))) + r")\b", re.I)
    want = Counter({i: len(either.findall(t)) for i, t in docs if t})
    spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["d5_phrase_table_join_whole"](spark, str(tmp_path)).collect()
    assert {r.row_id: r.n for r in got} == {i: n for i, n in want.items() if n} and want[21] == 2
