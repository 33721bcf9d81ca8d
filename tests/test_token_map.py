"""One pass for a whole token map gives what a pass per label gives."""

import random

from pyspark.sql import functions as F

from veilwork.operators.detect import OCC, detect
from veilwork.rules.ruleset import RuleSet, apart, compile_pattern, compile_tokens, dialect

MAP = {"ZIP": ["<ZIP/>", "zip"], "PIN": ["<PIN/>"], "LAUGH": ["haha", "<L>"]}


def test_one_step_where_tokens_stay_apart():
    assert [d.kind for d in compile_tokens(0, "T", MAP, "")] == ["tokens"]
    for other in ({"A": ["ab"], "B": ["bc"]}, {"A": ["ab"], "B": ["xaby"]}, {"A": ["a.c"], "B": ["x"]}, {"A": ["AB"], "B": ["ab"]}):
        same_case = other == {"A": ["AB"], "B": ["ab"]}
        assert apart(other, False) == same_case and not apart(other, True)
        steps = compile_tokens(0, "T", other, "i")
        assert [d.kind for d in steps] == ["pattern"] * 2 and [d.params["opens"] for d in steps] == [True, False]
    assert compile_tokens(0, "T", {}, "") == [] and compile_tokens(0, "T", {"A": []}, "") == []


def run(df, steps):
    return sorted((r.row_id, r.text, [tuple(o) for o in r.occ]) for r in detect(df, steps).collect())


def test_equals_a_pass_per_label(spark):
    rnd = random.Random(2)
    parts = ["<ZIP/>", "zip", "<PIN/>", "haha", "<L>", " ", "x", "[ZIP-3]", "[PIN]", "[", "]", "-", "<", "[zip-1]", "é"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(400)] + ["", None, "<PIN/>" * 500 + "zip"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").withColumn("conversation_id", F.lit(1))
    each = [compile_pattern(0, "T", dialect.alternation(found), "", label=label) for label, found in MAP.items()]
    assert run(df, compile_tokens(0, "T", MAP, "")) == run(df, each)
    patterns = {"TAG": ["<[A-Z]+/?>"], "WORD": ["zip", "ha(ha)?"]}
    each = [compile_pattern(0, "T", dialect.alternation(found), "", label=label) for label, found in patterns.items()]
    assert run(df, compile_tokens(0, "T", patterns, "")) == run(df, each)


def test_one_regex_pass_in_the_plan(spark, capsys):
    df = spark.createDataFrame([(1, 1, "a <ZIP/>")], "row_id long, conversation_id long, text string")
    steps = [d for d in RuleSet({"token-map": {f"L{i}": [f"<T{i}/>"] for i in range(30)}}).detectors("text", 0) if d.rule == "_TOKEN_MAP_"]
    assert len(steps) == 1
    out = detect(df, steps)
    assert OCC in out.columns and out.count() == 1
