"""Whole runs on small dialogues, and properties that must hold at any size."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilwork import RedactionJob, RuleSet
from veilwork.functions.text import clean_text
from veilwork.operators import numbering as N
from veilwork.operators.anonymize import anonymize, restore
from veilwork.operators.detect import detect
from veilwork.sources import phrases as P
from veilwork.sources import tables as S

TOKENS = {"ZIP": ["<ZIP/>"], "PIN": ["<PIN/>", "<CVV/>"]}
TEXT = [
    "Good morning, garden shop, how can I help?", "The parcel for Mirko Tanaka never came.", "Write to mirko.t@example.net please.",
    "Our house is 7 Birch Hollow lane, <ZIP/>.", "Call 6175550188 before noon.", "Paid by 4012 0000 9876 5439, pin 2290.",
    "345-67-8901 is on file", "yes Mirko, $62.10 comes back", "", "code <CVV/>  <UNK> and zip 40213", "pin 2290 again, the 2nd of six"]
VOICE = ["reach me on six one seven, five five five, oh one eight eight", "social three four five six seven eight nine oh one.",
         "zip four oh two one three please", "the pin is two two nine oh", "that makes two hundred and six pots"]


def frame(spark, texts, conversation="c1", chunk=100):
    rows = [(i, i // chunk, conversation, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row_id long, chunk_id long, conversation_id string, text string")


def names_model(words):
    @F.pandas_udf("array<struct<start:int,end:int,label:string>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": m.start(), "end": m.end(), "label": label}
                           for m in re.finditer("|".join(map(re.escape, words)), t)
                           for label in [words[m.group()]]] for t in texts])
    return find


def lines(df):
    return [r.text for r in df.orderBy("row_id").collect()]


def test_text_level_2_global_numbers(spark):
    model = names_model({"Mirko Tanaka": "PERSON", "Mirko": "PERSON", "62.10": "MONEY", "six": "CARDINAL"})
    job = RedactionJob(RuleSet({"token-map": TOKENS}), "text", 2, numbering="global", span_source=model)
    out, log = job.run(frame(spark, TEXT))
    assert lines(out) == [
        "Good morning, garden shop, how can I help?", "The parcel for [PERSON-14] [PERSON-13] never came.", "Write to [EMAIL-10] please.",
        "Our house is [ADDRESS-5], [ZIP-0].", "Call [PHONE-7] before noon.", "Paid by [CCARD-6], pin [PIN-11].",
        "[SSN-8] is on file", "yes [PERSON-14], [MONEY-15] comes back", "", "code [PIN-1]  and zip [ZIP-9]",
        "pin [PIN-11] again, the 2nd of six"]
    got = [(r.label, r.value) for r in log.orderBy("seq").collect()]
    assert got == [("ZIP-0", "<ZIP/>"), ("PIN-1", "<CVV/>"), ("_IGNORE_-2", "pin"), ("_IGNORE_-3", "2nd of"),
                   ("ADDRESS-5", "7 Birch Hollow lane"), ("CCARD-6", "4012 0000 9876 5439"), ("PHONE-7", "6175550188"),
                   ("SSN-8", "345-67-8901"), ("ZIP-9", "40213"), ("EMAIL-10", "mirko.t@example.net"), ("PIN-11", "2290"),
                   ("PERSON-13", "Tanaka"), ("PERSON-14", "Mirko"), ("MONEY-15", "62.10")]


def test_chunks_are_numbered_one_after_the_other(spark):
    out, log = RedactionJob(level=2, numbering="global").run(frame(spark, ["pin 1168 x", "a@b.org", "pin 2279 x"], chunk=2))
    assert [r.label for r in log.orderBy("seq").collect()] == ["_IGNORE_-0", "EMAIL-1", "PIN-2", "PIN-4"]


def test_voice_level_4(spark):
    out, _ = RedactionJob(modality="voice", level=4).run(frame(spark, VOICE))
    got = lines(out)
    assert [re.sub(r"-\d+", "", t) for t in got] == [
        "reach me on [PHONE]", "social [SSN].", "zip [ZIP] please", "the pin is [PIN]", "that makes [CARDINAL] pots"]


def test_redact_then_restore_is_the_clean_input(spark):
    df = frame(spark, TEXT)
    found = detect(df, RuleSet({"token-map": TOKENS}).detectors("text", 2)).cache()
    indexed, dictionary = N.conversation_index(N.explode_hits(found))
    out, log = N.render(found, indexed, []), N.audit_log(dictionary)
    out = restore(out, log, ["_IGNORE_", "PIN", "ZIP", "ADDRESS", "CCARD", "PHONE", "SSN", "EMAIL"])
    assert lines(clean_text(out, "text")) == lines(clean_text(df, "text"))


def test_partitioning_does_not_change_the_result(spark):
    df = frame(spark, TEXT * 20)
    job = RedactionJob(level=1, numbering="global", block_rows=7)
    assert lines(job.run(df.repartition(1))[0]) == lines(job.run(df.repartition(13))[0])


def test_one_conversation_holds_most_rows(spark):
    texts = [f"pin {1000 + i % 700} and {2000 + i % 3}" for i in range(3000)]
    df = frame(spark, texts, "hot").unionByName(frame(spark, texts[:5], "cold").withColumn("row_id", F.col("row_id") + 9000))
    _, log = RedactionJob(level=1, block_rows=100).run(df)
    hot = [(r.label, r.value) for r in log.where("conversation_id = 'hot'").orderBy("seq").collect()]
    seen, want = set(), []
    for t in texts:
        found = [("_IGNORE_", "pin")] + [("PIN", n) for n in re.findall(r"(?<=\s)\d{4}", t)[::-1]]
        for f in found:
            if f not in seen:
                seen.add(f)
                want.append((f"{f[0]}-{len(want)}", f[1]))
    assert hot == want


def test_labels_of_the_input_are_kept(spark):
    out, _ = RedactionJob(level=4).run(frame(spark, ["see [PIN-7] and 55 [laughter]here", "x[PIN-7]y"]))
    assert lines(out) == ["see [PIN-7] and [CARDINAL-0] [laughter] here", "x [PIN-7] y"]


def test_uppercase_and_pass_through(spark):
    df = frame(spark, ["mail a@b.org"]).withColumn("other", F.lit("x"))
    out, _ = RedactionJob(level=2, uppercase=True).run(df)
    assert out.columns == df.columns and lines(out) == ["MAIL [EMAIL-0]"]


def test_anonymize_is_consistent_and_seeded(spark):
    df = frame(spark, ["call [PHONE-1]", "again [PHONE-1]", "other [PHONE-2]", "fac [FAC-1].", "[URL-1]"])
    a, b = (lines(anonymize(df, RuleSet(), "text", 4, seed=3)) for _ in range(2))
    assert a == b and a[0][5:] == a[1][6:] != a[2][6:]
    assert re.fullmatch(r"call \d{3}-\d{3}-\d{4}", a[0]) and a[3:] == ["fac .", "[URL-1]"]
    assert lines(anonymize(df, RuleSet(), "text", 4)) != lines(anonymize(df, RuleSet(), "text", 4))


def test_stream_state_equals_batch(spark, tmp_path):
    from veilwork.streaming.redact import stateful_index
    df = frame(spark, TEXT)
    hits = N.explode_hits(detect(df, RuleSet().detectors("text", 2))).select("conversation_id", "row_id", "k", "label", "value")
    hits = hits.cache()
    hits.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in"))
    out = stateful_index(stream)
    (out.writeStream.option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").format("parquet")
     .option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination())
    got = {(r.row_id, r.k, r.ix) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    want = {(r.row_id, r.k, r.ix) for r in N.conversation_index(hits)[0].collect()}
    assert got == want


def test_incremental_batches_keep_indexes(spark, tmp_path):
    from veilwork.streaming.redact import init_state, redact_batch
    steps = [d for d in RuleSet().detectors("text", 2) if d.rule == "EMAIL"]
    first, second = frame(spark, ["a@x.org b@x.org"]), frame(spark, ["c@x.org a@x.org"]).withColumn("row_id", F.lit(9))
    init_state(spark, f"{tmp_path}/s")
    for i, df in enumerate([first, second, second]):
        redact_batch(df, min(i, 1), steps, f"{tmp_path}/s", f"{tmp_path}/o")      # the second batch runs twice
    assert lines(spark.read.parquet(f"{tmp_path}/o")) == ["[EMAIL-1] [EMAIL-0]", "[EMAIL-2] [EMAIL-1]"]


def test_csv_in_and_out(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("﻿id,text\r\n1,\"a, \"\"b\"\"\"\r\n1,NA\r\n1,\r\n".encode())
    df = S.number_rows(S.read_csv(spark, str(tmp_path / "in.csv")), 2)
    rows = df.orderBy("row_id").collect()
    assert [(r["_c0"], r["_c1"], r["row_id"], r["chunk_id"]) for r in rows] == [
        ("id", "text", 0, 0), ("1", 'a, "b"', 1, 0), ("1", "NA", 2, 1), ("1", "", 3, 1)]
    with pytest.raises(KeyError):
        S.bind(df, "nothing", 1)
    S.write_log(spark.createDataFrame([("PIN-1", "x", 1), ("A-0", "y", 0)], "label string, value string, seq long"), str(tmp_path / "log"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "log")).collect()] == [("A-0", "y"), ("PIN-1", "x")]


def test_phrase_documents(spark, tmp_path):
    (tmp_path / "p.yml").write_text("terms:\n  - names: [a, b]\n  - names: c\n")
    assert [r.phrase for r in P.read_phrase_document(spark, str(tmp_path / "p.yml"), "terms.names").collect()] == ["a", "b", "c"]
    (tmp_path / "p.csv").write_text("U.S.\nPeru\n")
    assert P.rule_phrases({"phrase-filename": str(tmp_path / "p.csv"), "phrase-header": False}, spark) == ["U.S.", "Peru"]


def test_long_phrase_list_goes_through_the_join(spark, tmp_path):
    (tmp_path / "p.csv").write_text("phrase\n" + "\n".join(f"word{i} tail" for i in range(P.INLINE_LIMIT + 5)))
    rules = RuleSet({"level": {"own": ["T"]}, "redaction-order": ["T"], "entities": {"T": {"redactor": {
        "model-class": "phraselist", "text": {"phrase-filename": str(tmp_path / "p.csv"), "phrase-field": "phrase"}}}}})
    out, _ = RedactionJob(rules, level="own").run(frame(spark, ["a Word7 tail, word2004 tail.", "word7 tails"]))
    assert lines(out) == ["a [T-1], [T-0].", "word7 tails"]


def test_rule_tests_report(spark):
    from veilwork.operators.ruleqa import run_rule_tests
    rules = RuleSet({"regex": {"pin": r"(^|\s)(?<pin>\d{4})\s*?"}, "regex-test": {"pin": [
        {"match-type": "ONE_OR_MORE_MATCH", "phrases": ["1234", "the pin number is 1234."]},
        {"match-type": "NO_MATCHES", "phrases": ["abc1234de", "1 2 3 4"]}]}}, defaults=False)
    got = {(r.test_text, r.match, r.ix, r.left, r.matched_text, r.right, r["pass"]) for r in run_rule_tests(spark, rules).collect()}
    assert got == {("1234", "exact", 1, "", "1234", "", True), ("the pin number is 1234.", "partial", 1, "the pin number is", " 1234", ".", True),
                   ("abc1234de", "none", 0, "", "", "", True), ("1 2 3 4", "none", 0, "", "", "", True)}


def test_shipped_rule_tests_pass(spark):
    from veilwork.operators.ruleqa import run_rule_tests
    rows = run_rule_tests(spark, RuleSet()).collect()
    assert {r.regex_id for r in rows} == {"pin-text", "pin-voice"} and all(r["pass"] for r in rows)
    assert {(r.test_text, r.left, r.matched_text, r.right) for r in rows if r.regex_id == "pin-text" and r.ix} == {
        ("1234", "", "1234", ""), ("the pin number is 1234.", "the pin number is", " 1234", ".")}


def test_named_patterns_in_user_documents(spark):
    rules = RuleSet({"level": {"own": ["CODE"]}, "redaction-order": ["CODE"], "entities": {"CODE": {"redactor": {
        "model-class": "regex", "text": {"regex": r"code ?INCLUDE<oh_to_nine-voice>\b"}}}}})
    out, _ = RedactionJob(rules, level="own").run(frame(spark, ["the code seven here", "code red"]))
    assert lines(out) == ["the [CODE-0] here", "code red"]
