"""Rows and values that must not get lost: null keys and texts, repeated log labels, nested hits."""

from __future__ import annotations

import pytest

from veilwork import RedactionJob, RuleSet
from veilwork.operators.anonymize import restore

NESTED = {"redaction-order": ["CODE", "NOTE"], "entities": {
    "CODE": {"redactor": {"model-class": "regex", "text": {"regex": r"\d{4}"}}},
    "NOTE": {"redactor": {"model-class": "regex", "text": {"regex": r"note .*? end"}}}}}
COLUMNS = "row_id long, conversation_id string, text string"


@pytest.fixture
def rules():
    return RuleSet({**NESTED, "level": {"own": ["CODE", "NOTE"]}})


@pytest.mark.parametrize("numbering", ["conversation", "global"])
def test_null_conversations_and_texts_stay(spark, rules, numbering):
    rows = [(1, None, "pin 1111 1111 2222"), (2, "a", "pin 1111"), (3, None, None), (4, None, "2222"), (5, "a", "none")]
    table, log = RedactionJob(rules, level="own", numbering=numbering).run(spark.createDataFrame(rows, COLUMNS))
    got = {r.row_id: r.text for r in table.collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[5] == "none"
    assert got[1].split()[1] == got[1].split()[2] != got[1].split()[3] == got[4]
    assert log.count() == 3


def test_enclosing_hits_are_logged_with_final_labels(spark, rules):
    rows = [(1, "a", "note 1111 x end"), (2, "a", "note 2222 x end"), (3, "a", "note 1111 x end, 2222"),
            (4, "b", "note 2222 3333 end 4444")]
    table, log = RedactionJob(rules, level="own").run(spark.createDataFrame(rows, COLUMNS))
    got = {r.row_id: r.text for r in table.collect()}
    logged = {(r.conversation_id, r.label): r.value for r in log.collect()}
    assert got[1] != got[2] and got[3].split(",")[0] == got[1]
    assert not any(ord(c) >= 0xFDD0 and ord(c) <= 0xFDEF for v in logged.values() for c in v)
    back = restore(table, log, ["NOTE"])
    back = {r.row_id: r.text for r in restore(back, log, ["CODE"]).collect()}
    assert back == {i: t for i, _, t in rows}


def test_restore_keeps_null_texts_and_takes_the_first_of_repeated_labels(spark):
    rows = spark.createDataFrame([(1, None, "[CODE-0][CODE-1] x [CODE-0]"), (2, "a", None), (3, "a", "[CODE-0] [CODE-9]")], COLUMNS)
    log = spark.createDataFrame([(None, "CODE-0", "11", 0), (None, "CODE-1", "22", 1), (None, "CODE-0", "99", 5), ("a", "CODE-0", "33", 0)],
                                "conversation_id string, label string, value string, seq long")
    assert {r.row_id: r.text for r in restore(rows, log, "CODE").collect()} == {1: "1122 x 11", 2: None, 3: "33 [CODE-9]"}
