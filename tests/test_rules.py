import re

import pytest

from veilwork.rules import dialect, shipped
from veilwork.rules.ruleset import RuleError, RuleSet, compile_pattern, kind_of


def test_levels_and_order():
    rules = RuleSet()
    assert [len(rules.level(n)) for n in range(5)] == [2, 10, 13, 17, 29]
    assert len(rules.full_order) == 29
    assert rules.redaction_order(1)[0] == "_TOKEN_MAP_"
    assert rules.redaction_order(2, redact=False) == ["_TOKEN_MAP_"]
    assert rules.anonymization_order(2, False) == ["_IGNORE_"]


def test_errors():
    with pytest.raises(RuleError, match="no rules"):
        RuleSet(defaults=False)
    with pytest.raises(RuleError, match="level"):
        RuleSet().level("nine")
    with pytest.raises(RuleError, match="BADGE"):
        RuleSet({"level": {"own": ["BADGE"]}}).redaction_order("own")
    with pytest.raises(RuleError, match="cycle"):
        RuleSet({"regex": {"a": "x?INCLUDE<b>", "b": "y?INCLUDE<a>"}}).pattern_set("a")


def test_merge_last_wins_and_always_redact():
    rules = RuleSet({"always-redact": ["_IGNORE_"], "redaction-order": ["PIN", "SSN"], "level": {"own": ["PIN"]}})
    assert rules.full_order == ["_IGNORE_", "PIN", "SSN"]


def test_include_and_definitions():
    rules = RuleSet({"regex": {"d": "(?<d>one|two)", "p": "(?x)(?(DEFINE)?INCLUDE<d>) a # note\n (?&d) [ ] (?<n>\\d+)"}})
    java, names, flags = dialect.to_java(rules.pattern_set("p")[0])
    assert java == r"a(?:one|two)[ ](\d+)" and names == {"n": 1} and flags == "(?idU)"


def test_recursive_definition_is_dropped_with_a_warning():
    rules = RuleSet({"level": {"own": ["X", "PIN"]}, "entities": {"X": {"redactor": {
        "model-class": "regex", "text": {"regex": "(?(DEFINE)(?<a>(?&a)))(?&a)"}}}}, "redaction-order": ["X", "PIN"]})
    with pytest.warns(UserWarning, match="X"):
        assert [d.rule for d in rules.detectors("text", "own")] == ["PIN"]


def test_word_edges_and_group_lead():
    assert dialect.to_java(r"\mone\M")[0] == r"\b(?=\w)one\b(?<=\w)"
    pattern, group, added = dialect.capture_lead(r"a(b|c(d))e|((x)y(?:z|w(q)))", 5)
    assert added == 2 and group == 7
    m = re.fullmatch(pattern.replace("(?<vw", "(?P<vw"), "xywq")
    assert m.group(group) == "q" and (m["vw0"] or "") + (m["vw1"] or "") == "xyw"


def test_kinds_and_suffixes():
    assert kind_of("somewhere.RedactorPhraseList") == kind_of("phraselist") == "phraselist"
    words = shipped.street_suffixes(["quay"])
    assert "QUAY" in words and words == sorted(words, key=lambda w: (-len(w), w))


def test_modality_without_block_is_skipped():
    rules = RuleSet({"level": {"own": ["X"]}, "redaction-order": ["X"], "entities": {"X": {"redactor": {
        "model-class": "regex", "voice": {"regex": "a"}}}}})
    assert rules.detectors("text", "own") == [] and len(rules.detectors("voice", "own")) == 1


def test_flags():
    assert dialect.flag_letters(["IGNORECASE", "S", "nothing"]) == "is"
    assert compile_pattern(0, "X", "a", "").pattern == "(?dU)a"
