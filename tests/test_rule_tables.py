"""Rules in a table give what the same rules give as literals."""

import pytest

from veilwork.operators import ruleqa as Q

RULES = {"pin": ([r"pin (\d{4})", r"code[ ](?P<v>\d{4})"], "1", "i", "ALL_PARTIAL_MATCH"),
         "word": ([r"[a-z]+"], "0", "", "ONE_OR_MORE_EXACT_MATCH"),
         "late": ([r"(a|b(c))(\d)?x"], "3", "i", "NO_EXACT_MATCHES"),
         "name": ([r"to (?P<who>\w+)"], "who", "i", "ONE_OR_MORE_MATCH"),
         "two": ([r"x+", r"X{2}"], "0", "i", "NO_MATCHES")}
PHRASES = ["pin 1234", "PIN 1234 or code 5678", "abc", "", None, "ABC", "ax b3x bc4x", "go to Rome, to Oslo", "xX", "a$1\\x", "😀 pin 1234 😀"]
COLUMNS = ["phrase_ix", "group", "test_type", "pattern_ix", "ix", "match", "left", "matched_text", "right", "exact", "partial", "pass"]


@pytest.fixture(scope="module")
def tables(spark):
    phrases = [(k, i, p) for k in RULES for i, p in enumerate(PHRASES)] + [("unknown", 0, "pin 1234"), (None, 1, "pin 1234")]
    rules = [(k, j + 1, p, f, g, m) for k, (ps, g, f, m) in RULES.items() for j, p in enumerate(ps)] + [("unknown", 1, None, None, None, None)]
    return (spark.createDataFrame(phrases, "regex_id string, phrase_ix int, test_text string").repartition(3),
            spark.createDataFrame(rules, "regex_id string, pattern_ix int, pattern string, flags string, `group` string, match_type string"))


def rows(df):
    return sorted(map(repr, df.collect()))


def test_table_equals_literals(spark, tables):
    phrases, rules = tables
    got = Q.match_report_by_rule(phrases, rules)
    assert got.where("regex_id IS NULL OR regex_id = 'unknown'").count() == 0
    for k, (patterns, group, flags, kind) in RULES.items():
        one = phrases.where(f"regex_id = '{k}'")
        want = Q.match_report(one, patterns, match_type=kind, group=int(group) if group.isdigit() else group, flags=flags)
        assert rows(got.where(f"regex_id = '{k}'").select(COLUMNS)) == rows(want.select(COLUMNS))
        assert want.count() > 0
        counted = Q.match_counters(one, patterns, ["phrase_ix"], match_type=kind, group=int(group) if group.isdigit() else group, flags=flags)
        by_rule = Q.match_counters_by_rule(one, rules, ["regex_id"], ["phrase_ix"])
        assert rows(by_rule) == rows(counted)


def test_defaults_and_empty_tables(spark, tables):
    phrases, rules = tables
    plain = rules.where("regex_id = 'word'").select("regex_id", "pattern_ix", "pattern")
    got = Q.match_report_by_rule(phrases.where("regex_id = 'word'"), plain)
    assert rows(got.select(COLUMNS)) == rows(Q.match_report(phrases.where("regex_id = 'word'"), RULES["word"][0]).select(COLUMNS))
    assert Q.match_report_by_rule(phrases, rules.limit(0)).count() == 0
    assert Q.match_report_by_rule(phrases.limit(0), rules).count() == 0


def test_the_plan_does_not_grow_with_the_rules(spark, tables):
    phrases, _ = tables
    def plan(n):
        rules = spark.range(n).selectExpr("concat('r', id) AS regex_id", "1 AS pattern_ix", "concat('a', id) AS pattern")
        return len(Q.match_report_by_rule(phrases, rules)._jdf.queryExecution().optimizedPlan().toString())
    assert abs(plan(5) - plan(5000)) < 50
