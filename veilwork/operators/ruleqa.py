"""Rule quality: patterns against a table of labelled phrases (H3..H6).

`match_report` takes a few patterns known when the plan is made; `match_report_by_rule` takes rules as a table, so the plan
stays the same for thousands of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from veilwork.functions import marks as M
from veilwork.rules import dialect

MATCH_TYPES = {
    "ONE_OR_MORE_MATCH": "exact + partial > 0",
    "ONE_OR_MORE_EXACT_MATCH": "exact > 0",
    "ONE_OR_MORE_PARTIAL_MATCH": "partial > 0",
    "ALL_EXACT_MATCH": "exact = {n}",
    "ALL_PARTIAL_MATCH": "partial = {n}",
    "NO_MATCHES": "exact + partial = 0",
    "NO_EXACT_MATCHES": "exact = 0",
    "NO_PARTIAL_MATCHES": "partial = 0",
}


@F.pandas_udf(StructType().add("java", StringType()).add("marks", StringType()))
def _compiled(pattern: pd.Series, flags: pd.Series, group: pd.Series) -> pd.DataFrame:
    """The Java pattern of each rule, and the replacement that marks its matches as `_matches` does."""
    out = []
    for p, f, g in zip(pattern, flags, group):
        java, names, prefix = dialect.to_java(p, f)
        number, lead = 0, ""
        if g != "0":
            java, number, wrapped = dialect.capture_lead(java, int(g) if g.isdigit() else names[g])
            lead = "".join(f"${{vw{i}}}" for i in range(wrapped))
        out.append((prefix + java, f"{M.OPEN}$0{M.MID}{lead}{M.MID}${number}{M.CLOSE}"))
    return pd.DataFrame(out, columns=["java", "marks"])


def _matches(text: str, pattern: str, flags: str, group) -> Column:
    """``array<struct<start,end,ok>>`` of all matches; ``ok`` is false where the group took no part."""
    java, names, prefix = dialect.to_java(pattern, flags)
    if group in (0, "0"):
        raw = F.regexp_replace(F.col(text), F.lit(prefix + java), F.lit(f"{M.OPEN}$0{M.MID}{M.MID}$0{M.CLOSE}"))
    else:
        number = names[group] if isinstance(group, str) else group
        java, number, lead = dialect.capture_lead(java, number)
        raw = M.mark_group_raw(F.col(text), prefix + java, number, lead)
    return raw


def _spans(raw: str) -> str:
    whole = f"substring_index(p, '{M.MID}', 1)"
    lead = f"substring_index(substring_index({M.head('p')}, '{M.MID}', 2), '{M.MID}', -1)"
    value = M.hit_value("p", True)
    sizes = f"transform({M.pieces('q')}, p -> length({whole}) + length({M.tail('p')}))"
    span = (f"named_struct('start', z + at + length({lead}), 'end', z + at + length({lead}) + length({value}), "
            f"'ok', {value} != '')")
    each = f"zip_with({M.pieces('q')}, {M.running(sizes)}, (p, at) -> {span})"
    return f"transform(array(split({raw}, '{M.OPEN}')), q -> transform(array(length(q[0])), z -> {each})[0])[0]"


def _judged(phrases: DataFrame, patterns: list[str], text: str, match_type: str, group, flags: str) -> DataFrame:
    """The phrases with all their matches in ``__flat``, the counts ``exact`` and ``partial``, and ``pass``.

    Patterns are few and known when the plan is made, so they become expressions of each
    phrase row: no join.
    """
    df = phrases.withColumn("test_type", F.lit(match_type)).withColumn("group", F.lit(str(group)))
    for i, p in enumerate(patterns):
        df = df.withColumn(f"__raw{i}", _matches(text, p, flags, group))
    rows = ", ".join(f"struct({i + 1} AS pattern_ix, {_spans(f'__raw{i}')} AS m)" for i in range(len(patterns)))
    df = df.withColumn("__all", F.expr(f"array({rows})")).drop(*[f"__raw{i}" for i in range(len(patterns))])
    return _verdicts(df, text, MATCH_TYPES[match_type.upper()].format(n=len(patterns)))


def _verdicts(df: DataFrame, text: str, passed: str) -> DataFrame:
    """``__flat, exact, partial, pass`` from ``__all``, the spans of each pattern."""
    none = "named_struct('pattern_ix', x.pattern_ix, 'match', 'none', 'start', 0, 'end', 0)"
    some = (f"named_struct('pattern_ix', x.pattern_ix, 'match', CASE WHEN NOT s.ok THEN 'group-not-matched' "
            f"WHEN s.start = 0 AND s.end = length({text}) THEN 'exact' ELSE 'partial' END, "
            f"'start', IF(s.ok, s.start, 0), 'end', IF(s.ok, s.end, 0))")
    df = df.withColumn("__flat", F.expr(
        f"flatten(transform(__all, x -> IF(size(x.m) = 0, array({none}), transform(x.m, s -> {some}))))")).drop("__all")
    # Numbers run over the matches of all patterns of the phrase.
    counted = M.running("transform(__flat, x -> IF(x.match IN ('exact', 'partial'), 1, 0))")
    df = df.withColumn("__flat", F.expr(
        f"zip_with(__flat, {counted}, (x, n) -> named_struct('pattern_ix', x.pattern_ix, "
        "'ix', IF(x.match IN ('exact', 'partial'), n + 1, 0), 'match', x.match, 'start', x.start, 'end', x.end))"))
    return (df.withColumn("exact", F.expr("size(filter(__flat, x -> x.match = 'exact'))"))
              .withColumn("partial", F.expr("size(filter(__flat, x -> x.match = 'partial'))"))
              .withColumn("pass", F.expr(passed)))


def match_report(phrases: DataFrame, patterns: list[str], text: str = "test_text",
                 match_type: str = "ONE_OR_MORE_MATCH", group=0, flags: str = "i") -> DataFrame:
    """H3: one row per match (one with ix 0 where a pattern has none).

    Adds ``pattern_ix, ix, match, left, matched_text, right, pass``.
    """
    return _listed(_judged(phrases, patterns, text, match_type, group, flags), text)


def _listed(judged: DataFrame, text: str) -> DataFrame:
    # The outer form keeps the optimiser from pushing an inferred size filter below the matching.
    out = judged.select("*", F.expr("inline_outer(__flat)")).drop("__flat").where("pattern_ix IS NOT NULL")
    seen = F.col("ix") > 0
    return (out.withColumn("left", F.when(seen, F.expr(f"substr({text}, 1, start)")).otherwise(""))
               .withColumn("matched_text", F.when(seen, F.expr(f"substr({text}, start + 1, end - start)")).otherwise(""))
               .withColumn("right", F.when(seen, F.expr(f"substr({text}, end + 1)")).otherwise(""))
               .drop("start", "end"))


def _judged_by_rule(phrases: DataFrame, rules: DataFrame, keys: tuple[str, ...], text: str) -> DataFrame:
    given = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in rules.columns else F.lit(default)
    sets = rules.where("pattern IS NOT NULL").select(
        *keys, F.col("pattern_ix").cast("int").alias("pattern_ix"), given("group", "0").alias("group"),
        F.upper(given("match_type", "ONE_OR_MORE_MATCH")).alias("test_type"),
        _compiled("pattern", given("flags", "i"), given("group", "0")).alias("c"))
    sets = sets.groupBy(*keys).agg(  # the patterns of one rule are few
        F.min_by("test_type", "pattern_ix").alias("test_type"), F.min_by("group", "pattern_ix").alias("group"),
        F.sort_array(F.collect_list(F.struct("pattern_ix", "c.java", "c.marks"))).alias("__set"))
    df = phrases.join(sets, list(keys))
    df = df.withColumn("__set", F.transform("__set", lambda s: F.struct(
        s["pattern_ix"].alias("pattern_ix"), F.regexp_replace(F.col(text), s["java"], s["marks"]).alias("raw"))))
    df = df.withColumn("__all", F.expr(f"transform(__set, s -> struct(s.pattern_ix AS pattern_ix, {_spans('s.raw')} AS m))"))
    passed = " ".join(f"WHEN '{k}' THEN {v.format(n='size(__set)')}" for k, v in MATCH_TYPES.items())
    return _verdicts(df, text, f"CASE test_type {passed} END").drop("__set", "__all")


def match_report_by_rule(phrases: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("regex_id",), text: str = "test_text") -> DataFrame:
    """H3/L6 with the rules in a table: the columns of `match_report`, each phrase against the patterns of its own rule.

    ``rules`` has ``keys``, ``pattern_ix``, ``pattern`` and, where they differ from the defaults, ``flags`` (letters),
    ``group`` (number or name) and ``match_type``; group and type of a rule are those of its first pattern.  Rules meet
    phrases in one equi-join on ``keys``, and a phrase's row meets the patterns of its rule only.  Phrases without a rule, or with
    a null key, have no rows; null patterns are no rule; a match type that isn't known gives a null ``pass``.
    """
    return _listed(_judged_by_rule(phrases, rules, keys, text), text)


def match_counters_by_rule(phrases: DataFrame, rules: DataFrame, keys: tuple[str, ...], columns: list[str],
                           text: str = "test_text") -> DataFrame:
    """H4/H5 with the rules in a table: ``columns`` and exact, partial, pass, a row for each phrase that has a rule."""
    return _judged_by_rule(phrases, rules, keys, text).select(
        *columns, F.col("exact").cast("bigint"), F.col("partial").cast("bigint"), "pass")


def match_counters(phrases: DataFrame, patterns: list[str], keys: list[str], text: str = "test_text",
                   match_type: str = "ONE_OR_MORE_MATCH", group=0, flags: str = "i") -> DataFrame:
    """H4/H5: exact and partial counts and the verdict, a row for each phrase; nothing is shuffled."""
    return _judged(phrases, patterns, text, match_type, group, flags).select(
        *keys, F.col("exact").cast("bigint"), F.col("partial").cast("bigint"), "pass")


def summary(counters: DataFrame, rule_keys: list[str]) -> DataFrame:
    """H6: failed phrases and whether the rule failed."""
    return counters.groupBy(*rule_keys).agg(
        F.count("*").alias("phrases"),
        F.sum((~F.col("pass")).cast("bigint")).alias("failed_phrases"),
        F.max((~F.col("pass")).cast("int")).alias("rule_failed"))


def run_rule_tests(spark, rules) -> DataFrame:
    """Every entry of the rule document's ``regex-test`` section as one report; the plan is the same for any number."""
    phrases, sets = [], []
    for regex_id, tests in rules.doc.get("regex-test", {}).items():
        for t, test in enumerate(tests):
            phrases += [(regex_id, t, i, p) for i, p in enumerate(test["phrases"])]
            flags, kind = dialect.flag_letters(test.get("flags", ["IGNORECASE"])), test.get("match-type", "ONE_OR_MORE_MATCH").upper()
            sets += [(regex_id, t, i + 1, p, flags, str(test.get("group", 0)), kind) for i, p in enumerate(rules.pattern_set(regex_id))]
    return match_report_by_rule(
        spark.createDataFrame(phrases, "regex_id string, test_ix int, phrase_ix int, test_text string"),
        spark.createDataFrame(sets, "regex_id string, test_ix int, pattern_ix int, pattern string, flags string, group string, "
                                    "match_type string"), ("regex_id", "test_ix"))
