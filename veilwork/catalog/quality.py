"""H3..H6 queries: rule tests over whole tables of phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import TRANSCRIPTS, lit, query, table, transcripts
from veilwork.catalog.rules import EMAIL_RE
from veilwork.operators import ruleqa as Q
from veilwork.rules import shipped as S

PATTERNS = [r"\d{4}", r"[a-z]+@[a-z.]+|yes"]


def phrases(spark, sf_dir, rule=None):
    """Phrases, with the column that names their rule."""
    keys = [F.col(rule).alias("regex_id")] if rule else []
    return transcripts(spark, sf_dir).select(*keys, F.col("turn").alias("phrase_ix"), F.col("text").alias("test_text"))


def _pieces(pattern: str, ix: int) -> str:
    return f"""SELECT phrase_ix, test_text, {ix} AS pattern_ix, unnest(string_split(m, chr(1))) AS p,
  generate_subscripts(string_split(m, chr(1)), 1) AS i FROM (SELECT turn AS phrase_ix, text AS test_text,
  regexp_replace(text, {lit('(' + pattern + ')')}, chr(1) || '\\1' || chr(2), 'gi') AS m FROM ({TRANSCRIPTS}))"""


_MATCHED = """,
pos AS (SELECT *, split_part(p, chr(2), 1) AS v, sum(CASE WHEN i = 1 THEN length(p) ELSE length(p) - 1 END)
  OVER (PARTITION BY phrase_ix, pattern_ix ORDER BY i) - (length(p) - 1) AS s, max(i) OVER (PARTITION BY phrase_ix, pattern_ix) AS most FROM pcs),
found AS (SELECT phrase_ix, test_text, pattern_ix, i, v AS matched_text, CAST(substr(test_text, 1, CAST(s AS INT)) AS VARCHAR) AS "left",
  substr(test_text, CAST(s + length(v) + 1 AS INT)) AS "right", CASE WHEN v = test_text THEN 'exact' ELSE 'partial' END AS "match" FROM pos WHERE i > 1),
report AS (SELECT phrase_ix, pattern_ix, CAST(row_number() OVER (PARTITION BY phrase_ix ORDER BY pattern_ix, i) AS INT) AS ix, "match", "left", matched_text, "right" FROM found
  UNION ALL SELECT phrase_ix, pattern_ix, 0, 'none', '', '', '' FROM pos WHERE most = 1),
counts AS (SELECT phrase_ix, count(*) FILTER ("match" = 'exact') AS exact, count(*) FILTER ("match" = 'partial') AS "partial" FROM report GROUP BY phrase_ix)"""
MATCHES = f"pcs AS ({_pieces(PATTERNS[0], 1)} UNION ALL {_pieces(PATTERNS[1], 2)})" + _MATCHED

# One rule of two patterns for each customer; the phrases of a customer are tested by that rule.
RULES = """SELECT c_custkey AS regex_id, concat('user', CAST(c_custkey AS STRING), '@[a-z]+[.]com|yes') AS p1,
 lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') AS p2 FROM customer"""


def _rule_pieces(column: str, ix: int) -> str:
    return f"""SELECT phrase_ix, test_text, {ix} AS pattern_ix, unnest(string_split(m, chr(1))) AS p,
  generate_subscripts(string_split(m, chr(1)), 1) AS i FROM (SELECT turn AS phrase_ix, text AS test_text,
  regexp_replace(text, concat('(', {column}, ')'), chr(1) || '\\1' || chr(2), 'gi') AS m FROM ({TRANSCRIPTS}) JOIN ({RULES}) ON conv_id = regex_id)"""


BY_RULE = f"pcs AS ({_rule_pieces('p1', 1)} UNION ALL {_rule_pieces('p2', 2)})" + _MATCHED


def rule_table(spark, sf_dir):
    two = spark.sql(RULES.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return two.select("regex_id", F.posexplode(F.array("p1", "p2")).alias("at", "pattern")).withColumn("pattern_ix", F.col("at") + 1)


@query("h3_rules_from_table", f"""WITH {BY_RULE} SELECT r.phrase_ix, r.pattern_ix, r.ix, r."match", r."left", r.matched_text, r."right",
 c.exact + c."partial" > 0 AS pass FROM report r JOIN counts c USING (phrase_ix)""")
def h3_rules_from_table(spark, sf_dir):
    """Each phrase against its rule, the rules read from a table."""
    tested = phrases(spark, sf_dir, "conv_id")
    return Q.match_report_by_rule(tested, rule_table(spark, sf_dir)).select(
        "phrase_ix", "pattern_ix", "ix", "match", "left", "matched_text", "right", "pass")


@query("h6_summary_by_rule", f"""WITH {BY_RULE} SELECT t.conv_id AS regex_id, count(*) AS phrases,
 CAST(sum(CASE WHEN exact + "partial" > 0 THEN 0 ELSE 1 END) AS BIGINT) AS failed_phrases,
 max(CASE WHEN exact + "partial" > 0 THEN 0 ELSE 1 END) AS rule_failed FROM counts JOIN ({TRANSCRIPTS}) t ON t.turn = phrase_ix GROUP BY 1""")
def h6_by_rule(spark, sf_dir):
    counters = Q.match_counters_by_rule(phrases(spark, sf_dir, "conv_id"), rule_table(spark, sf_dir), ["regex_id"], ["regex_id", "phrase_ix"])
    return Q.summary(counters, ["regex_id"])


@query("h3_match_report", f'WITH {MATCHES} SELECT phrase_ix, pattern_ix, ix, "match", "left", matched_text, "right" FROM report')
def h3(spark, sf_dir):
    return Q.match_report(phrases(spark, sf_dir), PATTERNS).select(
        "phrase_ix", "pattern_ix", "ix", "match", "left", "matched_text", "right")


@query("h4_match_counters", f'WITH {MATCHES} SELECT phrase_ix, exact, "partial" FROM counts')
def h4(spark, sf_dir):
    return Q.match_counters(phrases(spark, sf_dir), PATTERNS, ["phrase_ix"]).select("phrase_ix", "exact", "partial")


@query("b4_report_file", f"""WITH {MATCHES} SELECT 'own' AS regex_id, 'ONE_OR_MORE_MATCH' AS test_type, CASE WHEN exact + "partial" > 0 THEN 'true' ELSE 'false' END AS pass,
 '0' AS "group", CAST(ix AS VARCHAR) AS ix, "match", "left", matched_text, "right", text AS test_text, CAST(pattern_ix AS VARCHAR) AS pattern_ix
FROM report JOIN counts USING (phrase_ix) JOIN ({TRANSCRIPTS}) ON turn = phrase_ix""")
def b4(spark, sf_dir):
    """The report as a file, read back as text."""
    from veilwork.catalog.base import shared_folder
    from veilwork.sources.tables import read_csv, write_report
    rows = phrases(spark, sf_dir)
    found = Q.match_report(rows, PATTERNS).select("phrase_ix", "pattern_ix", "ix", "match", "left", "matched_text", "right")
    passed = Q.match_counters(rows, PATTERNS, ["phrase_ix"], match_type="ONE_OR_MORE_MATCH").select("phrase_ix", "pass")
    report = found.join(passed, "phrase_ix").join(rows, "phrase_ix").withColumns(
        {"regex_id": F.lit("own"), "test_type": F.lit("ONE_OR_MORE_MATCH"), "group": F.lit(0), "pass": F.col("pass").cast("string")})
    path = shared_folder(spark) + "/report"
    write_report(report, path)
    return read_csv(spark, path, header=True).drop("file_ix", "file_path", "block_start", "in_block")


_PASS = {k: v.format(n=len(PATTERNS)).replace("partial", '"partial"') for k, v in Q.MATCH_TYPES.items()}
for _kind, _test in _PASS.items():
    @query(f"h5_pass_{_kind.lower()}", f'WITH {MATCHES} SELECT phrase_ix, {_test} AS pass FROM counts')
    def h5(spark, sf_dir, kind=_kind):
        return Q.match_counters(phrases(spark, sf_dir), PATTERNS, ["phrase_ix"], match_type=kind).select("phrase_ix", "pass")


@query("h6_summary", f"""WITH {MATCHES} SELECT count(*) AS phrases, CAST(sum(CASE WHEN exact + "partial" > 0 THEN 0 ELSE 1 END) AS BIGINT) AS failed_phrases,
 max(CASE WHEN exact + "partial" > 0 THEN 0 ELSE 1 END) AS rule_failed, 'own' AS regex_id FROM counts""")
def h6(spark, sf_dir):
    counters = Q.match_counters(phrases(spark, sf_dir), PATTERNS, ["phrase_ix"]).withColumn("regex_id", F.lit("own"))
    return Q.summary(counters, ["regex_id"])


@query("h3_email_rule_on_documents", f"""SELECT doc_id AS phrase_ix, count(*) AS n FROM (
 SELECT doc_id, unnest(regexp_extract_all(text, {lit(EMAIL_RE)}, 0, 'i')) FROM documents) GROUP BY doc_id""")
def h3_documents(spark, sf_dir):
    df = table(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("phrase_ix"), F.col("text").alias("test_text"))
    report = Q.match_report(df, [S.EMAIL]).where("ix > 0")
    return report.groupBy("phrase_ix").agg(F.count("*").alias("n"))
