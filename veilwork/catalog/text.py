"""A4, C and G queries: scalar text work on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import TRANSCRIPTS, conversations, documents, query, table, transcripts
from veilwork.functions import marks as M
from veilwork.functions import text as T

TURNS = f"(SELECT turn AS row_id, text FROM ({TRANSCRIPTS}))"
DOCS = "(SELECT doc_id AS row_id, text FROM documents)"


def _scalar(name, expr_sql, fn, src=TURNS, frame=transcripts):
    @query(name, f"SELECT row_id, {expr_sql} AS text FROM {src}")
    def run(spark, sf_dir):
        return frame(spark, sf_dir).select("row_id", fn(F.col("text")).alias("text"))


def _doc(name, expr_sql, fn):
    _scalar(name, expr_sql, fn, DOCS, documents)


_scalar("g1_drop_ellipsis", r"regexp_replace(text, '\.\.\.', '', 'g')", T.drop_ellipsis)
_doc("g2_squeeze_whitespace", r"regexp_replace(text, '\s+', ' ', 'g')", T.squeeze_whitespace)
_scalar("g3_drop_unknown", "replace(text, '<UNK>', '')", T.drop_unknown)
_scalar("g4_split_adjacent_labels", r"regexp_replace(text, '\]\[', '] [', 'g')", T.split_adjacent_labels)
_scalar("g5_space_before_label", r"regexp_replace(replace(text, ' [', '['), '(\w)\[', '\1 [', 'g')",
        lambda t: T.space_before_label(F.replace(t, F.lit(" ["), F.lit("["))))
_scalar("g6_space_after_label", r"regexp_replace(text || ']x', '\](\w)', '] \1', 'g')",
        lambda t: T.space_after_label(F.concat(t, F.lit("]x"))))
_doc("g7_strip", r"regexp_replace(' ' || text || chr(10), '^\s+|\s+$', '', 'g')",
     lambda t: T.strip(F.concat(F.lit(" "), t, F.lit("\n"))))
CLEAN = (r"trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(replace({t}, '...', ''), '\s+', ' ', 'g'), "
         r"'<UNK>', ''), '][', '] ['), '(\w)\[', '\1 [', 'g'), '\](\w)', '] \1', 'g'))")


@query("g7_clean_chain", f"SELECT row_id, {CLEAN.format(t='text')} AS text FROM {TURNS}")
def clean_turns(spark, sf_dir):
    return T.clean_text(transcripts(spark, sf_dir), "text").select("row_id", "text")


@query("g7_clean_documents", f"SELECT row_id, {CLEAN.format(t='text')} AS text FROM {DOCS}")
def clean_docs(spark, sf_dir):
    return T.clean_text(documents(spark, sf_dir), "text").select("row_id", "text")


_DIGITS = "lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')"
_words_sql = _DIGITS
for _d, _w in enumerate(T.DIGIT_WORDS):
    _words_sql = f"replace({_words_sql}, '{_d}', ' {_w}')"


@query("g8_digits_to_words", f"SELECT o_orderkey, {_words_sql} AS words FROM orders")
def g8(spark, sf_dir):
    digits = F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.digits_to_words(digits).alias("words"))


_N = "CAST(o_orderkey % 1000 AS BIGINT)"
_ones = "[" + ", ".join(f"'{w}'" for w in T.DIGIT_WORDS + T.TEENS) + "]"
_tens = "[" + ", ".join(f"'{w}'" for w in T.TENS) + "]"


@query("g9_number_to_words", f"""WITH n AS (SELECT o_orderkey, {_N} AS n FROM orders),
w AS (SELECT o_orderkey, n, CASE WHEN n % 100 < 20 THEN {_ones}[n % 100 + 1]
        ELSE {_tens}[n % 100 // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || {_ones}[n % 10 + 1] ELSE '' END END AS low FROM n)
SELECT o_orderkey, CASE WHEN n < 100 THEN low WHEN n % 100 = 0 THEN {_ones}[n // 100 + 1] || ' hundred'
  ELSE {_ones}[n // 100 + 1] || ' hundred and ' || low END AS words FROM w""")
def g9(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.number_to_words(F.col("o_orderkey") % 1000).alias("words"))


# The SQL engine has no full case mapping: sharp s needs a hand there.
_doc("g10_uppercase", "upper(replace(text, 'ß', 'SS'))", T.upper)


@query("g11_sub_until_stable", r"""WITH t AS (SELECT c_custkey, repeat('(', CAST(c_custkey % 51 AS INT)) || c_name || repeat(')', CAST(c_custkey % 51 AS INT)) AS text FROM customer)
SELECT c_custkey, regexp_replace(text, '[()]', '', 'g') AS text, CAST(c_custkey % 51 AS INT) AS text_rounds FROM t""")
def g11(spark, sf_dir):
    n = (F.col("c_custkey") % 51).cast("int")
    df = table(spark, sf_dir, "customer").select("c_custkey", F.concat(
        F.repeat(F.lit("("), n), F.col("c_name"), F.repeat(F.lit(")"), n)).alias("text"))
    return T.sub_until_stable(df, "text", r"^\((.*)\)$", "$1")


@query("g12_search_and_substitute", r"""SELECT o_orderkey, regexp_matches(o_orderpriority, 'urgent|high', 'i') AS hit,
 regexp_replace(o_orderpriority, '[aeiou]', '*', 'gi') AS text FROM orders""")
def g12(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.search("o_orderpriority", "urgent|high", "i").alias("hit"),
        T.sub("o_orderpriority", "[aeiou]", "*", "i").alias("text"))


_TAG = "CASE WHEN o_orderkey % 3 = 0 THEN '[A-B-' || o_orderkey || ']' WHEN o_orderkey % 3 = 1 THEN 'PIN-' || o_custkey ELSE '<PIN/>' END"


@query("g13_parse_label", rf"""SELECT o_orderkey, regexp_extract({_TAG}, '^\[?(.*)-(.*?)\]?$', 1) AS category,
 regexp_extract({_TAG}, '^\[?(.*)-(.*?)\]?$', 2) AS ix FROM orders""")
def g13(spark, sf_dir):
    tag = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat('[A-B-', o_orderkey, ']') "
                 "WHEN o_orderkey % 3 = 1 THEN concat('PIN-', o_custkey) ELSE '<PIN/>' END")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.label_category(tag).alias("category"), T.label_index(tag).alias("ix"))


@query("g14_format_label", "SELECT o_orderkey, 'PIN-' || o_custkey AS name, '[PIN-' || o_custkey || ']' AS label FROM orders")
def g14(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.format_label(F.lit("PIN"), "o_custkey", False).alias("name"),
        T.format_label(F.lit("PIN"), "o_custkey").alias("label"))


@query("a4_blank_fill", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), '') AS text FROM orders")
def a4(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.blank_fill(F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))).alias("text"))


@query("c1_replace_one_column", f"""SELECT conv_id, turn, speaker, replace(text, 'yes', 'no') AS text FROM ({TRANSCRIPTS})""")
def c1(spark, sf_dir):
    df = transcripts(spark, sf_dir).withColumn("text", F.replace("text", F.lit("yes"), F.lit("no")))
    return df.select("conv_id", "turn", "speaker", "text")


@query("c10_label_shape", r"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '[laughter]' WHEN o_orderkey % 4 = 1 THEN '[PIN-' || o_custkey || ']'
 WHEN o_orderkey % 4 = 2 THEN '[PIN ' || o_custkey || ']' ELSE o_orderpriority END AS text FROM orders)
SELECT o_orderkey, regexp_matches(text, '^\[\w+(-\d+)?\]$') AS is_label FROM t""")
def c10(spark, sf_dir):
    text = F.expr("CASE WHEN o_orderkey % 4 = 0 THEN '[laughter]' WHEN o_orderkey % 4 = 1 THEN concat('[PIN-', o_custkey, ']') "
                  "WHEN o_orderkey % 4 = 2 THEN concat('[PIN ', o_custkey, ']') ELSE o_orderpriority END")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.is_label(text).alias("is_label"))


ZONES = r"""z AS (SELECT row_id, unnest(string_split(m, chr(1))) AS p, generate_subscripts(string_split(m, chr(1)), 1) AS i
  FROM (SELECT row_id, regexp_replace(text, '(\[\w+(?:-\d+)?\])', chr(1) || '\1' || chr(2), 'g') AS m FROM src)),
zones AS (SELECT row_id, i, length(split_part(p, chr(2), 1)) AS n, CASE WHEN i = 1 THEN length(p) ELSE length(p) - 1 END AS total FROM z),
label_zones AS (SELECT * FROM (SELECT row_id, i, CAST(sum(total) OVER (PARTITION BY row_id ORDER BY i) - total AS INT) AS zone_start, n FROM zones) WHERE i > 1)"""


def _zone_query(name, source, frame):
    @query(name, f"""WITH src AS (SELECT row_id, text FROM {source}), {ZONES}
SELECT row_id, zone_start, CAST(zone_start + n AS INT) AS zone_end FROM label_zones""")
    def run(spark, sf_dir):
        return (frame(spark, sf_dir).where(F.contains("text", F.lit("[")))
                .select("row_id", F.expr(f"inline_outer({M.label_zones('text')})")).where("start IS NOT NULL")
                .withColumnsRenamed({"start": "zone_start", "end": "zone_end"}))


_zone_query("d16_label_zones", TURNS, transcripts)
_zone_query("d16_label_zones_documents", DOCS, documents)
