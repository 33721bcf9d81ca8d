"""C9, D and L queries beyond the shipped rules: how detectors work together."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import (DOC_SRC, TRANSCRIPTS, TURN_SRC, documents, hits_ctes, lit, mark, query, redact,
                                   redact_sql, shared_folder, table, transcripts)
from veilwork.catalog.rules import EMAIL_RE
from veilwork.catalog.text import CLEAN, ZONES
from veilwork.operators import numbering as N
from veilwork.operators.detect import detect
from veilwork.operators.phrases import phrase_spans
from veilwork.operators.registry import register_detector, register_surrogate
from veilwork.plans.redaction import RedactionJob
from veilwork.rules.ruleset import RuleSet, compile_pattern


def custom(name: str, redactor: dict, **more) -> list:
    """The detectors of a rule set with one rule of its own."""
    rules = RuleSet({"level": {"own": [name]}, "redaction-order": [name],
                     "entities": {name: {"redactor": redactor}}, **more})
    return rules.detectors("text", "own")


def _own(name, label, redactor, marked, src=TURN_SRC, frame=transcripts):
    @query(name, redact_sql(src, marked, label))
    def run(spark, sf_dir):
        return redact(frame(spark, sf_dir), custom(label, redactor))


WORDS = ["thanks", "time", "call", "card is", "or"]
_own("d1_regex_detector", "WORD", {"model-class": "regex", "text": {"regex": "[a-z]+ly"}}, mark("([a-z]+ly)"), DOC_SRC, documents)
_own("d2_group_only", "NUM", {"model-class": "regex", "text": {"regex": r"(pin|ssn|call) (is )?(?<num>\d+)", "group": "num"}},
     mark(r"((?:pin|ssn|call) (?:is )?)(\d+)", before="\\1"))
_own("d4_combined_alternation", "WORD", {"model-class": "regex", "text": {"regex": ["th", "the", "time|thanks"]}},
     mark("(th|the|time|thanks)"))
_own("d5_phrase_list", "PHRASE", {"model-class": "phraselist", "text": {"phrase-list": WORDS}},
     mark(rf"(\b(?:{'|'.join(WORDS)})\b)"))
_own("d7_match_guards", "GUARDED", {"model-class": "phraselist", "text": {
    "phrase-list": ["pin", "card"], "prematch": {"regex": ["the ", "My "]}, "postmatch": {"regex": [" is"]}}},
     mark("((?:the |My )(?:pin|card)(?: is))"))
_own("l5_phrases_in_documents", "PHRASE", {"model-class": "phraselist", "text": {"phrase-list": ["the hand", "in the", "tion"], "add-wordbreak": False}},
     mark("(the hand|in the|tion)"), DOC_SRC, documents)


@query("d3_patterns_in_sequence", f"""WITH src AS ({TURN_SRC}),
a AS (SELECT row_id, conv, regexp_replace(text, '(555)', chr(1) || '\\1' || chr(2), 'g') AS t FROM src),
m AS (SELECT row_id, conv, regexp_replace(t, '(call|today)', chr(1) || '\\1' || chr(2), 'g') AS m FROM a),
pcs AS (SELECT row_id, conv, unnest(string_split(m, chr(1))) AS p, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM m),
h AS (SELECT row_id, split_part(p, chr(2), 1) AS value, i FROM pcs WHERE i > 1)
SELECT row_id, value, row_number() OVER (PARTITION BY row_id ORDER BY CASE WHEN value = '555' THEN 0 ELSE 1 END, i DESC) - 1 AS k FROM h""")
def d3(spark, sf_dir):
    """The second pattern sees the labels of the first; numbers run pattern by pattern."""
    steps = custom("STEP", {"model-class": "regex", "text": {"regex": ["555", "call|today"], "single-regex": False}})
    h = N.explode_hits(detect(transcripts(spark, sf_dir), steps))
    return h.select("row_id", "value", F.col("k").cast("bigint").alias("k"))


@query("d6_phrase_dictionary", redact_sql(TURN_SRC, mark(r"(\b(?:thanks|time|card is)\b)"), "TERM"))
def d6(spark, sf_dir):
    """Phrases from ``terms.names`` of a JSON document."""
    path = shared_folder(spark) + "/phrases.json"
    (spark.createDataFrame([('{"terms": [{"names": ["thanks", "time"]}, {"names": ["card is"]}]}',)], "value string")
     .write.text(path))
    rules = RuleSet({"level": {"own": ["TERM"]}, "redaction-order": ["TERM"], "entities": {"TERM": {"redactor": {
        "model-class": "phrasedict", "text": {"phrase-filename": path, "phrase-path": "terms.names"}}}}})
    return redact(transcripts(spark, sf_dir), rules.detectors("text", "own", spark=spark))


# ---- large phrase lists: n-gram join -------------------------------------------------
def _phrase_join_sql(lengths) -> str:
    """Words with the gaps behind them, n-grams with single blanks, and a fold that takes the leftmost ones."""
    words = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"
    tokens = lambda t, i: (
        f"(SELECT id, unnest(string_split(m, chr(1))) AS p, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM "
        f"(SELECT {i} AS id, regexp_replace(lower(text), '({words})', chr(1) || '\\1' || chr(2), 'g') AS m FROM {t}))")
    table_of = lambda t, i: (
        f"SELECT id, i, split_part(p, chr(2), 1) AS w1, split_part(p, chr(2), 2) AS g1, lead(split_part(p, chr(2), 1)) OVER o AS w2, "
        f"lead(split_part(p, chr(2), 2)) OVER o AS g2, lead(split_part(p, chr(2), 1), 2) OVER o AS w3 FROM {tokens(t, i)} "
        f"WHERE i > 1 WINDOW o AS (PARTITION BY id ORDER BY i)")
    gram = {1: ("w1", "true"), 2: ("w1 || ' ' || w2", "g1 = ' ' AND w2 IS NOT NULL"),
            3: ("w1 || ' ' || w2 || ' ' || w3", "g1 = ' ' AND g2 = ' ' AND w3 IS NOT NULL")}
    grams = lambda t: " UNION ALL ".join(f"SELECT id, i, {n} AS n, {gram[n][0]} AS phrase FROM {t} WHERE {gram[n][1]}" for n in lengths)
    return f"""WITH b AS ({table_of('benchmark', 'item_id')}), ph AS (SELECT DISTINCT phrase FROM ({grams('b')})),
d AS ({table_of('documents', 'doc_id')}), best AS (SELECT id, i, max(n) AS n FROM ({grams('d')}) JOIN ph USING (phrase) GROUP BY id, i),
l AS (SELECT id, list(struct_pack(s := i, e := i + n, c := CAST(1 AS BIGINT)) ORDER BY i) AS c FROM best GROUP BY id)
SELECT id AS row_id, list_reduce(c, lambda a, x: CASE WHEN x.s >= a.e THEN struct_pack(s := x.s, e := x.e, c := a.c + 1) ELSE a END).c AS n FROM l"""


def word_phrases(texts, shortest: int = 1, longest: int = 3):
    """All phrases of ``shortest`` to ``longest`` words with single spaces between them, in lower case, each once."""
    grams = [F.regexp_extract_all("text", F.lit(rf"(?U)(?<!\w)(?=(\w+(?: \w+){{{n - 1}}})(?!\w))"), F.lit(1))
             for n in range(shortest, longest + 1)]
    return texts.select(F.explode(F.concat(*grams)).alias("phrase")).select(F.lower("phrase").alias("phrase")).distinct()


@query("d5_phrase_table_join", _phrase_join_sql([2]))
def d5_join(spark, sf_dir):
    """All word pairs of whole benchmark texts in whole documents."""
    phrases = word_phrases(table(spark, sf_dir, "benchmark"), 2, 2)
    return phrase_spans(documents(spark, sf_dir), phrases).groupBy("row_id").agg(F.count("*").alias("n"))


@query("d5_phrase_table_join_whole", _phrase_join_sql([1, 2, 3]))
def d5_join_whole(spark, sf_dir):
    """All phrases of one to three words of whole benchmark texts; of those that start at one word the longest counts."""
    phrases = word_phrases(table(spark, sf_dir, "benchmark"))
    return phrase_spans(documents(spark, sf_dir), phrases).groupBy("row_id").agg(F.count("*").alias("n"))


# ---- tokens, ignore, overlap ---------------------------------------------------------
TOKENS = {"ZIP": ["<ZIP/>"], "PIN": ["<PIN/>", "<CVV/>"]}


@query("d10_token_map", f"""SELECT turn AS row_id, 'ZIP' AS label, '<ZIP/>' AS value, CAST(0 AS BIGINT) AS k FROM ({TRANSCRIPTS}) WHERE text LIKE '%<ZIP/>%'
UNION ALL SELECT turn, 'PIN', '<PIN/>', 1 FROM ({TRANSCRIPTS}) WHERE text LIKE '%<PIN/>%'""")
def d10(spark, sf_dir):
    steps = RuleSet({"token-map": TOKENS}).detectors("text", 0)
    h = N.explode_hits(detect(transcripts(spark, sf_dir), [d for d in steps if d.rule == "_TOKEN_MAP_"]))
    return h.select("row_id", "label", "value", F.col("k").cast("bigint").alias("k"))


GATE_MAP = {"SPEAKER": ["okay", "thanks"], "ZIP": ["<ZIP/>"], "NEVER": ["<NEVER/>"], "PIN": ["<PIN/>", "<CVV/>"], "UNKNOWN": ["<UNK>"]}
_GATE_MARKS = "text"
for _label, _found in GATE_MAP.items():
    _GATE_MARKS = f"regexp_replace({_GATE_MARKS}, '({'|'.join(_found)})', chr(1) || '{_label}' || chr(3) || '\\1' || chr(2), 'g')"


@query("c9_gate_before_mapping", f"""WITH src AS ({TURN_SRC}), m AS (SELECT row_id, {_GATE_MARKS} AS m FROM src),
pcs AS (SELECT row_id, unnest(string_split(m, chr(1))) AS p, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM m),
h AS (SELECT row_id, i, split_part(p, chr(3), 1) AS label, split_part(split_part(p, chr(2), 1), chr(3), 2) AS value FROM pcs WHERE i > 1)
SELECT row_id, label, value, row_number() OVER (PARTITION BY row_id ORDER BY list_position({list(GATE_MAP)}, label), i DESC) - 1 AS k FROM h""")
def c9(spark, sf_dir):
    """The whole token map in one pass; the branch that matched names the label."""
    steps = [d for d in RuleSet({"token-map": GATE_MAP}).detectors("text", 0) if d.rule == "_TOKEN_MAP_"]
    h = N.explode_hits(detect(transcripts(spark, sf_dir), steps))
    return h.select("row_id", "label", "value", F.col("k").cast("bigint").alias("k"))


@query("c9_gate_of_patterns", f"""WITH src AS ({TURN_SRC}),
m AS (SELECT row_id, regexp_replace(regexp_replace(text, '(<[A-Z]+/>)', chr(1) || 'TAG' || chr(3) || '\\1' || chr(2), 'g'),
  '(today|the [a-z]+)', chr(1) || 'WORD' || chr(3) || '\\1' || chr(2), 'g') AS m FROM src),
pcs AS (SELECT row_id, unnest(string_split(m, chr(1))) AS p, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM m),
h AS (SELECT row_id, i, split_part(p, chr(3), 1) AS label, split_part(split_part(p, chr(2), 1), chr(3), 2) AS value FROM pcs WHERE i > 1)
SELECT row_id, label, value, row_number() OVER (PARTITION BY row_id ORDER BY label, i DESC) - 1 AS k FROM h""")
def c9_patterns(spark, sf_dir):
    """Tokens that are patterns could overlap: one look at the row opens the passes of all labels."""
    steps = [d for d in RuleSet({"token-map": {"TAG": ["<[A-Z]+/>"], "WORD": ["today", "the [a-z]+"]}}).detectors("text", 0) if d.rule == "_TOKEN_MAP_"]
    h = N.explode_hits(detect(transcripts(spark, sf_dir), steps))
    return h.select("row_id", "label", "value", F.col("k").cast("bigint").alias("k"))


@query("d21_ignore_and_restore", f"SELECT turn AS row_id, {CLEAN.format(t='text')} AS text FROM ({TRANSCRIPTS})")
def d21(spark, sf_dir):
    """Only protected phrases are found, and they all come back."""
    return RedactionJob(level=0).run(transcripts(spark, sf_dir).select("row_id", "conversation_id", "text"))[0].select("row_id", "text")


def _overlap_query(name, source, frame, pattern=r"\w+"):
    @query(name, f"""WITH src AS ({source}), {ZONES},
w AS (SELECT row_id, unnest(string_split(m, chr(1))) AS p, generate_subscripts(string_split(m, chr(1)), 1) AS i
      FROM (SELECT row_id, regexp_replace(text, '([A-Za-z0-9_]+ ?\\[?)', chr(1) || '\\1' || chr(2), 'g') AS m FROM src)),
pos AS (SELECT row_id, i, split_part(p, chr(2), 1) AS value,
        sum(CASE WHEN i = 1 THEN length(p) ELSE length(p) - 1 END) OVER (PARTITION BY row_id ORDER BY i) - (length(p) - 1) AS s FROM w),
ok AS (SELECT * FROM pos h WHERE i > 1 AND NOT EXISTS (SELECT 1 FROM label_zones z WHERE z.row_id = h.row_id AND (
   (h.s >= z.zone_start AND h.s < z.zone_start + z.n) OR
   (h.s + length(h.value) - 1 >= z.zone_start AND h.s + length(h.value) - 1 < z.zone_start + z.n))))
SELECT row_id, value, row_number() OVER (PARTITION BY row_id ORDER BY i DESC) - 1 AS k FROM ok""")
    def run(spark, sf_dir):
        # A word may take a following bracket along: such a hit ends inside a label.
        steps = [compile_pattern(0, "WORD", r"[A-Za-z0-9_]+ ?\[?", "")]
        h = N.explode_hits(detect(frame(spark, sf_dir), steps))
        return h.select("row_id", "value", F.col("k").cast("bigint").alias("k"))


_overlap_query("d17_overlap_exclusion", f"SELECT turn AS row_id, text FROM ({TRANSCRIPTS})", transcripts)
_overlap_query("l4_overlap_in_documents", "SELECT doc_id AS row_id, text FROM documents", documents)


# ---- model spans ---------------------------------------------------------------------
SPAN_TEXT = f"SELECT turn AS row_id, conv_id AS conv, '$' || text AS text FROM ({TRANSCRIPTS})"
SPAN_MARK = ("CASE CAST(row_id % 8 AS INT) WHEN 4 THEN '$' || chr(1) || 'the' || chr(2) || ' ' || chr(1) || 'pin' || chr(2) || substr(text, 9) "
             "WHEN 0 THEN '$My ' || chr(1) || 'card' || chr(2) || substr(text, 9) ELSE text END")


def span_table(spark, sf_dir):
    """Spans as a model would give them: two words, one word, and a label outside the level."""
    kind = F.col("row_id") % 8
    df = transcripts(spark, sf_dir).where(kind.isin(4, 0, 3))
    return df.select("row_id", F.when(kind == 0, 4).otherwise(1).cast("int").alias("start"),
                     F.when(kind == 3, 4).otherwise(8).cast("int").alias("end"),
                     F.when(kind == 3, "WEATHER").otherwise("PERSON").alias("label"))


def model_steps():
    return [d for d in RuleSet().detectors("text", 2) if d.kind == "spans"]


@query("d12_model_spans", f"SELECT row_id, replace(text, '$', '') AS text FROM ({redact_sql(SPAN_TEXT, SPAN_MARK, 'PERSON')})")
def d12(spark, sf_dir):
    """D12..D14, L7, L8: supplied spans, level filter, one label per word, no dollar signs left."""
    from veilwork.plans.redaction import keep_once
    df = transcripts(spark, sf_dir).select("row_id", "conversation_id", F.concat(F.lit("$"), "text").alias("text"))
    found = keep_once(detect(df, model_steps(), span_source=span_table(spark, sf_dir)))
    indexed, _ = N.conversation_index(N.explode_hits(found))
    return N.render(found, indexed, []).select("row_id", "text")


@query("d13_multi_word_split", f"""SELECT turn AS row_id, 'pin' AS value, CAST(0 AS BIGINT) AS k FROM ({TRANSCRIPTS}) WHERE turn % 8 = 4
UNION ALL SELECT turn, 'the', 1 FROM ({TRANSCRIPTS}) WHERE turn % 8 = 4
UNION ALL SELECT turn, 'card', 0 FROM ({TRANSCRIPTS}) WHERE turn % 8 = 0""")
def d13(spark, sf_dir):
    df = transcripts(spark, sf_dir).withColumn("text", F.concat(F.lit("$"), "text"))
    h = N.explode_hits(detect(df, model_steps(), span_source=span_table(spark, sf_dir)))
    return h.select("row_id", "value", F.col("k").cast("bigint").alias("k"))


# ---- the whole run -------------------------------------------------------------------
_TURN_MARKS = """CASE CAST(turn % 8 AS INT)
 WHEN 0 THEN regexp_replace(text, '((?:\\d[ -]*?){13,16})', chr(1) || 'CCARD' || chr(3) || '\\1' || chr(2), 'g')
 WHEN 1 THEN regexp_replace(text, '(@MAIL@)', chr(1) || 'EMAIL' || chr(3) || '\\1' || chr(2), 'gi')
 WHEN 2 THEN regexp_replace(regexp_replace(text, '(555-\\d+-\\d+)', chr(1) || 'PHONE' || chr(3) || '\\1' || chr(2), 'g'),
             '(today)', chr(1) || '_IGNORE_' || chr(3) || '\\1' || chr(2), 'g')
 WHEN 3 THEN regexp_replace(text, '(234-23-\\d{4})', chr(1) || 'SSN' || chr(3) || '\\1' || chr(2), 'g')
 WHEN 4 THEN replace(regexp_replace(text, '(\\d{4})', chr(1) || 'PIN' || chr(3) || '\\1' || chr(2), 'g'),
             'pin', chr(1) || '_IGNORE_' || chr(3) || 'pin' || chr(2))
 WHEN 5 THEN replace(replace(text, '<ZIP/>', chr(1) || 'ZIP' || chr(3) || '<ZIP/>' || chr(2)), '<PIN/>', chr(1) || 'PIN' || chr(3) || '<PIN/>' || chr(2))
 WHEN 6 THEN regexp_replace(text, '(one moment)', chr(1) || '_IGNORE_' || chr(3) || '\\1' || chr(2), 'g')
 ELSE text END""".replace("@MAIL@", EMAIL_RE)
RUN = f"""src AS (SELECT turn, turn AS row_id, conv_id AS conv, text FROM ({TRANSCRIPTS})),
m AS (SELECT row_id, conv, {_TURN_MARKS} AS m FROM src),
pcs AS (SELECT row_id, conv, unnest(string_split(m, chr(1))) AS p, generate_subscripts(string_split(m, chr(1)), 1) AS i FROM m),
h0 AS (SELECT row_id, conv, i, split_part(p, chr(3), 1) AS label, split_part(split_part(p, chr(2), 1), chr(3), 2) AS value,
       split_part(p, chr(2), 2) AS tail FROM pcs WHERE i > 1),
h1 AS (SELECT *, CASE WHEN row_id % 8 = 5 THEN 0 WHEN label = '_IGNORE_' THEN 1 WHEN label = 'CCARD' THEN 3 WHEN label = 'PHONE' THEN 4
       WHEN label = 'SSN' THEN 5 WHEN label = 'EMAIL' THEN 7 ELSE 9 END AS rule_ix, CASE WHEN row_id % 8 = 5 THEN i ELSE -i END AS o FROM h0),
h AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY rule_ix, o) - 1 AS k,
      row_number() OVER (ORDER BY rule_ix, row_id, o) - 1 AS seq FROM h1)"""


def _run_sql(index_ctes: str, ix: str) -> str:
    return f"""WITH {RUN}{index_ctes},
shown AS (SELECT row_id, string_agg(CASE WHEN label = '_IGNORE_' THEN value ELSE '[' || label || '-' || {ix} || ']' END || tail, '' ORDER BY i) AS body
          FROM labelled GROUP BY row_id)
SELECT p.row_id, {CLEAN.format(t="(p.p || coalesce(s.body, ''))")} AS text FROM pcs p LEFT JOIN shown s ON s.row_id = p.row_id WHERE p.i = 1"""


@query("d18_run_global_numbers", _run_sql(
    ", labelled AS (SELECT *, min(seq) OVER (PARTITION BY conv, label, value) AS ix FROM h)", "ix"))
def d18_global(spark, sf_dir):
    job = RedactionJob(RuleSet({"token-map": TOKENS}), "text", 2, numbering="global")
    return job.run(transcripts(spark, sf_dir).select("row_id", "conversation_id", "text"))[0].select("row_id", "text")


@query("d18_run_conversation_numbers", _run_sql(""",
f AS (SELECT conv, label, value, min(row_id) AS r0 FROM h GROUP BY ALL),
g AS (SELECT f.*, min(h.k) AS k0 FROM f JOIN h ON h.conv = f.conv AND h.label = f.label AND h.value = f.value AND h.row_id = f.r0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY r0, k0) - 1 AS ix FROM g),
labelled AS (SELECT h.*, r.ix FROM h JOIN r USING (conv, label, value))""", "ix"))
def d18_conversation(spark, sf_dir):
    job = RedactionJob(RuleSet({"token-map": TOKENS}), "text", 2)
    return job.run(transcripts(spark, sf_dir).select("row_id", "conversation_id", "text"))[0].select("row_id", "text")


@query("d18_documents_level_4")
def d18_documents(spark, sf_dir):
    """Every shipped rule over the documents; the chain has no SQL form."""
    return RedactionJob(RuleSet({"token-map": TOKENS}), "text", 4).run(documents(spark, sf_dir))[0].select("row_id", "text")


@query("f14_redact_and_anonymize")
def f14(spark, sf_dir):
    """Level 2 with seeded surrogates and restored phrases over the transcripts."""
    job = RedactionJob(RuleSet({"token-map": TOKENS}), "text", 2, anonymize=True, seed=7)
    return job.run(transcripts(spark, sf_dir).select("row_id", "conversation_id", "text"))[0].select("row_id", "text")


# ---- user surfaces -------------------------------------------------------------------
@query("nu1_custom_detector", redact_sql(TURN_SRC, mark(r"(\bpin\b)", "g"), "SECRET"))
def nu1(spark, sf_dir):
    """A detector given as a function of the text: here the word after a fixed phrase."""
    def find(text, params):
        at = F.instr(text, params["word"])
        return F.when(at > 0, F.array(F.struct((at - 1).alias("start"), (at - 1 + len(params["word"])).alias("end")))
                      ).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    register_detector("wordfinder", find)
    return redact(transcripts(spark, sf_dir), custom("SECRET", {"model-class": "wordfinder", "text": {"word": "pin"}}))


@query("nu2_custom_surrogate", f"""WITH k AS (SELECT o_orderkey AS row_id, concat_ws('|', '7', CAST(o_custkey AS VARCHAR), 'BADGE', CAST(o_orderkey % 5 AS VARCHAR)) AS key FROM orders)
SELECT row_id, 'x B' || CAST(CAST('0x' || substr(md5(key || '|0'), 1, 8) AS BIGINT) % 1000 AS VARCHAR) || ' y' AS text FROM k""")
def nu2(spark, sf_dir):
    from veilwork.catalog.surrogates import labelled
    from veilwork.operators.anonymize import anonymize
    register_surrogate("badge", lambda draws, params: f"concat('{params['prefix']}', {draws.between(0, 1000)})")
    rules = RuleSet({"level": {"own": ["BADGE"]}, "redaction-order": ["BADGE"],
                     "entities": {"BADGE": {"anonymizer": {"model-class": "badge", "prefix": "B"}}}})
    return anonymize(labelled(spark, sf_dir, "BADGE"), rules, "text", "own", 7).select("row_id", "text")
