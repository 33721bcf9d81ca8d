"""F and N queries: surrogates for labels written into texts derived from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import QUERIES, SQL, conversations, lit, query, table
from veilwork.catalog.text import CLEAN
from veilwork.functions.draws import spell
from veilwork.functions.text import DIGIT_WORDS, TEENS, TENS
from veilwork.operators.anonymize import anonymize, restore
from veilwork.rules import surrogate_lists as L
from veilwork.rules.ruleset import RuleSet
from veilwork.rules.shipped import MONTHS, ORDINALS_TO_TEN

SEED = "7"
ONES = DIGIT_WORDS[1:]
TO_19 = ONES + TEENS


def labelled(spark, sf_dir, label: str):
    """One text per order with one label; five indexes per conversation."""
    text = F.concat(F.lit(f"x [{label}-"), (F.col("o_orderkey") % 5).cast("string"), F.lit("] y"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("conversation_id"), text.alias("text"))


class Gen:
    """SQL side: draws over ``key`` in slot order."""

    def __init__(self):
        self.slot = -1

    def d(self, n: int) -> str:
        self.slot += 1
        return f"(CAST('0x' || substr(md5(key || '|{self.slot}'), 1, 8) AS BIGINT) % {n})"

    def pick(self, words) -> str:
        words = list(words)
        return f"[{', '.join(lit(w) for w in words)}][1 + {self.d(len(words))}]"

    def digits(self, n: int) -> str:
        return " || ".join(self.pick("0123456789") for _ in range(n))

    def maybe(self, fn) -> str:
        count = self.d(2)
        return f"CASE WHEN {count} > 0 THEN {fn()} ELSE '' END"

    def alternatives(self, *fns) -> str:
        which = self.d(len(fns))
        return f"CASE {which} " + " ".join(f"WHEN {i} THEN {fn()}" for i, fn in enumerate(fns)) + " END"

    def to_99(self) -> str:
        return self.alternatives(lambda: self.pick(TO_19), lambda: f"{self.pick(TENS)} || ' ' || {self.pick(ONES)}")

    def number(self, low: int, high: int) -> str:
        return f"CAST({low} + {self.d(high - low)} AS VARCHAR)"


def in_words(sql: str) -> str:
    for i, w in enumerate(DIGIT_WORDS):
        sql = f"replace({sql}, '{i}', ' {w}')"
    return sql


def spoken_digits(g: Gen, n: int, words=DIGIT_WORDS) -> str:
    return " || ".join(f"' ' || {g.pick(words)}" for _ in range(n))


def cents(g):
    return g.maybe(lambda: f"{g.pick(TENS + [''])} || ' ' || {g.pick(ONES)} || ' cents'")


def more_digits(g, most: int) -> str:
    count = g.d(most + 1)
    return " || ".join(f"CASE WHEN {count} > {i} THEN {g.pick('0123456789')} ELSE '' END" for i in range(most))


HOURS = ONES + TEENS[:3]
OH = ["zero", "oh"] + ONES
NUM_MONTHS = [f"{m:02d}" for m in range(1, 13)]
DAYS = ORDINALS_TO_TEN + [
    "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth",
    "eighteenth", "nineteenth", "twentieth"] + [f"twenty {o}" for o in ORDINALS_TO_TEN[:8]]


def money_text(g):
    return f"'$' || {g.pick('123456789')} || {more_digits(g, 2)} || {g.maybe(lambda: chr(39) + '.' + chr(39) + ' || ' + g.digits(2))}"


def phone(g):
    return [g.number(200, 999), g.number(200, 999), g.number(1000, 9999)]


def ssn(g):
    return [g.number(200, 999), g.number(10, 99), g.number(1000, 9999)]


SURROGATES = {
    ("MONEY", "text"): money_text,
    ("MONEY", "voice"): lambda g: g.alternatives(
        lambda: f"{g.pick(TENS)} || ' ' || {g.pick(ONES + [''])} || ' dollars ' || {cents(g)}",
        lambda: f"{g.pick(TEENS + [''])} || ' dollars ' || {cents(g)}"),
    ("DATE", "text"): lambda g: f"{g.pick(NUM_MONTHS)} || '/' || {g.pick('012')} || {g.pick('0123456789')} || '/202' || {g.pick('0123456')}",
    ("DATE", "voice"): lambda g: f"{g.pick(MONTHS)} || ' ' || {g.pick(DAYS)}",
    ("TIME", "text"): lambda g: f"{g.pick(NUM_MONTHS)} || ':' || {g.pick('012345')} || {g.pick('0123456789')} || ' ' || {g.pick(['AM', 'PM'])}",
    ("TIME", "voice"): lambda g: g.alternatives(
        lambda: f"{g.pick(HOURS)} || ' ' || {g.pick(['oh', 'twenty', 'thirty', 'forty', 'fifty'])} || ' ' || {g.pick(ONES)} || ' ' || {g.pick(['AM', 'PM'])}",
        lambda: f"{g.pick(HOURS)} || ' ' || {g.pick(['', 'ten', 'twenty', 'thirty', 'forty', 'fifty'])} || ' ' || {g.pick(['AM', 'PM'])}",
        lambda: f"{g.pick(HOURS)} || ' ' || {g.pick(TEENS[1:])} || ' ' || {g.pick(['AM', 'PM'])}"),
    ("PERCENT", "text"): lambda g: f"{g.pick('123456789')} || {more_digits(g, 1)} || '%'",
    ("PERCENT", "voice"): lambda g: f"{g.to_99()} || ' percent'",
    ("QUANTITY", "text"): lambda g: f"{g.pick('123456789')} || {more_digits(g, 1)} || {more_digits(g, 1)} || {more_digits(g, 1)}",
    ("QUANTITY", "voice"): lambda g: f"{g.maybe(lambda: '(' + g.to_99() + ') || ' + lit(' hundred and '))} || {g.to_99()}",
    ("CCARD", "text"): lambda g: g.alternatives(
        lambda: f"'4' || {g.digits(3)} || '-' || {g.digits(4)} || '-' || {g.digits(4)} || '-' || {g.digits(4)}",
        lambda: f"'3' || {g.pick('47')} || {g.digits(2)} || '-' || {g.digits(6)} || '-' || {g.digits(5)}"),
    ("CCARD", "voice"): lambda g: g.alternatives(lambda: f"'four ' || {spoken_digits(g, 15, OH)}",
                                                 lambda: f"'three ' || {spoken_digits(g, 14, OH)}"),
    ("PIN", "text"): lambda g: g.digits(4),
    ("PIN", "voice"): lambda g: spoken_digits(g, 4),
    ("ORDINAL", "text"): lambda g: g.pick("1st 2nd 3rd 4th 5th 6th 7th 8th 9th 10th".split()),
    ("ORDINAL", "voice"): lambda g: g.pick(ORDINALS_TO_TEN),
    ("CARDINAL", "text"): lambda g: f"' ' || {g.pick('0123456789')} || ' '",
    ("CARDINAL", "voice"): lambda g: f"' ' || {g.pick(DIGIT_WORDS)} || ' '",
    ("EVENT", "text"): lambda g: g.pick(L.EVENT[0].split("|")),
    ("LANGUAGE", "text"): lambda g: g.pick(L.LANGUAGE[0].split("|")),
    ("PRODUCT", "text"): lambda g: g.pick(L.PRODUCT[0].split("|")),
    ("LOC", "text"): lambda g: g.pick(L.CITIES),
    ("GPE", "text"): lambda g: g.pick(L.PLACES),
    ("ORG", "text"): lambda g: g.pick(L.COMPANIES),
    ("NORP", "text"): lambda g: g.pick(L.NATIONALITIES),
    ("PERSON", "text"): lambda g: g.pick(L.FIRST_NAMES),
    ("WORK_OF_ART", "text"): lambda g: g.pick(L.ART_TITLES),
    ("EMAIL", "text"): lambda g: f"{g.pick(L.FIRST_NAMES)} || {g.pick(L.MAIL_DOMAINS)}",
    ("ZIP", "text"): lambda g: g.pick(L.ZIPS),
    ("ZIP", "voice"): lambda g: in_words(g.pick(L.ZIPS)),
    ("ADDRESS", "text"): lambda g: f"{g.number(100, 500)} || ' ' || {g.pick(L.STREETS)} || ' '",
    ("ADDRESS", "voice"): lambda g: f"{g.pick([spell(n) for n in range(100, 500)])} || ' ' || {g.pick(L.STREETS)} || ' '",
    ("PHONE", "text"): lambda g: " || '-' || ".join(phone(g)),
    ("PHONE", "voice"): lambda g: in_words("(" + " || ".join(phone(g)) + ")"),
    ("SSN", "text"): lambda g: " || '-' || ".join(ssn(g)),
    ("SSN", "voice"): lambda g: in_words("(" + " || ".join(ssn(g)) + ")"),
    ("FAC", "text"): lambda g: "''",
    ("LAUGHTER", "text"): lambda g: "''",
    ("LAW", "text"): lambda g: "''",
}


def _surrogate_query(entity, modality, body):
    sql = f"""WITH k AS (SELECT o_orderkey AS row_id,
  concat_ws('|', '{SEED}', CAST(o_custkey AS VARCHAR), '{entity}', CAST(o_orderkey % 5 AS VARCHAR)) AS key FROM orders)
SELECT row_id, 'x ' || ({body(Gen())}) || ' y' AS text FROM k"""

    @query(f"n_{entity.lower()}_{modality}", sql)
    def run(spark, sf_dir):
        return anonymize(labelled(spark, sf_dir, entity), RuleSet(), modality, 4, SEED).select("row_id", "text")


for (_entity, _modality), _body in SURROGATES.items():
    _surrogate_query(_entity, _modality, _body)


# ---- labels, aliases and tokens ------------------------------------------------------
RULES = {"anon-map": {"EMAIL": ["EMAIL", "emailAddress"], "PIN": []}, "token-map": {"ZIP": ["<ZIP/>"]}}
MIXED = """SELECT o_orderkey AS row_id, o_custkey AS conversation_id,
 CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN concat('a [EMAIL-', CAST(o_orderkey % 3 AS STRING), '] b')
  WHEN 1 THEN concat('a [emailAddress-', CAST(o_orderkey % 3 AS STRING), '] b')
  WHEN 2 THEN concat('a [PIN-', CAST(o_orderkey % 3 AS STRING), '] b') WHEN 3 THEN 'a <ZIP/> b' ELSE 'a [EMAIL] b' END AS text
FROM orders"""


def mixed(spark, sf_dir):
    return spark.sql(MIXED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def _mixed_sql(persist: bool) -> str:
    key = f"concat_ws('|', '{SEED}', CAST(conversation_id AS VARCHAR), {{0}})"
    fresh = key.format("tag, CAST(row_id AS VARCHAR), '0'")
    same = key.format("regexp_extract(tag, '^\\[?(.*)-(.*?)\\]?$', 1), regexp_extract(tag, '^\\[?(.*)-(.*?)\\]?$', 2)")
    mail, zips = SURROGATES["EMAIL", "text"](Gen()), SURROGATES["ZIP", "text"](Gen())
    return f"""WITH t AS (SELECT *, regexp_extract(text, '^a (.*) b$', 1) AS tag FROM ({MIXED})),
k AS (SELECT *, CASE WHEN {str(persist).lower()} AND tag LIKE '%-%' THEN {same} ELSE {fresh} END AS key FROM t)
SELECT row_id, 'a ' || CASE WHEN tag LIKE '[PIN%' THEN tag WHEN tag = '<ZIP/>' THEN {zips} ELSE {mail} END || ' b' AS text FROM k"""


@query("f1_aliases_tokens_and_suppression", _mixed_sql(True))
def f1(spark, sf_dir):
    """Aliases keep their own name in the key, PIN has no alias left, tokens are fresh."""
    return anonymize(mixed(spark, sf_dir), RuleSet(RULES), "text", 4, SEED).select("row_id", "text")


@query("f3_fresh_value_each_time", _mixed_sql(False))
def f3(spark, sf_dir):
    rules = RuleSet(RULES, {"entities": {"EMAIL": {"anonymizer": {"persist": False}}}})
    return anonymize(mixed(spark, sf_dir), rules, "text", 4, SEED).select("row_id", "text")


@query("f18_consistency", "SELECT count(*) AS keys, CAST(1 AS BIGINT) AS most FROM (SELECT DISTINCT o_custkey, o_orderkey % 5 FROM orders)")
def f18(spark, sf_dir):
    """The same label of a conversation always has the same surrogate."""
    df = labelled(spark, sf_dir, "PHONE").withColumn("label", F.col("text"))
    out = anonymize(df, RuleSet(), "text", 4, SEED)
    return (out.groupBy("conversation_id", "label").agg(F.countDistinct("text").alias("n"))
            .agg(F.count("*").alias("keys"), F.max("n").alias("most")))


@query("f13_restore", """SELECT o_orderkey AS row_id, 'x ' || CASE WHEN o_orderkey % 5 < 3 THEN 'word' || o_custkey || '/' || o_orderkey % 5
 ELSE '[_IGNORE_-' || o_orderkey % 5 || ']' END || ' y' AS text FROM orders""")
def f13(spark, sf_dir):
    """Labels with a log entry come back, the others stay."""
    df = labelled(spark, sf_dir, "_IGNORE_")
    ix = (F.col("o_orderkey") % 5).cast("string")
    log = (table(spark, sf_dir, "orders").where("o_orderkey % 5 < 3")
           .select(F.col("o_custkey").alias("conversation_id"), F.concat(F.lit("_IGNORE_-"), ix).alias("label"),
                   F.concat(F.lit("word"), F.col("o_custkey").cast("string"), F.lit("/"), ix).alias("value")).distinct())
    return restore(df, log).select("row_id", "text")


# ---- long lists ----------------------------------------------------------------------
_LONG = """SELECT l_orderkey || '-' || l_linenumber || '-' || k AS phrase FROM lineitem, (VALUES (1), (2), (3), (4)) v(k)"""
_DRAW = "CAST('0x' || substr(md5(concat_ws('|', '7', CAST(o_custkey AS VARCHAR), 'TOWN', CAST(o_orderkey % 5 AS VARCHAR)) || '|0'), 1, 8) AS BIGINT)"


@query("f6_long_phrase_list", f"""WITH p AS (SELECT phrase, row_number() OVER (ORDER BY phrase) - 1 AS ix, count(*) OVER () AS n FROM ({_LONG})),
o AS (SELECT o_orderkey AS row_id, {_DRAW} % (SELECT max(n) FROM p) AS ix FROM orders)
SELECT row_id, 'x ' || phrase || ' y' AS text FROM o JOIN p USING (ix)""")
def f6_long(spark, sf_dir):
    """Surrogates from a file of four lines per line item (240 000 at sf0.01), which stays a table."""
    from veilwork.catalog.base import shared_folder
    path = shared_folder(spark) + "/towns"
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("k"))
    lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "k").alias("town")).write.csv(path)
    rules = RuleSet({"level": {"own": ["TOWN"]}, "redaction-order": ["TOWN"], "entities": {"TOWN": {"anonymizer": {
        "model-class": "phraselist", "text": {"phrase-filename": path, "phrase-header": False}}}}})
    return anonymize(labelled(spark, sf_dir, "TOWN"), rules, "text", "own", 7).select("row_id", "text")


# ---- whole runs without detection, and without a seed --------------------------------
@query("f15_anonymize_only", f"SELECT row_id, {CLEAN.format(t='text')} AS text FROM ({SQL['n_phone_text']})")
def f15(spark, sf_dir):
    """Labelled input, no detection: surrogates and cleaning only."""
    from veilwork.plans.redaction import RedactionJob
    job = RedactionJob(RuleSet(), "text", 2, redact=False, anonymize=True, seed=7)
    return job.run(labelled(spark, sf_dir, "PHONE"))[0].select("row_id", "text")


@query("f17_without_seed", "SELECT o_custkey AS conversation_id, o_orderkey % 5 AS ix, CAST(1 AS BIGINT) AS n FROM orders GROUP BY ALL")
def f17(spark, sf_dir):
    """Without a seed a run draws its own surrogates, one for each label of a conversation."""
    from veilwork.plans.redaction import keep_once
    out = keep_once(anonymize(labelled(spark, sf_dir, "PHONE"), RuleSet(), "text", 2, None))
    return out.groupBy("conversation_id", (F.col("row_id") % 5).alias("ix")).agg(F.countDistinct("text").alias("n"))
