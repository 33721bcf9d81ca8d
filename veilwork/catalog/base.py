"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}

O, C, M = "chr(1)", "chr(2)", "chr(3)"      # marks used in the SQL


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table; with fewer files than cores its rows are spread by ``key`` first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if key and len(df.inputFiles()) < cores:
        df = df.repartition(cores, key)
    return df


def shared_folder(spark: SparkSession) -> str:
    """A new folder for files a query writes and reads back; without a checkpoint folder, in the warehouse."""
    from veilwork.plans.redaction import checkpoint_folder
    return checkpoint_folder(spark) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/veilwork-{uuid.uuid4().hex}"


TRANSCRIPTS = """SELECT o_custkey AS conv_id, o_orderkey AS turn,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Agent' ELSE 'Client' END AS speaker,
 CASE CAST(o_orderkey % 8 AS INT)
  WHEN 0 THEN concat('My card is 4012 0000 ', lpad(CAST(o_custkey % 10000 AS STRING),4,'0'), ' 5439 ok...')
  WHEN 1 THEN concat('mail user', CAST(o_custkey AS STRING), '@example.com or alt', CAST(o_orderkey % 3 AS STRING), '@example.org')
  WHEN 2 THEN concat('call 555-', lpad(CAST(o_orderkey % 1000 AS STRING),3,'0'), '-', lpad(CAST(o_custkey % 10000 AS STRING),4,'0'), ' today')
  WHEN 3 THEN concat('ssn 234-23-', lpad(CAST(1 + o_custkey % 9998 AS STRING),4,'0'), '.')
  WHEN 4 THEN concat('the pin is ', lpad(CAST(o_orderkey % 10000 AS STRING),4,'0'), '   <UNK> thanks')
  WHEN 5 THEN concat('zip <ZIP/> or <PIN/> and [PERSON-', CAST(o_orderkey % 4 AS STRING), '][emailAddress-', CAST(o_orderkey % 2 AS STRING), ']')
  WHEN 6 THEN concat('one moment, the ', CAST(1 + o_orderkey % 9 AS STRING), 'th time')
  ELSE 'yes' END AS text
FROM orders"""


def _digit(expr: str) -> str:
    words = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    return f"CASE CAST({expr} % 10 AS INT) " + " ".join(
        f"WHEN {i} THEN '{w}'" for i, w in enumerate(words[:9])) + " ELSE 'nine' END"


def _digits(n: int, zero: str = "oh") -> str:
    parts = [_digit(f"CAST(FLOOR((o_orderkey * 7 + o_custkey) / {3 ** i}) AS BIGINT)") for i in range(n)]
    spoken = ", ' ', ".join(parts)
    return f"replace(concat({spoken}), 'zero', '{zero}')"


# Spelled-out numbers, built from the orders like the transcripts.
SPOKEN = f"""SELECT o_custkey AS conv_id, o_orderkey AS turn,
 CASE CAST(o_orderkey % 8 AS INT)
  WHEN 0 THEN concat('card four ', {_digits(15, 'zero')}, ' thanks')
  WHEN 1 THEN concat('amex three seven ', {_digits(13)}, ' or five two ', {_digits(14)})
  WHEN 2 THEN concat('call ', {_digits(3)}, ', ', {_digits(3)}, ' ', {_digits(4)}, ' please')
  WHEN 3 THEN concat('social ', {_digits(9)}, '.')
  WHEN 4 THEN concat('pin ', {_digits(4)}, ' and zip ', {_digits(5)})
  WHEN 5 THEN concat('the ', {_digits(1)}, 'th or twenty first of ', {_digits(1)}, ' hundred and ', {_digits(1)})
  WHEN 6 THEN concat({_digits(1)}, ' thousand ', {_digits(1)}, ' hundred dollars and seventy-', {_digits(1)}, ' cents')
  ELSE concat({_digits(2)}, ' percent of ', {_digits(1)}, ' million ninety five') END AS text
FROM orders"""


def _spoken_on_spark() -> str:
    """``SPOKEN`` for Spark: the digits once a row, as an array.  A CASE for each digit makes more code than a method can hold."""
    words = "array('zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine')"
    number = "CAST(CAST(FLOOR((o_orderkey * 7 + o_custkey) / p) AS BIGINT) % 10 AS INT)"
    digits = f"transform(array({', '.join(str(3 ** i) for i in range(15))}), p -> coalesce(get({words}, {number}), 'nine'))"
    sql = SPOKEN.replace("FROM orders", f"FROM (SELECT o_custkey, o_orderkey, {digits} AS digits FROM orders)")
    for n in range(15, 0, -1):
        for zero in ("oh", "zero"):
            sql = sql.replace(_digits(n, zero), f"replace(array_join(slice(digits, 1, {n}), ' '), 'zero', '{zero}')")
    return sql


SPOKEN_ON_SPARK = _spoken_on_spark()


def transcripts(spark, sf_dir, sql: str = TRANSCRIPTS) -> DataFrame:
    """The derived transcripts with ``row_id`` and ``conversation_id``."""
    df = spark.sql(sql.replace("FROM orders", "FROM {orders}"),
                   orders=table(spark, sf_dir, "orders", "o_orderkey"))
    return df.withColumns({"row_id": F.col("turn"), "conversation_id": F.col("conv_id")})


def documents(spark, sf_dir) -> DataFrame:
    df = table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    return df.select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("conversation_id"), "text")


def conversations(spark, sf_dir) -> DataFrame:
    """Turns as rows: the row id keeps conversation and turn order (turns stay below 2^20)."""
    df = table(spark, sf_dir, "conversations", "conv_id")
    return df.select((F.col("conv_id") * F.lit(1 << 20) + F.col("turn")).alias("row_id"),
                     F.col("conv_id").alias("conversation_id"), "role", "text")


DOC_SRC = "SELECT doc_id AS row_id, doc_id AS conv, text FROM documents"
TURN_SRC = f"SELECT turn AS row_id, conv_id AS conv, text FROM ({TRANSCRIPTS})"
SPOKEN_SRC = f"SELECT turn AS row_id, conv_id AS conv, text FROM ({SPOKEN})"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mark(pattern: str, flags: str = "gi", before: str = "", after: str = "", text: str = "text") -> str:
    """SQL: the text with every match wrapped in marks; before/after are group references."""
    inner = "\\2" if before else "\\1"
    return (f"regexp_replace({text}, {lit(pattern)}, {lit(before)} || {O} || {lit(inner)} || {C} || "
            f"{lit(after)}, '{flags}')")


def hits_ctes(src: str, marked: str, label: str, rule: int = 0) -> str:
    """CTEs ``pcs`` and ``hits(row_id, conv, i, k, label, value, tail)`` from a marked text."""
    return f"""
src AS ({src}),
m AS (SELECT row_id, conv, {marked} AS m FROM src),
pcs AS (SELECT row_id, conv, unnest(string_split(m, {O})) AS p,
               generate_subscripts(string_split(m, {O}), 1) AS i FROM m),
hits AS (SELECT row_id, conv, i, max(i) OVER (PARTITION BY row_id) - i AS k, '{label}' AS label, {rule} AS rule_ix,
                split_part(p, {C}, 1) AS value, split_part(p, {C}, 2) AS tail FROM pcs WHERE i > 1)"""


INDEX_CTES = """
firsts AS (SELECT conv, label, value, min(row_id) AS r0 FROM hits GROUP BY ALL),
ranked AS (SELECT f.conv, f.label, f.value, row_number() OVER (PARTITION BY f.conv ORDER BY f.r0, min(h.k)) - 1 AS ix
           FROM firsts f JOIN hits h ON h.conv = f.conv AND h.label = f.label AND h.value = f.value AND h.row_id = f.r0
           GROUP BY f.conv, f.label, f.value, f.r0)"""


def redact_sql(src: str, marked: str, label: str) -> str:
    """The whole single-rule redaction with a dense index per conversation."""
    return f"""WITH {hits_ctes(src, marked, label)},{INDEX_CTES},
shown AS (SELECT h.row_id, string_agg('[' || h.label || '-' || r.ix || ']' || h.tail, '' ORDER BY h.i) AS body
          FROM hits h JOIN ranked r ON h.conv = r.conv AND h.label = r.label AND h.value = r.value GROUP BY h.row_id)
SELECT p.row_id, p.p || coalesce(s.body, '') AS text
FROM pcs p LEFT JOIN shown s ON s.row_id = p.row_id WHERE p.i = 1"""


def redact(df: DataFrame, detectors) -> DataFrame:
    """Spark side of ``redact_sql``."""
    from veilwork.operators import numbering as N
    from veilwork.operators.detect import detect
    from veilwork.plans.redaction import keep_once
    found = keep_once(detect(df.select("row_id", "conversation_id", "text"), detectors))
    indexed, _ = N.conversation_index(N.explode_hits(found))
    return N.render(found, indexed, []).select("row_id", "text")
