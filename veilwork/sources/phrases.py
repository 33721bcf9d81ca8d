"""Phrase lists: inline, from a CSV column, or from a path inside a JSON/YAML document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE_LIMIT = 2_000      # above this a list of plain words may be matched by an n-gram join
#: What the join matches exactly as the pattern would: words with single spaces between them.
PLAIN = r"(?U)^\w+(?: \w+)*$"


def read_phrase_csv(spark, path: str, field: str | None = None, column: int = 0,
                    header: bool = True) -> DataFrame:
    """One CSV column as ``phrase``.  ``header=False`` keeps line 1 as a phrase."""
    df = spark.read.option("header", header).option("escape", '"').csv(path)
    name = field if field is not None else df.columns[column]
    if name not in df.columns:
        raise ValueError(f"no column {name!r} in {path}")
    return df.select(F.col(f"`{name}`").cast("string").alias("phrase")).where("phrase IS NOT NULL")


def read_phrase_document(spark, path: str, phrase_path: str) -> DataFrame:
    """``field`` or ``array.field`` of a JSON or YAML document; the leaf is a text or a list."""
    *outer, field = phrase_path.split(".")
    if path.endswith((".yml", ".yaml")):
        import yaml
        # A rule author's document: Spark reads it whole, the parsed leaf becomes a frame.
        doc = yaml.safe_load(spark.read.text(path, wholetext=True).first().value)
        leaves = [item.get(field) for item in (doc.get(outer[0]) if outer else [doc])]
        flat = [p for leaf in leaves for p in ([leaf] if isinstance(leaf, str) else leaf or [])]
        return spark.createDataFrame([(str(p),) for p in flat], "phrase string")
    df = spark.read.option("multiLine", True).json(path)
    if outer:
        df = df.select(F.explode(outer[0]).alias("__item")).select(f"__item.{field}")
    leaf = F.col(field)
    if df.schema[field].dataType.typeName() == "array":
        df = df.select(F.explode(leaf).alias(field))
    return df.select(F.col(field).cast("string").alias("phrase")).where("phrase IS NOT NULL")


def rule_phrases(params: dict, spark=None, whole: bool = False):
    """The phrases of a rule block: a list, or a frame where a join gives the same spans.

    ``whole`` asks for the phrases as they are: a list up to ``INLINE_LIMIT``, else the frame.
    A long list with guards, other flags, or phrases that are patterns stays a list, and so a pattern.
    """
    if params.get("phrase-list") is not None:
        return list(params["phrase-list"])
    path = params["phrase-filename"]
    if params.get("phrase-path"):
        df = read_phrase_document(spark, path, params["phrase-path"])
    else:
        df = read_phrase_csv(spark, path, params.get("phrase-field"), params.get("phrase-column", 0),
                             params.get("phrase-header", True) is not False)
    few = df.limit(INLINE_LIMIT + 1).collect()
    if len(few) <= INLINE_LIMIT:
        return [r.phrase for r in few]
    if whole:
        return df
    if joinable(params) and df.where(~F.rlike("phrase", F.lit(PLAIN))).isEmpty():
        return df.withColumn("phrase_ix", F.monotonically_increasing_id())      # the order of the file
    return [r.phrase for r in df.collect()]


def joinable(params: dict) -> bool:
    """Whether the join gives a rule's spans: word breaks, no guards, case-blind, one alternation."""
    return (params.get("add-wordbreak", True) and not params.get("prematch") and not params.get("postmatch")
            and [f.upper() for f in params.get("flags", ["IGNORECASE"])] == ["IGNORECASE"]
            and params.get("combine-sets", True))
