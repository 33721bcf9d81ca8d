"""A training corpus from raw documents: quality rules, near duplicates, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) with the columns of `documents` and returns them for the documents it keeps; the last
returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.minhash import without_near_duplicates
from veilwork.llm.mixing import mix
from veilwork.llm.packing import pack
from veilwork.llm.quality_rules import quality_rules
from veilwork.llm.queries import tokenizer_file
from veilwork.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return without_near_duplicates(docs, COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes of passages that also start earlier."""
    cut = remove_repeats(docs, carry=COLUMNS)
    return cut.select("carried.doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source",
                      F.length("kept_text").cast("long").alias("n_chars"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; one without words, which no budget holds, stays once."""
    mixed = mix(docs, carry=COLUMNS).withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.col("copies")))
    return mixed.where("copies > 0").select("carried.*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def to_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return pack(docs, tokenizer=tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality rules", keep_good), ("near duplicates", keep_one_of_each), ("repeated passages", cut_repeats),
          ("mixing", to_weights), ("packing", to_sequences)]

#: Near duplicates, repeated passages and packing can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
