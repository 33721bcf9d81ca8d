"""Helpers shared by the training-data operators: words, intermediate tables, size-checked joins."""

from __future__ import annotations

import gc
import itertools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: words are runs of anything but these six characters.
BLANKS = " \t\n\x0b\f\r"
#: Rows up to which a side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000

_names = itertools.count()


def words(text: Column) -> Column:
    """The words of a text in order (null text: null)."""
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, ""))


def work_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; in sessions that set none, in the warehouse, which is shared too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/veilwork-{uuid.uuid4().hex}"


class Store:
    """Written tables of one run.  They cut the lineage and survive lost executors; `drop` deletes one early."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, work_folder(spark)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.folder}/{name}-{next(_names)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def clean(self) -> None:
        """Let the driver drop shuffles that no frame needs any more; else they stay until it happens to collect garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.kept_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only where the table (a written one) is proven to be small; `rows`: its rows, or a bound of them.

    Others are never broadcast: Spark would judge them by their compressed files, and send the driver many times that size.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of an equi-join that is never broadcast."""
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
