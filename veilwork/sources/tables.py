"""Conversation tables: all-text CSV scans with a row number, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dated_path(stem: str, start: str, end: str) -> str:
    """``{stem}_{start}_{end}.csv``."""
    return f"{stem}_{start}_{end}.csv"


def read_csv(spark, paths, header: bool = False, multiline: bool = True) -> DataFrame:
    """A1/A2/K1: text columns only, blanks stay blank, files in the given order.

    Adds ``file_ix`` and the place of each row in its file (``block_start``, ``in_block``).
    ``multiline=False`` lets Spark split large files whose fields hold no line breaks.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for i, path in enumerate(paths):
        df = (spark.read.option("header", header).option("escape", '"').option("multiLine", multiline)
              .option("encoding", "UTF-8").csv(path))
        names = [c.lstrip("﻿") for c in df.columns]
        df = df.toDF(*names) if names != df.columns else df
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names]
        if not header:
            cells[0] = F.regexp_replace(cells[0], F.lit("^﻿"), F.lit("")).alias(names[0])
        df = df.select(*cells, F.lit(i).alias("file_ix"),
                       F.col("_metadata.file_path").alias("file_path"),
                       F.col("_metadata.file_block_start").alias("block_start"),
                       F.monotonically_increasing_id().alias("in_block"))
        out = df if out is None else out.unionByName(df)
    return out


def bind(df: DataFrame, text, conversation) -> DataFrame:
    """A3: name the text and id columns by header name or by 1-based position."""
    def name(which):
        if isinstance(which, int):
            if not 1 <= which <= len(df.columns):
                raise KeyError(f"no column number {which}")
            return df.columns[which - 1]
        if which not in df.columns:
            raise KeyError(f"the column {which!r} was not found in the input")
        return which
    text, conversation = name(text), name(conversation)
    return df.withColumnsRenamed({text: "text", conversation: "conversation_id"})


def number_rows(df: DataFrame, chunk_rows: int = 100_000) -> DataFrame:
    """``row_id`` 0, 1, ... over all files, and ``chunk_id`` counted over all files.

    Rows of one split have consecutive ids already; only the counts per split are summed up.
    """
    splits = df.groupBy("file_ix", "file_path", "block_start").agg(
        F.count("*").alias("__n"), F.min("in_block").alias("__low"))
    order = Window.orderBy("file_ix", "file_path", "block_start").rowsBetween(Window.unboundedPreceding, 0)
    in_file = (Window.partitionBy("file_ix").orderBy("file_path", "block_start")
               .rowsBetween(Window.unboundedPreceding, 0))
    splits = (splits.withColumn("__before", F.sum("__n").over(order) - F.col("__n"))
              .withColumn("__in_file", F.sum("__n").over(in_file) - F.col("__n")))
    # Chunks start anew with each file, as every file is cut on its own.
    files = splits.groupBy("file_ix").agg(F.ceil(F.sum("__n") / chunk_rows).alias("__chunks"))
    files = files.withColumn("__first_chunk", F.sum("__chunks").over(
        Window.orderBy("file_ix").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__chunks"))
    splits = splits.join(files.drop("__chunks"), "file_ix")
    here = F.col("in_block") - F.col("__low")
    return (df.join(splits.drop("__n"), ["file_ix", "file_path", "block_start"])
            .withColumn("row_id", (F.col("__before") + here).cast("bigint"))
            .withColumn("chunk_id", (F.col("__first_chunk") + F.floor((F.col("__in_file") + here) / chunk_rows)).cast("bigint"))
            .drop("file_path", "block_start", "in_block", "__low", "__before", "__in_file", "__first_chunk"))


def limit_chunks(df: DataFrame, chunks: int) -> DataFrame:
    """Only the first chunks, over all files."""
    return df.where(F.col("chunk_id") < chunks)


def gather(df: DataFrame, chunks_per_file: int) -> DataFrame:
    """B2: ``gather_id`` and the file label, which is the last chunk of the group."""
    df = df.withColumn("gather_id", F.floor(F.col("chunk_id") / chunks_per_file).cast("bigint"))
    labels = df.groupBy("gather_id").agg(F.max("chunk_id").alias("file_label"))
    return df.join(labels, "gather_id")


#: Texts are written as they are: quotes doubled, blanks at their ends kept.
AS_IS = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_dated(df: DataFrame, path: str, date: str, header: bool = True, mode: str = "error", files_per_day: int = 1) -> None:
    """One folder per day of the date column, so that a range of days is read without the others."""
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c != date]), F.lit(files_per_day))
    df.repartition(date, spread).write.mode(mode).option("header", header).options(**AS_IS).partitionBy(date).csv(path)


def read_dated(spark, path: str, date: str, start: str | None = None, end: str | None = None, header: bool = True,
               multiline: bool = False) -> DataFrame:
    """A5: text columns of the days from ``start`` to ``end`` (both included, null: open); only their folders are listed."""
    df = (spark.read.option("header", header).option("escape", '"').option("multiLine", multiline)
          .option("encoding", "UTF-8").csv(path))
    day = F.col(date).cast("date")
    if start is not None:
        df = df.where(day >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(day <= F.lit(end).cast("date"))
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


HELPERS = ["row_id", "chunk_id", "file_ix", "gather_id", "file_label"]


def write_table(df: DataFrame, path: str, header: bool = True, mode: str = "error") -> None:
    """Rows in input order, as many files as the range sort makes, helper columns left out."""
    ordered = df.orderBy("row_id")
    ordered.drop(*HELPERS).write.mode(mode).option("header", header).options(**AS_IS).csv(path)


def write_gathered(df: DataFrame, path: str, chunks_per_file: int, header: bool = False,
                   mode: str = "error") -> None:
    """B2: one folder per group of chunks, rows in input order inside it.

    A group is split over tasks by chunk, so its size does not bound a task.
    """
    out = gather(df, chunks_per_file)
    out = out.repartitionByRange("file_label", "chunk_id").sortWithinPartitions("file_label", "row_id")
    drop = [c for c in HELPERS if c != "file_label"]
    out.drop(*drop).write.mode(mode).option("header", header).options(**AS_IS).partitionBy("file_label").csv(path)


def write_log(log: DataFrame, path: str, mode: str = "error") -> None:
    """Label and value in order of creation.  Holds personal data: keep it apart."""
    by_conversation = "conversation_id" in log.columns
    keys = ["conversation_id", "seq"] if by_conversation else ["seq"]
    columns = (["conversation_id"] if by_conversation else []) + ["label", "value"]
    log.orderBy(*keys).select(*columns).write.mode(mode).options(**AS_IS).csv(path)


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """The rule-test report."""
    columns = ["regex_id", "test_type", "pass", "group", "ix", "match", "left", "matched_text", "right",
               "test_text", "pattern_ix"]
    report.select(*columns).write.mode(mode).option("header", True).options(**AS_IS).csv(path)
