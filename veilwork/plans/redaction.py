"""The redaction job: detect, number, render, anonymise, clean."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.functions.text import clean_text
from veilwork.operators import numbering as N
from veilwork.operators.detect import OCC, detect
from veilwork.rules.ruleset import RuleSet


#: Folders and frames kept by this driver, until they are released.
_kept: list = []


def checkpoint_folder(spark) -> str | None:
    """A new folder in the shared folder of the cluster, if the session names one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        return None
    folder = f"{base.rstrip('/')}/veilwork-{uuid.uuid4().hex}"
    _kept.append(folder)
    return folder


def keep_once(df: DataFrame) -> DataFrame:
    """Make sure an expensive frame that is read several times is computed once.

    It is written as a columnar table to the shared checkpoint folder and read back: readers
    prune its columns, the plan above it starts at a scan, and a lost executor costs a
    re-read.  A session without such a folder gets a cache, whose lost blocks are computed
    again from the source.  ``release`` removes both: they hold personal data.
    """
    path = checkpoint_folder(df.sparkSession)
    if path is None:
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        _kept.append(out)
        return out
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark, since: int = 0) -> None:
    """Delete what was kept from number ``since`` on, once the results are written."""
    gone, _kept[since:] = _kept[since:], []
    for x in gone:
        if isinstance(x, DataFrame):
            x.unpersist()
        else:
            path = spark._jvm.org.apache.hadoop.fs.Path(x)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept() -> int:
    """How many folders and frames are kept now."""
    return len(_kept)


@dataclass
class RedactionJob:
    """One run.  ``run`` writes the detected rows once and returns the changed table and the audit frame.

    After both are written, ``release(spark)`` deletes the detected rows.

    The input has ``row_id BIGINT`` (unique, consecutive rows have near ids), a conversation
    id and a text column; other columns pass through.  ``numbering`` is ``conversation``
    (dense index inside each conversation) or ``global`` (one counter over the table).
    """
    rules: RuleSet = field(default_factory=RuleSet)
    modality: str = "text"
    level: object = 2
    redact: bool = True
    anonymize: bool = False
    numbering: str = "conversation"
    compat: bool = False
    uppercase: bool = False
    seed: object = None
    span_source: object = None
    block_rows: int = N.BLOCK_ROWS

    def detect(self, df: DataFrame, text: str) -> DataFrame:
        steps = self.rules.detectors(self.modality, self.level, self.redact, df.sparkSession)
        return detect(df, steps, text, span_source=self.span_source)

    def index(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        keep = [c for c in ("file_ix", "chunk_id") if c in found.columns]
        hits = N.explode_hits(found, ["row_id", "conversation_id", *keep])
        if self.numbering == "global":
            return N.global_index(N.sequence(hits, self.block_rows), self.compat)
        return N.conversation_index(hits, self.block_rows)

    def run(self, df: DataFrame, text: str = "text", conversation: str = "conversation_id"):
        columns = df.columns
        if conversation != "conversation_id":
            df = df.withColumn("conversation_id", F.col(conversation))
        found = keep_once(self.detect(df, text))
        indexed, dictionary = self.index(found)
        restore = [r for r in self.rules.anonymization_order(self.level, self.anonymize)
                   if self.restores(r)]
        out = N.render(found, indexed, restore, text).drop(OCC)
        if self.anonymize:
            from veilwork.operators.anonymize import anonymize
            out = anonymize(out, self.rules, self.modality, self.level, self.seed, text)
        out = clean_text(out, text)
        if self.uppercase:
            out = out.withColumn(text, F.upper(text))
        return out.select(*columns), N.audit_log(N.with_final_labels(dictionary))

    def restores(self, rule: str) -> bool:
        from veilwork.rules.ruleset import kind_of
        block = self.rules.block(rule, "anonymizer")
        return bool(block) and kind_of(block["model-class"]) == "restoreentitytext"
