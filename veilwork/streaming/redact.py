"""Redaction of streams.

``redact_stateless`` is the whole row-local chain (detect, label, restore, anonymise, clean) as one
streaming plan: a label's number is a hash of its value, so equal values have equal labels and
surrogates in every batch without any state.

Dense indexes need what earlier batches have seen; two forms are given:

* ``start_incremental``: micro-batches meet a saved dictionary table.  The work of a batch is
  joins and aggregates, so one huge conversation is spread like in a batch run.
* ``stateful_index``: the dictionary as keyed state (``transformWithState``), for
  streams of many moderate conversations and low latency.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from veilwork.functions import marks as M
from veilwork.functions.text import clean_text
from veilwork.operators import numbering as N
from veilwork.operators.detect import OCC, detect
from veilwork.plans.redaction import keep_once, kept, release

DICTIONARY = "conversation_id string, label string, value string, ix bigint"
#: The dictionary is cut by conversation; a bucket has at most SEGMENTS folders before they are written as one.
BUCKETS, SEGMENTS = 64, 8


# ---- without state
def value_number(value: str) -> str:
    """SQL: 32 bits of a value's md5 sum."""
    return f"CAST(conv(substr(md5({value}), 1, 8), 16, 10) AS BIGINT)"


def redact_stateless(df: DataFrame, detectors, restore=("_IGNORE_",), surrogates=None, level=4, modality: str = "text",
                     seed=None, text: str = "text") -> DataFrame:
    """M2: detect, label, restore, anonymise and clean row by row; runs on a streaming frame.

    ``surrogates`` is a rule set whose generators replace the labels of ``level``; without it the labels stay, as
    ``[LABEL-<hash of the value>]``.  Two values of a conversation share a label once in four thousand million pairs.
    """
    columns = df.columns
    found = detect(df, detectors, text)
    label = f"concat('[', {{label}}, '-', cast({value_number(f'{OCC}[{{k}}].value')} AS string), ']')"
    names = ", ".join(M.quote(r) for r in restore) or "NULL"
    out = found.withColumn(text, M.fill(text, f"CASE WHEN {{label}} IN ({names}) THEN {OCC}[{{k}}].value ELSE {label} END")).drop(OCC)
    if surrogates is not None:
        from veilwork.operators.anonymize import anonymize
        out = anonymize(out, surrogates, modality, level, seed, text)
    return clean_text(out, text).select(*columns)


# ---- micro-batches with a saved dictionary
def bucket_of(conversation: str = "conversation_id") -> Column:
    return F.pmod(F.xxhash64(conversation), F.lit(BUCKETS)).cast("int")


def read_manifest(spark, state_path: str, batch: int) -> dict[int, list[int]]:
    """The folders (batch numbers) that hold each bucket after a batch."""
    line = spark.read.text(f"{state_path}/manifest/batch={batch}").first()
    return {int(b): v for b, v in json.loads(line.value).items()}


def write_manifest(spark, state_path: str, batch: int, manifest: dict, mode: str = "overwrite") -> None:
    one = spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1)
    one.write.mode(mode).text(f"{state_path}/manifest/batch={batch}")


def saved_dictionary(spark, state_path: str, manifest: dict[int, list[int]], buckets: list[int]) -> DataFrame:
    """The entries of the given buckets, from the few folders that hold them."""
    paths = [f"{state_path}/dictionary/batch={v}/bucket={b}" for b in buckets for v in manifest.get(b, [])]
    if not paths:
        return spark.createDataFrame([], DICTIONARY)
    return spark.read.schema(DICTIONARY).parquet(*paths)


def init_state(spark, state_path: str) -> None:
    """An empty manifest; left alone where the stream has run before."""
    write_manifest(spark, state_path, -1, {}, "ignore")


def redact_batch(batch: DataFrame, batch_id: int, detectors, state_path: str, out_path: str,
                 restore=("_IGNORE_",), block_rows: int = N.BLOCK_ROWS) -> None:
    """One micro-batch: number the new values behind the stored ones, then render.

    Only the buckets of the batch's conversations are read, each from ``SEGMENTS`` folders at most, so a batch costs the
    same after a thousand others.  A batch writes its own folders and replaces them when it runs again, so a repeated
    batch changes nothing.  ``log/batch=<n>`` holds the labels the batch created (M4: the audit stream).
    """
    spark = batch.sparkSession
    batch = batch.withColumn("conversation_id", F.col("conversation_id").cast("string"))
    before = kept()
    found = keep_once(detect(batch, detectors))
    hits = N.explode_hits(found)
    manifest = read_manifest(spark, state_path, batch_id - 1)
    touched = keep_once(hits.select("conversation_id").distinct())
    buckets = sorted(r[0] for r in touched.select(bucket_of()).distinct().collect())      # BUCKETS rows at most
    stored = saved_dictionary(spark, state_path, manifest, buckets)
    known = N.null_safe_join(stored, touched, ["conversation_id"], "left_semi")
    last = known.groupBy("conversation_id").agg((F.max("ix") + 1).alias("__next"))
    new = N.null_safe_join(N.first_places(hits, block_rows), known, N.KEY, "left_anti")
    new = N.running_number(new, ["first_block"], ["first_place"], "ix", within=["conversation_id"])
    new = (N.null_safe_join(new, last, ["conversation_id"], "left")
           .withColumn("ix", F.col("ix") + F.coalesce("__next", F.lit(0))).select(*N.KEY, "ix"))
    log = f"{state_path}/log/batch={batch_id}"
    new.write.mode("overwrite").parquet(log)
    new = spark.read.schema(DICTIONARY).parquet(log)
    store_entries(new, stored, state_path, batch_id, manifest, buckets)
    dictionary = known.select(*N.KEY, "ix").unionByName(new)
    indexed = N.spread_index(N.with_block(hits, block_rows), dictionary)
    out = clean_text(N.render(found, indexed, list(restore)).drop(OCC), "text")
    out.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
    release(spark, before)


def store_entries(new: DataFrame, stored: DataFrame, state_path: str, batch_id: int, manifest: dict, buckets: list[int]) -> None:
    """Add the new entries as one folder per bucket; a bucket with enough folders is written whole instead."""
    full = [b for b in buckets if len(manifest.get(b, [])) >= SEGMENTS - 1]
    entries = new.withColumn("bucket", bucket_of())
    if full:
        entries = entries.unionByName(stored.withColumn("bucket", bucket_of()).where(F.col("bucket").isin(full)))
    path = f"{state_path}/dictionary/batch={batch_id}"
    entries.repartition("bucket", F.pmod(F.xxhash64("value"), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(path)
    written = {r[0] for r in entries.select("bucket").distinct().collect()}
    after = {b: v for b, v in manifest.items()}
    for b in written:
        after[b] = [batch_id] if b in full else [*manifest.get(b, []), batch_id]
    write_manifest(new.sparkSession, state_path, batch_id, after)


def start_incremental(stream: DataFrame, detectors, state_path: str, out_path: str, checkpoint: str,
                      once: bool = False, **kw):
    """M1/M3: run ``redact_batch`` on every micro-batch of ``stream``."""
    init_state(stream.sparkSession, state_path)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, i: redact_batch(df, i, detectors, state_path, out_path, **kw))
    return (writer.trigger(availableNow=True) if once else writer).start()


def stateful_index(hits: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """M3: index of each hit from keyed state; input ``(conversation_id, row_id, k, label, value)``.

    A conversation's hits of one micro-batch are put in order before they are numbered, and each distinct value touches the
    state once; they are held together for that, so streams with huge conversations use ``start_incremental``.  Needs the RocksDB state store.  ``ttl_ms`` forgets values not seen for that long.
    """
    from pyspark.sql.streaming import StatefulProcessor

    class Index(StatefulProcessor):
        def init(self, handle):
            self.known = handle.getMapState("known", "label string, value string", "ix bigint", ttl_ms)
            self.next = handle.getValueState("next", "ix bigint", ttl_ms)

        def handleInputRows(self, key, rows, timers):
            rows = sorted(rows, key=lambda r: (r.row_id is None, r.row_id, r.k))
            seen = self.next.get()                # None: a new conversation, no value needs a look-up
            number, index = seen[0] if seen else 0, {}
            for r in rows:
                pair = (r.label, r.value)
                if pair not in index:
                    known = self.known.getValue(pair) if seen else None
                    if known is None:
                        known, number = (number,), number + 1
                        self.known.updateValue(pair, known)
                    elif ttl_ms is not None:      # seen again: its time starts anew
                        self.known.updateValue(pair, known)
                    index[pair] = known[0]
            if ttl_ms is not None or not seen or number != seen[0]:
                self.next.update((number,))
            for r in rows:
                yield Row(**r.asDict(), ix=index[r.label, r.value])

        def close(self):
            pass

    return hits.select("conversation_id", "row_id", "k", "label", "value").groupBy("conversation_id").transformWithState(
        Index(), "conversation_id string, row_id bigint, k int, label string, value string, ix bigint",
        "append", "none" if ttl_ms is None else "processingTime")
