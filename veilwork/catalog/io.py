"""A, B, K and M queries: files in, files out, streams.

Each writes rows derived from the tables to the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import INDEX_CTES, TRANSCRIPTS, TURN_SRC, hits_ctes, query, redact_sql, shared_folder, table, transcripts
from veilwork.catalog.detection import RUN, TOKENS
from veilwork.catalog.rules import EMAIL_RE, only, whole
from veilwork.catalog.text import CLEAN
from veilwork.operators import numbering as N
from veilwork.operators.detect import detect
from veilwork.plans.redaction import keep_once
from veilwork.rules.ruleset import RuleSet
from veilwork.sources import tables as S
from veilwork.sources.phrases import read_phrase_csv, read_phrase_document

COLUMNS = ["conv_id", "turn", "speaker", "text"]
# Quotes, commas, line breaks, blanks and NA words, as real exports have them.
TRICKY = """SELECT o_orderkey, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'NA' WHEN 2 THEN 'null'
 WHEN 3 THEN concat('say "hi", ', o_orderpriority) WHEN 4 THEN concat('two', chr(10), 'lines') ELSE o_orderpriority END AS text FROM orders"""


def _orders_sql(spark, sf_dir, sql):
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


@query("a1_csv_all_text", TRICKY.replace("SELECT o_orderkey,", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,"))
def a1(spark, sf_dir):
    path = shared_folder(spark) + "/a1"
    _orders_sql(spark, sf_dir, TRICKY).write.option("header", True).option("escape", '"').csv(path)
    return S.read_csv(spark, path, header=True).select("o_orderkey", "text")


def two_files(spark, sf_dir):
    root = shared_folder(spark)
    df = transcripts(spark, sf_dir).select(*COLUMNS)
    for i in (0, 1):
        # Ranges in order, a part file each, so that the place in the whole is known to the SQL.
        (df.where(F.col("turn") % 2 == i).repartitionByRange("turn").sortWithinPartitions("turn")
         .write.option("header", True).option("escape", '"').csv(f"{root}/file{i}"))
    return S.read_csv(spark, [f"{root}/file0", f"{root}/file1"], header=True)


FILES = f"SELECT CAST(turn AS VARCHAR) AS turn, CAST(turn % 2 AS INT) AS file_ix, turn AS t FROM ({TRANSCRIPTS})"
NUMBERED = f"""SELECT turn, file_ix, row_number() OVER (ORDER BY file_ix, t) - 1 AS row_id,
 row_number() OVER (PARTITION BY file_ix ORDER BY t) - 1 AS in_file, count(*) OVER (PARTITION BY file_ix) AS n FROM ({FILES})"""
CHUNKED = f"""SELECT turn, file_ix, row_id, in_file // 100 + CASE WHEN file_ix = 1 THEN
 (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) FROM ({FILES}) WHERE file_ix = 0) ELSE 0 END AS chunk_id FROM ({NUMBERED})"""


@query("a2_files_in_order", f"SELECT turn, file_ix FROM ({FILES})")
def a2(spark, sf_dir):
    return two_files(spark, sf_dir).select("turn", "file_ix")


@query("a3_bind_columns", "SELECT CAST(conv_id AS BIGINT) AS conversation_id, turn, role, text FROM conversations")
def a3(spark, sf_dir):
    """Text by position, conversation by name."""
    return S.bind(table(spark, sf_dir, "conversations"), 4, "conv_id").select("conversation_id", "turn", "role", "text")


@query("a6_row_numbers_and_chunks", CHUNKED)
def a6(spark, sf_dir):
    return S.number_rows(two_files(spark, sf_dir), 100).select("turn", "file_ix", "row_id", "chunk_id")


@query("a7_chunk_limit", f"SELECT turn, chunk_id FROM ({CHUNKED}) WHERE chunk_id < 3")
def a7(spark, sf_dir):
    return S.limit_chunks(S.number_rows(two_files(spark, sf_dir), 100), 3).select("turn", "chunk_id")


@query("a8_phrase_csv", "SELECT n_name AS phrase FROM nation UNION ALL SELECT 'U.S.' UNION ALL SELECT r_name FROM region")
def a8(spark, sf_dir):
    """A headed list by field name and a headless one by column number."""
    root = shared_folder(spark)
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(f"{root}/named")
    plain = spark.range(1).select(F.lit("U.S.").alias("n")).unionByName(
        table(spark, sf_dir, "region").select(F.col("r_name").alias("n")))
    plain.write.option("header", False).csv(f"{root}/plain")
    return read_phrase_csv(spark, f"{root}/named", field="n_name").unionByName(
        read_phrase_csv(spark, f"{root}/plain", column=0, header=False))


@query("a9_phrase_document", "SELECT n_name AS phrase FROM nation")
def a9(spark, sf_dir):
    """``regions.names``: an array of objects with a list of names each."""
    root = shared_folder(spark)
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    doc = names.agg(F.collect_list(F.struct("names")).alias("regions"))
    doc.write.json(f"{root}/doc")
    return read_phrase_document(spark, f"{root}/doc", "regions.names")


@query("a5_dated_input", f"SELECT CAST(turn AS VARCHAR) AS turn, text FROM ({TRANSCRIPTS})")
def a5(spark, sf_dir):
    """A path made of stem and dates, written and read."""
    path = S.dated_path(shared_folder(spark) + "/input", "2024-01-01", "2024-01-31")
    transcripts(spark, sf_dir).select("turn", "text").write.option("header", True).option("escape", '"').csv(path)
    return S.read_csv(spark, path, header=True).select("turn", "text")


@query("a5_date_range", """SELECT CAST(o_orderkey AS VARCHAR) AS turn, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS dt, ' ' || o_orderpriority AS text
FROM orders WHERE date_trunc('month', o_orderdate) BETWEEN DATE '1995-02-01' AND DATE '1995-06-01'""")
def a5_range(spark, sf_dir):
    """A folder per month, and the folders of five months read."""
    path = shared_folder(spark) + "/dated"
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("turn"), F.trunc("o_orderdate", "month").alias("dt"),
                                               F.concat(F.lit(" "), "o_orderpriority").alias("text"))
    S.write_dated(df, path, "dt")
    return S.read_dated(spark, path, "dt", "1995-02-01", "1995-06-01").select("turn", "dt", "text")


@query("b1_place_in_order", f"SELECT CAST(turn AS VARCHAR) AS turn, row_number() OVER (ORDER BY turn) - 1 AS place FROM ({TRANSCRIPTS})")
def b1_place(spark, sf_dir):
    """The place of each row in the files that were written, counted over the files in the order of their names."""
    path = shared_folder(spark) + "/out"
    S.write_table(transcripts(spark, sf_dir).select("row_id", "turn", "text"), path)
    return S.number_rows(S.read_csv(spark, path, header=True)).select("turn", F.col("row_id").alias("place"))


@query("b1_write_in_order", f"SELECT CAST(turn AS VARCHAR) AS turn, text FROM ({TRANSCRIPTS})")
def b1(spark, sf_dir):
    path = shared_folder(spark) + "/out"
    S.write_table(transcripts(spark, sf_dir).select("row_id", "turn", "text"), path)
    return S.read_csv(spark, path, header=True).select("turn", "text")


@query("b2_gathered_chunks", f"""SELECT turn, gather_id, max(chunk_id) OVER (PARTITION BY gather_id) AS file_label
FROM (SELECT *, chunk_id // 4 AS gather_id FROM ({CHUNKED}))""")
def b2(spark, sf_dir):
    return S.gather(S.number_rows(two_files(spark, sf_dir), 100), 4).select("turn", "gather_id", "file_label")


@query("b2_gathered_files", f"""SELECT turn, max(chunk_id) OVER (PARTITION BY chunk_id // 4) AS file_label FROM ({CHUNKED})""")
def b2_files(spark, sf_dir):
    path = shared_folder(spark) + "/gathered"
    S.write_gathered(S.number_rows(two_files(spark, sf_dir), 100), path, 4, header=True)
    return (spark.read.option("header", True).csv(path)
            .select("turn", F.col("file_label").cast("bigint").alias("file_label")))


@query("k1_concatenate_files", f"SELECT file_ix, count(*) AS n FROM ({FILES}) GROUP BY file_ix")
def k1(spark, sf_dir):
    return two_files(spark, sf_dir).groupBy("file_ix").agg(F.count("*").alias("n"))


@query("l2_restore_from_saved_log", f"SELECT turn AS row_id, text FROM ({TRANSCRIPTS})")
def l2(spark, sf_dir):
    """Redact mail addresses, write the log, and restore the text from the log in a second pass."""
    from veilwork.operators.anonymize import restore
    df = transcripts(spark, sf_dir).select("row_id", F.col("conversation_id").cast("string").alias("conversation_id"), "text")
    found = keep_once(detect(df, only("EMAIL")))
    indexed, dictionary = N.conversation_index(N.explode_hits(found))
    path = shared_folder(spark) + "/log"
    S.write_log(N.audit_log(dictionary), path)
    log = spark.read.schema("conversation_id string, label string, value string").option("escape", '"').csv(path)
    return restore(N.render(found, indexed, []), log, "EMAIL").select("row_id", "text")


# ---- streams -------------------------------------------------------------------------
def _streams(spark, sf_dir, slices: int = 4):
    """A folder and, slice by slice in turn order, the transcripts as a stream whose new files are one micro-batch.

    A slice is written by all tasks, so its batch is spread over as many files.  The caller runs the query to its end for each
    slice, from the same checkpoint; so files of two slices never meet in a batch.
    """
    root = shared_folder(spark)
    df = transcripts(spark, sf_dir).select("row_id", F.col("conversation_id").cast("string").alias("conversation_id"), "text")
    df = keep_once(df)
    last = df.agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0]

    def feed():
        for i in range(slices):
            df.where(F.floor(F.col("row_id") * slices / (last + 1)) == i).write.mode("append").parquet(f"{root}/in")
            yield spark.readStream.schema(df.schema).parquet(f"{root}/in")
    return root, feed()


M2_SEED = 7
_M2_KEY = f"concat_ws('|', '{M2_SEED}', CAST(conv AS VARCHAR), label, CAST(CAST('0x' || substr(md5(value), 1, 8) AS BIGINT) AS VARCHAR))"
_M2_DRAW = f"CAST(CAST('0x' || substr(md5({_M2_KEY} || '|0'), 1, 8) AS BIGINT) % 1000000 AS VARCHAR)"


@query("m2_stateless_stream", f"""WITH {RUN},
shown AS (SELECT row_id, string_agg(CASE WHEN label = '_IGNORE_' THEN value ELSE label || ' ' || {_M2_DRAW} END || tail, '' ORDER BY i) AS body
          FROM h GROUP BY row_id)
SELECT p.row_id, {CLEAN.format(t="(p.p || coalesce(s.body, ''))")} AS text FROM pcs p LEFT JOIN shown s ON s.row_id = p.row_id WHERE p.i = 1""")
def m2(spark, sf_dir):
    """Every rule of level 2, labels, restored phrases, surrogates and cleaning in one streaming plan."""
    from veilwork.operators.registry import register_surrogate
    from veilwork.streaming.redact import redact_stateless
    register_surrogate("numbered", lambda draws, params: f"concat('{params['prefix']} ', {draws.between(0, 1_000_000)})")
    labels = ["ZIP", "PIN", "CCARD", "PHONE", "SSN", "EMAIL"]
    surrogates = RuleSet({"level": {"own": labels}, "redaction-order": labels, "anon-map": {}, "entities": {
        e: {"anonymizer": {"model-class": "numbered", "prefix": e}} for e in labels}}, defaults=False)
    root, streams = _streams(spark, sf_dir)
    steps = RuleSet({"token-map": TOKENS}).detectors("text", 2)
    for stream in streams:
        out = redact_stateless(stream, steps, surrogates=surrogates, level="own", seed=M2_SEED).select("row_id", "text")
        (out.writeStream.option("checkpointLocation", f"{root}/cp").option("path", f"{root}/out").format("parquet")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("m3_incremental_index", f"""SELECT r.row_id, CAST(s.conv AS VARCHAR) AS conversation_id, {CLEAN.format(t='r.text')} AS text
FROM ({redact_sql(TURN_SRC, whole(EMAIL_RE), 'EMAIL')}) r JOIN ({TURN_SRC}) s ON s.row_id = r.row_id""")
def m3(spark, sf_dir):
    """Micro-batches of files with the saved dictionary; indexes stay the same over batches."""
    from veilwork.streaming.redact import start_incremental
    root, streams = _streams(spark, sf_dir)
    for stream in streams:
        start_incremental(stream, only("EMAIL"), f"{root}/state", f"{root}/out", f"{root}/cp", once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("row_id", "conversation_id", "text")


MAIL_INDEX = f"{hits_ctes(TURN_SRC, whole(EMAIL_RE), 'EMAIL')},{INDEX_CTES}"


@query("m3_stateful_index", f"""WITH {MAIL_INDEX}
SELECT CAST(h.conv AS VARCHAR) AS conversation_id, h.row_id, h.k, h.value, r.ix FROM hits h JOIN ranked r USING (conv, label, value)""")
def m3_stateful(spark, sf_dir):
    """The index of each hit from keyed state, over four micro-batches."""
    from veilwork.streaming.redact import stateful_index
    root, streams = _streams(spark, sf_dir)
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for stream in streams:
            out = stateful_index(N.explode_hits(detect(stream, only("EMAIL"))).drop("rule_ix"))
            (out.writeStream.option("checkpointLocation", f"{root}/cp").option("path", f"{root}/out").format("parquet")
             .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(out.schema).parquet(f"{root}/out").select(
        "conversation_id", "row_id", F.col("k").cast("bigint").alias("k"), "value", "ix")


@query("m4_audit_stream", f"""WITH {MAIL_INDEX} SELECT CAST(conv AS VARCHAR) AS conversation_id, label, value, min(ix) AS ix, count(*) AS n
FROM ranked GROUP BY ALL""")
def m4(spark, sf_dir):
    """The log written batch by batch holds every value exactly once, with its index."""
    from veilwork.streaming.redact import DICTIONARY, start_incremental
    root, streams = _streams(spark, sf_dir)
    for stream in streams:
        start_incremental(stream, only("EMAIL"), f"{root}/state", f"{root}/out", f"{root}/cp", once=True).awaitTermination()
    return (spark.read.schema(DICTIONARY).parquet(f"{root}/state/log")
            .groupBy("conversation_id", "label", "value").agg(F.min("ix").alias("ix"), F.count("*").alias("n")))
