"""E, I, J, L, H1/H2 queries: sequence numbers, indexes and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilwork.catalog.base import TURN_SRC, conversations, hits_ctes, query, table, transcripts
from veilwork.catalog.rules import EMAIL_RE, only, whole
from veilwork.operators import numbering as N
from veilwork.operators.detect import detect
from veilwork.rules.ruleset import compile_pattern

CHUNK = 1000
HITS = hits_ctes(TURN_SRC, whole(EMAIL_RE), "EMAIL", 1)
# Two rules over the same turns, so numbers run rule by rule inside a chunk.
TWO_RULES = f"""{HITS.replace('hits AS', 'mail_hits AS')},
m2 AS (SELECT row_id, conv, regexp_replace(text, '(^|\\s)(\\d{{4}})', '\\1' || chr(1) || '\\2' || chr(2), 'g') AS m FROM src),
pcs2 AS (SELECT row_id, conv, unnest(string_split(m, chr(1))) AS p,
                generate_subscripts(string_split(m, chr(1)), 1) AS i FROM m2),
pin_hits AS (SELECT row_id, conv, i, max(i) OVER (PARTITION BY row_id) - i AS k, 'PIN' AS label, 2 AS rule_ix,
                    split_part(p, chr(2), 1) AS value FROM pcs2 WHERE i > 1),
hits AS (SELECT row_id, conv, k, label, rule_ix, value FROM mail_hits UNION ALL
         SELECT row_id, conv, k, label, rule_ix, value FROM pin_hits),
numbered AS (SELECT *, row_number() OVER (ORDER BY row_id // {CHUNK}, rule_ix, row_id, k) - 1 AS seq FROM hits)"""
# Mail and PIN hits are in different turns, so k is the place inside the rule in both engines.


def found(spark, sf_dir):
    steps = [*only("EMAIL"), *only("PIN")]
    df = transcripts(spark, sf_dir).withColumn("chunk_id", F.floor(F.col("row_id") / CHUNK))
    return detect(df, steps)


def hits(spark, sf_dir):
    return N.explode_hits(found(spark, sf_dir), ["row_id", "conversation_id", "chunk_id"])


def sequenced(spark, sf_dir):
    from veilwork.plans.redaction import keep_once
    return N.sequence(keep_once(hits(spark, sf_dir)), CHUNK)


@query("e1_sequence", f"WITH {TWO_RULES} SELECT row_id, label, value, seq FROM numbered")
def e1(spark, sf_dir):
    return sequenced(spark, sf_dir).select("row_id", "label", "value", "seq")


# ids far apart: nearly every turn is a block of its own
SPARSE = r"""h AS (SELECT conv_id, conv_id * 1048576 + turn AS row_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+[aeiou]\b')) AS value,
 generate_subscripts(regexp_extract_all(text, '[A-Za-z]+[aeiou]\b'), 1) AS i FROM conversations)"""


def sparse_hits(spark, sf_dir):
    steps = [compile_pattern(0, "WORD", r"(?<![A-Za-z])[A-Za-z]+[aeiou](?![A-Za-z0-9_])", "a")]
    return N.explode_hits(detect(conversations(spark, sf_dir), steps))


@query("e1_sparse_ids", f"""WITH {SPARSE} SELECT row_id, value, row_number() OVER (ORDER BY row_id, i DESC) - 1 AS seq FROM h""")
def e1_sparse(spark, sf_dir):
    from veilwork.plans.redaction import keep_once
    return N.sequence(keep_once(sparse_hits(spark, sf_dir))).select("row_id", "value", "seq")


@query("e6_sparse_ids", f"""WITH {SPARSE},
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY row_id, i DESC) AS o FROM h),
f AS (SELECT conv_id, value, min(o) AS o FROM o GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS ix FROM f)
SELECT o.row_id, o.value, r.ix FROM o JOIN r USING (conv_id, value)""")
def e6_sparse(spark, sf_dir):
    from veilwork.plans.redaction import keep_once
    return N.conversation_index(keep_once(sparse_hits(spark, sf_dir)))[0].select("row_id", "value", "ix")


@query("e2_index", f"""WITH {TWO_RULES}
SELECT row_id, label, value, seq, min(seq) OVER (PARTITION BY conv, label, value) AS ix FROM numbered""")
def e2(spark, sf_dir):
    return N.global_index(sequenced(spark, sf_dir))[0].select("row_id", "label", "value", "seq", "ix")


@query("e4_index_zero_reissue", f"""WITH {TWO_RULES},
f AS (SELECT *, min(seq) OVER w AS first_seq, min(CASE WHEN seq > 0 THEN seq END) OVER w AS second
      FROM numbered WINDOW w AS (PARTITION BY conv, label, value))
SELECT row_id, label, value, seq,
       CASE WHEN seq = 0 THEN 0 WHEN first_seq = 0 THEN coalesce(second, 0) ELSE first_seq END AS ix FROM f""")
def e4(spark, sf_dir):
    return N.global_index(sequenced(spark, sf_dir), compat=True)[0].select("row_id", "label", "value", "seq", "ix")


@query("e5_first_value_per_label", f"""WITH {TWO_RULES},
f AS (SELECT *, min(seq) OVER (PARTITION BY conv, label, value) AS ix FROM numbered)
SELECT label || '-' || ix AS label, arg_min(value, seq) AS value, min(seq) AS seq FROM f GROUP BY label || '-' || ix""")
def e5(spark, sf_dir):
    return N.audit_log(N.global_index(sequenced(spark, sf_dir))[1])


E6 = f"""{TWO_RULES},
firsts AS (SELECT conv, label, value, min(row_id) AS r0 FROM hits GROUP BY ALL),
places AS (SELECT f.*, min(h.k) AS k0 FROM firsts f JOIN hits h
           ON h.conv = f.conv AND h.label = f.label AND h.value = f.value AND h.row_id = f.r0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY r0, k0) - 1 AS ix FROM places)"""


@query("e6_conversation_index", f"""WITH {E6}
SELECT h.row_id, h.label, h.value, r.ix FROM hits h JOIN ranked r USING (conv, label, value)""")
def e6(spark, sf_dir):
    from veilwork.plans.redaction import keep_once
    return N.conversation_index(keep_once(hits(spark, sf_dir)), CHUNK)[0].select("row_id", "label", "value", "ix")


@query("e6_index_by_user_events", """WITH d AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL)
SELECT e.event_id, d2.ix FROM events e JOIN (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS ix FROM d) d2 USING (user_id, event_type)""")
def e6_events(spark, sf_dir):
    h = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("conversation_id"), F.lit(0).alias("k"),
        F.lit("EVENT").alias("label"), F.col("event_type").alias("value"))
    return N.conversation_index(h)[0].select(F.col("row_id").alias("event_id"), "ix")


@query("b3_audit_log", f"""WITH {E6} SELECT conv AS conversation_id, label || '-' || ix AS label, value, ix AS seq FROM ranked""")
def b3(spark, sf_dir):
    from veilwork.plans.redaction import keep_once
    return N.audit_log(N.conversation_index(keep_once(hits(spark, sf_dir)), CHUNK)[1])


@query("h1_replacement_counts", f"""WITH {TWO_RULES}
SELECT label, count(*) AS n, count(DISTINCT row_id) AS turns, count(DISTINCT conv) AS conversations FROM hits GROUP BY label""")
def h1(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("label").agg(
        F.count("*").alias("n"), F.countDistinct("row_id").alias("turns"),
        F.countDistinct("conversation_id").alias("conversations"))


@query("h2_distinct_labels", f"""WITH {TWO_RULES},
f AS (SELECT *, min(seq) OVER (PARTITION BY conv, label, value) AS ix FROM numbered)
SELECT label, count(DISTINCT ix) AS labels, arg_min(value, seq) AS first_value FROM f GROUP BY label""")
def h2(spark, sf_dir):
    log = N.global_index(sequenced(spark, sf_dir))[1]
    return log.groupBy("label").agg(F.countDistinct("ix").alias("labels"),
                                    F.min_by("value", "first_seq").alias("first_value"))


@query("i1_running_counter", f"""WITH {TWO_RULES}
SELECT row_id, count(*) AS n, max(seq) + 1 AS counter FROM numbered GROUP BY row_id""")
def i1(spark, sf_dir):
    return sequenced(spark, sf_dir).groupBy("row_id").agg(
        F.count("*").alias("n"), (F.max("seq") + 1).alias("counter"))


@query("i3_repeat_number", f"""WITH {TWO_RULES}
SELECT row_id, k, label, value, row_number() OVER (PARTITION BY conv, label, value ORDER BY seq) AS repeat_no FROM numbered""")
def i3(spark, sf_dir):
    # A hot value is numbered block by block, like everything that follows the input order.
    out = N.running_number(sequenced(spark, sf_dir), ["chunk_id", "block"], ["seq"], "repeat_no", within=N.KEY)
    return out.select("row_id", "k", "label", "value", (F.col("repeat_no") + 1).alias("repeat_no"))


@query("i4_match_ordinal", f"""WITH {HITS}
SELECT row_id, value, row_number() OVER (PARTITION BY row_id ORDER BY i) AS ix FROM hits""")
def i4(spark, sf_dir):
    df = detect(transcripts(spark, sf_dir), only("EMAIL"))
    return df.select("row_id", F.posexplode_outer(F.reverse("occ")).alias("p", "o")).where("p IS NOT NULL").select(
        "row_id", "o.value", (F.col("p") + 1).cast("bigint").alias("ix"))


@query("j2_right_to_left", f"""WITH {HITS}
SELECT row_id, value, row_number() OVER (PARTITION BY row_id ORDER BY i DESC) - 1 AS k FROM hits""")
def j2(spark, sf_dir):
    h = N.explode_hits(detect(transcripts(spark, sf_dir), only("EMAIL")))
    return h.select("row_id", "value", F.col("k").cast("bigint").alias("k"))


@query("j3_audit_order", f"""WITH {TWO_RULES},
f AS (SELECT *, min(seq) OVER (PARTITION BY conv, label, value) AS ix FROM numbered),
l AS (SELECT label || '-' || ix AS label, min(seq) AS seq FROM f GROUP BY label || '-' || ix)
SELECT label, row_number() OVER (ORDER BY seq) AS line FROM l""")
def j3(spark, sf_dir):
    from veilwork.plans.redaction import keep_once
    log = keep_once(N.audit_log(N.global_index(sequenced(spark, sf_dir))[1])).withColumn(
        "block", F.floor(F.col("seq") / CHUNK))
    return N.running_number(log, ["block"], ["seq"], "line").select("label", (F.col("line") + 1).alias("line"))


@query("l1_saved_map_lookup", f"""WITH {E6}
SELECT h.row_id, h.k, r.ix FROM hits h JOIN ranked r USING (conv, label, value)""")
def l1(spark, sf_dir):
    """Hits against a dictionary saved by an earlier run."""
    from veilwork.catalog.base import shared_folder
    from veilwork.plans.redaction import keep_once
    rows = keep_once(hits(spark, sf_dir))
    path = shared_folder(spark) + "/dictionary"
    N.dictionary_of(rows, CHUNK).write.parquet(path)
    saved = spark.read.parquet(path)
    out = N.spread_index(N.with_block(rows, CHUNK), saved)
    return out.select("row_id", F.col("k").cast("bigint").alias("k"), "ix")


@query("l3_alias_lookup", """WITH a AS (SELECT * FROM (VALUES ('emailAddress','EMAIL'),('PERSON','PERSON'),('MAIL','EMAIL')) v(name, entity)),
t AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN 'emailAddress' WHEN o_orderkey % 3 = 1 THEN 'PERSON' ELSE 'OTHER' END AS name FROM orders)
SELECT entity, count(*) AS n FROM t JOIN a USING (name) GROUP BY entity""")
def l3(spark, sf_dir):
    from itertools import chain
    from veilwork.operators.anonymize import label_owners
    rules_owner = label_owners(_alias_rules(), ["PERSON", "EMAIL"])
    owner = F.create_map(*[F.lit(x) for x in chain(*rules_owner.items())])
    name = (F.when(F.col("o_orderkey") % 3 == 0, "emailAddress").when(F.col("o_orderkey") % 3 == 1, "PERSON")
            .otherwise("OTHER"))
    return (table(spark, sf_dir, "orders").select(owner[name].alias("entity")).where("entity IS NOT NULL")
            .groupBy("entity").agg(F.count("*").alias("n")))


def _alias_rules():
    from veilwork.rules.ruleset import RuleSet
    return RuleSet({"anon-map": {"EMAIL": ["EMAIL", "emailAddress", "MAIL"]}})
