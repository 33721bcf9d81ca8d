"""The operators applied to whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.classifier import classify
from veilwork.llm.common import words
from veilwork.llm.context_tree import score
from veilwork.llm.importance import resample
from veilwork.llm.licenses import known_digests, known_texts, license_scan
from veilwork.llm.minhash import near_duplicates
from veilwork.llm.mixing import mix
from veilwork.llm.packing import pack
from veilwork.llm.periodic_runs import find_runs
from veilwork.llm.pii import KINDS, personal_data
from veilwork.llm.quality_rules import quality_rules
from veilwork.llm.suffix_dedup import remove_repeats
from veilwork.llm.topk import top_k
from veilwork.llm.url_filter import filter_urls, known_blocklist


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"), known_digests(spark, known_texts()))


def op10_classifier(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select(
        "carried.doc_id", "source", "size", "source_size", "target", "taken")


def op4_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).drop("n_removed_words")


def op3_context_tree(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))


def op5_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op6_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("th")


#: URL rules (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op8_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), known_blocklist(spark), URL_RULES)


def op7_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_file("byte_bpe_50k.json"))


def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "carried.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_pii(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents"))
    strict = F.filter("spans", lambda s: s["base"])
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter(strict, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("carried.doc_id", *map(of_kind, KINDS), F.sha2(listed(strict).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def with_periods(docs: DataFrame) -> DataFrame:
    """The texts of the contract: from some word on, one document in ten repeats its next words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("w")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.col("w"), place(i).cast("int")))
    df = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    return df.select("doc_id", F.when(F.size("w") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    found = find_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "carried.doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES = {
    "op11_pii": op11_pii,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_resampling": op13_resampling,
    "op1_licenses": op1_licenses,
    "op10_classifier": op10_classifier,
    "op3_context_tree": op3_context_tree,
    "op5_top_k": op5_top_k,
    "op6_minhash": op6_minhash,
    "op8_url_filter": op8_url_filter,
    "op2_mixing": op2_mixing,
    "op7_packing": op7_packing,
    "op4_quality_rules": op4_quality_rules,
    "op9_suffix_dedup": op9_suffix_dedup,
}

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
a AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (SELECT *, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))
  ELSE CAST([] AS VARCHAR[]) END AS tri FROM a),
tw AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM
  (SELECT rid, unnest(tri) AS t, generate_subscripts(tri, 1) AS i FROM b)),
cov AS (SELECT rid, sum(least(3, coalesce(nx - i, 3))) AS n FROM
  (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM tw WHERE c > 1) GROUP BY rid),
ln AS (SELECT rid, source, text AS fam, unnest(ls) AS l FROM b),
nl AS (SELECT rid, source, fam, trim(regexp_replace(lower(l), '[^\p{L}\p{N}]+', ' ', 'g')) AS s,
  len(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS wc FROM ln),
fr AS (SELECT source, s FROM nl WHERE s <> '' GROUP BY source, s
  HAVING count(DISTINCT fam) > 20),
rm AS (SELECT rid, sum(wc) AS r FROM nl JOIN fr ON nl.source IS NOT DISTINCT FROM fr.source AND nl.s = fr.s GROUP BY rid),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(r, 0) AS r FROM b LEFT JOIN cov USING (rid) LEFT JOIN rm USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR n_repeat_words > 0.5 * n_words AS base_failed,
  NOT (n_words < 50 OR n_repeat_words > 0.5 * n_words) AND NOT (n_words - r < 0.2 * n_words) AS kept FROM o
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '-')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
l AS (SELECT (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lv
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(2.0 * source_size, w * (SELECT max(lv) FROM l)) AS target FROM s),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
v AS (SELECT *, CAST(floor(target - whole * source_size + 1e-6) AS BIGINT) AS r0 FROM u),
a0 AS (SELECT d.*, source_size, target, whole, r0 FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source),
a1 AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) <= r0 AS x1 FROM a0),
b1 AS (SELECT *, r0 - coalesce(sum(CASE WHEN x1 THEN size END) OVER (PARTITION BY source), 0) AS r1 FROM a1),
a2 AS (SELECT *, sum(CASE WHEN NOT x1 AND size <= r1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) <= r1
  AND NOT x1 AND size <= r1 AS x2 FROM b1),
b2 AS (SELECT *, r1 - coalesce(sum(CASE WHEN x2 THEN size END) OVER (PARTITION BY source), 0) AS r2 FROM a2),
a3 AS (SELECT *, sum(CASE WHEN NOT x1 AND NOT x2 AND size <= r2 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY h RANGE UNBOUNDED PRECEDING) <= r2
  AND NOT x1 AND NOT x2 AND size <= r2 AS x3 FROM b2)
SELECT doc_id, source, size, source_size, target, CAST((whole + CASE WHEN x1 OR x2 OR x3 THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM a3
"""


def _op1_sql() -> str:
    """The canonical form and the known texts, spelled out; copyright statements are judged line by line, as there is no look-ahead."""
    from veilwork.llm.licenses import NAMED_BY_ITS_HOLDER, RUNNING_WORDS, SPELLINGS, YEAR

    quote = lambda t: "'" + t.replace("'", "''") + "'"
    start = r"^[^a-z0-9\n]*"
    reserved = quote(start + r"all rights reserved\b")
    signed = quote(f"{start}(?:copyright[ \\t:,]*(?:\\(c\\)|©|{YEAR})|\\(c\\)[ \\t:,]*(?:copyright\\b|{YEAR})|©)")
    named = quote(start + r"copyright[ \t]+[<\[{]?\p{L}")
    running = quote(f"{start}copyright[ \\t]+(?:{RUNNING_WORDS})\\b")
    the, holder = quote(start + r"copyright[ \t]+the\b"), quote(start + r"copyright[ \t]+the[^\n]*" + NAMED_BY_ITS_HOLDER)

    def canonical(c: str) -> str:
        lines = f"""list_transform(string_split(lower({c}), chr(10)), lambda y: CASE WHEN regexp_matches(y, {reserved}) THEN regexp_replace(y, {reserved}, ' ')
 WHEN regexp_matches(y, {signed}) OR regexp_matches(y, {named}) AND NOT regexp_matches(y, {running})
  AND NOT (regexp_matches(y, {the}) AND NOT regexp_matches(y, {holder})) THEN ' ' ELSE y END)"""
        out = f"replace(regexp_replace(array_to_string({lines}, chr(10)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '- ', '-')"
        for a, b in SPELLINGS:
            out = f"regexp_replace({out}, {quote(a)}, {quote(b)}, 'g')"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    known = ", ".join(f"({quote(a)}, {quote(t)})" for a, t in dict.fromkeys(known_texts()))
    return f"""
WITH k AS (SELECT c, min(license) AS license FROM (SELECT license, {canonical('t')} AS c FROM (VALUES {known}) v(license, t)) WHERE c <> '' GROUP BY c),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, {canonical('text')} AS c FROM d),
l AS (SELECT rid, {canonical('x')} AS c FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d)),
n AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN k USING (c) GROUP BY rid)
SELECT doc_id, CASE WHEN c <> '' THEN md5(c) END AS digest, license, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, notices
FROM w LEFT JOIN k USING (c) LEFT JOIN n USING (rid)"""


OP5_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(e.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def _op8_sql() -> str:
    """Rules first, then the lines of the shipped list: a host with its subdomains, or a part of a host."""
    lines = [line.removeprefix("0.0.0.0 ") for file in sorted((Path(__file__).parent / "url_lists").glob("*.txt"))
             for line in file.read_text().splitlines() if not line.startswith("#")]
    listed = ", ".join("('{}', '{}{}')".format(host, slash, path) for host, slash, path in (line.partition("/") for line in lines))
    return rf"""
WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h0,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT page_id, path, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM p),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
b(bh, bp) AS (VALUES {listed}),
f AS (SELECT h.*, (SELECT max_by(struct_pack(rule := rh || rp, v := verdict), length(rh || rp)) FROM r
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS fit,
  EXISTS (SELECT 1 FROM b WHERE (host = bh OR ends_with(host, '.' || bh)) AND (bp = '' OR path = bp OR ends_with(bp, '/') AND starts_with(path, bp))) AS listed FROM h)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM f"""


ORACLE = {"op1_licenses": _op1_sql(), "op5_top_k": OP5_SQL, "op8_url_filter": _op8_sql(), "op2_mixing": OP2_SQL, "op4_quality_rules": OP4_SQL}
