r"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. One pass over a text cuts out the zones that can hold personal data: runs of digits and their separators (seven digits or a
   dotted quad), runs around an @, spelled addresses, colon groups.  Every pattern starts at the edge of a run and takes it whole, so
   the work is linear in the text.  Zones travel on by themselves, a few per document; texts don't.
2. High-recall generators (`GENERATORS`) propose spans inside each zone; they overlap.
3. Boosted trees (`boosting`) score a candidate by whole-number features of its format and context.  They learn from examples made
   of `SHAPES` in known contexts, and from the candidates of the documents that the strict formats confirm.
4. Held-out examples set a threshold per kind: the least score at which `precision` of the examples above it are right.
5. Strict hits (`base`) always stay.  A chosen candidate is added unless another span covers it.

Strict formats (leftmost, one after the other, per kind; hits that fail the test are dropped without another try): an address with a dot
in its domain; dotted quads with parts up to 255; 12 to 19 digits, single blanks or hyphens between, that pass the Luhn test; a plus
sign and 9 to 15 digits with blanks, brackets, dots and hyphens.

Edge cases: null and empty texts have no spans; each row is a document, also with a repeated or null id; a number of any length and a
text of any length is handled whole; an empty table gives an empty result, and documents without any confirmed hit leave only the
made examples to learn from.  Input columns are carried only if named, in the struct `carried`, so their names can't clash.
Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.functions.marks import quote
from veilwork.llm.boosting import Model, fit
from veilwork.llm.common import Store

KINDS = ["email", "ip", "card", "phone"]
_NAME = r"[A-Za-z0-9._%+-]"
_HOST = r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_AT_SPELLED = r" ?[(\[{<] ?(?i:at|@) ?[)\]}>] ?"
_DOT_SPELLED = r"(?: ?[(\[{<] ?(?i:dot|\.) ?[)\]}>] ?| (?i:dot) )"
_PART = r"[A-Za-z0-9-]{1,63}+"

#: Zones of the text: (pattern, test that lets a row leave early).
ZONES = {
    "number": (r"[+(]?[0-9](?:[ ().+-]*+[0-9]){6,}+|[0-9]++(?:\.[0-9]++){3}",
               r"[0-9](?:[ ().+-]*+[0-9]){6}|[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "at": (rf"(?<![A-Za-z0-9._%+@-]){_NAME}*+@[A-Za-z0-9._%+@-]*+", "@"),
    "spelled": (rf"(?<!{_NAME})[A-Za-z0-9]{_NAME}{{0,63}}+(?:{_AT_SPELLED}{_PART}(?:(?:{_DOT_SPELLED}|\.){_PART})++"
                rf"| (?i:at) {_PART}(?:{_DOT_SPELLED}{_PART})++|(?: @ ?|@ ){_PART}(?:\.{_PART})++)",
                r"(?i)[(\[{<] ?(?:at|@) ?[)\]}>]| dot | @|@ "),
    "colons": (r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r":[0-9A-Fa-f]{0,4}:"),
}
#: (kind, zone, pattern in the zone); the first four are the strict formats, '' is the whole zone.
GENERATORS = [
    ("email", "at", rf"(?:\G|(?<!{_NAME})){_NAME}++@{_HOST}"),
    ("ip", "number", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "number", r"[0-9](?:[ -]?+[0-9])++"),
    ("phone", "number", r"\+[0-9](?:[ ().-]*+[0-9])++"),
    ("card", "number", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", "number", r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){2}[ .-][0-9]{1,7}(?![0-9])"),
    ("card", "number", r"(?<![0-9])[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{4,5}(?![0-9])"),
    ("phone", "number", r"(?:\+?(?<![0-9])1[ .-]?)?(?:\((?:[0-9]{3})\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone", "number", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}+(?![0-9])"),
    ("phone", "number", r"(?<![0-9])00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,8}){2,5}+(?![0-9])"),
    ("phone", "number", r"(?:\(|(?<![0-9]))0[0-9]{2,4}(?:\) ?|[ -])[0-9]{3,4}[ -]?[0-9]{3,5}(?![0-9])"),
    ("phone", "number", r"(?<![0-9])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
    ("email", "spelled", ""),
    ("ip", "colons", ""),
]
#: Words before a value that speak for its kind, and words that speak for a number of another sort.
WORDS = {"email": "e-?mail|mail|write to|contact|correo|courriel", "ip": "ip|address|server|host|adresse|from",
         "card": "card|visa|mastercard|amex|pay with|karte|tarjeta|carte", "phone": "call|phone|tel|mobile|fax|telefon|me at|teléfono"}
OTHER_WORDS = ("order|invoice|isbn|ref|reference|id|version|tracking number|serial|sku|page|price|total|no|nr|code|time|clock|years?")
FEATURES = ["kind_no", "least_gen", "n_gens", "digits", "others", "letters", "first", "distinct_digits", "longest", "lead", "before",
            "after", "luhn", "own_words", "other_words", "dots", "last_part", "years"]

#: Made examples: kind, whether it is personal, shape (9 a digit, ~ a letter, ^ a hexadecimal digit), contexts (n plain, k own
#: words, o other words).
SHAPES = [
    ("email", 1, "~~~~.~~~~~@~~~~~.com", "nk"), ("email", 1, "~~~~~9@~~~~.~~", "nk"), ("email", 1, "~~~.99@~~~~9.~~~~~~~.com", "nk"),
    ("email", 1, "~~~~ (at) ~~~~~ (dot) com", "nk"), ("email", 1, "~~~~.~~~~ [at] ~~~~~.org", "nk"),
    ("email", 1, "~~~~~9 at ~~~~~~ dot com", "nk"), ("email", 1, "~~~~~ @ ~~~~~.com", "nk"),
    ("email", 0, "~~~~ at ~~~ dot ~~~~~~~~", "n"), ("email", 0, "~~~~ at ~~~ dot ~~~~~~", "n"), ("email", 0, "~~~~~ at ~ dot ~~~~~", "n"), ("email", 0, "~~~~~~ @ 9.99", "no"), ("email", 0, "~~~ @ 99.99", "no"),
    ("ip", 1, "199.19.9.199", "nk"), ("ip", 1, "99.199.19.9", "nk"), ("ip", 1, "^^^^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^", "nk"),
    ("ip", 1, "2001:db8::^^^^:^^^^", "nk"), ("ip", 1, "fe80::^^^^:^^^^", "nk"),
    ("ip", 0, "19:59:59", "no"), ("ip", 0, "9:59:59", "no"), ("ip", 0, "99:59:59", "no"), ("ip", 0, "9:9:9", "no"),
    ("card", 1, "4999999999999999", "nk"), ("card", 1, "5999 9999 9999 9999", "nk"), ("card", 1, "4999-9999-9999-9999", "nk"),
    ("card", 1, "4999.9999.9999.9999", "nk"), ("card", 1, "3799 999999 99999", "nk"), ("card", 1, "9999999999999999", "nk"),
    ("card", 0, "9999999999999999", "o"), ("card", 0, "999999999999", "no"), ("card", 0, "~9999999999999999~", "no"),
    ("card", 0, "^^^^9999999999999^^^", "no"), ("card", 0, "~~99999999999999~~", "no"), ("card", 0, "1699999999999", "no"),
    ("card", 0, "0.9999999999999999", "no"), ("card", 0, "978-9-99-999999-9", "no"), ("card", 0, "99 999 999 999 999", "no"),
    ("card", 0, "9999999999999", "no"), ("card", 0, "9999 9999 9999", "no"), ("card", 0, "99999999999999999", "no"),
    ("card", 0, "1999 1999 2009 2019", "no"), ("card", 0, "2009 2019 2019 2029", "no"), ("card", 0, "1999-2009-2019-2029", "no"),
    ("card", 0, "99 99 99 99 99 99 99", "no"), ("card", 0, "9 9 9 9 9 9 9 9 9 9 9 9 9", "no"), ("card", 0, "999 999 999 999 999", "no"),
    ("phone", 1, "+1 (999) 999-9999", "nk"), ("phone", 1, "(999) 999-9999", "nk"), ("phone", 1, "999-999-9999", "nk"),
    ("phone", 1, "999.999.9999", "nk"), ("phone", 1, "999 999 9999", "k"), ("phone", 1, "+49 99 9999999", "nk"),
    ("phone", 1, "0049 99 9999999", "nk"), ("phone", 1, "099 9999 9999", "k"), ("phone", 1, "(099) 9999 999", "nk"),
    ("phone", 1, "999-9999", "k"), ("phone", 1, "+9 (999) 999-9999 199.19.99.9", "n"),
    ("phone", 0, "999-9999", "no"), ("phone", 0, "999.9999", "no"), ("phone", 0, "999 999 9999", "no"), ("phone", 0, "099 9999 9999", "o"),
    ("phone", 0, "999-999-9999", "o"), ("phone", 0, "~999-999-9999", "no"), ("phone", 0, "999.999.9999", "o"),
    ("phone", 0, "0099 9999 9999", "o"), ("phone", 0, "999-9999-9999", "no"),
    ("phone", 0, "9 999 999 9999", "no"), ("phone", 0, "9 000 000 000", "no"), ("phone", 0, "9 999 000 000", "no"),
]
#: Contexts of made examples: before and after.
BEFORE = {"n": ["", "the ", "it was ", "of this. ", "in der ", "que la ", "and, ", "line\n", "(", "est \"", "see "],
          "email": ["email: ", "my mail is ", "write to ", "contact ", "e-mail "], "ip": ["ip ", "address ", "server ", "host: ", "from "],
          "card": ["card ", "visa ", "credit card: ", "pay with ", "karte "], "phone": ["call ", "phone: ", "tel. ", "mobile ", "call me at "],
          "o": ["order ", "order no. ", "invoice ", "isbn ", "ref: ", "id ", "version ", "tracking number ", "serial ", "total ", "code="]}
AFTER = ["", ".", ", and", " and then", "\nnext", ") of", " der ", " the", "; "]


# ---- zones and candidates
def _pieces(text: str, pattern: str, make: str) -> str:
    """SQL: `make` for each hit v (number i) of the pattern in the text, with the pieces p around the hits."""
    q = quote(pattern)
    return (f"transform(array(split({text}, {q}, -1)), p -> transform(regexp_extract_all({text}, {q}, 0), (v, i) -> {make}))[0]")


def zones(text: str = "text") -> Column:
    """Array of zone, i, gap (characters since the zone before), hit, before and after (text around it)."""
    kind = "array<struct<zone:string,i:int,gap:int,hit:string,before:string,after:string>>"
    parts = []
    for name, (pattern, gate) in ZONES.items():
        test = f"contains({text}, '@')" if gate == "@" else f"{text} RLIKE {quote(gate)}"
        make = (f"named_struct('zone', '{name}', 'i', i, 'gap', length(p[i]), 'hit', v, 'before', right(p[i], 32), 'after', left(p[i + 1], 16))")
        parts.append(f"CASE WHEN {test} THEN {_pieces(text, pattern, make)} ELSE CAST(array() AS {kind}) END")
    return F.expr(f"concat({', '.join(parts)})").cast(kind)


def candidates(rows: DataFrame, *others: str) -> DataFrame:
    """rid, others, kind, start, end, value, before, after, gen of the spans the generators propose; `rows` has rid and zones."""
    z = rows.selectExpr("rid", *others, "inline(zones)")
    by = W.partitionBy("rid", "zone").orderBy("i")
    z = z.withColumn("at", F.sum(F.expr("gap + length(hit)")).over(by) - F.length("hit"))
    made = []
    for number, (kind, zone, pattern) in enumerate(GENERATORS):
        make = f"named_struct('gen', {number}, 'kind', '{kind}', 'j', %s, 'skip', %s, 'value', %s)"
        found = (_pieces("hit", pattern, make % ("i", "length(p[i])", "v")) if pattern else f"array({make % ('0', '0', 'hit')})")
        made.append(f"CASE WHEN zone = '{zone}' THEN {found} ELSE array() END")
    c = z.selectExpr("rid", *others, "zone", "i", "at", "hit", "before", "after", f"inline(concat({', '.join(made)}))")
    inside = W.partitionBy("rid", "zone", "i", "gen").orderBy("j")
    c = c.withColumn("offset", F.sum(F.expr("skip + length(value)")).over(inside) - F.length("value"))
    c = c.withColumn("digit", F.regexp_replace("value", "[^0-9]", "")).withColumn("digits", F.length("digit"))
    fits = """CASE kind WHEN 'card' THEN digits BETWEEN 12 AND 19 WHEN 'phone' THEN digits BETWEEN 7 AND 15 AND (gen > 3 OR digits >= 9)
              WHEN 'ip' THEN zone = 'colons' OR forall(split(value, '[.]'), x -> coalesce(try_cast(right(trim(LEADING '0' FROM x), 4) AS int), 0) <= 255
                AND length(trim(LEADING '0' FROM x)) <= 3) ELSE true END"""
    c = c.where(F.expr(fits)).withColumn("luhn", F.expr(
        """CASE WHEN kind = 'card' THEN int(aggregate(transform(split(reverse(digit), ''), (c, k) -> coalesce(try_cast(c AS int), 0) * (1 + k % 2)),
             0L, (a, x) -> a + x % 10 + x div 10) % 10 = 0) ELSE 0 END"""))
    return c.select(
        "rid", *others, "kind", (F.col("at") + F.col("offset")).cast("long").alias("start"),
        (F.col("at") + F.col("offset") + F.length("value")).cast("long").alias("end"), "gen", "value", "digit", "digits", "luhn",
        F.expr("CASE WHEN offset = 0 THEN right(before, 1) ELSE substr(hit, offset, 1) END").alias("left_char"),
        F.expr("CASE WHEN offset + length(value) = length(hit) THEN left(after, 1) ELSE substr(hit, offset + length(value) + 1, 1) END").alias("right_char"),
        F.expr("lower(CASE WHEN offset < 12 THEN before ELSE '' END)").alias("context"),
        F.expr("gen < 4 AND (kind <> 'card' OR luhn = 1)").alias("base"))


def featured(c: DataFrame, *others: str) -> DataFrame:
    """One row per rid, kind and span, with whether it is a strict hit and the feature columns, all small whole numbers."""
    side = lambda x: (f"CASE WHEN {x} = '' OR {x} RLIKE '\\\\s' THEN 0 WHEN {x} RLIKE '\\\\p{{L}}' THEN 1 WHEN {x} RLIKE '[0-9]' THEN 2 "  # noqa: E731
                      f"WHEN {x} RLIKE '[(\\\\[<\"\\':;,)\\\\]>]' THEN 3 WHEN {x} RLIKE '[=#$€£_%&*]' THEN 4 ELSE 5 END")
    own = " ".join(f"WHEN '{k}' THEN context RLIKE {quote(chr(92) + 'b(?:' + w + ')' + chr(92) + 'b[^0-9]{0,14}$')}" for k, w in WORDS.items())
    other = quote(rf"\b(?:{OTHER_WORDS})\b[^0-9]{{0,14}}$")
    c = c.groupBy("rid", *others, "kind", "start", "end").agg(
        F.max("base").alias("base"), F.min("gen").alias("least_gen"), F.countDistinct("gen").cast("int").alias("n_gens"),
        *[F.min(x).alias(x) for x in ("value", "digit", "digits", "luhn", "left_char", "right_char", "context")])
    return c.selectExpr(
        "rid", *others, "kind", "start", "end", "base", "least_gen", "n_gens", "luhn",
        f"int(array_position(array({', '.join(map(quote, KINDS))}), kind) - 1) AS kind_no", "least(digits, 40) AS digits",
        "least(length(value) - digits, 20) AS others", "least(length(regexp_replace(value, '[^A-Za-z]', '')), 20) AS letters",
        "coalesce(try_cast(left(digit, 1) AS int), 10) AS first", "int(least(size(array_distinct(split(digit, ''))), 11)) AS distinct_digits",
        "least(array_max(transform(split(value, '[^0-9]+'), x -> length(x))), 20) AS longest",
        "CASE WHEN value LIKE '+%' THEN 1 WHEN value LIKE '(%' THEN 2 WHEN value LIKE '00%' THEN 3 WHEN value LIKE '0%' THEN 4 ELSE 0 END AS lead",
        f"{side('left_char')} AS before", f"{side('right_char')} AS after",
        f"int(CASE kind {own} ELSE false END) AS own_words", f"int(context RLIKE {other} OR left_char = '=') AS other_words",
        "least(length(value) - length(replace(value, '.', '')), 5) AS dots",
        "CASE WHEN kind = 'email' THEN least(length(regexp_extract(value, '[A-Za-z]*$', 0)), 12) ELSE 0 END AS last_part",
        "least(size(filter(split(value, '[^0-9]+'), x -> x RLIKE '^(19|20)[0-9][0-9]$')), 4) AS years")


# ---- learning
def made_examples(spark: SparkSession, n: int) -> DataFrame:
    """rid, want (kind), good, want_start, want_end, zones: `n` texts of known shapes and contexts."""
    literal = lambda rows: f"array({', '.join(rows)})"
    shapes = literal([f"named_struct('want', '{k}', 'good', {g}, 'shape', {quote(s)}, 'way', '{c}')" for k, g, s, ways in SHAPES for c in ways])
    lists = literal([f"array({', '.join(map(quote, v))})" for v in BEFORE.values()])
    names = literal([quote(k) for k in BEFORE])
    draw = lambda k, n: f"int(pmod(xxhash64(id, {k}), {n}))"
    df = spark.range(n).selectExpr("id AS rid", "id", f"element_at({shapes}, 1 + int(id % {len([1 for *_, w in SHAPES for c in w])})) AS s")
    df = df.selectExpr("rid", "id", "s.want", "s.good", "s.shape", f"element_at({lists}, int(array_position({names}, IF(s.way = 'k', s.want, s.way)))) AS heads")
    sign = (f"CASE c WHEN '9' THEN string({draw('k + 10', 10)}) WHEN '~' THEN chr(97 + {draw('k + 10', 26)}) "
            f"WHEN '^' THEN lower(hex({draw('k + 10', 16)})) ELSE c END")
    df = df.selectExpr("rid", "want", "good", f"element_at(heads, 1 + {draw('1', 'size(heads)')}) AS head",
                       f"array_join(transform(split(shape, ''), (c, k) -> {sign}), '') AS value",
                       f"element_at(array({', '.join(map(quote, AFTER))}), 1 + {draw('2', len(AFTER))}) AS tail")
    df = df.withColumn("text", F.concat("head", "value", "tail"))
    return df.select("rid", "want", "good", F.length("head").alias("want_start"),
                     # the phone number in front of another number is the example, not both
                     (F.length("head") + F.length(F.regexp_replace("value", r"(?<=\d{4}) 1\d\d\..*$", ""))).alias("want_end"), zones().alias("zones"))


def labelled(examples: DataFrame) -> DataFrame:
    """Candidates of the made examples with label and weight; parts of a personal value are neither right nor wrong."""
    keep = ["want", "good", "want_start", "want_end"]
    c = featured(candidates(examples, *keep), *keep)
    exact = (F.col("kind") == F.col("want")) & (F.col("start") == F.col("want_start")) & (F.col("end") == F.col("want_end"))
    right = (F.col("good") == 1) & exact
    c = c.where((F.col("good") == 0) | exact).withColumn("label", right.cast("int"))
    # seven of ten real card numbers pass the test, one of ten drawn ones does
    luhn = F.when(F.col("luhn") == 1, 7.0).otherwise(1 / 3)
    return c.withColumn("weight", F.when(right & (F.col("kind") == "card"), luhn).otherwise(F.lit(1.0)))


def learn(confirmed: DataFrame, store: Store, n_examples: int = 12_000, share: float = 0.25, precision: float = 0.9,
          max_vectors: int = 100_000) -> tuple[Model, dict[str, float]]:
    """The model, and a threshold for each kind.

    `confirmed` are featured candidates; they weigh `share` of the made examples together.  Vectors beyond `max_vectors`
    distinct ones, the lightest first, aren't learned from.
    """
    examples = store.keep(labelled(made_examples(store.spark, n_examples)).withColumn("held", F.col("rid") % 5 == 0), "examples")
    own = store.keep(confirmed.groupBy(*FEATURES).count(), "confirmed")
    total = own.agg(F.sum("count")).first()[0] or 0
    scale = share * n_examples / max(total, 1)
    vectors = examples.where("NOT held").select(*FEATURES, (F.col("weight") * F.col("label")).alias("pos"), (F.col("weight") * (1 - F.col("label"))).alias("neg"))
    vectors = vectors.unionByName(own.select(*FEATURES, (F.col("count") * scale).alias("pos"), F.lit(0.0).alias("neg")))
    vectors = vectors.groupBy(*FEATURES).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    model = fit(store.keep(vectors.orderBy((F.col("pos") + F.col("neg")).desc(), *FEATURES).limit(max_vectors), "vectors"), FEATURES)
    steps = 50
    held = examples.where("held").select("kind", "label", "weight", F.floor(model.probability() * steps).alias("step"))
    hits: dict = {k: {} for k in KINDS}
    for r in held.groupBy("kind", "step").agg(F.sum(F.col("weight") * F.col("label")).alias("pos"), F.sum("weight").alias("all")).collect():
        hits[r["kind"]][r["step"]] = (r["pos"], r["all"])
    out = {}
    for kind, found in hits.items():
        pos = every = 0.0
        out[kind] = 0.5
        for step in sorted(found, reverse=True):
            pos, every = pos + found[step][0], every + found[step][1]
            if pos >= precision * every:
                out[kind] = step / steps
    return model, out


# ---- the operator
def personal_data(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text: str = "text", n_examples: int = 12_000,
                  precision: float = 0.9) -> DataFrame:
    """Struct `carried`, spans (array of start, kind_no, kind, end, base, score; by start, then kind as in `KINDS`)."""
    store = Store(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = store.keep(rows.select("carried", zones().alias("zones"), F.monotonically_increasing_id().alias("rid")), "zones")
    found = store.keep(featured(candidates(rows.where(F.size("zones") > 0).select("rid", "zones"))), "candidates")
    model, least = learn(found.where("base"), store, n_examples, precision=precision)
    limit = F.element_at(F.create_map(*[F.lit(x) for k, v in least.items() for x in (k, v)]), F.col("kind"))
    chosen = found.withColumn("score", F.when(F.col("base"), F.lit(1.0)).otherwise(F.round(model.probability(), 6))).where(F.col("score") >= limit)
    order = W.partitionBy("rid").orderBy("start", F.col("end").desc(), F.col("base").desc(), "kind_no")
    covered = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)) >= F.col("end"), F.lit(False))
    spans = (chosen.withColumn("covered", covered).where(F.col("base") | ~F.col("covered")).groupBy("rid")
             .agg(F.array_sort(F.collect_list(F.struct("start", "kind_no", "kind", "end", "base", "score"))).alias("spans")))
    none = F.array().cast(spans.schema["spans"].dataType)
    some = rows.where(F.size("zones") > 0).select("rid", "carried").join(spans, "rid", "left")
    return some.select("carried", F.coalesce("spans", none).alias("spans")).unionByName(
        rows.where(F.size("zones") == 0).select("carried", none.alias("spans")))
