"""Anonymisation: labels become surrogates, ignored phrases come back.

One scan finds every label and raw token of the row; the entity, the key and the surrogate
are worked out where the label stands.  Nothing is shuffled and no state is kept, but for phrase
files beyond ``INLINE_LIMIT`` lines: there a draw is a number, and numbered phrases join the rows that drew them.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.functions import marks as M
from veilwork.functions.draws import Draws, LongList, surrogate
from veilwork.functions.text import TAG
from veilwork.operators.numbering import null_safe_join
from veilwork.rules import dialect
from veilwork.rules.ruleset import RuleSet, kind_of

RESTORE = "restoreentitytext"


def label_owners(rules: RuleSet, entities: list[str]) -> dict[str, str]:
    """F1/F16/L3: label name -> entity; the first entity in order which lists a name owns it."""
    aliases, owners = rules.aliases(), {}
    for entity in entities:
        for name in aliases.get(entity, []):
            owners.setdefault(name, entity)
    return owners


def anonymize(df: DataFrame, rules: RuleSet, modality: str = "text", level=4, seed=None,
              text: str = "text", conversation: str = "conversation_id",
              row_id: str = "row_id") -> DataFrame:
    """Replace labels by surrogates.  Without a seed every run draws its own."""
    seed = uuid.uuid4().hex if seed is None else str(seed)
    blocks, tables = {}, []
    for entity in rules.anonymization_order(level, True):
        block = rules.block(entity, "anonymizer")
        if block and kind_of(block["model-class"]) != RESTORE:
            blocks[entity] = resolve_lists(block, rules, modality, df.sparkSession, tables)
    owners = label_owners(rules, list(blocks))
    tokens = {e: t for e, t in rules.tokens().items() if e in blocks}
    if not owners and not tokens:
        return df

    if tables:
        df = df.withColumn(text, M.guard_input(F.col(text)))
    names = "|".join(re.escape(n) for n in sorted(owners, key=len, reverse=True))
    pattern = rf"\[({names})(?:-\d+)?\]" if names else r"(\b\B)"
    marks = f"{M.OPEN}$0{M.MID}$1"
    for i, found in enumerate(tokens.values()):
        java = dialect.to_java(dialect.alternation(found), "")[0]
        pattern += f"|(?<tk{i}>{java})"
        marks += f"{M.MID}${{tk{i}}}"
    df = df.withColumn("__marked", F.regexp_replace(F.col(text), F.lit("(?dU)" + pattern), F.lit(marks + M.CLOSE)))

    # In the fold over the hits: f holds [tag, label name, token of entity 0, token of entity 1, ...].
    f = f"split({M.head('p')}, '{M.MID}')"
    owner_map = ", ".join(f"{M.quote(n)}, {M.quote(e)}" for n, e in owners.items())
    entity = f"CASE WHEN h.f[1] != '' THEN map({owner_map})[h.f[1]] " if names else "CASE "
    for i, e in enumerate(tokens):
        entity += f"WHEN h.f[{i + 2}] != '' THEN {M.quote(e)} "
    entity += "END"
    tag = "h.f[0]"
    fixed = f"concat_ws('|', {M.quote(seed)}, cast({conversation} AS string), "
    same = fixed + f"regexp_extract({tag}, {M.quote(TAG)}, 1), regexp_extract({tag}, {M.quote(TAG)}, 2))"
    fresh = fixed + f"{tag}, cast({row_id} AS string), cast(h.i AS string))"
    once = [e for e, b in blocks.items() if b.get("persist", True)]
    keeps = f"h.e IN ({', '.join(map(M.quote, once)) or 'NULL'}) AND contains({tag}, '-')"
    cases = " ".join(
        f"WHEN {M.quote(e)} THEN {surrogate(kind_of(b['model-class']), b, modality, Draws('h.key'))}"
        for e, b in blocks.items())
    hits = (f"transform({M.pieces('__parts')}, (p, i) -> struct({f} AS f, {M.tail('p')} AS rest, i AS i))")
    named = f"transform({hits}, h -> struct(h.f, h.rest, h.i, {entity} AS e))"
    keyed = f"transform({named}, h -> struct(h.rest, h.e, CASE WHEN {keeps} THEN {same} ELSE {fresh} END AS key))"
    filled = f"transform({keyed}, h -> concat(CASE h.e {cases} END, h.rest))"
    out = (df.withColumn("__parts", F.expr(f"CASE WHEN contains(__marked, '{M.OPEN}') THEN split(__marked, '{M.OPEN}') END"))
              .withColumn(text, F.expr(f"CASE WHEN size(__parts) > 1 THEN concat(__parts[0], "
                                       f"array_join({filled}, '')) ELSE {text} END"))
              .drop("__marked", "__parts"))
    return fill_phrases(out, tables, text, row_id) if tables else out


def fill_phrases(df: DataFrame, tables: list[DataFrame], text: str, row_id: str) -> DataFrame:
    """the drawn numbers of long lists as their phrases.  Only rows that drew one are shuffled.

    ``tables`` hold ``(ix, phrase)``.  The distinct draws of a block of rows meet the phrases, so a draw that a busy
    conversation repeats is no hot key.
    """
    from functools import reduce
    from veilwork.plans.redaction import keep_once
    df = keep_once(df)
    listed = reduce(DataFrame.unionByName, [t.select(F.lit(i).alias("list"), "ix", "phrase") for i, t in enumerate(tables)])
    has = F.coalesce(F.contains(F.col(text), F.lit(M.OPEN)), F.lit(False))
    ref = rf"{M.OPEN}(\d+{M.MID}\d+){M.CLOSE}"
    used = df.where(has).select(row_id, F.floor(F.col(row_id) / 50_000).alias("block"), F.explode(F.array_distinct(
        F.regexp_extract_all(F.col(text), F.lit(ref), F.lit(1)))).alias("ref"))
    # numbers meet, not texts: the longer side is the list
    values = used.select("block", "ref").distinct().withColumns({
        "list": F.substring_index("ref", M.MID, 1).cast("int"), "ix": F.substring_index("ref", M.MID, -1).cast("bigint")})
    values = values.join(listed, ["list", "ix"]).select("block", "ref", "phrase")
    per_row = used.join(values, ["block", "ref"]).groupBy(row_id).agg(
        F.map_from_entries(F.collect_list(F.struct("ref", "phrase"))).alias("__drawn"))
    filled = M.rejoin(f"split(`{text}`, '{M.OPEN}')", f"p -> concat(__drawn[{M.head('p')}], {M.tail('p')})")
    out = df.where(has).join(per_row, row_id, "left").withColumn(text, F.expr(filled)).drop("__drawn")
    return out.select(*df.columns).unionByName(df.where(~has))


def numbered_phrases(phrases: DataFrame) -> tuple[DataFrame, int]:
    """``(ix, phrase)``, numbered from 0 by the text of the phrase, and how many there are; never collected.

    One sort by range, written once: a row's number is its place in its part and the rows of the parts before, of which the
    driver gets one count a part.  A phrase that comes often is spread over parts, as equal phrases may stand in any order.
    """
    from veilwork.plans.redaction import keep_once
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("smallint")
    rows = phrases.select("phrase", spread.alias("__s")).repartitionByRange("phrase", "__s").sortWithinPartitions("phrase")
    rows = keep_once(rows.select(F.monotonically_increasing_id().alias("__at"), "phrase"))
    part = F.shiftright("__at", 33)
    counts = sorted(map(tuple, rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()))
    starts, size = [], 0
    for number, n in counts:                                 # a row per part
        starts.append((number, size))
        size += n
    if not starts:
        return rows.select(F.col("__at").alias("ix"), "phrase"), 0
    starts = F.broadcast(phrases.sparkSession.createDataFrame(starts, "part bigint, __start bigint"))
    place = F.col("__at").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("part", part).join(starts, "part").select((F.col("__start") + place).alias("ix"), "phrase"), size


def resolve_lists(block: dict, rules: RuleSet, modality: str, spark, tables: list | None = None) -> dict:
    """Pattern ids and phrase files of a generator block as plain lists; long files are added to ``tables``."""
    from veilwork.sources.phrases import rule_phrases
    params = block.get(modality)
    if params is None:
        return block
    if kind_of(block["model-class"]) == "regex":
        return {**block, modality: {**params, "regex": rules.patterns_in(params)}}
    many = params if isinstance(params, list) else [params]
    if all("phrase-list" in p or "phrase-filename" in p for p in many):
        lists = []
        for p in many:
            phrases = rule_phrases(p, spark, whole=True)
            if isinstance(phrases, DataFrame) and tables is not None and not (kind_of(block["model-class"]) == "zipc" and modality != "text"):
                table, size = numbered_phrases(phrases)
                phrases = LongList(len(tables), size)
                tables.append(table)
            elif isinstance(phrases, DataFrame):      # a list that has to be spelled out in words
                phrases = [r.phrase for r in phrases.collect()]
            lists.append({"phrase-list": phrases})
        return {**block, modality: lists}
    return block


def restore(df: DataFrame, log: DataFrame, entity="_IGNORE_", text: str = "text",
            row_id: str = "row_id", by_conversation: bool = True) -> DataFrame:
    """Put the logged text back in place of ``[entity-n]``; one entity or a list.

    Only rows with such a label are shuffled.  A label without a log entry stays.
    """
    names = "|".join(re.escape(e) for e in ([entity] if isinstance(entity, str) else entity))
    label = rf"\[((?:{names})-\d+)\]"
    has = F.coalesce(F.rlike(F.col(text), F.lit(label)), F.lit(False))
    keys = (["conversation_id"] if by_conversation else []) + ["label"]
    # A label that is logged twice has the value that was written first.
    written = F.col("seq") if "seq" in log.columns else F.monotonically_increasing_id()
    log = (log.where(F.rlike("label", F.lit(f"^(?:{names})-"))).select(*keys, "value", written.alias("seq"))
           .groupBy(*keys).agg(F.min_by("value", "seq").alias("value")))
    rows = df.where(has)
    used = (rows.select(row_id, *keys[:-1], F.explode(F.array_distinct(
        F.regexp_extract_all(F.col(text), F.lit(label), F.lit(1)))).alias("label")))
    # The distinct labels of a block of rows meet the log, so a busy conversation is no hot key.
    used = used.withColumn("block", F.floor(F.col(row_id) / 50_000))
    values = null_safe_join(used.select("block", *keys).distinct(), log, keys)
    per_row = (null_safe_join(used, values, ["block", *keys]).groupBy(row_id)
               .agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("__log")))
    out = rows.join(per_row, row_id, "left").withColumn(
        "__marked", F.regexp_replace(F.col(text), F.lit(label), F.lit(f"{M.OPEN}$1{M.CLOSE}")))
    fill = f"p -> concat(coalesce(__log[{M.head('p')}], concat('[', {M.head('p')}, ']')), {M.tail('p')})"
    split = "split(__marked, '%s')" % M.OPEN
    return (out.withColumn(text, F.expr(M.rejoin(split, fill))).drop("__marked", "__log")
               .unionByName(df.where(~has)))
