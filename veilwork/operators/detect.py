"""Detection: ordered rules over one text column, all inside the row (no shuffle).

Each rule adds three narrow projections: mark the hits with one regex pass, settle which
hits stay (labels of earlier rules are protected; looked at only where the text has a
bracket), and put placeholders where the hits were.  Rows without a hit leave the rule
after the regex pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.functions import marks as M
from veilwork.rules.ruleset import Detector

OCC = "occ"


def detect(df: DataFrame, detectors: list[Detector], text: str = "text", row_id: str = "row_id",
           span_source=None) -> DataFrame:
    """Run the detectors in order; adds ``occ``, the row's hits in creation order.

    ``span_source`` serves the model rule: either a function ``Column -> Column`` giving
    sorted ``array<struct<start:int,end:int,label:string>>`` for the text after the earlier
    rules (a pandas UDF around a model, for instance), or a frame
    ``(row_id, start, end, label)``.
    """
    df = df.withColumns({text: M.guard_input(F.col(text)), OCC: F.array().cast(M.OCC_TYPE)})
    for d in detectors:
        if d.kind != "spans" or span_source is not None:
            df = run_detector(df, d, text, row_id, span_source)
    return df.drop("__marked", "__parts", "__gate")


def run_detector(df: DataFrame, d: Detector, text: str, row_id: str, span_source=None) -> DataFrame:
    if d.kind == "tokens":
        return run_tokens(df, d, text)
    label = d.label if d.kind == "pattern" else None       # None: each hit names its own
    if d.kind == "pattern":
        df = _mark_pattern(df, d, text)
    else:
        df = _mark_spans(df, d, text, row_id, span_source)
    df = df.withColumn("__parts", M.settled_parts(text, "__marked", label is None))
    new_text = F.expr(M.splice(text, "__parts", f"size({OCC})", label))
    if d.kind == "spans":
        new_text = F.replace(new_text, F.lit("$"), F.lit(""))          # D14
    return df.withColumns({text: new_text, OCC: M.append_hits(OCC, "__parts", d.rule_ix, label)})


def run_tokens(df: DataFrame, d: Detector, text: str) -> DataFrame:
    """A whole token map in one regex pass; numbers run label by label, as its labels are listed."""
    labels = d.params["labels"]
    first, named = M.mark_branches(F.col(text), d.pattern, labels, "__marked")
    df = df.withColumn("__marked", first).withColumn("__marked", named)
    df = df.withColumn("__parts", M.settled_parts(text, "__marked", True))
    new_text = F.expr(M.splice_by_label(text, "__parts", f"size({OCC})", labels))
    return df.withColumns({text: new_text, OCC: M.append_by_label(OCC, "__parts", d.rule_ix, labels)})


def _mark_pattern(df: DataFrame, d: Detector, text: str) -> DataFrame:
    t = F.col(text)
    marked = (M.mark_group_raw(t, d.pattern, d.group, d.lead_groups) if d.group
              else M.mark_whole(t, d.pattern))
    if d.needs:
        marked = F.when(F.contains(t, F.lit(d.needs)), marked).otherwise(t)
    if "gate" in d.params:                  # C9: one look at the row decides for all labels of the map
        if d.params["opens"]:
            df = df.withColumn("__gate", F.rlike(t, F.lit(d.params["gate"])))
        marked = F.when(F.col("__gate"), marked).otherwise(t)
    df = df.withColumn("__marked", marked)
    return df.withColumn("__marked", M.mark_group("__marked")) if d.group else df


def _mark_spans(df: DataFrame, d: Detector, text: str, row_id: str, span_source) -> DataFrame:
    # A placeholder is shown with digits in place of its two noncharacters: a label of the
    # same length, so offsets stay valid.
    shown = F.translate(F.col(text), M.PH_L + M.PH_R, "00")
    if d.kind == "custom":
        df = df.withColumn("__spans", F.transform(d.params["fn"](shown, d.params), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(d.label).alias("label"))))
    elif d.kind == "phrase_table":
        from veilwork.operators.phrases import phrase_spans
        found = phrase_spans(df.select(row_id, shown.alias(text)), d.params["table"], row_id, text)
        df = attach_spans(df, found.withColumn("label", F.lit(d.label)), row_id)
    else:
        df = (attach_spans(df, span_source, row_id) if isinstance(span_source, DataFrame)
              else df.withColumn("__spans", span_source(shown)))
        wanted = F.array(*[F.lit(x) for x in d.params["labels"]])
        df = df.withColumn("__spans", F.filter("__spans", lambda s: F.array_contains(wanted, s["label"])))
    df = df.withColumn("__marked", M.mark_spans(text, "__spans")).drop("__spans")
    for label in d.params.get("split", []):
        df = df.withColumn("__marked", M.split_words("__marked", label))
    return df


def attach_spans(df: DataFrame, spans: DataFrame, row_id: str) -> DataFrame:
    """One sorted span array per row, by an equi-join on the row id."""
    per_row = spans.groupBy(row_id).agg(F.array_sort(F.collect_list(
        F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
                 F.col("label")))).alias("__spans"))
    return df.join(per_row, row_id, "left")


def inner_values(occ: str) -> str:
    """Hits whose value holds an earlier hit's placeholder get that hit's value in it.

    The number in a placeholder only means something inside its row; the value makes equal
    texts equal.  A value can hold placeholders of several levels, one round resolves one level.
    """
    number = rf"{M.PH_L}\d+{M.PH_R}"
    marked = f"split(regexp_replace(o.value, {M.quote(M.PLACEHOLDER)}, {M.quote(f'{M.OPEN}$1{M.MID}$2{M.CLOSE}')}), {M.quote(M.OPEN)})"
    inner = f"all[cast({M.hit_value('p', True)} AS int)].value"
    filled = M.rejoin(marked, f"p -> concat('[', substring_index(p, '{M.MID}', 1), '-{M.PH_L}x', hex({inner}), '{M.PH_R}]', {M.tail('p')})")
    # only values whose inner values are settled are filled in this round
    ready = (f"NOT exists(regexp_extract_all(o.value, {M.quote(M.PLACEHOLDER)}, 2), "
             f"k -> rlike(all[cast(k AS int)].value, {M.quote(number)}))")
    one = (f"transform(array(a), all -> transform(all, o -> CASE WHEN rlike(o.value, {M.quote(number)}) AND {ready} "
           f"THEN named_struct('rule_ix', o.rule_ix, 'label', o.label, 'value', {filled}) ELSE o END))[0]")
    nested = f"exists({occ}, o -> contains(o.value, '{M.PH_L}'))"
    rounds = f"aggregate(sequence(1, size({occ})), {occ}, (a, r) -> CASE WHEN exists(a, o -> rlike(o.value, {M.quote(number)})) THEN {one} ELSE a END)"
    return f"CASE WHEN {nested} THEN {rounds} ELSE {occ} END"


def explode_hits(found: DataFrame, keep=("row_id", "conversation_id")) -> DataFrame:
    """The hits as rows: ``(*keep, k, rule_ix, label, value)``; k is the creation order in the row.

    The outer form keeps the optimiser from inferring a filter on ``occ`` and pushing it
    through the whole rule chain, where it would copy the expressions of every step.
    """
    return (found.select(*keep, F.posexplode_outer(F.expr(inner_values(OCC))).alias("k", "o"))
            .where(F.col("k").isNotNull())
            .select(*keep, "k", "o.rule_ix", "o.label", "o.value"))
