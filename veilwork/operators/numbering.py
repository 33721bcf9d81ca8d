"""Index assignment: which number a value's label carries.

Hits are numbered without an unpartitioned window over the data.  Rows are cut into blocks
of consecutive row ids; a block is bounded by ``BLOCK_ROWS`` rows whatever its content, so
it is the unit of every window here.  The counts per block are summed up over a whole
conversation (or over the whole table in global mode) by ranges of blocks, so ids may also be
sparse and nearly every row a block of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions import marks as M
from veilwork.operators.detect import OCC, explode_hits  # noqa: F401

BLOCK_ROWS = 50_000
PART_GROUPS = 100_000
KEY = ["conversation_id", "label", "value"]


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the left side's keys stay."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(right, on, how).drop(*[f"__r_{k}" for k in keys])


def with_block(hits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return hits.withColumn("block", F.floor(F.col("row_id") / block_rows).cast("bigint"))


def running_number(df: DataFrame, order_groups: list[str], inside: list[str], out: str,
                   within: list[str] = ()) -> DataFrame:
    """Number rows 0, 1, ... by (order_groups, inside), separately for each ``within`` key.

    ``order_groups`` must cut the rows into bounded groups.  Counts per group are summed to
    offsets; the row number is taken inside one group only.
    """
    groups = [*within, *order_groups]
    offsets = group_offsets(df.groupBy(*groups).agg(F.count("*").alias("__n")), list(within), order_groups)
    inner = Window.partitionBy(*groups).orderBy(*inside)
    numbered = df.withColumn("__rank", F.row_number().over(inner) - 1)
    return (null_safe_join(numbered, offsets, groups)
            .withColumn(out, (F.col("__offset") + F.col("__rank")).cast("bigint"))
            .drop("__offset", "__rank"))


def group_offsets(counts: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """``(within, order, __offset)``: the sum of ``__n`` over the earlier groups of the same ``within`` key.

    A hierarchical prefix sum.  The groups, one row each and written once, are sorted by range into parts of about
    ``PART_GROUPS``; a window runs inside a part, and what comes in from the parts before is worked out from one row per
    part.  So neither one long table nor one key with a third of all groups meets in one task.
    """
    from veilwork.plans.redaction import keep_once
    groups = [*within, *order]
    counts = keep_once(counts)
    wanted = -(-counts.count() // PART_GROUPS)
    n = max(1, min(wanted, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if n == 1:
        parts = counts.coalesce(1).withColumn("__part", F.spark_partition_id())
    else:
        parts = keep_once(counts.repartitionByRange(n, *groups).withColumn("__part", F.spark_partition_id()))
    before = (Window.partitionBy("__part", *within).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = parts.withColumn("__offset", F.sum("__n").over(before) - F.col("__n"))
    carried = carried_in(parts, within) if n > 1 else []
    if not carried:
        return inside.drop("__n", "__part")
    keys = ["__part", *within]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*keys).schema)
    start = parts.sparkSession.createDataFrame(carried, f"{kind}, __start bigint")      # a row per part at most
    return (null_safe_join(inside, F.broadcast(start), keys, "left")
            .withColumn("__offset", F.col("__offset") + F.coalesce("__start", F.lit(0)))
            .drop("__n", "__part", "__start"))


def carried_in(parts: DataFrame, within: list[str]) -> list[tuple]:
    """``(part, within..., sum)`` for the first key of each part: its sum in the parts before."""
    key = F.struct(*within) if within else F.lit(0)
    sums = parts.groupBy("__part", *within).agg(F.sum("__n").alias("__n")).withColumn("__k", key)
    ends = sums.groupBy("__part").agg(F.min("__k").alias("first"), F.max("__k").alias("last"), F.max_by("__n", "__k").alias("n"))
    out, open_key, open_sum = [], None, 0
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):      # a row per part
        first, last = r["first"], r["last"]
        if first != open_key:
            open_sum = 0
        elif open_sum:
            out.append((r["__part"], *(first if within else ()), open_sum))
        open_sum = r["n"] + (open_sum if first == last else 0)
        open_key = last
    return out


def sequence(hits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every hit takes the next number in (file, chunk, rule, row, creation) order."""
    hits = with_block(hits, block_rows)
    lead = [c for c in ("file_ix", "chunk_id") if c in hits.columns]
    return running_number(hits, [*lead, "rule_ix", "block"], ["row_id", "k"], "seq")


def block_values(hits: DataFrame, *aggregates) -> DataFrame:
    """One row per block and value: what a hot value shrinks to before anything else moves."""
    return hits.groupBy("block", *KEY).agg(F.count("*").alias("n"), *aggregates)


def global_index(hits: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """The index of a value is the sequence number of its first hit in the conversation.

    ``compat`` reproduces E4: number 0 is not remembered, so the second hit of that first
    value brings its own number.  Input needs ``seq`` and ``block``.  Returns the hits with
    ``ix`` and the dictionary ``(KEY, ix, first_seq)``.
    """
    later = F.min(F.when(F.col("seq") > 0, F.col("seq")))
    per_block = block_values(hits, F.min("seq").alias("__first"), later.alias("__later"))
    firsts = per_block.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("__first").alias("first_seq"),
                                         F.min("__later").alias("__second"))
    dictionary = firsts.select(*KEY, "n", F.col("first_seq").alias("ix"), "first_seq")
    if not compat:
        return spread_index(hits, dictionary), dictionary
    reissued = firsts.where((F.col("first_seq") == 0) & F.col("__second").isNotNull()).select(
        *KEY, "n", F.col("__second").alias("ix"), F.col("__second").alias("first_seq"))
    later_ix = F.when(F.col("first_seq") == 0, F.coalesce("__second", "first_seq")).otherwise(F.col("first_seq"))
    out = spread_index(hits, firsts.select(*KEY, later_ix.alias("ix")))
    return (out.withColumn("ix", F.when(F.col("seq") == 0, F.lit(0)).otherwise(F.col("ix"))),
            dictionary.unionByName(reissued))


def first_places(hits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The distinct values ``(KEY, n)`` with the block and place of their first hit.

    The position of a hit inside its block is one number, so both steps aggregate in hash
    tables with partial sums before the shuffle.
    """
    place = (F.col("row_id") - F.col("block") * block_rows) * F.lit(1 << 40) + F.col("k")
    per_block = block_values(with_block(hits, block_rows), F.min(place).alias("__place"))
    return per_block.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.min("block").alias("first_block"),
        F.min_by("__place", "block").alias("first_place"))


def dictionary_of(hits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """E6 dictionary: ``(KEY, n, ix)``, ix dense by first position inside the conversation."""
    from veilwork.plans.redaction import keep_once
    return running_number(keep_once(first_places(hits, block_rows)), ["first_block"], ["first_place"], "ix",
                          within=["conversation_id"])


def spread_index(hits: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Bring the index of each value to its hits.

    The dictionary meets the distinct values of each block first, so a value that fills a
    third of the table takes part once per block, and then the hits by block and value.
    """
    values = null_safe_join(hits.select("block", *KEY).distinct(), dictionary.select(*KEY, "ix"), KEY)
    return null_safe_join(hits, values, ["block", *KEY])


def conversation_index(hits: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Dense index per conversation.  Returns the hits with ``ix`` and the dictionary."""
    dictionary = dictionary_of(hits, block_rows)
    return spread_index(with_block(hits, block_rows), dictionary), dictionary


def with_final_labels(dictionary: DataFrame) -> DataFrame:
    """The dictionary with final labels where a value holds an earlier label.

    Such a value came here with the inner value in place of a number (see ``detect.inner_values``),
    so equal texts have equal keys.
    """
    names = dictionary.select("conversation_id", F.col("label").alias("__l"), F.col("value").alias("__v"), F.col("ix").alias("__n"))
    nested = F.contains("value", F.lit(M.PH_L))
    each = dictionary.where(nested).select(*dictionary.columns, F.posexplode(F.expr(
        f"regexp_extract_all(value, {M.quote(M.INNER)}, 0)")).alias("__i", "__m"))
    each = each.withColumn("__l", F.regexp_extract("__m", M.INNER, 1)).withColumn(
        "__v", F.expr(f"cast(unhex(regexp_extract(__m, {M.quote(M.INNER)}, 2)) AS string)"))
    found = null_safe_join(each, names, ["conversation_id", "__l", "__v"], "left")
    labels = found.groupBy(*dictionary.columns).agg(F.array_sort(F.collect_list(F.struct("__i", "__l", "__n"))).alias("__x"))
    marked = f"split(regexp_replace(value, {M.quote(M.INNER)}, '{M.OPEN}{M.CLOSE}'), '{M.OPEN}')"
    label = "concat('[', __x[i].__l, '-', cast(__x[i].__n AS string), ']')"
    filled = M.rejoin(marked, f"(p, i) -> concat({label}, {M.tail('p')})")
    closed = labels.withColumn("value", F.expr(filled)).select(*dictionary.columns)
    return dictionary.where(~nested).unionByName(closed)


def audit_log(dictionary: DataFrame) -> DataFrame:
    """Each label with its first value, and what orders labels by creation.

    An index names one value only, so the dictionary is the log.
    """
    name = F.concat_ws("-", "label", F.col("ix").cast("string")).alias("label")
    if "first_seq" in dictionary.columns:
        return dictionary.select(name, "value", F.col("first_seq").alias("seq"))
    return dictionary.select("conversation_id", name, "value", F.col("ix").alias("seq"))


def render(found: DataFrame, indexed: DataFrame, restore: list[str], text: str = "text") -> DataFrame:
    """Fill the placeholders.  Only rows with hits are shuffled; the others pass by."""
    per_row = indexed.groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("k", "ix"))).alias("__ix"))
    hit = found.where(F.size(OCC) > 0).join(per_row, "row_id", "left")
    number = "coalesce(__ix[{k}].ix, cast(raise_error('a hit has no number') AS bigint))"
    label = f"concat('[', {{label}}, '-', cast({number} AS string), ']')"
    if restore:
        names = ", ".join(M.quote(r) for r in restore)
        label = f"CASE WHEN {{label}} IN ({names}) THEN {OCC}[{{k}}].value ELSE {label} END"
    hit = hit.withColumn(text, M.fill(text, label)).drop("__ix")
    return hit.unionByName(found.where(F.size(OCC) == 0))
