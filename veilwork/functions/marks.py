"""Marked text: how a detector's hits travel inside one string column.

A detector answers with the text in which every hit is wrapped as ``OPEN value CLOSE``.
One ``regexp_replace`` makes that string, so a rule costs one regex pass and a row without
a hit is recognised by a byte search.  The characters are Unicode noncharacters, which may
not occur in interchanged text; ``guard_input`` replaces any that do.

Replaced hits leave ``[LABEL-<PH_L>k<PH_R>]`` behind: the shape of a label, but with the
row-local hit number k, so later rules see a label and the final index can be filled in
once it is known.

The array work is written as SQL text: one parse per expression keeps plan building fast
for runs of many rules.  Every function takes SQL text and returns SQL text or a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PH_L, PH_R = "﷐", "﷑"
OPEN, MID, CLOSE = "﷒", "﷓", "﷕"
#: Around a label while zones are found, and the marks of hits that touch one.
ZONE_L, ZONE_R, OPEN_X, CLOSE_X = "\ufdd6", "\ufdd7", "\ufdd8", "\ufdd9"
LABEL_SHAPE = r"(?U)\[\w+(?:-(?:\d+|﷐\d+﷑))?\]"
PLACEHOLDER = r"\[([^\[\]]+?)-﷐(\d+)﷑\]"
#: A placeholder inside a logged value: the hexadecimal inner value stands for the number.
INNER = "\\[([^\\[\\]]+?)-" + PH_L + "x([0-9A-F]*)" + PH_R + "\\]"

OCC_TYPE = "array<struct<rule_ix:int,label:string,value:string>>"


def quote(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def guard_input(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), F.lit("[\ufdd0-\ufdd9]"), F.lit("�"))


def mark_whole(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}"))


def mark_group_raw(text: Column, pattern: str, group: int, lead_groups: int) -> Column:
    """Each match as ``OPEN whole MID lead MID group CLOSE``.

    The lead groups cover the match up to the marked group, so their total length is the
    offset of the group in the match.
    """
    lead = "".join(f"${{vw{i}}}" for i in range(lead_groups))
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{MID}{lead}{MID}${group}{CLOSE}"))


def head(x: str) -> str:
    return f"substring_index({x}, '{CLOSE}', 1)"


def tail(x: str) -> str:
    return f"substring_index({x}, '{CLOSE}', -1)"


def hit_value(x: str, inline_label: bool = False) -> str:
    return f"substring_index({head(x)}, '{MID}', -1)" if inline_label else head(x)


def hit_label(x: str, label: str | None) -> str:
    return f"substring_index({x}, '{MID}', 1)" if label is None else quote(label)


def pieces(parts: str) -> str:
    """The parts behind the first mark; each is one hit and the text up to the next."""
    return f"slice({parts}, 2, size({parts}) - 1)"


def rejoin(parts: str, lambda_sql: str) -> str:
    return f"concat({parts}[0], array_join(transform({pieces(parts)}, {lambda_sql}), ''))"


def mark_group(raw: str) -> Column:
    """From the raw form to plain marks around the group.

    Where the group took no part in the match, the whole match is marked.
    """
    whole = f"substring_index(p, '{MID}', 1)"
    lead = f"substring_index(substring_index({head('p')}, '{MID}', 2), '{MID}', -1)"
    value = hit_value("p", True)
    rest = f"substr({whole}, length({lead}) + length({value}) + 1)"
    settle = (f"p -> CASE WHEN {value} = '' THEN concat('{OPEN}', {whole}, '{CLOSE}', {tail('p')}) "
              f"ELSE concat({lead}, '{OPEN}', {value}, '{CLOSE}', {rest}, {tail('p')}) END")
    return F.expr(f"CASE WHEN contains({raw}, '{OPEN}') THEN "
                  f"{rejoin(f'split({raw}, {quote(OPEN)})', settle)} ELSE {raw} END")


def in_order(spans: str, text: str) -> str:
    """Spans sorted and inside the text, without those that overlap an earlier one.

    The fold only runs where a span is out of line; neighbours in order are all in order.
    """
    ordered = f"array_sort(filter({spans}, s -> s.start >= 0 AND s.start < s.end AND s.end <= length({text})))"
    broken = "exists(sequence(1, size(o) - 1), i -> o[i].start < o[i - 1].end)"
    kind = "array<struct<start:int,end:int,label:string>>"
    fold = (f"aggregate(o, struct(0 AS pos, cast(array() AS {kind}) AS out), (a, s) -> CASE WHEN s.start >= a.pos "
            f"THEN struct(s.end AS pos, array_append(a.out, named_struct('start', s.start, 'end', s.end, 'label', s.label)) AS out) "
            f"ELSE a END, a -> a.out)")
    return f"transform(array({ordered}), o -> CASE WHEN size(o) > 1 AND {broken} THEN {fold} ELSE o END)[0]"


def mark_spans(text: str, spans: str) -> Column:
    """``(start, end, label)`` spans as ``OPEN label MID value CLOSE``.

    The text is taken apart into characters once, so every piece costs its own length.
    """
    cut = lambda a, b: f"array_join(slice(c, {a} + 1, {b} - {a}), '')"
    before = "coalesce(get(o, i - 1).end, 0)"
    piece = (f"concat({cut(f'{before}', 's.start')}, '{OPEN}', s.label, '{MID}', {cut('s.start', 's.end')}, '{CLOSE}')")
    whole = f"concat(array_join(transform(o, (s, i) -> {piece}), ''), {cut('o[size(o) - 1].end', 'size(c)')})"
    return F.expr(
        f"CASE WHEN size({spans}) > 0 THEN transform(array({in_order(spans, text)}), o -> CASE WHEN size(o) = 0 THEN {text} "
        f"ELSE transform(array(regexp_extract_all({text}, '(?s).', 0)), c -> {whole})[0] END)[0] ELSE {text} END")


def split_words(marked: str, label: str) -> Column:
    """One hit per word where ``label`` has a hit of several words."""
    start = label + MID
    words = (f"regexp_replace({hit_value('p', True)}, '(?U)(\\\\S+)', "
             f"{quote(OPEN + start + '$1' + CLOSE)})")
    each = (f"p -> CASE WHEN startswith(p, {quote(start)}) THEN concat({words}, {tail('p')}) "
            f"ELSE concat('{OPEN}', p) END")
    return F.expr(f"CASE WHEN contains({marked}, {quote(OPEN + start)}) THEN "
                  f"{rejoin(f'split({marked}, {quote(OPEN)})', each)} ELSE {marked} END")


def running(lengths: str, block: int = 16, blocks: int = 64) -> str:
    """Sum of the elements before each one.

    Elements are summed in blocks, and so are the blocks: an element costs a few additions however long the row is,
    and no array grows element by element.
    """
    add = "0, (a, z) -> a + z"

    def before(row: str, size: int, of_sums, v: str) -> str:
        cut = f"transform(sequence(0, (size({row}) - 1) div {size}), b -> slice({row}, b * {size} + 1, {size}))"
        inside = f"transform({v}x, ({v}y, {v}j) -> {v}o[{v}q] + aggregate(slice({v}x, 1, {v}j), {add}))"
        each = f"flatten(transform({v}b, ({v}x, {v}q) -> {inside}))"
        sums = f"transform({v}b, x -> aggregate(x, {add}))"
        outer = f"transform(array({sums}), {v}s -> {of_sums(v + 's')})[0]"
        return f"transform(array({cut}), {v}b -> transform(array({outer}), {v}o -> {each})[0])[0]"

    few = lambda row: f"transform({row}, (y, j) -> aggregate(slice({row}, 1, j), {add}))"
    return f"transform(array({lengths}), l -> {before('l', block, lambda s: before(s, blocks, few, 'm'), 'k')})[0]"


def spans_of(parts: str, inline_label: bool = False) -> str:
    """Start and end (0-based, end exclusive) of every hit in the text without marks."""
    value = f"length({hit_value('p', inline_label)})"
    sizes = f"transform({pieces('q')}, p -> {value} + length({tail('p')}))"
    each = f"zip_with({pieces('q')}, {running(sizes)}, (p, at) -> named_struct('start', z + at, 'end', z + at + {value}))"
    return f"transform(array({parts}), q -> transform(array(length(q[0])), z -> {each})[0])[0]"


def label_zones(text: str) -> str:
    """The spans of labels already in the text."""
    marked = f"regexp_replace({text}, {quote(LABEL_SHAPE)}, {quote(OPEN + '$0' + CLOSE)})"
    return spans_of(f"split({marked}, '{OPEN}')")


def settled(marked: str, inline_label: bool = False) -> str:
    """Without the hits whose first or last character lies in a label (enclosing one is allowed).

    Labels are found in the marked text by a pattern that lets marks stand inside them.  A mark
    that such a label holds (or that its ends touch from outside) belongs to a hit that has to
    go.  All of it is passes over one string, so a row costs its length, however many hits.
    """
    name = f"(?:[^{OPEN}{MID}{CLOSE}{OPEN_X}{CLOSE_X}]*+{MID})?+" if inline_label else ""
    mark = f"(?:{OPEN}{name}|{CLOSE})*+"
    digits = rf"(?:\d{mark})++"
    label = (rf"(?U)(?:{OPEN}{name})?+\[{mark}(?:\w{mark})++"
             rf"(?:-{mark}(?:{digits}|{PH_L}{mark}{digits}{PH_R}{mark}))?+\]{CLOSE}?+")
    zoned = f"regexp_replace({marked}, {quote(label)}, {quote(ZONE_L + '$0' + ZONE_R)})"
    crossed = (f"p -> concat(translate(substring_index(p, '{ZONE_R}', 1), '{OPEN}{CLOSE}', '{OPEN_X}{CLOSE_X}'), "
               f"substring_index(p, '{ZONE_R}', -1))")
    value = f"([^{OPEN}{CLOSE}{OPEN_X}{CLOSE_X}]*+)"
    out = rejoin(f"split({zoned}, '{ZONE_L}')", crossed)
    out = f"regexp_replace({out}, {quote(f'{OPEN_X}{name}{value}[{CLOSE}{CLOSE_X}]')}, '$1')"
    return f"regexp_replace({out}, {quote(f'{OPEN}{name}{value}{CLOSE_X}')}, '$1')"


def settled_parts(text: str, marked: str, inline_label: bool = False) -> Column:
    """The parts around the accepted hits; null where there is no hit.

    Zones matter only where the text has a bracket.
    """
    return F.expr(f"CASE WHEN contains({marked}, '{OPEN}') THEN split(CASE WHEN contains({text}, '[') "
                  f"THEN {settled(marked, inline_label)} ELSE {marked} END, '{OPEN}') END")


def splice(text: str, parts: str, base: str, label: str | None) -> str:
    """A numbered placeholder where each hit was; numbers run right to left."""
    place = (f"(p, i) -> concat('[', {hit_label('p', label)}, '-{PH_L}', "
             f"cast({base} + size({parts}) - 2 - i AS string), '{PH_R}]', {tail('p')})")
    return f"CASE WHEN size({parts}) > 1 THEN {rejoin(parts, place)} ELSE {text} END"


def append_hits(occ: str, parts: str, rule_ix: int, label: str | None) -> Column:
    """The row's hit list, longer by the hits of one rule from right to left."""
    entry = (f"p -> named_struct('rule_ix', {rule_ix}, 'label', {hit_label('p', label)}, "
             f"'value', {hit_value('p', label is None)})")
    return F.expr(f"CASE WHEN size({parts}) > 1 THEN "
                  f"concat({occ}, reverse(transform({pieces(parts)}, {entry}))) ELSE {occ} END")


def mark_branches(text: Column, pattern: str, labels: list[str], marked: str) -> tuple[Column, Column]:
    """Hits of ``(...)|(...)|...`` as ``OPEN label MID value CLOSE``; the branch that matched names the label.

    Two columns, the second over the first under the name ``marked``: one regex pass, then work on rows with hits only.
    """
    groups = MID.join(f"${i + 1}" for i in range(len(labels)))
    first = F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}{groups}{CLOSE}"))
    fields = f"split({head('p')}, '{MID}')"
    name = f"array({', '.join(map(quote, labels))})[array_position(transform(f, x -> x != ''), true) - 1]"
    each = (f"p -> transform(array({fields}), f -> concat('{OPEN}', {name}, '{MID}', array_join(f, ''), '{CLOSE}', {tail('p')}))[0]")
    return first, F.expr(f"CASE WHEN contains({marked}, '{OPEN}') THEN {rejoin(f'split({marked}, {quote(OPEN)})', each)} ELSE {marked} END")


def _label_by_label(parts: str, labels: list[str]) -> str:
    """The hits as ``(o, j)``, by label in the given order and from right to left inside a label; -j is the place in the row."""
    order = f"array({', '.join(map(quote, labels))})"
    return f"array_sort(transform({pieces(parts)}, (p, i) -> struct(array_position({order}, {hit_label('p', None)}) AS o, -i AS j)))"


def splice_by_label(text: str, parts: str, base: str, labels: list[str]) -> str:
    """D15 for hits of several labels found in one pass, numbered as if each label had its own pass."""
    numbers = f"transform(array_sort(transform({_label_by_label(parts, labels)}, (x, r) -> struct(-x.j AS i, r AS r))), y -> y.r)"
    place = f"(p, i) -> concat('[', {hit_label('p', None)}, '-{PH_L}', cast({base} + n[i] AS string), '{PH_R}]', {tail('p')})"
    return f"CASE WHEN size({parts}) > 1 THEN transform(array({numbers}), n -> {rejoin(parts, place)})[0] ELSE {text} END"


def append_by_label(occ: str, parts: str, rule_ix: int, labels: list[str]) -> Column:
    """The row's hit list, longer by the hits of a rule label by label."""
    entry = (f"transform(array({parts}[1 - x.j]), p -> named_struct('rule_ix', {rule_ix}, 'label', {hit_label('p', None)}, "
             f"'value', {hit_value('p', True)}))[0]")
    return F.expr(f"CASE WHEN size({parts}) > 1 THEN concat({occ}, transform({_label_by_label(parts, labels)}, x -> {entry})) ELSE {occ} END")


def fill(text: str, replacement: str) -> Column:
    """Replace every placeholder; ``replacement`` is SQL over ``label`` and ``k``."""
    marked = f"regexp_replace({text}, {quote(PLACEHOLDER)}, {quote(f'{OPEN}$1{MID}$2{CLOSE}')})"
    new = replacement.format(label=f"substring_index(p, '{MID}', 1)",
                             k=f"cast({hit_value('p', True)} AS int)")
    return F.expr(f"CASE WHEN contains({text}, '{PH_L}') THEN "
                  f"{rejoin(f'split({marked}, {quote(OPEN)})', f'p -> concat({new}, {tail(chr(112))})')} "
                  f"ELSE {text} END")
