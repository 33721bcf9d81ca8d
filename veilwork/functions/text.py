"""Scalar text functions (native Column expressions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
TEENS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
         "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(text, pattern: str, replacement: str, flags: str = "") -> Column:
    """Substitute every match; ``flags`` are inline letters such as ``iU``."""
    return F.regexp_replace(col(text), F.lit(_flagged(pattern, flags)), F.lit(replacement))


def search(text, pattern: str, flags: str = "") -> Column:
    """Does the pattern occur anywhere in the text?"""
    return F.rlike(col(text), F.lit(_flagged(pattern, flags)))


def _flagged(pattern: str, flags: str) -> str:
    return f"(?{flags}){pattern}" if flags else pattern


def blank_fill(text) -> Column:
    """A4: null text becomes the empty string."""
    return F.coalesce(col(text), F.lit(""))


def drop_ellipsis(text) -> Column:
    return F.replace(col(text), F.lit("..."), F.lit(""))


def squeeze_whitespace(text) -> Column:
    # Single blanks are left alone: only longer runs and other whitespace are rewritten.
    return sub(text, r"\s{2,}|[^\S ]", " ", "U")


def drop_unknown(text) -> Column:
    return F.replace(col(text), F.lit("<UNK>"), F.lit(""))


def split_adjacent_labels(text) -> Column:
    return F.replace(col(text), F.lit("]["), F.lit("] ["))


def space_before_label(text) -> Column:
    # The word before the bracket needs no look at its start: one word character is enough.
    return sub(text, r"(\w)\[", "$1 [", "U")


def space_after_label(text) -> Column:
    return sub(text, r"\](\w)", "] $1", "U")


def strip(text) -> Column:
    return sub(text, r"^\s+|\s+$", "", "Ud")


def clean_text(df, text: str, out: str | None = None):
    """G1..G7 in their fixed order on one column of a frame.

    After G2 every whitespace is a blank, so a plain trim is a whitespace strip; it can go
    first because the bracket steps only add inner blanks.  Those run only where there is
    a bracket.
    """
    out = out or text
    has_bracket = F.contains(F.col(out), F.lit("[")) | F.contains(F.col(out), F.lit("]"))
    spaced = space_after_label(space_before_label(split_adjacent_labels(F.col(out))))
    return (df.withColumn(out, F.trim(drop_unknown(squeeze_whitespace(drop_ellipsis(text)))))
              .withColumn(out, F.when(has_bracket, spaced).otherwise(F.col(out))))


def upper(text) -> Column:
    return F.upper(col(text))


def sub_until_stable(df, text: str, pattern: str, replacement: str):
    """Substitute until nothing changes.

    Adds ``<text>_rounds``: how many rounds changed the text.  A pattern that never comes to
    rest is given up after as many rounds as the text has characters (16 at least).
    """
    n, state = f"{text}_rounds", "struct<t:string,n:int>"

    def step(a, _):
        new = sub(a["t"], pattern, replacement)
        return F.when(new == a["t"], a).otherwise(F.struct(new.alias("t"), (a["n"] + 1).alias("n")))

    start = F.struct(F.col(text).alias("t"), F.lit(0).alias("n")).cast(state)
    moving = sub(text, pattern, replacement) != F.col(text)
    rounds = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(16)))
    df = df.withColumn("__s", F.when(moving, F.aggregate(rounds, start, step)).otherwise(start))
    return df.withColumn(text, F.col("__s.t")).withColumn(n, F.col("__s.n")).drop("__s")


def digits_to_words(digits) -> Column:
    """Every digit as a word with a leading blank."""
    out = col(digits)
    for d, w in enumerate(DIGIT_WORDS):
        out = F.replace(out, F.lit(str(d)), F.lit(" " + w))
    return out


def number_to_words(n) -> Column:
    """0..999 in British style: ``one hundred and eighty-six``."""
    n = col(n)
    words = F.array(*[F.lit(w) for w in DIGIT_WORDS + TEENS])
    tens = F.array(*[F.lit(w) for w in TENS])
    rest = n % 100
    low = F.when(rest < 20, F.get(words, rest.cast("int"))).otherwise(
        F.concat(F.get(tens, F.floor(rest / 10).cast("int") - 2),
                 F.when(rest % 10 > 0, F.concat(F.lit("-"), F.get(words, (rest % 10).cast("int"))))
                 .otherwise(F.lit(""))))
    hundreds = F.concat(F.get(words, F.floor(n / 100).cast("int")), F.lit(" hundred"))
    return (F.when(n < 100, low)
             .when(rest == 0, hundreds)
             .otherwise(F.concat(hundreds, F.lit(" and "), low)))


TAG = r"^\[?(.*)-(.*?)\]?$"


def label_category(tag) -> Column:
    """``[A-B-3]`` -> ``A-B`` (empty when the tag has no index)."""
    return F.regexp_extract(col(tag), TAG, 1)


def label_index(tag) -> Column:
    return F.regexp_extract(col(tag), TAG, 2)


def format_label(label, ix, brackets: bool = True) -> Column:
    """``LABEL-ix`` or ``[LABEL-ix]``."""
    body = F.concat(col(label), F.lit("-"), col(ix).cast("string"))
    return F.concat(F.lit("["), body, F.lit("]")) if brackets else body


def is_label(text) -> Column:
    """Is the whole text a protected label?"""
    return search(text, r"^\[\w+(-\d+)?\]$", "Ud")
