"""D and R queries: detectors over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.catalog.base import (C, DOC_SRC, INDEX_CTES, M, O, SPOKEN_ON_SPARK, SPOKEN_SRC, TURN_SRC, documents, hits_ctes,
                                   lit, mark, query, redact, redact_sql, transcripts)
from veilwork.operators import numbering as N
from veilwork.operators.detect import detect
from veilwork.rules import shipped as S
from veilwork.rules.ruleset import RuleSet, compile_pattern


def only(rule: str, modality: str = "text", level=4):
    """The shipped detectors of one rule."""
    return [d for d in RuleSet().detectors(modality, level) if d.rule == rule]


# ---- the patterns in the SQL engine's dialect (no look-around, no atomic groups) ------
EMAIL_RE = S.EMAIL.replace("]++@", "]+@")
_COMPASS = "(?:N(?:orth)?|S(?:outh)?)? ?(?:E(?:ast)?|W(?:est)?)?"
ADDRESS_RE = (rf"[0-9]{{1,6}}(?: 1/[234])?(?: {_COMPASS})?(?:(?: [0-9]+ ?(?:th|rd|st|nd))|(?: [A-Z][a-z]+)+)"
              rf" (?:{'|'.join(sorted(S.STREET_SUFFIXES, key=lambda w: (-len(w), w)))})(?: {_COMPASS})?")
IGNORE_RE = "((" + ")|(".join(S.IGNORE_PHRASES) + "))"
SSN_FIRST = r"(?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])"
SSN_RE = (rf"(^|\s)({SSN_FIRST}(?:-|\s)?(?:0[1-9]|[1-9][0-9])(?:-|\s)?"
          r"(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3}))(\s|$|\.)")


def _used_zip_prefixes() -> str:
    import re
    unused = re.compile(S.UNUSED_ZIP_PREFIXES)
    return "|".join(f"{n:03d}" for n in range(1000) if not unused.fullmatch(f"{n:03d}"))


ZIP_RE = (rf"(^|\s)((?:{_used_zip_prefixes()})[0-9]{{2}})(\s|\.|$|-(?:[0-9]{{4}})?)"
          rf"|({S.CANADA_FIRST}[ ]?{S.CANADA_LAST})$")
ZIP_MARK = f"regexp_replace(text, {lit(ZIP_RE)}, '\\1' || {O} || '\\2\\4' || {C} || '\\3', 'gi')"

# Look-around by markers: every character but digit and hyphen is followed by a marker, so
# the boundary before and after a phone number can be taken from two different characters.
_gap, _sp = rf"(?:-|[.\s*]\x03)?", r"(?:\s\x03)*"
PHONE_RE = (rf"(^|\x03)((?:(?:(?:\+\x03)?\d{{1,3}}{_gap})?(?:(?:\(\x03)?\d{{3}}(?:\)\x03)?{_gap})?\d{{3}}{_gap}\d{{4}})"
            rf"|(?:(?:\(\x03(?:\+\x03)?\d{{2}}\)\x03)|(?:(?:\+\x03)?\d{{2}})){_sp}\d{{2}}{_sp}\d{{3}}{_sp}\d{{4}})($|[^0-9\x03-])")
PHONE_MARK = (f"replace(regexp_replace(regexp_replace(text, '([^0-9-])', '\\1' || {M}, 'g'), {lit(PHONE_RE)}, "
              f"'\\1' || {O} || '\\2' || {C} || '\\3', 'g'), {M}, '')")

# Negative look-ahead by markers: a marker stands wherever a number is followed by a word
# that forbids it; three rounds because one round can eat the start of the next number.
_number_words = "|".join([S.ONE_TO_NINE, S.TEN_TO_NINETEEN, S.TENS, "zero|hundred|thousand|million|billion|trillion"])


def cardinal_mark(text_modality: bool) -> str:
    stop = (("st|nd|rd|th|" if text_modality else "") + S.NOT_A_COUNT)
    number = rf"(\d|\b(?:{_number_words})\b)(\s*(?:{stop}))"
    t = "text"
    for _ in range(3):
        t = f"regexp_replace({t}, {lit(number)}, '\\1' || {M} || '\\2', 'gi')"
    grammar = S.cardinal_grammar().replace("[ ]", r"\x03?[ ]").replace("[- ]", r"\x03?[- ]")
    found = rf"({grammar}{'|[0-9]+' if text_modality else ''})($|[^\x03])"
    return f"replace(regexp_replace({t}, {lit(found)}, {O} || '\\1' || {C} || '\\2', 'gi'), {M}, '')"


def _rule_query(name, rule, modality, src, marked, frame):
    @query(name, redact_sql(src, marked, rule))
    def run(spark, sf_dir):
        return redact(frame(spark, sf_dir), only(rule, modality))


def spoken(spark, sf_dir):
    return transcripts(spark, sf_dir, SPOKEN_ON_SPARK)


def whole(pattern):
    return mark(f"({pattern})")


def grouped(pattern, after=""):
    return mark(pattern, before="\\1", after=after)


_rule_query("r1_phone_text", "PHONE", "text", DOC_SRC, PHONE_MARK, documents)
_rule_query("r1_phone_text_turns", "PHONE", "text", TURN_SRC, PHONE_MARK, transcripts)
_rule_query("r2_phone_voice", "PHONE", "voice", SPOKEN_SRC, whole(S.PHONE_VOICE), spoken)
_rule_query("r3_ccard_text", "CCARD", "text", DOC_SRC, whole(S.CCARD_TEXT), documents)
_rule_query("r4_ccard_voice", "CCARD", "voice", SPOKEN_SRC, whole(S.CCARD_VOICE), spoken)
_rule_query("r5_ssn_text", "SSN", "text", TURN_SRC, grouped(SSN_RE, "\\3"), transcripts)
_rule_query("r6_ssn_voice", "SSN", "voice", SPOKEN_SRC, whole(S.SSN_VOICE.replace("?<ssn>", "?:")), spoken)
_rule_query("r7_zip_text", "ZIP", "text", DOC_SRC, ZIP_MARK, documents)
_rule_query("r8_zip_voice", "ZIP", "voice", SPOKEN_SRC, grouped(S.ZIP_VOICE.replace("?<zip>", "")), spoken)
_rule_query("r9_email", "EMAIL", "text", DOC_SRC, whole(EMAIL_RE), documents)
_rule_query("r9_email_turns", "EMAIL", "text", TURN_SRC, whole(EMAIL_RE), transcripts)
_rule_query("r10_address", "ADDRESS", "text", DOC_SRC, whole(ADDRESS_RE), documents)
_rule_query("r11_pin_text", "PIN", "text", DOC_SRC, grouped(r"(^|\s)(\d{4})"), documents)
_rule_query("r11_pin_text_turns", "PIN", "text", TURN_SRC, grouped(r"(^|\s)(\d{4})"), transcripts)
_rule_query("r12_pin_voice", "PIN", "voice", SPOKEN_SRC, grouped(S.PIN_VOICE.replace("?<pin>", "")), spoken)
_rule_query("r13_ordinal", "ORDINAL", "text", DOC_SRC, whole(S.ordinal_grammar()), documents)
_rule_query("r13_ordinal_voice", "ORDINAL", "voice", SPOKEN_SRC, whole(S.ordinal_grammar()), spoken)
_rule_query("r14_cardinal_text", "CARDINAL", "text", DOC_SRC, cardinal_mark(True), documents)
_rule_query("r15_cardinal_voice", "CARDINAL", "voice", SPOKEN_SRC, cardinal_mark(False), spoken)
_rule_query("r16_ignore", "_IGNORE_", "text", DOC_SRC, whole(IGNORE_RE), documents)
