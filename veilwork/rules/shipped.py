"""The shipped detectors and generators.

The word lists and pattern formats below are fixed values: they decide what is found.
"""

from __future__ import annotations

# ---- fixed values: words -------------------------------------------------------------
ONE_TO_NINE = "one|two|three|four|five|six|seven|eight|nine"
TEN_TO_NINETEEN = "ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen"
TENS = "twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety"
SPOKEN_DIGIT = "one|two|three|four|five|six|seven|eight|nine|oh|0z"
SPOKEN_DIGIT_ZERO = "one|two|three|four|five|six|seven|eight|nine|oh|zero"
SPOKEN_ZERO_TO_SEVEN = "one|two|three|four|five|six|seven|oh|zero"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]
ORDINALS_TO_TEN = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth",
                   "ninth", "tenth"]
COUNT_WORDS = (ONE_TO_NINE + "|" + TEN_TO_NINETEEN + "|twenty|twenty one|twenty two|twenty three"
               "|twenty four|twenty five|twenty six|twenty seven|twenty eight|twenty nine"
               "|thirty|thirty one")
ORDINAL_ABBREVIATIONS = "1st|2nd|3rd|4th|5th|6th|7th|8th|9th|10th"

# ---- fixed values: levels, order -----------------------------------------------------
LEVEL_1 = ["_TOKEN_MAP_", "_IGNORE_", "_SPACY_", "PHONE", "PERSON", "ADDRESS", "CCARD", "MONEY",
           "SSN", "PIN"]
LEVEL_2 = LEVEL_1 + ["ZIP", "LOC", "EMAIL"]
LEVEL_3 = LEVEL_2 + ["CARDINAL", "DATE", "PERCENT", "TIME"]
LEVEL_4 = LEVEL_3 + ["FAC", "GPE", "LANGUAGE", "NORP", "PRODUCT", "EVENT", "LAUGHTER", "LAW",
                     "ORG", "QUANTITY", "WORK_OF_ART", "ORDINAL"]
LEVELS = {"0": ["_TOKEN_MAP_", "_IGNORE_"], "1": LEVEL_1, "2": LEVEL_2, "3": LEVEL_3, "4": LEVEL_4}
REDACTION_ORDER = [
    "_TOKEN_MAP_", "_IGNORE_", "PERSON", "ADDRESS", "CCARD", "PHONE", "SSN", "ZIP", "EMAIL",
    "MONEY", "LOC", "DATE", "EVENT", "FAC", "GPE", "LANGUAGE", "LAUGHTER", "LAW", "NORP", "ORG",
    "PERCENT", "PRODUCT", "QUANTITY", "TIME", "WORK_OF_ART", "PIN", "_SPACY_", "ORDINAL",
    "CARDINAL"]

# ---- fixed values: street suffixes ---------------------------------------------------
# Every suffix of postal addressing that ends a street, long and short forms.  A site with
# more passes them as RuleSet(street_suffixes=[...]).
STREET_SUFFIXES = """
ALLEE ALLEY ALLY ALY ANEX ANNEX ANNX ANX ARC ARCADE AV AVE AVEN AVENU AVENUE AVN AVNUE BAYOO BAYOU BCH BEACH
BEND BLF BLUF BLUFF BLUFFS BLVD BND BOT BOTTM BOTTOM BOUL BOULEVARD BOULV BR BRANCH BRDGE BRG BRIDGE BRK BRNCH
BROOK BROOKS BTM BURG BURGS BYP BYPA BYPAS BYPASS BYPS CAMP CANYN CANYON CAPE CAUSEWAY CAUSWA CEN CENT CENTER
CENTERS CENTR CENTRE CIR CIRC CIRCL CIRCLE CIRCLES CLB CLF CLFS CLIFF CLIFFS CLUB CMP CNTER CNTR CNYN COMMON
COMMONS COR CORNER CORNERS CORS COURSE COURT COURTS COVE COVES CP CPE CRCL CRCLE CREEK CRES CRESCENT CREST CRK
CROSSING CROSSROAD CROSSROADS CRSE CRSENT CRSNT CRSSNG CSWY CT CTR CTS CURVE CV DALE DAM DIV DIVIDE DL DM DR
DRIV DRIVE DRIVES DRV DV DVD EST ESTATE ESTATES ESTS EXP EXPR EXPRESS EXPRESSWAY EXPW EXPY EXT EXTENSION EXTN
EXTNSN EXTS FALL FALLS FERRY FIELD FIELDS FLAT FLATS FLD FLDS FLS FLT FLTS FORD FORDS FOREST FORESTS FORG
FORGE FORGES FORK FORKS FORT FRD FREEWAY FREEWY FRG FRK FRKS FRRY FRST FRT FRWAY FRWY FRY FT FWY GARDEN
GARDENS GARDN GATEWAY GATEWY GATWAY GDNS GLEN GLENS GLN GRDEN GRDN GRDNS GREEN GREENS GRN GROV GROVE GROVES
GRV GTWAY GTWY HARB HARBOR HARBORS HARBR HAVEN HBR HIGHWAY HIGHWY HILL HILLS HIWAY HIWY HL HLLW HLS HOLLOW
HOLLOWS HOLW HOLWS HRBOR HT HTS HVN HWAY HWY INLT IS ISLAND ISLANDS ISLE ISLES ISLND ISLNDS ISS JCT JCTION
JCTN JCTNS JCTS JUNCTION JUNCTIONS JUNCTN JUNCTON KEY KEYS KNL KNLS KNOL KNOLL KNOLLS KY KYS LAKE LAKES LAND
LANDING LANE LCK LCKS LDG LDGE LF LGT LIGHT LIGHTS LK LKS LN LNDG LNDNG LOAF LOCK LOCKS LODG LODGE LOOP LOOPS
MALL MANOR MANORS MDW MDWS MEADOW MEADOWS MEDOWS MEWS MILL MILLS MISSN MNR MNRS MNT MNTAIN MNTN MNTNS MOTORWAY
MOUNT MOUNTAIN MOUNTAINS MOUNTIN MSSN MT MTIN MTN NCK NECK ORCH ORCHARD ORCHRD OVAL OVERPASS OVL PARK PARKS
PARKWAY PARKWAYS PARKWY PASS PASSAGE PATH PATHS PIKE PIKES PINE PINES PKWAY PKWY PKWYS PKY PL PLAIN PLAINS
PLAZA PLN PLNS PLZ PLZA PNES POINT POINTS PORT PORTS PR PRAIRIE PRK PRR PRT PRTS PT PTS RAD RADIAL RADIEL RADL
RAMP RANCH RANCHES RAPID RAPIDS RD RDG RDGE RDGS RDS REST RIDGE RIDGES RIV RIVER RIVR RNCH RNCHS ROAD ROADS
ROUTE ROW RPD RPDS RST RUE RUN RVR SHL SHLS SHOAL SHOALS SHOAR SHOARS SHORE SHORES SHR SHRS SKYWAY SMT SPG
SPGS SPNG SPNGS SPRING SPRINGS SPRNG SPRNGS SPUR SPURS SQ SQR SQRE SQRS SQU SQUARE SQUARES ST STA STATION
STATN STN STR STRA STRAV STRAVEN STRAVENUE STRAVN STREAM STREET STREETS STREME STRM STRT STRVN STRVNUE SUMIT
SUMITT SUMMIT TER TERR TERRACE THROUGHWAY TRACE TRACES TRACK TRACKS TRAFFICWAY TRAIL TRAILER TRAILS TRAK TRCE
TRK TRKS TRL TRLR TRLRS TRLS TRNPK TUNEL TUNL TUNLS TUNNEL TUNNELS TUNNL TURNPIKE TURNPK UN UNDERPASS UNION
UNIONS VALLEY VALLEYS VALLY VDCT VIA VIADCT VIADUCT VIEW VIEWS VILL VILLAG VILLAGE VILLAGES VILLE VILLG
VILLIAGE VIS VIST VISTA VL VLG VLGS VLLY VLY VLYS VST VSTA VW VWS WALK WALKS WALL WAY WAYS WELL WELLS WLS WY
XING""".split()


def street_suffixes(extra=()) -> list[str]:
    """Longest first, so that a short form never hides a longer one."""
    return sorted({*STREET_SUFFIXES, *(w.upper() for w in extra)}, key=lambda w: (-len(w), w))


# ---- guards --------------------------------------------------------------------------
def _any_case(letter: str) -> str:
    """All characters which a case-blind pattern takes for the letter."""
    return letter.lower() + letter.upper() + {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}.get(letter.lower(), "")


def starts_with(words, also: str = "") -> str:
    """A look-ahead for the first three letters of the words.

    It changes no result (every alternative behind it begins with one of the words) but
    lets the regex engine leave most positions at once instead of trying each alternative.
    Case is spelled out, as plain classes are much faster than case-blind ones.
    """
    by_letter: dict[str, set] = {}
    for w in words:
        by_letter.setdefault(w[0].lower(), set()).add("".join(f"[{_any_case(c)}]" for c in w[1:3]))
    tree = "|".join(f"[{_any_case(c)}](?:{'|'.join(sorted(rest))})" for c, rest in sorted(by_letter.items()))
    first = "".join(map(_any_case, sorted(by_letter)))
    return f"(?-i:(?=[{first}0-9])(?={tree}{'|' + also if also else ''}))"


IGNORE_STARTS = ("first today yesterday cv pin tomorrow this that another some last next previous new "
                 "old second third fourth fifth sixth seventh eighth ninth tenth twenty thirty").split()
ORDINAL_STARTS = "fir seco thi four fif six seven eigh nin ten eleven twelf twen for".split()

# ---- fixed values: detector formats --------------------------------------------------
IGNORE_PHRASES = [
    "first name",
    "first and",
    "today|yesterday",
    "CV|PIN",
    "(tomorrow|today|yesterday)",
    f"(this|that|another|some|last|next|previous|new|old) ({COUNT_WORDS})",
    f"({ORDINAL_ABBREVIATIONS}|{'|'.join(ORDINALS_TO_TEN)}) (one)",
    f"({ORDINAL_ABBREVIATIONS}|{'|'.join(ORDINALS_TO_TEN)}|{COUNT_WORDS}|[0-9]{{1,2}}) "
    "(moment(s)?|phones(s)?|devices(s)?|account(s)?|(person|people)|minute(s)?|second(s)?|hour(s)?"
    "|day(s)?|month(s)?|week(s)?|years(s)?|times(s)?|of|more time(s)?)",
    "(2|3|4|5|two|three|four|five)[ -]?g",
    "one (off|by one)",
]
PHONE_TEXT = (r"((?:(?<![\d-])(?:\+?\d{1,3}[-.\s*]?)?(?:\(?\d{3}\)?[-.\s*]?)?\d{3}[-.\s*]?\d{4}(?![\d-]))"
              r"|(?:(?<![\d-])(?:(?:\(\+?\d{2}\))|(?:\+?\d{2}))\s*\d{2}\s*\d{3}\s*\d{4}(?![\d-])))")
EMAIL = r"[A-Z0-9._%+-]++@[A-Z0-9.-]+\.[A-Z]{2,}"
CCARD_TEXT = r"(?:\d[ -]*?){13,16}"
SSN_TEXT = (r"(^|\s)(?<ssn>(?!000|666)[0-8][0-9]{2}(-|\s)?(?!00)[0-9]{2}(-|\s)?(?!0000)[0-9]{4})"
            r"(\s|$|\.)")
UNUSED_ZIP_PREFIXES = ("00[02-5]|099|213|269|34[358]|353|419|42[89]|51[789]|529|53[36]|552|5[67]8|5[78]9"
                       "|621|6[348]2|6[46]3|659|69[4-9]|7[034]2|709|715|771|81[789]|8[3469]9|8[4568]8"
                       "|8[6-9]6|8[68]7|9[02]9|987")
CANADA_FIRST = r"[ABCEGHJKLMNPRSTVXY]{1}\d{1}[A-Z]{1}"
CANADA_LAST = r"\d{1}[A-Z]{1}\d{1}"
ZIP_TEXT = (rf"(({CANADA_FIRST}(?:[ ](?=\d))?{CANADA_LAST})$)"
            rf"|((^|\s{{1}})(?<zip>(?!{UNUSED_ZIP_PREFIXES})\d{{5}})(\s|\.|$|\-([0-9]{{4}})?))")
PIN_TEXT = r"(^|\s)(?<pin>(?:(\d{4})))\s*?"
NOT_A_COUNT = ("%|percent|((of)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))"
               "|dollar|pound|cent|pence")


# Phrases that the named patterns are tested with.
RULE_TESTS = {
    "pin-text": [
        {"match-type": "ONE_OR_MORE_MATCH", "phrases": ["1234", "the pin number is 1234."]},
        {"match-type": "NO_MATCHES", "phrases": ["abc1234de", "1 2 3 4"]},
    ],
    "pin-voice": [
        {"match-type": "ONE_OR_MORE_MATCH",
         "phrases": ["one two three four", "the pin number is one two three four maiden name is walsh"]},
    ],
}


def spoken(digits: str, groups: list[int], glue: str, first: str | None = None) -> str:
    """Spelled-out digits in groups; ``glue`` stands between groups, ``\\s?`` inside."""
    d = f"(?:{digits})"
    return glue.join(r"\s?".join([d] * n) for n in groups)


PIN_VOICE = rf"(^|\s)(?<pin>{spoken(SPOKEN_DIGIT, [4], '')})"
ZIP_VOICE = rf"(^|\s)(?<zip>{spoken(SPOKEN_DIGIT, [5], '')})"
PHONE_VOICE = rf"(^|\s)(?:{spoken(SPOKEN_DIGIT, [3, 3, 4], r'[\s,]{1,2}')})"
SSN_VOICE = (rf"(?<ssn>(?:(?:{SPOKEN_ZERO_TO_SEVEN})\s(?:(?:{SPOKEN_DIGIT_ZERO})\s){{7}}"
             rf"(?:{SPOKEN_DIGIT_ZERO})))")
_D0 = f"(?:{SPOKEN_DIGIT_ZERO})"
CCARD_VOICE = (rf"(?:(?:four|for)\s(?:{_D0}\s){{14}}{_D0}"
               rf"|five\s(?:one|two|to|three|four|for|five)\s(?:{_D0}\s){{13}}{_D0}"
               rf"|three\s(?:four|for|seven)\s(?:{_D0}\s){{12}}{_D0})")


def _scales(ninety_nine: str, one_nine: str) -> str:
    """English number grammar up to trillions over the given smaller parts."""
    hundreds = f"(?:{one_nine}[ ]hundred(?:[ ](?:and[ ])?{ninety_nine})?|{ninety_nine})"
    below = hundreds
    for word in ["thousand", "million", "billion", "trillion"]:
        below = f"(?:{hundreds}[ ]{word}(?:[ ]{below})?|{below})"
    return below


def cardinal_grammar() -> str:
    one9, teens, tens = (rf"(?:\b(?:{w})\b)" for w in (ONE_TO_NINE, TEN_TO_NINETEEN, TENS))
    return rf"(?:\bzero\b|{_scales(f'(?:{tens}(?:[- ]{one9})?|{teens}|{one9})', one9)})"


def ordinal_grammar() -> str:
    stems = "s(?:even|ix)|t(?:hir|wen)|f(?:if|or)|eigh|nine"
    one9 = "(?:(?:fir|seco|thi|four|fif|six|seven|eigh|nin|[1-9])(?:st|nd|rd|th))"
    teens = "(?:(?:ten|eleven|twelf|(?:thir|four|fif|six|seven|eigh|nine)teen)th|1[0-9]th)"
    tens = f"(?:(?:{stems})tieth|[2-9]0th)"
    numeric = "(?:[2-9][1-9](?:st|nd|rd|th))"
    return _scales(f"(?:{tens}|{numeric}|(?:{stems})ty[- ]{one9}|{teens}|{one9})", one9)


ORDINAL = starts_with(ORDINAL_STARTS, "[1-9][0-9snrtSNRT\u017f]") + ordinal_grammar()
_NUMBER_WORD = (r"\b" + starts_with((ONE_TO_NINE + "|" + TEN_TO_NINETEEN + "|" + TENS + "|zero").split("|"))
                + cardinal_grammar())
CARDINAL_TEXT = rf"(?:{_NUMBER_WORD}|\d+)(?!\s*(?:st|nd|rd|th|{NOT_A_COUNT}))"
CARDINAL_VOICE = rf"{_NUMBER_WORD}(?!\s*(?:{NOT_A_COUNT}))"


def address(extra_suffixes=()) -> str:
    """House number, fraction, compass, street words, suffix (no right boundary), compass."""
    north_south, east_west = "(?:N(?:orth)?|S(?:outh)?)?", "(?:E(?:ast)?|W(?:est)?)"
    suffix = rf" (?>{'|'.join(street_suffixes(extra_suffixes))})"
    # Street words up to the last one that a suffix follows.  Each round takes one word and the
    # words up to the next suffix; possessive groups run as loops, so long texts need no stack.
    streets = rf"(?: [A-Z][a-z]++(?:(?!{suffix}) [A-Z][a-z]++)*+(?={suffix}))++"
    return (rf"\d{{1,6}}(?> 1/[234])?(?: {north_south} ?{east_west})?"
            rf"(?:(?> \d+ ?(?:th|rd|st|nd))|{streets})"
            rf"{suffix}(?: {north_south} ?{east_west}?)?")


def shipped_rules(street_suffixes=()) -> dict:
    """The default rule document: same keys as a user's rule file."""
    def regex(text=None, voice=None, group=None, needs=""):
        blocks = {}
        for modality, pattern in (("text", text), ("voice", voice)):
            if pattern is not None:
                blocks[modality] = {"regex": pattern, **({"group": group} if group else {}),
                                    **({"needs": needs} if needs else {})}
        return {"model-class": "regex", **blocks}

    def generate(text, voice=None):
        return {"model-class": "regex", "text": {"regex": text}, "voice": {"regex": voice or text}}

    def phrases(*word_lists, kind="phraselist"):
        block = [{"phrase-list": words} for words in word_lists]
        return {"model-class": kind, "text": block, "voice": block}

    from veilwork.rules import surrogate_lists as lists
    words = (COUNT_WORDS + "|" + TENS).split("|") + IGNORE_STARTS
    guarded = starts_with(words, "[0-9]") + "((" + ")|(".join(IGNORE_PHRASES) + "))"
    where = address(street_suffixes)
    removed = {"model-class": "nullstring"}
    ent = {
        "_IGNORE_": {"redactor": regex(guarded, guarded),
                     "anonymizer": {"model-class": "restoreentitytext"}},
        "_SPACY_": {"redactor": {"model-class": "spans"}},
        "ADDRESS": {"redactor": regex(where, where),
                    "anonymizer": phrases(lists.STREETS, kind="address")},
        "CCARD": {"redactor": regex(CCARD_TEXT, CCARD_VOICE),
                  "anonymizer": generate(lists.CCARD_TEXT, lists.CCARD_VOICE)},
        "PHONE": {"redactor": regex(r"(?=[\d+(])" + PHONE_TEXT, PHONE_VOICE), "anonymizer": {"model-class": "phone"}},
        "SSN": {"redactor": regex(r"(?=\s?\d)" + SSN_TEXT, SSN_VOICE, "ssn"), "anonymizer": {"model-class": "ssn"}},
        "ZIP": {"redactor": regex(r"(?=\d|\D\d)(?:" + ZIP_TEXT + ")", ZIP_VOICE, "zip"),
                "anonymizer": phrases(lists.ZIPS, kind="zipc")},
        "EMAIL": {"redactor": regex(EMAIL, EMAIL, needs="@"),
                  "anonymizer": phrases(lists.FIRST_NAMES, lists.MAIL_DOMAINS)},
        "PIN": {"redactor": regex(r"(?=\s?\d)" + PIN_TEXT, PIN_VOICE, "pin"),
                "anonymizer": generate(lists.PIN_TEXT, lists.PIN_VOICE)},
        "ORDINAL": {"redactor": regex(ORDINAL, ORDINAL),
                    "anonymizer": generate(lists.ORDINAL_TEXT, lists.ORDINAL_VOICE)},
        "CARDINAL": {"redactor": regex(CARDINAL_TEXT, CARDINAL_VOICE),
                     "anonymizer": generate(lists.CARDINAL_TEXT, lists.CARDINAL_VOICE)},
        "MONEY": {"anonymizer": generate(lists.MONEY_TEXT, lists.MONEY_VOICE)},
        "DATE": {"anonymizer": generate(lists.DATE_TEXT, lists.DATE_VOICE)},
        "TIME": {"anonymizer": generate(lists.TIME_TEXT, lists.TIME_VOICE)},
        "PERCENT": {"anonymizer": generate(lists.PERCENT_TEXT, lists.PERCENT_VOICE)},
        "QUANTITY": {"anonymizer": generate(lists.QUANTITY_TEXT, lists.QUANTITY_VOICE)},
        "EVENT": {"anonymizer": generate(lists.EVENT)},
        "LANGUAGE": {"anonymizer": generate(lists.LANGUAGE)},
        "PRODUCT": {"anonymizer": generate(lists.PRODUCT)},
        "LOC": {"anonymizer": phrases(lists.CITIES)},
        "GPE": {"anonymizer": phrases(lists.PLACES)},
        "ORG": {"anonymizer": phrases(lists.COMPANIES)},
        "NORP": {"anonymizer": phrases(lists.NATIONALITIES)},
        "PERSON": {"anonymizer": phrases(lists.FIRST_NAMES)},
        "WORK_OF_ART": {"anonymizer": phrases(lists.ART_TITLES)},
        "FAC": {"anonymizer": dict(removed)},
        "LAUGHTER": {"anonymizer": dict(removed)},
        "LAW": {"anonymizer": dict(removed)},
    }
    return {
        "level": {k: list(v) for k, v in LEVELS.items()},
        "always-anonymize": ["_IGNORE_"],
        "always-redact": ["_TOKEN_MAP_"],
        "redaction-order": list(REDACTION_ORDER),
        "anon-map": {}, "token-map": {}, "entities": ent,
        "regex": named_patterns(where), "regex-test": {k: [dict(t) for t in v] for k, v in RULE_TESTS.items()},
    }


def named_patterns(where: str) -> dict:
    """The patterns a rule document can name by ``regex-id`` or ``?INCLUDE<...>``."""
    from veilwork.rules import surrogate_lists as lists
    return {
        "oh_to_nine-voice": f"(?:{SPOKEN_DIGIT})", "zero_to_nine-voice": f"(?:{SPOKEN_DIGIT_ZERO})",
        "pin-text": PIN_TEXT, "pin-voice": PIN_VOICE, "zip-text": ZIP_TEXT, "zip-voice": ZIP_VOICE,
        "ssn-text": SSN_TEXT, "ssn-voice": SSN_VOICE, "phone-text": PHONE_TEXT, "phone-voice": PHONE_VOICE,
        "ccard-text": CCARD_TEXT, "ccard-voice": CCARD_VOICE, "email": EMAIL, "address": where,
        "ordinal-text": ORDINAL, "ordinal-voice": ORDINAL, "cardinal-text": CARDINAL_TEXT, "cardinal-voice": CARDINAL_VOICE,
        "ccard-text-gen": lists.CCARD_TEXT, "ccard-voice-gen": lists.CCARD_VOICE,
        "4-digit-text-gen": lists.PIN_TEXT, "4-digit-voice-gen": lists.PIN_VOICE,
        "ordinal-text-gen": lists.ORDINAL_TEXT, "ordinal-voice-gen": lists.ORDINAL_VOICE,
        "cardinal-text-gen": lists.CARDINAL_TEXT, "cardinal-voice-gen": lists.CARDINAL_VOICE,
        "money-text-gen": lists.MONEY_TEXT, "money-voice-gen": lists.MONEY_VOICE,
        "date-text-gen": lists.DATE_TEXT, "date-voice-gen": lists.DATE_VOICE,
        "time-text-gen": lists.TIME_TEXT, "time-voice-gen": lists.TIME_VOICE,
        "percent-text-gen": lists.PERCENT_TEXT, "percent-voice-gen": lists.PERCENT_VOICE,
        "event-gen": lists.EVENT, "language-gen": lists.LANGUAGE, "product-gen": lists.PRODUCT,
    }
