"""Generator formats (fixed values) and small neutral phrase lists for surrogates."""

from veilwork.rules.shipped import MONTHS, ONE_TO_NINE, ORDINALS_TO_TEN, TEN_TO_NINETEEN, TENS

# ---- fixed values: generator formats -------------------------------------------------
_DIGIT = "zero|one|two|three|four|five|six|seven|eight|nine"
_DIGIT_OH = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
_HOURS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
_TO_99 = f"({ONE_TO_NINE}|{TEN_TO_NINETEEN})|({TENS}) ({ONE_TO_NINE})"
_CENTS = f"(({TENS}|) ({ONE_TO_NINE}) cents){{0,1}}"
_DAYS = "|".join(ORDINALS_TO_TEN) + (
    "|eleventh|twelfth|thirteenth|fourteenth|fifteenth|sixteenth|seventeenth|eighteenth|nineteenth"
    "|twentieth|twenty first|twenty second|twenty third|twenty fourth|twenty fifth|twenty sixth"
    "|twenty seventh|twenty eighth")
_MONTH_NUMBERS = "01|02|03|04|05|06|07|08|09|10|11|12"

PIN_TEXT = ["[0-9]{4}"]
PIN_VOICE = [f"( ({_DIGIT})){{4}}"]
QUANTITY_TEXT = ["([1-9][0-9]{0,1}[0-9]{0,1}[0-9]{0,1})"]
QUANTITY_VOICE = [f"(({_TO_99}) hundred and ){{0,1}}({_TO_99})"]
PRODUCT = ["cheese|beef|milk|corn|couch|chair|table|window|stove|desk"]
PERCENT_TEXT = [r"([1-9][0-9]{0,1})\%"]
PERCENT_VOICE = [f"({_TO_99}) percent"]
ORDINAL_TEXT = ["1st|2nd|3rd|4th|5th|6th|7th|8th|9th|10th"]
ORDINAL_VOICE = ["|".join(ORDINALS_TO_TEN)]
MONEY_TEXT = [r"\$([1-9]\d{0,2})(\.\d{2}){0,1}"]
MONEY_VOICE = [f"({TENS}) ({ONE_TO_NINE}|) dollars {_CENTS}",
               f"({TEN_TO_NINETEEN}|) dollars {_CENTS}"]
EVENT = ["seminar|conference|trade show|workshop|reunion|party|gala|picnic|meeting|lunch"]
CCARD_TEXT = [r"4\d{3}-\d{4}-\d{4}-\d{4}", r"3[47]\d{2}-\d{6}-\d{5}"]
CCARD_VOICE = [f"four ( ({_DIGIT_OH})){{15}}", f"three ( ({_DIGIT_OH})){{14}}"]
CARDINAL_TEXT = [" (0|1|2|3|4|5|6|7|8|9) "]
CARDINAL_VOICE = [f" ({_DIGIT}) "]
DATE_VOICE = [f"({'|'.join(MONTHS)}) ({_DAYS})"]
DATE_TEXT = [rf"({_MONTH_NUMBERS})\/(0|1|2)[0-9]\/20(20|21|22|23|24|25|26)"]
TIME_TEXT = [f"({_MONTH_NUMBERS}):(0|1|2|3|4|5)[0-9] (AM|PM)"]
TIME_VOICE = [f"({_HOURS}) (oh|twenty|thirty|forty|fifty) ({ONE_TO_NINE}) (AM|PM)",
              f"({_HOURS}) (|ten|twenty|thirty|forty|fifty) (AM|PM)",
              f"({_HOURS}) (eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen) (AM|PM)"]
LANGUAGE = ["Chinese|Spanish|English|Hindi|Arabic|Portuguese|Russian|German|Korean|French|Turkish"]
MAIL_DOMAINS = ["@gmail.com", "@yahoo.com", "@hotmail.com", "@icloud.com", "@msn.com"]

# ---- own neutral lists; a site replaces them through its rule document ---------------
FIRST_NAMES = ["Ada", "Ben", "Clara", "Daniel", "Elena", "Felix", "Grace", "Hugo", "Iris", "Jonas",
               "Kira", "Leo", "Mara", "Nils", "Olga", "Paul", "Rosa", "Simon", "Tessa", "Victor"]
CITIES = ["Akron", "Boise", "Chico", "Dayton", "Eugene", "Fresno", "Gary", "Helena", "Irving",
          "Joliet", "Laredo", "Macon", "Norman", "Ogden", "Provo", "Reno", "Salem", "Tulsa"]
PLACES = ["Austria", "Brazil", "Canada", "Denmark", "Egypt", "Finland", "Ghana", "Hungary", "India",
          "Japan", "Kenya", "Latvia", "Mexico", "Norway", "Oman", "Peru", "Qatar", "Spain"]
COMPANIES = ["Acorn Goods", "Birch Market", "Cedar Stores", "Delta Outlet", "Elm Trading",
             "Fern Supply", "Grove Retail", "Hazel Shops", "Ivy Home", "Juniper Foods"]
NATIONALITIES = ["Austrian", "Brazilian", "Canadian", "Danish", "Egyptian", "Finnish", "Ghanaian",
                 "Hungarian", "Indian", "Japanese", "Kenyan", "Latvian", "Mexican", "Norwegian"]
ART_TITLES = ["Blue Harbour", "Evening Field", "Garden Path", "Quiet River", "Red Bridge",
              "Silver Lake", "The Orchard", "Winter Road"]
STREETS = ["Alder Way", "Birch Street", "Canal Road", "Dover Lane", "Elm Court", "Forest Drive",
           "Garden Place", "Hill Avenue", "Island View", "Juniper Trail"]
ZIPS = ["10001", "30303", "49265", "55801", "60601", "73301", "80202", "85001", "94105", "98101"]
