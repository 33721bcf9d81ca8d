"""Surrogate values as SQL text over keyed draws.

A draw is a pure function of a key and a slot: the first 32 bits of an md5.  The key holds
the seed, the conversation, the label and its index, so equal labels get equal surrogates
on every partition and in every batch, without any shared state.
"""

from __future__ import annotations

import string
from re import _constants as rc
from re import _parser as parser

from veilwork.functions.marks import CLOSE, MID, OPEN, quote
from veilwork.functions.text import DIGIT_WORDS, TEENS, TENS


class Draws:
    """Draws of one surrogate: ``key`` is SQL text, slots are counted up as they are used."""

    def __init__(self, key: str):
        self.key, self.slot = key, 0

    def below(self, n: int) -> str:
        """A number 0..n-1."""
        slot, self.slot = self.slot, self.slot + 1
        return (f"pmod(cast(conv(substr(md5(concat({self.key}, '|{slot}')), 1, 8), 16, 10) AS bigint), {n})")

    def pick(self, words) -> str:
        words = [str(w) for w in words]
        if len(words) == 1:
            return quote(words[0])
        return f"element_at(array({', '.join(map(quote, words))}), cast(1 + {self.below(len(words))} AS int))"

    def between(self, low: int, high: int) -> str:
        """A number low..high-1 as text."""
        return f"cast({low} + {self.below(high - low)} AS string)"


def digits_in_words(sql: str) -> str:
    for d, w in enumerate(DIGIT_WORDS):
        sql = f"replace({sql}, '{d}', ' {w}')"
    return sql


def spell(n: int) -> str:
    """0..999 in words, for small constant tables."""
    if n < 20:
        return (DIGIT_WORDS + TEENS)[n]
    if n < 100:
        return TENS[n // 10 - 2] + (f"-{DIGIT_WORDS[n % 10]}" if n % 10 else "")
    return f"{DIGIT_WORDS[n // 100]} hundred" + (f" and {spell(n % 100)}" if n % 100 else "")


def from_patterns(patterns, draws: Draws, limit: int = 10) -> str:
    """a random text of one of the patterns; ``limit`` bounds ``*`` and ``+``.

    A single pattern given as a plain string is a list of one.
    """
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    return _choose([list(parser.parse(p)) for p in patterns], draws, limit)


def _choose(alternatives: list, draws: Draws, limit: int) -> str:
    if len(alternatives) == 1:
        return _sequence(alternatives[0], draws, limit)
    if all(op is rc.LITERAL for alt in alternatives for op, _ in alt):
        return draws.pick(["".join(chr(c) for _, c in alt) for alt in alternatives])
    which = draws.below(len(alternatives))
    texts = [_sequence(alt, draws, limit) for alt in alternatives]
    cases = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts[:-1]))
    return f"(CASE {which} {cases} ELSE {texts[-1]} END)"


def _sequence(nodes, draws: Draws, limit: int) -> str:
    out, plain = [], ""
    for op, arg in nodes:
        if op is rc.LITERAL:
            plain += chr(arg)
            continue
        if plain:
            out, plain = out + [quote(plain)], ""
        out.append(_node(op, arg, draws, limit))
    out = [t for t in out + ([quote(plain)] if plain else []) if t != "''"]
    return f"concat({', '.join(out)})" if len(out) > 1 else (out[0] if out else "''")


def _node(op, arg, draws: Draws, limit: int) -> str:
    if op is rc.IN or op is rc.CATEGORY or op is rc.ANY or op is rc.NOT_LITERAL:
        return draws.pick(_characters(op, arg))
    if op is rc.BRANCH:
        return _choose([list(a) for a in arg[1]], draws, limit)
    if op is rc.SUBPATTERN:
        return _sequence(list(arg[3]), draws, limit)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, item = arg
        high = max(low, limit) if high == rc.MAXREPEAT else int(high)
        if low == high:
            return _sequence_texts([_sequence(list(item), draws, limit) for _ in range(high)])
        count = draws.below(high - low + 1)
        texts = [_sequence(list(item), draws, limit) for _ in range(high)]
        return _sequence_texts([t if i < low else f"IF({low} + {count} > {i}, {t}, '')"
                                for i, t in enumerate(texts)])
    if op is rc.AT:
        return "''"
    raise ValueError(f"a generator cannot use {op}")


def _sequence_texts(texts: list[str]) -> str:
    return f"concat({', '.join(texts)})" if len(texts) > 1 else (texts[0] if texts else "''")


_CATEGORIES = {rc.CATEGORY_DIGIT: string.digits, rc.CATEGORY_SPACE: " ",
               rc.CATEGORY_WORD: string.ascii_letters + string.digits + "_"}


def _characters(op, arg) -> str:
    if op is rc.ANY:
        return string.printable[:95]
    if op is rc.CATEGORY:
        return _CATEGORIES[arg]
    if op is rc.NOT_LITERAL:
        return string.printable[:95].replace(chr(arg), "")
    chars, negate = "", False
    for kind, value in arg:
        if kind is rc.NEGATE:
            negate = True
        elif kind is rc.RANGE:
            chars += "".join(chr(c) for c in range(value[0], value[1] + 1))
        elif kind is rc.CATEGORY:
            chars += _CATEGORIES[value]
        else:
            chars += chr(value)
    return "".join(c for c in string.printable[:95] if c not in chars) if negate else chars


class LongList:
    """A phrase list that stays a table: a draw leaves ``(list, number)`` in marks, filled in by a join (``anonymize``)."""

    def __init__(self, number: int, size: int):
        self.number, self.size = number, size


def _phrase(words, draws: Draws) -> str:
    if isinstance(words, LongList):
        return f"concat({quote(OPEN + str(words.number) + MID)}, cast({draws.below(words.size)} AS string), '{CLOSE}')"
    return draws.pick(words)


def surrogate(kind: str, params, modality: str, draws: Draws) -> str:
    """SQL text of the surrogate of one anonymiser block."""
    from veilwork.operators.registry import SURROGATES
    if kind in SURROGATES:
        return SURROGATES[kind](draws, params)
    text = modality == "text"
    if kind == "nullstring":
        return "''"
    if kind == "regex":
        block = params[modality]
        return from_patterns(block["regex"], draws, block.get("limit", 10))
    if kind in ("phone", "ssn"):
        a = draws.between(200, 999)
        b = draws.between(200, 999) if kind == "phone" else draws.between(10, 99)
        c = draws.between(1000, 9999)
        return f"concat({a}, '-', {b}, '-', {c})" if text else digits_in_words(f"concat({a}, {b}, {c})")
    lists = params[modality]
    lists = [b["phrase-list"] for b in (lists if isinstance(lists, list) else [lists])]
    if kind == "phraselist":
        return _sequence_texts([_phrase(words, draws) for words in lists])
    if kind == "address":
        number = draws.below(400)
        shown = (f"cast(100 + {number} AS string)" if text else
                 f"element_at(array({', '.join(quote(spell(n)) for n in range(100, 500))}), cast(1 + {number} AS int))")
        return f"concat({shown}, ' ', {_phrase(lists[0], draws)}, ' ')"
    if kind == "zipc":
        words = lists[0] if text else ["".join(" " + DIGIT_WORDS[int(d)] for d in str(z)) for z in lists[0]]
        return _phrase(words, draws)
    raise ValueError(f"unknown surrogate kind {kind!r}")
