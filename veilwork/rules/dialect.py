r"""Rule patterns to Java patterns (plan-time helper, works on a few strings on the driver).

User rules are written in the dialect of Python's ``regex`` package.  Handled here:
``(?(DEFINE)...)`` blocks with ``(?&name)`` calls, verbose mode, ``\m`` / ``\M``, named
groups (Java names may not hold ``_``), and flag names.
"""

from __future__ import annotations

import re

FLAG_LETTERS = {
    "ASCII": "a", "A": "a", "IGNORECASE": "i", "I": "i", "MULTILINE": "m", "M": "m",
    "DOTALL": "s", "S": "s", "VERBOSE": "x", "X": "x", "LOCALE": "", "L": "",
}


class PatternError(ValueError):
    """A rule pattern which cannot be expressed."""


def flag_letters(names) -> str:
    names = [names] if isinstance(names, str) else names
    return "".join(sorted({FLAG_LETTERS.get(n, "") for n in names} - {""}))


def tokens(pattern: str):
    """Yield ``(position, token)``; escapes and character classes are one token each."""
    i = 0
    while i < len(pattern):
        m = re.compile(r"\\Q.*?\\E|\\[pPNx]\{[^}]*\}|\\.|\[\^?\]?(?:\\.|\[:\w+:\]|[^\]\\])*\]|.", re.S).match(pattern, i)
        yield i, m.group()
        i = m.end()


def strip_verbose(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        t = next(tokens(pattern[i:]))[1]
        if t == "#":
            i = (pattern + "\n").index("\n", i)
            continue
        if not t.isspace():
            out.append(t)
        i += len(t)
    return "".join(out)


def _group_end(pattern: str, start: int) -> int:
    depth = 0
    for i, t in tokens(pattern[start:]):
        depth += (t == "(") - (t == ")")
        if depth == 0:
            return start + i
    raise PatternError(f"unbalanced group in {pattern[start:start + 40]!r}")


def inline_definitions(pattern: str) -> str:
    defs: dict[str, str] = {}
    while (at := pattern.find("(?(DEFINE)")) >= 0:
        end = _group_end(pattern, at)
        block = pattern[at + len("(?(DEFINE)"):end]
        pattern = pattern[:at] + pattern[end + 1:]
        while m := re.search(r"\(\?P?<([A-Za-z_]\w*)>", block):
            stop = _group_end(block, m.start())
            defs[m.group(1)] = block[m.end():stop]
            block = block[stop + 1:]

    def expand(text: str, active: tuple) -> str:
        def call(m):
            name = m.group(1)
            if name in active or name not in defs:
                raise PatternError(f"recursive or unknown definition: {name}")
            return "(?:" + expand(defs[name], active + (name,)) + ")"
        return re.sub(r"\(\?&(\w+)\)", call, text)

    return expand(pattern, ())


def number_groups(pattern: str) -> tuple[str, dict[str, int]]:
    """Turn named groups into plain ones; return the numbers of the names."""
    names, out, n, i = {}, [], 0, 0
    toks = list(tokens(pattern))
    for i, t in toks:
        if t == "(":
            m = re.match(r"\(\?P?<([A-Za-z_]\w*)>", pattern[i:])
            if m or pattern[i:i + 2] != "(?":
                n += 1
            if m:
                names[m.group(1)] = n
    return re.sub(r"(?<!\\)\(\?P?<([A-Za-z_]\w*)>", "(", pattern), names


def to_java(pattern: str, flags: str = "i") -> tuple[str, dict[str, int], str]:
    """Return the Java pattern without flags, its group names, and the inline flag prefix."""
    letters = set(flags)
    for m in re.finditer(r"(?<!\\)\(\?([aimsxLuw]+)\)", pattern):
        letters |= set(m.group(1))
    pattern = re.sub(r"(?<!\\)\(\?[aimsxLuw]+\)", "", pattern)
    if "x" in letters:
        pattern = strip_verbose(pattern)
    pattern = inline_definitions(pattern)
    pattern = pattern.replace("(?!\\s*)?", "")
    pattern = pattern.replace(r"\m", r"\b(?=\w)").replace(r"\M", r"\b(?<=\w)")
    pattern, names = number_groups(pattern)
    keep = "".join(sorted(letters & set("ims")))
    return pattern, names, f"(?{keep}d)" if "a" in letters else f"(?{keep}dU)"


def capture_lead(pattern: str, group: int) -> tuple[str, int, int]:
    """Add groups ``vw0, vw1, ...`` that cover a match up to the given group.

    At every level of nesting around the group, the part of its own branch which stands
    before it is wrapped.  Returns the pattern, the new number of the group, and how many
    groups were added.
    """
    stack, path, n = [[0, None]], None, 0      # [start of current branch, paren position]
    for i, t in tokens(pattern):
        if t == "(":
            head = re.match(r"\((?:\?(?:[:>=!]|<[=!]|[a-z]+:))?", pattern[i:]).group()
            capturing = head == "("
            n += capturing
            if capturing and n == group:
                path = [level[0] for level in stack] , [level[1] for level in stack[1:]] + [i]
                break
            stack.append([i + len(head), i])
        elif t == ")":
            stack.pop()
        elif t == "|":
            stack[-1][0] = i + 1
    if path is None:
        raise PatternError(f"no group {group}")
    if re.search(r"\\[1-9]", pattern):
        raise PatternError("back-references cannot be combined with a group")
    cuts = [(a, b) for a, b in zip(*path) if b > a]
    out, at = [], 0
    for k, (a, b) in enumerate(cuts):
        out += [pattern[at:a], f"(?<vw{k}>", pattern[a:b], ")"]
        at = b
    wrapped = "".join(out) + pattern[at:]
    # The group keeps its order among the old ones; each added group stands before it.
    return wrapped, group + len(cuts), len(cuts)


def alternation(patterns: list[str]) -> str:
    """Several patterns as one, tried in list order."""
    return "((" + ")|(".join(patterns) + "))"
