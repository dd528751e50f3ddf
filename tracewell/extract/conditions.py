"""What a condition tells of variables on its true and on its false edge."""

from __future__ import annotations

import re

from tracewell.extract.tokens import Source

_NAME = r"([\w$][\w$.]*)"
_TYPED = re.compile(rf"typeof\s+{_NAME}\s*(===?|!==?)\s*['\"](number|boolean|bigint|symbol|undefined)['\"]")
_EQUAL = re.compile(rf"{_NAME}\s*(===?|!==?)\s*(?:['\"][^'\"]*['\"]|-?\d[\w.]*|null|undefined|true|false)")
#: Calls that settle their argument when they are true: membership, a match, a validator by name, a numeric check.
_CALLS = tuple(re.compile(p) for p in (
    rf"[\w$.]+\.(?:has|includes)\(\s*{_NAME}\s*\)",
    rf"/.*/[a-z]*\.test\(\s*{_NAME}\s*\)",
    rf"(?:[\w$.]*\.)?(?:validate|isValid|isSafe|isAllowed|check|verify|isEmail|isUUID|isInt|isAlphanumeric)\w*\(\s*{_NAME}.*",
    rf"(?:Number\.)?(?:isInteger|isSafeInteger|isFinite)\(\s*{_NAME}\s*\)",
))

Settled = tuple[frozenset[str], frozenset[str]]
_NOTHING: Settled = (frozenset(), frozenset())


def _atom(text: str) -> Settled:
    for pattern in (_TYPED, _EQUAL):
        if m := pattern.fullmatch(text):
            found = frozenset([m.group(1)])
            return (frozenset(), found) if m.group(2).startswith("!") else (found, frozenset())
    for pattern in _CALLS:
        if m := pattern.fullmatch(text):
            return frozenset([m.group(1)]), frozenset()
    return _NOTHING


def settled(s: Source, a: int, b: int) -> Settled:
    """Variables that cannot hold any text where the condition in tokens [a, b) is true, and where it is false.

    They were compared with a literal, found in a fixed set, matched or validated, or are of a type that carries no text.
    """
    while b - a > 1 and s.word(a) == "(" and s.kind(a) == "mark" and s.partner[a] == b - 1:
        a, b = a + 1, b - 1
    for mark in ("?", "??", "||", "&&"):  # from the loosest; a choice settles nothing
        parts, i, start = [], a, a
        while i < b:
            if s.kind(i) == "mark" and s.word(i) in ("(", "[", "{") and s.partner[i] > i:
                i = s.partner[i]
            elif s.kind(i) == "mark" and s.word(i) == mark:
                parts.append((start, i))
                start = i + 1
            i += 1
        if parts:
            if mark in ("?", "??"):
                return _NOTHING
            each = [settled(s, x, y) for x, y in [*parts, (start, b)]]
            every = frozenset.intersection(*(e[mark == "&&"] for e in each))
            some = frozenset.union(*(e[mark == "||"] for e in each))
            return (every, some) if mark == "||" else (some, every)
    if a < b and s.word(a) == "!" and s.kind(a) == "mark":
        true, false = settled(s, a + 1, b)
        return false, true
    return _atom(s.text[s.tokens[a].at : s.tokens[b - 1].at + len(s.tokens[b - 1].text)]) if a < b else _NOTHING
