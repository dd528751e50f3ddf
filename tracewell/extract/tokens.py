"""A tokenizer for JavaScript and TypeScript text that bears any input."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, number, string, template, regex, mark
    text: str
    at: int


_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Za-z_$\u0080-\U0010ffff#][\w$\u0080-\U0010ffff]*")
_NUMBER = re.compile(r"\d[\w.]*")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?', re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_MARK = re.compile(r"=>|\.\.\.|\?\.|\?\?=?|===|!==|==|!=|<=|>=|&&=?|\|\|=?|\+\+|--|\*\*|[-+*/%&|^]=|.", re.S)
#: After these words a slash begins a regular expression.
_OPENS = frozenset("return typeof case in of delete void throw new instanceof await yield else do".split())


class Source:
    """Tokens and comments of a text, with the partner of every bracket."""

    def __init__(self, text: str):
        self.text = text
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, int]] = []
        self._lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self._scan()
        self._pair()

    def line(self, at: int) -> int:
        return bisect_right(self._lines, at)

    def column(self, at: int) -> int:
        return at - self._lines[self.line(at) - 1] + 1

    def _scan(self) -> None:
        text, i, n, out = self.text, 0, len(self.text), self.tokens
        while i < n:
            if m := _SPACE.match(text, i):
                i = m.end()
                continue
            c = text[i]
            if text.startswith("//", i) or (i == 0 and text.startswith("#!")):
                end = text.find("\n", i)
                end = n if end < 0 else end
                self.comments.append((i, end))
                i = end
                continue
            if text.startswith("/*", i):
                end = text.find("*/", i + 2)
                end = n if end < 0 else end + 2
                self.comments.append((i, end))
                i = end
                continue
            if c in "\"'":
                m, kind = _STRING.match(text, i), "string"
            elif c == "`":
                end = self._template_end(i)
                out.append(Token("template", text[i:end], i))
                i = end
                continue
            elif c == "/" and self._regex_may_start() and (m := _REGEX.match(text, i)):
                kind = "regex"
            elif m := _NAME.match(text, i):
                kind = "name"
            elif m := _NUMBER.match(text, i):
                kind = "number"
            else:
                m, kind = _MARK.match(text, i), "mark"
            out.append(Token(kind, m.group(), i))
            i = max(m.end(), i + 1)

    def _template_end(self, i: int) -> int:
        text, n = self.text, len(self.text)
        i += 1
        while i < n:
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1
            elif text.startswith("${", i):
                depth, i = 1, i + 2
                while i < n and depth:
                    if text[i] == "`":
                        i = self._template_end(i)
                        continue
                    depth += {"{": 1, "}": -1}.get(text[i], 0)
                    i += 1
            else:
                i += 1
        return n

    def _regex_may_start(self) -> bool:
        if not self.tokens:
            return True
        last = self.tokens[-1]
        if last.kind == "name":
            return last.text in _OPENS
        return last.kind == "mark" and last.text not in (")", "]", "}", "++", "--")

    def _pair(self) -> None:
        """partner[k]: the token that closes or opens token k, or -1."""
        self.partner = [-1] * len(self.tokens)
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in "([{":
                stack.append(k)
            elif t.text in ")]}":
                want = {")": "(", "]": "[", "}": "{"}[t.text]
                for s in range(len(stack) - 1, -1, -1):
                    if self.tokens[stack[s]].text == want:
                        self.partner[k], self.partner[stack[s]] = stack[s], k
                        del stack[s:]
                        break

    def word(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def kind(self, k: int) -> str:
        return self.tokens[k].kind if 0 <= k < len(self.tokens) else ""

    def between(self, a: int, b: int) -> str:
        """The text from token a to token b, exclusive of both brackets' insides' ends."""
        if a + 1 >= b:
            return ""
        return self.text[self.tokens[a].at + len(self.tokens[a].text) : self.tokens[b].at]


def unquoted(text: str) -> str:
    return text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]


def innermost(spans: list[tuple[int, int]], n: int) -> list[int]:
    """For each k below n the number of the span (a, b) that begins last with a < k <= b, or -1; of spans that begin
    together the one that ends first, then the first named. One sweep, whatever the nesting."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][1], -i))
    out, open_, at = [-1] * max(0, n), [], 0
    for k in range(n):
        while at < len(order) and spans[order[at]][0] < k:
            open_.append(order[at])
            at += 1
        while open_ and spans[open_[-1]][1] < k:
            open_.pop()
        if open_:
            out[k] = open_[-1]
    return out
