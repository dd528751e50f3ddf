"""Value flows of source files: what every assignment, argument and result is made of.

One row for each binding: (path, fn, kind, line, ix, arg, target, callee, uses). fn is the function's name, or its place if it
has none; the top of a file is "". Kinds:

- param: target is the parameter's name, arg its number, callee its decorator ("@Body"), if it has one;
- assign: target gets what uses hold;
- return: the function's result is made of uses;
- call: the call number ix of callee; target is the name that its result is given at once, if any;
- arg: argument number arg of the call ix; arg -1 is the object that a method is called on.

uses are dotted names ("req.body.id"), "@7" for the result of call number 7, and "=>f" for the function f as a value.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.extract.facts import _NOT_METHODS, Reader
from tracewell.extract.tokens import innermost

SCHEMA = "path string, fn string, kind string, line int, ix int, arg int, target string, callee string, uses array<string>"
_ARROW = pa.schema([("path", pa.string()), ("fn", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("ix", pa.int32()), ("arg", pa.int32()), ("target", pa.string()), ("callee", pa.string()), ("uses", pa.list_(pa.string()))])
_KEYWORDS = frozenset(
    "await async new typeof void delete in of instanceof return const let var function class if else for while do switch case default break continue throw try catch finally yield "
    "true false null undefined import export from extends as satisfies super this".split()
) - {"this"}
_ASSIGNS = frozenset("= += -= *= /= %= &&= ||= ??= &= |= ^=".split())
_GOES_ON = frozenset(". ?. + - * / % && || ?? ? : = => == === != !== < > <= >= & | ^ , ( [ ** ) ] }".split())
_IN_TEMPLATE = re.compile(r"\$\{([^{}]*)\}")
_DOTTED = re.compile(r"(?<![\w.'\"])([A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*)(\s*\()?")


class Flows(Reader):
    def __init__(self, text: str):
        super().__init__(text)
        self.body_at = {start: end for _, _, _, start, end in self.heads}
        self.head_at = {opened: end for _, opened, _, _, end in self.heads}
        self.made_at = {opened: self.name_of(k, j) for j, (k, opened, _, _, _) in enumerate(self.heads)}
        self.owners = [(opened - 1, end, self.name_of(k, j)) for j, (k, opened, _, _, end) in enumerate(self.heads)]
        self._owned: list[int] | None = None
        self.out: list[dict] = []

    def name_of(self, k: int, j: int) -> str:
        name = self.functions[j][2]
        if name != "(anonymous)":
            return name
        at = self.s.tokens[k].at
        return f"@{self.s.line(at)}:{self.s.column(at)}"

    def owner(self, k: int) -> str:
        if self._owned is None:
            self._owned = innermost([(a, b) for a, b, _ in self.owners], len(self.s.tokens))
        n = self._owned[k] if k < len(self._owned) else -1
        return self.owners[n][2] if n >= 0 else ""

    def row(self, k: int, kind: str, fn: str | None = None, **more) -> None:
        self.out.append({"fn": self.owner(k) if fn is None else fn, "kind": kind, "line": self.s.line(self.s.tokens[k].at), "ix": None, "arg": None, "target": None, "callee": None, "uses": []} | more)

    def flows(self) -> list[dict]:
        s = self.s
        for j, (k, opened, close, start, end) in enumerate(self.heads):
            name = self.name_of(k, j)
            ranges = [(opened, opened + 1)] if s.word(opened) != "(" else self._split(opened + 1, close)
            for n, (a, b) in enumerate(ranges):
                mark = f"@{s.word(a + 1)}" if s.word(a) == "@" else None
                for one in self._bound(a, b):
                    self.row(k, "param", fn=name, target=one, arg=n, callee=mark)
            if s.word(start) != "{":
                self.row(start, "return", fn=name, uses=self.uses(start, end + 1))
        for k, t in enumerate(s.tokens):
            if t.kind == "mark" and t.text in _ASSIGNS and not self._default(k):
                self._assigned(k)
            elif t.kind == "name" and t.text == "return":
                self.row(k, "return", uses=self.uses(k + 1, self._end(k + 1)))
            elif t.kind == "name" and t.text == "of" and s.word(k - 2) in ("const", "let", "var"):
                self.row(k, "assign", target=s.word(k - 1), uses=self.uses(k + 1, self._end(k + 1)))
            elif t.text == "(" and t.kind == "mark" and s.partner[k] > 0 and self._callee(k):
                self._called(k)
        return self.out

    def _default(self, k: int) -> bool:
        """Whether the = at k gives a parameter its default."""
        return any(opened < k < close for _, opened, close, _, _ in self.heads if self.s.word(opened) == "(")

    def _bound(self, a: int, b: int) -> list[str]:
        """The names that a pattern or a parameter between two tokens binds."""
        s = self.s
        if s.word(a) in ("{", "["):
            inner = self._split(a + 1, s.partner[a]) if s.partner[a] > 0 else []
            out = []
            for x, y in inner:
                x += s.word(x) == "..."
                at = next((j for j in range(x, y) if s.word(j) == ":"), None)
                out += self._bound(at + 1, y) if at is not None and s.word(a) == "{" else self._bound(x, y)
            return out
        while a < b and (s.word(a) in ("...", "public", "private", "protected", "readonly", "@") or s.word(a - 1) == "@" or s.word(a) == "(" and s.partner[a] > 0):
            a = s.partner[a] + 1 if s.word(a) == "(" else a + 1
        return [s.word(a)] if a < b and s.kind(a) == "name" else []

    def _split(self, a: int, b: int) -> list[tuple[int, int]]:
        """The ranges between commas of a bracket's inside."""
        s, out, i, first = self.s, [], a, a
        while i < b:
            if s.word(i) in ("(", "[", "{") and s.kind(i) == "mark" and s.partner[i] > 0:
                i = s.partner[i]
            elif s.word(i) == "," and s.kind(i) == "mark":
                out.append((first, i))
                first = i + 1
            i += 1
        return [*out, (first, b)] if first < b else out

    def _end(self, k: int) -> int:
        """One behind the last token of the expression that begins at k; a line that cannot go on ends it as well."""
        s, i = self.s, k
        while i < len(s.tokens):
            if i > k and s.line(s.tokens[i].at) > s.line(s.tokens[i - 1].at) and s.word(i) not in _GOES_ON and s.word(i - 1) not in _GOES_ON - {")", "]", "}"} and s.word(i - 1) not in ("await", "new", "typeof"):
                return i
            if s.kind(i) == "mark" and s.word(i) in ("(", "[", "{") and s.partner[i] > 0:
                i = s.partner[i] + 1
                continue
            if s.kind(i) == "mark" and s.word(i) in (",", ";", ")", "]", "}"):
                return i
            i += 1
        return i

    def _dotted_before(self, k: int) -> tuple[str, int]:
        """The dotted name that ends at token k, and where it begins."""
        s, parts = self.s, [self.s.word(k)]
        while s.word(k - 1) in (".", "?.") and s.kind(k - 2) == "name":
            k -= 2
            parts.append(s.word(k))
        return ".".join(reversed(parts)), k

    def _assigned(self, k: int) -> None:
        s = self.s
        uses = self.uses(k + 1, self._end(k + 1))
        if s.word(k - 1) in ("}", "]") and s.partner[k - 1] > 0 and s.word(s.partner[k - 1] - 1) in ("const", "let", "var", "(", ";"):
            targets = self._bound(s.partner[k - 1], k)
        elif s.word(k - 1) == "]" and s.kind(s.partner[k - 1] - 1) == "name":
            targets = [self._dotted_before(s.partner[k - 1] - 1)[0]]
        elif s.kind(k - 1) == "name":
            name, at = self._dotted_before(k - 1)
            colon = next((j for j in range(at - 1, max(0, at - 12), -1) if s.word(j) in (":", ";", "{", "}", "const", "let", "var")), None)
            targets = [s.word(colon - 1)] if colon is not None and s.word(colon) == ":" and s.word(colon - 2) in ("const", "let", "var") else [name]
        else:
            return
        if s.word(k) != "=":
            uses = [*uses, *targets]
        for target in targets:
            self.row(k, "assign", target=target, uses=uses)

    def _callee(self, k: int) -> str:
        s = self.s
        if s.kind(k - 1) != "name" or s.word(k - 1) in _NOT_METHODS or s.word(k - 1) in _KEYWORDS:
            return ""
        if k in self.head_at or s.word(k - 2) == "function":
            return ""
        name, at = self._dotted_before(k - 1)
        return "()." + name if s.word(at - 1) in (".", "?.") else name

    def _called(self, k: int) -> None:
        s, callee = self.s, self._callee(k)
        name, at = self._dotted_before(k - 1)
        before = at - 1 - (s.word(at - 1) in ("await", "new"))
        target = self._dotted_before(before - 1)[0] if s.word(before) == "=" and s.kind(before - 1) == "name" and self._end(before + 1) == s.partner[k] + 1 else None
        self.row(k, "call", ix=k, callee=callee, target=target, arg=len(self._split(k + 1, s.partner[k])))
        chained = s.word(at - 1) in (".", "?.") and s.word(at - 2) == ")" and s.partner[at - 2] > 0
        on = [f"@{s.partner[at - 2]}"] if chained and self._callee(s.partner[at - 2]) else [callee.rpartition(".")[0]] if "." in callee and not callee.startswith("()") else []
        if on:
            self.row(k, "arg", ix=k, callee=callee, arg=-1, uses=on)
        for n, (a, b) in enumerate(self._split(k + 1, s.partner[k])):
            self.row(k, "arg", ix=k, callee=callee, arg=n, uses=self.uses(a, b))

    def uses(self, a: int, b: int) -> list[str]:
        s, out, i = self.s, [], a
        while i < b:
            if i in self.head_at and self.head_at[i] < len(s.tokens):  # a function given as a value is its own scope
                out.append(f"=>{self.made_at[i]}")
                i = self.head_at[i] + 1
            elif s.kind(i) == "template":
                for inner in _IN_TEMPLATE.findall(s.word(i)):
                    out += [m[1].replace("?.", ".") for m in _DOTTED.finditer(inner) if not m[2] and m[1] not in _KEYWORDS]
                i += 1
            elif s.kind(i) == "name" and s.word(i) not in _KEYWORDS and not (s.word(i + 1) == ":" and s.word(i - 1) in ("{", ",")):
                j, parts = i, [s.word(i)]
                while s.word(j + 1) in (".", "?.") and s.kind(j + 2) == "name":
                    j += 2
                    parts.append(s.word(j))
                if s.word(j + 1) == "(" and s.partner[j + 1] > 0:
                    last = j + 1
                    while s.word(s.partner[last] + 1) in (".", "?.") and s.word(s.partner[last] + 3) == "(" and s.partner[s.partner[last] + 3] > 0:
                        last = s.partner[last] + 3  # of a chain of calls the last makes the value
                    out.append(f"@{last}")
                    j = s.partner[last]
                    while s.word(j + 1) in (".", "?.") and s.kind(j + 2) == "name":
                        j += 2
                else:
                    out.append(".".join(parts))
                i = j + 1
            else:
                i += 1
        return list(dict.fromkeys(out))


def read_flows(text: str) -> list[dict]:
    return Flows(text).flows()


def extract(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Bindings of every file, one parse each, no shuffle. A file that cannot be read has one row of kind error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = read_flows(text)
                except Exception as e:  # one bad file must not hide the others
                    rows = [{"fn": "", "kind": "error", "line": 1, "ix": None, "arg": None, "target": f"{type(e).__name__}: {e}", "callee": None, "uses": []}]
                out += [r | {"path": path} for r in rows]
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return files.select(F.col(path_col).alias("path"), F.coalesce(F.col(content_col), F.lit("")).alias("content")).mapInArrow(run, SCHEMA)
