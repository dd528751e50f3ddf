"""Fact rows of source files: imports, exports, functions, classes, calls, catches, literals and regular expressions.

Every file is parsed once; each fact is one row (path, kind, ix, name, line, column, end_line, scope, about), where about is a
map of what is known of it. Later steps are joins and projections on these rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.extract.tokens import Source, innermost, unquoted

SCHEMA = "path string, kind string, ix int, name string, line int, column int, end_line int, scope string, about map<string,string>"
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("ix", pa.int32()), ("name", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("end_line", pa.int32()), ("scope", pa.string()), ("about", pa.map_(pa.string(), pa.string()))])
_NOT_METHODS = frozenset("async if for while switch catch with function return await typeof super import".split())
_ESCAPED, _CONTROL = re.compile(r"\\(.)", re.S), {"n": "\n", "t": "\t", "r": "\r"}
_CUT_CALL = r"\.(?:charat|substring|substr|slice|trim|trimstart|trimend|padstart|padend|split)\("
_CUT = re.compile(_CUT_CALL + r"[^()]*\)$", re.I)
_EACH = frozenset("map foreach filter find some every flatmap reduce".split())
_CHECKS = re.compile(r"validat|sanitiz|check|verify|parse", re.I)
_INPUT = re.compile(r"\b(?:req|request|ctx|context)\.(?:body|query|params|headers|cookies)|\bctx\.request\.body|\bevent\.(?:body|queryStringParameters)")
#: Of an error only so much is shown; source text is never cut, as detectors search all of it.
_SHOWN = 2000


class Reader:
    """Walks the tokens of one file."""

    def __init__(self, text: str):
        self.s = Source(text)
        self.rows: list[dict] = []
        self.functions: list[tuple[int, int, str, bool]] = []  # first and last token of the body, name, async
        self.heads: list[tuple[int, int, int, int, int]] = []  # of each function: name, parameters' first and last, body's first and last token
        self.blocks: list[tuple[int, int, str]] = []  # first, last, kind: try, catch, loop
        self._scopes: list[int] | None = None
        self._inside: dict[str, list[int]] = {}
        self._cuts: dict[str, bool] = {}
        self._reads: dict[int, bool] = {}
        self._functions()
        self._blocks()
        self.ends = {b for _, b, *_ in self.functions}

    def add(self, kind: str, name: str, k: int, end: int | None = None, **about) -> None:
        s = self.s
        at = s.tokens[k].at
        last = s.tokens[end].at if end is not None and 0 <= end < len(s.tokens) else at
        told = {key: (str(v).lower() if isinstance(v, bool) else str(v)) for key, v in about.items() if v is not None}
        self.rows.append({"kind": kind, "name": name, "line": s.line(at), "column": s.column(at), "end_line": s.line(last), "scope": self.scope(k)[0], "about": told})

    def scope(self, k: int) -> tuple[str, bool]:
        """The innermost function around token k: its name ("" at the top of the file) and whether it is async."""
        if self._scopes is None:
            self._scopes = innermost([(a, b) for a, b, *_ in self.functions], len(self.s.tokens))
        n = self._scopes[k] if k < len(self._scopes) else -1
        return (self.functions[n][2], self.functions[n][3]) if n >= 0 else ("", False)

    def within(self, k: int, kind: str) -> bool:
        if kind not in self._inside:
            steps = [0] * (len(self.s.tokens) + 2)
            for a, b, x in self.blocks:
                if x == kind:
                    steps[a + 1] += 1
                    steps[b] -= 1
            self._inside[kind] = list(accumulate(steps))
        return self._inside[kind][k] > 0

    def _functions(self) -> None:
        s = self.s
        for k, t in enumerate(s.tokens):
            if t.text == "function" and t.kind == "name":
                j = k + 1 + (s.word(k + 1) == "*")
                name = s.word(j) if s.kind(j) == "name" else self._named_before(k - (s.word(k - 1) == "async"))
                j += s.kind(j) == "name"
                if s.word(j) == "(" and s.partner[j] > 0:
                    self._body(k, name, j, s.partner[j], s.word(k - 1) == "async")
            elif t.text == "=>" and t.kind == "mark":
                close = k - 1
                opened = s.partner[close] if s.word(close) == ")" else close
                if opened < 0:
                    continue
                is_async = s.word(opened - 1) == "async"
                self._body(opened, self._named_before(opened - is_async), opened, close, is_async, k + 1)
            elif t.text == "(" and t.kind == "mark" and s.kind(k - 1) == "name" and s.word(k - 1) not in _NOT_METHODS and s.partner[k] > 0:
                close = s.partner[k]
                after = close + 1
                if s.word(after) == ":":  # a return type
                    while after < len(s.tokens) and s.word(after) not in "{;=,":
                        after += 1
                if s.word(after) == "{" and s.word(k - 2) not in ("new", ".", "function", "?.", "*") or (s.word(after) == "{" and s.word(k - 2) == "*" and s.word(k - 3) != "function"):
                    self._body(k - 1, s.word(k - 1), k, close, s.word(k - 2) == "async", after)

    def _named_before(self, k: int) -> str:
        """The name that an expression at token k is given: x = ..., x: ..."""
        s = self.s
        if s.word(k - 1) in ("=", ":") and s.kind(k - 2) == "name":
            return s.word(k - 2)
        j = k - 1
        while j > 0 and s.word(j) not in (";", "{", "}", "=", "=>") and k - j < 30:
            j -= 1
        return s.word(j - 1) if s.word(j) == "=" and s.kind(j - 1) == "name" and s.word(k - 1) in ("=",) else ""

    def _body(self, k: int, name: str, opened: int, close: int, is_async: bool, start: int | None = None) -> None:
        s = self.s
        start = close + 1 if start is None else start
        while s.word(start) and s.word(start) != "{" and start - close < 40 and start <= close + 1:
            if s.word(start) == ":":
                while start < len(s.tokens) and s.word(start) not in ("{", ";", "=>"):
                    start += 1
                break
            break
        end = s.partner[start] if s.word(start) == "{" and s.partner[start] > 0 else self._expression_end(start)
        self.functions.append((opened - 1, end, name or "(anonymous)", is_async))
        self.heads.append((k, opened, close, start, end))
        params = s.between(opened, close) if s.word(opened) == "(" else s.word(opened)
        self.rows.append({"kind": "function", "name": name or "(anonymous)", "line": s.line(s.tokens[k].at), "column": s.column(s.tokens[k].at), "end_line": s.line(s.tokens[min(end, len(s.tokens) - 1)].at), "scope": "", "about": {"async": str(is_async).lower(), "params": params, "exported": str(self._exported(k)).lower()}})

    def _exported(self, k: int) -> bool:
        return any(self.s.word(j) == "export" for j in range(max(0, k - 6), k) if all(self.s.word(x) not in (";", "}") for x in range(j, k)))

    def _expression_end(self, k: int) -> int:
        s = self.s
        while k < len(s.tokens):
            if s.word(k) in "([{" and s.kind(k) == "mark" and s.partner[k] > 0:
                k = s.partner[k] + 1
                continue
            if s.kind(k) == "mark" and s.word(k) in (",", ";", ")", "]", "}"):
                return k - 1
            k += 1
        return len(s.tokens) - 1

    def _blocks(self) -> None:
        s = self.s
        for k, t in enumerate(s.tokens):
            if t.kind != "name":
                continue
            if t.text == "try" and s.word(k + 1) == "{" and s.partner[k + 1] > 0:
                self.blocks.append((k + 1, s.partner[k + 1], "try"))
            elif t.text in ("for", "while") or t.text == "catch" and s.word(k - 1) == "}":
                j = k + 1 + (s.word(k + 1) == "await")
                if s.word(j) == "(" and s.partner[j] > 0:
                    j = s.partner[j] + 1
                if s.word(j) == "{" and s.partner[j] > 0:
                    self.blocks.append((j, s.partner[j], "catch" if t.text == "catch" else "loop"))

    # facts

    def read(self) -> list[dict]:
        s = self.s
        for k, t in enumerate(s.tokens):
            if t.kind == "name":
                if t.text == "import":
                    self._import(k)
                elif t.text == "export":
                    self._export(k)
                elif t.text == "class" and s.kind(k + 1) == "name":
                    self._class(k)
                elif t.text == "catch" and s.word(k - 1) == "}":
                    self._catch(k)
            elif t.kind == "regex":
                body, _, flags = t.text[1:].rpartition("/")
                self.add("regex", body, k, flags=flags, near=self._near(k))
            elif t.kind in ("string", "template"):
                self._literal(k)
            elif t.text == "(" and t.kind == "mark" and s.partner[k] > 0:
                self._call(k)
        return self.rows

    def _import(self, k: int) -> None:
        s = self.s
        if s.word(k + 1) == "(":
            if s.kind(k + 2) in ("string", "template"):
                self.add("import", unquoted(s.word(k + 2)), k, form="dynamic", type_only=False, guarded=self.within(k, "try") or self._next_member(s.partner[k + 1]) == "catch")
            return
        if s.word(k - 1) == "." or s.word(k + 1) == ".":
            return
        j = k + 1
        while j < len(s.tokens) and s.kind(j) != "string" and s.word(j) != ";" and j - k < 400:
            j += 1
        if s.kind(j) == "string":
            names = s.text[s.tokens[k].at + 6 : s.tokens[j].at].strip()
            self.add("import", unquoted(s.word(j)), k, form="esm", type_only=s.word(k + 1) == "type" and s.word(k + 2) not in ("from", ","), names=re.sub(r"\s*\bfrom$", "", names), guarded=False)

    def _export(self, k: int) -> None:
        s, j = self.s, k + 1
        if s.word(j) == "type" and s.word(j + 1) in ("{", "*"):
            j += 1
        if s.word(j) in ("{", "*"):
            end = s.partner[j] if s.word(j) == "{" else j
            names = s.between(j, end) if s.word(j) == "{" else "*"
            while end < len(s.tokens) and end - j < 400 and s.word(end + 1) in ("as", "from") or s.kind(end + 1) == "name" and s.word(end) == "as":
                end += 1
            target = unquoted(s.word(end + 1)) if s.kind(end + 1) == "string" else None
            for name in names.split(","):
                if name.strip():
                    original, _, shown = (x.strip() for x in name.strip().partition(" as "))
                    self.add("export", shown or original, k, original=original, target=target)
            if target is not None:
                self.add("import", target, k, form="reexport", type_only=s.word(k + 1) == "type", names=names, guarded=False)
            return
        if s.word(j) == "default":
            j = named = j + 1
            while s.word(named) in ("async", "abstract", "function", "class", "*"):
                named += 1
            self.add("export", "default", k, original=s.word(named if s.kind(named) == "name" and s.word(named) not in ("extends", "implements") else j))
            return
        while s.word(j) in ("async", "abstract", "declare", "const", "let", "var", "function", "class", "interface", "type", "enum", "*"):
            j += 1
        if s.kind(j) == "name":
            self.add("export", s.word(j), k, original=s.word(j))

    def _class(self, k: int) -> None:
        s, j, base, implements = self.s, k + 2, None, []
        while j < len(s.tokens) and s.word(j) != "{" and j - k < 60:
            if s.word(j) == "extends":
                base = s.word(j + 1)
            elif s.word(j) == "implements":
                implements.append(s.word(j + 1))
            j += 1
        self.add("class", s.word(k + 1), k, s.partner[j] if s.word(j) == "{" else None, extends=base, implements=",".join(implements))

    def _catch(self, k: int) -> None:
        s, j, name = self.s, k + 1, ""
        if s.word(j) == "(" and s.partner[j] > 0:
            name = re.split(r"[:\s]", s.between(j, s.partner[j]).strip())[0]
            j = s.partner[j] + 1
        if s.word(j) != "{" or s.partner[j] < 0:
            return
        end = s.partner[j]
        inside = s.tokens[j + 1 : end]
        body = s.between(j, end)
        commented = any(s.tokens[j].at < a < s.tokens[end].at for a, _ in s.comments)
        calls = [s.word(x - 1) for x in range(j + 2, end) if s.word(x) == "(" and s.kind(x - 1) == "name" and s.word(x - 1) not in _NOT_METHODS]
        consoles = sum(1 for t in inside if t.text == "console")
        self.add("catch", name, k, end, body=body.strip(), tokens=len(inside), commented=commented, throws=any(t.text == "throw" for t in inside), returns=any(t.text == "return" for t in inside), calls=",".join(calls), consoles=consoles, uses=bool(name) and any(t.text == name for t in inside), in_loop=self.within(k, "loop"))

    def _literal(self, k: int) -> None:
        s = self.s
        value = unquoted(s.word(k))
        if len(value) < 8:
            return
        given = s.word(k - 2) if s.word(k - 1) in ("=", ":") and s.kind(k - 2) in ("name", "string") else ""
        around = s.word(k - 2) if s.word(k - 1) == "(" else ""
        self.add("literal", value, k, given=given.strip("\"'"), argument_of=around, form=s.kind(k))

    # where a regular expression is used

    def _object(self, k: int) -> str:
        """The text of what the method named at token k is called on; "" if k names no method."""
        s, j = self.s, k - 2
        if s.kind(k) != "name" or s.word(k - 1) not in (".", "?."):
            return ""
        last = j
        while True:
            while s.word(j) in (")", "]") and s.partner[j] > 0:
                j = s.partner[j] - 1
            if s.word(j - 1) not in (".", "?."):
                break
            j -= 2
        return s.text[s.tokens[max(j, 0)].at : s.tokens[last].at + len(s.tokens[last].text)] if last >= 0 else ""

    def _short(self, text: str) -> bool:
        """Whether a value is cut to a bounded length: by a method here, where its name is given a value, or by a loop over lines."""
        if _CUT.search(text):
            return True
        if not re.fullmatch(r"[\w$]+", text):
            return False
        if text not in self._cuts:
            name = re.escape(text)
            self._cuts[text] = bool(re.search(rf"\b{name}\s*=[^=;\n][^;\n]*{_CUT_CALL}|\b(?:const|let|var)\s+{name}\s+of\s[^;{{\n]*\.split\(", self.s.text, re.I))
        return self._cuts[text]

    def _near(self, k: int) -> str:
        """What is known of the text that a pattern meets: bounded, input, route, validator or ""."""
        s, given, around = self.s, "", self.scope(k) and self._scopes[k]
        if s.word(k - 1) == "(" and s.word(k - 2) in ("match", "search", "test", "replace", "replaceAll", "split"):
            given = self._object(k - 2)
            if s.word(k - 2) != "split" and self._short(given):
                return "bounded"
        n, route, validator = around, False, False
        while n >= 0:
            at, last, name, _ = self.functions[n]
            opened = self.heads[n][1]
            before = opened - 1 - (s.word(opened - 1) == "async")
            callee = before - 1
            if s.word(before) == "(" and s.word(callee).lower() in _EACH and self._short(self._object(callee)):
                return "bounded"
            params = [p.strip().split(":")[0].rstrip("?").lower() for p in (s.between(opened, self.heads[n][2]) if s.word(opened) == "(" else s.word(opened)).split(",")]
            steps_on = len(params) > 2 and "next" in params
            route |= not steps_on and (params[0] == "ctx" or params[0] in ("req", "request") and len(params) > 1 and params[1] in ("res", "response", "reply", "h"))
            validator |= bool(_CHECKS.search(name))
            if n == around and n not in self._reads:
                self._reads[n] = bool(_INPUT.search(s.text[s.tokens[max(at, 0)].at : s.tokens[min(last, len(s.tokens) - 1)].at]))
            n = self._scopes[at] if at >= 0 else -1
        if _INPUT.search(given) or self._reads.get(around):
            return "input"
        return "route" if route else "validator" if validator else ""

    def _next_member(self, k: int) -> str:
        return self.s.word(k + 2) if self.s.word(k + 1) in (".", "?.") else ""

    def _call(self, k: int) -> None:
        s = self.s
        j = k - 1
        if s.kind(j) != "name" or s.word(j) in _NOT_METHODS:
            return
        end = s.partner[k]
        if s.word(end + 1) == "{" and s.partner[end + 1] in self.ends:
            return  # a method's own head
        parts = [s.word(j)]
        while s.word(j - 1) in (".", "?."):
            j -= 2
            if s.word(j) in (")", "]") and s.partner[j] > 0:
                j = s.partner[j]
                parts.append("()")
                if s.kind(j - 1) != "name":
                    break
                j -= 1
                parts.append(s.word(j))
                continue
            if s.kind(j) not in ("name", "string", "template", "regex"):
                break
            parts.append(s.word(j) if s.kind(j) == "name" else "''")
        if s.word(j - 1) == "function" or s.word(j - 1) == "*" and s.word(j - 2) == "function":
            return
        name = ".".join(reversed(parts)).replace(".().", "().")
        before = s.word(j - 1)
        scope, in_async = self.scope(k)
        given = s.word(j - 2) if before == "=" and s.kind(j - 2) == "name" else None
        if before == "await" and s.word(j - 2) == "=":
            given = s.word(j - 3)
        if name == "require" and s.kind(k + 1) == "string" and end == k + 2:
            self.add("import", unquoted(s.word(k + 1)), j, form="require", type_only=False, guarded=self.within(k, "try"), names=given)
        if name == "RegExp" and s.kind(k + 1) in ("string", "template") and s.word(k + 2) in (")", ",") and "${" not in s.word(k + 1):
            self.add("regex", _ESCAPED.sub(lambda m: _CONTROL.get(m.group(1), m.group(1)), unquoted(s.word(k + 1))), j, flags="", near=self._near(k))
        args = s.between(k, end)
        self.add(
            "call", name, j, end, awaited=before == "await", returned=before == "return" or before == "=>", voided=before == "void", built=before == "new",
            statement=before in (";", "{", "}", "") or before == ")" and s.line(s.tokens[j - 1].at) < s.line(s.tokens[j].at), argument=before in ("(", ","), given=given, chained=self._next_member(end),
            args=args.strip(), in_async=in_async, in_try=self.within(k, "try"), in_catch=self.within(k, "catch"), in_loop=self.within(k, "loop"), last=s.word(end + 1) in ("}", "") or s.word(end + 1) == ";" and s.word(end + 2) == "}",
        )


def read_file(text: str) -> list[dict]:
    return Reader(text).read()


def extract(files: DataFrame, path_col: str = "path", content_col: str = "content", step: int = 1 << 24) -> DataFrame:
    """Facts of every file. A file that cannot be read yields one row of kind error instead of ending the job.

    Facts are sent on after about step characters, as calls inside calls repeat their text.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = read_file(text)
                except Exception as e:  # one bad file must not hide the others
                    rows = [{"kind": "error", "name": f"{type(e).__name__}: {e}"[:_SHOWN], "line": 1, "column": 1, "end_line": 1, "scope": "", "about": {}}]
                rows.sort(key=lambda r: (r["line"], r["column"]))
                for ix, r in enumerate(rows):
                    out.append(r | {"path": path, "ix": ix, "about": list(r["about"].items())})
                    size += len(r["name"]) + sum(map(len, r["about"].values()))
                    if size >= step:
                        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return files.select(F.col(path_col).alias("path"), F.coalesce(F.col(content_col), F.lit("")).alias("content")).mapInArrow(run, SCHEMA)


def of_kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.filter(F.col("kind") == kind)


def told(key: str):
    """What a fact tells under a key; "" if nothing."""
    return F.coalesce(F.col("about")[key], F.lit(""))


def is_told(key: str):
    return told(key) == "true"
