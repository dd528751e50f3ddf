"""What statements write to and read from access paths, next to the control flow they stand in: field by field.

A path is an array: a root and its fields, "*" for an element whose name is not known. Rows (path, fn, kind, block, to, label,
line, ix, op, target, source):

- edge: from block to `to`; block 0 is the entry;
- settled: target cannot hold any text on the edges of label that leave the block;
- write: as number ix in the order of evaluation, target
  - new: gets a value that is made of nothing told here,
  - copy: gets the value, and the object, of source,
  - derive: may hold what source holds, besides what it held; through the callee in label, if there is one;
- read: argument number `to` of the callee in label holds source.

Roots beginning with "@" are results of calls, with "#" literals that are being put together, with "$" parameters without a
name; "$return" is the function's result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.extract.bindings import _DOTTED, _IN_TEMPLATE, _KEYWORDS, Flows
from tracewell.extract.cfg import graphs_of
from tracewell.extract.tokens import unquoted

SCHEMA = "path string, fn string, kind string, block int, to int, label string, line int, ix int, op string, target array<string>, source array<string>"
_ARROW = pa.schema([("path", pa.string()), ("fn", pa.string()), ("kind", pa.string()), ("block", pa.int32()), ("to", pa.int32()), ("label", pa.string()), ("line", pa.int32()), ("ix", pa.int32()), ("op", pa.string()), ("target", pa.list_(pa.string())), ("source", pa.list_(pa.string()))])
_NONE = {"block": None, "to": None, "label": None, "line": None, "ix": None, "op": None, "target": None, "source": None}
_ADDS = frozenset(("push", "unshift", "add"))
_ASSIGNS = frozenset("= += -= *= /= %= &&= ||= ??= &= |= ^=".split())
Path = list[str]


class Heap:
    def __init__(self, text: str):
        self.f = Flows(text)
        self.s = self.f.s
        self.graphs, rows = graphs_of(self.f)
        self.out: list[dict] = [_NONE | {"fn": r["fn"], "kind": r["kind"], "block": r["block"], "to": r["to"], "label": r["label"], "target": r["var"].split(".") if r["kind"] == "settled" else None} for r in rows if r["kind"] in ("edge", "settled")]
        self.told: list[tuple[int, int, dict]] = []  # position, order in it, row
        self.heads_inside = bytearray(len(self.s.tokens))  # 1 for a token between the brackets of parameters
        for _, opened, close, _, _ in self.f.heads:
            self.heads_inside[opened + 1 : close] = b"\1" * max(0, close - opened - 1)

    def put(self, at: int, position: int, kind: str, fn: str | None = None, **more) -> None:
        fn = self.f.owner(at) if fn is None else fn
        if graph := self.graphs.get(fn):
            block = 0 if position < 0 else graph.block_of(at)
            self.told.append((position, len(self.told), _NONE | {"fn": fn, "kind": kind, "block": block, "line": self.s.line(self.s.tokens[at].at)} | more))

    # expressions

    def _key(self, a: int, b: int) -> str:
        """The name of an element by the expression in its brackets."""
        if b - a == 1 and self.s.kind(a) in ("string", "number"):
            return unquoted(self.s.word(a)) if self.s.kind(a) == "string" else self.s.word(a)
        return "*"

    def _fields(self, j: int, b: int) -> tuple[Path, int]:
        s, out = self.s, []
        while j < b:
            if s.word(j) in (".", "?.") and s.kind(j + 1) == "name":
                out.append(s.word(j + 1))
                j += 2
            elif s.word(j) == "?." and s.word(j + 1) in ("[", "(") or s.word(j) == "!" and s.word(j + 1) in (".", "[", ")", ";", ","):
                j += 1
            elif s.word(j) == "[" and s.kind(j) == "mark" and s.partner[j] > j:
                out.append(self._key(j + 1, s.partner[j]))
                j = s.partner[j] + 1
            else:
                break
        return out, j

    def operand(self, i: int, b: int) -> tuple[Path | None, int]:
        """The path at token i, of names or of a call's result, and the token behind it."""
        s = self.s
        if s.kind(i) != "name" or s.word(i) in _KEYWORDS:
            return None, i + 1
        root = s.word(i)
        fields, j = self._fields(i + 1, b)
        while j < b and s.word(j) == "(" and s.kind(j) == "mark" and s.partner[j] > j:
            root, (fields, j) = f"@{j}", self._fields(s.partner[j] + 1, b)
        return [root, *fields], j

    def _bare(self, a: int, b: int) -> tuple[int, int]:
        s = self.s
        while True:
            if s.kind(a) == "name" and s.word(a) in ("await", "new"):
                a += 1
            elif b - a > 1 and s.word(a) == "(" and s.kind(a) == "mark" and s.partner[a] == b - 1 and a not in self.f.head_at:
                a, b = a + 1, b - 1
            else:
                cast = next((j for j in range(a + 1, b) if s.kind(j) == "name" and s.word(j) in ("as", "satisfies")), None) if s.kind(a) == "name" else None
                if cast is None or any(s.kind(j) == "mark" and s.word(j) not in (".", "?.", "<", ">", "[", "]", "|", ",") for j in range(a, b)):
                    return a, b
                b = cast

    def value(self, a: int, b: int) -> Path | None:
        """The path that the whole expression is."""
        a, b = self._bare(a, b)
        found, j = self.operand(a, b)
        return found if found and j == b else None

    def reads(self, a: int, b: int) -> list[Path]:
        s, out, i = self.s, [], a
        while i < b:
            if i in self.f.head_at and self.f.head_at[i] < len(s.tokens):
                i = self.f.head_at[i] + 1
            elif s.kind(i) == "template":
                for inner in _IN_TEMPLATE.findall(s.word(i)):
                    out += [m[1].replace("?.", ".").split(".") for m in _DOTTED.finditer(inner) if not m[2] and m[1] not in _KEYWORDS]
                i += 1
            elif s.kind(i) == "name" and s.word(i) not in _KEYWORDS and s.word(i - 1) not in (".", "?.") and not (s.word(i + 1) == ":" and s.word(i - 1) in ("{", ",")):
                found, i = self.operand(i, b)
                out.append(found)
            else:
                i += 1
        return out

    def made(self, a: int, b: int, at: int, position: int) -> list[Path]:
        """The paths that an expression is made of; a literal is put together under a root of its own."""
        if found := self.value(a, b):
            return [found]
        x, y = self._bare(a, b)
        if self.s.kind(x) == "mark" and self.s.word(x) in ("{", "[") and self.s.partner[x] == y - 1 and x not in self.f.head_at:
            self.literal([f"#{x}"], x, at, position)
            return [[f"#{x}"]]
        return self.reads(a, b)

    def literal(self, target: Path, opened: int, at: int, position: int) -> None:
        s = self.s
        self.put(at, position, "write", op="new", target=target)
        for n, (x, y) in enumerate(self.f._split(opened + 1, s.partner[opened])):
            if s.word(x) == "...":
                for one in self.made(x + 1, y, at, position):
                    self.put(at, position, "write", op="derive", target=target, source=one)
            elif s.word(opened) == "[":
                self.assign([*target, str(n)], x, y, at, position)
            elif s.word(x + 1) == ":" and s.kind(x) in ("name", "string", "number"):
                self.assign([*target, unquoted(s.word(x)) if s.kind(x) == "string" else s.word(x)], x + 2, y, at, position)
            elif s.word(x) == "[" and s.partner[x] > x and s.word(s.partner[x] + 1) == ":":
                for one in self.made(s.partner[x] + 2, y, at, position):
                    self.put(at, position, "write", op="derive", target=[*target, self._key(x + 1, s.partner[x])], source=one)
            elif s.kind(x) == "name" and y == x + 1:
                self.put(at, position, "write", op="copy", target=[*target, s.word(x)], source=[s.word(x)])

    def assign(self, target: Path, a: int, b: int, at: int, position: int) -> None:
        whole = self.value(a, b)
        parts = [whole] if whole else self.made(a, b, at, position)
        if whole or len(parts) == 1 and parts[0][0].startswith("#"):
            self.put(at, position, "write", op="copy", target=target, source=parts[0])
            return
        if parts:  # from a root of its own, as the target may be one of the parts
            self.put(at, position, "write", op="new", target=[f"#{a}"])
            for one in parts:
                self.put(at, position, "write", op="derive", target=[f"#{a}"], source=one)
            self.put(at, position, "write", op="copy", target=target, source=[f"#{a}"])
        else:
            self.put(at, position, "write", op="new", target=target)

    def bind(self, a: int, b: int, source: Path, at: int, position: int, fn: str | None = None) -> None:
        """The pattern or name in tokens [a, b) gets source."""
        s = self.s
        equal = next((j for j in range(s.partner[a] if s.partner[a] > a else a, b) if s.word(j) == "=" and s.kind(j) == "mark"), b)
        if s.word(a) in ("{", "[") and s.partner[a] > a:
            for n, (x, y) in enumerate(self.f._split(a + 1, s.partner[a])):
                if s.word(x) == "...":
                    self.put(at, position, "write", fn, op="new", target=[s.word(x + 1)])
                    self.put(at, position, "write", fn, op="derive", target=[s.word(x + 1)], source=source)
                elif s.word(a) == "[":
                    self.bind(x, y, [*source, str(n)], at, position, fn)
                elif s.word(x + 1) == ":":
                    self.bind(x + 2, y, [*source, unquoted(s.word(x)) if s.kind(x) == "string" else s.word(x)], at, position, fn)
                elif s.kind(x) == "name":
                    self.bind(x, y, [*source, s.word(x)], at, position, fn)
        elif s.kind(a) == "name":
            target, _ = self._fields(a + 1, equal)
            self.put(at, position, "write", fn, op="copy", target=[s.word(a), *target], source=source)
            for one in self.reads(equal + 1, b):
                self.put(at, position, "write", fn, op="derive", target=[s.word(a), *target], source=one)

    # statements

    def before(self, k: int) -> tuple[Path, int]:
        """The path that ends at token k, and where it begins."""
        s, fields = self.s, []
        while k >= 0:
            if s.word(k) == "]" and s.kind(k) == "mark" and s.partner[k] >= 0:
                fields.append(self._key(s.partner[k] + 1, k))
                k = s.partner[k] - 1 - (s.word(s.partner[k] - 1) == "?.")
            elif s.word(k) == ")" and s.kind(k) == "mark" and s.partner[k] > 0 and self.f._callee(s.partner[k]):
                return [f"@{s.partner[k]}", *reversed(fields)], k
            elif s.kind(k) == "name":
                fields.append(s.word(k))
                if s.word(k - 1) not in (".", "?."):
                    return list(reversed(fields)), k
                k -= 2
            else:
                break
        return [], k

    def assigned(self, k: int) -> None:
        s, end = self.s, self.f._end(k + 1)
        position = max(k, end - 1) * 2 + 1
        opened = s.partner[k - 1] if s.word(k - 1) in ("}", "]") and s.kind(k - 1) == "mark" else -1
        if opened >= 0 and s.word(opened - 1) in ("const", "let", "var", "(", ";", "{", "}", ""):
            source = self.value(k + 1, end)
            if source is None:
                source = [f"#{k}"]
                self.assign(source, k + 1, end, k, position)
            self.bind(opened, k, source, k, position)
            return
        typed = next((j for j in range(k - 1, max(-1, k - 14), -1) if s.word(j) in ("const", "let", "var", ";", "{")), -1)
        target = [s.word(typed + 1)] if typed >= 0 and s.word(typed) in ("const", "let", "var") and s.word(typed + 2) == ":" else self.before(k - 1)[0]
        if not target:
            return
        if s.word(k) == "=":
            self.assign(target, k + 1, end, k, position)
        else:
            for one in self.reads(k + 1, end):
                self.put(k, position, "write", op="derive", target=target, source=one)

    def called(self, k: int) -> None:
        s, callee, position, result = self.s, self.f._callee(k), self.s.partner[k] * 2, [f"@{k}"]
        on = self.before(k - 1)[0][:-1]
        ranges = self.f._split(k + 1, s.partner[k])
        parts = [self.made(a, b, k, position) for a, b in ranges]
        for n, each in enumerate(parts):
            for one in [p for x in each for p in ([x, [*x, "*"]] if x[0].startswith("#") else [x])]:  # a literal is given with its fields
                self.put(k, position, "read", label=callee, to=n, source=one)
        method = s.word(k - 1)
        if callee == "Object.assign" and parts and len(parts[0]) == 1:
            for one in [p for each in parts[1:] for p in each]:
                self.put(k, position, "write", op="derive", target=parts[0][0], source=one)
            self.put(k, position, "write", op="copy", target=result, source=parts[0][0])
            return
        if on and method == "get" and len(ranges) == 1:
            self.put(k, position, "write", op="copy", target=result, source=[*on, self._key(*ranges[0])])
            return
        self.put(k, position, "write", op="new", target=result)
        for one in [p for each in parts for p in each] + ([on, [*on, "*"]] if on else []):
            self.put(k, position, "write", op="derive", target=result, source=one, label=callee)
        if on and method in _ADDS:
            for one in [p for each in parts for p in each]:
                self.put(k, position, "write", op="derive", target=[*on, "*"], source=one)
        elif on and method == "set" and len(ranges) == 2:
            for one in parts[1]:
                self.put(k, position, "write", op="derive", target=[*on, self._key(*ranges[0])], source=one)

    def rows(self) -> list[dict]:
        s, f = self.s, self.f
        seen: set[str] = set()
        for j, (k, opened, close, start, end) in enumerate(f.heads):
            name = f.name_of(k, j)
            if name not in seen and s.word(opened) == "(":
                for n, (a, b) in enumerate(f._split(opened + 1, close)):
                    if s.word(a) in ("{", "["):
                        self.bind(a, b, [f"${n}"], opened, -1, name)
            seen.add(name)
            if s.word(start) != "{" and start <= end < len(s.tokens):
                self.assign(["$return"], start, end + 1, start, end * 2 + 1)
        for k, t in enumerate(s.tokens):
            if t.kind == "mark" and t.text in _ASSIGNS and not self.heads_inside[k]:
                self.assigned(k)
            elif t.kind == "name" and t.text == "return":
                end = f._end(k + 1)
                self.assign(["$return"], k + 1, end, k, max(k, end - 1) * 2 + 1)
            elif t.kind == "name" and t.text == "of" and (s.word(k - 2) in ("const", "let", "var") or s.partner[k - 1] > 0 and s.word(s.partner[k - 1] - 1) in ("const", "let", "var")):
                opened = s.partner[k - 1] if s.partner[k - 1] > 0 else k - 1
                for one in self.made(k + 1, f._end(k + 1), k, k * 2 + 1)[:1]:
                    self.bind(opened, k, [*one, "*"], k, k * 2 + 1)
            elif t.text == "(" and t.kind == "mark" and s.partner[k] > 0 and f._callee(k):
                self.called(k)
        for n, (_, _, row) in enumerate(sorted(self.told, key=lambda x: x[:2])):
            self.out.append(row | {"ix": n})
        return self.out


def extract(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Writes and reads of all functions of every file, one parse each, no shuffle. A file that cannot be read has one row of kind error."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = Heap(text).rows()
                except Exception as e:  # one bad file must not hide the others
                    rows = [_NONE | {"fn": "", "kind": "error", "label": f"{type(e).__name__}: {e}", "line": 1}]
                out += [r | {"path": path} for r in rows]
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return files.select(F.col(path_col).alias("path"), F.coalesce(F.col(content_col), F.lit("")).alias("content")).mapInArrow(run, SCHEMA)
