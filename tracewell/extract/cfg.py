"""Control flow of functions: blocks, edges and the definitions inside blocks.

Rows (path, fn, kind, block, to, label, line, end_line, ix, var, uses):

- block: a straight run of statements; label is entry, exit, body, test, join, catch, finally or case;
- edge: from block to `to`; label is next, true, false, back, case, default, exception, break, continue, return or throw;
- test: what the block's last expression tests: uses are its names, var its text;
- settled: var cannot hold any text on the edges of label (true or false) that leave a test;
- def: var gets a value made of uses, as number ix in the order of the text; parameters are defined in the entry. The result of
  call number k is defined as "@k", with the callee as label;
- arg: argument number `to` of the call ix, whose callee is var.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.extract.bindings import Flows
from tracewell.extract.conditions import settled
from tracewell.extract.tokens import innermost

SCHEMA = "path string, fn string, kind string, block int, to int, label string, line int, end_line int, ix int, var string, uses array<string>"
_ARROW = pa.schema([("path", pa.string()), ("fn", pa.string()), ("kind", pa.string()), ("block", pa.int32()), ("to", pa.int32()), ("label", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("ix", pa.int32()), ("var", pa.string()), ("uses", pa.list_(pa.string()))])


class Graph:
    """The blocks of one function, made statement by statement."""

    def __init__(self, flows: Flows, name: str):
        self.f, self.s, self.name = flows, flows.s, name
        self.blocks: list[list] = []  # label, first token, last token
        self.edges: list[tuple[int, int, str]] = []
        self.tests: list[tuple[int, int, int]] = []  # block, first token, end
        self.spans: list[tuple[int, int, int]] = []  # first token, end, block
        self.targets: list[tuple[str, str, int]] = []  # kind (break or continue), label, block
        self.handlers: list[int] = []
        self.owner: list[int] | None = None  # of each token from self.first on: the block of the shortest span around it
        self.first = 0
        self.entry, self.exit = self.new("entry"), self.new("exit")

    def new(self, label: str, k: int | None = None) -> int:
        self.blocks.append([label, k, k])
        return len(self.blocks) - 1

    def edge(self, a: int | None, b: int, label: str = "next") -> None:
        if a is not None and (a, b, label) not in self.edges:
            self.edges.append((a, b, label))

    def cover(self, block: int, a: int, b: int) -> None:
        own = self.blocks[block]
        own[1] = a if own[1] is None else min(own[1], a)
        own[2] = b - 1 if own[2] is None else max(own[2], b - 1)
        self.spans.append((a, b, block))

    def after(self, k: int) -> int:
        """The first token behind the bracket that k opens, or k + 1."""
        return self.s.partner[k] + 1 if 0 <= k < len(self.s.tokens) and self.s.partner[k] > k else k + 1

    def run(self, start: int, end: int) -> None:
        s = self.s
        body = self.new("body", start)
        self.edge(self.entry, body)
        if s.word(start) == "{" and s.partner[start] > 0:
            last = self.statements(start + 1, s.partner[start], body)
        else:
            self.cover(body, start, end + 1)
            last = self.branches(start, end + 1, body)
        self.edge(last, self.exit)

    def statements(self, a: int, b: int, at: int | None) -> int | None:
        while a < b:
            if self.s.word(a) == ";":
                a += 1
                continue
            if at is None:
                at = self.new("body", a)  # nothing leads here
            a, at = self.statement(a, b, at)
        return at

    def statement(self, a: int, b: int, at: int, name: str = "") -> tuple[int, int | None]:
        """Works on the statement at token a; the token behind it, and the block that goes on (none if nothing does)."""
        s, word = self.s, self.s.word(a)
        if s.kind(a) == "name" and s.word(a + 1) == ":" and s.word(a - 1) in (";", "{", "}", "") and word not in ("case", "default"):
            join = self.new("join", a)
            self.targets.append(("break", word, join))
            a, end = self.statement(a + 2, b, at, word)
            self.targets.pop()
            self.edge(end, join)
            return a, join
        if word == "{":
            return self.after(a), self.statements(a + 1, s.partner[a] if s.partner[a] > 0 else b, at)
        if s.kind(a) != "name":
            return self.plain(a, b, at)
        if word == "if":
            return self._if(a, b, at)
        if word in ("for", "while"):
            return self._loop(a, b, at, name)
        if word == "do":
            return self._do(a, b, at, name)
        if word == "switch":
            return self._switch(a, b, at)
        if word == "try":
            return self._try(a, b, at)
        if word in ("return", "throw"):
            end = min(b, max(a + 1, self.f._end(a + 1)))
            self.cover(at, a, end)
            at = self.branches(a + 1, end, at)
            self.edge(at, self.handlers[-1] if word == "throw" and self.handlers else self.exit, word)
            return end, None
        if word in ("break", "continue"):
            to = s.word(a + 1) if s.kind(a + 1) == "name" and s.line(s.tokens[a + 1].at) == s.line(s.tokens[a].at) else ""
            self.cover(at, a, a + 1 + bool(to))
            found = [t for kind, label, t in self.targets if kind == word and (label == to or not to and label != "")] if to else [t for kind, label, t in self.targets if kind == word and label == ""]
            self.edge(at, found[-1] if found else self.exit, word)
            return a + 1 + bool(to), None
        return self.plain(a, b, at)

    def plain(self, a: int, b: int, at: int) -> tuple[int, int]:
        end = min(b, max(a + 1, self.f._end(a)))
        if self.s.word(a) in ("function", "class") or self.s.word(a) in ("async", "export") and self.s.word(a + 1) in ("function", "class"):
            brace = next((j for j in range(a, b) if self.s.word(j) == "{" and self.s.partner[j] > 0), None)
            end = self.s.partner[brace] + 1 if brace is not None else end
        while end < b and self.s.word(end) == ",":
            end = max(end + 1, self.f._end(end + 1))
        self.cover(at, a, end)
        return end, self.branches(a, end, at)

    def branches(self, a: int, b: int, at: int) -> int:
        """Short circuits and conditional expressions of [a, b): blocks of their own, as their right sides may not run."""
        s, i = self.s, a
        while i < b:
            if i in self.f.head_at and self.f.head_at[i] < len(s.tokens):
                i = self.f.head_at[i] + 1
                continue
            if s.kind(i) == "mark" and s.word(i) in ("(", "[", "{") and s.partner[i] > 0:
                i = s.partner[i] + 1
                continue
            if s.kind(i) == "mark" and s.word(i) in ("&&", "||", "??", "?"):
                right, join = self.new("body", i + 1), self.new("join", i)
                self.tests.append((at, a, i))
                self.edge(at, right, "true" if s.word(i) in ("&&", "?") else "false")
                if s.word(i) == "?":
                    colon = next((j for j in range(i + 1, b) if s.word(j) == ":"), None)
                    other = self.new("body", colon)
                    self.edge(at, other, "false")
                    if colon is not None:
                        self.cover(right, i + 1, colon)
                        self.cover(other, colon + 1, b)
                    self.edge(right, join)
                    self.edge(other, join)
                    return join
                self.edge(at, join, "false" if s.word(i) == "&&" else "true")
                self.cover(right, i + 1, b)
                self.edge(self.branches(i + 1, b, right), join)
                return join
            i += 1
        return at

    def _if(self, a: int, b: int, at: int) -> tuple[int, int | None]:
        s = self.s
        end = self.after(a + 1)
        self.cover(at, a, end)
        self.tests.append((at, a + 2, end - 1))
        yes, join = self.new("body", end), None
        self.edge(at, yes, "true")
        a, done = self.statement(end, b, yes)
        while s.word(a) == ";" and s.word(a + 1) == "else":
            a += 1
        if s.word(a) == "else":
            no = self.new("body", a + 1)
            self.edge(at, no, "false")
            a, other = self.statement(a + 1, b, no)
            if done is None and other is None:
                return a, None
            join = self.new("join", a)
            self.edge(other, join)
        else:
            join = self.new("join", a)
            self.edge(at, join, "false")
        self.edge(done, join)
        return a, join

    def _body(self, a: int, b: int, block: int, back: int, out: int, name: str) -> tuple[int, int | None]:
        names = ["", *([name] if name else [])]
        added = [(kind, n, to) for n in names for kind, to in (("break", out), ("continue", back))]
        self.targets += added
        a, end = self.statement(a, b, block)
        del self.targets[len(self.targets) - len(added) :]
        return a, end

    def _loop(self, a: int, b: int, at: int, name: str) -> tuple[int, int]:
        s = self.s
        head = a + 1 + (s.word(a + 1) == "await")
        end = self.after(head)
        test, body, out = self.new("test", a), self.new("body", end), self.new("join", end)
        self.cover(test, a, end)
        self.tests.append((test, head + 1, end - 1))
        self.edge(at, test)
        self.edge(test, body, "true")
        self.edge(test, out, "false")
        a, done = self._body(end, b, body, test, out, name)
        self.edge(done, test, "back")
        return a, out

    def _do(self, a: int, b: int, at: int, name: str) -> tuple[int, int]:
        body, test, out = self.new("body", a + 1), self.new("test", a), self.new("join", a)
        self.edge(at, body)
        a, done = self._body(a + 1, b, body, test, out, name)
        self.edge(done, test)
        while self.s.word(a) == ";":
            a += 1
        if self.s.word(a) == "while":
            end = self.after(a + 1)
            self.cover(test, a, end)
            self.tests.append((test, a + 2, end - 1))
            a = end
        self.edge(test, body, "back")
        self.edge(test, out, "false")
        return a, out

    def _switch(self, a: int, b: int, at: int) -> tuple[int, int]:
        s = self.s
        brace = self.after(a + 1)
        self.cover(at, a, brace)
        self.tests.append((at, a + 2, brace - 1))
        end, out = (s.partner[brace] if s.word(brace) == "{" and s.partner[brace] > 0 else b), self.new("join", brace)
        marks, i = [], brace + 1
        while i < end:
            if s.kind(i) == "name" and s.word(i) in ("case", "default") and s.word(i - 1) in ("{", ";", "}", ":", ")", "]") or s.word(i) in ("case", "default") and s.kind(i) == "name" and s.line(s.tokens[i].at) > s.line(s.tokens[i - 1].at):
                marks.append(i)
            i = self.after(i) if s.word(i) in ("(", "[", "{") and s.kind(i) == "mark" else i + 1
        self.targets.append(("break", "", out))
        before, default = None, False
        for k, m in enumerate(marks):
            colon = next((j for j in range(m, end) if s.word(j) == ":"), m)
            block = self.new("case", m)
            self.cover(block, m, colon + 1)
            default |= s.word(m) == "default"
            self.edge(at, block, s.word(m))
            self.edge(before, block)  # falls through
            before = self.statements(colon + 1, marks[k + 1] if k + 1 < len(marks) else end, block)
        self.targets.pop()
        self.edge(before, out)
        if not default:
            self.edge(at, out, "false")
        return end + 1, out

    def _try(self, a: int, b: int, at: int) -> tuple[int, int | None]:
        s = self.s
        if s.word(a + 1) != "{" or s.partner[a + 1] < 0:
            return self.plain(a, b, at)
        close = s.partner[a + 1]
        body = self.new("body", a + 2)
        self.edge(at, body)
        catch = self.new("catch", close + 1) if s.word(close + 1) == "catch" else None
        if catch is not None:
            self.handlers.append(catch)
            self.edge(body, catch, "exception")
        done = self.statements(a + 2, close, body)
        a = close + 1
        if catch is not None:
            self.handlers.pop()
            brace = self.after(a + 1) if s.word(a + 1) == "(" else a + 1
            self.cover(catch, a, brace)
            handled = self.statements(brace + 1, s.partner[brace], catch) if s.word(brace) == "{" and s.partner[brace] > 0 else catch
            a = self.after(brace)
        else:
            handled = None
        if s.word(a) == "finally" and s.word(a + 1) == "{":
            last = self.new("finally", a)
            self.edge(done, last)
            self.edge(handled, last)
            if catch is None:
                self.edge(body, last, "exception")
            return self.after(a + 1), self.statements(a + 2, s.partner[a + 1], last)
        if done is None and handled is None:
            return a, None
        join = self.new("join", a)
        self.edge(done, join)
        self.edge(handled, join)
        return a, join

    def block_of(self, k: int) -> int:
        """The block of the shortest span around token k."""
        if self.owner is None:
            by_size = sorted(self.spans, key=lambda x: (x[1] - x[0], x[2]))
            self.first = min((a for a, *_ in by_size), default=0)
            self.owner = [by_size[n][2] if n >= 0 else self.entry for n in innermost([(a - 1 - self.first, b - 1 - self.first) for a, b, _ in by_size], max((b for _, b, _ in by_size), default=0) - self.first)]
        return self.owner[k - self.first] if 0 <= k - self.first < len(self.owner) else self.entry

    def rows(self) -> list[dict]:
        s, out = self.s, []
        line = lambda k: s.line(s.tokens[min(k, len(s.tokens) - 1)].at) if k is not None else None
        none = {"fn": self.name, "to": None, "label": None, "line": None, "end_line": None, "ix": None, "var": None, "uses": []}
        for n, (label, a, b) in enumerate(self.blocks):
            out.append(none | {"kind": "block", "block": n, "label": label, "line": line(a), "end_line": line(b)})
        for a, b, label in self.edges:
            out.append(none | {"kind": "edge", "block": a, "to": b, "label": label})
        for block, a, b in self.tests:
            if a < b:
                out.append(none | {"kind": "test", "block": block, "line": line(a), "var": s.text[s.tokens[a].at : s.tokens[b - 1].at + len(s.tokens[b - 1].text)], "uses": self.f.uses(a, b)})
                for label, names in zip(("true", "false"), settled(s, a, b), strict=True):
                    out += [none | {"kind": "settled", "block": block, "label": label, "var": name} for name in sorted(names)]
        return out


def graphs_of(flows: Flows) -> tuple[dict[str, Graph], list[dict]]:
    """The first graph of each name, and the rows of all."""
    out: list[dict] = []
    graphs: dict[str, Graph] = {}
    for j, (k, _, _, start, end) in enumerate(flows.heads):
        name = flows.name_of(k, j)
        graph = Graph(flows, name)
        graph.run(start, min(end, len(flows.s.tokens) - 1))
        graphs.setdefault(name, graph)
        out += graph.rows()
    return graphs, out


def read_graphs(text: str) -> list[dict]:
    flows = Flows(text)
    graphs, out = graphs_of(flows)
    first: dict[str, int] = {}
    marks = [k for k, t in enumerate(flows.s.tokens) if t.kind == "mark" and t.text in ("=", "+=", "-=", "*=", "??=", "||=", "&&=")]
    none = {"to": None, "label": None, "end_line": None}
    for k in marks:
        before = len(flows.out)
        if not flows._default(k):
            flows._assigned(k)
        for r in flows.out[before:]:
            if graph := graphs.get(r["fn"]):  # the value is there when its expression ends
                out.append(none | {"fn": r["fn"], "kind": "def", "block": graph.block_of(k), "line": r["line"], "ix": max(k, flows._end(k + 1) - 1), "var": r["target"], "uses": r["uses"]})
    for k, t in enumerate(flows.s.tokens):
        if t.text != "(" or t.kind != "mark" or flows.s.partner[k] < 0 or not flows._callee(k):
            continue
        before = len(flows.out)
        flows._called(k)
        for r in flows.out[before:]:
            graph = graphs.get(r["fn"])
            if graph and r["kind"] == "arg":
                out.append(none | {"fn": r["fn"], "kind": "arg", "block": graph.block_of(k), "to": r["arg"], "line": r["line"], "ix": k, "var": r["callee"], "uses": r["uses"]})
            elif graph:
                uses = [u for x in flows.out[before + 1 :] for u in x["uses"]]
                out.append(none | {"fn": r["fn"], "kind": "def", "block": graph.block_of(k), "label": r["callee"], "line": r["line"], "ix": k, "var": f"@{k}", "uses": list(dict.fromkeys(uses))})
    for j, (k, opened, close, _, _) in enumerate(flows.heads):
        name = flows.name_of(k, j)
        if first.setdefault(name, j) != j:
            continue
        names = [[flows.s.word(opened)]] if flows.s.word(opened) != "(" else [flows._bound(a, b) for a, b in flows._split(opened + 1, close)]
        for n, bound in enumerate(names):
            for one in bound:
                out.append({"fn": name, "kind": "def", "block": 0, "to": None, "label": "param", "line": flows.s.line(flows.s.tokens[k].at), "end_line": None, "ix": -1 - n, "var": one, "uses": []})
    return out


def extract(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Control flow of all functions of every file, one parse each, no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = read_graphs(text)
                except Exception as e:  # one bad file must not hide the others
                    rows = [{"fn": "", "kind": "error", "block": None, "to": None, "label": f"{type(e).__name__}: {e}", "line": 1, "end_line": None, "ix": None, "var": None, "uses": []}]
                out += [r | {"path": path} for r in rows]
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return files.select(F.col(path_col).alias("path"), F.coalesce(F.col(content_col), F.lit("")).alias("content")).mapInArrow(run, SCHEMA)
