"""Data flow inside functions, over the rows of extract.cfg: reachability, dominators, reaching definitions and taint.

Functions are grouped, and each is worked on in one pass by one task; reaching definitions alone share a large function out, by its
definitions. A fixpoint ends when a round finds nothing new. Facts only grow, so no bound on passes and no widening is needed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.operators import graphs
from tracewell.taint.summaries import Catalogue, root

FN = ("path", "fn")
_SHARE = 512


def edges(cfg: DataFrame) -> DataFrame:
    return cfg.filter("kind = 'edge'").select(*FN, "block", "to", "label")


_BLOCKS = "path string, fn string, block long, rank int, idom long, depth int, enter int, leave int, frontier array<bigint>"


def _numbered(entry: int, after: dict[int, list[int]]) -> list[int]:
    """Blocks that the entry leads to, in reverse postorder."""
    seen, out, work = {entry}, [], [(entry, iter(after.get(entry, ())))]
    while work:
        block, rest = work[-1]
        to = next((x for x in rest if x not in seen), None)
        if to is None:
            out.append(block)
            work.pop()
        else:
            seen.add(to)
            work.append((to, iter(after.get(to, ()))))
    return out[::-1]


def _tree(ranked: list[int], after: dict[int, list[int]]) -> tuple[list[int], list[list[int]], list[set[int]]]:
    """By rank: the immediate dominator's rank (of the entry: itself), predecessors, and the dominance frontier."""
    rank = {b: k for k, b in enumerate(ranked)}
    before: list[list[int]] = [[] for _ in ranked]
    for b in ranked:
        for to in after.get(b, ()):
            before[rank[to]].append(rank[b])
    idom = [0] + [-1] * (len(ranked) - 1)
    changed = True
    while changed:  # twice for reducible graphs
        changed = False
        for k in range(1, len(ranked)):
            found = -1
            for p in before[k]:
                if idom[p] < 0:
                    continue
                q = found if found >= 0 else p
                while p != q:  # the nearest that both have above them: a dominator has the smaller rank
                    p, q = (idom[p], q) if p > q else (p, idom[q])
                found = p
            changed |= idom[k] != found
            idom[k] = found
    frontier: list[set[int]] = [set() for _ in ranked]
    for k, sources in enumerate(before):
        if len(sources) > 1 or k == 0:
            for p in sources:
                while p != idom[k] or k == 0:
                    frontier[p].add(k)
                    if p == 0:
                        break
                    p = idom[p]
    return idom, before, frontier


def _graph(told: list[tuple]) -> tuple[list[int], dict[int, list[int]]]:
    """Blocks that the entry leads to, in reverse postorder, and where each leads; an entry's row has no block."""
    after: dict[int, list[int]] = {}
    for x, y in sorted({(x, y) for x, y in told if x is not None and y is not None}):
        after.setdefault(x, []).append(y)
    entries = [y for x, y in told if x is None]
    return (_numbered(min(entries), after) if entries else []), after


def _blocks(key: tuple, told: list[tuple]) -> list[tuple]:
    ranked, after = _graph(told)
    idom, _, frontier = _tree(ranked, after) if ranked else ([], [], [])
    under: list[list[int]] = [[] for _ in ranked]
    depth, enter, leave = [0] * len(ranked), [0] * len(ranked), [0] * len(ranked)
    for k in range(1, len(ranked)):
        under[idom[k]].append(k)
        depth[k] = depth[idom[k]] + 1  # a dominator has the smaller rank
    clock, work = 0, [(0, False)] if ranked else []
    while work:
        k, done = work.pop()
        if done:
            leave[k] = clock
            continue
        enter[k], clock = clock, clock + 1
        work.append((k, True))
        work += [(u, False) for u in reversed(under[k])]
    return [(*key, b, k, ranked[idom[k]] if k else None, depth[k], enter[k], leave[k], sorted(ranked[x] for x in frontier[k])) for k, b in enumerate(ranked)]


def _together(steps: DataFrame, first: DataFrame | None) -> DataFrame:
    long = lambda name: F.col(name).cast("long")
    told = steps.select(*FN, long("block").alias("block"), long("to").alias("to"))
    return told if first is None else told.unionByName(first.select(*FN, F.lit(None).cast("long").alias("block"), long("block").alias("to")))


def structure(steps: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """A row for each block that its function's entry leads to: rank in reverse postorder, idom (immediate dominator; null for the
    entry), depth in the dominator tree, its interval there [enter, leave), and frontier (the dominance frontier, ascending).

    steps (path, fn, block, to), first (path, fn, block); without first, steps hold the entries, as rows without a block. Functions
    are grouped, and one function's graph is one task's: it came from one parse of one file. A block dominates another if its
    interval has the other's in it.
    """
    return graphs.each_group(_together(steps, first), FN, _blocks, _BLOCKS)


def reachable(steps: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(path, fn, block) that first(path, fn, block) leads to."""
    return graphs.each_group(_together(steps, first), FN, lambda key, told: [(*key, b) for b in _graph(told)[0]], "path string, fn string, block long")


_PAIRS = "path string, fn string, block long, dominator long"


def _lines(key: tuple, idom: dict[int, int | None]) -> Iterator[tuple]:
    for block in idom:
        at: int | None = block
        while at is not None:
            yield (*key, block, at)
            at = idom[at]


def dominators(blocks: DataFrame) -> DataFrame:
    """(path, fn, block, dominator): every way from the entry to a block goes through its dominators, itself included.

    blocks: what structure() gives. As many rows as all lines of the dominator tree have, made function by function.
    """
    return graphs.each_group(blocks.select(*FN, "block", "idom"), FN, lambda key, told: _lines(key, dict(told)), _PAIRS)


def dominated(steps: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """dominators(structure(steps, first)) in one pass: edges are sent once, and nothing else."""

    def work(key: tuple, told: list[tuple]) -> Iterator[tuple]:
        ranked, after = _graph(told)
        idom = _tree(ranked, after)[0] if ranked else []
        return _lines(key, {b: ranked[idom[k]] if k else None for k, b in enumerate(ranked)})

    return graphs.each_group(_together(steps, first), FN, work, _PAIRS)


def back_edges(steps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges to a block that dominates where they begin: the loops of a reducible graph. blocks: what structure() gives."""
    here = blocks.select(*FN, "block", F.col("enter").alias("__at"))
    there = blocks.select(*FN, F.col("block").alias("to"), "enter", "leave")
    met = steps.join(here, [*FN, "block"]).join(there, [*FN, "to"]).filter("enter <= __at AND __at < leave")
    return met.select(*steps.columns)


def loops(steps: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(path, fn, block, to) of back_edges(), in one pass: edges are sent once, and nothing else."""

    def work(key: tuple, told: list[tuple]) -> Iterator[tuple]:
        ranked, after = _graph(told)
        idom, before, _ = _tree(ranked, after) if ranked else ([], [], [])
        for k, sources in enumerate(before):
            for p in sources:
                at = p
                while at > k:  # a dominator has the smaller rank
                    at = idom[at]
                if at == k:
                    yield (*key, ranked[p], ranked[k])

    return graphs.each_group(_together(steps, first), FN, work, "path string, fn string, block long, to long")


# conditions


def refinements(cfg: DataFrame) -> DataFrame:
    """(path, fn, block, label, var): on this edge of a test the variable cannot hold any text (see extract.conditions)."""
    return cfg.filter("kind = 'settled'").select(*FN, "block", "label", root(F.col("var")).alias("var")).distinct()


# definitions


def definitions(cfg: DataFrame) -> DataFrame:
    """(path, fn, block, def, var, callee, uses, line)."""
    return cfg.filter("kind = 'def'").select(*FN, "block", F.col("ix").alias("def"), root(F.col("var")).alias("var"), F.when(F.col("label") != "param", F.col("label")).alias("callee"), (F.col("label") == "param").alias("param"), "uses", "line")


def reaching(defs: DataFrame, steps: DataFrame, refined: DataFrame | None = None) -> DataFrame:
    """(path, fn, block, var, def): definitions that may still hold where a block begins.

    refined: edges (path, fn, block, label, var) that a variable's definitions do not pass.
    """
    last = defs.groupBy(*FN, "block", "var").agg(F.max("def").alias("def"))
    last = graphs.cut(last.filter("path IS NOT NULL AND fn IS NOT NULL AND block IS NOT NULL AND var IS NOT NULL AND def IS NOT NULL"))
    kind = {c: last.schema[c].dataType.simpleString() for c in ("var", "def")} | {"to": steps.schema["to"].dataType.simpleString()}
    schema = f"path string, fn string, block {kind['to']}, var {kind['var']}, def {kind['def']}"
    none = lambda t: F.lit(None).cast(t)
    block, to = F.col("block").cast("long").alias("block"), F.col("to").cast("long").alias("to")
    told = steps.select(*FN, block, to, "label", none(kind["var"]).alias("var"), none(kind["def"]).alias("def")).filter("block IS NOT NULL AND to IS NOT NULL").distinct()
    told = told.unionByName(last.select(*FN, block, none("long").alias("to"), none("string").alias("label"), "var", "def"))
    if refined is not None:
        told = told.unionByName(refined.select(*FN, block, none("long").alias("to"), "label", "var", none(kind["def"]).alias("def")))
    # a function of many definitions is shared out by them: each share gets the whole graph
    shares = last.groupBy(*FN).agg(F.ceil(F.count("*") / _SHARE).cast("int").alias("__n"))
    told = told.join(shares, list(FN)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))

    def work(key: tuple, told: list[tuple]) -> Iterator[pa.RecordBatch]:
        path, fn, n, k = key
        all_edges, begun, settled = [], {}, {}
        for block, to, label, var, number in told:
            if to is not None:
                all_edges.append((block, to, label))
            elif number is not None:
                begun.setdefault(var, []).append((block, number))
            else:
                settled.setdefault(var, set()).add((block, label))
        shares, whole = {}, None
        for place, (var, one) in enumerate(sorted((v, o) for v, ones in begun.items() for o in ones)):
            if place % n == k:
                shares.setdefault(var, []).append(one)
        for var, mine in shares.items():
            not_passed = settled.get(var, set())
            kept = [e for e in all_edges if (e[0], e[2]) not in not_passed] if not_passed else all_edges
            if whole is None or not_passed:
                graph = graphs.Packed(np.array([b for ones in begun.values() for b, _ in ones], np.int64), np.array([e[0] for e in kept], np.int64), np.array([e[1] for e in kept], np.int64))
                whole = None if not_passed else graph
            else:
                graph = whole
            stops = np.zeros(len(graph.ids), bool)
            stops[np.searchsorted(graph.ids, [b for b, _ in begun[var]])] = True
            for first in range(0, len(mine), graph.most):
                part = mine[first : first + graph.most]
                held = graph.carried(np.searchsorted(graph.ids, [b for b, _ in part]), np.arange(len(part)), stops)
                numbers = pa.array([d for _, d in part])
                for word in range(held.shape[1]):
                    bit, node = np.nonzero(graphs.of_word(held, word))
                    for at in range(0, len(bit), 1 << 18):
                        b = slice(at, at + (1 << 18))
                        rows = len(bit[b])
                        yield graphs.batch(schema_, [pa.array([path] * rows), pa.array([fn] * rows), pa.array(graph.ids[node[b]]), pa.array([var] * rows), numbers.take(pa.array(64 * word + bit[b]))])

    schema_ = StructType.fromDDL(schema)
    return graphs.each_group(told.select(*FN, "__n", "__k", "block", "to", "label", "var", "def"), (*FN, "__n", "__k"), work, schema)


def chains(uses: DataFrame, defs: DataFrame, reach: DataFrame) -> DataFrame:
    """uses (path, fn, block, at, use, ...) with def: the definitions that each use may see. One in the same block that comes
    before hides those that reach the block; a call's result is seen wherever it is named."""
    named = uses.withColumn("var", root(F.col("use")))
    of_calls = named.filter("var LIKE '@%'").join(defs.select(*FN, "var", "def"), [*FN, "var"])
    plain = named.filter("var NOT LIKE '@%'")
    near = plain.join(defs.select(*FN, "block", "var", F.col("def").alias("d")), [*FN, "block", "var"]).filter("d < at").groupBy(*plain.columns).agg(F.max("d").alias("def"))
    far = plain.join(near.select(*FN, "block", "at", "use").distinct(), [*FN, "block", "at", "use"], "left_anti").join(reach, [*FN, "block", "var"])
    columns = [*uses.columns, "def"]
    return near.select(*columns).unionByName(far.select(*columns)).unionByName(of_calls.select(*columns))


def tainted(cfg: DataFrame, names: Catalogue | None = None, parameters: bool = False) -> DataFrame:
    """(path, fn, line, sink_kind, sink_callee, arg, origin, sanitized, sanitizations): what reaches a sink inside its function,
    along definitions and their uses. With parameters, every parameter counts as an origin ("param:name")."""
    names = names or Catalogue()
    kind, var = F.col("kind"), F.col("var")
    known = kind.isin("edge", "settled", "def") | ((kind == "arg") & (F.col("to") >= 0) & names.sink_kind(var).isNotNull() & names.takes(var, F.col("to")))
    mark = F.when((kind == "def") & (F.col("label") != "param"), names.sanitizer_kind(F.col("label")))
    told = cfg.filter(known).select(*FN, "kind", "block", "to", "label", "ix", F.when(kind.isin("def", "settled"), root(var)).otherwise(var).alias("var"), "uses", "line", mark.alias("mark"), F.when(kind == "arg", names.sink_kind(var)).alias("sink"))
    source_of = names.source_of

    def work(key: tuple, told: list[tuple]) -> list[tuple]:
        return [(*key, *found) for found in _Function(told, source_of).taint(parameters)] if any(t[0] == "arg" for t in told) else []

    return graphs.each_group(told, FN, work, _TAINTED)


_TAINTED = "path string, fn string, line int, sink_kind string, sink_callee string, arg int, origin string, sanitized boolean, sanitizations array<string>"


def _root(use: str) -> str:
    """root() of one name."""
    parts = use.split(".", 2)
    return ".".join(parts[:2]) if use.startswith("this.") else parts[0]


class _Function:
    """Definitions of one function, where they hold and what they are made of."""

    def __init__(self, told: list[tuple], source_of):
        self.source_of, self.defs, self.args = source_of, [], []
        self.after: dict[int, set[tuple[int, str]]] = {}
        self.settled: dict[str, set[tuple[int, str]]] = {}
        self.of: dict[str, list[tuple[int, int]]] = {}  # by variable: block and number of its definitions
        for kind, block, to, label, ix, var, uses, line, mark, sink in told:
            if kind == "edge":
                self.after.setdefault(block, set()).add((to, label))
            elif kind == "settled":
                self.settled.setdefault(var, set()).add((block, label))
            elif kind == "def":
                self.defs.append((block, ix, var, uses or (), mark, label == "param"))
                if var is not None:
                    self.of.setdefault(var, []).append((ix, block))
            else:
                self.args.append((block, ix, uses or (), (line, sink, var, to)))
        self.blocks = sorted(self.after)
        self.reach: dict[str, tuple[dict[int, int], list[int]]] = {}
        self.inside: dict[str, dict[int, list[int]]] = {}
        for var, ones in self.of.items():
            own = self.inside[var] = {}
            for ix, block in sorted(ones):
                own.setdefault(block, []).append(ix)

    def reaching(self, var: str) -> tuple[dict[int, int], list[int]]:
        """By block, bits of the definitions that may hold where it begins, and the definitions."""
        if var not in self.reach:
            last = {block: ixs[-1] for block, ixs in self.inside.get(var, {}).items()}
            numbers, settled, into = list(last.values()), self.settled.get(var, ()), {}
            begun, again = {block: 1 << k for k, block in enumerate(last)}, True
            while again:  # once more for each edge back on a way
                again = False
                for block in self.blocks:
                    bits = begun[block] if block in begun else into.get(block, 0)
                    for to, label in self.after[block] if bits else ():
                        if bits & ~into.get(to, 0) and (block, label) not in settled:
                            into[to] = into.get(to, 0) | bits
                            again |= to <= block
            self.reach[var] = into, numbers
        return self.reach[var]

    def seen(self, block: int, at: int, use: str) -> set[int]:
        """chains() of one use."""
        var = _root(use)
        if var.startswith("@"):
            return {ix for ix, _ in self.of.get(var, ())}
        near = self.inside.get(var, {}).get(block, ())
        if place := bisect_left(near, at):
            return {near[place - 1]}
        into, numbers = self.reaching(var)
        bits, found = into.get(block, 0), set()
        while bits:
            low = bits & -bits
            found.add(numbers[low.bit_length() - 1])
            bits ^= low
        return found

    def taint(self, parameters: bool) -> set[tuple]:
        """(line, sink_kind, sink_callee, arg, origin, sanitized, sanitizations)."""
        state: dict[int, set[tuple[str, tuple]]] = {}
        hop: dict[int, set[tuple[int, str | None]]] = {}
        for block, ix, var, uses, mark, param in self.defs:
            if param and parameters:
                state.setdefault(ix, set()).add((f"param:{var}", ()))
            for use in uses:
                if origin := self.source_of(use):
                    state.setdefault(ix, set()).add((origin, () if mark is None else (mark,)))
                for was in self.seen(block, ix, use):
                    hop.setdefault(was, set()).add((ix, mark))
        work = {at: set(held) for at, held in state.items()}
        while work:
            at, fresh = work.popitem()
            for to, mark in hop.get(at, ()):
                known = state.setdefault(to, set())
                new = {(o, k if mark is None or mark in k else tuple(sorted((*k, mark)))) for o, k in fresh} - known
                if new:
                    known |= new
                    work.setdefault(to, set()).update(new)
        found = set()
        for block, at, uses, place in self.args:
            for use in uses:
                held = {h for was in self.seen(block, at, use) for h in state.get(was, ())}
                if origin := self.source_of(use):
                    held.add((origin, ()))
                found |= {(*place, o, bool(k), k) for o, k in held}
        return found


def confidence(steps: Column) -> Column:
    """How sure a flow of so many steps is: over 10 low, over 5 medium, else high."""
    return F.when(steps > 10, "low").when(steps > 5, "medium").otherwise("high")
