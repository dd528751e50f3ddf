"""Recursion over edge tables: closures, fixpoints and bounded path enumeration."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewell.session import spread


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by checkpoint() in the shared folder of spark.checkpoint.dir; where that is unset, in a local session's warehouse."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def sent(rows: DataFrame) -> DataFrame:
    """rows as a side of a join to which both sides are sent by key. What is parsed from a small table, or follows from that, is held
    small by the planner, which then would send it whole to the driver and to every task, however large it is."""
    return rows.hint("merge")


_SLICE, _ROWS = 256, 1 << 15


def each_group(rows: DataFrame, keys: tuple[str, ...], work: Callable[[tuple, list[tuple]], Iterable[tuple | pa.RecordBatch]], schema: str) -> DataFrame:
    """What work(key, rows) gives for the rows of every key, as tuples or as whole record batches; the rows are tuples of the other
    columns, in their order.

    A key's rows come to one task, as one row; where they lie together already, they are put together before they are sent.
    """
    rest = [c for c in rows.columns if c not in keys]
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("__rows"))
    names = StructType.fromDDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for first in range(0, many.num_rows, _SLICE):
                part = many.slice(first, _SLICE)
                lists = part.column(len(keys))
                flat = list(zip(*[c.to_pylist() for c in lists.flatten().flatten()], strict=True))
                at, out = 0, []
                for key, n in zip(zip(*[part.column(k).to_pylist() for k in range(len(keys))], strict=True), lists.value_lengths().to_pylist(), strict=True):
                    for found in work(key, flat[at : at + n]):
                        if isinstance(found, pa.RecordBatch):
                            yield found
                            continue
                        out.append(found)
                        if len(out) >= _ROWS:  # a group can give many times its own rows
                            yield batch(names, list(zip(*out, strict=True)))
                            out = []
                    at += n
                if out:
                    yield batch(names, list(zip(*out, strict=True)))

    return packed.mapInArrow(run, schema)


def batch(names: StructType, columns: list) -> pa.RecordBatch:
    """Columns, as Arrow arrays or as values, in the types of a schema."""
    kind = to_arrow_schema(names)
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def closure(start: DataFrame, step, rounds: int | None = None) -> DataFrame:
    """The rows of start and all that step(rows) leads to: semi-naive, each round works on the new rows alone.

    A round writes its new rows only; those of the rounds before are read where they lie. It ends when nothing is new, or
    after `rounds`.
    """
    fresh = cut(start.distinct())
    parts = [fresh]
    while rounds is None or len(parts) <= rounds:
        known = reduce(DataFrame.unionByName, parts)
        fresh = cut(step(fresh).distinct().join(known, known.columns, "left_anti"))
        if not fresh.limit(1).count():
            break
        parts.append(fresh)
        if len(parts) > 24:  # a long chain: one table again, so that the plan stays short
            parts = [cut(reduce(DataFrame.unionByName, parts))]
            rounds = rounds and rounds - 24
    return reduce(DataFrame.unionByName, parts)


def cheapest(start: DataFrame, keys: list[str], cost: str, step) -> DataFrame:
    """(keys, cost): what start(keys, cost) and step(rows) lead to, each at its least cost.

    A round works on the rows that are new or cheaper than before; with costs that grow along a step it ends in spite of cycles.
    """
    best = lambda df: df.groupBy(*keys).agg(F.min(cost).alias(cost))
    fresh = cut(best(start.select(*keys, cost)))
    known = fresh
    while True:
        was = known.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(cost).alias("__was"))
        equal = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys])
        met = best(step(fresh).select(*keys, cost)).join(sent(was), equal, "left").filter(F.col("__was").isNull() | (F.col(cost) < F.col("__was")))
        fresh = cut(met.select(*keys, cost))
        if not fresh.limit(1).count():
            return known
        known = cut(best(known.unionByName(fresh)))


_EDGES, _MATRIX = 4_000_000, 1 << 25
_WHOLE = ("tinyint", "smallint", "int", "bigint")


class Packed:
    """A graph in arrays, over which bits are carried: one bit for each of the rows that set out."""

    def __init__(self, ids: np.ndarray, source: np.ndarray, target: np.ndarray):
        self.ids = np.unique(np.concatenate([ids, source, target]))
        n, u, v = len(self.ids), np.searchsorted(self.ids, source), np.searchsorted(self.ids, target)
        order = np.argsort(u, kind="stable")
        self.to, self.first = v[order], np.searchsorted(u[order], np.arange(n + 1))
        self.most = 64 * max(1, min(64, _MATRIX // (8 * max(n, 1))))  # bits at a time: a matrix of at most 32 MB, or of one word a node

    def carried(self, at: np.ndarray, bits: np.ndarray, stops: np.ndarray | None = None, itself: bool = False) -> np.ndarray:
        """By node: the bits that come to it (words of 64) from where they set out, along edges, up to the nodes that stop them;
        with itself, a bit is also where it sets out. A round goes on from the nodes to which something new has come."""
        words = int(bits.max()) // 64 + 1 if len(bits) else 1
        held = np.zeros((len(self.ids), words), np.uint64)
        begun = held if itself else np.zeros_like(held)
        np.bitwise_or.at(begun, (at, bits // 64), np.uint64(1) << (bits % 64).astype(np.uint64))
        active, now = np.unique(at), begun
        while len(active):
            n = self.first[active + 1] - self.first[active]
            edges = np.repeat(self.first[active] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            if not len(edges):
                break
            order = np.argsort(self.to[edges], kind="stable")
            to, sent = self.to[edges][order], np.repeat(active, n)[order]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            was = held[to[heads]]
            more = np.bitwise_or.reduceat(now[sent], heads, axis=0) | was
            new = (more != was).any(axis=1)
            active, now = to[heads][new], held
            held[active] = more[new]
            if stops is not None:
                active = active[~stops[active]]
        return held


def of_word(held: np.ndarray, word: int) -> np.ndarray:
    """(64, nodes): whether each bit of a word has come to each node."""
    return np.unpackbits(np.ascontiguousarray(held[:, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(bool)


def _walked(edges: DataFrame, start: DataFrame, source: str, target: str, told: bool) -> DataFrame | None:
    """reachable(), or with told reached(), for graphs of whole numbers that fit into each task; starts are dealt out to tasks, which
    carry a bit for each and send rows on start by start: nothing is shuffled but the starts. None for other graphs."""
    hop = edges.select(F.col(source).alias("node"), F.col(target).alias("__to")).filter("node IS NOT NULL AND __to IS NOT NULL").distinct()
    kinds = [hop.schema["node"].dataType.simpleString(), hop.schema["__to"].dataType.simpleString(), start.schema["node"].dataType.simpleString()]
    if any(k not in _WHOLE for k in kinds) or kinds[1] != kinds[2]:
        return None
    hop = cut(hop)
    if hop.count() > _EDGES:
        return None
    packed = hop.select(F.col("node").cast("long"), F.col("__to").cast("long")).toArrow()
    u, v = (packed.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(2))
    shown = start.select("start", "node").schema
    schema = f"start {shown['start'].dataType.simpleString()}, " + ("reached long, least {0}, greatest {0}" if told else "node {0}").format(kinds[2])
    kept = StructType.fromDDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(kept)
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        names = whole.column(0).combine_chunks().dictionary_encode(null_encoding="encode")
        nodes, number = whole.column(1).combine_chunks().cast(pa.int64()), names.indices.to_numpy(zero_copy_only=False)
        there = nodes.is_valid().to_numpy(zero_copy_only=False)
        at = nodes.fill_null(0).to_numpy(zero_copy_only=False)
        graph = Packed(at[there], u, v)
        where, ids = np.searchsorted(graph.ids, at), pa.array(graph.ids).cast(kind[-1].type)
        empty = np.unique(number[~there])  # a start at no node has that as its row
        for first in range(0, len(names.dictionary), graph.most):
            mine = there & (number >= first) & (number < first + graph.most)
            held = graph.carried(where[mine], number[mine] - first, itself=True)
            for word in range(held.shape[1]):
                met = of_word(held, word)
                base = first + 64 * word
                if told:
                    n = met.sum(axis=1)
                    live = np.flatnonzero(n)
                    least, greatest = met[live].argmax(axis=1), met.shape[1] - 1 - met[live][:, ::-1].argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(base + live)), pa.array(n[live] + np.isin(base + live, empty), pa.int64()), ids.take(pa.array(least)), ids.take(pa.array(greatest))], schema=kind)
                else:
                    k, node = np.nonzero(met)
                    for cut_ in range(0, len(k), 1 << 18):
                        part = slice(cut_, cut_ + (1 << 18))
                        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(base + k[part])), ids.take(pa.array(node[part]))], schema=kind)
        alone = np.setdiff1d(empty, number[there]) if told else empty
        if len(alone):
            own = names.dictionary.take(pa.array(alone))
            yield pa.RecordBatch.from_arrays([own, pa.array([1] * len(alone), pa.int64()), *[pa.nulls(len(alone), kind[-1].type)] * 2] if told else [own, pa.nulls(len(alone), kind[-1].type)], schema=kind)

    return spread(start.select("start", "node"), "start").mapInArrow(run, schema)


def reachable(edges: DataFrame, start: DataFrame, source: str, target: str) -> DataFrame:
    """(start, node): every node that a start leads to over edges (source to target), itself included."""
    walked = _walked(edges, start, source, target, False)
    if walked is not None:
        return walked
    hop = edges.select(F.col(source).alias("node"), F.col(target).alias("__to")).distinct()
    return closure(start.select("start", "node"), lambda new: new.join(hop, "node").select("start", F.col("__to").alias("node")))


def reached(edges: DataFrame, start: DataFrame, source: str, target: str) -> DataFrame:
    """(start, reached, least, greatest): how many nodes a start leads to, itself included, the least and the greatest of them."""
    walked = _walked(edges, start, source, target, True)
    if walked is not None:
        return walked
    return reachable(edges, start, source, target).groupBy("start").agg(F.count("*").alias("reached"), F.min("node").alias("least"), F.max("node").alias("greatest"))


def summary_fixpoint(hits: DataFrame, calls: DataFrame) -> DataFrame:
    """Sink hits (fn, param, kind) carried from callees to callers over calls (caller, caller_param, callee, callee_param)."""
    links = calls.filter(F.col("caller") != F.col("callee")).select(F.col("callee").alias("fn"), F.col("callee_param").alias("param"), "caller", "caller_param")
    return closure(hits.select("fn", "param", "kind"), lambda new: new.join(links, ["fn", "param"]).select(F.col("caller").alias("fn"), F.col("caller_param").alias("param"), "kind"))


def paths(edges: DataFrame, start: DataFrame, source: str, target: str, depth: int) -> DataFrame:
    """(start, node, depth, trail): all paths of up to `depth` edges that visit no node twice."""
    hop = edges.select(F.col(source).alias("node"), F.col(target).alias("__to")).distinct()
    level = start.select("start", "node", F.lit(0).alias("depth"), F.array("node").alias("trail"))
    found = level
    for d in range(1, depth + 1):
        level = level.join(hop, "node").filter(~F.array_contains("trail", F.col("__to"))).select("start", F.col("__to").alias("node"), F.lit(d).alias("depth"), F.concat("trail", F.array("__to")).alias("trail"))
        found = found.unionByName(level)
    return found.select("start", "node", "depth", "trail")
