"""Exact top-k search over integer vectors by block-at-a-time pruning.

Rows lie in blocks of a range of ids; a block has the largest and smallest value of every component, and its rows as a
forward index. A query sums its term maxima over the components into a bound for each block, visits blocks from the
highest bound down, scores their rows exactly and stops when a bound falls below its kth score.

Queries are a stated set, in packs; every pack meets every segment of blocks once, by an equi-join on the segment number
after each pack was dealt to all segments. Each meeting returns k rows a query at most, and the last step ranks those.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; a query meets vectors
of its own length only; ids that are null take no part; rows that repeat an id other than the query's are separate
candidates. A component that is no finite number after scaling counts as non-finite. Components of any size are multiplied
exactly (in integers without bound where 64 bits do not suffice); rows are ranked by scores of up to 38 digits, and scores
beyond 64 bits are shown as the greatest or least long.

Blocks can only be left out where rows of near ids are alike or differ in length from others: for vectors of random
directions the sum of term maxima is above every score, and all blocks are scored (see share_scored).
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import tables


#: The greatest score of 38 digits.
MOST = 10**38 - 1


def quantized(rows: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v array<double>): floor(scale * x), with x as double; only rows that take part."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double") * F.lit(float(scale)))
    fine = F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    shown = rows.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(fine)
    # the floor of a double as a long is exact below 2**52; a larger one has no fraction
    return shown.select("id", F.transform("x", lambda e: F.when(F.abs(e) < F.lit(float(1 << 52)), F.floor(e).cast("double")).otherwise(e)).alias("v"))


def packed(rows: DataFrame, per: int, parts: int) -> DataFrame:
    """(pack long, width, ids binary, vectors binary): at most per rows of one width, in order of id within a range of ids."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}

        def pack(width, items):
            nonlocal number
            number += 1
            ids = np.array([i for i, _ in items], np.int64)
            return {"pack": number, "width": width, "ids": ids.tobytes(), "vectors": np.array([v for _, v in items], np.float64).tobytes()}

        def send(out):
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([("pack", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())]))

        for batch in batches:
            values = batch.column(1)
            flat = values.flatten().to_numpy(zero_copy_only=False)
            sizes = values.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for i, size, end in zip(batch.column(0).to_pylist(), sizes.tolist(), ends.tolist(), strict=True):
                own = waiting.setdefault(size, [])
                own.append((i, flat[end - size : end]))
                if len(own) == per:
                    yield send([pack(size, waiting.pop(size))])
        for size, own in waiting.items():
            yield send([pack(size, own)])

    return rows.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(run, "pack long, width int, ids binary, vectors binary")


def exact(q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type whose inner products are exact: doubles (products run on BLAS), longs, or Python's integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return q, rows
    if most < 2**63:
        return q.astype(np.int64), rows.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(q), whole(rows)


def block_topk(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = 64, step: int = 8, seen: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best rows for each query, by descending score and then id; a query's own id is left out.

    q and rows hold whole numbers as doubles. seen, if given, gets the number of blocks scored and that of all.
    """
    q, rows = exact(q, rows)
    kind = q.dtype
    edges = np.arange(0, len(rows), block)
    high, low = np.maximum.reduceat(rows, edges, axis=0), np.minimum.reduceat(rows, edges, axis=0)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    whole = [(rows[e : e + block], ids[e : e + block]) for e in edges]
    out = []
    for n in range(len(q)):
        own, bound = order[n], bounds[n]
        best_s, best_i = np.zeros(0, kind), np.zeros(0, np.int64)
        scored = 0
        for at in range(0, len(own), step):
            if len(best_s) >= k and bound[own[at]] < best_s[k - 1]:
                break
            some = own[at : at + step]
            scored += len(some)
            found_i = np.concatenate([whole[b][1] for b in some])
            found_s = np.concatenate([whole[b][0] for b in some]) @ q[n]
            ok = found_i != q_ids[n]
            if len(best_s) >= k:
                ok &= found_s >= best_s[k - 1]
            if not ok.any():
                continue
            best_s, best_i = np.concatenate([best_s, found_s[ok]]), np.concatenate([best_i, found_i[ok]])
            first = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[first], best_i[first]
        out += [(int(q_ids[n]), int(i), int(s)) for s, i in zip(best_s, best_i, strict=True)]
        if seen is not None:
            seen += [scored, len(own)]
    return out


def share_scored(q: np.ndarray, rows: np.ndarray, k: int = 5, block: int = 64) -> float:
    """The share of blocks that the queries q score among rows in this order: what pruning leaves."""
    seen: list[int] = []
    block_topk(np.full(len(q), -1), q, np.arange(len(rows)), rows, k, block, 1, seen)
    return sum(seen[::2]) / max(1, sum(seen[1::2]))


def search(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, per_segment: int = 8192, per_pack: int = 512) -> DataFrame:
    """(query_id, rank, id, score): the k highest integer inner products of each query row with all other rows.

    is_query: a condition on the column "id". The table is counted once to size the segments.
    """
    v = quantized(rows, id_col, vector_col, scale)
    parts = max(1, -(-rows.count() // per_segment))
    segments = packed(v, per_segment, parts).withColumn("segment", F.col("pack"))
    segments = tables.cut(segments)
    packs = packed(v.filter(is_query), per_pack, max(1, parts // 16))
    numbers = segments.select("segment", F.col("width").alias("w")).groupBy("w").agg(F.collect_list("segment").alias("all"))
    # one array of segment numbers for each width: eight bytes for every 8192 rows
    dealt = packs.join(numbers, packs["width"] == numbers["w"]).select(F.explode("all").alias("segment"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))
    met = dealt.join(segments, "segment").select("q_ids", "q", "width", "ids", "vectors")

    def score(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                width = r["width"]
                found += block_topk(np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q"]).reshape(-1, width), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, width), k)
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            score = [decimal.Decimal(min(max(x, -MOST), MOST)) for x in columns[2]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(score, pa.decimal128(38, 0))], names=["query_id", "id", "score"])

    from pyspark.sql import Window

    best = met.mapInArrow(score, "query_id long, id long, score decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    shown = F.greatest(F.least(F.col("score"), F.lit((1 << 63) - 1)), F.lit(-(1 << 63))).cast("long")
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), shown.alias("score"))


def op10_topk(spark, sf_dir: str) -> DataFrame:
    return search(tables.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
