"""Queries over access paths: bodies whose flows are told, one for each customer, and writes made from order lines, whose twin
goes back from every read, write by write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.extract import heap as read
from tracewell.plans.catalog import register
from tracewell.plans.corpus import customers, values
from tracewell.session import share_code
from tracewell.sources.issues import table
from tracewell.taint import heap

#: Bodies of a function of req and res, and what reaches db.query in them: origin, whether sanitized, by what, and which argument.
BODIES = (
    ("const a = {}; const b = a; a.x = req.query.q; db.query(b.x);", "req-query", False, "", 0),
    ("const a = {}; const b = a; b.x = req.query.q; db.query(a.x);", "req-query", False, "", 0),
    ("const a = {}; const b = a; a.x = req.query.q; db.query(b.y);", None, None, None, None),
    ("let a = {}; const b = a; a = {}; a.x = req.query.q; db.query(b.x);", None, None, None, None),
    ("const o = {}; o.x = req.query.q; o.y = 'fixed'; db.query(o.y);", None, None, None, None),
    ("const o = req.body; o.x = escape(o.x); db.query(o.x);", "req-body", True, "html-escape", 0),
    ("const o = req.body; o.x = escape(o.x); db.query(o.y);", "req-body", False, "", 0),
    ("const { a, b: { c } } = req.body; db.query('select', c);", "req-body", False, "", 1),
    ("const { a, ...rest } = req.body; a.x = 1; db.query(rest.y);", "req-body", False, "", 0),
    ("let x = req.query.q; if (go) { x = escape(x); } db.query(x);", "req-query", False, "", 0),
    ("let x = req.query.q; if (go) { x = escape(x); } else { x = escape(x); } db.query(x);", "req-query", True, "html-escape", 0),
    ("let x = req.query.q; if (go) { x = escape(x); } else { x = parseInt(x); } db.query(x);", "req-query", True, "", 0),
    ("const a = { x: req.query.q }; const o = { ...a }; db.query(o.x);", "req-query", False, "", 0),
    ("const a = { x: req.query.q }; const o = { ...a, x: 'safe' }; db.query(o.x);", None, None, None, None),
    ("const l = []; l.push(req.query.q); for (const i of l) { db.query(i); }", "req-query", False, "", 0),
    ("const m = new Map(); m.set('k', req.query.q); db.query(m.get('k'));", "req-query", False, "", 0),
    ("const m = new Map(); m.set('k', req.query.q); db.query(m.get('j'));", None, None, None, None),
    ("const m = new Map(); m.set(key, req.query.q); db.query(m.get('j'));", "req-query", False, "", 0),
    ("let n = req.body; while (n) { n = n.next; } db.query(n.v);", "req-body", False, "", 0),
    ("const o = {}; o.x = req.query.q; db.query(o);", None, None, None, None),
    ("const o = req.body; if (!validate(o)) { return; } db.query(o.x);", None, None, None, None),
    ("const o = {}; set(o); const p = { inner: o }; o.x = req.query.q; db.query(p.inner.x);", "req-query", False, "", 0),
    ("let x = 'a'; x = x + req.query.q; x = x + 'b'; db.query(x);", "req-query", False, "", 0),
)


def files(spark, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey")
    body = F.element_at(F.array(*[F.lit(b) for b, *_ in BODIES]), (n % len(BODIES) + 1).cast("int"))
    return customers(spark, sf_dir).select(F.concat(F.lit("src/heap/h"), n.cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("export function f"), n.cast("string"), F.lit("(req, res) {\n  "), body, F.lit("\n}\n")).alias("content"))


@register("q87_heap_flows", f"""SELECT 'src/heap/h' || c_custkey || '.ts' AS path, origin, sanitized = 1 AS sanitized, kinds, arg
  FROM customer JOIN {values([(k, o, int(c), w, a) for k, (_, o, c, w, a) in enumerate(BODIES) if o], "k, origin, sanitized, kinds, arg")} ON c_custkey % {len(BODIES)} = k""")
def q87(spark, sf_dir):
    """Taint field by field: aliases, patterns, sanitized children, branches that meet, spreads, elements."""
    share_code(spark)
    return heap.tainted(read.extract(files(spark, sf_dir))).select("path", "origin", "sanitized", F.array_join("sanitizations", ",").alias("kinds"), "arg")


_READS = (("v0",), ("v1",), ("v0", "a"), ("v0", "b"), ("v1", "a"), ("v1", "b"))
_SOURCES = (("req", "query"), ("v0",), ("v1", "a"), ("v0", "b"), ("v1",))
_END = 1_000_000


def _line_heap(spark, sf_dir: str) -> DataFrame:
    """Two orders are a function and each line is a block of one write; some lines may skip the next one. What is read in the end
    stands beside the first line. Lines are sent once; all rows of a function are made where its lines are."""
    texts = lambda parts: F.array(*[F.lit(x) for x in parts])
    lines = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 2).cast("string").alias("fn"), F.struct("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q")).alias("l"))
    lines = lines.groupBy("fn").agg(F.array_sort(F.collect_set("l")).alias("all")).select("fn", F.size("all").alias("n"), F.posexplode("all").alias("k", "l")).select("fn", "n", (F.col("k") + 1).alias("block"), "l.*")
    op = F.col("p") % 5
    target = F.concat(F.array(F.concat(F.lit("v"), (F.col("s") % 2).cast("string"))), F.when(F.col("q") % 3 == 1, texts(["a"])).when(F.col("q") % 3 == 2, texts(["b"])).otherwise(F.array().cast("array<string>")))
    source = F.element_at(F.array(*[texts(x) for x in _SOURCES]), (F.floor(F.col("p") / 5) % 5 + 1).cast("int"))
    block, kinds = F.col("block"), {"to": "int", "label": "string", "line": "int", "ix": "int", "op": "string", "target": "array<string>", "source": "array<string>"}
    row = lambda kind, block, **more: F.struct(F.lit(kind).alias("kind"), block.cast("int").alias("block"), *[more.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])
    write = row("write", block, line=F.lit(1), ix=block, op=F.when(op == 0, "new").when(op == 3, "derive").otherwise("value"), label=F.when(op == 4, "escape"), target=target, source=F.when(op != 0, source))
    edge = lambda at, to: row("edge", at, to=to, label=F.lit("next"))
    end = F.lit(_END)
    skips = F.when((F.col("p") % 3 == 0) & (block + 2 <= F.col("n")), F.array(edge(block, block + 2)))
    first = F.when(block == 1, F.array(edge(F.lit(0), F.lit(1)), *[row("asked", end, ix=end, target=texts(x)) for x in _READS]))
    none = F.array().cast(f"array<struct<kind:string,block:int,{','.join(f'{k}:{t}' for k, t in kinds.items())}>>")
    told = F.concat(F.array(write, edge(block, F.when(block < F.col("n"), block + 1).otherwise(end))), F.coalesce(skips, none), F.coalesce(first, none))
    return lines.select(F.lit("p").alias("path"), "fn", F.explode(told).alias("r")).select("path", "fn", "r.*")


_LIST = lambda parts: "[" + ", ".join(f"'{p}'" for p in parts) + "]"


@register("q88_heap_reads", f"""WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey // 2 AS fn, l_orderkey, l_linenumber, l_partkey AS p, l_suppkey AS s, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem),
  l AS (SELECT fn, row_number() OVER (PARTITION BY fn ORDER BY l_orderkey, l_linenumber, p, s, q) AS b, count(*) OVER (PARTITION BY fn) AS n, p % 5 AS op, p % 3 = 0 AS skips,
    ['v' || s % 2] || CASE q % 3 WHEN 1 THEN ['a'] WHEN 2 THEN ['b'] ELSE CAST([] AS VARCHAR[]) END AS t, [{', '.join(map(_LIST, _SOURCES))}][p // 5 % 5 + 1] AS s FROM d),
  e AS (SELECT *, CASE WHEN b < n THEN b + 1 ELSE {_END} END AS nxt FROM l UNION SELECT *, b + 2 FROM l WHERE skips AND b + 2 <= n),
  w AS (SELECT fn, r AS asked, CAST({_END} AS BIGINT) AS node, r AS p, false AS k FROM (SELECT DISTINCT fn FROM l), (SELECT unnest([{', '.join(map(_LIST, _READS))}]) AS r)
    UNION SELECT w.fn, asked, e.b, CASE WHEN take = 1 THEN (e.s || w.p[len(e.t) + 1:])[1:5] ELSE w.p END, k OR (take = 1 AND op = 4)
    FROM w JOIN e ON e.fn = w.fn AND e.nxt = w.node, (VALUES (0), (1)) c(take)
    WHERE CASE WHEN take = 1 THEN w.p[1:len(e.t)] = e.t AND op <> 0 ELSE op = 3 OR w.p[1:len(e.t)] <> e.t END)
  SELECT CAST(fn AS VARCHAR) AS fn, array_to_string(asked, '.') AS asked, bool_and(k) AS sanitized FROM w WHERE node = 1 AND p[1] = 'req' AND p[2] = 'query' GROUP BY 1, 2""")
def q88(spark, sf_dir):
    """Which of six paths may hold a request's query after all lines, and whether it is sanitized on every way."""
    share_code(spark)
    return heap.taint_of(_line_heap(spark, sf_dir)).select("fn", F.array_join("p", ".").alias("asked"), "sanitized")
