"""A Merkle manifest of a dataset: a tree of digests over each group's rows, one over the groups, and a proof for every row.

Rows are sorted by group and order over ranges of partitions. A count for each partition of its first and its last group (a group
that neither begins nor ends there lies in the partition whole) tells where a partition's rows stand in their groups. Every
task then builds the complete subtrees of its own rows. What stays are the ragged nodes at the borders of partitions, a few
for each level: they are shuffled by the coordinate of the ancestor they share some levels up, built that far, and so on to
the roots. The siblings that a partition lacks on the way from its borders to the roots are looked up by coordinate and sent to it;
there the proofs are put together.

A digest is the lowercase hex SHA-256 of its inputs' digests in a row. Every FAN consecutive nodes of a level make one of the next,
the last run may be shorter, and a tree of one node is that node. A proof has a word for each level, from the leaf up:
the node's position in its run, then the digests of the others of the run.

Defined results: groups are in bytewise order, null first; rows in ascending order, nulls first, and equal ones by digest; rows
that repeat are leaves each; a group of one row has its leaf for root; an empty table has no rows. Only the columns named are carried.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import tables

FAN = 3
#: Rows of a partition, about.
ROWS = 1 << 15
#: Levels that one shuffle of ragged nodes builds.
RISE = 6

_NODE, _NEED, _RUN = 0, 1, 2
_PASS = "kind int, part int, key string, total long, level int, ix long, hash string"


def digest(columns: Iterable[Column]) -> Column:
    """SHA-256 of the columns in a row: each `-` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _joined(digests: Iterable[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _grown(first: int, digests: list[str], total: int) -> list[tuple[int, list[str]]]:
    """For each level the first index and the digests of the nodes whose leaves are all here."""
    levels, n = [(first, digests)], total
    while n > 1:
        low, own = levels[-1]
        high = low + len(own)
        begin, end = -(-low // FAN), -(-high // FAN) if high == n else high // FAN
        made = [_joined(own[FAN * j - low : FAN * j - low + FAN]) for j in range(begin, end)]
        if not made:
            break
        levels.append((begin, made))
        n = -(-n // FAN)
    return levels


def _run_of(ix: int, n: int) -> range:
    """The nodes that have the same parent, on a level of n."""
    begin = ix // FAN * FAN
    return range(begin, min(begin + FAN, n))


def _width(total: int, level: int) -> int:
    for _ in range(level):
        total = -(-total // FAN)
    return total


def _ragged(levels: list[tuple[int, list[str]]], total: int) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes whose parent is not among levels; a whole tree's root is one of them."""
    for level, (low, own) in enumerate(levels):
        begin, made = levels[level + 1] if level + 1 < len(levels) else (0, [])
        inside = range(FAN * begin, FAN * (begin + len(made)))
        for ix, found in enumerate(own, low):
            if ix not in inside:
                yield level, ix, found


@dataclass
class Forest:
    """Rows in ranges of partitions (with __part, __at), and the nodes above the partitions."""

    rows: DataFrame
    parts: int
    spans: object
    nodes: DataFrame
    needs: DataFrame
    runs: DataFrame

    def roots(self) -> DataFrame:
        """(key, root) of each group."""
        top = F.col("ix") == 0
        return self.nodes.filter(top & F.col("is_root")).select("key", F.col("hash").alias("root"))


def _runs(batches: Iterable[pa.RecordBatch], spans: list[tuple[int, int, int]]) -> tuple[pa.Table | None, list[tuple[str, int, int, int, int]]]:
    """The partition's rows, and of each group there (key, from row, to row, index of its first leaf, leaves of the whole group)."""
    held = list(batches)
    if not held:
        return None, []
    table = pa.Table.from_batches(held)
    keys = table.column("__key").to_pylist()
    before, of_first, of_last = spans[table.column("__part")[0].as_py()]
    out, at = [], 0
    for key, same in itertools.groupby(keys):
        n = sum(1 for _ in same)
        total = of_first if at == 0 else of_last if at + n == len(keys) else n
        out.append((key, at, at + n, before if at == 0 else 0, total))
        at += n
    return table, out


def _counted(ranged: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """For each partition: leaves of its first group in partitions before, leaves of its first and of its last group anywhere.

    Collects one row for each partition.
    """
    here = ranged.groupBy("__part", "__key").agg(F.count("*").alias("n")).withColumn("name", F.sha2("__key", 256))
    ends = here.groupBy("__part").agg(F.min(F.struct("__key", "name", "n")).alias("a"), F.max(F.struct("__key", "name", "n")).alias("z"))
    rows = sorted(tuple(r) for r in ends.select("__part", "a.name", "a.n", "z.name", "z.n").collect())
    spans, last, upto = {}, None, 0
    for part, first, n, end, m in rows:
        before = upto if first == last else 0
        spans[part] = [before, before + n, before + n if first == end else m]
        last, upto = end, before + n if first == end else m
    following, total = None, 0
    for part, first, _, end, _ in reversed(rows):
        own = spans[part]
        if end == following:
            own[2] = total
            if first == end:
                own[1] = total
        following, total = first, own[1]
    return [tuple(spans.get(p, (0, 0, 0))) for p in range(parts)]


def build(rows: DataFrame, order: list[str], rows_per_part: int = ROWS) -> Forest:
    """The trees over rows, which have __key (string, not null: the group) and __leaf, ordered by the columns in order."""
    spark = rows.sparkSession
    flat = tables.cut(rows)
    parts = max(1, -(-flat.count() // rows_per_part))
    by = ["__key", *order, "__leaf", "__tie"]  # the tie parts equal rows, whose order makes no difference
    ranged = flat.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__tie")
    ranged = tables.cut(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    parts = ranged.rdd.getNumPartitions()
    spans = spark.sparkContext.broadcast(_counted(ranged, parts))

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, runs = _runs(batches, spans.value)
        out = []
        for key, a, z, first, total in runs:
            part, levels = table.column("__part")[0].as_py(), _grown(first, table.column("__leaf").slice(a, z - a).to_pylist(), total)
            needs = set()
            for level, ix, found in _ragged(levels, total):
                out.append((_NODE, part, key, total, level, ix, found))
                n = _width(total, level)
                while n > 1:
                    for other in _run_of(ix, n):
                        low, own = levels[level] if level < len(levels) else (0, [])
                        if other != ix and not low <= other < low + len(own):
                            needs.add((level, other))
                    level, ix, n = level + 1, ix // FAN, -(-n // FAN)
            out += [(_NEED, part, key, total, level, ix, None) for level, ix in sorted(needs)]
            out.append((_RUN, part, key, total, 0, 0, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    made = tables.cut(ranged.select("__part", "__key", "__leaf").mapInArrow(local, _PASS))
    nodes = made.filter(F.col("kind") == _NODE).select("key", "total", "level", "ix", "hash").withColumn("is_root", F.lit(False))
    most = nodes.agg(F.max("total")).first()[0] or 0
    single = (F.col("level") == _height(F.col("total"), most)).alias("is_root")
    nodes = tables.cut(nodes.withColumn("is_root", single))
    found = [nodes]
    waiting = nodes.filter(~F.col("is_root"))
    for top in range(RISE, _height_of(most) + RISE, RISE):
        if waiting.limit(1).count() == 0:
            break
        now = waiting.filter(F.col("level") < top)
        ancestor = F.floor(F.col("ix") / F.pow(F.lit(float(FAN)), F.lit(top) - F.col("level"))).cast("long")
        new = tables.cut(now.withColumn("ancestor", ancestor).groupBy("key", "ancestor").applyInArrow(_rise(top), "key string, total long, level int, ix long, hash string, is_root boolean"))
        found.append(new)
        waiting = tables.cut(waiting.filter(F.col("level") >= top).unionAll(new.filter((F.col("level") == top) & ~F.col("is_root"))))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return Forest(ranged, parts, spans, every, made.filter(F.col("kind") == _NEED).select("part", "key", "level", "ix"), made.filter(F.col("kind") == _RUN).select("part", "key"))


_NAMES = [f.split()[0] for f in _PASS.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]


def _height_of(total: int) -> int:
    level = 0
    while total > 1:
        total, level = -(-total // FAN), level + 1
    return level


def _height(total: Column, most: int) -> Column:
    """The level of the root of a tree of so many leaves, most at most."""
    out, n = F.lit(0), 1
    while n < most:
        out = out + F.when(total > n, 1).otherwise(0)
        n *= FAN
    return out


def _rise(top: int):
    """Builds what lies above the given nodes of one ancestor, up to the level top or the root."""

    def run(table: pa.Table) -> pa.Table:
        key, total = table.column("key")[0].as_py(), table.column("total")[0].as_py()
        have: dict[int, dict[int, str]] = {}
        for level, ix, found in zip(*(table.column(c).to_pylist() for c in ("level", "ix", "hash")), strict=True):
            have.setdefault(level, {})[ix] = found
        out = []
        for level in range(min(have), top):
            n = _width(total, level)
            if n == 1:
                break
            for parent in sorted({ix // FAN for ix in have.get(level, {})}):
                made = _joined(have[level][i] for i in _run_of(parent * FAN, n))
                have.setdefault(level + 1, {})[parent] = made
                out.append((level + 1, parent, made, -(-n // FAN) == 1))
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        return pa.table({
            "key": pa.array([key] * len(out), pa.string()), "total": pa.array([total] * len(out), pa.int64()), "level": pa.array(columns[0], pa.int32()),
            "ix": pa.array(columns[1], pa.int64()), "hash": pa.array(columns[2], pa.string()), "is_root": pa.array(columns[3], pa.bool_()),
        })

    return run


def prove(forest: Forest, above: DataFrame) -> DataFrame:
    """The rows without helper columns, with place and leaves (in the group, long), proof, subroot and root.

    above (key, proof, root) says how each group's root is proved further up.
    """
    nodes = forest.needs.join(forest.nodes.select("key", "level", "ix", "hash"), ["key", "level", "ix"])
    nothing = F.lit(None).cast("string")
    tops = forest.runs.join(above.select("key", "proof", "root").join(forest.roots().withColumnRenamed("root", "hash"), "key"), "key")
    notes = nodes.select(F.col("part").alias("__deal"), F.col("key").alias("__of"), F.col("level").alias("__level"), F.col("ix").alias("__ix"), F.col("hash").alias("__hash"), nothing.alias("__above"), nothing.alias("__root"))
    notes = notes.unionAll(tops.select("part", "key", F.lit(-1), F.lit(0).cast("long"), "hash", "proof", "root"))
    kept = [c for c in forest.rows.columns if not c.startswith("__")]
    new = [T.StructField("place", T.LongType()), T.StructField("leaves", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("proof", "subroot", "root"))]
    schema, spans = T.StructType([*(forest.rows.schema[c] for c in kept), *new]), forest.spans

    def work(batches: Iterable[pa.RecordBatch], told: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: dict[tuple[str, int, int], str] = {}
        tops: dict[str, tuple[str, str, str]] = {}
        for note in told:
            for key, level, ix, found, proof, root in zip(*(note.column(c).to_pylist() for c in ("__of", "__level", "__ix", "__hash", "__above", "__root")), strict=True):
                if level < 0:
                    tops[key] = found, proof, root
                else:
                    given[key, level, ix] = found
        table, runs = _runs(batches, spans.value)
        for key, a, z, first, total in runs:
            levels = _grown(first, table.column("__leaf").slice(a, z - a).to_pylist(), total)
            widths = [total]
            while widths[-1] > 1:
                widths.append(-(-widths[-1] // FAN))
            subroot, further, root = tops[key]
            known: dict[tuple[int, int], str] = {}

            def upwards(level: int, ix: int) -> str:
                if widths[level] == 1:
                    return further
                if level and (level, ix) in known:
                    return known[level, ix]
                low, own = levels[level] if level < len(levels) else (0, [])
                others = (own[i - low] if low <= i < low + len(own) else given[key, level, i] for i in _run_of(ix, widths[level]) if i != ix)
                found = f"{ix % FAN}{''.join(others)} {upwards(level + 1, ix // FAN)}"
                if level:
                    known[level, ix] = found
                return found

            for at in range(a, z, 2048):
                n = min(z, at + 2048) - at
                places = range(first + at - a, first + at - a + n)
                proofs = [upwards(0, ix).rstrip() for ix in places]
                own = [table.column(c).slice(at, n).combine_chunks() for c in kept]
                own = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own]
                yield pa.RecordBatch.from_arrays([*own, pa.array(places, pa.int64()), pa.array([total] * n, pa.int64()), pa.array(proofs, pa.string()), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string())], names=schema.names)

    held = forest.rows.select(*kept, "__key", "__leaf", "__part", "__at", F.col("__part").alias("__deal"))
    return tables.with_notes(held, notes, "__deal", forest.parts, work, schema, ["__at"])


def manifest(rows: DataFrame, leaf_col: str, group_col: str, order: list[str], keep: list[str], rows_per_part: int = ROWS) -> DataFrame:
    """The columns in keep of every row, with place and leaves in its group, proof, subroot and root."""
    name = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null is a group, the first
    shown = [F.col(c) for c in keep if c not in {"place", "leaves", "proof", "subroot", "root"} and not c.startswith("__")]
    docs = build(rows.select(*shown, name.alias("__key"), F.col(leaf_col).alias("__leaf"), *[F.col(c).alias(f"__by{k}") for k, c in enumerate(order)]), [f"__by{k}" for k in range(len(order))], rows_per_part)
    groups = docs.roots().select(F.col("key").alias("of"), F.lit("").alias("__key"), F.col("root").alias("__leaf"))
    tops = build(groups.withColumn("__by0", F.col("of")), ["__by0"], rows_per_part)
    whole = tops.roots().select("key", F.lit("").alias("proof"), "root")
    above = prove(tops, whole).select(F.col("of").alias("key"), "proof", "root")
    return prove(docs, above)


def siblings(proof: Column) -> Column:
    """The siblings' digests of a proof in a row."""
    return F.regexp_replace(proof, "(^| ).", "")


def folded(rows: DataFrame, leaf_col: str, proof_col: str, as_col: str) -> DataFrame:
    """rows with the root that a leaf and a proof give (null if one is null)."""
    kept = [c for c in rows.columns if c.lower() != as_col.lower()]
    shown = rows.select(*kept, F.col(leaf_col).alias("__from"), F.col(proof_col).alias("__by"))
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(as_col, T.StringType())])

    def fold(leaf: str | None, proof: str | None) -> str | None:
        if leaf is None or proof is None:
            return None
        for word in proof.split():
            place, others = 64 * int(word[0]), word[1:]
            leaf = sha256((others[:place] + leaf + others[place:]).encode()).hexdigest()
        return leaf

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tables.parts(batch):
                roots = [fold(a, b) for a, b in zip(part.column(len(kept)).to_pylist(), part.column(len(kept) + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(roots, pa.string())], names=schema.names)

    return shown.mapInArrow(run, schema)


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", digest(map(F.col, [*fields, "text"])).alias("leaf"), digest([*map(F.col, fields), tampered]).alias("tampered"))
    proved = manifest(leaves, "leaf", "source", ["doc_id"], ["doc_id", "leaf", "tampered"])
    checked = folded(proved.select("doc_id", "leaf", "tampered", "subroot", "root", "proof"), "tampered", "proof", "folded_root")
    return checked.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


MERKLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS fields, text,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, v: xor(xor(a, v) >> 1, CASE WHEN xor(a, v) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc
  FROM documents
), t AS (
  SELECT doc_id, source, sha256(array_to_string(fields, '') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed, fields FROM d
), leaves AS (
  SELECT doc_id, source, leaf, sha256(array_to_string(fields, '') || coalesce(strlen(changed) || ':' || changed, '-')) AS tampered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS ix, count(*) OVER (PARTITION BY source) AS n FROM t
), nodes AS (
  SELECT 0 AS level, source, ix, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT level + 1, source, ix // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY ix)) FROM nodes WHERE n > 1 GROUP BY level, source, ix // 3, n
), subroots AS (SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS ix, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, ix, n, subroot AS hash FROM subroots
  UNION ALL
  SELECT level + 1, ix // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY ix)) FROM upper WHERE n > 1 GROUP BY level, ix // 3, n
), up AS (
  SELECT l.doc_id, l.source, l.ix, x.level, coalesce(string_agg(s.hash, '' ORDER BY s.ix) FILTER (s.ix < x.ix), '') AS before, coalesce(string_agg(s.hash, '' ORDER BY s.ix) FILTER (s.ix > x.ix), '') AS after
  FROM leaves l JOIN nodes x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.ix = l.ix // CAST(pow(3, x.level) AS BIGINT)
  JOIN nodes s ON s.source IS NOT DISTINCT FROM x.source AND s.level = x.level AND s.ix // 3 = x.ix // 3 GROUP BY ALL
), further AS (
  SELECT g.source, 1000 + x.level AS level, coalesce(string_agg(s.hash, '' ORDER BY s.ix) FILTER (s.ix < x.ix), '') AS before, coalesce(string_agg(s.hash, '' ORDER BY s.ix) FILTER (s.ix > x.ix), '') AS after
  FROM subroots g JOIN upper x ON x.n > 1 AND x.ix = g.ix // CAST(pow(3, x.level) AS BIGINT) JOIN upper s ON s.level = x.level AND s.ix // 3 = x.ix // 3 GROUP BY g.source, x.level
), steps AS (
  SELECT source, ix, level, before, after FROM up
  UNION ALL
  SELECT l.source, l.ix, f.level, f.before, f.after FROM leaves l JOIN further f ON f.source IS NOT DISTINCT FROM l.source
), proofs AS (SELECT source, ix, string_agg(before || after, '' ORDER BY level) AS proof, list(before || '|' || after ORDER BY level) AS way FROM steps GROUP BY source, ix),
folded AS (
  SELECT l.doc_id, l.leaf, g.subroot, r.hash AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_concat([l.tampered], coalesce(p.way, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots g ON g.source IS NOT DISTINCT FROM l.source CROSS JOIN (SELECT hash FROM upper WHERE n = 1) r
  LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM l.source AND p.ix = l.ix
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
