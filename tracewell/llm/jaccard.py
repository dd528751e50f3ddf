"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures and exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct shingles of WORDS words. Two sets link when their Jaccard
similarity reaches 0.8, that is 9 * common >= 4 * (n + m), or 9 * different <= n + m.

1. One pass over the texts makes, for each document, the size and the hash of its set; for the first of equal sets in a
   task also a signature of about n bits, each the parity of the members that hash to it, and the set's prefix: its
   n - ceil(0.8 n) + 1 first members in one global order. Linked sets share a prefix member in any global order; ours puts
   members last that many documents share, so passages that documents have in common are hardly ever looked up.
2. Sets that share a prefix member meet. A member with up to FEW sets gives their pairs; one with more, or known to be held by
   many documents, gives its list of sets, which is cut into size-banded tiles (sizes within one band or the next can link). The bits that differ in two
   signatures bound the different members from below, so their overlap from above; pairs beyond the bound go. A tile
   returns no pairs but a spanning forest of those that are left.
3. What the forest connects is a family. The sets of a family are made again from their texts, each sent once (in tiles
   again if a family is large), and compared exactly, signatures first; two sets that already are connected need no
   comparison. The forest of exact links is turned into classes by hash-min with pointer jumping.

No step lists the pairs of a group, none drops any, and nothing but the members that many documents share reaches the
driver (at most SHARED of them, as the order may be any; it decides on speed, not on results).

Defined results: null texts count as empty; an empty text has no set, no links and its own id as class. A row without an
id is in the class of its text, whose id is null if no row of the class has one. Rows that repeat an id or a text each get
a row; equal texts are linked. Sets are told apart by 64 bits: of 10**10 different sets about three pairs would be
mistaken for equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels as K
from tracewell.llm import tables

WORDS = 5
LANES = 8  # 64-bit words of the smallest signatures
FEW = 32
TILE = 4096
#: Shingles in a tile of whole sets: 32 MB.
TILE_MEMBERS = 4 << 20
SHARED = 1 << 17
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def sets(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    for i, j in K.chunks(offsets):
        part, here = K.FOLD[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends = K.words(part, here, ~K.BLANK[part])
        names = K.span_hashes(part, starts, ends)
        own = np.searchsorted(starts, here)
        n = len(names)
        rolled = np.zeros(max(0, n - width + 1), np.uint64)
        for k in range(width):
            rolled += K.mix(names[k : n - width + 1 + k] ^ _TURN[k]) if len(rolled) else rolled
        rolled = K.mix(rolled)
        for k in range(j - i):
            a, b = own[k], own[k + 1]
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for x in range(b - a):
                    whole = K.mix(whole ^ names[a + x : a + x + 1] * _TURN[x])
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def set_hash(members: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        both = np.bitwise_xor.reduce(K.mix(members ^ _TURN[3])) + np.add.reduce(K.mix(members ^ _TURN[4])) * _TURN[0] + np.uint64(len(members))
        return int(K.mix(np.array([both], np.uint64))[0].astype(np.int64))


def lanes(n: int) -> int:
    """64-bit words of the signature of n members: a power of two with at least n bits, so that unlike sets differ in enough."""
    return max(LANES, 1 << max(0, -(-n // 64) - 1).bit_length())


def signature(members: np.ndarray) -> np.ndarray:
    """Words of bits, each the parity of the members that hash to it."""
    size = 64 * lanes(len(members))
    odd = np.bincount((members >> np.uint64(32)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(sign: np.ndarray) -> np.ndarray:
    """The signature of half as many words, along the last axis."""
    half = sign.shape[-1] // 2
    return sign[..., :half] ^ sign[..., half:]


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


class Order:
    """The global order of members: those that many documents share last, by how many do; else by hash."""

    def __init__(self, shared: np.ndarray):
        """shared: hashes, ascending by the number of documents."""
        self.sorted = np.sort(shared)
        self.rank = np.argsort(shared, kind="stable")
        self.gate = np.zeros(1 << 22, bool)
        self.gate[(shared >> np.uint64(42)).astype(np.int64)] = True

    def prefix(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prefix of a set: its members that few documents hold, and those that many do."""
        size, none = prefix_size(len(members)), members[:0]
        if not len(self.sorted):
            return members[:size], none
        maybe = np.flatnonzero(self.gate[(members >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, members[maybe]), len(self.sorted) - 1)
        hit = self.sorted[at] == members[maybe]
        if not hit.any():
            return members[:size], none
        late, rank = maybe[hit], self.rank[at[hit]]
        early = np.ones(len(members), bool)
        early[late] = False
        first = members[early][:size]
        if len(first) == size:
            return first, none
        return first, members[late[np.argsort(rank, kind="stable")]][: size - len(first)]


def repeated(every: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The members that occur `least` times or more, and how often. Sorts in place: nothing but bits is made for each of the others."""
    every.sort()
    first = every[: max(0, len(every) - least + 1)] == every[least - 1 :]
    first[1:] &= every[1 : len(first)] != every[: max(0, len(first) - 1)]
    member = every[: len(first)][first]
    return member, np.searchsorted(every, member, "right") - np.flatnonzero(first)


def shared_members(docs: DataFrame, text_col: str, local: int = 4, least: int = 2 * FEW) -> np.ndarray:
    """Hashes of members that at least about `least` different sets hold, ascending by how many; at most SHARED.

    Tasks report members that they meet `local` times in a batch, so one that is rare in every batch is left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found = []
            for members in sets(*K.flat(batch.column(0))):
                if len(members) and (name := set_hash(members)) not in seen:
                    seen.add(name)
                    found.append(members)
            if len(seen) > 1 << 20:
                seen.clear()
            if found:
                every = np.concatenate(found)
                found.clear()  # the batch's members are held once
                member, count = repeated(every, local)
                yield pa.RecordBatch.from_arrays([pa.array(member.view(np.int64)), pa.array(count)], names=["member", "n"])

    local_counts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "member long, n long")
    counts = tables.cut(local_counts.groupBy("member").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    steps = counts.groupBy(F.floor(4 * F.log2("n")).alias("step")).count().collect()  # at most a few hundred
    kept, lowest = 0, None
    for step, count in sorted(((r["step"], r["count"]) for r in steps), reverse=True):
        if kept + count > SHARED:
            break
        kept, lowest = kept + count, step
    if lowest is None:
        return np.zeros(0, np.uint64)
    got = counts.filter(F.floor(4 * F.log2("n")) >= lowest).toArrow()
    member, n = got.column("member").to_numpy(), got.column("n").to_numpy()
    return member[np.lexsort((member, n))].view(np.uint64)


def described(docs: DataFrame, shared: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, row, n, node, sign, prefix, common): node is the set's hash, row the hash of id and text; signature and prefix (the
    members that few and that many documents hold) only for the first of equal sets in a task."""
    order = docs.sparkSession.sparkContext.broadcast(shared)

    def kernel():
        ranks, seen = Order(order.value), set()

        def work(texts: pa.Array) -> list[pa.Array]:
            n, node, sign, prefix, common = [], [], [], [], []
            for members in sets(*K.flat(texts)):
                n.append(len(members))
                name = set_hash(members) if len(members) else None
                node.append(name)
                if name is None or name in seen:
                    sign.append(None)
                    prefix.append(None)
                    common.append(None)
                else:
                    seen.add(name)
                    few, many = ranks.prefix(members)
                    sign.append(signature(members))
                    prefix.append(few.view(np.int64))
                    common.append(many.view(np.int64))
            if len(seen) > 1 << 20:
                seen.clear()
            return [pa.array(n, pa.int64()), pa.array(node, pa.int64())] + [pa.array(x, pa.list_(pa.int64())) for x in (sign, prefix, common)]

        return work

    numbers = T.ArrayType(T.LongType())
    fields = [T.StructField("n", T.LongType()), T.StructField("node", T.LongType()), T.StructField("sign", numbers), T.StructField("prefix", numbers), T.StructField("common", numbers)]
    return tables.add_columns(docs.select(F.col(id_col).alias("id"), "row", F.col(text_col).alias("body")), "body", fields, kernel, keep=["id", "row"])


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Of rows sorted by their first `keys` long columns: columns of many whole groups at once, and the groups' bounds.

    The rows of the last group wait for the next batch.
    """
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        edge = _edges(table, keys)
        if len(edge) > 1:
            yield table.slice(0, edge[-1]), edge
        rest = table.slice(edge[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _edges(table: pa.Table, keys: int) -> np.ndarray:
    """Starts of the groups."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in range(keys):
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, n) sorted by key and node to (kind, a, b, n): 0 a pair of nodes, 1 a node b on the long list of key a."""
    names = ["kind", "a", "b", "n"]
    for table, edge in runs(batches, 1):
        key, node, n = (table.column(k).to_numpy() for k in range(3))
        bounds = edge if edge[-1] == len(key) else np.append(edge, len(key))
        lone = np.diff(bounds) == 1
        kind, out_a, out_b, out_n = [], [], [], []
        pairs: list[np.ndarray] = []
        for g in np.flatnonzero(~lone):
            a, b = bounds[g], bounds[g + 1]
            own, first = np.unique(node[a:b], return_index=True)
            if len(own) < 2:
                continue
            size = n[a:b][first]
            if len(own) > FEW:
                kind.append(np.ones(len(own), np.int64))
                out_a.append(np.full(len(own), key[a]))
                out_b.append(own)
                out_n.append(size)
            else:
                i, j = np.triu_indices(len(own), 1)
                fit = (5 * size[i] >= 4 * size[j]) & (5 * size[j] >= 4 * size[i])
                pairs.append(np.column_stack([own[i[fit]], own[j[fit]]]))
        if pairs:
            both = np.concatenate(pairs)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)])] if len(both) else both
            kind.append(np.zeros(len(both), np.int64))
            out_a.append(both[:, 0])
            out_b.append(both[:, 1])
            out_n.append(np.zeros(len(both), np.int64))
        if kind:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kind, out_a, out_b, out_n)], names=names)


def forest(node: np.ndarray, n: np.ndarray, signs: list[np.ndarray], same: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Edges that span what links among the nodes: every node is compared with those that nothing has reached yet.

    Links are pairs whose signatures allow 9 * different <= n + m, and that same() confirms if it is given. Signatures of
    one number of words lie in one matrix; those of sets that can link have as many words, or twice or half as many.
    """
    words = np.array([len(x) for x in signs])
    every = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
    whole = {w: np.stack([signs[i] for i in at]).view(np.uint64) for w, at in every.items()}
    halves = {w: folded(m) for w, m in whole.items() if w // 2 in every}
    place = np.zeros(len(node), np.int64)
    for at in every.values():
        place[at] = np.arange(len(at))
    free = np.ones(len(node), bool)
    out = []
    for root in range(len(node)):
        if not free[root]:
            continue
        free[root], queue = False, [root]
        while queue:
            u = queue.pop()
            w = int(words[u])
            own = whole[w][place[u]]
            for other, table, key in ((w, whole.get(w), own), (2 * w, halves.get(2 * w), own), (w // 2, whole.get(w // 2), folded(own))):
                if table is None:
                    continue
                at = every[other]
                m = n[at]
                at = at[free[at] & (5 * m >= 4 * n[u]) & (5 * n[u] >= 4 * m)]
                if not len(at):
                    continue
                differ = np.bitwise_count(table[place[at]] ^ key).sum(axis=1, dtype=np.int64)
                near = at[9 * differ <= n[u] + n[at]]
                if same is not None:
                    near = np.array([v for v in near if same(u, v)], at.dtype)
                out += [(int(node[u]), int(node[v])) for v in near]
                queue += near.tolist()
                free[near] = False
    return out


def tiles(rows: DataFrame, weight, most: int, least: int) -> DataFrame:
    """rows (group, node, n, ...) with a column tile: groups of up to `least` in weight have one; the rows of larger groups go to
    each tile that pairs their part of their size band with a part of the same or the next band. Parts grow with their group,
    from half of `least` to half of `most`, so that middling groups are dealt to many tasks and large ones are not sent often."""
    rows = rows.withColumn("weight", weight)
    # one row for each group above `most`, so that rows meet it where they lie and no group's rows land in one task
    totals = tables.if_small(tables.cut(rows.groupBy("group").agg(F.sum("weight").alias("total")).filter(F.col("total") > least)))
    small = rows.join(totals, "group", "left_anti").withColumn("tile", F.lit(0).cast("long"))
    large = rows.join(totals, "group").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(1.25)))
    part_size = F.greatest(F.lit(least / 2), F.least(F.lit(most / 2), F.first("total") / 16))
    bands = tables.cut(large.groupBy("group", "band").agg(F.ceil(F.sum("weight") / part_size).cast("long").alias("parts")))
    few = bands.count() <= 1 << 20
    side = lambda shift, name: (F.broadcast if few else lambda x: x)(bands.select("group", (F.col("band") + shift).alias("band"), F.col("parts").alias(name)))
    large = large.join(side(0, "parts"), ["group", "band"]).join(side(-1, "above"), ["group", "band"], "left").join(side(1, "below"), ["group", "band"], "left")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    code = lambda low, a, b: F.xxhash64(low, a, b)  # noqa: E731  a tile's name: its lower band, the part there, and the part in it or above
    span = lambda n: F.when(n.isNull(), F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("long"), n - 1))
    own = F.transform(span(F.col("parts")), lambda p: code(F.col("band"), F.least(p, part), F.greatest(p, part)))
    up = F.transform(span(F.col("above")), lambda p: code(F.col("band"), part, p + (1 << 32)))
    down = F.transform(span(F.col("below")), lambda p: code(F.col("band") - 1, p, part + (1 << 32)))
    large = large.withColumn("tile", F.explode(F.concat(own, up, down)))
    keep = [c for c in rows.columns if c != "weight"] + ["tile"]
    return small.select(*keep).unionByName(large.select(*keep))


def _signature_forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, tile, node, n, sign) sorted by group and tile to the edges of each tile's forest."""
    for table, edge in runs(batches, 2):
        node, n = table.column(2).to_numpy(), table.column(3).to_numpy()
        bounds = edge if edge[-1] == table.num_rows else np.append(edge, table.num_rows)
        sign = table.column(4).combine_chunks()
        words, at = sign.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sign.value_lengths().to_numpy())])
        out: list[tuple[int, int]] = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            out += forest(node[a:b], n[a:b], [words[at[k] : at[k + 1]] for k in range(a, b)])
        yield _edge_batch(out)


def _edge_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    out = list({(min(e), max(e)) for e in out})
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in out], pa.int64()), pa.array([e[1] for e in out], pa.int64())], names=["a", "b"])


def _exact_forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, tile, text) sorted by group and tile to the edges of exact links among each tile's sets."""
    for table, edge in runs(batches, 2):
        bounds = edge if edge[-1] == table.num_rows else np.append(edge, table.num_rows)
        texts = table.column(2).combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        every = sets(*K.flat(texts))
        out: list[tuple[int, int]] = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = list({set_hash(m): m for m in (next(every) for _ in range(b - a)) if len(m)}.items())
            if len(own) < 2:
                continue
            members = [m for _, m in own]
            n = np.array([len(m) for m in members])

            def same(u: int, v: int, members=members) -> bool:
                x, y = (members[u], members[v]) if len(members[u]) <= len(members[v]) else (members[v], members[u])
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                return 9 * int((y[at] == x).sum()) >= 4 * (len(x) + len(y))

            out += forest(np.array([k for k, _ in own], np.int64), n, [signature(m) for m in members], same)
        yield _edge_batch(out)


def _united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) to (node, label), by union-find."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = sorted(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "label"])


def components(edges: DataFrame, small: int = 1 << 20) -> DataFrame:
    """(node, label): the smallest node that each node of edges(a, b) is connected with.

    Up to `small` edges, as counted (16 MB), one task unites them. More take hash-min with pointer jumping: every round takes
    the smallest label among neighbours and then the label's own label, so the number of rounds grows with the logarithm of
    the longest path. Each round is checkpointed.
    """
    edges = tables.cut(edges.select("a", "b").distinct())
    if edges.count() <= small:
        return tables.cut(edges.coalesce(1).mapInArrow(_united, "node long, label long"))
    both = tables.cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = tables.cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        moved = tables.cut(lower.join(jump, "low").select("node", "label", F.least("low", "far").alias("new")))
        changed = moved.filter(F.col("new") < F.col("label")).limit(1).count()
        labels = moved.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _by_group(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): every row of docs with the size of its set and the smallest id of its class."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("id", "text"))
    shared = shared_members(docs, "text")
    about = tables.cut(described(docs, shared, "id", "text"))
    first = about.filter(F.col("prefix").isNotNull())
    keyed = first.select(F.explode("prefix").alias("key"), "node", "n")
    met = tables.cut(keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meet, "kind long, a long, b long, n long"))
    # a member that many documents hold makes a list wherever its rows lie: no task gets all of them
    common = first.select(F.explode("common").alias("group"), "node", "n").distinct()

    # equal sets of several tasks have equal signatures; any will do
    signs = first.groupBy("node").agg(F.min("n").alias("n"), F.min("sign").alias("sign"))
    left = signs.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sign").alias("sa"))
    right = signs.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sign").alias("sb"))
    least = F.least(F.size("sa"), F.size("sb"))
    fold = lambda x: F.when(F.size(x) > least, F.zip_with(F.slice(x, F.lit(1), least), F.slice(x, least + 1, least), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(x))
    differ = F.aggregate(F.zip_with(fold("sa"), fold("sb"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    pairs = met.filter("kind = 0").select("a", "b").distinct().join(left, "a").join(right, "b").filter(9 * differ <= F.col("na") + F.col("nb")).select("a", "b")
    lists = tables.cut(met.filter("kind = 1").select(F.col("a").alias("group"), F.col("b").alias("node"), "n").unionByName(common))
    tiled = tiles(lists, F.lit(1), TILE, TILE // 4).join(signs.drop("n"), "node").select("group", "tile", "node", "n", "sign")
    chained = _by_group(tiled, ["group", "tile"]).mapInArrow(_signature_forest, "a long, b long")
    families = components(pairs.unionByName(chained))

    # the text of any document that has a set of a family, with an id or without
    sized = about.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"), F.min("row").alias("row"), F.min("n").alias("n"))
    wanted = tables.cut(families.join(sized, "node").select(F.col("label").alias("group"), "node", "n", "row"))
    asked = tiles(wanted, F.col("n"), TILE_MEMBERS, TILE_MEMBERS // 16).select("row", "group", "tile")
    texts = docs.join(asked, "row").select("group", "tile", "row", F.coalesce("text", F.lit("")).alias("text"))
    if about.groupBy("row").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["group", "tile", "row"])  # repeated rows have one text
    sent = _by_group(texts.select("group", "tile", "text"), ["group", "tile"])
    linked = components(sent.mapInArrow(_exact_forest, "a long, b long"))

    lowest = sized.join(linked, "node", "left").select("node", "id", F.coalesce("label", "node").alias("label"))
    best = lowest.groupBy("label").agg(F.min("id").alias("component_id"))
    named = lowest.join(best, "label").select("node", "component_id")
    return about.select("id", "node", F.col("n").alias("n_shingles")).join(named, "node", "left").select("id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that another document of a smaller id stands for: one row of each class, all columns as they were.

    A row's key is its id (null: after all others) and its text's hash, so ids may be null or repeat with different texts.
    """
    key = F.struct(F.col(id_col).isNull().alias("absent"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"))
    keyed = docs.withColumn("__key", key)
    found = classes(keyed, "__key", text_col)
    keep = tables.cut(found.filter(F.col("id") == F.col("component_id")).groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("__rows")))
    kept = keyed.join(keep.select("__id"), F.col("__key") == F.col("__id"), "left_semi")
    if keep.filter("__rows > 1").limit(1).count():
        kept = kept.dropDuplicates(["__key"])
    return kept.drop("__key")


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


JACCARD_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM t
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM g),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.b AS component_id FROM g JOIN c ON g.doc_id = c.a
"""
