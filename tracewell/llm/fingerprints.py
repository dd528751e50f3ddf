"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases whose ends depend on their surroundings alone: runs of one symbol become one symbol,
deterministic coin tossing (the lowest bit in which a symbol differs from the one before, and its value) turns symbols into
a few labels in a few rounds, and a phrase begins at each local maximum of the labels. The phrases, named by their content,
are the symbols of the next level. Equal substrings so share all interior phrases on every level, wherever they stand.

The fingerprint keeps, for phrases of the levels LONG, SHORT and TINY, the smallest hash of each of BINS ranges
(one-permutation min-hash), 16 bits of each in hex: sketches whose agreement estimates how alike two sets of phrases are. A
sketch of tiny phrases is kept for texts alone whose short phrases fill fewer than SOME ranges. Likeness is that of the long
phrases; where both texts have fewer than FEW of these, that of all sketches that both texts have.

Defined results: null counts as empty; an empty text has empty sketches, is like another empty text (1) and unlike any other
(0). Equal texts have equal fingerprints and likeness 1. Repeated rows each get a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels as K
from tracewell.llm import tables

BINS = 64
LEVELS = 6
TINY, SHORT, LONG = 1, 2, 3  # levels
FEW = 8
SOME = 32
EMPTY = 0xFFFF
_SALT = np.random.default_rng(99).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = K.mix(np.arange(1, 257, dtype=np.uint64))
_LOW = np.array([x & -x for x in range(256)], np.uint8)
_LOG = np.array([max(0, (x & -x).bit_length() - 1) for x in range(256)], np.uint8)


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One coin toss: 2 * the lowest bit in which a symbol differs from the one before it, plus that bit's value."""
    one = symbols.dtype.type(1)
    x = np.empty_like(symbols)
    x[1:] = symbols[1:] ^ symbols[:-1]
    x[first] = one  # a text's first symbol differs from the one before in the lowest bit
    if symbols.dtype == np.uint8:
        return (_LOG[x] << np.uint8(1)) | ((symbols & _LOW[x]) != 0)
    low = x & (~x + one)
    at = np.frexp(low.astype(np.float64))[1].astype(np.uint8) - np.uint8(1)  # exact: low is a power of two
    return (at << np.uint8(1)) | ((symbols & low) != 0)


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """8 labels for symbols that differ from their neighbours; neighbours keep differing. first: starts of texts."""
    for _ in range(2 if symbols.dtype == np.uint8 else 3):  # 128 labels of long names, then 16, then 8
        symbols = _toss(symbols, first)
    return symbols


def parse(data: np.ndarray, offsets: np.ndarray, levels: int = LEVELS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level: the names of all phrases and, for each text, the bounds of its own."""
    names, bounds = data, np.asarray(offsets, np.int64)
    out = []
    for level in range(levels):
        if not len(names):
            out.append((names, bounds))
            continue
        start = np.zeros(len(names), bool)
        first = np.unique(bounds[:-1][np.diff(bounds) > 0])
        start[1:] = names[1:] != names[:-1]
        start[first] = True
        at = np.flatnonzero(start)  # runs become one symbol, named by the symbol and their length
        length = np.diff(np.append(at, len(names)))
        symbols = names[at]
        names = _BYTES[symbols] if level == 0 else symbols
        runs = np.flatnonzero(length > 1)
        names[runs] = K.mix(names[runs] ^ (length[runs].astype(np.uint64) * _SALT[8]))
        bounds = np.searchsorted(at, bounds)
        first = np.unique(bounds[:-1][np.diff(bounds) > 0])
        label = _labels(symbols if level == 0 else names, first)
        lead = np.zeros(len(names), bool)
        if len(names) > 2:
            lead[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        inner = first[first > 0]
        lead[inner - 1] = False  # the last symbol of a text leads no phrase: no maximum without both neighbours
        after = first + 1
        after = after[after < len(names)]
        lead[after] = False  # nor does the second, whose neighbour has no left surroundings
        lead[first] = True
        at = np.flatnonzero(lead)
        size = np.diff(np.append(at, len(names)))
        place = np.arange(len(names)) - np.repeat(at, size)
        names = K.mix(np.add.reduceat(K.mix(names + place.astype(np.uint64) * _SALT[9]), at) ^ (size.astype(np.uint64) * _SALT[level]))
        bounds = np.searchsorted(at, bounds)
        out.append((names, bounds))
    return out


def _sketch(names: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, BINS) smallest 16-bit hash of each bin; EMPTY where a bin has none."""
    n = len(bounds) - 1
    h = K.mix(names ^ _SALT[10])
    owner = np.repeat(np.arange(n), np.diff(bounds))
    cell = owner * BINS + (h >> np.uint64(58)).astype(np.int64)
    value = (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
    smallest = np.full(n * BINS, 1 << 40)
    np.minimum.at(smallest, cell, value)
    spread = (K.mix(smallest.astype(np.uint64)) % np.uint64(EMPTY)).astype(np.int64)
    return np.where(smallest < 1 << 40, spread, EMPTY).reshape(n, BINS).astype(np.uint16)


class Sketches:
    """Of many texts: sketches of short, long and tiny phrases."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        levels = parse(data, offsets, LONG)
        self.short, self.long = _sketch(*levels[SHORT - 1]), _sketch(*levels[LONG - 1])
        self.tiny = np.full_like(self.short, EMPTY)
        bounds = levels[TINY - 1][1]
        for k in np.flatnonzero((self.short != EMPTY).sum(axis=1) < SOME):
            own = levels[TINY - 1][0][bounds[k] : bounds[k + 1]]
            self.tiny[k] = _sketch(own, np.array([0, len(own)]))[0]

    def at(self, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.short[k], self.long[k], self.tiny[k]

    def strings(self) -> list[str]:
        both = np.concatenate([self.short, self.long, self.tiny], axis=1).astype(">u2")
        return [row.tobytes().hex() for row in both]


def _agreement(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    some = (a != EMPTY) | (b != EMPTY)
    return ((a == b) & some).sum(axis=1), some.sum(axis=1)


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Of rows of (short, long, tiny) sketches: 0 to 1."""
    same, some = _agreement(a[1], b[1])
    few = ((a[1] != EMPTY).sum(axis=1) < FEW) & ((b[1] != EMPTY).sum(axis=1) < FEW)
    fine = few & (a[2] != EMPTY).any(axis=1) & (b[2] != EMPTY).any(axis=1)
    for k, use in ((0, few), (2, fine)):
        more = _agreement(a[k], b[k])
        same, some = same + np.where(use, more[0], 0), some + np.where(use, more[1], 0)
    return np.where(some > 0, same / np.maximum(some, 1), 1.0)


def compare(one: str, other: str) -> float:
    """Likeness of two fingerprint strings."""
    split = lambda s: tuple(np.frombuffer(bytes.fromhex(s), ">u2").astype(np.uint16).reshape(3, 1, BINS))
    return float(likeness(split(one), split(other))[0])


def fingerprint(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, fingerprint_as: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each whole text; no shuffle."""

    def kernel():
        def work(texts: pa.Array) -> list[pa.Array]:
            data, offsets = K.flat(texts)
            out: list[str] = []
            for i, j in K.chunks(offsets):
                out += Sketches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).strings()
            return [pa.array(out, pa.string())]

        return work

    return tables.add_columns(docs, text_col, [T.StructField(fingerprint_as, T.StringType())], kernel, keep)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 2048) -> DataFrame:
    """(part, id, text, role) dealt to ranges of ids, each sorted by descending id and followed by the row that comes next.

    Ranges end at ids that occur, found as quantiles of the id column alone. Each text is shuffled once; the rows with the
    largest id of a range go to the range above as well, and those with the largest of all to the last range, so every row
    but these copies (role 1) has its successor right behind it. Rows of equal ids are in order of their text's hash. A row
    without an id (role 2) has no place in the order: it is dealt by hash and has no successor.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    facts = ids.agg(F.count("*").alias("n"), F.max("id").alias("top")).first()
    parts = max(1, min(1 << 16, -(-facts["n"] // rows_per_range)))
    cuts: list[int] = []
    if parts > 1 and facts["top"] is not None:
        found = ids.filter(F.col("id").isNotNull()).agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], max(10_000, 8 * parts)).alias("cuts")).first()["cuts"]
        cuts = sorted(set(found) - {facts["top"]})
    parts = len(cuts) + 1
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = F.lit(0)
    if cuts:  # by halves: how many cuts are below the id
        table = F.array(*[F.lit(c) for c in cuts])
        pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

        def halve(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            return F.when(s["lo"] >= s["hi"], s).when(F.element_at(table, F.least(mid, F.lit(len(cuts) - 1)) + 1) < F.col("id"), pair(mid + 1, s["hi"])).otherwise(pair(s["lo"], mid))

        rounds = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
        own = F.aggregate(rounds, pair(F.lit(0), F.lit(len(cuts))), halve)["lo"]
    role = F.when(F.col("id").isNull(), F.lit(2)).otherwise(F.lit(0))
    here = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).otherwise(own)
    placed = body.select("id", "text", role.alias("role"), here.alias("part"))
    ghost = F.when(F.col("id").isin(cuts), F.col("part") + 1) if cuts else F.lit(None).cast("int")
    ghost = F.when(F.col("id") == F.lit(facts["top"]), F.lit(0)).otherwise(ghost)
    place = lambda part, role, last: F.struct(part.cast("int").alias("part"), role.cast("int").alias("role"), F.lit(last).alias("last"))
    both = F.when(ghost.isNotNull(), F.array(place(F.col("part"), F.col("role"), 0), place(ghost, F.lit(1), 1))).otherwise(F.array(place(F.col("part"), F.col("role"), 0)))
    dealt = placed.select("id", "text", F.explode(both).alias("p")).select("id", "text", "p.part", "p.role", "p.last")
    return dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", (F.col("role") == 2), "last", F.col("id").desc(), F.xxhash64("text")).select("part", "id", "text", "role")


def spliced(text: str, after: str) -> str:
    """text with its last half (rounded down) replaced by as much of the start of after."""
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: int = 1 << 20) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): every text against its splice
    with the next one in descending order of ids (after the last: the first), and against that next one."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        waiting: list[tuple] = []
        size = 0

        def flush(last: bool):
            """All waiting rows whose successor is known; the last one is kept back unless nothing follows."""
            nonlocal waiting, size
            texts = [w[2] for w in waiting]
            own = Sketches(*K.flat(pa.array(texts, pa.large_string())))
            n = len(waiting) - (0 if last else 1)
            rows = [k for k in range(n) if waiting[k][3] != 1]
            after = [k + 1 if waiting[k][3] == 0 and k + 1 < len(waiting) and waiting[k + 1][0] == waiting[k][0] and waiting[k + 1][3] != 2 else -1 for k in rows]
            new = [spliced(texts[k], texts[a] if a >= 0 else "") for k, a in zip(rows, after, strict=True)]
            other = Sketches(*K.flat(pa.array(new, pa.large_string())))
            mine, theirs = np.array(rows, int), np.array(after, int)
            near_edited = likeness(own.at(mine), other.at(slice(None)))
            near_next = np.where(theirs >= 0, likeness(own.at(mine), own.at(theirs)), 0.0)
            strings = own.strings()
            columns = [
                pa.array([waiting[k][1] for k in rows], pa.int64()), pa.array([len(texts[k]) for k in rows], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()), pa.array([strings[k] for k in rows], pa.string()),
                pa.array(other.strings(), pa.string()), pa.array(near_edited, pa.float64()), pa.array(near_next, pa.float64()),
            ]
            waiting = [] if last else waiting[-1:]
            size = sum(len(w[2]) for w in waiting)
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append(row)
                size += len(row[2])
                if size >= step and len(waiting) > 1:
                    yield flush(False)
        if waiting:
            yield flush(True)

    return with_next(docs, id_col, text_col).mapInArrow(run, schema)


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
