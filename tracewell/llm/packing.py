"""Best-fit packing of tokenized documents into sequences by best-two-fit, planned on the histogram of lengths.

Texts are tokenized once, in Arrow batches. Documents longer than a sequence are cut into whole sequences and a first piece that
takes the rest. Which pieces share a sequence depends on their lengths alone, so the plan needs the number of pieces of every
length and nothing else: at most one number for each length up to the capacity, however many documents there are.

Best-two-fit works on that stock. A sequence is filled greedily from the longest length down; if a gap stays, its shortest
piece is given back when two unpacked ones fit the gap and its place more tightly, and the two go in instead. A filling is used
again as long as the stock holds all that it takes, which is what the same steps would give one sequence at a time; so there are
about as many fillings as lengths. Pieces are numbered within their length (a count for each partition and length, summed in
order of the partitions) and take the places that the plan has for their length in that order.

Defined results: a null text is empty and has the end id alone; rows that repeat, or have no id, are packed each by itself;
an empty table gives no pieces. Other columns pass through packed() unless they have the name of a new one.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels, tables

CAPACITY = 1024
END = 2

#: Bytes of text that are tokenized at once.
STEP = 1 << 22
#: What a byte surely is: 1 a blank, 2 a stop, 4 something shown, 8 a letter, 16 the second byte of a Latin letter, if 32 comes before.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] |= 1
_CLASS[list(b",.;:!?")] |= 2
_CLASS[0x21:0x7F] |= 4
_CLASS[[*range(65, 91), *range(97, 123)]] |= 8
_CLASS[0x80:0xC0] |= 16
_CLASS[0xC3] |= 32


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut so that the tokenizer's words stay whole, documents' ends included.

    No word of byte-level BPE has a blank behind something else, nor a letter before a stop; what is not surely a blank or a
    letter makes no cut. So the ids of the cut strings in a row are those of the text.
    """
    kind = _CLASS[data]
    at = np.flatnonzero(kind & 3)
    at = at[at > 0]
    own, last = kind[at], kind[at - 1]
    latin = (last & 16).astype(bool) & (kind[np.maximum(at - 2, 0)] & 32).astype(bool)
    at = at[np.where(own & 1, ((last & 4) > 0) | latin, (last & 8) > 0)]
    edges = np.zeros(len(data) + 1, bool)
    edges[at] = True
    edges[offsets] = True
    return np.flatnonzero(edges)


class Encoder:
    """A byte-level BPE tokenizer with a bounded memory of the strings that it has met."""

    def __init__(self, blob: bytes, remember: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer, self.remember = Tokenizer.from_buffer(blob), remember
        kind = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or type(kind).__name__ != "ByteLevel" or kind.add_prefix_space:
            raise ValueError("only byte-level BPE without a normalizer or a prefix space is supported")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.counts, self.store = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        self.stored = 0

    def _learn(self, new: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        n, total = len(self.known), int(counts.sum())
        while len(self.counts) < n + len(new):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        while len(self.store) < self.stored + total:
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.stored : self.stored + total] = np.fromiter((i for ids in got for i in ids), np.uint32, total)
        self.starts[n : n + len(new)] = self.stored + np.cumsum(counts) - counts
        self.counts[n : n + len(new)] = counts
        self.stored += total
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def _encode(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the strings between cuts, and the number of each."""
        if len(self.known) > self.remember or self.stored > 8 * self.remember:
            self._forget()
        body = np.ascontiguousarray(data[cuts[0] : cuts[-1]])
        strings = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer((cuts - cuts[0]).astype(np.int32)), pa.py_buffer(body)).dictionary_encode()
        shown = strings.dictionary.to_pylist()
        new = [s for s in shown if s not in self.known]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, shown), np.int64, len(shown))[strings.indices.to_numpy()]
        counts = self.counts[number]
        ends = np.cumsum(counts)
        ids = self.store[np.arange(ends[-1]) + np.repeat(self.starts[number] - (ends - counts), counts)]
        return ids, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts in a buffer of UTF-8, and the offsets of each text in them."""
        cuts = _cuts(data, offsets)
        ids, bounds, at = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for i, j in kernels.chunks(cuts, STEP):
            got, counts = self._encode(data, cuts[i : j + 1])
            ids.append(got)
            bounds.append(at + np.cumsum(counts))
            at += len(got)
        return np.concatenate(ids), np.concatenate(bounds)[np.searchsorted(cuts, offsets)]


_loaded: dict[int, Encoder] = {}


def _encoder(blob: bytes) -> Encoder:
    key = hash(blob)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(blob)
    return _loaded[key]


def cut_pieces(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: the columns in keep, piece int, start, length, ids_crc32 long and, if asked for, ids array<int>."""
    with open(tokenizer_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"}]

    def kernel():
        encoder = _encoder(shared.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            data, offsets = kernels.flat(texts)
            columns, counts = [[np.zeros(0, np.int64)] for _ in range(3)], [np.zeros(0, np.int64)]
            ids_of, sizes_of = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for i, j in kernels.chunks(offsets, STEP):
                ids, bounds = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ids = np.insert(ids, bounds[1:], end)
                bounds = bounds + np.arange(len(bounds))
                size = np.diff(bounds)
                number = -(-size // capacity)
                nth = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                first = np.repeat(size - (number - 1) * capacity, number)  # the length of each document's first piece
                start = np.where(nth > 0, first + (nth - 1) * capacity, 0)
                length = np.where(nth > 0, capacity, first)
                at = np.repeat(bounds[:-1], number) + start
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)), np.int64, len(at))
                for column, own in zip(columns, (start, length, crc), strict=True):
                    column.append(own)
                counts.append(number)
                if with_ids:
                    ids_of.append(ids)
                    sizes_of.append(length)
            lists = [pa.array(np.concatenate(c)) for c in columns]
            if with_ids:
                inner = np.concatenate([[0], np.cumsum(np.concatenate(sizes_of))]).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(inner), pa.array(np.concatenate(ids_of).astype(np.int32))))
            outer = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32))
            return [pa.ListArray.from_arrays(outer, pa.StructArray.from_arrays(lists, names=[f.name for f in fields]))]

        return work

    listed = tables.add_columns(docs.select(*kept, F.col(text_col).alias("__body")), "__body", [T.StructField("__pieces", T.ArrayType(T.StructType(fields)))], kernel, kept)
    return listed.select(*kept, F.posexplode("__pieces").alias("piece", "__piece")).select(*kept, "piece", "__piece.*")


def plan(stock: Sequence[int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Fillings (how often, lengths from the longest) by best-two-fit; stock[n] is the number of pieces of length n."""
    left = [int(k) for k in stock]
    here, out = [n for n, k in enumerate(left) if n and k], []
    while here:
        uses: dict[int, int] = {}
        gap, at = capacity, len(here)
        while gap and (at := bisect_right(here, gap, hi=at) - 1) >= 0:
            n = here[at]
            uses[n] = min(gap // n, left[n])
            gap -= n * uses[n]
        taken = dict(uses)
        if gap:
            shortest = min(uses)
            two = _two(left, taken, here, shortest, shortest + gap)
            if two:
                taken[shortest] -= 1
                for n in two:
                    taken[n] = taken.get(n, 0) + 1
                for n in set(two):
                    uses[n] = uses.get(n, 0) + two.count(n)  # before the shortest is back
        often = min(left[n] // k for n, k in uses.items())
        out.append((often, [n for n in sorted(taken, reverse=True) for _ in range(taken[n])]))
        for n, k in taken.items():
            left[n] -= often * k
            if k and not left[n]:
                del here[bisect_left(here, n)]
    return out


def _two(left: list[int], taken: dict[int, int], here: list[int], over: int, most: int) -> tuple[int, int] | None:
    """Of the unpacked pieces the two whose sum is largest, above over and at most most; the more even pair on ties."""
    free = lambda n: left[n] - taken.get(n, 0)
    middle = bisect_right(here, most // 2)
    low, best, pair = middle - 1, over, None
    while low >= 0 and not free(here[low]):
        low -= 1
    if low < 0:
        return None
    x, y = here[low], low
    if free(x) < 2:
        y -= 1
        while y >= 0 and not free(here[y]):
            y -= 1
    if y >= 0 and x + here[y] > best:
        best, pair = x + here[y], (x, here[y])
    for high in range(middle, len(here)):  # one of the two is longer than half, so the other shrinks as it grows
        x = here[high]
        if best == most or x >= most:
            break
        if free(x):
            while low >= 0 and (here[low] + x > most or not free(here[low])):
                low -= 1
            if low < 0:
                break
            if x + here[low] > best:
                best, pair = x + here[low], (x, here[low])
    return pair


def _places(fillings: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """For the pieces in order of length and number: where each run of places begins, its first sequence and its offset.

    firsts[n] is the place of the first piece of length n.
    """
    rows, base = [], 0
    for often, lengths in fillings:
        offset = 0
        for n in lengths:
            rows.append((n, base, offset, often))
            offset += n
        base += often
    rows.sort(key=lambda r: r[0])  # stable: fillings in their order
    length, sequence, offset, often = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([], [], [], [])))
    begins = np.cumsum(often) - often
    firsts = np.zeros(capacity + 2, np.int64)
    np.add.at(firsts, length + 1, often)
    return begins, sequence, offset, np.cumsum(firsts)


def packed(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id long and offset long; no sequence is longer than capacity. Lengths are 1 to capacity.

    pieces are written once in the shared folder, so that their numbers hold when a task is repeated.
    """
    kept = [c for c in pieces.columns if c.lower() not in {"sequence_id", "offset"}]
    rows = tables.cut(pieces.select(*kept).withColumn("__part", F.spark_partition_id()))
    parts = rows.rdd.getNumPartitions()
    counted = rows.groupBy("__part", F.col(length_col).cast("int").alias("__of")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__of").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counted = tables.cut(counted.withColumn("__before", F.coalesce(before, F.lit(0))))
    stock = np.zeros(capacity + 1, np.int64)
    for n, count in counted.groupBy("__of").agg(F.sum("__n")).collect():  # a number for each length
        if n is None or not 0 < n <= capacity:
            raise ValueError(f"a piece of length {n}; cut_pieces() gives lengths of 1 to {capacity}")
        stock[n] = count
    places = pieces.sparkSession.sparkContext.broadcast(_places(plan(stock, capacity), capacity))
    schema = T.StructType([*(pieces.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = kept.index(length_col)

    def place(batches: Iterable[pa.RecordBatch], notes: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, sequence, offset, firsts = places.value
        upto = np.zeros(capacity + 1, np.int64)
        for note in notes:
            upto[note.column("__of").to_numpy()] = note.column("__before").to_numpy()
        for batch in batches:
            length = batch.column(at).to_numpy().astype(np.int64)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            first = np.searchsorted(ranked, ranked)
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - first
            place = firsts[length] + upto[length] + nth
            np.add.at(upto, length, 1)
            run = np.searchsorted(begins, place, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence[run] + place - begins[run]), pa.array(offset[run])], names=schema.names)

    return tables.with_notes(rows, counted.select("__part", "__of", "__before"), "__part", parts, place, schema)


def sequences(pieces: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry their ids; a sequence holds at most its capacity."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", F.col(ids_col).alias("ids")))).alias("__of"))
    return rows.select("sequence_id", F.flatten(F.transform("__of", lambda p: p["ids"])).alias("ids"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return packed(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
