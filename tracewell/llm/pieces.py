"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut into words that no piece can span; all words of a batch that are not known yet lie in flat numpy arrays of
symbols, cut further into segments wherever no piece has the two characters in a row. Each round finds every segment's best
rank (a segmented minimum of pair ranks) and merges its places from the left, in all segments at once, then compacts, until no
pair remains. The library merges one place after the other, leftmost first, so a segment's places are merged together up to
the first whose new neighbours could be merged before the next one; the rest wait for the next round.

Defined results: a null text counts as empty; an empty text has the end id alone (if asked for) and decodes to "".
Repeated rows each get a row; other columns pass through, and one with the name of a new column gives way to it.
"""

from __future__ import annotations

import codecs
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import tables

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NONE = np.int64(1 << 30)

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


class Pieces:
    """A BPE model file, ready to encode and decode. Holds a bounded memory of words met before."""

    def __init__(self, model: bytes, remember: int = 300_000):
        self.names, self.scores, self.kinds = [], [], []
        prefix, squeeze, fallback, bpe = True, True, False, False
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.names.append(own.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                bpe, fallback = spec.get(3, 1) == 2, bool(spec.get(35, 0))
                self.unk_surface = spec.get(44, b" \xe2\x81\x87 ")
            elif number == 3:
                spec = dict(_fields(value))
                prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    raise ValueError("only models without a character map are supported")
        if not bpe or squeeze or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only BPE models that keep white space and have no user-defined or unused pieces are supported")
        self.prefix, self.fallback = prefix, fallback
        self.unknown = self.kinds.index(UNKNOWN)
        self.end = self.names.index("</s>")
        self.byte_ids = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == BYTE}
        self._pair_table()
        self._output_table()
        self.remember = remember
        self._forget()

    def _pair_table(self) -> None:
        normal = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)) if k == NORMAL}
        if any(SPACE in n.lstrip(SPACE) or ("\n" in n and len(n) > 1) for n in normal):
            raise ValueError("a piece spans words")
        self.normal, size = normal, len(self.names)
        #: Characters have their piece's number, or one beyond the pieces; so have those that are in no piece of their own.
        self.symbol = {n: i for n, i in normal.items() if len(n) == 1}
        for n in normal:
            for c in n:
                self.symbol.setdefault(c, size + len(self.symbol))
        self.stranger = size + len(self.symbol) + 1  # and up: characters that no piece has
        number = normal | self.symbol
        order = {s: r for r, s in enumerate(sorted({self.scores[i] for i in normal.values()}, reverse=True))}
        pairs = []
        for n, i in normal.items():
            for cut in range(1, len(n)):
                a, b = number.get(n[:cut]), number.get(n[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, order[self.scores[i]], i))
        pairs.sort()
        self.pair, self.rank, self.made = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ([], [], [])))
        #: Characters that stand in a row in some piece.
        self.inside = np.array(sorted({self.symbol[x] << 32 | self.symbol[y] for n in normal for x, y in zip(n, n[1:], strict=False)}), np.int64)
        self.pair = np.append(self.pair, np.iinfo(np.int64).max)
        self.rank = np.append(self.rank, _NONE)

    def _output_table(self) -> None:
        surface = []
        for n, k in zip(self.names, self.kinds, strict=True):
            surface.append(b"" if k == CONTROL else self.unk_surface if k == UNKNOWN else bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(SPACE, " ").encode())
        self.width = np.array([len(x) for x in surface], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.spaced = np.array([k == NORMAL and n.startswith(SPACE) for n, k in zip(self.names, self.kinds, strict=True)])

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.counts, self.store = [], [], []
        self.stored = 0

    # encoding

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair: its rank (_NONE if it does not merge) and its place in the table."""
        key = left << 32 | right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.rank[at], _NONE), at

    def _segments(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each symbol: its segment, numbered from 0; a new one begins with each word and where no piece can go on."""
        new = np.zeros(len(symbols), bool)
        new[np.cumsum(sizes)[:-1]] = True
        if len(symbols) > 1:
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.inside, key), max(0, len(self.inside) - 1))
            new[1:] |= (self.inside[at] != key) if len(self.inside) else True
        return np.cumsum(new)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of words of the given sizes (all over 0) to what is left of each: flat symbols and sizes."""
        sym, done_sym, done_seg = symbols.astype(np.int64), [], []
        if not len(sym):
            return sym, np.zeros(len(sizes), np.int64)
        seg = self._segments(sym, sizes)
        word_of = np.repeat(np.arange(len(sizes)), sizes)[np.flatnonzero(np.diff(seg, prepend=-1))]
        rank = np.full(len(sym), _NONE)
        rank[:-1] = np.where(seg[1:] == seg[:-1], self._ranks(sym[:-1], sym[1:])[0], _NONE)
        while True:
            first = np.flatnonzero(np.diff(seg, prepend=-1))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            ready = best == _NONE
            if ready.any():
                mask = np.repeat(ready, size)
                done_sym.append(sym[mask])
                done_seg.append(seg[mask])
                sym, seg, rank = sym[~mask], seg[~mask], rank[~mask]
                best, size = best[~ready], size[~ready]
            if not len(sym):
                break
            at = self._places(sym, seg, rank, np.repeat(best, size))
            sym[at] = self.made[np.searchsorted(self.pair, sym[at] << 32 | sym[at + 1])]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # each place before took one symbol away
            sym, seg, rank = sym[keep], seg[keep], rank[keep]
            for i in (at, at - 1):  # only pairs beside a merge have changed
                i = i[i >= 0]
                ok = np.zeros(len(i), bool)
                inner = i + 1 < len(sym)
                ok[inner] = seg[i[inner]] == seg[i[inner] + 1]
                rank[i] = _NONE
                i = i[ok]
                rank[i] = self._ranks(sym[i], sym[i + 1])[0]
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], np.bincount(word_of[seg], minlength=len(sizes))

    def _places(self, sym: np.ndarray, seg: np.ndarray, rank: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The places of this round: in each segment those of its best rank that do not overlap, from the left, up to the first
        after which a new neighbour of that rank or a better one stands."""
        at = np.flatnonzero(rank == best)
        nth = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) == 1, 0, nth))
        at = at[(nth - run) % 2 == 0]  # of places in a row, each takes its right neighbour away
        made = self.made[np.searchsorted(self.pair, sym[at] << 32 | sym[at + 1])]
        before = np.where(at > 0, sym[at - 1], -1)
        joined = np.flatnonzero(np.diff(at, prepend=-9) == 2)
        before[joined] = made[joined - 1]
        after = np.minimum(at + 2, len(sym) - 1)
        left = np.where((at > 0) & (seg[at - 1] == seg[at]), self._ranks(before, made)[0], _NONE)
        right = np.where((at + 2 < len(sym)) & (seg[after] == seg[at]), self._ranks(made, sym[after])[0], _NONE)
        stop = np.minimum(left, right) <= best[at]
        earlier = np.cumsum(stop) - stop
        own = np.diff(seg[at], prepend=-1) != 0
        base = np.maximum.accumulate(np.where(own, earlier, 0))
        return at[earlier == base]

    def _learn(self, new: list[str]) -> None:
        """Adds words to the memory."""
        strangers: dict[str, int] = {}
        get = self.symbol.get
        flat, sizes = [], []
        for w in new:
            flat += [get(c) if c in self.symbol else strangers.setdefault(c, self.stranger + len(strangers)) for c in w]
            sizes.append(len(w))
        sym, left = self.merge(np.array(flat, np.int64), np.array(sizes, np.int64))
        bounds = np.concatenate([[0], np.cumsum(left)])
        back = {v: c for c, v in strangers.items()} | {v: c for c, v in self.symbol.items() if v >= len(self.names)}
        odd = sym >= len(self.names)
        any_odd = np.zeros(len(new), bool)
        any_odd[np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1] = True
        for k, w in enumerate(new):
            own = sym[bounds[k] : bounds[k + 1]]
            if any_odd[k]:
                out: list[int] = []
                for s in own.tolist():
                    out += [s] if s < len(self.names) else [self.byte_ids[b] for b in back[s].encode()] if self.fallback else [self.unknown]
                own = np.array(out, np.int64)
            self.known[w] = len(self.counts)
            self.starts.append(self.stored)
            self.counts.append(len(own))
            self.store.append(own.astype(np.int32))
            self.stored += len(own)

    _cut = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")

    def encode(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the number of ids of each."""
        if len(self.known) > self.remember or self.stored > 8 * self.remember:
            self._forget()
        cut = [self._cut.findall((SPACE if self.prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        known = self.known
        new = list(dict.fromkeys(w for ws in cut for w in ws if w not in known))
        if new:
            self._learn(new)
            self.store = [np.concatenate(self.store)]
        words = np.fromiter((known[w] for ws in cut for w in ws), np.int64, sum(map(len, cut)))
        store = self.store[0] if self.store else np.zeros(0, np.int32)
        starts, counts = np.array(self.starts, np.int64), np.array(self.counts, np.int64)
        count = counts[words]
        place = np.concatenate([[0], np.cumsum(count)])
        ids = store[np.arange(place[-1]) + np.repeat(starts[words] - place[:-1], count)]
        bounds = place[np.concatenate([[0], np.cumsum([len(ws) for ws in cut])]).astype(np.int64)]
        sizes = np.diff(bounds)
        if end:
            ids = np.insert(ids, bounds[1:], self.end)
            sizes = sizes + 1
        return ids.astype(np.int32), sizes

    # decoding

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        ids = ids.astype(np.int64)
        width = self.width[ids]
        place = np.concatenate([[0], np.cumsum(width)])
        data = self.surface[np.arange(place[-1]) + np.repeat(self.at[ids] - place[:-1], width)].tobytes()
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        shown = np.append(np.flatnonzero(width > 0), len(ids))
        first = shown[np.searchsorted(shown, bounds[:-1])]
        out = []
        for k in range(len(sizes)):
            a, b = place[bounds[k]], place[bounds[k + 1]]
            if self.prefix and first[k] < bounds[k + 1] and self.spaced[ids[first[k]]]:
                a += 1  # the space that encoding puts in front
            out.append(data[a:b].decode("utf-8", "each_byte"))
        return out


_loaded: dict[int, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    key = hash(model)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, ids_as: str = "ids", decoded_as: str | None = None, end: bool = True, step: int = 1 << 20) -> DataFrame:
    """docs with the ids of each whole text and, if decoded_as is given, the text that they decode to; no shuffle.

    The model file (half a megabyte) is read on the driver and broadcast. About step characters are worked on at once.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField(ids_as, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_as, T.StringType())] if decoded_as else [])

    def kernel():
        model = _pieces(shared.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids, sizes, decoded, waiting, chars = [], [], [], [], 0

            def flush() -> None:
                got, size = model.encode(waiting, end)
                ids.append(got)
                sizes.append(size)
                if decoded_as:
                    decoded.extend(model.decode(got, size))

            for t in texts.to_pylist():
                waiting.append(t)
                chars += len(t)
                if chars >= step:
                    flush()
                    waiting, chars = [], 0
            if waiting:
                flush()
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, []]))]).astype(np.int32)
            out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32()))]
            return out + ([pa.array(decoded, pa.string())] if decoded_as else [])

        return work

    return tables.add_columns(docs, text_col, fields, kernel, keep)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_as: str = "decoded") -> DataFrame:
    """rows with the text of each array of ids (null: null). An id outside the model is an error, as in the library."""
    with open(model_path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in rows.columns if c.lower() != text_as.lower()]
    shown = rows.select(*kept, F.col(ids_col).cast("array<int>").alias("__ids"))
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(text_as, T.StringType())])

    def run(batches):
        model = _pieces(shared.value)
        for batch in batches:
            ids = batch.column(len(kept))
            null = ids.is_null().to_pylist()
            sizes = np.array([0 if x is None else x for x in ids.value_lengths().to_pylist()], np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            text = model.decode(flat, sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([None if n else t for n, t in zip(null, text, strict=True)], pa.string())], names=[f.name for f in schema])

    return shown.mapInArrow(run, schema)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], decoded_as="decoded")
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
