"""Phrase collocation mining with suffix arrays of word ids.

A shard is the text of some documents of one language in a task. Its words are numbered by a dictionary and lie in one array,
with a gap behind every piece. Suffixes are ranked by prefix doubling (1, 2, 4 words, then the depth that is asked for) and
sorted; neighbours that agree in n words or more form an LCP interval, whose size is the count of those n words in the shard.
The counts of all shards are added by language and phrase.

A phrase cannot be more frequent than its parts. So single words are counted first, then phrases all of whose pairs can be
frequent; what is rare is a gap in the shard's array. Which pairs can be is found by counting hashes of the pairs of frequent
words, which are sent as steps between ascending hashes, two or three bytes a pair. Frequent words and hashes reach the tasks
as a bitmap of at most 2**BITS bits: a false hit costs a count, not a result, and if there are so many that the bitmap fills
up, more is counted and nothing is lost.

Defined results: a null text is empty and a null language is `und`; documents that repeat count each time, with or without an
id; an empty table has no phrases.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm import kernels, tables

LEAST = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
#: Bytes of text in a shard, about.
SHARD = 1 << 24
#: The largest bitmap of frequent phrases: 32 MB.
BITS = 28

_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_STOP
_INSIDE[[0x20, 0x09]] = False
U64 = np.uint64


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word (null: 0)."""
    data, offsets = kernels.flat(words)
    out = np.zeros(len(words), np.uint64)
    for i, j in kernels.chunks(offsets):
        own = offsets[i : j + 1] - offsets[i]
        out[i:j] = kernels.span_hashes(data[offsets[i] : offsets[j]], own[:-1], own[1:])
    return out


def _phrase_hash(lang: np.uint64, words: Sequence[np.ndarray]) -> np.ndarray:
    found = lang
    for word in words:
        found = kernels.mix(found * U64(0x9E3779B97F4A7C15) + word)
    return found


class Sieve:
    """A set of hashes of phrases of so many words that may hold more than was put in, in a bitmap of bounded size."""

    def __init__(self, size: int, bits: int, cells: np.ndarray):
        self.size, self.bits, self.cells = size, bits, cells

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> U64(64 - self.bits)
        return (self.cells[(slot >> U64(5)).astype(np.int64)] >> (slot & U64(31)).astype(np.uint32)) & 1 == 1


def _sieve(hashes: DataFrame, size: int) -> Sieve:
    """A sieve of the hashes (long); the driver gets a number for each 32 bits that are not all 0, so at most the bitmap."""
    bits = min(BITS, max(16, int(hashes.count()).bit_length() + 5))
    slot = F.shiftrightunsigned("hash", 64 - bits)
    found = hashes.groupBy(F.shiftrightunsigned(slot, 5).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(hash, {64 - bits}) & 31 AS INT))")).alias("mask")).toArrow()
    cells = np.zeros(1 << (bits - 5), np.uint32)
    cells[found.column("cell").to_numpy()] = found.column("mask").to_numpy().astype(np.uint32)
    return Sieve(size, bits, cells)


def sieve(frequent: DataFrame) -> Sieve:
    """The words in the (lang, phrase) rows of frequent."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, word = (_hashes(batch.column(c).cast(pa.string())) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_phrase_hash(lang, [word]).view(np.int64))], names=["hash"])

    return _sieve(frequent.select("lang", "phrase").mapInArrow(hashed, "hash long"), 1)


def _tokens(texts: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a shard, the number of each word in a row, and whether a piece ends behind it."""
    words, ends = [], []
    for text in texts:
        data, offsets = kernels.flat(text)
        for i, j in kernels.chunks(offsets, 1 << 22):
            own, at = kernels.FOLD[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            inside = _INSIDE[own]
            starts, stops = kernels.words(own, at, inside)
            if not len(starts):
                continue
            # a piece ends where a stop or the document's end is before the next word
            breaks = np.zeros(len(own) + 1, np.int32)
            breaks[:-1] = _STOP[own]
            breaks[at] += 1
            upto = np.cumsum(breaks, dtype=np.int32)
            last = np.ones(len(starts), bool)
            last[:-1] = upto[starts[1:]] > upto[stops[:-1] - 1]
            bounds = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
            words.append(pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(own[inside])))
            ends.append(last)
    if not words:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, bool)
    coded = pa.chunked_array(words).dictionary_encode().unify_dictionaries()
    number = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
    return coded.chunk(coded.num_chunks - 1).dictionary, number, np.concatenate(ends)


def _room(last: np.ndarray) -> np.ndarray:
    """For each word how many words there are from it to the gap, itself included."""
    gaps = np.flatnonzero(last)
    at = np.arange(len(last))
    return gaps[np.searchsorted(gaps, at)] - at + 1


def _doubled(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (first, second)."""
    pair = first << 32 | second
    order = np.argsort(pair, kind="stable")
    ranked = pair[order]
    new = np.ones(len(ranked), np.int64)
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(ranked), np.int64)
    out[order] = np.cumsum(new)
    return out


def counts(number: np.ndarray, room: np.ndarray, depths: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each depth (1 to LONGEST) the places of a first occurrence of each n words, and how often they are there.

    number gives each word's id, room the words up to the next gap. Suffixes end at gaps and, here, after the largest depth.
    """
    deepest = max(depths)
    one = number + 1
    at = np.flatnonzero(room >= min(depths))
    if not len(at):
        return
    ranks = {1: one}

    def behind(rank: np.ndarray, step: int) -> np.ndarray:
        """The rank that lies step words on, or 0 where there is a gap between."""
        out = np.zeros(len(rank), np.int64)
        out[:-step] = rank[step:]
        out[room <= step] = 0
        return out

    width = 1
    while width * 2 <= deepest:
        ranks[width * 2] = _doubled(ranks[width], behind(ranks[width], width))
        width *= 2
    rest = deepest - width  # 0, 1 or more: the last ranks overlap the ones before
    rank = _doubled(ranks[width], behind(ranks[width], rest)) if rest else ranks[width]
    order = at[np.argsort(rank[at], kind="stable")]  # the suffix array, of suffixes with room enough
    # the longest common prefix of neighbours, from the ranks of 4, 2 and 1 words
    common = np.zeros(len(order), np.int64)
    here, there = order[1:].copy(), order[:-1].copy()
    left = np.minimum(room[here], room[there])
    for step in sorted(ranks, reverse=True):
        while True:
            ok = left >= step
            same = np.zeros(len(ok), bool)
            same[ok] = ranks[step][here[ok]] == ranks[step][there[ok]]
            same &= common[1:] + step <= deepest
            if not same.any():
                break
            common[1:][same] += step
            left = left - step * same
            here, there = np.minimum(here + step * same, len(number) - 1), np.minimum(there + step * same, len(number) - 1)
    for n in depths:
        enough = room[order] >= n
        starts = np.flatnonzero((common < n) & enough)
        # an interval goes on while neighbours agree in n words; what is shorter than n words is in none
        upto = np.concatenate([[0], np.cumsum(enough)])
        stops = np.append(starts[1:], len(order))
        yield n, order[starts], upto[stops] - upto[starts]


def _shards(docs: DataFrame, work, schema: str, text_col: str, lang_col: str, shard: int) -> DataFrame:
    """work(the (language, texts) of a shard) gives its batches; a shard is some shard bytes of a task's texts."""
    shown = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size = 0
        for batch in batches:
            for part in tables.parts(batch):
                langs = part.column(0).dictionary_encode()
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    held.setdefault(lang, []).append(part.column(1).filter(pc.equal(langs.indices, k)))
                size += part.column(1).nbytes
                if size >= shard:
                    yield from work(held)
                    held, size = {}, 0
        if held:
            yield from work(held)

    return shown.mapInArrow(run, schema)


def _sifted(lang: str, texts: list[pa.Array], known: Sieve | None) -> tuple[pa.Array, np.ndarray, np.ndarray, int]:
    """The words of a language in a shard, their numbers in a row and the room behind each, without what the sieve keeps back;
    and how many there were."""
    words, number, last = _tokens(texts)
    total = len(number)
    if known and total:
        top, own = _hashes(pa.array([lang])), _hashes(words)
        if known.size == 1:
            keep = known.has(_phrase_hash(top, [own]))[number]
            last = last | ~np.append(keep[1:], True)  # a gap in place of a rare word
            number, last = number[keep], last[keep]
        else:
            pair = np.zeros(total, bool)
            pair[:-1] = ~last[:-1] & known.has(_phrase_hash(top, [own[number[:-1]], own[number[1:]]]))
            last = ~pair
    return words, number, _room(last), total


def count(docs: DataFrame, depths: Sequence[int], text_col: str = "text", lang_col: str = "lang", frequent: Sieve | None = None, shard: int = SHARD, totals: bool = False) -> DataFrame:
    """(lang, phrase, f): all occurrences of the phrases of so many words; phrases are words with single spaces between.

    Phrases with a word (or pair) that is not in the sieve may be left out. With totals, the row of phrase "" has the number of
    all words.
    """
    given = docs.sparkSession.sparkContext.broadcast(frequent)

    def work(held: dict[str, list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            words, number, room, total = _sifted(lang, texts, given.value)
            found = [(pa.array([""]), np.array([total]))] if totals else []
            for n, places, often in counts(number, room, depths):
                joined = [words.take(pa.array(number[places + k])) for k in range(n)]
                found.append((pc.binary_join_element_wise(*joined, " ") if n > 1 else joined[0], often))
            for phrase, often in found:
                for a in range(0, len(often), 1 << 16):
                    own = phrase.slice(a, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), own, pa.array(often[a : a + (1 << 16)].astype(np.int64))], names=["lang", "phrase", "f"])

    # shards have added up their own already, so rows go straight to where they are added
    return _shards(docs, work, "lang string, phrase string, f long", text_col, lang_col, shard).repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


#: Bits of a pair's hash behind those of its bucket.
_LOW = 24
_STEP = (1 << 16) - 1


def _packed(hashes: np.ndarray, often: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, data) of ascending hashes with their counts: two-byte steps from 0 up in every bucket, then a byte for each count.
    A longer step is filled up with steps of count 0."""
    bucket = hashes >> _LOW
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    step = np.diff(hashes & ((1 << _LOW) - 1), prepend=0)
    step[starts] = hashes[starts] & ((1 << _LOW) - 1)
    fill = step // _STEP
    at = np.arange(len(step)) + np.cumsum(fill)
    steps, counted = np.full(len(step) + int(fill.sum()), _STEP, np.uint16), np.zeros(len(step) + int(fill.sum()), np.uint8)
    steps[at], counted[at] = step % _STEP, often
    bounds = np.append(at[starts] - fill[starts], len(steps))
    for k, a, z in zip(bucket[starts].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield k, steps[a:z].tobytes() + counted[a:z].tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 3
    counted = np.frombuffer(data, np.uint8, n, 2 * n)
    real = counted > 0
    return np.cumsum(np.frombuffer(data, np.uint16, n), dtype=np.int64)[real], counted[real].astype(np.int64)


def pairs_that_can_be(docs: DataFrame, words: Sieve, least: int, n_words: int, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> DataFrame:
    """(hash long) of pairs of words in the sieve: all that occur least times, and those that share a hash with such.

    Hashes are dealt to as many buckets as leave about 2**17 words to each, 2**6 to 2**16. A shard's count of a pair stops at
    least, or at 255, which is enough to tell; a task adds up one bucket after the other.
    """
    bits = min(16, max(6, int(n_words).bit_length() - 17))
    given, most, cut_at = docs.sparkSession.sparkContext.broadcast(words), min(255, least), 64 - bits - _LOW

    def work(held: dict[str, list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        hashes, counted = [], []
        for lang, texts in held.items():
            own, number, room, _ = _sifted(lang, texts, given.value)
            own, top = _hashes(own), _hashes(pa.array([lang]))
            for _, places, often in counts(number, room, [2]):
                hashes.append((_phrase_hash(top, [own[number[places]], own[number[places + 1]]]) >> U64(cut_at)).astype(np.int64))
                counted.append(often)
        if hashes:
            unique, at = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(at, np.concatenate(counted))
            rows = list(_packed(unique, np.minimum(total, most).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["bucket", "data"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, low, counted, waiting = None, [], [], 0

        def summed() -> None:
            unique, at = np.unique(np.concatenate(low), return_inverse=True)
            low[:], counted[:] = [unique], [np.bincount(at, np.concatenate(counted)).astype(np.int64)]

        def flush() -> Iterator[pa.RecordBatch]:
            if bucket is not None:
                summed()
                found = low[0][counted[0] >= most] + (bucket << _LOW)
                yield pa.RecordBatch.from_arrays([pa.array((found.astype(np.uint64) << U64(cut_at)).view(np.int64))], names=["hash"])

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != bucket:
                    yield from flush()
                    bucket, low, counted, waiting = k, [], [], 0
                own, often = _unpacked(data.as_buffer())
                low.append(own)
                counted.append(often)
                waiting += len(own)
                if waiting > 1 << 21:
                    summed()
                    waiting = 0
        yield from flush()

    return _shards(docs, work, "bucket int, data binary", text_col, lang_col, shard).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "hash long")


def mined(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, contained: int = 100, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first top phrases.

    Products have up to 38 digits, which is enough below about 10**17 words a language.
    """
    words = tables.cut(count(docs, [1], text_col, lang_col, shard=shard, totals=True).filter((F.col("f") >= least) | (F.col("phrase") == "")))
    n = words.filter(F.col("phrase") == "").select("lang", F.col("f").alias("n"))
    words = words.filter(F.col("phrase") != "")
    known = sieve(words)
    pairs = tables.cut(pairs_that_can_be(docs, known, least, n.agg(F.sum("n")).first()[0] or 0, text_col, lang_col, shard))
    every = words.unionAll(tables.cut(count(docs, range(2, longest + 1), text_col, lang_col, _sieve(pairs, 2), shard).filter(F.col("f") >= least)))
    candidates = every.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words")).filter("size > 1")
    return ranked(candidates, every, n, top, contained)


def ranked(candidates: DataFrame, every: DataFrame, n: DataFrame, top: int, contained: int) -> DataFrame:
    joined = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    # a phrase inside a longer one that is as frequent is inside one that is longer by a word and as frequent
    longer = candidates.filter("size > 2")
    parts = longer.select("lang", "f", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"))
    covers = parts.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = candidates.join(covers, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * contained))
    cuts = kept.select("lang", "phrase", "words", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    f = tables.if_small(every.select("lang", "phrase", "f"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(F.broadcast(n) if n.count() <= 1 << 16 else n, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(16,0)) * CAST(n AS DECIMAL(16,0))) div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0)))")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", F.col("low.score").cast("long").alias("score"))


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return mined(tables.read(spark, sf_dir, "documents").select("text", "lang"))


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), cut AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM cut GROUP BY lang),
grams AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
    FROM cut, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE len(words) >= size
  ) GROUP BY lang, size, phrase HAVING count(*) >= 100
), covered AS (
  SELECT DISTINCT lang, phrase, f FROM (
    SELECT lang, f, unnest([array_to_string(w[1:size - 1], ' '), array_to_string(w[2:size], ' ')]) AS phrase FROM (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE size > 2)
  )
), kept AS (SELECT * FROM grams WHERE size > 1 AND (lang, phrase, f) NOT IN (SELECT (lang, phrase, f) FROM covered)),
cuts AS (
  SELECT lang, phrase, f, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:size], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, k, (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.first JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest JOIN total t ON t.lang = c.lang
), lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE nth = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranks WHERE rank <= 2000
"""
