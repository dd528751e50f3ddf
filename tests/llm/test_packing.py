"""Packing against one sequence at a time, its ids against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewell.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def one_at_a_time(stock, capacity):
    left, out = {n: k for n, k in enumerate(stock) if n and k}, []
    while left:
        gap, own = capacity, []
        for n in sorted(left, reverse=True):
            while left[n] and n <= gap:
                own.append(n)
                gap, left[n] = gap - n, left[n] - 1
        left = {n: k for n, k in left.items() if k}
        shortest, names = min(own), sorted(left)
        pairs = [(x + y, x - y, x, y) for i, x in enumerate(names) for y in names[i:] if (x != y or left[x] > 1) and shortest < x + y <= shortest + gap]
        if gap and pairs:
            x, y = max(pairs)[2:]
            own.remove(shortest)
            own += [x, y]
            left[shortest] = left.get(shortest, 0) + 1
            for n in (x, y):
                left[n] -= 1
            left = {n: k for n, k in left.items() if k}
        out.append(sorted(own, reverse=True))
    return out


def test_plan_is_best_two_fit():
    r = random.Random(5)
    for _ in range(200):
        capacity = r.choice([10, 17, 40, 100])
        stock = [0] + [r.choice([0, 0, 1, 2, 3, 20]) for _ in range(capacity)]
        assert [f for often, f in packing.plan(stock, capacity) for _ in range(often)] == one_at_a_time(stock, capacity)


def test_plan_is_near_the_bound_and_short():
    stock = np.bincount(np.minimum(np.random.default_rng(1).lognormal(6, 1, 1_000_000).astype(int) % 1024 + 1, 1024), minlength=1025)
    fillings = packing.plan(stock)
    assert sum(often for often, _ in fillings) <= 1.001 * (stock * np.arange(1025)).sum() / 1024
    assert len(fillings) < 60_000


def test_ids_are_the_librarys():
    r, ours, theirs = random.Random(1), packing.Encoder(open(PATH, "rb").read()), Tokenizer.from_file(PATH)
    texts = ["".join(r.choice("ab \n\t,.;'s!tdé漢　 \x85\x0b1 2<|endoftext|>😀ß\xa0") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += ["", "a<|endoftext|> b", "it's, don't. we'll!", "  a  b   ", " \n\n x", "x" * 9000, "voilà la é, ñ. Straße,Ende", "\x00"]
    data = "".join(texts).encode()
    ids, bounds = ours.encode(np.frombuffer(data, np.uint8), np.cumsum([0] + [len(t.encode()) for t in texts]))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == theirs.encode(text, add_special_tokens=False).ids, text


def test_words_are_forgotten_without_harm():
    ours = packing.Encoder(open(PATH, "rb").read(), remember=10)
    text = np.frombuffer(b"one two three four five six seven eight nine ten eleven twelve", np.uint8)
    first = ours.encode(text, np.array([0, len(text)]))[0].tolist()
    assert ours.encode(text, np.array([0, len(text)]))[0].tolist() == first


@pytest.fixture(scope="module")
def pieces(odd):
    return packing.cut_pieces(odd, PATH, with_ids=True)


def test_pieces_and_sequences(odd, pieces):
    theirs = Tokenizer.from_file(PATH)
    rows = packing.packed(pieces).collect()
    whole = {}
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        whole.setdefault((r["doc_id"], r["n_chars"]), []).append(r)
    for r in odd.collect():
        ids = theirs.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        own = sorted((p for p in whole[r["doc_id"], r["n_chars"]]), key=lambda p: p["piece"])
        times = sum(1 for p in own if p["piece"] == 0)  # rows that repeat
        assert all(ids[p["start"] : p["start"] + p["length"]] == p["ids"] for p in own if r["doc_id"] is not None)
        if times == 1:
            assert [p["piece"] for p in own] == list(range(len(own))) and sum(p["length"] for p in own) == len(ids)
            assert len(own) == max(1, -(-len(ids) // 1024)) and all(p["length"] == 1024 for p in own[1:])
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(places) == list(range(len(places)))
    told = {r["sequence_id"]: r["ids"] for r in packing.sequences(packing.packed(pieces)).collect()}
    assert {s: sum(n for _, n in own) for s, own in places.items()} == {s: len(ids) for s, ids in told.items()}


def test_many_partitions_of_one_length(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', repeat('word ', CAST(id % 40 AS int))) AS text").repartition(13)
    rows = packing.packed(packing.cut_pieces(docs, PATH, keep=["doc_id"])).toPandas()
    assert len(rows) == 3000
    ends = rows.sort_values(["sequence_id", "offset"])
    assert (ends.groupby("sequence_id")["length"].cumsum() - ends["length"] == ends["offset"]).all()
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 1024) + 1


def test_empty_and_clashing(spark, empty):
    assert packing.packed(packing.cut_pieces(empty, PATH)).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, piece int, `offset` int, other int")
    assert packing.packed(packing.cut_pieces(docs, PATH)).columns == ["doc_id", "text", "other", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
