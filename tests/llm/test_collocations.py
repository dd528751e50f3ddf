"""Collocations against counting phrase by phrase."""

import random
import re
from collections import Counter

import numpy as np

from tracewell.llm import collocations


def pieces(rows):
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            yield lang or "und", re.findall(r"[^\x20\x09]+", piece)


def expected(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, words in pieces(rows):
        n[lang] += len(words)
        f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    candidates = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    out = []
    for lang in n:
        scored = []
        own = {p: c for (l, p), c in candidates.items() if l == lang}
        for phrase, a in own.items():
            inside = any(len(q) > len(phrase) and c >= a and any(q[i : i + len(phrase)] == phrase for i in range(len(q))) for q, c in own.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (f[lang, phrase[:k]] * f[lang, phrase[k:]]), k) for k in range(1, len(phrase)))
                scored.append((-score, -a, " ".join(phrase).encode(), f[lang, phrase[:k]], f[lang, phrase[k:]]))
        out += [(lang, r, p.decode(), -a, l, rest, n[lang], -s) for r, (s, a, p, l, rest) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found(docs, least, **more):
    return sorted(tuple(r) for r in collocations.mined(docs, least=least, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some(seed, n, words="the of and to a in Big red fox é 漢字 ab".split()):
    r = random.Random(seed)
    return [("".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(r.randint(0, 60))) or None, r.choice(["en", "de", None])) for _ in range(n)]


def test_against_counting(spark):
    rows = some(1, 300) + [("san francisco bay area is big", "en")] * 12 + [(None, None), ("", "en"), (" \t\n.,", "fr"), ("alone", "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert found(docs, 8) == expected(rows, 8)
    assert found(docs, 8, shard=1000) == expected(rows, 8)  # many shards a task
    assert found(docs, 20, top=5) == expected(rows, 20, 5)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = some(2, 200)
    monkeypatch.setattr(collocations, "BITS", 6)
    assert found(spark.createDataFrame(rows, "text string, lang string"), 5) == expected(rows, 5)


def test_repeats_and_overlaps(spark):
    rows = [("ha ha ha ha ha ha ha", "en")] * 5 + [("x " * 3000, "en")]
    assert found(spark.createDataFrame(rows, "text string, lang string"), 3) == expected(rows, 3)


def test_odd_and_empty(spark, odd, empty):
    assert found(odd, 30) == expected([(r["text"], r["lang"]) for r in odd.collect()], 30)
    assert found(empty, 2) == []


def test_products_above_64_bits(spark):
    big = 10**13
    every = spark.createDataFrame([("en", "a", big), ("en", "b", big), ("en", "a b", big // 10)], "lang string, phrase string, f long")
    candidates = every.selectExpr("*", "split(phrase, ' ') AS words", "size(split(phrase, ' ')) AS size").filter("size > 1")
    n = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    row = collocations.ranked(candidates, every, n, 10, 100).first()
    assert row["score"] == 1000 * (big // 10) * 10**15 // (big * big)


def test_counts_of_a_shard():
    r = np.random.default_rng(3)
    number, last = r.integers(0, 3, 2000), r.random(2000) < 0.2
    last[-1] = True
    room = collocations._room(last)
    for depths in ([1], [2], [3, 4, 5], [1, 2, 3, 4, 5]):
        for n, places, often in collocations.counts(number, room, depths):
            want = Counter(tuple(number[i : i + n]) for i in range(2000) if room[i] >= n)
            assert {tuple(number[p : p + n]): c for p, c in zip(places, often.tolist(), strict=True)} == dict(want)
