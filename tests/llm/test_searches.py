import hashlib
import itertools
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SF
from pyspark.sql import functions as F

from tracewell.llm import fingerprints, jaccard, licenses, tables, topk

FOLD = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute_classes(rows):
    """rows: (id, text) to the smallest id of each row's class, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            up[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [least.get(find(k)) for k in range(len(rows))], [len(s) for s in sets]


def edited(seed, base, edits):
    r = random.Random(seed)
    w = base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """A family of near copies around the threshold, exact copies, a passage that many share, and sizes from 1 word."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base, passage = " ".join(word() for _ in range(150)), " ".join(word() for _ in range(60))
    texts = [edited(k, base, k % 7) for k in range(220)] + [base] * 15
    texts += [" ".join([word() for _ in range(r.randrange(1, 200))] + ([passage] if k % 3 else [])) for k in range(150)]
    long = " ".join(word() for _ in range(560))
    texts += [edited(k, long, k) for k in range(0, 40, 4)] + [" ".join(long.split()[: 460 + 20 * k]) for k in range(5)]
    texts += ["a b", "A  b", "a b c d e", "a\tb\nc d e", ""]
    return list(enumerate(texts))


def check(spark, rows):
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, sizes = brute_classes(rows)
    assert sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == sorted(zip([i for i, _ in rows], sizes, want, strict=True), key=repr)


def test_jaccard_agrees_with_all_pairs(spark, copies):
    check(spark, copies)


def test_jaccard_in_many_small_tiles(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 40)
    monkeypatch.setattr(jaccard, "TILE_MEMBERS", 4000)
    check(spark, copies)


def test_jaccard_of_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = {(r["id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(odd).collect()}
    want, sizes = brute_classes(rows)
    assert got == set(zip([i for i, _ in rows], sizes, want, strict=True))
    kept = jaccard.deduplicated(odd.filter("doc_id IS NOT NULL"))
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for (i, _), c in zip(rows, want, strict=True) if i == c and i is not None})
    assert jaccard.classes(empty).count() == 0 and jaccard.deduplicated(empty).count() == 0


def test_every_class_keeps_one_row(spark):
    """Ids that repeat with other texts or are null: a class keeps its row of the smallest id, and no class is lost."""
    word = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(5, word(1), "a"), (5, word(2), "b"), (9, word(2) + " end", "c"), (None, word(3), "d"), (None, word(3), "d"), (None, word(4), "e"), (None, word(1), "f"), (7, word(5), "g"), (7, word(5), "g"), (None, None, "h"), (None, "", "i"), (8, None, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["source"]) for r in jaccard.deduplicated(docs).collect()), key=repr)
    assert got == sorted([(5, "a"), (5, "b"), (None, "d"), (None, "e"), (7, "g"), (None, "h"), (None, "i"), (8, "j")], key=repr)


def test_a_row_without_id_links_its_neighbours(spark):
    """1 and 2 are below 0.8 of one another; the row without an id between them is within reach of both."""
    words = [f"w{k}" for k in range(104)]
    rows = [(1, " ".join(words)), (None, " ".join(words[5:] + [f"x{k}" for k in range(5)])), (2, " ".join(words[11:] + [f"x{k}" for k in range(11)])), (3, "a b c d e f")]
    check(spark, rows)
    got = {r["id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, None: 1, 2: 1, 3: 3}


def test_members_that_many_documents_hold_make_lists(spark, monkeypatch):
    """Texts made of one passage that all share and little else: their prefixes hold common members."""
    r = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + "".join(f" q{r.randrange(400)}" for _ in range(r.randrange(0, 14)))) for k in range(300)]
    monkeypatch.setattr(jaccard, "TILE", 64)
    check(spark, rows)


def test_components_of_many_edges_and_of_few_agree(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    df = spark.createDataFrame(edges, "a long, b long")
    few, many = (sorted(map(tuple, jaccard.components(df, small=s).collect())) for s in (1 << 20, 0))
    assert few == many and dict(few)[460] == 400
    assert jaccard.components(df.limit(0)).count() == 0


def test_repeated_members_are_counted_in_little_memory():
    r = np.random.default_rng(3)
    for n, least in itertools.product((0, 1, 2, 3, 4, 5, 50, 1000), (1, 2, 4)):
        every = r.integers(0, n // 3 + 1, n).astype(np.uint64)
        value, count = np.unique(every, return_counts=True)
        got, times = jaccard.repeated(every.copy(), least)
        assert got.tolist() == value[count >= least].tolist() and times.tolist() == count[count >= least].tolist()
    every = r.integers(0, 2**63, 1 << 20).astype(np.uint64)
    tracemalloc.start()
    jaccard.repeated(every, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < every.nbytes / 2  # bounds and counts of all members took over three times their bytes


def test_long_texts_are_cut_into_small_slices():
    def sizes(text, n):
        batch = pa.record_batch({"text": pa.array([text] * n)})
        got = list(tables.parts(batch))
        assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch])) if n else not got
        return [x.num_rows for x in got]

    assert sizes("some words", 2500) == [1024, 1024, 452] and sizes("", 0) == []
    long = sizes("x" * 100_000, 300)
    assert max(long) * 100_000 <= 8 << 20 and sum(long) == 300
    assert sizes("x" * (9 << 20), 2) == [1, 1]


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(4)
    order = jaccard.Order(r.integers(0, 2**63, 5).astype(np.uint64))
    for _ in range(200):
        n = int(r.integers(1, 40))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        drop = int(len(a) * 0.2)
        b = a[drop:]
        if len(b) and 9 * len(b) >= 4 * (len(a) + len(b)):
            assert set(np.concatenate(order.prefix(a)).tolist()) & set(np.concatenate(order.prefix(b)).tolist())


def test_signature_bounds_the_difference():
    r = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 300, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        assert np.bitwise_count(jaccard.signature(a).view(np.uint64) ^ jaccard.signature(b).view(np.uint64)).sum() <= differ


def test_folded_signatures_are_signatures_of_fewer_words():
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 2**63, 600).astype(np.uint64))
    assert jaccard.lanes(512) == 8 and jaccard.lanes(513) == 16 and jaccard.lanes(1025) == 32 and len(jaccard.signature(a)) == 16
    odd = np.zeros(512, int)
    for h in a.tolist():
        odd[(h >> 32) % 512] ^= 1
    assert (np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64) == jaccard.folded(jaccard.signature(a))).all()


def test_jaccard_sql_twin(spark):
    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = sorted(map(tuple, jaccard.op2_jaccard_join(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(db.execute(jaccard.JACCARD_SQL).fetchall())


# fingerprints


def test_interior_phrases_do_not_depend_on_the_offset():
    r = random.Random(8)
    shared = "".join(r.choice("abcdefgh ij") for _ in range(600))
    one, two = "xyz" * 7 + shared + "q" * 31, "".join(r.choice("klm") for _ in range(111)) + shared
    for names, bounds in fingerprints.parse(*jaccard.K.flat(pa.array([one, two])), levels=3):
        a, b = set(names[: bounds[1]].tolist()), set(names[bounds[1] :].tolist())
        assert len(a & b) >= 0.6 * min(len(a), len(b))


def test_phrases_cover_runs_and_are_short():
    texts = ["a" * 1000, "ab" * 500, "abc" * 300, "", "x", "xy"]
    data, offsets = jaccard.K.flat(pa.array(texts))
    names, bounds = fingerprints.parse(data, offsets, 1)[0]
    count = np.diff(bounds)
    assert count[0] == 1 and count[3] == 0 and count[4] == 1
    assert count[1] >= 1000 / 16 and count[2] >= 900 / 16


def test_fingerprints_against_brute_force(spark, odd):
    rows = [r for r in odd.select("doc_id", "text").collect() if r["doc_id"] is not None and r["doc_id"] != 1]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [(r["doc_id"], r["text"] or "") for r in sorted(rows, key=lambda r: -r["doc_id"])]
    for per in (1, 3, 100):
        moved = fingerprints.with_next(df, rows_per_range=per)
        assert moved.filter("role <> 1").count() == len(rows)
    got = {r["doc_id"]: r for r in fingerprints.edited(df).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
        assert got[i]["near_edited"] == fingerprints.compare(got[i]["fingerprint"], got[i]["edited_fingerprint"])
    alone = fingerprints.fingerprint(df)
    assert all(got[r["doc_id"]]["fingerprint"] == r["fingerprint"] for r in alone.collect())


def test_ranges_of_any_size_give_the_same_successors(spark):
    df = spark.createDataFrame([(k * 3 % 101, f"text {k} " * 5) for k in range(101)], "doc_id long, text string")
    want = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.edited(df).collect()}
    original = fingerprints.with_next
    try:
        fingerprints.with_next = lambda docs, i, t: original(docs, i, t, rows_per_range=7)
        assert {r["doc_id"]: r["edited_sha256"] for r in fingerprints.edited(df).collect()} == want
    finally:
        fingerprints.with_next = original


def test_rows_without_ids_and_repeats_have_fingerprints(spark, odd, empty):
    got = fingerprints.edited(odd)
    assert got.count() == odd.count()
    assert len({r["fingerprint"] for r in got.filter("doc_id = 1").collect()}) == 1
    assert fingerprints.edited(empty).count() == 0


def brute_level(names: list[int], level: int, first_level: bool) -> list[int]:
    """One level of the parse of one text, symbol by symbol in Python's integers."""
    whole = (1 << 64) - 1

    def mix(x: int) -> int:
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & whole
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & whole
        return x ^ x >> 31

    salt = [int(x) for x in fingerprints._SALT]
    runs: list[list[int]] = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    symbols = [x for x, _ in runs]
    named = [mix((mix(x + 1) if first_level else x) ^ (n * salt[8] & whole)) if n > 1 else (mix(x + 1) if first_level else x) for x, n in runs]
    label = symbols if first_level else named
    for _ in range(2 if first_level else 3):
        tossed = []
        for k, x in enumerate(label):
            low = 1 if k == 0 else (x ^ label[k - 1]) & -(x ^ label[k - 1])
            tossed.append(2 * (low.bit_length() - 1) + (x & low != 0))
        label = tossed
    starts = [k for k in range(len(named)) if k == 0 or 1 < k < len(named) - 1 and label[k - 1] < label[k] > label[k + 1]]
    out = []
    for a, b in zip(starts, [*starts[1:], len(named)] if starts else [], strict=True):
        total = sum(mix(named[k] + (k - a) * salt[9] & whole) for k in range(a, b)) & whole
        out.append(mix(total ^ ((b - a) * salt[level] & whole)))
    return out


def test_parse_agrees_with_brute_force():
    r = random.Random(10)
    texts = ["", "x", "xy", "aaaa", "abab" * 9, "漢字 é", *("".join(r.choice("abc de") for _ in range(r.randrange(300))) for _ in range(40))]
    levels = fingerprints.parse(*jaccard.K.flat(pa.array(texts)), levels=3)
    for k, text in enumerate(texts):
        names = list(text.encode())
        for level, (got, bounds) in enumerate(levels):
            names = brute_level(names, level, level == 0)
            assert got[bounds[k] : bounds[k + 1]].tolist() == names


def test_short_texts_are_told_apart():
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeinrstlo") for _ in range(r.randrange(2, 8)))
    texts = [" ".join(word() for _ in range(r.randrange(12, 30))) for _ in range(300)]
    new = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
    a, b = (fingerprints.Sketches(*jaccard.K.flat(pa.array(x))) for x in (texts, new))
    near_edited = fingerprints.likeness(a.at(slice(None)), b.at(slice(None)))
    near_next = fingerprints.likeness(a.at(slice(None)), a.at([*range(1, 300), 0]))
    assert (near_edited > near_next).mean() >= 0.99
    assert np.quantile(near_edited, 0.05) > 0.1


def test_near_is_higher_for_the_edited_text(spark):
    got = fingerprints.op4_fingerprints(spark, SF).filter("n_chars > 300").agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert 0.25 < got["e"] < 0.45 and got["n"] < 0.05


# licenses


def brute_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    found = [(k, label) for label, phrase in licenses.BASE for k in range(len(w)) if tuple(w[k : k + len(phrase)]) == phrase]
    return len(w), sorted(found)


TRICKY = [
    "MIT License", "the mit-license; MIT\n\n LICENSE", "smit license", "mit licenses", "Apache License, Version 2.0", "GNU General  Public\tLicense",
    "é mit é license", "mitlicense", "General public mit license", "Licensed under the Apache Licence, Verson 2.0", "Permision is hereby granted, free of charge", None, "",
]


def test_base_places_agree_with_brute_force(spark, odd):
    rows = list(enumerate(TRICKY)) + [(100 + k, r["text"]) for k, r in enumerate(odd.collect())] + [(1000 + r["doc_id"], r["text"]) for r in tables.read(spark, SF, "documents").limit(400).collect()]
    where = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(where, keep=["doc_id"]).collect()}
    for i, text in rows:
        n, places = brute_places(text)
        assert got[i]["n_words"] == n
        assert sorted((s["exact_word"], s["label"]) for s in got[i]["spans"] if s["exact_word"] is not None) == places


def test_fuzzy_notices_report_their_edits(spark, empty):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["label"], s["edits"]) for s in r["spans"] if s["exact_word"] is None] for r in licenses.scan(df).collect()}
    assert ("apache", 2) in got[9] and ("mit", 1) in got[10]
    assert got[2] == [] and got[12] == []
    assert licenses.scan(empty).count() == 0


def test_seeds_find_every_match_within_the_edits():
    import regex

    scanner = licenses.Scanner()
    r = random.Random(6)
    for label, notice, edits in licenses.NOTICES:
        for _ in range(30):
            text = list(notice)
            for _ in range(r.randrange(edits + 1)):
                k = r.randrange(1, len(text) - 1)
                text[k : k + 1] = r.choice([[], ["q"], [text[k], "q"]])
            text = "zz " + "".join(text) + " zz"
            if regex.search(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}", text):
                assert label in {s[0] for s in scanner.spans(text) if not s[4]}


def test_notices_that_stand_close_together_are_all_found():
    scanner = licenses.Scanner()
    for text, label, want in (
        ("all rights resrved. all rights reserved", "copyright", [1, 0]),
        ("licensed under the apache licence, version 2.0 and licensed under the apache license, version 2.0", "apache", [1, 0]),
        ("all rights reservedall rights reserved", "copyright", [0, 0]),
    ):
        assert [s[3] for s in sorted(scanner.spans(text), key=lambda s: s[1]) if s[0] == label and not s[4]] == want


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def ends_within(text: str, notice: str, edits: int) -> list[tuple[int, int]]:
    """(end, distance) of all places where some substring of text within the edits ends (Sellers' table)."""
    row, out = list(range(len(notice) + 1)), []
    for at, c in enumerate(text, 1):
        last, row = row, [0]
        for j, y in enumerate(notice, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != y)))
        if row[-1] <= edits:
            out.append((at, row[-1]))
    return out


def test_fuzzy_spans_agree_with_brute_force():
    """Every span has the edits it says, and every approximate match shares half of a span that is as good."""
    scanner, r = licenses.Scanner(), random.Random(8)
    for _ in range(60):
        pieces = []
        for _ in range(r.randrange(1, 4)):
            _, notice, edits = r.choice(licenses.NOTICES)
            chars = list(notice)
            for _ in range(r.randrange(edits + 2)):
                k = r.randrange(1, len(chars) - 1)
                chars[k : k + 1] = r.choice([[], ["q"], [chars[k], "q"]])
            pieces.append("".join(chars))
        text = r.choice(["", "zz ", " "]).join(pieces)
        spans = [s for s in scanner.spans(text) if not s[4]]
        for label, notice, edits in licenses.NOTICES:
            own = [s for s in spans if s[0] == label and distance(text[s[1] : s[2]], notice) <= edits]
            for _, a, b, e, _ in own:
                assert distance(text[a:b], notice) <= e or any(n != notice and x == label and distance(text[a:b], n) == e for x, n, _ in licenses.NOTICES)
            for end, far in ends_within(text, notice, edits):
                assert any(e <= far and min(b, end) - max(a, end - len(notice)) >= len(notice) // 2 - edits for _, a, b, e, _ in own), (text, notice, end, far)


def test_license_query_columns_agree_with_brute_force(spark, tmp_path):
    rows = list(enumerate(TRICKY))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in licenses.op6_license_scan(spark, str(tmp_path)).collect()}
    scanner = licenses.Scanner()
    for i, text in rows:
        n, places = brute_places(text)
        found = scanner.spans(licenses.lower(text or ""))
        sure = [1 - e / (b - a + e) for _, a, b, e, _ in found]
        row = got[i]
        assert (row["n_words"], row["n_base"]) == (n, len(places))
        assert (row["first_word"], row["last_word"]) == ((min(w for w, _ in places), max(w for w, _ in places)) if places else (None, None))
        assert row["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert row["labels"] == ",".join(sorted({s[0] for s in found}))
        assert abs(row["score"] - max(sure, default=0.0)) < 1e-12


# top-k


def test_topk_agrees_with_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op10_topk(spark, SF).collect())) == sorted(db.execute(topk.TOPK_SQL).fetchall())


def test_topk_of_odd_vectors(spark):
    r = random.Random(7)
    rows = [(k, [float(r.randrange(-2, 3)) / 4 for _ in range(4)]) for k in range(120)]
    rows += [(200, None), (250, []), (300, [1.0, None, 0.0, 0.0]), (350, [float("nan")] * 4), (400, [float("inf")] * 4), (450, [1.0, 2.0]), (451, [0.5, 0.5]), (None, [1.0] * 4), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.search(df, F.col("id") % 50 == 0, per_segment=16, per_pack=2).collect())
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in fine:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_components_of_any_finite_size_are_exact(spark):
    rows = [(50, [1e30, 2.0]), (1, [1e30, 1.0]), (2, [3.0, 1e18]), (3, [-1e300, 0.0]), (4, [1e308, 1e308]), (5, [float(1 << 60), 1.0]), (100, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(df, F.col("id") % 50 == 0).collect()}
    fine = {i: [int(np.floor(256 * x)) if abs(x) < 2**40 else int(256 * x) for x in v] for i, v in rows if np.isfinite(256 * np.array(v)).all()}
    assert 4 not in fine
    for q in (50, 100):
        best = sorted((-sum(a * b for a, b in zip(fine[q], w, strict=True)), i) for i, w in fine.items() if i != q)[:5]
        for k, (s, i) in enumerate(best):
            assert got[q, k + 1] == (i, min(max(-s, -(2**63)), 2**63 - 1))


def test_only_few_blocks_are_scored_where_rows_of_near_ids_are_alike():
    r = np.random.default_rng(2)
    rows = np.floor(np.repeat(r.normal(size=(40, 16)), 64, axis=0) * 256 + r.normal(size=(2560, 16)) * 8)
    assert topk.share_scored(rows[::97], rows) < 0.3
    assert topk.share_scored(np.floor(r.normal(size=(8, 64)) * 256), np.floor(r.normal(size=(2048, 64)) * 256)) == 1.0


def test_blocks_are_pruned():
    r = np.random.default_rng(1)
    rows, seen = np.zeros((1024, 8)), []
    rows[:64] = r.integers(50, 100, (64, 8))
    found = topk.block_topk(np.array([-1]), np.full((1, 8), 3.0), np.arange(1024), rows, 5, step=1, seen=seen)
    assert seen == [1, 16]
    want = sorted(((-3 * int(x.sum()), k) for k, x in enumerate(rows)))[:5]
    assert [(i, s) for _, i, s in found] == [(k, -s) for s, k in want]
