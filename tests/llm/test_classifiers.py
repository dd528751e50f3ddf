import random

import numpy as np
import pyarrow as pa
from conftest_llm import SF, make_sf
from pyspark.sql import functions as F

from tracewell.llm import language, quality, tables, toxicity


def test_language_held_out_accuracy(spark):
    got = language.op1_language_id(spark, SF)
    docs = tables.read(spark, SF, "documents").select("doc_id", "lang")
    tried = got.join(docs, "doc_id").filter("held_out AND lang_pred <> 'und'")
    assert tried.filter("lang = lang_pred").count() >= 0.97 * tried.count() > 0
    assert got.count() == docs.count()
    assert got.filter("NOT score BETWEEN 0 AND 1").count() == 0


def test_language_is_sparse_and_odd_rows_have_results(spark, odd, empty):
    model = language.train(odd)
    assert model.labels == ["de", "en"]
    assert 0 < model.nonzero() < 0.2
    got = language.predict(odd, model)
    assert got.count() == odd.count()
    assert set(odd.columns) - {"score"} <= set(got.columns) and dict(got.dtypes)["score"] == "double"
    und = {(r["doc_id"], r["lang_pred"]) for r in got.filter("text IS NULL OR doc_id IN (4, 5, 9)").collect()}
    assert {x for _, x in und} == {"und"}
    assert {r["lang_pred"] for r in got.filter("doc_id IN (10, 11)").collect()} == {"de"}
    nothing = language.train(empty)
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_ngrams_agree_with_a_loop():
    texts = ["aéb", "", "ab"]
    for _, _, bounds, out in language.grams(pa.array(texts)):
        assert bounds.tolist() == [0, 3, 3, 5]
        assert (out >= 0).sum(axis=1).tolist() == [3, 2, 1, 2, 1]
        assert out[0, 0] == out[3, 0] and out[2, 0] == out[4, 0] and out[0, 1] != out[3, 1]


def test_temperature_flattens_overconfident_logits():
    logits = np.array([[4.0, 0.0]] * 10)
    truth = np.array([0] * 7 + [1] * 3)
    t = language.temperature(logits, truth)
    assert abs(language.softmax(logits / t)[0, 0] - 0.7) < 0.01


def test_quality_held_out_accuracy(spark):
    got = quality.op8_quality(spark, SF)
    labels = tables.read(spark, SF, "labels")
    tried = got.join(labels, "doc_id").filter("held_out")
    assert tried.filter("quality = predicted").count() >= 0.97 * tried.count() > 0


def test_quadratic_discriminant_agrees_with_densities():
    r = np.random.default_rng(1)
    x0, x1 = r.normal(0, 1, (400, 3)), r.normal(1, 2, (400, 3))
    m = quality.fit_moments(np.array([400.0, 400.0]), np.array([x0.sum(0), x1.sum(0)]), np.array([x0.T @ x0, x1.T @ x1]), shrink=0.0, sphere=0.0)
    x = r.normal(0.5, 1, (20, 3))

    def density(v, own):
        c, mu = np.cov(own.T, bias=True) + 1e-6 * np.eye(3), own.mean(0)
        d = v - mu
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]

    want = 1 / (1 + np.exp(-(density(x, x1) - density(x, x0))))
    assert np.allclose(m.score(x), want, atol=1e-6)


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 1), (8, 1), (9, 0), (15, 0), (5, 0), (3, None), (None, 1), (1, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    got = quality.predict(odd, model)
    assert got.count() == odd.count() and got.filter("score IS NULL OR isnan(score)").count() == 0
    one_class = quality.train(odd, labels.filter("quality = 1"))
    assert {r["score"] for r in quality.predict(odd, one_class).collect()} == {1.0}
    assert {r["score"] for r in quality.predict(odd, quality.train(empty, labels)).collect()} == {0.5}


def test_toxicity_finds_planted_passages(spark, tmp_path):
    sf = make_sf(spark, tmp_path, toxic_word="grrrumble")
    got = toxicity.op3_toxicity(spark, sf).join(tables.read(spark, sf, "labels"), "doc_id")
    assert got.filter("toxic <> predicted").count() <= 0.03 * got.count()
    docs = tables.read(spark, sf, "documents")
    model = toxicity.train(docs, tables.read(spark, sf, "labels"))
    spans = toxicity.predict(docs.filter("text LIKE '%grrrumble%'"), model).select("text", F.explode("passages").alias("p")).limit(20).collect()
    assert spans and all("grrrumble" in r.text.encode()[r.p.start : r.p.end].decode() for r in spans)


def test_maximal_segments_agree_with_brute_force():
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(1, 14))
        gain = np.where(r.random(n) < 0.5, r.integers(1, 6, n), 0).astype(float)
        score = np.where(gain > 0, gain, -1.5)
        at = np.flatnonzero(gain)
        got = toxicity.maximal_segments(at, gain[at], 1.5)

        def split(lo, hi):  # the best segment, the shortest of equals, then the rest on either side
            best = max(((score[a:b].sum(), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            *_, a, b = best
            return [*split(lo, a), (a, b - 1, best[0]), *split(b, hi)]

        want = split(0, n)
        assert sum(s for *_, s in got) == sum(s for *_, s in want)
        assert max((s for *_, s in got), default=0) == max((s for *_, s in want), default=0)


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (8, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.predict(odd, model)
    assert got.count() == odd.count() and got.filter("score IS NULL OR NOT score BETWEEN 0 AND 1").count() == 0
    assert {r["score"] for r in toxicity.predict(odd, toxicity.train(empty, labels)).collect()} == {0.0}


def test_packed_buckets_round_trip():
    for x in ([], [5], [0, 1, 2], [3, 250_000], list(range(0, 200_000, 7))):
        assert toxicity.unpacked(toxicity.packed(np.array(x, np.int32))).tolist() == x


def test_toxicity_query_agrees_with_brute_force(spark, tmp_path):
    """The whole query again with dictionaries: counts by stem, every interval of tokens, the law, the line."""
    import math
    import re
    import zlib

    r = random.Random(21)
    base = [f"{a}{b}" for a in ("wal", "tor", "min", "pel", "gos") for b in ("ka", "ti", "ros", "en", "u", "dal", "fir", "mo")]
    docs, labels = [], []
    for i in range(500):
        words = [r.choice(base) for _ in range(r.randrange(3, 40))]
        toxic = i % 4 == 0
        for _ in range(r.randrange(2, 5) if toxic else 0):
            words.insert(r.randrange(len(words)), "zurk" + r.choice(["", "en", "s", "alo"]))
        docs.append((i, " ".join(words) if i % 97 else None))
        if i % 11:
            labels.append((i, int(toxic)))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, str(tmp_path)).collect()}

    ids = spark.createDataFrame([(i,) for i, _ in docs], "id long")
    calibrates = {r["id"] for r in ids.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5)) == 0).collect()}
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    tokens = {i: re.findall(r"[^\W\d_]+", (t or "").lower()) for i, t in docs}
    label = {i: y for i, y in labels if i not in held}
    counts = [[{}, {}] for _ in toxicity.STEMS]
    n = [0, 0]
    for i, y in label.items():
        if i not in calibrates:
            n[y] += 1
            for k, size in enumerate(toxicity.STEMS):
                for s in {t[:size] for t in tokens[i]}:
                    counts[k][y][s] = counts[k][y].get(s, 0) + 1
    share = n[1] / sum(n)

    def gain(token):
        out = 0.0
        for k, size in enumerate(toxicity.STEMS):
            other, toxic = (counts[k][y].get(token[:size], 0) for y in (0, 1))
            a = 2 + 20 * (toxic + other) / (sum(n) + 1)
            t, o = toxic + a * share, other + a * (1 - share)
            delta = math.log(t / (n[1] + 20 * share - toxic)) - math.log(o / (n[0] + 20 * (1 - share) - other))
            z = delta / math.sqrt(1 / t + 1 / o)
            trust = (toxic + other) / (toxic + other + 5)
            out = trust * (delta * (1 - (2 / z) ** 2) if z > 2 else 0.0) + (1 - trust) * out
        return out if out > 1 else 0.0

    def segments(values):
        """Maximal segments by their definition: the best interval, then the same to its left and right."""
        if not values:
            return []
        steps = [v if v else -1.0 for v in values]
        sums = [0.0]
        for s in steps:
            sums.append(sums[-1] + s)
        best = max(((sums[b] - sums[a], -(b - a), -a, b) for a in range(len(steps)) for b in range(a + 1, len(steps) + 1)))
        if best[0] <= 0:
            return []
        a, b = -best[2], best[3]
        return segments(values[:a]) + [best[0]] + segments(values[b:])

    found = {i: segments([gain(t) for t in ts]) for i, ts in tokens.items()}
    chosen = [i for i in label if i in calibrates]
    clean = [i for i in chosen if label[i] == 0]
    bins = np.zeros(toxicity.BINS)
    for i in clean:
        for t in tokens[i]:
            bins[min(int(gain(t) / toxicity.WIDTH), toxicity.BINS - 1)] += 1
    decay = toxicity.decay_of(bins, 1.0)
    size = {i: max(1, len(ts)) for i, ts in tokens.items()}
    constant = float(np.quantile([decay * max(found[i], default=0.0) - math.log(size[i]) for i in clean], 0.9) + math.log(-math.log(0.9)))

    def evidence(i):
        each = [decay * s - constant - math.log(size[i]) for s in found[i] or [0.0]]
        return sum(e for e in each if e > 0) if any(e > 0 for e in each) else max(each)

    x = np.array([math.log1p(np.logaddexp(0, evidence(i))) for i in chosen])
    y = np.array([label[i] for i in chosen], float)
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum())) * len(y)
    slope, shift = toxicity.fit_line(x, y, weight)
    for i, _ in docs:
        want = 1 / (1 + math.exp(-(slope * math.log1p(np.logaddexp(0, evidence(i))) + shift)))
        assert abs(got[i]["score"] - want) < 1e-3 and got[i]["held_out"] == (i in held) and got[i]["predicted"] == int(got[i]["score"] >= 0.5)
    toxic_held = [i for i, y in labels if y == 1 and i in held]
    assert sum(got[i]["predicted"] for i in toxic_held) >= 0.9 * len(toxic_held)


def test_quality_query_agrees_with_brute_force(spark, tmp_path):
    """The whole query again, character by character, with numpy's own covariances and solver."""
    import math
    import re
    import zlib

    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdeXYZ019.,#é") for _ in range(r.randrange(1, 9)))
    docs = [(i, r.choice([" ", "  ", "\n", " \t"]).join(word() if i % 2 else r.choice(["good", "Fine", "text,", "here."]) for _ in range(r.randrange(0, 60)))) for i in range(400)] + [(400, None), (401, "")]
    labels = [(i, int(i % 2 == 0) if i % 7 else int(i % 2)) for i, _ in docs if i % 5 != 3]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x["doc_id"]: x for x in quality.op8_quality(spark, str(tmp_path)).collect()}
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}

    def features(text):
        raw = (text or "").encode()
        words = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
        n, some = len(words), max(1, len(words))
        mean = sum(map(len, words)) / some
        spread = max(0.0, sum(len(w) ** 2 for w in words) / some - mean**2)
        part = lambda chosen: math.sqrt(sum(b in chosen for b in raw) / max(1, len(raw)))
        marks = bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
        return [
            math.log1p(n), math.log1p(mean), part(bytes(range(65, 91))), part(bytes(range(48, 58))), part(marks), part(b"#$%&*+<=>@[]^_{|}~\\/"), part(b".,;:"),
            math.sqrt(sum(a == b for a, b in zip(words, words[1:], strict=False)) / some), math.log1p(len(raw) / (raw.count(b"\n") + 1)), part(b" \t\n\x0b\x0c\r"), part(bytes(range(128, 256))),
            math.sqrt(sum(65 <= w[0] <= 90 for w in words) / some), math.log1p(math.sqrt(spread)),
        ]

    x = {i: np.array(features(t)) for i, t in docs}
    sides = [np.array([x[i] for i, y in labels if y == c and i not in held]) for c in (0, 1)]
    n = sum(map(len, sides))
    own = [np.cov(s.T, bias=True) for s in sides]
    pooled = sum(len(s) * c for s, c in zip(sides, own, strict=True)) / n

    def density(v, c):
        s = 0.9 * own[c] + 0.1 * pooled
        s = 0.98 * s + 0.02 * np.diag(np.maximum(np.diag(pooled), 1e-4)) + 1e-6 * np.eye(len(v))
        away = v - sides[c].mean(axis=0)
        return math.log(len(sides[c]) / n) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * away @ np.linalg.solve(s, away)

    for i, _ in docs:
        want = 1 / (1 + math.exp(-min(60, max(-60, density(x[i], 1) - density(x[i], 0)))))
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["predicted"] == int(got[i]["score"] >= 0.3) and got[i]["held_out"] == (i in held)


def test_language_query_agrees_with_brute_force(spark, tmp_path):
    """The whole query again with dictionaries of n-grams in place of buckets, and one weight at a time."""
    import math
    import zlib

    r = random.Random(41)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 5))) for _ in range(r.randrange(4, 10)))
    docs = [(i, make("abc") if i % 3 else make("xyc"), "one" if i % 3 else "two") for i in range(90)] + [(90, None, "one"), (91, "12 3", "two"), (92, "cab", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in language.op1_language_id(spark, str(tmp_path)).collect()}
    held = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    grams = lambda t: [t[k : k + n] for k in range(len(t)) for n in (1, 2, 3) if k + n <= len(t)]
    every = sorted({g for _, t, _ in docs for g in grams(t or "")})
    hashed = {}
    for *_, out in language.grams(pa.array(every)):
        pass
    for g in every:
        for *_, out in language.grams(pa.array([g])):
            hashed[g] = int(out[0][len(g) - 1])
    assert len(set(hashed.values())) == len(every)  # no two share a bucket, so dictionaries are the same model

    taught = [(i, t or "", y) for i, t, y in docs if y is not None and i not in held]
    df = {}
    for _, t, _ in taught:
        for g in set(grams(t)):
            df[g] = df.get(g, 0) + 1
    idf = {g: math.log((1 + len(taught)) / (1 + df.get(g, 0))) + 1 for g in every}

    def values(t):
        gs = grams(t)
        return {g: gs.count(g) / max(1, len(gs)) * idf[g] * 16 for g in set(gs)}

    labels = ["one", "two"]
    rows = [(values(t), labels.index(y)) for _, t, y in sorted(taught)]
    apart, fitted = [x for k, x in enumerate(rows) if k % 5 == 4], [x for k, x in enumerate(rows) if k % 5 != 4]
    z, n = {}, {}

    def weight(g, c):
        a, b = z.get((g, c), 0.0), n.get((g, c), 0.0)
        return 0.0 if abs(a) <= 0.02 else (math.copysign(0.02, a) - a) / ((1 + math.sqrt(b)) / 0.3 + 0.1)

    def chances(x, t=1.0):
        s = [sum(v * weight(g, c) for g, v in x.items()) / t for c in (0, 1)]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(fitted)):
            x, y = fitted[k][0] | {None: 1.0}, fitted[k][1]
            p = chances(x)
            steps = []
            for g, v in x.items():
                for c in (0, 1):
                    step, w, was = v * (p[c] - (c == y)), weight(g, c), n.get((g, c), 0.0)
                    steps.append(((g, c), step - (math.sqrt(was + step**2) - math.sqrt(was)) / 0.3 * w, was + step**2))
            for at, add, now in steps:
                z[at], n[at] = z.get(at, 0.0) + add, now
    t = min((math.exp(math.log(0.05) + k / 4000 * math.log(400)) for k in range(4001)), key=lambda t: -sum(math.log(max(chances(x | {None: 1.0}, t)[y], 1e-12)) for x, y in apart))
    for i, text, _ in docs:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        p = chances(values(text) | {None: 1.0}, t)
        assert got[i]["lang_pred"] == labels[int(p[1] > p[0])] and abs(got[i]["score"] - max(p)) < 5e-3, (i, p, got[i])


def test_segment_scan_is_linear():
    """Gains below the drift between them leave every token a segment of its own: the scan must not look at them again."""
    import time

    def seconds(n: int) -> float:
        best = 9.0
        for _ in range(3):
            began = time.perf_counter()
            found = toxicity.maximal_segments(np.arange(n) * 3, np.full(n, 1.2), 1.0)
            best = min(best, time.perf_counter() - began)
            assert len(found) == n
        return best

    assert seconds(64_000) < 8 * 4 * seconds(8_000)
    rising = np.arange(64_000) * 2
    assert len(toxicity.maximal_segments(rising, np.linspace(0.5, 2, 64_000), 1.0)) > 1
