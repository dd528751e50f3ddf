"""Toxicity by maximum-scoring segments.

Tokens (runs of letters, lower-cased) score their log-odds of toxic against other documents. The odds of a token come from
its first STEMS code points in turn, each under a Dirichlet prior and shrunk by its uncertainty; a longer stem that few
documents hold leans on the shorter one, so inflected and unseen forms of a toxic word count too. A linear-time scan finds
every maximal segment of a text; Karlin-Altschul statistics (a Gumbel law with decay lambda and constant K) give each
segment its expected number in clean text of that length. Segments that are expected less than once are a text's evidence
together; without any, its best segment alone is, so that no two texts are alike only because nothing is significant.

Token counts cover every labelled training document but those that set the calibration (a fifth, chosen by the id).

Defined results: a null or empty text has no passages and scores like a text of one token that is not toxic. Rows with null
labels or ids are not learnt from; an id with several labels counts once for each; without both labels every score is the
share of toxic ones (0 for none). Repeated rows each get a row. A run of letters in a script without spaces is one token.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels as K
from tracewell.llm import tables

BITS = 18
SIZE = 1 << BITS
#: Code points of a token that each level of its log-odds looks at; a shorter token is its own stem.
STEMS = (3, 4, 5, 6, 8)
#: Bins of a histogram of gains, and their width; the last bin has all above.
BINS, WIDTH = 64, 0.25
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True

PASSAGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])


def token_stems(texts: pa.Array):
    """For each chunk: (first, last, own, stems, byte starts, byte ends), tokens of document i in own[i]:own[i+1]; stems holds
    the bucket of every stem of every token, one row for each of STEMS."""
    data, offsets = K.flat(texts)
    for i, j in K.chunks(offsets):
        part, here = K.FOLD[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends = K.words(part, here, _LETTER[part])
        chars = np.append(np.flatnonzero((part & 0xC0) != 0x80), np.full(max(STEMS), len(part)))
        first = np.searchsorted(chars, starts)
        stems = np.empty((len(STEMS), len(starts)), np.int32)
        for k, size in enumerate(STEMS):
            stems[k] = K.span_hashes(part, starts, np.minimum(chars[first + size], ends)) >> np.uint64(64 - BITS)
        own = np.searchsorted(starts, here)
        base = here[np.searchsorted(here, starts, "right") - 1]
        yield i, j, own, stems, starts - base, ends - base


def packed(buckets: np.ndarray) -> bytes:
    """Ascending buckets as two-byte steps, or as they are (with one odd byte) if a step needs more."""
    steps = np.diff(buckets, prepend=0)
    return steps.astype(np.uint16).tobytes() if not len(steps) or steps.max() < 1 << 16 else buckets.astype(np.int32).tobytes() + b"="


def unpacked(data) -> np.ndarray:
    if len(data) % 2:
        return np.frombuffer(data, np.int32, (len(data) - 1) // 4)
    return np.cumsum(np.frombuffer(data, np.uint16), dtype=np.int64)


def maximal_segments(at: np.ndarray, gain: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score): Ruzzo and Tompa's scan.

    Only the tokens at `at` gain; every other one costs `drift`. The scan steps over gaining tokens alone.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, the nearest below with a smaller sum before
    total, before = 0.0, -1
    for where, plus in zip(at.tolist(), gain.tolist(), strict=True):
        total -= drift * (where - before - 1)
        before = where
        first, low, k = where, total, len(stack) - 1
        total += plus
        while True:
            while k >= 0 and stack[k][2] >= low:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= total:
                break
            first, _, low, _, under = stack[k]
            del stack[k:]
            k = under
        stack.append((first, where, low, total, k))
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def feature(evidence: np.ndarray) -> np.ndarray:
    """What the score is a logistic function of: level below 0, like ln above, and ascending throughout."""
    return np.log1p(np.logaddexp(0.0, evidence))


@dataclass
class Model:
    value: np.ndarray  # by level and bucket: what a stem adds to the log-odds
    lean: np.ndarray  # by level and bucket: the share of the shorter stem's log-odds that it keeps
    drift: float
    decay: float  # lambda
    constant: float  # ln K
    level: float  # a passage is reported from this expected number down
    slope: float
    shift: float
    share: float
    known: bool

    def gains(self, stems: np.ndarray) -> np.ndarray:
        """The log-odds of each token; 0 where they do not exceed the drift, which such a token costs."""
        out = np.zeros(stems.shape[1], np.float32)
        for value, lean, at in zip(self.value, self.lean, stems, strict=True):
            out = value[at] + lean[at] * out
        return np.where(out > self.drift, out, np.float32(0))

    def segments(self, gain: np.ndarray) -> list[tuple[int, int, float]]:
        at = np.flatnonzero(gain)
        return maximal_segments(at, gain[at].astype(float), self.drift) if len(at) else []

    def surprise(self, score, tokens):
        """-ln of the expected number of segments of such a score in clean text of so many tokens."""
        return self.decay * np.asarray(score, float) - self.constant - np.log(np.maximum(tokens, 1))

    def evidence(self, scores: list[float], tokens: int) -> float:
        """The surprises of all segments expected less than once together, or the greatest one if there is none."""
        each = self.surprise(scores or [0.0], tokens)
        return float(each[each > 0].sum() or each.max())

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(evidence), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * feature(evidence) + self.shift, -40, 40)))


def stem_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, prior: float = 20.0, least: float = 2.0, certain: float = 2.0) -> np.ndarray:
    """Log-odds under a Dirichlet prior of least + prior * rate documents, shared out like the classes; shrunk by their
    standard error, to 0 where they are below `certain` of it."""
    share = n_toxic / (n_toxic + n_other)
    a = least + prior * (toxic + other) / (n_toxic + n_other + 1)
    t, o = toxic + a * share, other + a * (1 - share)
    delta = np.log(t / (n_toxic + prior * share - toxic)) - np.log(o / (n_other + prior * (1 - share) - other))
    z = np.maximum(delta / np.sqrt(1 / t + 1 / o), certain)
    return np.where(z > certain, delta * (1 - (certain / z) ** 2), 0.0)


def decay_of(bins: np.ndarray, drift: float) -> float:
    """lambda > 0 with E[exp(lambda * score)] = 1 under clean text, by bisection; bins counts clean tokens by gain."""
    p = bins / max(1, bins.sum())
    s = np.where(np.arange(BINS) > 0, (np.arange(BINS) + 0.5) * WIDTH, -drift)

    def excess(x: float) -> float:
        return float((p * np.exp(np.minimum(x * s, 500))).sum() - 1)

    low, high = 1e-6, 1e-3
    while excess(high) < 0 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return (low + high) / 2


def constant_of(best: np.ndarray, tokens: np.ndarray, decay: float, tail: float = 0.1) -> float:
    """ln K such that a share `tail` of clean texts has a best segment that P(best > x) = 1 - exp(-K n exp(-lambda x)) gives
    that chance at most: the law is matched in its tail, where it decides."""
    return float(np.quantile(decay * best - np.log(tokens), 1 - tail) + np.log(-np.log1p(-tail))) if len(best) else 0.0


def fit_line(x: np.ndarray, y: np.ndarray, rate: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression in one variable with a small ridge (Newton's steps)."""
    beta = np.zeros(2)
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        g = design.T @ (rate * (p - y)) + 1e-3 * beta
        h = (design * (rate * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", drift: float = 1.0, level: float = 0.05, lean_on: float = 5.0, calibration_per_class: int = 2000) -> Model:
    """Learns from all rows given: leave out what must not be learnt. calibration_per_class bounds the calibration sample alone;
    a stem that lean_on documents hold takes half of its log-odds from the shorter stem."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    fold = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(5)) == 0

    def distinct_kernel():
        at = (np.arange(len(STEMS)) * SIZE)[:, None]

        def work(texts: pa.Array) -> list[pa.Array]:
            out = []
            for i, j, own, stems, *_ in token_stems(texts):
                every = stems + at
                out += [packed(np.unique(every[:, own[k] : own[k + 1]])) for k in range(j - i)]
            return [pa.array(out, pa.binary())]

        return work

    body = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    own = tables.add_columns(body.filter(~fold), "body", [T.StructField("buckets", T.BinaryType())], distinct_kernel, keep=["id"])
    size = len(STEMS) * SIZE

    def count_kernel():
        def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
            for found, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total[unpacked(found.as_buffer()) + label * size] += 1
                total[2 * size + label] += 1

        return add

    taught = tables.if_small(known.filter(~fold))
    total = tables.summed(own.join(taught, "id").select("buckets", "label"), 2 * size + 2, count_kernel)
    other, toxic, n_other, n_toxic = total[:size].astype(float), total[size : 2 * size].astype(float), int(total[-2]), int(total[-1])
    nothing = np.zeros((len(STEMS), 1), np.float32)
    if not n_other or not n_toxic:
        share = n_toxic / max(1, n_other + n_toxic)
        return Model(nothing, nothing, drift, 1.0, 0.0, level, 0.0, 0.0, share, False)
    trust = (toxic + other) / (toxic + other + lean_on)
    value = (trust * stem_odds(toxic, other, n_toxic, n_other)).astype(np.float32).reshape(len(STEMS), SIZE)
    model = Model(value, (1 - trust).astype(np.float32).reshape(len(STEMS), SIZE), drift, 1.0, 0.0, level, 1.0, 0.0, n_toxic / (n_other + n_toxic), True)

    sample = tables.class_sample(body.filter(fold).join(tables.if_small(known.filter(fold)), "id"), "label", "id", calibration_per_class, salt=5)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("tokens", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("bins", T.BinaryType())]

    def scan_kernel():
        def work(texts: pa.Array) -> list[pa.Array]:
            sizes, found, bins = [], [], []
            for i, j, own, stems, *_ in token_stems(texts):
                gain = shared.value.gains(stems)
                for k in range(j - i):
                    mine = gain[own[k] : own[k + 1]]
                    sizes.append(len(mine))
                    found.append([s for *_, s in shared.value.segments(mine)])
                    bins.append(np.bincount(np.minimum(mine / WIDTH, BINS - 1).astype(np.int64), minlength=BINS).tobytes())
            return [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.float64())), pa.array(bins, pa.binary())]

        return work

    # the sample has at most about calibration_per_class rows of two short arrays for either label
    chosen = tables.add_columns(sample, "body", fields, scan_kernel, keep=["label"]).collect()
    n = np.array([max(1, r["tokens"]) for r in chosen], float)
    y = np.array([r["label"] for r in chosen], float)
    if not (y == 0).any():
        model.slope, model.shift = 2.0, -2.0
        return model
    best = np.array([max(r["scores"], default=0.0) for r in chosen])
    model.decay = decay_of(np.sum([np.frombuffer(bytes(r["bins"]), np.int64) for r in chosen if r["label"] == 0], axis=0), drift)
    model.constant = constant_of(best[y == 0], n[y == 0], model.decay)
    if not (y == 1).any():
        model.slope, model.shift = 2.0, -2.0
        return model
    evidence = np.array([model.evidence(r["scores"], size) for r, size in zip(chosen, n, strict=True)])
    weight = np.where(y == 1, model.share / (y == 1).sum(), (1 - model.share) / (y == 0).sum()) * len(y)
    model.slope, model.shift = fit_line(feature(evidence), y, weight)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score_as: str = "score", passages_as: str | None = "passages") -> DataFrame:
    """docs with the score of each whole text and its significant passages (byte offsets in UTF-8); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(score_as, T.DoubleType())] + ([T.StructField(passages_as, T.ArrayType(PASSAGE))] if passages_as else [])

    def kernel():
        model = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        reported = -np.log(model.level)

        def work(texts: pa.Array) -> list[pa.Array]:
            evidence, passages = np.zeros(len(texts)), [[] for _ in range(len(texts))]
            if not model.known:
                return [pa.array(model.probability(evidence), pa.float64())] + ([pa.array(passages, kind)] if passages_as else [])
            for i, j, own, stems, starts, ends in token_stems(texts):
                gain = model.gains(stems)
                sizes = np.diff(own)
                evidence[i:j] = model.surprise(np.zeros(j - i), sizes)
                for k in np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(gain), own))):
                    first, n = own[k], sizes[k]
                    found = model.segments(gain[first : own[k + 1]])
                    evidence[i + k] = model.evidence([s for *_, s in found], n)
                    if passages_as:
                        each = model.surprise([s for *_, s in found], n)
                        passages[i + k] = [{"start": int(starts[first + a]), "end": int(ends[first + b]), "score": s, "expected": float(np.exp(-e))} for (a, b, s), e in zip(found, each, strict=True) if e >= reported]
            out = [pa.array(model.probability(evidence), pa.float64())]
            return out + ([pa.array(passages, kind)] if passages_as else [])

        return work

    return tables.add_columns(docs, text_col, fields, kernel, keep)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = tables.read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs.filter(tables.trainable()), labels.filter(tables.trainable()))
    scored = predict(docs.select("doc_id", "text", tables.held_out().alias("held_out")), model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
