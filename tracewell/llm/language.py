"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (FTRL-proximal) under elastic-net penalties, then calibrated by one temperature.

Features: n-grams of 1 to 3 code points of the lower-cased whole text, hashed to 2**16; value = count / n-grams * idf.
Document frequencies cover every training document; the model is fitted to about per_class documents of each language, which
count by their language's share of all, so that the fit does not shift where a table outgrows the sample.

Defined results: a null or empty text, or one without a letter, gets "und" with score 0; without any training
document every text gets "und". Rows with a null language or id are never learnt from. Repeated rows each get a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm import kernels as K
from tracewell.llm import tables

BITS = 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SCALE = 16.0


def grams(texts: pa.Array):
    """For each chunk of documents: (first, last, bounds, buckets), buckets of document i in bounds[i]:bounds[i+1]."""
    data, offsets = K.flat(pc.utf8_lower(texts))
    for i, j in K.chunks(offsets):
        part = data[offsets[i] : offsets[j]]
        here = offsets[i : j + 1] - offsets[i]
        chars = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        bounds = K.char_offsets(part, here)
        n = len(chars)
        width = len(ORDERS)
        out = np.full((n, width), -1, np.int32)
        end = np.repeat(bounds[1:], np.diff(bounds)) if n else np.zeros(0, np.int64)
        at = np.arange(n)
        h = np.zeros(n, np.uint32)
        for k in range(max(ORDERS)):
            shifted = np.zeros(n, np.uint32)
            shifted[: n - k] = chars[k:] if k else chars
            h = (h ^ shifted) * _MULTIPLIERS[k] + np.uint32(k + 1)
            h ^= h >> np.uint32(15)
            if k + 1 in ORDERS:
                ok = at + k < end
                out[ok, ORDERS.index(k + 1)] = ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))[ok].astype(np.int32)
        yield i, j, bounds, out


@dataclass
class Model:
    """labels; weight (buckets, labels), with the idf multiplied in; bias (labels); temperature."""

    labels: list[str]
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    idf: np.ndarray

    def nonzero(self) -> float:
        return float((self.weight != 0).mean()) if self.weight.size else 0.0


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Of each bucket, over all documents; and how many documents there are."""
    size = (1 << BITS) + 1

    def kernel():
        def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
            seen = np.zeros(size, bool)
            for i, j, bounds, out in grams(batch.column(0)):
                for k in range(j - i):
                    seen[:] = False
                    seen[out[bounds[k] : bounds[k + 1]].ravel()] = True  # -1 marks the last place, which counts documents below
                    seen[-1] = True
                    total += seen

        return add

    total = tables.summed(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), size, kernel)
    return total[:-1], int(total[-1])


def _sparse(texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    index, value = [], []
    for i, j, bounds, out in grams(texts):
        for k in range(j - i):
            own = out[bounds[k] : bounds[k + 1]].ravel()
            found, count = np.unique(own[own >= 0], return_counts=True)
            index.append(found.astype(np.int32))
            value.append((count / max(1, count.sum())).astype(np.float32))
    return index, value


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for the multinomial loss; rows count by the share of their label. Weights come from the accumulated z and n only when a row touches them."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    order = np.random.default_rng(seed)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            index, value, label = rows[r]
            at = np.append(index, size)  # the last is the bias
            x = np.append(value, 1.0)
            w = weights(at)
            g = softmax(x @ w)
            g[label] -= 1.0
            if share is not None:
                g *= share[label]
            step = x[:, None] * g[None, :]
            sq = step * step
            z[at] += step - (np.sqrt(n[at] + sq) - np.sqrt(n[at])) / alpha * w
            n[at] += sq
    w = weights(np.arange(size + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, truth: np.ndarray, share: np.ndarray | None = None) -> float:
    """The one divisor of the logits that makes the truth likeliest (golden-section search)."""
    if not len(truth):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -float(np.average(np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)), weights=None if share is None else share[truth]))

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", per_class: int = 1500, most_rows: int = 60_000, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 2) -> Model:
    """Fits to the rows that are given: leave out what must not be learnt. per_class bounds the sample of a language, and most_rows
    that of all together (the driver's memory), which it shares out evenly among many languages.

    Only the sparse features of the sample reach the driver. A fifth of the sample sets the temperature alone.
    """
    docs = docs.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    df, count = document_frequencies(docs, text_col)
    if not count:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, np.zeros(1 << BITS))
    idf = np.log((1 + count) / (1 + df)).astype(np.float32) + 1
    counts = tables.class_counts(docs, label_col)
    per_class = min(per_class, max(1, most_rows // len(counts)))
    sample = tables.class_sample(docs, label_col, id_col, per_class, salt=11, counts=counts)

    def kernel():
        def work(texts: pa.Array) -> list[pa.Array]:
            index, value = _sparse(texts)
            return [pa.array([x.tobytes() for x in index], pa.binary()), pa.array([x.tobytes() for x in value], pa.binary())]

        return work

    kept = sample.select(F.col(label_col).cast("string").alias("__label"), F.col(id_col).alias("__id"), F.col(text_col).alias("__body"))
    # as Arrow columns, so that the driver holds no object for each row
    got = tables.add_columns(kept, "__body", [T.StructField("__index", T.BinaryType()), T.StructField("__value", T.BinaryType())], kernel, keep=["__label", "__id"]).toArrow()
    got = got.sort_by([("__id", "ascending"), ("__label", "ascending"), ("__index", "ascending")]).combine_chunks()
    truth = got.column("__label").to_pylist()
    labels = sorted(set(truth))
    rows = []
    for label, i, v in zip(truth, got.column("__index"), got.column("__value"), strict=True):
        index = np.frombuffer(i.as_buffer(), np.int32)
        rows.append((index, np.frombuffer(v.as_buffer(), np.float32) * idf[index] * _SCALE, labels.index(label)))
    apart = [r for k, r in enumerate(rows) if k % 5 == 4]
    fitted = [r for k, r in enumerate(rows) if k % 5 != 4] or rows
    found = np.bincount([y for *_, y in rows], minlength=len(labels))
    share = np.array([{str(k): n for k, n in counts.items()}[x] for x in labels]) / np.maximum(found, 1)
    share = share / np.average(share, weights=found) if len(found) else share
    weight, bias = ftrl(fitted, len(labels), 1 << BITS, alpha, beta, l1, l2, epochs, seed=7, share=share)
    logits = np.array([x @ weight[i] + bias for i, x, _ in apart]).reshape(len(apart), len(labels))
    t = temperature(logits, np.array([y for *_, y in apart], int), share)
    return Model(labels, (weight * idf[:, None] * _SCALE).astype(np.float32), bias, t, idf)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its calibrated probability; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, np.vstack([model.weight, np.zeros((1, model.weight.shape[1]), np.float32)]), model.bias, model.temperature))

    def kernel():
        import regex

        labels, weight, bias, t = shared.value
        letter = regex.compile(r"\p{L}")
        names = np.array([*labels, UNKNOWN], object)

        def work(texts: pa.Array) -> list[pa.Array]:
            n = len(texts)
            best, score = np.full(n, len(labels)), np.zeros(n)
            lettered = np.fromiter((letter.search(x) is not None for x in texts.to_pylist()), bool, n)
            for i, j, bounds, out in grams(texts) if labels else ():
                total = np.zeros((j - i, len(labels)))
                for k in range(out.shape[1]):
                    total += K.per_doc(weight[out[:, k]], bounds)
                size = np.maximum(K.per_doc((out >= 0).sum(axis=1), bounds), 1)
                p = softmax((total / size[:, None] + bias) / t)
                best[i:j], score[i:j] = p.argmax(axis=1), p.max(axis=1)
            best[~lettered], score[~lettered] = len(labels), 0.0
            return [pa.array(names[best], pa.string()), pa.array(score, pa.float64())]

        return work

    return tables.add_columns(docs, text_col, [T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())], kernel, keep)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(tables.trainable()))
    return predict(docs.select("doc_id", "text", tables.held_out().alias("held_out")), model, keep=["doc_id", "held_out"])
