"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled one and towards a sphere; the score is the logistic
of the difference of the Mahalanobis log-densities, from Cholesky factors that are made once and kept in the model.
Moments cover every labelled training document and are summed by Spark; only the sums reach the driver.

Defined results: a null text counts as empty and is scored like any other (statistics 0). Rows with null labels or ids
are not learnt from; an id with several labels counts once for each. With one class only (or none) every score is the
share of good documents learnt from (0.5 for none). Repeated rows each get a row.
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

STATISTICS = ("words", "word_length", "upper", "digit", "mark", "symbol", "stop_mark", "repeated_pair", "line_length", "blank", "non_ascii", "title", "spread")
#: From this score on a document counts as good.
GOOD = 0.3

_CLASS = np.zeros((256, 7), bool)  # upper, digit, mark, symbol, stop mark, blank, non-ASCII
_CLASS[65:91, 0] = True
_CLASS[48:58, 1] = True
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 2] = True
_CLASS[[ord(c) for c in "#$%&*+<=>@[]^_{|}~\\/"], 3] = True
_CLASS[[ord(c) for c in ".,;:"], 4] = True
_CLASS[:, 5] = K.BLANK
_CLASS[128:, 6] = True


def statistics(texts: pa.Array) -> np.ndarray:
    """(documents, statistics): logs of sizes, logits-like roots of shares, so that tails are short."""
    data, offsets = K.flat(texts)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    for i, j in K.chunks(offsets):
        part, here = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        size = np.diff(here)
        safe = np.maximum(size, 1)
        share = [K.per_doc(_CLASS[:, k][part], here) / safe for k in range(_CLASS.shape[1])]
        starts, ends = K.words(part, here, ~K.BLANK[part])
        own = np.searchsorted(starts, here)
        count = np.diff(own)
        names = K.span_hashes(part, starts, ends)
        same = np.zeros(len(names), bool)
        same[1:] = names[1:] == names[:-1]
        first = own[:-1][count > 0]
        same[first] = False
        capital = _CLASS[:, 0][part[starts]] if len(starts) else np.zeros(0, bool)
        length = (ends - starts).astype(float)
        some = np.maximum(count, 1)
        mean = K.per_doc(length, own) / some
        square = K.per_doc(length * length, own) / some
        lines = K.per_doc(part == 10, here) + 1
        out[i:j] = np.column_stack([
            np.log1p(count), np.log1p(mean), *(np.sqrt(share[k]) for k in (0, 1, 2, 3, 4)), np.sqrt(K.per_doc(same, own) / some),
            np.log1p(size / lines), np.sqrt(share[5]), np.sqrt(share[6]), np.sqrt(K.per_doc(capital, own) / some), np.log1p(np.sqrt(np.maximum(square - mean * mean, 0))),
        ])
    return out


@dataclass
class Model:
    """For each of the two classes: the mean, the inverse Cholesky factor and the log-density's constant."""

    mean: np.ndarray
    factor: np.ndarray
    constant: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.constant):
            return np.full(len(x), self.prior)
        density = [self.constant[c] - 0.5 * ((((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(axis=1)) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -60, 60)))


def fit_moments(n: np.ndarray, total: np.ndarray, outer: np.ndarray, shrink: float = 0.1, sphere: float = 0.02) -> Model:
    """n, total and outer: by class, the count and the sums of x and of x x'."""
    d = total.shape[1]
    if (n < 2).any():
        return Model(np.zeros((0, d)), np.zeros((0, d, d)), np.zeros(0), float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = total / n[:, None]
    own = [outer[c] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factor, constant = [], []
    for c in (0, 1):
        s = (1 - shrink) * own[c] + shrink * pooled
        s = (1 - sphere) * s + sphere * np.diag(np.maximum(np.diag(pooled), 1e-4)) + 1e-6 * np.eye(d)
        low = np.linalg.cholesky(s)
        factor.append(np.linalg.inv(low))
        constant.append(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    return Model(mean, np.array(factor), np.array(constant), float(n[1] / n.sum()))


def _statistics_kernel():
    def work(texts: pa.Array) -> list[pa.Array]:
        x = statistics(texts)
        return [pa.array(x[:, k]) for k in range(x.shape[1])]

    return work


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", id_col: str = "doc_id", shrink: float = 0.1, sphere: float = 0.02) -> Model:
    """Fits to all of docs that have a label 0 or 1: leave out what must not be learnt.

    The statistics are made before the join by id, so that no text is shuffled.
    """
    fields = [T.StructField(f"x{k}", T.DoubleType()) for k in range(len(STATISTICS))]
    d = len(fields)
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    x = tables.add_columns(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "body", fields, _statistics_kernel, keep=["id"]).join(known, "id")
    pairs = [(a, b) for a in range(d) for b in range(a, d)]
    sums = [F.sum(f"x{k}").alias(f"s{k}") for k in range(d)] + [F.sum(F.col(f"x{a}") * F.col(f"x{b}")).alias(f"p{a}_{b}") for a, b in pairs]
    n, total, outer = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for row in x.groupBy("label").agg(F.count("*").alias("n"), *sums).collect():
        c = row["label"]
        n[c] = row["n"]
        total[c] = [row[f"s{k}"] for k in range(d)]
        for a, b in pairs:
            outer[c, a, b] = outer[c, b, a] = row[f"p{a}_{b}"]
    return fit_moments(n, total, outer, shrink, sphere)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score_as: str = "score") -> DataFrame:
    """docs with the score of each whole text; no shuffle."""

    def kernel():
        return lambda texts: [pa.array(model.score(statistics(texts)), pa.float64())]

    return tables.add_columns(docs, text_col, [T.StructField(score_as, T.DoubleType())], kernel, keep)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(tables.trainable()), tables.read(spark, sf_dir, "labels").filter(tables.trainable()))
    scored = predict(docs.select("doc_id", "text", tables.held_out().alias("held_out")), model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
