"""Operator 5: quality classifier, a regularised quadratic discriminant.

Every document becomes a short vector of transformed text statistics (never
its label, language, source or id). The labelled training rows give each
class a mean and a covariance, shrunk towards the pooled one and towards a
scaled identity; the score is the posterior of class 1 from the difference of
the two Gaussian log-densities, with Mahalanobis distances through cached
Cholesky factors. All labelled rows are used: counts, sums and products per
class are one aggregation, so the driver gets two rows whatever the input.

Defined results: null text is empty; empty text has a vector and a score;
labels that are null or not 0 or 1 are ignored, repeated labels count
repeatedly; without rows of both classes every score is the smoothed share of
class 1; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TO_POOLED, TO_IDENTITY = 0.2, 0.05
STATISTICS = ("words", "word_size", "upper", "digit", "symbol", "exclaim", "other_punct", "beyond_ascii",
              "line", "distinct", "top_word", "stutter", "repeated_pairs", "dup_lines", "packed")

_KIND = np.zeros(256, np.int64)  # kinds of bytes
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b"\"'(),-./:;?@[\\]^_`{}~+=",
                             bytes(range(128, 256)), b"\n", b" \t\r\v\f"), 1):
    _KIND[list(_chars)] = _k


def vector(data: bytes) -> list[float]:
    """The statistics of one text (UTF-8), each in a range where classes look about normal."""
    n = max(len(data), 1)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=9)
    words = data.split()
    m = max(len(words), 1)
    each = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in data.split(b"\n") if x.strip()]
    upper = kinds[1] + 0.5 * max(sum(1 for c in data.decode("utf-8", "replace") if c.isupper()) - kinds[1], 0) \
        if kinds[6] > 0.02 * n else kinds[1]
    part = lambda k: float(np.sqrt(k / n))
    return [
        float(np.log1p(len(words))), float(np.log1p(sum(map(len, words)) / m)), part(upper), part(kinds[2]),
        part(kinds[3]), part(kinds[4]), part(kinds[5]), part(kinds[6]), part(kinds[7]),
        float(np.log(max(len(each), 1)) / np.log(m + 1)), float(np.sqrt(max(each.values(), default=0) / m)),
        float(np.sqrt(sum(a == b for a, b in zip(words, words[1:])) / m)),
        float(np.sqrt(1 - pairs / max(len(words) - 1, 1))) if len(words) > 1 else 0.0,
        float(np.sqrt(1 - len(set(lines)) / max(len(lines), 1))) if lines else 0.0,
        float(np.log((len(zlib.compress(data, 1)) + 20) / (n + 20))),
    ]


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every document."""
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            x = [vector(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    t = common.texts(docs)
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Discriminant:
    """Two shrunk Gaussians; ``probability`` of class 1."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        n = {k: moments[k][0] if k in moments else 0 for k in (0, 1)}
        self.share = (n[1] + 1) / (n[0] + n[1] + 2)
        self.factors = None
        if min(n.values()) < 2:
            return
        mean = {k: moments[k][1] / n[k] for k in n}
        cov = {k: moments[k][2] / n[k] - np.outer(mean[k], mean[k]) for k in n}
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))  # shrink in units of each statistic
        self.factors = []
        for k in (0, 1):
            c = ((1 - TO_POOLED) * cov[k] + TO_POOLED * pooled) / np.outer(scale, scale)
            c = (1 - TO_IDENTITY) * c + TO_IDENTITY * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
            low = np.linalg.cholesky(c)
            self.factors.append((mean[k], np.linalg.inv(low) / scale, float(np.log(np.diag(low)).sum())))

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.factors is None:
            return np.full(len(x), self.share)
        logs = [-0.5 * (((x - m) @ w.T) ** 2).sum(1) - d for m, w, d in self.factors]
        odds = logs[1] - logs[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(x: DataFrame, labels: DataFrame, held_out: Column) -> Discriminant:
    """Fitted on the vectors of all labelled rows outside ``held_out``."""
    given = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y"))
    rows = x.where(~held_out).join(given, "doc_id")
    d = len(STATISTICS)
    ij = [(i, j) for i in range(d) for j in range(i + 1)]
    got = rows.groupBy("y").agg(F.count("*"), *[F.sum(F.col("x")[i]) for i in range(d)],
                                *[F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in ij]).collect()
    moments = {}
    for y, n, *sums in got:
        products = np.zeros((d, d))
        for (i, j), v in zip(ij, sums[d:]):
            products[i, j] = products[j, i] = v
        moments[y] = (float(n), np.array(sums[:d]), products)
    return Discriminant(moments)


def scored(x: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))
                yield pa.record_batch([batch.column("doc_id"), pa.array(model.probability(values))], ["doc_id", "score"])

    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; learned outside ``held_out``."""
    x = common.stored(vectors(docs), "vectors")
    return (scored(x, fit(x, labels, held_out))
            .select("doc_id", held_out.alias("held_out"), "score",
                    F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")))


def accepted(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier scores at ``threshold`` or more, as they are."""
    model = fit(common.stored(vectors(docs), "vectors"), labels, held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(common.row_texts(batches)):
            x = np.array([vector(t.encode()) for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("row").filter(pa.array(model.probability(x) >= threshold))], ["row"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
