"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._vec import binary
from .quality import measure

STATISTICS = ("words", "word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "lettered", "distinct", "stops", "bangs", "line_length", "foreign", "digits")
_DROP = {k: bytes(b for b in range(256) if b not in v) for k, v in (("stops", b".,;:?"), ("bangs", b"!"), ("digits", b"0123456789"))}
_ASCII = bytes(range(128))


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a text, each transformed so that classes are nearer to normal; all 0 without a word."""
    n, chars, symbols, dup, rep, lines, letters, capitals, lettered = measure(text)
    if not n:
        return [0.0] * len(STATISTICS)
    count = {k: len(text.translate(None, drop)) for k, drop in _DROP.items()}
    foreign = len(text.translate(None, _ASCII))
    return [
        np.log1p(n), np.log(chars / n), np.log1p(20 * symbols / n), (dup / lines) ** 0.5, (rep / n) ** 0.5,
        (capitals / letters) ** 0.5 if letters else 0.0, (lettered / n) ** 2, (len(set(text.split())) / n) ** 0.5,
        np.log1p(10 * count["stops"] / n), np.log1p(10 * count["bangs"] / n), np.log(n / lines), (foreign / len(text)) ** 0.5,
        (count["digits"] / chars) ** 0.5,
    ]


def statistics_of(text: Column) -> Column:
    """array<double> of the STATISTICS; a null text counts as empty."""

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(x.as_py()) for x in binary(texts)], pa.list_(pa.float64()))

    return F.arrow_udf(batch, "array<double>")(text)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes, and the log prior odds of class 1."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    log_dets: tuple[float, float]
    log_odds: float

    def log_density_difference(self, x: np.ndarray) -> np.ndarray:
        side = []
        for c in (0, 1):
            y = (x - self.means[c]) @ self.factors[c].T  # whitened: its square is the Mahalanobis distance
            side.append(-0.5 * ((y * y).sum(axis=1) + self.log_dets[c]))
        return self.log_odds + side[1] - side[0]


def fit(rows: DataFrame, x: str, label: str, shrinkage: float = 0.1, ridge: float = 0.02) -> Discriminant:
    """Fit on all rows with label 0 or 1: sums and products are added up by Spark, d*d numbers reach the driver.

    Each class's covariance is shrunk towards the pooled diagonal, and a share (ridge) of the pooled variance is added.
    Rows with another or null label are left out. A class without rows takes the other's place at odds of 1:1; without
    any rows every score is 0.5.
    """
    d = len(STATISTICS)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    v = [F.col(x)[i] for i in range(d)]
    sums = rows.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(a) for a in v]).alias("s"), F.array(*[F.sum(v[i] * v[j]) for i, j in pairs]).alias("p"))
    n, mean, cov = [0, 0], [np.zeros(d)] * 2, [np.zeros((d, d))] * 2
    for r in sums.collect():
        n[r.c], mean[r.c] = r.n, np.array(r.s) / r.n
        full = np.zeros((d, d))
        for (i, j), p in zip(pairs, r.p, strict=True):
            full[i, j] = full[j, i] = p / r.n
        cov[r.c] = full - np.outer(mean[r.c], mean[r.c])
    if not all(n):
        have = 0 if n[0] else 1
        mean, cov = [mean[have]] * 2, [cov[have]] * 2
    pooled = np.diag((n[0] * cov[0] + n[1] * cov[1]) / max(1, sum(n))) + 1e-6
    factors, dets = [], []
    for c in (0, 1):
        shrunk = (1 - shrinkage) * cov[c] + np.diag((shrinkage + ridge) * pooled)
        low = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(low))
        dets.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(tuple(mean), tuple(factors), tuple(dets), float(np.log(n[1] / n[0])) if all(n) else 0.0)


def score(x: Column, model: Discriminant) -> Column:
    """Chance of class 1, in [0, 1]."""

    def batch(rows: pa.Array) -> pa.Array:
        values = np.asarray(rows.flatten(), float).reshape(len(rows), -1)
        odds = model.log_density_difference(values) if len(rows) else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))

    return F.arrow_udf(batch, "double")(x)
