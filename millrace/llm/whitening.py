"""Embedding whitening: singular value decompositions of partitions, merged level by level without losing a dimension.

A summary of vectors is their number, exact sums, mean, and all singular values and right vectors of the centred rows.
Two summaries are merged by stacking both sets of scaled right vectors over a row for the distance of the means, and
decomposing again; what comes out is the summary of all their vectors, whatever the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._codes import coded, unpack, whole
from ._work import written

#: Vectors that are decomposed at once in a task, and summaries that are merged in one.
BLOCK, FAN_IN = 8192, 16
_LONG = (1 << 63) - 1
_SCHEMA = "id long, n long, sums array<decimal(38,0)>, mean array<double>, scaled array<double>"


@dataclass(frozen=True)
class Summary:
    """n vectors: exact sums, their mean, and the singular values times the right vectors of the centred rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scaled: np.ndarray


def _decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors: as many rows as there are dimensions at most."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def summary(rows: np.ndarray) -> Summary:
    """Of a block of integer vectors."""
    edge = int(np.abs(rows).max()) * len(rows)
    sums = [int(v) for v in (rows if edge < 1 << 62 else rows.astype(object)).sum(axis=0)]
    mean = np.array([v / len(rows) for v in sums])
    return Summary(len(rows), sums, mean, _decomposed(rows - mean))


def merged(a: Summary, b: Summary) -> Summary:
    n = a.n + b.n
    sums = [x + y for x, y in zip(a.sums, b.sums, strict=True)]
    apart = np.sqrt(a.n / n * b.n) * (a.mean - b.mean)
    return Summary(n, sums, np.array([v / n for v in sums]), _decomposed(np.vstack([a.scaled, b.scaled, apart])))


def _row(i: int, s: Summary) -> dict:
    return {"id": i, "n": s.n, "sums": [Decimal(v) for v in s.sums], "mean": s.mean.tolist(), "scaled": s.scaled.ravel().tolist()}


def _read(n, sums, mean, scaled) -> Summary:
    return Summary(int(n), [int(v) for v in sums], np.array(mean, float), np.array(scaled, float).reshape(-1, len(mean)))


def _of_task(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = summary(unpack(b.column(0).slice(i, BLOCK), dim))
                out = part if out is None else merged(out, part)
        if out is not None:
            r = _row(TaskContext.get().partitionId(), out)
            arrays = [pa.array([r["id"]], pa.int64()), pa.array([r["n"]], pa.int64()), pa.array([r["sums"]], pa.list_(pa.decimal128(38, 0))), pa.array([r["mean"]], pa.list_(pa.float64())), pa.array([r["scaled"]], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=list(r))

    return run


def _merge_group(rows: pd.DataFrame) -> pd.DataFrame:
    out = None
    for r in rows.sort_values("id").itertuples(index=False):
        part = _read(r.n, r.sums, r.mean, r.scaled)
        out = part if out is None else merged(out, part)
    return pd.DataFrame([_row(int(rows["id"].iloc[0]) // FAN_IN, out)])


def summarised(codes: DataFrame, dim: int) -> Summary | None:
    """The summary of all codes, FAN_IN summaries of a level in a task at a time; None without rows.

    A summary has dim * (dim + 2) numbers, so neither a merging task nor the driver, which merges the last level, holds
    more than FAN_IN times that.
    """
    level = written(codes.select("code").mapInArrow(_of_task(dim), _SCHEMA), "summaries")
    while level.count() > FAN_IN:
        level = written(level.groupBy(F.expr(f"id div {FAN_IN}").alias("g")).applyInPandas(_merge_group, _SCHEMA), "summaries")
    out = None
    for r in level.orderBy("id").collect():
        part = _read(r.n, r.sums, r.mean, r.scaled)
        out = part if out is None else merged(out, part)
    return out


@dataclass(frozen=True)
class Whitening:
    """n, exact sums, eigenvalues (falling, all of them) and unit eigenvectors as rows, of the covariance with divisor n."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(s: Summary) -> Whitening:
        """Signs are such that each vector's largest component is positive."""
        dim = len(s.mean)
        _, singular, vt = np.linalg.svd(np.vstack([s.scaled, np.zeros((dim, dim))])[: max(dim, len(s.scaled))], full_matrices=True)
        values = np.zeros(dim)
        values[: len(singular)] = singular**2 / s.n
        sign = np.sign(vt[np.arange(dim), np.abs(vt).argmax(axis=1)])
        return Whitening(s.n, s.sums, values, vt * np.where(sign == 0, 1, sign)[:, None])

    @property
    def rank(self) -> int:
        """Components with a variance above what rounding leaves."""
        return int((self.values > self.values[0] * 1e-20).sum()) if len(self.values) and self.values[0] > 0 else 0

    def whitened(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Projections on the first k components over the square roots of the eigenvalues; 0 where there is no variance."""
        centre = np.array([v / self.n for v in self.sums])
        scale = np.array([1 / np.sqrt(e) if i < self.rank else 0.0 for i, e in enumerate(self.values[:k])])
        return (rows - centre) @ self.vectors[:k].T * scale

    def deviation(self, rows: np.ndarray) -> list[int]:
        """sum((n * x - S)**2), exactly, as n**2 sum(x**2) - 2 n sum(x * S) + sum(S**2)."""
        most, sums = int(np.abs(rows).max()) if rows.size else 0, np.array(self.sums, object)
        edge = most * max(most, *(abs(v) for v in self.sums)) * rows.shape[1]
        x = rows if edge < 1 << 62 else rows.astype(object)
        s = sums.astype(np.int64) if edge < 1 << 62 else sums
        c = int((sums * sums).sum())
        return [self.n * self.n * int(a) - 2 * self.n * int(b) + c for a, b in zip((x * x).sum(axis=1), x.dot(s), strict=True)]


def commonest_length(df: DataFrame, vector: str) -> int:
    """The number of components that most finite vectors have (ties: the greater); 0 without vectors."""
    sizes = df.filter(whole(F.col(vector).cast("array<double>"))).groupBy(F.size(vector).alias("d")).count().filter("d > 0")
    top = sizes.orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return top.d if top else 0


def fit(codes: DataFrame, dim: int) -> Whitening | None:
    """Over each distinct code once; codes is a written table."""
    s = summarised(codes, dim)
    return None if s is None else Whitening.of(s)


def identity_error(distinct: DataFrame, model: Whitening, dim: int, k: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity; 0.0 without a variance.

    Means first, then the products of what is left of them: both are sums by Spark.
    """
    k = min(k, model.rank)
    if not k:
        return 0.0
    w = F.arrow_udf(lambda codes: pa.array(list(model.whitened(unpack(codes, dim), k)), pa.list_(pa.float64())), "array<double>")(F.col("code"))
    rows = distinct.select(w.alias("w"))
    m = rows.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    off = [F.col("w")[i] - F.lit(m[i]) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    c = rows.agg(*[F.avg(off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, c, strict=True))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int | None = None, factor: int = 256) -> DataFrame:
    """(key, component int, n long, deviation long, whitened double, explained double, identity_error double).

    One row for each kept row and component up to k (all, if None). Kept are rows whose vector is there, finite in each
    entry and of the commonest length (ties: the greater); null keys stay, and repeated rows each have their result,
    while the fit takes each distinct integer vector once. Entries become floor(factor * c), held within 2**56. A
    component without variance has whitened and explained 0.0. A deviation that no long holds is null. An empty table,
    or one without vectors, gives no rows. Any other columns of df are left out.
    """
    spark, types = df.sparkSession, dict(df.dtypes)
    dim = commonest_length(df, vector)
    schema = f"`{key}` {types[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dim:
        return spark.createDataFrame([], schema)
    rows = written(coded(df, key, vector, factor, dim), "codes")
    distinct = written(rows.select("code").distinct(), "distinct-codes")
    model = fit(distinct, dim)
    k = min(k or dim, dim)
    error = identity_error(distinct, model, dim, k)
    trace = float(model.values.sum())
    explained = [float(e) / trace if i < model.rank else 0.0 for i, e in enumerate(model.values[:k])]

    def batch(codes: pa.Array) -> pa.Array:
        x = unpack(codes, dim)
        far = [v if v <= _LONG else None for v in model.deviation(x)]
        return pa.StructArray.from_arrays([pa.array(far, pa.int64()), pa.array(list(model.whitened(x, k)), pa.list_(pa.float64()))], names=["deviation", "w"])

    out = rows.select(key, F.arrow_udf(batch, "deviation long, w array<double>")(F.col("code")).alias("r"))
    out = out.select(key, "r.deviation", F.posexplode("r.w").alias("c", "whitened"))
    shares = F.array(*map(F.lit, explained))
    return out.select(key, (F.col("c") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("c")).alias("explained"), F.lit(float(error)).alias("identity_error"))
