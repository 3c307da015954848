"""Centroid clustering: Lloyd's rounds over distinct integer vectors with multiplicities.

Equal vectors always share a centroid, so a round only has to see each of them once, weighted by how many there are.
A third of all rows with one vector is one row of the rounds. Sums are integers, so no order of adding changes a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._codes import coded, unpack
from ._work import looked_up, written

_LONG = (1 << 63) - 1


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """The number of each row's nearest centroid (ties: the smaller) and their squared distance, both exact.

    Where all products and their sums stay below 2**53 a float product is exact; otherwise Python's integers are used.
    """
    if not len(rows):
        return np.zeros(0, np.int64), []
    most = max(int(np.abs(rows).max()), max(abs(x) for c in centroids for x in c))
    small = 8 * most * most * rows.shape[1] < 1 << 53
    x = rows.astype(np.float64) if small else rows.astype(object)
    c = np.array(centroids, np.float64 if small else object).reshape(len(centroids), rows.shape[1])
    far = (x * x).sum(axis=1)[:, None] - 2 * x.dot(c.T) + (c * c).sum(axis=1)[None]
    own = far.argmin(axis=1)
    return own.astype(np.int64), [int(v) for v in far[np.arange(len(rows)), own]]


def _round(centroids: list[list[int]], dim: int):
    """One row (cluster, n, sums) for each cluster that a task has vectors of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = {}, {}
        for b in batches:
            rows, weight = unpack(b.column(0), dim), b.column(1).to_numpy()
            own, _ = nearest(rows, centroids)
            for c in np.unique(own).tolist():
                at = own == c
                part = rows[at]
                small = int(np.abs(part).max()) * int(weight[at].sum()) < 1 << 62
                added = (part * weight[at][:, None]).sum(axis=0) if small else (part.astype(object) * weight[at].astype(object)[:, None]).sum(axis=0)
                count[c] = count.get(c, 0) + int(weight[at].sum())
                sums[c] = [a + int(v) for a, v in zip(sums.get(c, [0] * dim), added, strict=True)]
        if count:
            keys = sorted(count)
            whole = pa.array([[Decimal(v) for v in sums[c]] for c in keys], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([count[c] for c in keys], pa.int64()), whole], names=["cluster", "n", "sums"])

    return run


def _assign(centroids: list[list[int]], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, far = nearest(unpack(b.column(0), dim), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array([v if v <= _LONG else None for v in far], pa.int64())], names=["code", "n", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, key: str, k: int, dim: int, seed: int = 1) -> list[list[int]]:
    """The vectors of the k rows with the smallest sha256 of seed:key, in that order; ties by the vector's bytes.

    Rows without a key come last. Each task keeps k rows, so the driver sees k.
    """
    order = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), F.lit("g"))
    chosen = rows.select(order.alias("o"), "code").orderBy("o", "code").limit(k).select("code").toArrow().column("code").combine_chunks()
    return unpack(chosen, dim).tolist()


def moved(distinct: DataFrame, centroids: list[list[int]], dim: int) -> list[list[int]]:
    """Each centroid replaced by the floor of the mean of its vectors; those without vectors stay. k rows reach the driver."""
    parts = distinct.select("code", "n").mapInArrow(_round(centroids, dim), "cluster int, n long, sums array<decimal(38,0)>")
    sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
    out = [list(c) for c in centroids]
    for r in sums.collect():
        out[r.cluster] = [int(s) // r.n for s in r.sums]
    return out


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, factor: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """((key, cluster int, distance long, cluster_inertia long, inertia long), final centroids), one row for each kept row.

    Kept are the rows whose vector has dim components, none of them null or non-finite, whatever their key: a null key
    stays, and repeated rows each count and each have their result. Components become floor(factor * x), held within
    2**56. Fewer than k kept rows give as many centroids, none an empty table and no centroids. A squared distance that
    no long holds is null, and so are the inertias that it is part of. Any other columns of df are left out.
    """
    spark = df.sparkSession
    rows = written(coded(df, key, vector, factor, dim), "codes")
    # equal codes are counted in each task before they meet
    distinct = written(rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "distinct-codes")
    centroids = first_centroids(rows, key, k, dim, seed)
    types = dict(df.dtypes)
    if not centroids:
        return spark.createDataFrame([], f"`{key}` {types[key]}, cluster int, distance long, cluster_inertia long, inertia long"), centroids
    for _ in range(rounds):
        centroids = moved(distinct, centroids, dim)
    found = written(distinct.select("code", "n").mapInArrow(_assign(centroids, dim), "code binary, n long, cluster int, distance long"), "assigned")
    each: list[int | None] = [0] * len(centroids)
    for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)") * F.col("n")).alias("s"), F.count_if(F.col("distance").isNull()).alias("wide")).collect():
        each[r.cluster] = None if r.wide else int(r.s)
    total = None if None in each else sum(each)
    fits = lambda v: F.lit(v if v is not None and v <= _LONG else None).cast("long")
    out = looked_up(rows, found, ["code"])
    return out.select(key, "cluster", "distance", F.get(F.array(*map(fits, each)), F.col("cluster")).alias("cluster_inertia"), fits(total).alias("inertia")), centroids
