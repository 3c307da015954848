"""Clusters against their SQL and a plain restatement, whitening against an eigendecomposition, on odd vectors too."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import _codes, clusters, queries, whitening

NAN, INF = float("nan"), float("inf")


def _rows(seed=3, n=120, dim=64):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 1, (5, dim))
    out = [(i, (centres[i % 5] + rnd.normal(0, 0.3, dim)).astype(np.float32).tolist(), i % 7) for i in range(n)]
    third = rnd.normal(0, 1, dim).astype(np.float32).tolist()
    out += [(1000 + i, third, 0) for i in range(n // 2)]  # one vector that a third of the rows have
    out += [(2000, None, 1), (2001, [], 1), (2002, [NAN] + [0.0] * (dim - 1), 1), (2003, [INF] * dim, 1), (2004, [None] + [0.0] * (dim - 1), 1), (2005, [1.0] * (dim - 1), 1)]
    out += [(3, out[3][1], 0), (3, out[3][1], 0), (4, out[9][1], 0), (None, out[5][1], 0), (2006, [-0.0] * dim, 0)]
    return out


def _table(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return folder


def _kept(rows, dim=64):
    return [(i, v) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]


def _lloyd(rows, factor=64, k=16, rounds=3):
    """Plainly, with Python's integers."""
    vecs = [(i, [int(np.floor(factor * float(x))) for x in v]) for i, v in _kept(rows)]
    name = lambda i: "g" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    cents = [v for _, v in sorted(vecs, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in vecs]
        for j in range(len(cents)):
            mine = [v for (_, v), o in zip(vecs, own) if o == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    end = [near(v) for _, v in vecs]
    total = [sum(d for d, j in end if j == c) for c in range(len(cents))]
    return sorted(((i, j, d, total[j], sum(total), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(vecs, end)), key=repr)


def test_clusters(spark, tmp_path):
    rows = _rows()
    got = queries.op11_clusters(spark, _table(spark, tmp_path, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _lloyd(rows)


def test_fewer_vectors_than_centroids_and_none(spark, tmp_path):
    few = _rows(n=4)[:3] + [(9, None, 0)]
    got = queries.op11_clusters(spark, _table(spark, tmp_path, few)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _lloyd(few)
    none = queries.op11_clusters(spark, _table(spark, tmp_path, few[3:]))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert queries.op13_whitening(spark, _table(spark, tmp_path, few[3:])).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [float(x) for x in np.random.default_rng(i).integers(-(2**19), 2**19, 64)], 0) for i in range(40)] + [(100, [3e38] * 64, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in clusters.cluster(df)[0].collect()}
    want = {r[0]: r for r in _lloyd(rows[:40])}
    out, _ = clusters.cluster(df.filter("vec_id < 100"))
    assert all((r.cluster, r.distance, r.cluster_inertia) == want[r.vec_id][1:4] for r in out.collect())
    assert len(got) == 41 and all(r.inertia is None for r in got.values()) == (got[100].distance is None)


@pytest.mark.parametrize("most", [127, 128, 2**15, 2**31, 2**40])
def test_codes_come_back(most):
    rows = np.array([[most, -most, 0], [most - 1, -most - 1, 1], [0, 0, 0]], np.int64)
    assert (_codes.unpack(pa.array(_codes.pack(rows), pa.binary()), 3) == rows).all()
    # both ways of measuring agree at the border between them
    c = [[most, 0, 0], [0, 0, -most]]
    own, far = clusters.nearest(rows, c)
    plain = [min((sum((int(a) - b) ** 2 for a, b in zip(r, x)), j) for j, x in enumerate(c)) for r in rows]
    assert [(d, j) for d, j in zip(far, own.tolist())] == plain


def _check_whitening(got, rows, k):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    fit = [list(x) for x in {tuple(v) for _, v in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float)
    x -= x.mean(axis=0)
    cov = x.T @ x / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component, r.deviation), []).append(r)
    assert len(got) == k * len(kept)
    for c in range(k):
        want = (np.array([v for _, v in kept], float) - np.array(sums) / n) @ vectors[:, c] / np.sqrt(values[c])
        far = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for _, v in kept]
        mine = [by[i, c + 1, d][0] for (i, _), d in zip(kept, far)]
        w = np.array([r.whitened for r in mine])
        sign = np.sign(w @ want)
        assert np.abs(w * sign - want).max() < 1e-8
        assert all(r.n == n and abs(r.explained / (values[c] / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-9 for r in mine)


def test_whitening(spark, tmp_path):
    rows = _rows()
    got = queries.op13_whitening(spark, _table(spark, tmp_path, rows)).collect()
    _check_whitening(got, _kept(rows), 4)


def test_whitening_merges_many_summaries(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 3)
    rows = [(i, v, 0) for i, v in _kept(_rows(n=200))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(40)
    codes = _codes.coded(df, "vec_id", "embedding", 256, 64).select("code").distinct().repartition(37)
    whole = whitening.summarised(codes, 64)
    plain = whitening.summary(_codes.unpack(codes.toArrow().column("code").combine_chunks(), 64))
    assert whole.n == plain.n and whole.sums == plain.sums
    a, b = whitening.Whitening.of(whole), whitening.Whitening.of(plain)
    assert np.allclose(a.values, b.values, rtol=1e-9, atol=1e-9 * a.values[0]) and len(a.values) == 64


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(same).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(i, c, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for c in (1, 2)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(4)], "vec_id long, embedding array<float>")
    got = sorted(whitening.whiten(line).collect(), key=lambda r: (r.component, r.vec_id))
    assert [abs(r.whitened) > 0.1 for r in got] == [True] * 4 + [False] * 8 and got[0].explained > 0.999999 and got[0].identity_error < 1e-9


def test_extra_columns_change_nothing(spark):
    df = spark.createDataFrame(_rows(n=30), "vec_id long, embedding array<float>, label int")
    more = df.withColumn("code", F.lit("x")).withColumn("Cluster", F.lit(1)).withColumn("n", F.lit(2)).withColumn("deviation", F.lit(0))
    assert sorted(map(repr, clusters.cluster(df)[0].collect())) == sorted(map(repr, clusters.cluster(more)[0].collect()))
    assert len(whitening.whiten(more, k=2).collect()) == len(whitening.whiten(df, k=2).collect())
