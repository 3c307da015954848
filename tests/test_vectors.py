"""The vector index against all distances: ties, repeated and odd vectors, hot cells, several lengths, codes."""

import numpy as np
import pytest

from millrace.operators import vectors


def _rows(seed=1):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 5, (12, 8))
    m = [centres[i % 12] + rnd.normal(0, 0.5, 8) for i in range(500)] + [centres[3]] * 250  # a third in one place
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.array(m, np.float32))]
    return rows + [(2000 + i, [float(i), 1.0]) for i in range(5)] + [(3000, None), (3001, []), (3002, [float("nan")] * 8), (3003, [None] * 8), (3004, [0.0] * 8), (3005, [1e30] * 8)]


def _plain(rows, asked, k):
    out = {}
    ok = lambda v: v and all(x is not None and np.isfinite(x) for x in v)
    for q, v in asked:
        if ok(v):
            far = [(float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows if ok(w) and len(w) == len(v)]
            out[q] = sorted(far)[:k]
    return out


@pytest.mark.parametrize("coded", [False, True])
@pytest.mark.parametrize("k", [1, 7, 300])
def test_nearest(spark, monkeypatch, coded, k):
    monkeypatch.setattr(vectors, "PART", 40)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    rows = _rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = [rows[i] for i in (0, 1, 2, 3, 4, 5, 501, 502, 503, 504)] + [(9000, [0.5] * 8), (9001, [2.2, 1.0]), (9002, None), (9003, [1.0] * 5), (9004, [float("inf")] * 8), (9005, [1e29] * 8)]
    q = spark.createDataFrame(asked, "query_id long, embedding array<float>")
    looked = {}
    index = vectors.build(df)
    got = {}
    for r in vectors.nearest(index, q, k, coded=coded, looked=looked).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.distance, r.score))
    narrow = lambda rs: [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rs]
    want = {i: v for i, v in _plain(narrow(rows), narrow(asked), k).items() if v}
    assert got.keys() == want.keys()
    for i, near in want.items():
        mine = sorted(got[i])
        assert [c for _, c, _, _ in mine] == [c for _, c in near], i
        assert np.allclose([d for _, _, d, _ in mine], [d for d, _ in near], rtol=1e-12, atol=1e-12)
        assert all(abs(s - 1 / (1 + d)) < 1e-12 for _, _, d, s in mine)
    counts = {r.query_id: r for r in vectors.parts_looked_at(index, looked).collect()}
    assert all(r.n_looked_at <= r.n_parts for r in counts.values()) and counts[9003].n_parts == 0
    if k == 7:
        assert counts[0].n_looked_at < 0.5 * counts[0].n_parts


def test_round_trip_and_empty(spark, tmp_path):
    df = spark.createDataFrame(_rows(), "vec_id long, embedding array<float>")
    index = vectors.build(df)
    index.write(str(tmp_path))
    q = df.filter("vec_id in (1, 600, 2003)").withColumnRenamed("vec_id", "query_id")
    assert sorted(vectors.nearest(index, q, 4).collect()) == sorted(vectors.nearest(vectors.VectorIndex.read(spark, str(tmp_path)), q, 4).collect())
    assert vectors.nearest(vectors.build(df.limit(0)), q, 4).count() == 0
    assert vectors.nearest(index, q.limit(0), 4).count() == 0


def test_codes_bound_distances():
    m = np.random.default_rng(0).normal(0, 3, (50, 16))
    m[7] = 0
    code, scale, off = vectors._coded(m)
    assert np.allclose(np.sqrt(((m - scale[:, None] * code) ** 2).sum(1)), off) and off[7] == 0 and (off < 0.5 * np.sqrt(16) * scale + 1e-12).all()


@pytest.mark.parametrize("coded", [False, True])
def test_queries_are_not_copied_for_each_part(spark, monkeypatch, coded):
    """All neighbours of all vectors: what a search writes besides its result grows with the vectors, not with vectors times parts."""
    monkeypatch.setattr(vectors, "PART", 8)
    df = spark.createDataFrame(_rows(), "vec_id long, embedding array<float>")
    index, counts, settled = vectors.build(df), {}, vectors.settled

    def counted(table, name="settled"):
        out = settled(table, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(vectors, "settled", counted)
    n = vectors.nearest(index, df.withColumnRenamed("vec_id", "query_id"), 5, coded=coded).count()
    assert n == 757 * 5  # all that are there, finite and not empty
    assert counts.get("wanted", 0) + counts.get("looks", 0) <= 2 * 757


def test_pairs_keep_all_that_rounding_could_lose():
    rnd = np.random.default_rng(3)
    for scale in (1e-30, 1.0, 1e12, 1e30):
        q, m = rnd.normal(0, 1, (30, 16)) * scale, rnd.normal(0, 1, (40, 16)) * scale
        far = np.sqrt(((q[:, None] - m[None]) ** 2).sum(2))
        most = np.sort(far, 1)[:, 4]
        got = set(zip(*vectors._pairs(q, m, most, True), strict=True))
        assert {(i, j) for i, j in zip(*np.nonzero(far <= most[:, None]), strict=True)} <= got and len(got) <= 30 * 8
