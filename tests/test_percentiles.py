"""Percentiles by narrowing ranges against sorted lists: one group of all rows, ties, far values, nulls."""

import random

import pytest

from millrace.operators import evaluate


def _plain(rows, ps=(50, 95)):
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    return {g: tuple(sorted(vs)[min(len(vs) - 1, len(vs) * p // 100)] for p in ps) for g, vs in groups.items()}


@pytest.mark.parametrize(("rounds", "few"), [(8, 1), (8, 200), (0, 1), (8, 1 << 16)])
def test_by_group(spark, monkeypatch, rounds, few):
    monkeypatch.setattr(evaluate, "_ROUNDS", rounds)
    monkeypatch.setattr(evaluate, "_FEW", few)
    rnd = random.Random(3)
    rows = [("hot", rnd.gauss(0, 1) ** 5) for _ in range(6000)] + [("ties", float(rnd.randrange(3))) for _ in range(500)] + [("one", 4.0), (None, 1.0), (None, 2.0), ("none", None), ("nan", float("nan"))]
    rows += [("far", v) for v in (-1.7e308, 1.7e308, 0.0, 1e-300, 2e-300, -5.0)] + [("even", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    assert {r.g: (r.p50, r.p95) for r in evaluate.percentiles(df, "v", by=["g"]).collect()} == _plain(rows)
    whole = evaluate.percentiles(df, "v", (0, 1, 99, 100)).first()
    assert tuple(whole) == _plain([("all", v) for _, v in rows], (0, 1, 99, 100))["all"]
    assert evaluate.percentiles(df.filter("g = 'none'"), "v", by=["g"]).count() == 0
