"""Published versions with failing and rival writers, and vector tables with reuse, removal and lost sidecars."""

import shutil

import numpy as np
import pytest

from millrace.operators import dense
from millrace.sources import vector_table, versions


def test_a_failed_write_changes_nothing(spark, tmp_path):
    v = versions.Versions(spark, str(tmp_path))
    assert v.current() is None

    def write(n, fail=False):
        def run(folder):
            spark.range(n).write.parquet(f"{folder}/a")
            if fail:
                raise RuntimeError("lost")
            spark.range(2 * n).write.parquet(f"{folder}/b")
            return {"rows": n}

        return run

    first = v.publish(write(3))
    with pytest.raises(RuntimeError):
        v.publish(write(5, fail=True))
    assert v.current().number == 1 and v.current().table("b").count() == 6 and v.current().meta == {"rows": 3}
    second = v.publish(write(7), expected=1)
    assert (second.number, v.current().table("a").count()) == (2, 7)
    assert first.table("a").count() == 3  # an old reader still sees what it opened
    with pytest.raises(FileExistsError):
        v.publish(write(9), expected=1)
    with pytest.raises(FileExistsError):
        v.publish(lambda folder: v.publish(write(8)) and None)  # another writer comes first
    assert v.current().number == 3 and v.current().table("a").count() == 8
    assert len(v.vacuum(keep=1)) == 3 and v.numbers() == [3] and v.current().table("b").count() == 16


def test_another_layout_is_an_error(spark, tmp_path, monkeypatch):
    v = versions.Versions(spark, str(tmp_path))
    v.publish(lambda folder: spark.range(1).write.parquet(f"{folder}/a"))
    monkeypatch.setattr(versions, "SCHEMA_VERSION", 2)
    with pytest.raises(versions.SchemaMismatch):
        v.current()


def test_vector_table(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    plain = dense.hashed(8)

    def make():
        model = plain.make()

        def run(texts):
            seen.add(len(texts))
            return model(texts)

        return run

    model = dense.Embedder("org/small", 8, make)
    table = vector_table.VectorTable(spark, str(tmp_path), model)
    chunks = lambda rows: spark.createDataFrame(rows, "chunk_id long, body string")
    rows = [(i, f"text {i}") for i in range(200)]

    def embedded(rows):
        before = seen.value
        at = table.refresh(chunks(rows))
        return at, seen.value - before

    at, n = embedded(rows)
    assert n == 200 and at.meta["rewritten"] == at.meta["ranges"] <= vector_table.RANGES
    at, n = embedded(rows[::-1])
    assert (n, at.meta["rewritten"]) == (0, 0)
    changed = [(i, t if i != 5 else "other") for i, t in rows if i != 9] + [(900, None)]
    at, n = embedded(changed)
    assert n == 2 and 1 <= at.meta["rewritten"] <= 3
    got = {r.chunk_id: r for r in table.read().collect()}
    assert got.keys() == {i for i, _ in changed} and {i for i, r in got.items() if r.since == at.number} == {5, 900}
    want = plain.make()([t or "" for _, t in changed])
    assert all(np.allclose(got[i].embedding, w) for (i, _), w in zip(changed, want, strict=True))
    shutil.rmtree(f"{at.folder}/sidecar")
    assert embedded(changed)[1] == len(changed)
    other = vector_table.VectorTable(spark, str(tmp_path), dense.Embedder("org/large", 8, make))
    assert other.refresh(chunks(rows[:3])).number == 1 and other.read().count() == 3
    assert table.read().count() == len(changed)
    assert embedded([])[1] == 0 and table.read().count() == 0
