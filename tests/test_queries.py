"""Every registered query with SQL against it on the smallest tables."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from millrace.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, float):
        return None if x != x else float(f"{x:.9g}")
    return None if x is None or (not hasattr(x, "__len__") and pd.isna(x)) else x


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(_value(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_part(tmp_path):
    """A copy without that part still offers all other queries."""
    root = Path(__file__).parent.parent
    shutil.copytree(root / "millrace", tmp_path / "millrace", ignore=lambda _, names: {"llm", "__pycache__"} & set(names))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}).stdout
    assert json.loads(out) == [sorted(QUERIES), sorted(ORACLE_SQL)]


@pytest.mark.parametrize("name", "bm25_phrases retrieval_metrics search_words search_pipeline bm25_topk bm25_fields_and assembled_results reranked_results bm25_stemmed".split())
def test_a_batch_of_searches_builds_no_index(spark, monkeypatch, name):
    """Postings of words that nobody asks for are neither shuffled nor written."""
    from millrace.operators import lexical

    def never(*_, **__):
        raise AssertionError("an index was built")

    monkeypatch.setattr(lexical, "build", never)
    assert QUERIES[name](spark, DATA).count() >= 0
