"""Queries against their SQL on the smallest tables, and on hand-made tables with nulls, ties and repeats."""

import os

import duckdb
import pandas as pd
import pytest

from millrace.llm import queries

DATA = "/root/testdata/sf0.001"


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in df.itertuples(index=False)), key=repr)


def _compare(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')" if os.path.isdir(f"{folder}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_given_tables(spark, name):
    _compare(spark, name, DATA)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    run = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", " \n\t ", "# # $ a b c a b c", run, run + "\n" + run, "x\n" + run + "\n\ny", "same line\n" * 80, "É " * 60, "AA BB " * 40, run.upper(), "w " * 30_000, "\n".join(f"{i} alpha beta" for i in range(40)), "\n".join(f"{i} alpha beta" for i in range(5, 45))]
    items = [None, "", "word1 word2 word3", run, "Alpha, beta?", " ".join(f"WORD{i}" for i in range(20, 40))]
    urls = [None, "", "no scheme", "http://", "HTTP://www.Example.com/en/x", "https://example.com/en/", "x://a.example.com/en/?q=casino", "ftp://shop.net/es/1#a", "http://net/fr/", "http://free-bets.org/", "http://a.org/win/bonus", "http://a.org/winbonus", "a://b://c.com/x", "http://é.org/CASINO"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(4, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    vecs = [[float(i % 5)] * 63 + [float(i)] for i in range(20)] + [None, [], [1.0] * 63, [float("nan")] * 64, [None] * 64, [0.0] * 64, [-0.0] * 64]
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_odd_tables(spark, odd, name):
    _compare(spark, name, odd)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_odd_tables_run(spark, odd, name):
    assert queries.QUERIES[name](spark, odd).count() == (88 if name.startswith("op13") else 14)
