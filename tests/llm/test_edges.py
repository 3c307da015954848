"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for all operators and stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import classify, decontaminate, lines, minhash, pieces, pii, quality, secrets, sharding, substrings, urls

RUN = " ".join(f"word{i}" for i in range(70))
TEXTS = [None, "", " \n", RUN, RUN, RUN + " more", "x " * 60_000, "short text", "a\n" * 4000, RUN.replace("word1", "wort1")]
#: Names that the operators use inside.
CLASH = ["k", "t", "key", "rep", "bucket", "shard", "slot", "h", "n_words", "n_hit", "items", "measures", "failed", "spans", "component_id", "kept", "ids", "x", "doc", "row", "runs", "url_verdict"]


def _docs(spark, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[0]]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}) if extra else df


def _items(spark):
    return spark.createDataFrame([(1, " ".join(RUN.split()[:13])), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "op1": lambda s, d: substrings.substring_dedup(d).select("doc_id", "n_removed"),
    "op1_texts": lambda s, d: substrings.dedup_texts(d.dropDuplicates(["doc_id"])).select("doc_id", "text"),
    "op2": lambda s, d: pii.detect(d).select("doc_id", F.size("spans").alias("n")),
    "op3": lambda s, d: sharding.external_shuffle(d, ["doc_id", "text"], 3, sharding.record_size()).groupBy("shard").count(),
    "op4": lambda s, d: quality.ledger(d).select("doc_id", "failed"),
    "op5": lambda s, d: decontaminate.contamination(d, _items(s)).select("doc_id", "n_hit"),
    "op6": lambda s, d: minhash.near_duplicates(d).select("doc_id", "component_id"),
    "op7": lambda s, d: d.select("doc_id", pieces.Pieces(s).encode(F.col("text")).alias("a")),
    "op8": lambda s, d: d.select("doc_id", F.hash(classify.statistics_of(F.col("text"))).alias("a")),
    "op9": lambda s, d: urls.url_filter(d.withColumn("url", F.concat(F.lit("http://a.org/"), "text"))).select("doc_id", "url_verdict"),
    "op10": lambda s, d: lines.line_dedup(d).select("doc_id", "n_removed_lines"),
    "op12": lambda s, d: secrets.detect(d).select("doc_id", F.size("spans").alias("n")),
    **{f"stage {n}": (lambda f: lambda s, d: f(s, d, "/root/testdata/sf0.001").select("doc_id"))(f) for n, f in corpus_pipeline.STAGES},
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_change_nothing(spark, name):
    plain = sorted(map(repr, OPERATORS[name](spark, _docs(spark)).collect()))
    assert plain == sorted(map(repr, OPERATORS[name](spark, _docs(spark, extra=True)).collect()))
    if name in ("op2", "op4", "op5", "op7", "op8", "op9", "op10", "op12"):
        assert len(plain) == len(TEXTS) + 2


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, _docs(spark).limit(0)).count() == 0


def test_repeated_rows_have_one_result(spark):
    for name in ("op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op12"):
        rows = {repr(r) for r in OPERATORS[name](spark, _docs(spark)).collect() if r.doc_id == 3}
        assert len(rows) == 1, name


def test_stages_keep_their_columns(spark):
    docs = _docs(spark, extra=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == corpus_pipeline.COLUMNS
