import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.lexicon import Lexicon
from millrace.operators import assemble, dense, evaluate, fusion, sections
from millrace.plans import search as engine
from millrace.sources import corpus, reports
from millrace.streaming import ingest


def _cands(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, score double, rank long, route string, category string")


def test_rrf(spark):
    a = _cands(spark, [(1, 10, 9.0, 1, None, None), (1, 11, 8.0, 2, "a/b", "c")])
    b = _cands(spark, [(1, 11, 1.0, 1, "z", "z"), (1, 12, 1.0, 2, None, None)])
    got = {r.chunk_id: r for r in fusion.rrf([a, b]).collect()}
    assert got[11].score == 1 / 62 + 1 / 61 and got[11].route == "a/b" and got[10].score == 1 / 61 and got[12].route is None
    assert {r.chunk_id: r.score for r in fusion.rrf([a, b], (1.0, 0.5)).collect()}[12] == 0.5 / 62


def test_near_duplicates_in_order(spark):
    rows = [(1, i, 10.0 - i, r, t, h) for i, (r, t, h) in enumerate([("a/b/1", "T", "H"), ("a/b/2", "T", "H"), ("a/c/3", "T", "H"), ("a/c/4", "T", "H"), (None, "T", "H"), ("a/b/5", None, "H"), ("a/b/6", "T", None)])]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, route string, title string, heading_path string")
    assert sorted(r.chunk_id for r in fusion.near_duplicates_out(df, [F.col("score").desc()]).collect()) == [0, 2, 3, 4, 5, 6]


def test_boosts_and_filter(spark):
    rows = [(1, 1, "api/orders", None), (1, 2, "payments/test-upi-details", None), (1, 3, "x/errors", "announcements"), (1, 4, None, None)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, route string, category string").withColumns({"score": F.lit(1.0), "tokens": F.array(F.lit("orders"), F.lit("test"), F.lit("upi")), "topic": F.lit("api"), "soft_product": F.lit("x")})
    got = {r.chunk_id: round(r.score, 9) for r in fusion.boosted(df, Lexicon()).collect()}
    assert got == {1: 2.88, 2: 2.05, 3: 1.32, 4: 1.0}
    kept = fusion.only_product(df.withColumn("product", F.lit("payments")), Lexicon()).collect()
    assert [r.chunk_id for r in kept] == [2]


def test_refresh(spark):
    model = dense.hashed(16)
    one = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "chunk_id long, body string")
    first = dense.refresh(one, None, model)
    two = spark.createDataFrame([(1, "a b"), (2, "c d"), (4, "e")], "chunk_id long, body string")
    assert {r.chunk_id: r.reused for r in dense.refresh(two, first, model).collect()} == {1: True, 2: False, 4: False}
    assert dense.Embedder("org/model-x", 1, model.make).slug == "model-x"
    assert dense.embed(one, "body", dense.noop(3)).first().embedding == [0.0, 0.0, 0.0]


MD = """---
title: "Orders"
description: all about orders
---
Preamble text.

## Create

```js: Create an order
create()
```
See [refunds](https://raw.githubusercontent.com/o/r/master/api/refunds.md#x) and [it](https://raw.githubusercontent.com/o/r/master/api/orders.md).

## Long

intro

### One

{a}

### Two

{b}

```what is this
x
```
"""


def test_sections(spark):
    md = MD.replace("{a}", "word " * 500).replace("{b}", "word " * 400)
    df = spark.createDataFrame([("api/orders", 0, md), ("empty", 1, "  \n"), ("plain", 2, "no heading"), ("none", 3, None)], "route string, ordinal long, raw string")
    front = df.select(sections.front_matter(F.col("raw")).alias("f")).first().f
    assert front.fields == {"title": "Orders", "description": "all about orders"} and front.body.startswith("Preamble")
    docs = df.select("route", "ordinal", F.lit("t").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("c").alias("category"), sections.front_matter(F.col("raw"))["body"].alias("body"))
    rows = sorted(sections.chunk_docs(docs).collect(), key=lambda r: r.chunk_id)
    assert [(r.chunk_id, r.route, r.chunk_index, r.heading_path) for r in rows] == [(1, "api/orders", 0, ""), (2, "api/orders", 1, "Create"), (3, "api/orders", 2, "Long"), (4, "api/orders", 3, "Long > One"), (5, "api/orders", 4, "Long > Two"), (6, "plain", 0, "")]
    assert [(b.language, b.label, b.code) for b in rows[1].code_blocks] == [("node", "Create an order", "create()")]
    assert [b.language for b in rows[4].code_blocks] == ["unknown"]
    assert [(x.route, x.anchor) for x in rows[1].cross_links] == [("api/refunds", "x"), ("api/orders", None)]
    assert [(r.route, r.targets) for r in sections.link_graph(sections.chunk_docs(docs)).collect()] == [("api/orders", ["api/refunds"])]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    pages = {
        "api/orders/create": "## Create an order\n\nCreate an order with an amount. ```\n\n```js\norders.create()\n```\n\n```json\n{}\n```\nSee https://raw.githubusercontent.com/o/r/master/api/refunds.md",
        "api/refunds": "## Refund a payment\n\nIssue a refund for an order payment.",
        "webhooks/validate": "## Validate webhooks\n\nVerify the signature of a webhook.\n\n```python\nverify()\n```",
    }
    for route, body in pages.items():
        f = at / "src" / f"{route}.md"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"---\ntitle: front\n---\n{body}")
    routes = {r: {"title": r.upper(), "category": r.split("/")[0], "url": f"https://raw/{r}.md"} for r in [*pages, "api/missing"]}
    (at / "manifest.json").write_text(json.dumps({"version": "1", "generated": "now", "total": 4, "base_url": "b", "routes": routes}))
    rows, missing = corpus.documents(corpus.manifest(spark, str(at / "manifest.json")), corpus.markdown(spark, str(at / "src")))
    assert [r.route for r in missing.collect()] == ["api/missing"]
    counts = corpus.write_index(rows, str(at / "index"), "https://example.com", "abc")
    return str(at / "index"), counts


def test_index_and_search(spark, built):
    folder, counts = built
    assert counts["n_docs"] == 3 and corpus.meta_value(spark, folder, "source_sha") == "abc" and corpus.meta_value(spark, folder, "no") is None
    c = engine.Corpus.read(spark, folder)
    lex = Lexicon(synonyms=(("verify", "validate", "check"),))
    q = spark.createDataFrame([(1, "create an order", None), (2, "how to check a webhook signature", None), (3, "refund", "x"), (4, "zebra", None)], "query_id long, query string, product string")
    got = {}
    for r in engine.search(q, c, lex, k=5).collect():
        got.setdefault(r.query_id, []).append(r)
    assert got[1][0].route == "api/orders/create" and [b.language for b in got[1][0].code_blocks] == ["node", "json"] and [x.route for x in got[1][0].related] == ["api/refunds"]
    assert [r.route for r in got[2]] == ["webhooks/validate"] and 3 not in got and 4 not in got
    model = dense.hashed(32)
    vec = dense.embed(c.chunks.select("chunk_id", "body"), "body", model).select("chunk_id", "embedding")
    wider = engine.search(q, engine.Corpus(c.chunks, c.routes, c.index, c.graph, vec), lex, k=5, embedder=model, reranker=lambda pairs: [float(len(t)) for _, t in pairs]).collect()
    assert {r.query_id for r in wider} >= {1, 2, 4}
    tokens = {r.query_id: r.n_tokens for r in assemble.response_tokens(engine.search(q, c, lex, k=5)).collect()}
    assert tokens[1] > 0


def test_answers(spark, built):
    """Bounds of each field, a query's own k, what it was understood as, and names of models from the session."""
    c = engine.Corpus.read(spark, built[0])
    lex = Lexicon(synonyms=(("verify", "validate", "check"),))
    rows = [
        (1, "how to check a php webhook", None, None, None, None), (2, "order", None, None, None, 1), (3, "order", None, None, None, None), (4, "or", None, None, None, None), (5, None, None, None, None, None),
        (6, "x" * 257, None, None, None, None), (7, "order", "cobol", "no", None, None), (8, "order", None, "no", None, None), (9, "order", None, None, "no", 11), (10, "order", None, None, None, 0), (11, "order", "node", "payments", "api", 10),
    ]
    q = spark.createDataFrame(rows, "query_id long, query string, language string, product string, topic string, k int")
    a = engine.answer(q, c, lex, engine.Settings.of(spark))
    assert {r.query_id: r.problem for r in a.rejected.collect()} == {4: "query", 5: "query", 6: "query", 7: "language", 8: "product", 9: "topic", 10: "k"}
    said = {r.query_id: r for r in a.interpretation.collect()}
    assert set(said) == {1, 2, 3, 11} and said[1].tokens == ["check", "php", "webhook"] and said[1].expanded_terms == ["verify", "validate", "check"]
    assert (said[1].detected_language, said[1].detected_product, said[2].detected_language) == ("php", "payments", None)
    n = dict(a.results.groupBy("query_id").count().collect())
    assert n[2] == 1 and n[3] == 2 and set(n) <= {1, 2, 3, 11}
    assert not engine.answer(q.limit(0), c, lex).results.count()
    assert engine.answer(q.select("query_id", "query"), c, lex, k=1).results.filter("query_id = 3").count() == 1


def test_settings(spark):
    assert engine.Settings.of(spark) == engine.Settings()
    try:
        for k, v in {"index": "s3a://b/i", "embedder": "noop", "reranker": "lost", "default_language": "go"}.items():
            spark.conf.set(f"millrace.{k}", v)
        assert engine.Settings.of(spark) == engine.Settings("s3a://b/i", "noop", None, default_language="go")
        spark.conf.set("millrace.embedder", "lost")
        assert engine.Settings.of(spark).embedder == "hash"
    finally:
        for k in engine.Settings.__dataclass_fields__:
            spark.conf.unset(f"millrace.{k}")


def test_documents(spark, built):
    c = engine.Corpus.read(spark, built[0])
    asked = spark.createDataFrame([("https://example.com/docs/api/refunds/",), ("/api/orders/create/",), ("lost",), ("https://example.com/other",)], "said string")
    got = {r.said: r for r in engine.get_docs(asked, c).collect()}
    assert got["https://example.com/docs/api/refunds/"].found and got["/api/orders/create/"].related[0].route == "api/refunds"
    assert not got["lost"].found and got["https://example.com/other"].route is None


def test_evaluation(spark, tmp_path):
    lines = [{"id": "q001", "query": "first", "expected_routes": ["a"], "acceptable_routes": ["b"]}, {"id": "q002", "query": "second", "expected_routes": ["zz"]}]
    f = tmp_path / "q.jsonl"
    f.write_text("\n".join(json.dumps(x) for x in lines))
    q = corpus.eval_queries(spark, str(f))
    results = spark.createDataFrame([("q001", "x", 1), ("q001", "b", 2), ("q002", "a", 1)], "query_id string, route string, rank long")
    hits = evaluate.first_hit(q, results)
    assert dict(hits.collect()) == {"q001": 2, "q002": 0}
    m = evaluate.metrics(hits)
    row = m.first()
    assert (row.n, row.recall_1, row.recall_3, row.mrr) == (2, 0.0, 0.5, 0.25) and len(evaluate.passes(row, 300)) == 2
    assert [r.route for r in evaluate.missing_routes(q, results).collect()] == ["zz"]
    reports.write_metrics(m, str(tmp_path / "r.md"))
    back = reports.read_metrics(spark, str(tmp_path / "r.md"))
    assert {r.metric: r.change for r in evaluate.compared(back, reports.metric_rows(m)).collect()}["mrr"] == 0.0
    assert reports.query_lines(hits).first().value == "| q001 | 2 |"
    f.write_text(json.dumps({"id": "bad", "query": "x", "expected_routes": []}))
    with pytest.raises(Exception, match="fit"):
        corpus.eval_queries(spark, str(f)).collect()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("r1", "## A\n\nx\n\n## B\n\ny"), ("r2", "z")], "route string, body string").write.parquet(src)
    stream = spark.readStream.schema("route string, body string").parquet(src)
    ingest.embed_stream(stream, str(tmp_path / "out"), dense.hashed(8), str(tmp_path / "ck")).processAllAvailable()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    done = ingest.lint_stream(stream, "route", "body").writeStream.format("memory").queryName("linted").start()
    done.processAllAvailable()
    assert spark.table("linted").count() == 2


def test_rules_report(spark, tmp_path):
    from millrace.operators import lint

    reports.write_rules(lint.rules_table(spark), str(tmp_path / "rules.md"))
    text = (tmp_path / "rules.md").read_text()
    assert text.count("### L") == 30 and text.index("## amount_handling") < text.index("## capture")
