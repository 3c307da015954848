"""Sharding, the rule ledger, the classifier, url terms, line runs and the pipeline beyond what SQL compares."""

import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import _work, classify, decontaminate, lines, quality, queries, sharding, urls

DATA = "/root/testdata/sf0.001"


def test_shards(spark):
    rows = queries.op3_sharding(spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        b = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 16, zlib.crc32(b), "rows")
    by = Counter(r.shard for r in rows)
    assert set(by) == set(range(40)) and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    assert rows == queries.op3_sharding(spark, DATA).collect()


def test_whole_records_are_shuffled(spark, monkeypatch):
    shuffle, seen = sharding.external_shuffle, []
    monkeypatch.setattr(sharding, "external_shuffle", lambda *a, **how: seen.append((a[0], shuffle(*a, **how))) or seen[-1][1])
    queries.op3_sharding(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    (given, out), *more = seen
    assert not more and given.columns == docs.columns
    order = lambda df: sorted(df.select(docs.columns).collect(), key=lambda r: r.doc_id)
    assert order(out) == order(docs)


def test_shuffle_is_uniform_and_takes_clashing_names(spark):
    df = spark.range(4000).select((F.col("id") % 7).alias("shard"), F.lit(None).cast("string").alias("slot"), F.col("id").alias("k"), F.lit("x").alias("bucket"))
    rows = sharding.external_shuffle(df, ["k"], 8, F.lit(100), bucket_rows=300).collect()
    early = [r.k for r in rows if r.slot < 250]
    assert len(rows) == 4000 and 1700 < sum(early) / len(early) < 2300
    empty = sharding.external_shuffle(df.limit(0), ["k"], 8, F.lit(1))
    assert empty.count() == 0


def test_write_shards(spark, tmp_path):
    at = str(tmp_path / "shards")
    sharding.write_shards(spark.range(500).withColumnRenamed("id", "k"), at, ["k"], 5, F.lit(10), files_per_shard=2)
    back = spark.read.parquet(at)
    assert back.count() == 500 and back.select("shard").distinct().count() == 5


def test_ablations(spark):
    rows = [("w " * 60,), (None,), ("a b c " * 30,), ("ABC DEF GHI " + " ".join(f"W{chr(65 + i)}Q{chr(65 + j)}" for i in range(8) for j in range(8)),)]
    book = quality.ledger(spark.createDataFrame(rows, "text string"))
    got = {r.rule: r for r in quality.ablations(book).collect()}
    assert got["few_words"].n_fail == 1 and got["capitals"].n_alone == 1
    n_kept = book.filter(quality.passes("v2")).count()
    assert all(r.n_kept_without - n_kept == r.n_alone for r in got.values())
    assert quality.ablations(book.limit(0)).count() == len(quality.POLICIES["v2"])


def test_classifier(spark):
    docs = queries.op8_classifier(spark, DATA).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for r in docs:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    own = [r for r in docs if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in own) >= 0.85 * len(own)


def test_classifier_against_numpy(spark):
    """Scores as plain NumPy has them: shrunk covariances, log densities by solve and slogdet."""
    got = {r.doc_id: r for r in queries.op8_classifier(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    x = {r.doc_id: np.array(classify.statistics((r.text or "").encode())) for r in docs}
    own = {c: np.array([x[d] for d in sorted(x) if labels.get(d) == c and not got[d].held_out]) for c in (0, 1)}
    cov = {c: np.cov(own[c].T, bias=True) for c in own}
    n = {c: len(own[c]) for c in own}
    pooled = np.diag((n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])) + 1e-6

    def log_density(c, v):
        s = 0.9 * cov[c] + np.diag(0.12 * pooled)
        far = v - own[c].mean(0)
        return -0.5 * (far @ np.linalg.solve(s, far) + np.linalg.slogdet(s)[1])

    for d, v in x.items():
        odds = np.log(n[1] / n[0]) + log_density(1, v) - log_density(0, v)
        assert abs(got[d].score - 1 / (1 + np.exp(-odds))) < 1e-6


def test_classifier_without_a_class(spark):
    df = spark.createDataFrame([(1, "a b c", 1), (2, None, 1)], "doc_id long, text string, q int").withColumn("x", classify.statistics_of(F.col("text")))
    for rows in (df, df.limit(0)):
        model = classify.fit(rows, "x", "q")
        assert all(0 <= r.s <= 1 for r in df.select(classify.score(F.col("x"), model).alias("s")).collect())


def test_url_terms(spark):
    rows = ["http://a.com/poker", "http://a.com/poker9", "http://a.com/free", "http://a.com/free-win", "http://a.com/free/free", None]
    out = urls.url_filter(spark.createDataFrame([(u,) for u in rows], "url string")).collect()
    assert [r.url_verdict for r in out] == ["block", "allow", "allow", "block", "allow", "allow"]


def test_line_runs_keep_other_columns(spark):
    run = "\n".join(f"line {i} of the passage with words" for i in range(12))
    df = spark.createDataFrame([(1, "a\n" + run + "\nb", 5), (2, run + "\n\nc", 6), (3, None, 7), (None, run, 8)], "doc_id long, text string, n_runs int")
    out = {r.doc_id: r for r in lines.line_dedup(df).collect()}
    assert out[1].text.startswith("a\nline 0") and out[2].text == "\nc" and out[2].n_removed_lines == 12 and out[None].text == run and out[3].n_lines == 0


def test_many_filter_bits(spark, monkeypatch):
    """A filter that lets everything pass changes no result."""
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(decontaminate.contamination(docs, items).collect())
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 15)
    assert sorted(decontaminate.contamination(docs, items).collect()) == want


def _brute_runs(rows, min_words=50):
    """(key, text) to kept lines: a line goes if a run of lines over it, of min_words words, also starts earlier."""
    texts = sorted({r for r in rows if r[0] is not None and r[1] is not None})
    cut = {r: [(p, x) for p, x in enumerate(r[1].split("\n")) if x.split()] for r in texts}
    seen, gone = set(), {r: set() for r in texts}
    places = [(r, i) for r in texts for i in range(len(cut[r]))]
    for r, i in places:
        own = cut[r]
        for j in range(i, len(own)):
            run = tuple(x for _, x in own[i : j + 1])
            if sum(len(x.split()) for x in run) >= min_words and run in seen:
                gone[r] |= set(range(own[i][0], own[j][0] + 1))
        for j in range(i, len(own)):
            seen.add(tuple(x for _, x in own[i : j + 1]))
    return {r: "\n".join(x for p, x in enumerate(r[1].split("\n")) if p not in gone[r]) for r in texts}


def _check_runs(spark, rows):
    want = _brute_runs(rows)
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(((k, want.get((k, t), t)) for k, t in rows), key=repr)


def test_line_runs_against_brute_force(spark):
    rnd = random.Random(2)
    for words in (1, 7):
        pool = [" ".join(f"{chr(97 + i)}{j}" for j in range(words)) for i in range(6)] + ["", "  "]
        rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 120 // words)))) for i in range(14)]
        rows += [(20 + i, "\n".join([rnd.choice(pool), rows[i][1], rnd.choice(pool)])) for i in range(6)]
        rows += [(30, rows[0][1]), (31, rows[0][1]), rows[1], rows[1], (40, None), (41, ""), (None, rows[0][1])]
        _check_runs(spark, rows)


def test_line_runs_of_hot_keys(spark, monkeypatch):
    """With few keys taken as hot, the rest meets by the shuffle: same result."""
    rows = [(i, "\n".join(["header " * 30, f"line {i % 3} " * 20, "footer " * 30, f"own {i}"])) for i in range(40)]
    want = sorted(map(tuple, lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    monkeypatch.setattr(_work, "HOT", 3)
    assert sorted(map(tuple, lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want
    _check_runs(spark, rows)


def test_repeated_rows_lose_nothing_to_each_other(spark):
    run = "\n".join("one two three four five" for _ in range(1)) + "\n" + "\n".join(f"w{i} " * 6 for i in range(10))
    df = spark.createDataFrame([(1, run), (1, run), (2, run), (3, "x\n" + run)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.line_dedup(df).collect())
    assert got == [(1, run), (1, run), (2, ""), (3, "x")]


def test_very_long_documents_of_lines(spark):
    rnd = random.Random(9)
    body = [f"line {rnd.randrange(10**9)} of a long text" for _ in range(100_000)]
    df = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(["new", *body[10:], "end"]))], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.line_dedup(df).collect()}
    assert got[1].n_removed_lines == 0 and got[2].text == "new\nend" and got[2].n_runs == 1


def test_line_dedup_of_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x", 1)], "doc_id long, text string, n_runs int, k string, t int")
    out = lines.line_dedup(df).collect()
    assert [(r.k, r.t, r.n_runs, r.text) for r in out] == [("x", 1, 0, "a b")]
    assert lines.line_dedup(df.limit(0)).count() == 0


def test_pipeline(spark):
    """Each stage on its own input, by plain restatements; the result is the last one's."""
    from tests.llm.test_minhash import brute

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, DATA).cache()
    lined = corpus_pipeline.line_dedup(spark, kept, DATA).cache()
    near = corpus_pipeline.near_dedup(spark, lined, DATA).cache()
    want = {k for k, (_, _, first) in brute({r.doc_id: r.text for r in lined.collect()}).items() if first}
    assert {r.doc_id for r in near.collect()} == want
    clean = corpus_pipeline.decontamination(spark, near, DATA).cache()
    assert all(d.columns == corpus_pipeline.COLUMNS for d in (kept, lined, near, clean))
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in clean.select("doc_id").collect()} and all(r.restored for r in out)


def test_url_vocabulary_decides(spark):
    """Urls that no rule is about, in several languages: the vocabulary alone decides, and ordinary words don't add up."""
    block = ["http://best-casino.example.org/", "http://a.de/sportwetten/heute", "http://a.fr/machines-a-sous", "http://a.es/apuestas?x=1", "http://a.org/win/bonus", "http://a.de/erotik/kostenlos/lotto", "http://a.es/sexo/citas", "http://x.de/gl\u00fccksspiel/", "http://a.fr/rencontres-sexe"]
    allow = ["http://a.de/angebot/kostenlos/billig", "http://a.fr/gratuit/offre", "http://a.es/oferta/gratis", "http://a.org/kredit/angebot", "http://a.org/cassino", "http://a.org/sexes", "http://a.org/win", "http://a.org/win/win", None, ""]
    rows = {r.url: r.url_verdict for r in urls.url_filter(spark.createDataFrame([(u,) for u in block + allow], "url string")).collect()}
    assert {u for u, v in rows.items() if v == "block"} == set(block)
    table = spark.createDataFrame([("Foo", "strict", None), ("bar", "soft", 5.0), ("baz", "soft", 0.5), ("baz", "soft", 1.0), (None, "soft", 1.0)], "term string, kind string, weight double")
    strict, soft = urls.terms_of(table)
    assert (strict, soft) == (("foo",), {"bar": 1.0, "baz": 1.0})
    own = urls.url_filter(spark.createDataFrame([("x/foo",), ("x/bar",), ("x/bar/baz",)], "url string"), strict=strict, soft=soft)
    assert [r.url_verdict for r in own.collect()] == ["block", "allow", "block"]
