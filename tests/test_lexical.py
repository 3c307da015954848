"""The block index against a plain restatement of BM25, phrases by rarest word, and what ranked queries look at."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import lexical

WEIGHTS = {"title": 8.0, "body": 1.0}


def _corpus(n=900, seed=2):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    odds = [1 / (i + 1) for i in range(400)]
    rows = [(i, " ".join(rnd.choices(words, odds, k=rnd.randrange(0, 4))), " ".join(rnd.choices(words, odds, k=rnd.randrange(0, 60)))) for i in range(n)]
    rows += [(n + i, rows[7][1], rows[7][2] + " same tail of words") for i in range(n // 3)]  # a third of the rows are one text: ties
    return rows + [(5000, None, None), (5001, "", "...")]


def _plain(rows, queries, phrases=False):
    """{query: {chunk: score}} of groups of terms; terms of several words stand one after another in a field."""
    toks = {i: {f: re.findall("[a-z0-9]+", (t or "").lower()) for f, t in zip(WEIGHTS, texts)} for i, *texts in rows}
    dl = {i: sum(map(len, f.values())) for i, f in toks.items()}
    avg = sum(dl.values()) / len(dl)

    def tfs(term):
        ws = term.split()
        out = {}
        for i, fields in toks.items():
            tf = sum(WEIGHTS[f] for f, t in fields.items() for p in range(len(t)) if t[p : p + len(ws)] == ws)
            if tf:
                out[i] = tf
        return out

    memo = {}
    out = {}
    for q, groups in queries.items():
        parts = []
        for g in groups:
            own = Counter()
            for term in g:
                tf = memo.setdefault(term, tfs(term))
                idf = max(math.log((len(toks) - len(tf) + 0.5) / (len(tf) + 0.5)), 1e-6)
                for i, x in tf.items():
                    own[i] += idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * dl[i] / avg))
            parts.append(own)
        both = set.intersection(*[set(p) for p in parts]) if parts else set()
        out[q] = {i: sum(p[i] for p in parts) for i in both}
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = _corpus()
    return rows, lexical.build(spark.createDataFrame(rows, "chunk_id long, title string, body string").repartition(4), WEIGHTS, stem=False, tokens=T.ascii_tokens).settled()


def _asked(spark, queries):
    return spark.createDataFrame(list(queries.items()), "query_id long, groups array<array<string>>")


@pytest.mark.parametrize("k", [1, 10, 40, 2000])
def test_ranked_queries(spark, corpus, k):
    rows, index = corpus
    rnd = random.Random(k)
    queries = {i: [[f"w{min(399, int(rnd.expovariate(0.02)))}" for _ in range(rnd.randrange(1, 15))]] for i in range(25)}
    queries |= {100: [["w1"]], 101: [["tail", "w3", "w0"]], 102: [["absent"]], 103: [["w2", "w2", "absent"]], 104: [["w399", "w398", "w0", "w1", "w2"]]}
    want = _plain(rows, queries)
    got = {}
    for r in lexical.bm25(index, _asked(spark, queries), k, digits=9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
    for q, scores in want.items():
        order = sorted(((round(s, 9), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:k]
        mine = sorted(got.get(q, []))
        assert [s for _, _, s in mine] == pytest.approx([s for s, _ in order], abs=3e-9)
        assert len({i for _, i, _ in mine} ^ {i for _, i in order}) <= 2  # a last place may differ in the ninth digit
        assert [r for r, _, _ in mine] == list(range(1, len(order) + 1))


def test_looks_at_few_postings(spark, corpus):
    rows, index = corpus
    queries = {i: [[f"w{i + 90}", f"w{i + 100}", "tail", "w0", "w1", "w2", "w3", "w4"]] for i in range(10)}
    read = {}
    terms = _asked(spark, queries).select("query_id", F.explode(F.col("groups")[0]).alias("term"), F.lit(1).alias("times"))
    lexical.ranked_any(index, terms, 5, read).count()
    counts = lexical.postings_read(read).collect()
    assert len(counts) == 10 and sum(r.n_read for r in counts) < 0.5 * sum(r.n_all for r in counts)


def test_conjunctions_and_phrases(spark, corpus):
    rows, index = corpus
    queries = {
        1: [["w0"], ["w1"], ["w2"]], 2: [["w0 w1"]], 3: [["w1 w0 w0"], ["w3", "w5 w0"]], 4: [["same tail of words"]], 5: [["words of"]], 6: [["w0"], ["absent"]], 7: [], 8: [["w0 w0"]],
        9: [["of words", "w9 w1"], ["w4"]], 10: [["w0 absent"], ["w1"]], 11: [["w399"], ["w0", "w1"]], 12: [["w0 w0 w0 w0"]], 13: [["tail of words", "w0 w2"]],
    }
    want = _plain(rows, queries)
    got = {q: {} for q in queries}
    for r in lexical.bm25(index, _asked(spark, queries), None).collect():
        got[r.query_id][r.chunk_id] = r.score
    for q in queries:
        assert got[q].keys() == want[q].keys(), q
        assert all(abs(got[q][i] - s) < 1e-9 for i, s in want[q].items()), q


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], "chunk_id long, title string, body string")
    index = lexical.build(empty, WEIGHTS)
    assert lexical.bm25(index, _asked(spark, {1: [["a"]], 2: [["a b"], ["c"]], 3: []})).count() == 0


def test_blocks_hold_every_posting_once(spark, corpus):
    rows, index = corpus
    n = index.blocks.agg(F.sum("n"), F.sum(F.size("ids")), F.max("n")).first()
    assert n[0] == n[1] == index.terms.agg(F.sum("df")).first()[0]
    assert n[2] <= 4 * lexical.BLOCK
    assert index.n == len(rows)


def test_vocabulary_keeps_no_postings(spark, monkeypatch):
    """The same counts as the index's, in weighted fields and with stems, without an index or a table on shared storage."""
    df = spark.createDataFrame(_corpus(), "chunk_id long, title string, body string").repartition(3)
    want = {(r.term, r.df, r.cf) for r in lexical.build(df, WEIGHTS).terms.collect()}

    def never(*_, **__):
        raise AssertionError("an index was built")

    monkeypatch.setattr(lexical, "settled", never)
    monkeypatch.setattr(lexical, "build", never)
    assert {tuple(r) for r in lexical.vocabulary(df, WEIGHTS).collect()} == want
    from millrace.plans import QUERIES

    assert QUERIES["vocabulary"](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("digits", [None, 6])
@pytest.mark.parametrize("k", [None, 7])
def test_texts_find_what_their_index_finds(spark, monkeypatch, k, digits):
    """Any word, conjunctions, phrases, synonyms, a word said twice, words nobody has, ties of copies; nothing of the postings is shuffled."""
    monkeypatch.setattr(lexical, "_HELD", 20)
    monkeypatch.setattr(lexical, "_CELLS", 50)
    monkeypatch.setattr(lexical, "_BATCH", 400)
    df = spark.createDataFrame(_corpus(), "chunk_id long, title string, body string").repartition(3)
    asked = [[["w0", "w3", "w9"]], [["w1"], ["w2", "w7"]], [["w0 w1"], ["w2"]], [["w0 w0", "w5"]], [["same tail of words"]], [["w4", "w4"]], [["nobody"], ["w1"]], [["?!"], ["w1"]], [], [["w0 w1 w2", "w1 w0"]], [["tail"]]]
    queries = [spark.createDataFrame([(i, g) for i, g in enumerate(asked)], "query_id int, groups array<array<string>>"), spark.createDataFrame([(i, [[w for t in g for s in t for w in s.split()]]) for i, g in enumerate(asked) if g], "query_id int, groups array<array<string>>")]
    for places in (True, False):
        index = lexical.build(df, WEIGHTS, places=places).settled()
        texts = lexical.Texts(df, WEIGHTS, positional=places)
        for q in queries:
            want = lexical.bm25(index, q, k, digits or 6)
            got = lexical.bm25(texts, q, k, digits)
            assert got.schema == want.schema
            mine, theirs = ({(r.query_id, r.chunk_id): r.score for r in x.collect()} for x in (got, want))
            assert mine.keys() == theirs.keys() or (k and not digits)
            assert all(abs(mine[x] - theirs[x]) < 2e-6 for x in mine.keys() & theirs.keys())
            if k:
                assert sorted((r.query_id, r["rank"]) for r in got.collect()) == sorted((r.query_id, r["rank"]) for r in want.collect())
    monkeypatch.setattr(lexical, "ASKED", 3)  # a larger batch goes through the index
    assert {tuple(r) for r in lexical.bm25(texts, queries[1], 7, 6).collect()} == {tuple(r) for r in lexical.bm25(index, queries[1], 7, 6).collect()}
