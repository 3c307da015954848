import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import lexicon as L
from millrace.functions import text as T
from millrace.operators import lexical, rewrite


def _one(spark, col, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", col(F.col("x")).alias("y")).orderBy("i").collect()
    return [r.y for r in rows]


def test_query_tokens(spark):
    lex = L.Lexicon(corpus_words=("acme",))
    got = _one(spark, lambda x: T.query_tokens(x, lex), "How to verify the webhook signature", "error errors codes", "acme orders api a", "e-mandate mandates entries entry", "", None)
    assert got == [["verify", "webhook", "signature"], ["error", "codes"], ["orders", "api"], ["e-mandate", "mandates", "entries"], [], []]


def test_porter():
    said = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational digitizer operator feudalism decisiveness triplicate formative formalize electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angularity effective bowdlerize probate rate cease controll roll yes".split()
    want = "caress poni ti caress cat feed agre plaster bled motor sing conflat troubl size hop tan fall hiss fizz fail file happi sky relat condit ration digit oper feudal decis triplic form formal electr hope good reviv allow infer airlin adjust defens irrit replac adjust depend adopt homolog commun activ angular effect bowdler probat rate ceas control roll ye".split()
    assert [T.porter(w) for w in said] == want


def test_matches(spark):
    got = _one(spark, lambda x: T.matches(x, "[0-9]+(x)?", 1), "a12x345é6", "none", None)
    assert [[(m.start, m.hit, m.part) for m in r] for r in got] == [[(1, "12x", "x"), (4, "345", ""), (8, "6", "")], [], []]


def test_word_edges_are_ascii(spark):
    assert _one(spark, lambda x: x.rlike(T.rx(r"\bapi\b", "i")), "éapi", "my API.", "xapi", "api_") == [True, True, False, False]


def test_truncated(spark):
    got = _one(spark, lambda x: T.truncated(x, 20), "short", "a" * 30, "a" * 13 + "\n\n" + "b" * 20, "a" * 5 + "\n\n" + "b" * 20)
    assert got == ["short", "a" * 20, "a" * 13, "a" * 5 + "\n\n" + "b" * 13]


def test_routes(spark):
    got = _one(spark, T.route_of, "/api/orders/", "https://x.com/docs/api/orders/", "https://x.com/docs/a?b=1", "https://raw.x.com/o/r/master/a/b.md#c", "https://x.com/else", "a")
    assert got == ["api/orders", "api/orders", None, "a/b", None, "a"]


def test_rewrite(spark):
    lex = L.Lexicon(synonyms=(("verify", "validate", "check"), ("test", "sandbox"), ("payout", "transfer money"), ("salary", "payout")))
    rows = [(1, "How do I verify and validate payouts in Python?"), (2, "what is"), (3, None), (4, "payout in sandbox mode")]
    got = {r.query_id: r for r in rewrite.rewritten(spark.createDataFrame(rows, "query_id long, query string"), lex).collect()}
    assert got[1].tokens == ["verify", "validate", "payouts", "python?"[:-1]]
    assert got[1].synonym_groups == [["verify", "validate", "check"], ["payouts"], ["python"]] and got[1].expanded_terms == ["verify", "validate", "check"]
    assert (got[1].detected_language, got[1].detected_product, got[1].detected_topic) == ("python", "x", None)
    assert got[2].cleaned == "what is" and got[2].tokens == [] and got[3].tokens == []
    assert got[1].match == "verify AND validate AND payouts AND python" and got[1].synonym_match == "(verify OR validate OR check) AND payouts AND python"
    assert got[4].synonym_match.startswith("(salary OR payout) AND (test OR sandbox)")
    ok, bad = rewrite.accepted(spark.createDataFrame(rows, "query_id long, query string"), most=20)
    assert ([r.query_id for r in ok.collect()], sorted(r.query_id for r in bad.collect())) == ([2], [1, 3, 4])
    assert got[4].synonym_groups[0] == ["salary", "payout"]


def _index(spark, **how):
    rows = [(1, "Orders API", "Create an order. Refunds are created later."), (2, "Refund guide", "Money back to a customer, the cafés pay later"), (3, "Other", "Later pay and nothing")]
    return lexical.build(spark.createDataFrame(rows, "chunk_id long, title string, body string"), {"title": 8.0, "body": 1.0}, **how)


@pytest.mark.parametrize(("groups", "want"), [
    ([["refund"]], [2, 1]), ([["refund"], ["order"]], [1]), ([["refund"], ["nothing", "money back"]], [2]), ([["pay later"]], [2]), ([["cafe"]], [2]), ([["absent"]], []), ([["refund"], ["absent"]], []), ([], []), ([["!!"]], []),
])
def test_bm25(spark, groups, want):
    q = spark.createDataFrame([(1, groups)], "query_id long, groups array<array<string>>")
    assert [r.chunk_id for r in sorted(lexical.bm25(_index(spark), q).collect(), key=lambda r: r["rank"])] == want


def test_index_round_trip(spark, tmp_path):
    index = _index(spark)
    index.write(str(tmp_path))
    q = spark.createDataFrame([(1, [["later"]]), (2, [["refund"]])], "query_id long, groups array<array<string>>")
    assert sorted(lexical.bm25(lexical.Index.read(spark, str(tmp_path)), q).collect()) == sorted(lexical.bm25(index, q).collect())


def test_synonym_file(tmp_path):
    good, bad = tmp_path / "a.json", tmp_path / "b.json"
    good.write_text('{"version": 1, "groups": [["a", "b"]]}')
    bad.write_text('{"version": 1, "groups": [["a"]]}')
    assert L.load_synonyms(str(good)) == (("a", "b"),)
    with pytest.raises(ValueError):
        L.load_synonyms(str(bad))


def test_offsets_of_many_matches(spark):
    texts = [None, "", "none", "a1b22😀333", "1", "12 " * 1500, "é7" * 513, "x" * 3000 + "5"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.withColumn("m", T.matches(F.col("t"), "([0-9])[0-9]*", 1)).collect():
        assert [(m.start, m.hit, m.part) for m in r.m] == [(m.start(), m[0], m[1]) for m in re.finditer("([0-9])[0-9]*", r.t or "")], r.i


def test_word_edges_match_where_the_plain_pattern_does():
    """Both forms of a boundary find the same spans in all rules' patterns, over their snippets and over their own words in odd orders."""
    import random
    import re

    from millrace.operators import rules
    from millrace.operators.source_code import SIGNATURES, named
    from millrace.plans.snippets import CASES

    pick = random.Random(3)
    fixed = [x for v in vars(rules).values() for x in (v if isinstance(v, tuple) else (v,)) if isinstance(x, str) and r"\b" in x]
    patterns = [named(p, "acme", "acme") for p in fixed + [p for sigs in SIGNATURES.values() for p, _ in sigs]] + [r"\bx+\b", r"\b\w+\b", r"\ba?b\b"]
    found = 0
    for p in patterns:
        parts = re.findall("[A-Za-z_]+", p) + [" ", ".", "_", "a", "b", "x", "(", "9", "\n", "=", '"', "é"]
        texts = [code for cases in CASES.values() for code, _ in cases] + ["".join(pick.choice(parts) for _ in range(9)) for _ in range(40)]
        for flags in (re.A, re.A | re.I):
            for t in texts:
                plain = [m.span() for m in re.finditer(p, t, flags)]
                assert plain == [m.span() for m in re.finditer(T.rx(p), t, flags)], (p, t)
                found += bool(plain)
    assert found > 500
