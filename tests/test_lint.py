import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import reports
from millrace.operators import lint, rules
from millrace.operators.source_code import language_of, without_comments
from millrace.plans.snippets import CASES


def masked(code, lang):
    """A plain walk over the characters."""
    out, i, n = list(code), 0, len(code)
    c_like = lang in ("node", "java", "php", "go", "dotnet", "kotlin")
    while i < n:
        triple = next((q for q in ('"""', "'''") if lang == "python" and code.startswith(q, i)), None)
        if triple or (c_like and code.startswith("/*", i)):
            close = triple or "*/"
            at = code.find(close, i + len(triple or "/*"))
            stop = n if at < 0 else at + len(close)
        elif (lang in ("python", "ruby", "curl", "php") and code[i] == "#") or (c_like and code.startswith("//", i)):
            stop = code.find("\n", i)
            stop = n if stop < 0 else stop
        elif code[i] in "\"'" or (lang == "node" and code[i] == "`"):
            q, i = code[i], i + 1
            while i < n and code[i] not in (q, "\n"):
                i += 2 if code[i] == "\\" and i + 1 < n else 1
            i += 1 if i < n and code[i] == q else 0
            continue
        else:
            i += 1
            continue
        out[i:stop] = [c if c == "\n" else " " for c in out[i:stop]]
        i = stop
    return "".join(out)


def test_masks(spark):
    rnd = random.Random(11)
    bits = ["//", "/*", "*/", "#", '"', "'", "`", "\\", "\n", "a", " ", "é", '"""', "'''", "x = 1", "\\\n", '\\"']
    langs = ["node", "python", "php", "java", "ruby", "go", "dotnet", "kotlin", "curl", "unknown"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 25))), langs[i % len(langs)]) for i in range(3000)]
    rows += [(3000, '"' + "a\\\\b" * 5000, "node"), (3001, "/*" + "x\n" * 20000, "java")]
    df = spark.createDataFrame(rows, "i int, code string, lang string").withColumn("m", without_comments(F.col("code"), F.col("lang")))
    for r in df.collect():
        assert r.m == masked(r.code, r.lang), (r.code, r.lang)


def test_languages(spark):
    rows = [("const a = require('x')", None, "node"), ("def f(x):\n  return 1", None, "python"), ("<?php $a = json_encode($b);", None, "php"), ("package main\nfunc f() {}", None, "go"),
            ("plain words", None, "unknown"), ("def f(x):\n  pass", "server.RB", "ruby"), ("x", " ts ", "node"), ("curl https://a.b", "none", "curl"), ("using System;\nnamespace A", None, "dotnet"), (None, None, "unknown")]
    df = spark.createDataFrame(rows, "code string, hint string, want string")
    for r in df.withColumn("got", language_of(F.col("code"), F.col("hint"))).collect():
        assert r.got == r.want, r


def test_every_rule(spark):
    flat = [(f"L{n:03d}", i, code, line) for n, cases in CASES.items() for i, (code, line) in enumerate(cases)]
    df = spark.createDataFrame([(r, i, c) for r, i, c, _ in flat], "rule string, i int, code string").withColumn("hint", F.lit("a.js"))
    got = {(r.rule, r.i): [x.line for x in r.issues if x.rule_id == r.rule] for r in lint.lint(df, language="hint").collect()}
    wrong = {(r, i): (got[r, i], line, c) for r, i, c, line in flat if got[r, i] != ([] if line is None else [line])}
    assert not wrong


def test_columns_report_and_citations(spark):
    code = "const a = 1\n  const k = 'acme_live_ABCDEFGHIJKLMN'; save(cvv)"
    df = spark.createDataFrame([(1, code), (2, ""), (3, None)], "id int, code string")
    linted = lint.lint(df)
    issues = {r.rule_id: r for r in lint.issue_rows(linted, "id", lint.rules_table(spark)).collect()}
    assert (issues["L005"].line, issues["L005"].column) == (2, 14) and issues["L009"].column == 1
    assert {r.id: (r.total, r.n_error) for r in lint.report(linted, "id").collect()} == {1: (2, 2), 2: (0, 0), 3: (0, 0)}
    routes = spark.createDataFrame([(r.route, "u/" + r.route) for r in rules.RULES], "route string, url string").distinct()
    table = lint.resolved(lint.rules_table(spark), routes)
    assert {r.rule_id: r.url for r in table.collect()}["L017"] == "u/api/orders/create#notes"
    with pytest.raises(lint.UnresolvedCitation):
        lint.resolved(lint.rules_table(spark), routes.filter("route <> 'partners'"))


def test_chosen():
    assert {r.concern for r in rules.chosen("capture")} == {"capture"}
    with pytest.raises(ValueError):
        rules.chosen("nothing")
    with pytest.raises(ValueError):
        rules.chosen(rules=(*rules.RULES, rules.RULES[0]))


def test_lines_behind_characters_beyond_the_bmp(spark):
    flat = [(f"L{n:03d}", "😀" * 60 + "\n" + code, line + 1) for n, cases in CASES.items() for code, line in cases if line]
    df = spark.createDataFrame(flat, "rule string, code string, line int").withColumn("hint", F.lit("a.js"))
    for r in lint.lint(df, language="hint").collect():
        assert [x.line for x in r.issues if x.rule_id == r.rule] == [r.line], r


def test_triggers_lose_no_hit(spark):
    """Rules behind their triggers say what they say without: over all cases, in several letter cases, alone and joined."""
    from dataclasses import replace

    from millrace.operators.rules import RULES

    texts = [code for cases in CASES.values() for code, _ in cases]
    texts += ["\n".join(texts[i : i + 3]) for i in range(0, len(texts), 3)] + [t.upper() for t in texts] + [t.lower() for t in texts] + ["", "nothing here", "4111111111111111"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, code string")
    found = lambda rules: {r.i: r.issues for r in lint.lint(df, rules=rules).collect()}
    with_them = found(RULES)
    assert with_them == found(tuple(replace(r, triggers=()) for r in RULES))
    assert len({x.rule_id for issues in with_them.values() for x in issues}) == 30


def test_rules_json(spark, tmp_path):
    """The catalog goes through the gate, comes back whole, and a failed gate leaves what was there."""
    own = lint.rules_table(spark)
    routes = own.select("route").distinct().withColumn("url", F.concat(F.lit("u/"), "route"))
    path = str(tmp_path / "rules.json")
    assert reports.write_rules_json(own, routes, path) == 30 and reports.write_rules_json(own, routes, path) == 30
    back = reports.read_rules_json(spark, path)
    assert back.drop("url").exceptAll(own.select(back.drop("url").columns)).count() == 0 and back.count() == 30
    urls = {r.rule_id: r.url for r in back.collect()}
    assert urls["L017"] == "u/api/orders/create#notes" and urls["L003"] == "u/api/orders/create"
    with pytest.raises(lint.UnresolvedCitation, match="L024"):
        reports.write_rules_json(own, routes.filter("route <> 'partners'"), path)
    assert reports.read_rules_json(spark, path).count() == 30
    (tmp_path / "old.json").write_text('{"version": "0.9", "total": 0, "rules": []}')
    with pytest.raises(ValueError, match="version"):
        reports.read_rules_json(spark, str(tmp_path / "old.json"))


def test_own_rules(spark):
    """A catalog of one's own: a rule without triggers, one of a language only, one that looks for nothing."""
    from millrace.operators.rules import Rule, pattern

    rules = (Rule("A", "info", "x", "t", "r", "e", "f", pattern("ab+")), Rule("B", "error", "x", "t", "r", "e", "f", pattern("ab+"), languages=("php",), triggers=("ab",)), Rule("C", "error", "y", "t", "r", "e", "f", lambda c: F.array().cast("array<struct<line:int,column:int,snippet:string>>")))
    df = spark.createDataFrame([(1, "ab\nabb ab", "a.php"), (2, "x\nab", "a.js"), (3, None, None)], "i int, code string, file string")
    got = {r.i: [(x.rule_id, x.line, x.column, x.snippet) for x in r.issues] for r in lint.lint(df, language="file", rules=rules).collect()}
    assert got == {1: [("B", 1, 1, "ab"), ("B", 2, 1, "abb"), ("A", 1, 1, "ab"), ("A", 2, 1, "abb")], 2: [("A", 2, 1, "ab")], 3: []}
    assert [r.issues for r in lint.lint(df, rules=rules[2:]).collect()] == [[], [], []]


def test_rules_of_untriggered_runs_are_not_looked_at(spark):
    """most texts lack most triggers, so rules and the places of their patterns stand behind a comparison for each run of rules."""
    from millrace.operators.rules import RULES, RUN

    plan = lint.lint(spark.createDataFrame([(1, "x")], "id int, code string"))._jdf.queryExecution().analyzed().toString()
    gates = plan.count("THEN array(struct(rank") + plan.count("THEN array(CASE WHEN")
    assert gates >= len(RULES) // RUN, plan[:2000]


def test_signatures_need_their_words(spark):
    """a signature is searched only where its word is, and no language is lost by that."""
    from millrace.operators.source_code import NEEDS, SIGNATURES, named

    shown = {"node": ["require('x')", "import a from 'b'", "const a = 1", "let a = 1", "module.exports", "new Acme(", "=>"], "python": ["def f(", "import a", "from a import", "acme.Client(", "a:"],
             "php": ["<?php", "$a = 1", "->f(", r"\Acme\Api\Api", "json_encode("], "java": ["public class", "System.out.println", "new AcmeClient(", "import com.acme"], "ruby": ["def f", "require 'acme'", "Acme::Client", "end", ":a =>"],
             "go": ["package a", 'import "a"', "func f", "acme.NewClient", ":="], "dotnet": ["using System;", "namespace A", "new AcmeClient(", "var a ="], "curl": ["curl -X https://a", "curl \\"]}
    rows = [(text, lang, i) for lang, texts in shown.items() for i, text in enumerate(texts)]
    assert [(lang, i) for _, lang, i in rows] == [(lang, i) for lang, sigs in SIGNATURES.items() for i in range(len(sigs))]
    from millrace.functions.text import rx

    for text, lang, i in rows:
        pattern, flags = SIGNATURES[lang][i]
        assert named(NEEDS[lang][i], "acme", "acme") in text, (text, lang)
        assert spark.range(1).select(F.lit(text).rlike(rx(named(pattern, "acme", "acme"), flags))).first()[0], (text, lang)


def test_single_matches_are_not_split_for(spark):
    """places before and after characters beyond the BMP, of one match and of several, without a match, at the ends."""
    from millrace.functions import text as T

    rows = [("ab", [0]), ("xab", [1]), ("\U0001f600ab", [1]), ("\u00e9ab", [1]), ("ab\U0001f600ab", [0, 3]), ("", []), ("\U0001f600", []), ("a\nab\nb", [2]), (None, [])]
    df = spark.createDataFrame(rows, "t string, want array<int>").withColumn("m", T.matches(F.col("t"), "(?i)AB"))
    for r in df.collect():
        assert [x.start for x in r.m] == r.want, r
    assert "regexp_instr" in df._jdf.queryExecution().analyzed().toString()


def test_masks_of_long_comments_and_ends(spark):
    """one pass over a text, dealt out; comments of many lines, quotes in and beside triple ones, stars, ends without an end."""
    bits = ["/*" + "a b\n" * 50_000, "/*/ x */ y", "/***/ y /* **", '"""a""""b"""', '""""', "''' '' ''''#", "#\n#", "a / b // c\n/", '"\\', "`//` // `", "\U0001f600 // \U0001f600\n"]
    langs = ["node", "python", "php", "java", "ruby"]
    rows = [(text + more, lang) for text in bits for more in ("", "\n'#", ' "x') for lang in langs] + [(None, "java")]
    df = spark.createDataFrame(rows, "code string, lang string").withColumn("m", without_comments(F.col("code"), F.col("lang")))
    for r in df.collect():
        assert r.m == (None if r.code is None else masked(r.code, r.lang)), (r.code[:40], r.lang)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract_all(code" in plan and "zip_with" not in plan


def test_lint_deals_out_by_bytes(spark, tmp_path, monkeypatch):
    """a small input's tasks have so many bytes at most, however few cores there are."""
    spark.range(2000).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 20).alias("code")).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(lint, "PART", 1 << 14)
    parts = lint.lint(df).rdd.getNumPartitions()
    assert parts > spark.sparkContext.defaultParallelism, parts


def test_lint_rules_query_is_dealt_out(spark):
    """F16: the customers are dealt out before they are joined; a join's estimated size kept them in one task."""
    from millrace.plans import QUERIES

    assert QUERIES["lint_rules"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
