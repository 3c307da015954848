"""Linting of snippets: every rule on every snippet in one pass, then a report and its citations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.settle import spread
from .rules import FOUND, HITS, RULES, SEVERITIES, Code, Rule, chosen, first_of_line, trigger_mask, triggered
from .source_code import language_of, without_comments


#: Bytes of input that a task lints: rules take seconds a megabyte.
PART = 1 << 24


class UnresolvedCitation(ValueError):
    """A rule cites a route that the corpus doesn't have."""


def _code_columns(df: DataFrame, code: str, language: str | None, brand: str, mask: bool) -> DataFrame:
    """df with __lang, __masked and both texts' lines, in steps, so that each is computed once."""
    said = F.coalesce(F.col(code), F.lit(""))
    out = df.withColumn("__code", said).withColumn("__lang", language_of(F.col("__code"), F.col(language) if language else None, brand))
    out = out.withColumn("__masked", without_comments(F.col("__code"), F.col("__lang")) if mask else F.col("__code"))
    return out.withColumns({"__lines": F.split("__code", "\r?\n", -1), "__masked_lines": F.split("__masked", "\r?\n", -1)})


def lint(df: DataFrame, code: str = "code", language: str | None = None, concern: str = "all", rules: tuple[Rule, ...] = RULES, brand: str = "acme", key: str = "acme", mask: bool = True) -> DataFrame:
    """df with language_detected and issues: array<struct<rank, line, rule_id, column, snippet>>, sorted by severity, line, rule.

    The rules' triggers are looked for once, and only rules that have one of theirs in a snippet are tried on it. Row by
    row; only a small input is dealt out to all cores. A rule hits a line once. language names a column with a file name or language that
    goes before what the code looks like. A null or empty snippet has no issue. mask=False lints comments too.
    """
    own = chosen(concern, rules=rules)
    rows = _code_columns(spread(df, PART), code, language, brand, mask)
    rows = rows.withColumn("__low", F.lower("__masked")).withColumn("__bits", triggered(F.col("__low"), own, brand, key))
    c = Code(F.col("__code"), F.col("__masked"), F.col("__lines"), F.col("__masked_lines"), brand, key, F.col("__bits"))

    def tried(r: Rule) -> Column:
        mine = replace(c, needed=trigger_mask(r, own))
        applies = F.lit(True) if "*" in r.languages else F.col("__lang").isin(*r.languages)
        hits = F.when(applies & mine.wanted(mine.needed), r.detect(mine)).otherwise(F.array().cast(HITS))
        return F.struct(F.lit(SEVERITIES.index(r.severity)).alias("rank"), F.lit(r.id).alias("rule_id"), hits.alias("hits"))

    def issues(x: Column) -> Column:
        return F.transform(first_of_line(x["hits"]), lambda h: F.struct(x["rank"].alias("rank"), h["line"].alias("line"), x["rule_id"].alias("rule_id"), h["column"].alias("column"), h["snippet"].alias("snippet")))

    by_bits = sorted(((trigger_mask(r, own), r) for r in own), key=lambda x: ((x[0] or 0) & -(x[0] or 0), x[1].id))  # rules of like triggers are neighbours
    runs = c.gated([(needed, tried(r)) for needed, r in by_bits], lambda n: F.array().cast(f"array<struct<rank:int,rule_id:string,hits:{HITS}>>"))
    hit = F.filter(F.flatten(runs), lambda x: F.size(x["hits"]) > 0)  # few rules hit a snippet
    found = F.array_sort(F.flatten(F.transform(hit, issues)))
    rows = rows.withColumn(FOUND, c.located())  # of the patterns that the rules have noted by now
    return rows.select(*df.columns, F.col("__lang").alias("language_detected"), found.alias("issues"))


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The catalog as rows; its size is the catalog's."""
    rows = [(r.id, r.severity, r.concern, r.title, r.route, r.section, r.excerpt, r.fix) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, severity string, concern string, title string, route string, section string, excerpt string, fix string")


def unresolved(rules: DataFrame, routes: DataFrame) -> DataFrame:
    """Rules whose citation is of no known route."""
    return rules.join(routes.select("route"), "route", "left_anti")


def resolved(rules: DataFrame, routes: DataFrame, url: str = "url") -> DataFrame:
    """rules with the citation's url, a section after #. Fails if a route isn't there."""
    lost = [r.rule_id for r in unresolved(rules, routes).select("rule_id").collect()]  # no more than the catalog has
    if lost:
        raise UnresolvedCitation(f"no such route: rules {', '.join(sorted(lost))}")
    known = routes.join(F.broadcast(rules.select("route").distinct()), "route", "left_semi").select("route", F.col(url).alias("__url"))  # the catalog's rows
    return rules.join(known, "route").withColumn("url", F.concat_ws("#", "__url", "section")).drop("__url")


def issue_rows(linted: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """One row an issue: key, place in the report, severity, line, column, snippet, and what the catalog says."""
    return flat(linted, key).join(F.broadcast(rules), "rule_id")  # the catalog's rows


def flat(linted: DataFrame, key: str) -> DataFrame:
    """(key, place, rule_id, line, column, snippet): one row an issue.

    Exploded with empty rows, which go afterwards: else Spark would ask for the array's size first, and so make the
    rules' whole expression twice.
    """
    rows = linted.select(key, F.posexplode_outer("issues").alias("place", "i")).select(key, F.col("place").cast("long").alias("place"), "i.rule_id", "i.line", "i.column", "i.snippet")
    return rows.filter("rule_id is not null")


def report(linted: DataFrame, key: str, n_rules: int = len(RULES)) -> DataFrame:
    """One row a snippet: counts of issues by severity, rules applied, language."""
    by = [F.size(F.filter("issues", _of_rank(s))).cast("long").alias(f"n_{name}") for s, name in enumerate(SEVERITIES)]
    return linted.select(key, F.size("issues").cast("long").alias("total"), *by, F.lit(n_rules).cast("long").alias("rules_evaluated"), "language_detected")


def _of_rank(rank: int):
    return lambda i: i["rank"] == rank
