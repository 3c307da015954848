"""Reports as Markdown: an evaluation's metrics and queries, a comparison of two, and the rules' catalog."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lint import resolved


def metric_rows(metrics: DataFrame) -> DataFrame:
    """(metric, value) of a one-row table of numbers."""
    cols = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics.columns]
    return metrics.select(F.inline(F.array(*cols)))


def write_metrics(metrics: DataFrame, path: str, title: str = "Evaluation") -> None:
    """A Markdown table of a one-row metrics table. Its rows are its columns, so the driver gets no more than those."""
    rows = metric_rows(metrics).collect()
    lines = [f"# {title}", "", "| Metric | Value |", "| --- | --- |", *[f"| {r.metric} | {r.value:.4f} |" for r in rows]]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def query_lines(hits: DataFrame) -> DataFrame:
    """(value): Markdown rows of each query's hit, to be written with write.text."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return hits.orderBy("query_id").select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in hits.columns]), F.lit(" |")).alias("value"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(metric, value) of a report that write_metrics made."""
    row = r"^\|\s*([\w@ ]+?)\s*\|\s*(-?[0-9.]+)\s*\|$"
    lines = spark.read.text(path).filter(F.col("value").rlike(row))
    return lines.select(F.regexp_extract("value", row, 1).alias("metric"), F.regexp_extract("value", row, 2).cast("double").alias("value"))


def rule_lines(rules: DataFrame) -> DataFrame:
    """(concern, text): a Markdown section for each concern of the catalog, its rules by id."""
    one = F.concat(F.lit("### "), F.col("rule_id"), F.lit(" - "), F.col("title"), F.lit("\n\n"), F.col("severity"), F.lit(": "), F.col("excerpt"), F.lit(" "), F.col("fix"))
    by = rules.groupBy("concern").agg(F.array_sort(F.collect_list(F.struct("rule_id", one.alias("t")))).alias("x"))
    return by.orderBy("concern").select("concern", F.concat(F.lit("## "), "concern", F.lit("\n\n"), F.array_join("x.t", "\n\n")).alias("text"))


def write_rules(rules: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("# Rules\n\n" + "\n\n".join(r.text for r in rule_lines(rules).collect()) + "\n")




RULES_VERSION = "1.0"


def write_rules_json(rules: DataFrame, routes: DataFrame, path: str) -> int:
    """The catalog as one JSON object, in the order of rule ids, with the urls of its citations; returns how many rules it has.

    Nothing is written if a citation is of no known route (see lint.resolved()). An earlier file is put aside only by a whole one.
    """
    spark = rules.sparkSession
    rows = [json.loads(x) for x in resolved(rules, routes).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toPandas().iloc[:, 0]]  # as many as the catalog has
    citation = lambda r: {"route": r["route"], "section": r["section"], "url": r["url"], "excerpt": r["excerpt"]}
    own = ("rule_id", "severity", "concern", "title", "fix")
    said = {"version": RULES_VERSION, "generated": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "total": len(rows), "rules": [{**{k: r[k] for k in own}, "citation": citation(r)} for r in sorted(rows, key=lambda r: r["rule_id"])]}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    aside = to.suffix(".new")
    fs = to.getFileSystem(conf)
    out = fs.create(aside, True)
    out.write(json.dumps(said, indent=2).encode())
    out.close()
    fs.delete(to, False)
    if not fs.rename(aside, to):
        raise OSError(f"{path} could not be written")
    return len(rows)


def read_rules_json(spark: SparkSession, path: str) -> DataFrame:
    """The catalog of such a file, in the columns of lint.rules_table() and url. Another version of the format is refused."""
    kinds = "version string, generated string, total long, rules array<struct<rule_id: string, severity: string, concern: string, title: string, fix: string, citation: struct<route: string, section: string, url: string, excerpt: string>>>"
    whole = spark.read.schema(kinds).json(path, multiLine=True)
    head = whole.select("version", F.col("total") == F.size("rules")).first()
    if head is None or tuple(head) != (RULES_VERSION, True):
        raise ValueError(f"{path} is no whole catalog of version {RULES_VERSION}")
    return whole.select(F.inline("rules")).select("rule_id", "severity", "concern", "title", "citation.route", "citation.section", "citation.excerpt", "fix", "citation.url")
