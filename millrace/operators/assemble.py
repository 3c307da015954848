"""From ranked candidates to results; whole documents by route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lexicon import DOC_CAP, MAX_RELATED, SUMMARY_CAP
from ..functions.text import approx_tokens, is_sdk_language, route_of, summary, truncated


def clamp_k(k: float | None, default: int = 3) -> int:
    return default if k is None else max(1, min(10, int(k // 1)))


def canonical_url(route: Column, base: str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/docs/"), route, F.lit("/"))


def shown_blocks(blocks: Column, language: Column) -> Column:
    """The code blocks of a language; without one those of SDK languages and JSON."""
    plain = lambda b: F.struct(b["language"].alias("language"), F.coalesce(b["label"], F.lit("")).alias("label"), b["code"].alias("code"))
    return F.transform(F.filter(blocks, lambda b: F.when(language.isNotNull(), b["language"] == language).otherwise(is_sdk_language(b["language"]) | (b["language"] == "json"))), plain)


def related(routes: DataFrame, graph: DataFrame, most: int = MAX_RELATED) -> DataFrame:
    """(route, related array<struct<route, title>>): a route's first targets, in order, that exist."""
    edges = graph.select("route", F.posexplode("targets").alias("i", "target"))
    known = edges.join(routes.select(F.col("route").alias("target"), "title"), "target")
    order = W.partitionBy("route").orderBy("i")
    near = known.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    rows = near.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("i", F.col("target").alias("route"), "title"))).alias("x"))
    return rows.select("route", F.transform("x", lambda r: F.struct(r["route"].alias("route"), r["title"].alias("title"))).alias("related"))


def assembled(cands: DataFrame, chunks: DataFrame, routes: DataFrame, graph: DataFrame | None, k: int | Column, base_url: str) -> DataFrame:
    """One row for each query's result, best first: the chunk's texts, shown code blocks, url and related routes.

    cands: query_id, chunk_id, score, language, and what k refers to if it is a column. Only candidates meet the chunks, so bodies are read after the top-k.
    Candidates without a chunk are left out, and of a route's chunks the best stays.
    """
    hydrated = chunks.select("chunk_id", "route", "title", "description", "heading_path", "body", "code_blocks").join(cands.select("query_id", "chunk_id", "score", "language", (k if isinstance(k, Column) else F.lit(k)).alias("__k")), "chunk_id")
    first = hydrated.withColumn("n", F.row_number().over(W.partitionBy("query_id", "route").orderBy(F.col("score").desc(), "chunk_id"))).filter("n = 1")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id"))).filter("rank <= __k")
    out = ranked.join(routes.select("route", "url"), "route", "left")
    if graph is not None:
        out = out.join(related(routes, graph), "route", "left")
    links = F.coalesce("related", F.array().cast("array<struct<route:string,title:string>>")) if graph is not None else F.array().cast("array<struct<route:string,title:string>>")
    return out.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "route", "title", summary(F.col("description"), F.col("body"), SUMMARY_CAP).alias("summary"),
        truncated(F.col("body")).alias("excerpt"), F.coalesce("heading_path", F.lit("")).alias("heading_path"), shown_blocks(F.col("code_blocks"), F.col("language")).alias("code_blocks"),
        F.coalesce("url", canonical_url(F.col("route"), base_url)).alias("url"), links.alias("related"),
    )


def response_tokens(results: DataFrame) -> DataFrame:
    """(query_id, n_tokens): estimated tokens of all that a query got."""
    own = approx_tokens(F.col("title")) + approx_tokens(F.col("summary")) + approx_tokens(F.col("excerpt"))
    code = F.aggregate("code_blocks", F.lit(0).cast("long"), lambda acc, b: acc + approx_tokens(b["code"]))
    return results.groupBy("query_id").agg(F.sum(own + code).alias("n_tokens"))


def documents(asked: DataFrame, chunks: DataFrame, routes: DataFrame, graph: DataFrame | None = None, cap: int = DOC_CAP) -> DataFrame:
    """(said, route, found, title, url, body, truncated, related) for each row of asked (said: a route or url).

    A body is the chunks in order with a blank line between; past cap characters it is cut. A url that names no route,
    or a route that isn't there, gives found = false.
    """
    wanted = asked.select("said", route_of(F.col("said")).alias("route"))
    parts = chunks.join(wanted.select("route").distinct(), "route", "left_semi")
    whole = parts.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "body"))).alias("x"))
    whole = whole.select("route", F.array_join("x.body", "\n\n").alias("whole"))
    out = wanted.join(routes.select("route", "title", "url"), "route", "left").join(whole, "route", "left")
    if graph is not None:
        out = out.join(related(routes, graph), "route", "left")
    else:
        out = out.withColumn("related", F.array().cast("array<struct<route:string,title:string>>"))
    return out.select(
        "said", "route", F.col("title").isNotNull().alias("found"), "title", "url", F.substring("whole", 1, cap).alias("body"),
        F.coalesce(F.length("whole") > cap, F.lit(False)).alias("truncated"), F.coalesce("related", F.array().cast("array<struct<route:string,title:string>>")).alias("related"),
    )
