"""From Markdown documents to chunks, code blocks, links and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.lexicon import SECTION_TOKENS
from ..functions.settle import settled
from ..functions.text import approx_tokens, normal_language

_FRONT = r"\A---[ \t]*\r?\n(?s)(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
_FENCE = r"(?m)^```([^\n]*)\n([\s\S]*?)\n```"
#: Links to raw Markdown files; a corpus sets its own prefix.
RAW_PREFIX = r"https://raw\.githubusercontent\.com/[^/\s)]+/[^/\s)]+/(?:refs/heads/)?master/"


def front_matter(md: Column) -> Column:
    """struct<fields map<string,string>, body>: the simple key: value lines in front, and what follows."""
    head = F.regexp_extract(md, _FRONT, 1)
    pairs = F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*?)[ \t]*$"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([^:]+):", 1).alias("key"), F.regexp_replace(F.regexp_replace(p, r"^[^:]+:[ \t]*", ""), "^[\"']|[\"']$", "").alias("value")))
    fields = F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1))
    return F.struct(fields.alias("fields"), F.regexp_replace(md, _FRONT, "").alias("body"))


def sections(body: Column, level: int) -> Column:
    """array<struct<heading, content>>: parts that begin with a heading of this level, and a preamble that isn't blank.

    The content includes its heading line. Without headings a body that isn't blank is one part.
    """
    mark = "#" * level
    parts = F.split(F.coalesce(body, F.lit("")), rf"(?m)(?=^{mark}\s+\S)", -1)
    rows = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, rf"\A{mark}\s+(.+?)[ \t\r]*(?:\n|\z)", 1).alias("heading"), p.alias("content")))
    return F.filter(rows, lambda r: (r["heading"] != "") | r["content"].rlike(r"\S"))


def chunk_sections(body: Column, limit: int = SECTION_TOKENS) -> Column:
    """array<struct<heading_path, body>>: parts by second-level headings; those over the limit again by third-level ones."""

    def split(s):
        small = F.array(F.struct(s["heading"].alias("heading_path"), s["content"].alias("body")))
        inner = F.transform(sections(s["content"], 3), lambda t: F.struct(_path(s["heading"], t["heading"]).alias("heading_path"), t["content"].alias("body")))
        return F.when(approx_tokens(s["content"]) <= limit, small).otherwise(inner)

    trimmed = F.transform(F.flatten(F.transform(sections(body, 2), split)), lambda c: F.struct(c["heading_path"].alias("heading_path"), F.regexp_replace(c["body"], r"^\s+|\s+\z", "").alias("body")))
    return F.filter(trimmed, lambda c: c["body"] != "")


def _path(h2: Column, h3: Column) -> Column:
    return F.concat_ws(" > ", F.nullif(h2, F.lit("")), F.nullif(h3, F.lit("")))


def code_blocks(body: Column) -> Column:
    """array<struct<ordinal, language, label, code>> of the fences. A fence's first line is `language` or `language: label`."""
    heads = F.regexp_extract_all(body, F.lit(_FENCE), F.lit(1))
    codes = F.regexp_extract_all(body, F.lit(_FENCE), F.lit(2))
    rows = F.zip_with(heads, codes, lambda h, c: F.struct(F.trim(h).alias("h"), c.alias("c")))

    def block(x, i):
        plain = x["h"].rlike(r"^[A-Za-z0-9_+#.-]*(\s*:.*)?$")
        name = F.when(plain, F.regexp_extract(x["h"], r"^([A-Za-z0-9_+#.-]*)", 1)).otherwise(F.lit(""))
        label = F.when(plain, F.trim(F.regexp_extract(x["h"], r"^[^:]*:(.*)$", 1))).otherwise(F.lit(""))
        return F.struct(i.alias("ordinal"), normal_language(name).alias("language"), F.nullif(label, F.lit("")).alias("label"), x["c"].alias("code"))

    return F.transform(rows, block)


def cross_links(body: Column, prefix: str = RAW_PREFIX) -> Column:
    """array<struct<route, anchor>>: links to Markdown files under a prefix, each once, in order."""
    found = F.regexp_extract_all(body, F.lit(prefix + r"[^\s)\"'#]+?\.md(?:#[A-Za-z0-9_-]+)?"), F.lit(0))
    bare = F.transform(found, lambda u: F.regexp_replace(u, "^" + prefix, ""))
    return F.array_distinct(F.transform(bare, lambda u: F.struct(F.regexp_extract(u, r"^(.+?)\.md", 1).alias("route"), F.nullif(F.regexp_extract(u, r"#(.*)$", 1), F.lit("")).alias("anchor"))))


def chunk_docs(docs: DataFrame, limit: int = SECTION_TOKENS, prefix: str = RAW_PREFIX) -> DataFrame:
    """Chunks of docs (route, ordinal, title, description, category, body): one row each, without a shuffle but for ids.

    chunk_index counts a document's chunks from 0; chunk_id counts all from 1 in the order of ordinal. The ids come
    from counts by document: those are ranged and summed by partition, so no task sees the bodies of all.
    """
    parts = docs.withColumn("chunks", chunk_sections(F.col("body"), limit)).drop("body")
    ids = first_ids(parts.select("ordinal", F.size("chunks").cast("long").alias("n")), "ordinal", "n")
    rows = parts.join(ids, "ordinal").select("*", F.posexplode("chunks").alias("chunk_index", "c"))
    out = rows.select(
        (F.col("first") + F.col("chunk_index")).alias("chunk_id"), "route", "title", "description", "category", F.col("c.heading_path").alias("heading_path"),
        F.col("c.body").alias("body"), approx_tokens(F.col("c.body")).alias("n_tokens"), F.col("chunk_index").cast("long").alias("chunk_index"),
    )
    return out.withColumns({"code_blocks": code_blocks(F.col("body")), "cross_links": cross_links(F.col("body"), prefix)})


def first_ids(counts: DataFrame, order: str, n: str, start: int = 1) -> DataFrame:
    """(order, first): running totals of n in order, starting at start, by ranges: only one total a range meets in one task."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(counts.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    within = W.partitionBy("part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = ranged.withColumn("run", F.sum(n).over(within) - F.col(n))
    totals = ranged.groupBy("part").agg(F.sum(n).alias("all"))
    before = totals.withColumn("before", F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    return rows.join(F.broadcast(before), "part").select(order, (F.col("run") + F.col("before") + start).cast("long").alias("first"))


def link_graph(chunks: DataFrame) -> DataFrame:
    """(route, targets): sorted distinct routes that a route's chunks link to, itself left out."""
    edges = chunks.select(F.col("route").alias("src"), F.explode("cross_links.route").alias("dst")).filter("src <> dst").distinct()
    return edges.groupBy(F.col("src").alias("route")).agg(F.sort_array(F.collect_list("dst")).alias("targets"))
