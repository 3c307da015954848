"""The numbered queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify, clusters, decontaminate, lines, minhash, pieces, pii, quality, secrets, sharding, substrings, urls, whitening
from ._work import hex_sha, table, written


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", hex_sha("kept").alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    return out.select("doc_id", *counts, hex_sha(pii.joined(pii.named_base())).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("private"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole records go through both passes and are written; the digest is of what was written
    out = written(sharding.external_shuffle(table(spark, sf_dir, "documents"), ["doc_id", "text"], 40, sharding.record_size(), seed=20), "shards")
    digest = [sharding.record_size().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")]
    return out.select("doc_id", *digest, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("failed").bitwiseAND(F.lit(quality.mask(quality.BASE))) != 0
    four = [f"measures.{m}" for m in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return book.select("doc_id", "measures.n_words", *four, base.alias("base_failed"), (~base & quality.passes("v2")).alias("kept"), F.col("failed").alias("failed_bits"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of the policy what it rejects, what it alone rejects, and what is kept without it."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path"))
    judged = urls.url_filter(pages).withColumn("r", urls.longest_rule(F.col("host"), F.col("path")))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "url_verdict").alias("verdict"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        hex_sha(F.array_join("items", ",")).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coder = pieces.Pieces(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("ids", coder.encode(F.col("text")))
    out = docs.withColumn("back", coder.decode(F.col("ids")))
    n = F.when(F.col("ids").isNull(), F.lit(0)).otherwise(F.size("ids")).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.col("back").eqNullSafe(F.col("text")).alias("restored"))


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = written(docs.select("doc_id", classify.statistics_of(F.col("text")).alias("x")), "statistics")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = classify.fit(rows.filter(~held_out).join(labels, "doc_id"), "x", "quality")
    scored = rows.select("doc_id", held_out.alias("held_out"), classify.score(F.col("x"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_runs", hex_sha(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("kept_sha256"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distances and inertias of every kept vector, and its final centroid's hash; see clusters.cluster()."""
    out, centroids = clusters.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    names = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids] or [F.lit(None).cast("string")]
    return out.withColumn("centroid_sha256", F.get(F.array(*names), F.col("cluster")))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans by kind and all spans of every document; see secrets.detect()."""
    out = secrets.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secrets.count_of("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, hex_sha(secrets.joined(F.col("base"))).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every kept vector; see whitening.whiten()."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=4)


QUERIES = {"op1_substrings": op1_substrings, "op2_pii": op2_pii, "op3_sharding": op3_sharding, "op4_quality": op4_quality, "op5_decontaminate": op5_decontaminate, "op6_minhash": op6_minhash, "op7_pieces": op7_pieces, "op8_classifier": op8_classifier, "op9_urls": op9_urls, "op10_lines": op10_lines, "op11_clusters": op11_clusters, "op12_secrets": op12_secrets, "op13_whitening": op13_whitening, "quality_ablations": quality_ablations}


def _op9_sql() -> str:
    def count(terms):
        return " + ".join(f"{w} * regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t, w in terms.items())

    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    long_first = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in long_first) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in long_first)
    abc = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), {abc}) AS u,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {abc}) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, {rule} AS rule,
  {said} WHEN {count(dict.fromkeys(urls.STRICT, 1))} > 0 OR {count(urls.SOFT)} >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM cut"""


_OP4_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS three
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, three) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals,
    len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS n_lettered
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
    + 4 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT + 8 * (10 * n_symbols > 3 * n_words)::BIGINT
    + 16 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 32 * (10 * n_capitals > 4 * n_letters)::BIGINT
    + 64 * (10 * n_lettered < 7 * n_words)::BIGINT AS bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, bits % 4 <> 0 AS base_failed, bits = 0 AS kept, bits AS failed_bits
FROM f"""

_OP5_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower_az(text), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pl AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, pl.n, item_id FROM pl JOIN win ON win.w = pl.w AND win.n = pl.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY 1)
SELECT d.doc_id, coalesce(len(ws), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(ids.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids.s, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id LEFT JOIN ids ON ids.doc_id = d.doc_id""".replace("lower_az(text)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

_OP10_SQL = """
WITH ls AS (
  SELECT doc_id, pos - 1 AS pos, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM ls WHERE w > 0),
ahead AS (SELECT p.doc_id, p.i AS i, min(q.i) AS j FROM x p JOIN x q ON p.doc_id = q.doc_id AND q.i BETWEEN p.i AND p.i + 49 AND q.e - p.e + p.w >= 50 GROUP BY 1, 2),
back AS (SELECT q.doc_id, max(p.i) AS i, q.i AS j FROM x p JOIN x q ON p.doc_id = q.doc_id AND q.i BETWEEN p.i AND p.i + 49 AND q.e - p.e + p.w >= 50 GROUP BY 1, 3),
st AS (SELECT * FROM ahead UNION SELECT doc_id, i, j FROM back),
named AS (SELECT st.doc_id, st.i, st.j, string_agg(x.line, chr(10) ORDER BY x.i) AS name FROM st JOIN x ON x.doc_id = st.doc_id AND x.i BETWEEN st.i AND st.j GROUP BY 1, 2, 3),
later AS (
  SELECT doc_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY name, j - i ORDER BY doc_id, i) AS k FROM named) WHERE k > 1),
gone AS (
  SELECT DISTINCT l.doc_id, ls.pos FROM later l JOIN x a ON a.doc_id = l.doc_id AND a.i = l.i JOIN x b ON b.doc_id = l.doc_id AND b.i = l.j
  JOIN ls ON ls.doc_id = l.doc_id AND ls.pos BETWEEN a.pos AND b.pos),
runs AS (SELECT doc_id, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.pos = g.pos - 1)) AS n FROM gone g GROUP BY 1),
kept AS (
  SELECT ls.doc_id, count(*) AS n, count(gone.pos) AS n_gone, string_agg(line, chr(10) ORDER BY ls.pos) FILTER (WHERE gone.pos IS NULL) AS t
  FROM ls LEFT JOIN gone ON gone.doc_id = ls.doc_id AND gone.pos = ls.pos GROUP BY 1)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_lines, coalesce(k.n_gone, 0)::BIGINT AS n_removed_lines, coalesce(r.n, 0)::BIGINT AS n_runs,
  sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN runs r ON r.doc_id = d.doc_id"""



def _op11_sql(dim: int = 64, k: int = 16, rounds: int = 3, factor: int = 64) -> str:
    """Each round's centroids are rows (cluster, c) of lists; all sums are whole numbers."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor({factor} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS cluster, x FROM v QUALIFY cluster < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT vec_id, x, cluster, d FROM (SELECT v.vec_id, v.x, c.cluster, {far} AS d, row_number() OVER (PARTITION BY v.rowid ORDER BY {far}, c.cluster) AS n
    FROM (SELECT *, row_number() OVER () AS rowid FROM v) v, c{i} c) WHERE n = 1)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS x FROM (
      SELECT cluster, p, sum(e)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, generate_subscripts(x, 1) AS p FROM a{i}) GROUP BY ALL)
    GROUP BY 1) m ON m.cluster = c.cluster)""")
    return f"""
WITH {",".join(steps)},
i AS (SELECT cluster, sum(d) AS s FROM a{rounds} GROUP BY 1)
SELECT a.vec_id, a.cluster::INT AS cluster, a.d AS distance, i.s::BIGINT AS cluster_inertia, (SELECT sum(s) FROM i)::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN i ON i.cluster = a.cluster JOIN c{rounds} c ON c.cluster = a.cluster"""


_BITS = ", ".join(f"('{name}', {1 << i})" for i, name in enumerate(quality.RULES))
_ABLATIONS_SQL = f"""
WITH book AS ({_OP4_SQL})
SELECT rule, count(*) FILTER (WHERE failed_bits & bit <> 0) AS n_fail, count(*) FILTER (WHERE failed_bits = bit) AS n_alone,
  count(*) FILTER (WHERE failed_bits & ({(1 << len(quality.RULES)) - 1} - bit) = 0) AS n_kept_without
FROM book, (VALUES {_BITS}) AS r(rule, bit) GROUP BY rule"""

ORACLE_SQL = {"op11_clusters": _op11_sql(), "quality_ablations": _ABLATIONS_SQL, "op5_decontaminate": _OP5_SQL, "op10_lines": _OP10_SQL, "op4_quality": _OP4_SQL, "op9_urls": _op9_sql()}
