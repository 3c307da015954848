"""The library's operators as queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import assemble, dense, evaluate, fusion, lexical, lint, rewrite, sections, vectors
from ..operators.source_code import SPANS, language_of, without_comments
from ..functions.settle import shared_folder, spread
from ..sources import corpus as sources
from ..sources.vector_table import VectorTable
from ..streaming import ingest
from . import search as engine
from .snippets import CASES

LEXICON = L.Lexicon(synonyms=L.SYNONYMS)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sql_hints(col: str, hints) -> str:
    quoted = [(p.replace("'", "''"), n) for p, n in hints]
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}', 'i') THEN '{n}'" for p, n in quoted) + " END"


def _sql_stem(x: str) -> str:
    return f"CASE WHEN length({x}) <= 3 THEN {x} WHEN ends_with({x}, 'ies') THEN {x}[:-4] || 'y' WHEN ends_with({x}, 'es') AND length({x}) > 4 THEN {x}[:-3] WHEN ends_with({x}, 's') AND NOT ends_with({x}, 'ss') THEN {x}[:-2] ELSE {x} END"


def _sql_noise(x: str) -> str:
    for p in L.NOISE:
        x = f"regexp_replace({x}, '{p}', ' ', 'gi')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(*cols: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in cols]


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk: its first line is the title, source/lang/doc_id the route."""
    d = _table(spark, sf_dir, "documents")
    route = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("chunk_id"), F.split("text", "\n", 2)[0].alias("title"), F.col("source").alias("category"), route.alias("route"), F.col("text").alias("body"), F.lit(None).cast("string").alias("description"), F.col("lang").alias("heading_path"))


_CHUNKS = "SELECT doc_id AS chunk_id, string_split(text, chr(10))[1] AS title, source AS category, source || '/' || lang || '/' || doc_id AS route, text AS body, lang AS heading_path FROM documents"
_WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(T.ascii_tokens(F.col("text"))).alias("tokens"))


_BM25_CTES = f"""
d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
st AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format("text")}) AS term FROM benchmark),
part AS (SELECT query_id, doc_id AS chunk_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS p
  FROM tf JOIN df USING (term) JOIN q USING (term), st),
scored AS (SELECT query_id, chunk_id, round(sum(p), 6) AS score, count(*) AS met FROM part GROUP BY ALL),
ranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)"""


#: One written index for all queries over the same documents in a session, as long as their files stay as they are.
_indexes: dict[tuple, lexical.Index] = {}


def _index(spark: SparkSession, sf_dir: str, kind: str) -> lexical.Index:
    """body: words of the texts; fields: words of weighted fields; places: words with their places; stems: what search uses."""
    key = (spark.sparkContext.applicationId, kind, sources.fingerprint(spark, f"{sf_dir}/documents.parquet"))
    if key not in _indexes:
        _indexes[key] = _texts(spark, sf_dir, kind).indexed()
    return _indexes[key]


def _texts(spark: SparkSession, sf_dir: str, kind: str) -> lexical.Texts:
    """The documents for one batch of searches, of the same kinds as _index()."""
    chunks = _chunks(spark, sf_dir)
    if kind == "stems":
        return lexical.Texts(chunks)
    if kind == "fields":
        return lexical.Texts(chunks.select("chunk_id", "title", "category", "route", "body"), L.FIELD_WEIGHTS, False, T.ascii_tokens, False)
    return lexical.Texts(chunks.select("chunk_id", "body"), {"body": 1.0}, False, T.index_tokens if kind == "places" else T.ascii_tokens, kind == "places")


def _any_bm25(spark: SparkSession, sf_dir: str, k: int = L.RETRIEVED, texts: lexical.Texts | None = None) -> DataFrame:
    asked = _items(spark, sf_dir).select("query_id", lexical.any_of(F.col("tokens")).alias("groups"))
    return lexical.bm25(texts or _texts(spark, sf_dir, "body"), asked, k, digits=6)


@_query(f"WITH {_BM25_CTES} SELECT query_id, chunk_id, score, rank FROM ranked WHERE rank <= 30")
def bm25_topk(spark, sf_dir):
    """The 30 best documents of each benchmark item, by any of its words."""
    return _any_bm25(spark, sf_dir)


@_query(f"""
WITH c AS ({_CHUNKS}),
w AS (SELECT chunk_id, {_WORDS.format("title")} AS t, {_WORDS.format("category")} AS g, {_WORDS.format("route")} AS r, {_WORDS.format("body")} AS b FROM c),
l AS (SELECT chunk_id, len(t) + len(g) + len(r) + len(b) AS dl FROM w), st AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
tok AS (SELECT chunk_id, unnest(t) AS term, 8.0 AS wt FROM w UNION ALL SELECT chunk_id, unnest(g), 1.0 FROM w UNION ALL SELECT chunk_id, unnest(r), 2.0 FROM w UNION ALL SELECT chunk_id, unnest(b), 1.0 FROM w),
tf AS (SELECT chunk_id, term, sum(wt) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format("text")}) AS term FROM benchmark), qn AS (SELECT query_id, count(*) AS k FROM q GROUP BY 1),
s AS (SELECT query_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score, count(*) AS met
  FROM tf JOIN df USING (term) JOIN q USING (term) JOIN l USING (chunk_id), st GROUP BY ALL)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s JOIN qn USING (query_id) WHERE met = k""")
def bm25_fields_and(spark, sf_dir):
    """Documents with all words of a benchmark item in weighted fields, ranked."""
    found = lexical.bm25(_texts(spark, sf_dir, "fields"), _items(spark, sf_dir).select("query_id", lexical.all_of(F.col("tokens")).alias("groups")), k=None)
    found = found.withColumn("score", F.round("score", 6))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long"))


_PLACED = "regexp_extract_all(translate(lower(coalesce({}, '')), '" + T.ACCENTED + "', '" + T.PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"


@_query(f"""
WITH d AS (SELECT doc_id, {_PLACED.format("text")} AS ws FROM documents), st AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM d),
pos AS (SELECT doc_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS p FROM d),
i AS (SELECT item_id, {_PLACED.format("text")} AS ws FROM benchmark),
asked AS (SELECT item_id, 1 AS g, ws[1:3] AS ph FROM i WHERE len(ws) >= 6 UNION ALL SELECT item_id, 2, ws[4:4] FROM i WHERE len(ws) >= 6 UNION ALL SELECT item_id, 2, ws[5:6] FROM i WHERE len(ws) >= 6),
said AS (SELECT DISTINCT ph FROM asked),
hit AS (SELECT ph, a.doc_id, a.p FROM said JOIN pos a ON a.term = ph[1] LEFT JOIN pos b ON b.doc_id = a.doc_id AND b.p = a.p + 1 LEFT JOIN pos c ON c.doc_id = a.doc_id AND c.p = a.p + 2
  WHERE (len(ph) < 2 OR b.term = ph[2]) AND (len(ph) < 3 OR c.term = ph[3])),
tf AS (SELECT ph, doc_id, count(*) AS tf FROM hit GROUP BY ALL), df AS (SELECT ph, count(*) AS df FROM tf GROUP BY 1),
part AS (SELECT item_id, doc_id, g, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / a))) AS s
  FROM asked JOIN tf USING (ph) JOIN df USING (ph) JOIN d USING (doc_id), st GROUP BY ALL),
s AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(sum(s), 6) AS score FROM part GROUP BY ALL HAVING count(*) = 2)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 30""")
def bm25_phrases(spark, sf_dir):
    """Documents with an item's first three words as a phrase, and its fourth word or the next two as a phrase."""
    words = T.index_tokens(F.col("text"))
    phrase = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    asked = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w")).filter("size(w) >= 6")
    asked = asked.select("query_id", F.array(F.array(phrase(1, 3)), F.array(phrase(4, 1), phrase(5, 2))).alias("groups"))
    return lexical.bm25(_texts(spark, sf_dir, "places"), asked, digits=6)


@_query()
def bm25_postings_read(spark, sf_dir):
    """How many postings the words of each benchmark item have, and in how many of them the ranked search looks."""
    index, read = _index(spark, sf_dir, "body"), {}
    terms = _items(spark, sf_dir).select("query_id", F.explode("tokens").alias("term"), F.lit(1).alias("times"))
    lexical.ranked_any(index, terms, L.RETRIEVED, read)
    return lexical.postings_read(read)


@_query(f"WITH t AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_all FROM t GROUP BY 1")
def vocabulary(spark, sf_dir):
    """Document and collection frequency of every word."""
    terms = lexical.vocabulary(_chunks(spark, sf_dir).select("chunk_id", "body"), {"body": 1.0}, stem=False, tokens=T.ascii_tokens)
    return terms.select("term", F.col("df").alias("n_docs"), F.col("cf").cast("long").alias("n_all"))


def _sql_porter(words: str) -> str:
    """Tables p0 to p5 of the words of a query (term) and their Porter stems (term, w), by letters read as vowels and consonants."""

    def kinds(x: str) -> str:  # y is a vowel behind a consonant
        x = f"regexp_replace(regexp_replace(translate({x}, 'aeiou', 'VVVVV'), '[^Vy]', 'C', 'g'), '^y', 'C')"
        for _ in range(3):
            x = f"replace(replace({x}, 'Cy', 'CV'), 'Vy', 'VC')"
        return x

    measure = lambda x: f"len(regexp_extract_all({kinds(x)}, 'V+C+'))"
    short = lambda x: f"({measure(x)} = 1 AND ends_with({kinds(x)}, 'CVC') AND NOT regexp_matches({x}, '[wxy]$'))"
    ending = lambda ends: "CASE " + " ".join(f"WHEN ends_with(w, '{e}') THEN '{e}'" for e in sorted(ends, key=len, reverse=True)) + " ELSE '' END"

    def replaced(table: dict[str, str], before: str) -> str:
        to = "MAP {" + ", ".join(f"'{e}': '{t}'" for e, t in table.items()) + "}"
        return f"SELECT term, plain, CASE WHEN plain AND e <> '' AND {measure('h')} > 0 THEN h || {to}[e] ELSE w END AS w FROM (SELECT *, w[:length(w) - length(e)] AS h FROM (SELECT *, {ending(table)} AS e FROM {before}))"

    return f"""
p0 AS (SELECT term, length(term) >= 3 AND regexp_matches(term, '^[a-z]+$') AS plain, CASE WHEN NOT plain THEN term WHEN ends_with(term, 'sses') OR ends_with(term, 'ies') THEN term[:-3] WHEN ends_with(term, 's') AND NOT ends_with(term, 'ss') THEN term[:-2] ELSE term END AS w FROM ({words})),
pe AS (SELECT term, plain, w, CASE WHEN NOT plain OR ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') THEN w[:-3] WHEN ends_with(w, 'ing') THEN w[:-4] END AS h FROM p0),
p1 AS (SELECT term, plain, CASE WHEN plain AND ends_with(w, 'eed') THEN CASE WHEN {measure("w[:-4]")} > 0 THEN w[:-2] ELSE w END WHEN h IS NULL OR NOT contains({kinds("h")}, 'V') THEN w
  WHEN regexp_matches(h, '(at|bl|iz)$') THEN h || 'e' WHEN h[-1] = h[-2] AND length(h) > 1 AND NOT regexp_matches(h, '[aeiouylsz]$') THEN h[:-2] WHEN {short("h")} THEN h || 'e' ELSE h END AS w FROM pe),
py AS (SELECT term, plain, CASE WHEN plain AND ends_with(w, 'y') AND contains({kinds("w[:-2]")}, 'V') THEN w[:-2] || 'i' ELSE w END AS w FROM p1),
p2 AS ({replaced(T._STEP2, "py")}),
p3 AS ({replaced(T._STEP3, "p2")}),
p4 AS (SELECT term, plain, CASE WHEN plain AND e <> '' AND {measure("h")} > 1 AND (e <> 'ion' OR regexp_matches(h, '[st]$')) THEN h ELSE w END AS w FROM (SELECT *, w[:length(w) - length(e)] AS h FROM (SELECT *, {ending([*T._STEP4, "ion"])} AS e FROM p3))),
pf AS (SELECT term, plain, CASE WHEN plain AND ends_with(w, 'e') AND ({measure("w[:-2]")} > 1 OR ({measure("w[:-2]")} = 1 AND NOT {short("w[:-2]")})) THEN w[:-2] ELSE w END AS w FROM p4),
p5 AS (SELECT term, CASE WHEN plain AND ends_with(w, 'll') AND {measure("w")} > 1 THEN w[:-2] ELSE w END AS w FROM pf)"""


_DOCUMENT_WORDS = "SELECT DISTINCT unnest(" + _PLACED.format("text") + ") AS term FROM documents"


@_query(f"WITH {_sql_porter(_DOCUMENT_WORDS).lstrip()} SELECT term, w AS stem FROM p5")
def porter_vocabulary(spark, sf_dir):
    """The stem of every word of the documents."""
    words = _table(spark, sf_dir, "documents").select(F.explode(T.index_tokens(F.col("text"))).alias("term")).distinct()
    return words.withColumn("stem", T.porter_stem("term"))


@_query(f"""
WITH c AS ({_CHUNKS}), said AS (SELECT item_id, {_PLACED.format("text")} AS ws FROM benchmark),
asked AS (SELECT item_id * 1000 + p AS query_id, unnest(ws[2 * p + 1:2 * p + 2]) AS term FROM (SELECT item_id, ws, unnest(range(len(ws) // 2)) AS p FROM said)),
field AS (SELECT chunk_id, 8.0 AS wt, {_PLACED.format("title")} AS ws FROM c UNION ALL SELECT chunk_id, 1.0, {_PLACED.format("category")} FROM c UNION ALL SELECT chunk_id, 2.0, {_PLACED.format("route")} FROM c
  UNION ALL SELECT chunk_id, 3.0, {_PLACED.format("heading_path")} FROM c UNION ALL SELECT chunk_id, 1.0, {_PLACED.format("body")} FROM c),
l AS (SELECT chunk_id, sum(len(ws)) AS dl FROM field GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
word AS (SELECT chunk_id, wt, unnest(ws) AS term FROM field),
{_sql_porter("SELECT term FROM word UNION SELECT term FROM asked").lstrip()},
tf AS (SELECT chunk_id, w, sum(wt) AS tf FROM word JOIN p5 USING (term) GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT query_id, w, count(*) AS times FROM asked JOIN p5 USING (term) GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score, sum(times) AS met FROM q JOIN tf USING (w) JOIN df USING (w) JOIN l USING (chunk_id), st GROUP BY ALL)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE met = 2) WHERE rank <= 30""")
def bm25_stemmed(spark, sf_dir):
    """Documents with the stems of every two words of a benchmark item in a row, in weighted fields."""
    words = F.transform(T.index_tokens(F.col("text")), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = _table(spark, sf_dir, "benchmark").select("item_id", words.alias("ws"))
    pairs = F.transform(F.filter("ws", lambda x: (x["i"] % 2 == 0) & (x["i"] + 1 < F.size("ws"))), lambda x: F.struct((x["i"] / 2).cast("int").alias("p"), F.array(x["w"], F.get("ws", x["i"] + 1)["w"]).alias("two")))
    rows = rows.select("item_id", F.inline(pairs))
    asked = rows.select((F.col("item_id") * 1000 + F.col("p")).cast("long").alias("query_id"), lexical.all_of(F.col("two")).alias("groups"))
    return lexical.bm25(_texts(spark, sf_dir, "stems"), asked, digits=6)


_NEAREST = """
SELECT query_id, chunk_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS d,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), v.vec_id) AS rank
  FROM embeddings q, embeddings v{}) WHERE rank <= {}"""
_vector_indexes: dict[tuple, vectors.VectorIndex] = {}


def _vectors(spark: SparkSession, sf_dir: str) -> vectors.VectorIndex:
    """The index of the given embeddings, made once a session as long as their files stay as they are."""
    key = (spark.sparkContext.applicationId, sources.fingerprint(spark, f"{sf_dir}/embeddings.parquet"))
    if key not in _vector_indexes:
        _vector_indexes[key] = vectors.build(_table(spark, sf_dir, "embeddings"))
    return _vector_indexes[key]


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"), "rank")


def _hundredth(spark, sf_dir):
    return _table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@_query(_NEAREST.format(" WHERE q.vec_id % 100 = 0", 30))
def knn_l2(spark, sf_dir):
    """The 30 nearest vectors of every hundredth one, exactly, ring by ring."""
    return _rounded(vectors.nearest(_vectors(spark, sf_dir), _hundredth(spark, sf_dir)))


@_query(_NEAREST.format("", 5))
def knn_codes(spark, sf_dir):
    """The five nearest vectors of every vector: codes of a byte a component first, then exact distances of what is left."""
    asked = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return _rounded(vectors.nearest(_vectors(spark, sf_dir), asked, 5, coded=True))


@_query()
def knn_parts_looked_at(spark, sf_dir):
    """How many rings of vectors there are, and how many of them each search of knn_l2 looks at."""
    index, looked = _vectors(spark, sf_dir), {}
    vectors.nearest(index, _hundredth(spark, sf_dir), looked=looked)
    return vectors.parts_looked_at(index, looked)


def _by_type(spark, sf_dir):
    e = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("query_id"), F.col("user_id").alias("chunk_id"))
    sums = e.agg(F.round(F.sum("value"), 4).alias("a"), F.count(F.lit(1)).alias("b"), F.max("value").alias("c"))
    return [lexical.best(sums.select("query_id", "chunk_id", F.col(x).cast("double").alias("score")), L.RETRIEVED) for x in "abc"]


@_query("""
WITH s AS (SELECT event_type AS query_id, user_id AS chunk_id, round(sum(value), 4) AS a, count(*) AS b, max(value) AS c FROM events GROUP BY ALL),
r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY a DESC, chunk_id) AS ra,
  row_number() OVER (PARTITION BY query_id ORDER BY b DESC, chunk_id) AS rb, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, chunk_id) AS rc FROM s),
f AS (SELECT query_id, chunk_id, round(CASE WHEN ra <= 30 THEN 1.0 / (60 + ra) ELSE 0 END + CASE WHEN rb <= 30 THEN 0.6 / (60 + rb) ELSE 0 END + CASE WHEN rc <= 30 THEN 1.0 / (60 + rc) ELSE 0 END, 9) AS score
  FROM r WHERE least(ra, rb, rc) <= 30)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 20""")
def rrf_weighted(spark, sf_dir):
    """Three rankings of users by event type, fused with weights and cut."""
    fused = fusion.rrf(_by_type(spark, sf_dir), L.RRF_WEIGHTS).withColumn("score", F.round("score", 9))
    return fusion.top(fused).select("query_id", "chunk_id", "score", "rank")


@_query("""
WITH d AS (SELECT lang AS query_id, doc_id AS chunk_id, n_chars::DOUBLE AS score, nullif(source, 'src1') AS route FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, coalesce(route, '#' || chunk_id) ORDER BY score DESC, chunk_id) AS n FROM d)
SELECT query_id, chunk_id, score, route, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM o WHERE n = 1) WHERE rank <= 20""")
def route_dedupe(spark, sf_dir):
    """The longest document of each source and language; one source counts as without a route."""
    d = _table(spark, sf_dir, "documents")
    cands = d.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("n_chars").cast("double").alias("score"), F.nullif(F.col("source"), F.lit("src1")).alias("route"))
    return fusion.top(fusion.one_per_route(cands)).select("query_id", "chunk_id", "score", "route", "rank")


@_query(f"""
WITH d AS (SELECT heading_path AS query_id, chunk_id, length(body)::DOUBLE AS score, route, title FROM ({_CHUNKS})),
o AS (SELECT *, split_part(route, '/', 1) || '/' || split_part(route, '/', 2) AS fam FROM d),
k AS (SELECT *, row_number() OVER w AS n, first_value(fam) OVER w AS f FROM o WINDOW w AS (PARTITION BY query_id, title ORDER BY score DESC, chunk_id))
SELECT query_id, chunk_id, route FROM k WHERE n = 1 OR fam <> f OR title IS NULL""")
def near_duplicate_titles(spark, sf_dir):
    """Documents but those with the title and route family of a longer one."""
    c = _chunks(spark, sf_dir)
    cands = c.select(F.col("heading_path").alias("query_id"), "chunk_id", F.length("body").cast("double").alias("score"), "route", "title", "heading_path")
    return fusion.near_duplicates_out(cands, [F.col("score").desc(), F.col("chunk_id")]).select("query_id", "chunk_id", "route")


_PART_ROUTE = "CASE WHEN p_size <= 10 THEN 'api/payments/' WHEN p_size <= 20 THEN 'webhooks/payouts/' WHEN p_size <= 30 THEN 'payments/server-integration/' WHEN p_size <= 40 THEN 'x/' ELSE 'pos/' END || replace(lower(p_name), ' ', '-')"


def _parts(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    first, last = F.split("p_name", " ")[0], F.element_at(F.split("p_name", " "), -1)
    return p.select(
        F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("chunk_id"), F.col("p_retailprice").alias("score"), F.expr(_PART_ROUTE).alias("route"),
        F.when(F.col("p_type") == "SMALL", "announcements").otherwise("other").alias("category"), F.when(F.col("p_size") <= 25, "payments").otherwise("x").alias("soft_product"),
        F.when(F.col("p_size") > 15, "webhooks").otherwise("integration").alias("topic"), F.array(F.when(F.col("p_type") == "ECONOMY", F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(first), F.concat(last, F.lit("s"))).alias("tokens"),
    )


@_query(f"""
WITH p AS (SELECT p_brand AS query_id, p_partkey AS chunk_id, p_retailprice AS s, {_PART_ROUTE} AS route, p_type, p_size, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', -1) AS z, p_name FROM part),
b AS (SELECT *, (p_size <= 25 AND (starts_with(route, 'api/payments/') OR starts_with(route, 'payments/') OR starts_with(route, 'webhooks/'))) OR (p_size > 25 AND (starts_with(route, 'x/') OR starts_with(route, 'webhooks/payouts'))) AS soft,
  (p_size > 15 AND starts_with(route, 'webhooks/')) OR (p_size <= 15 AND starts_with(route, 'payments/server-integration/')) AS topic,
  (CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END) + (({_sql_stem("(z || 's')")}) = ({_sql_stem('z')}))::INT AS hits FROM p)
SELECT query_id, chunk_id, route, round(s * CASE WHEN soft THEN 1.2 ELSE 1 END * CASE WHEN topic THEN 1.6 ELSE 1 END
  * CASE WHEN p_type = 'ECONOMY' THEN 1.8 WHEN hits >= 2 THEN 1.25 + 0.4 * hits ELSE 1.25 END * CASE WHEN p_type = 'SMALL' THEN 1.1 ELSE 1 END, 4) AS score FROM b""")
def candidate_boosts(spark, sf_dir):
    """Parts as candidates, with all boosts."""
    return fusion.boosted(_parts(spark, sf_dir), LEXICON).select("query_id", "chunk_id", "route", F.round("score", 4).alias("score"))


@_query(f"""
WITH p AS (SELECT p_partkey AS chunk_id, {_PART_ROUTE} AS route, CASE WHEN p_size <= 25 THEN 'payments' ELSE 'x' END AS product FROM part)
SELECT chunk_id, product FROM p WHERE (product = 'payments' AND (starts_with(route, 'payments/') OR starts_with(route, 'api/payments/') OR starts_with(route, 'webhooks/')))
  OR (product = 'x' AND (starts_with(route, 'x/') OR starts_with(route, 'webhooks/payouts')))""")
def product_filter(spark, sf_dir):
    cands = _parts(spark, sf_dir).withColumnRenamed("soft_product", "product")
    return fusion.only_product(cands, LEXICON).select("chunk_id", "product")


_STOP = "[" + ", ".join(f"'{w}'" for w in LEXICON.stopwords) + "]"


def _rewrite_ctes(said: str) -> str:
    """Tables r, n, k, m, o: texts said, without noise, their words, the words' stems, and words whose stem is the first of its kind."""
    return f"""
r AS ({said}),
n AS (SELECT *, {_sql_noise("lower(said)")} AS bare FROM r),
k AS (SELECT *, list_filter(regexp_extract_all(bare, '[a-z0-9][a-z0-9_-]*'), lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x)) AS t FROM n),
m AS (SELECT *, list_transform(t, lambda x: {_sql_stem("x")}) AS stems FROM k),
o AS (SELECT *, list_filter(t, lambda x, i: list_position(stems, stems[i]) = i) AS tokens FROM m)"""



def _sql_groups(lexicon: L.Lexicon) -> tuple[str, str]:
    """A map of terms to the number of their synonym group, and the groups."""
    numbers = "MAP {" + ", ".join(f"'{t}': {i + 1}" for t, i in lexicon.group_of().items()) + "}"
    return numbers, "[" + ", ".join("[" + ", ".join(f"'{t}'" for t in g) + "]" for g in lexicon.synonyms) + "]"


_GROUP_OF, _GROUPS = _sql_groups(LEXICON)


@_query(f"""
WITH {_rewrite_ctes("SELECT conv_id, turn, trim(coalesce(text, '')) AS said FROM conversations")},
g AS (SELECT *, list_transform(tokens, lambda x: {_GROUP_OF}[x]) AS gs FROM o)
SELECT conv_id, turn, CASE WHEN bare <> '' THEN bare ELSE lower(said) END AS cleaned, array_to_string(tokens, ' ') AS tokens,
  array_to_string(list_transform(list_filter(tokens, lambda x, i: gs[i] IS NULL OR list_position(gs, gs[i]) = i), lambda x: coalesce(array_to_string({_GROUPS}[{_GROUP_OF}[x]], '|'), x)), ' & ') AS groups,
  {_sql_hints("said", L.LANGUAGE_HINTS)} AS language, {_sql_hints("said", LEXICON.product_hints)} AS product, {_sql_hints("said", L.TOPIC_HINTS)} AS topic FROM g""")
def query_rewrite(spark, sf_dir):
    """Every conversation turn read as a query."""
    rows = rewrite.rewritten(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), LEXICON, "text")
    groups = F.array_join(F.transform("synonym_groups", lambda g: F.array_join(g, "|")), " & ")
    return rows.select("conv_id", "turn", "cleaned", F.array_join("tokens", " ").alias("tokens"), groups.alias("groups"), *[F.col(f"detected_{n}").alias(n) for n in ("language", "product", "topic")])


@_query(f"WITH w AS (SELECT DISTINCT unnest({_WORDS.format('text')}) AS token FROM documents) SELECT token, {_sql_stem('token')} AS stem FROM w")
def plural_stems(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select(F.explode(T.ascii_tokens(F.col("text"))).alias("token")).distinct()
    return words.withColumn("stem", T.plural_stem(F.col("token")))


def _markdown(spark, sf_dir):
    """Each conversation as a Markdown document with a heading for each turn."""
    part = F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit(" "), F.col("turn").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("x"))
    return c.select(F.concat(F.lit("chat/"), F.col("conv_id").cast("string")).alias("route"), F.col("conv_id").alias("ordinal"), F.lit("chat").alias("title"), F.lit(None).cast("string").alias("description"), F.lit("chats").alias("category"), F.array_join("x.p", "\n\n").alias("body"))


_TURNS = r"SELECT conv_id, turn, coalesce(role, '') || ' ' || turn AS h, regexp_replace('## ' || coalesce(role, '') || ' ' || turn || chr(10) || chr(10) || coalesce(text, ''), '\s+$', '') AS b FROM conversations"


@_query(f"""
SELECT row_number() OVER (ORDER BY conv_id, turn) AS chunk_id, 'chat/' || conv_id AS route, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index,
  h AS heading_path, sha256(b) AS body_hash, ceil(length(b) / 4)::BIGINT AS n_tokens FROM ({_TURNS})""")
def chunked_documents(spark, sf_dir):
    """Conversations as Markdown, cut into chunks at their headings."""
    out = sections.chunk_docs(_markdown(spark, sf_dir))
    return out.select("chunk_id", "route", "chunk_index", "heading_path", F.sha2("body", 256).alias("body_hash"), "n_tokens")


@_query("SELECT event_id, 0 AS ordinal, 'json' AS language, event_type AS label, props AS code FROM events")
def code_fences(spark, sf_dir):
    """Event properties in code fences, and taken out of them again."""
    body = F.concat(F.lit("before\n```json: "), "event_type", F.lit("\n"), "props", F.lit("\n```\nafter"))
    rows = _table(spark, sf_dir, "events").select("event_id", F.explode(sections.code_blocks(body)).alias("b"))
    return rows.select("event_id", *[F.col(f"b.{c}").cast("int" if c == "ordinal" else "string").alias(c) for c in ("ordinal", "language", "label", "code")])


def _published(spark, sf_dir):
    """An index of the conversations, published and opened again: a section for each turn, its text fenced, and a link to the next conversation or the same."""
    turn, ends = F.col("turn"), F.concat(F.lit("\n\nSee https://raw.githubusercontent.com/o/r/master/chat/"), (F.col("conv_id") + F.when(F.col("turn") % 2 == 0, 1).otherwise(0)).cast("string"), F.lit(".md"))
    fence = F.when(turn % 4 == 0, "JS").when(turn % 4 == 1, "py").when(turn % 4 == 2, "Ruby").otherwise("text")
    label = F.when(turn % 3 == 0, F.concat(F.lit(": "), "role")).otherwise("")
    part = F.concat(F.lit("## Turn "), turn.cast("string"), F.lit("\n\n```"), fence, F.coalesce(label, F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n```"), ends)
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("x"))
    route = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"))
    docs = c.select(route.alias("route"), F.col("conv_id").alias("ordinal"), F.upper(route).alias("title"), F.lit(None).cast("string").alias("description"), F.lit("chats").alias("category"), F.lit("").alias("url"), F.array_join("x.p", "\n\n").alias("body"))
    folder = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    sources.publish_index(docs, folder, "https://example.com", "abc")
    return engine.Corpus.current(spark, folder)


@_query("""
SELECT chunk_id, route, chunk_index, 'Turn ' || turn AS heading_path, 0 AS ordinal, CASE turn % 4 WHEN 0 THEN 'node' WHEN 1 THEN 'python' WHEN 2 THEN 'ruby' ELSE 'unknown' END AS language,
  CASE WHEN turn % 3 = 0 THEN nullif(role, '') END AS label, sha256(coalesce(text, '')) AS code_hash, turn % 4 <> 3 AS shown, turn % 4 = 1 AS shown_for_python
FROM (SELECT *, 'chat/' || conv_id AS route, row_number() OVER (ORDER BY conv_id, turn) AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index FROM conversations)""")
def published_blocks(spark, sf_dir):
    """Code blocks of a published index of the conversations, and whether a result shows them to who asks for no language, and for Python."""
    chunks = _published(spark, sf_dir).chunks
    shown = lambda language: F.exists(assemble.shown_blocks(F.array("b"), F.lit(language).cast("string")), lambda x: F.lit(True))
    rows = chunks.select("chunk_id", "route", "chunk_index", "heading_path", F.explode("code_blocks").alias("b"))
    return rows.select("chunk_id", "route", "chunk_index", "heading_path", "b.ordinal", "b.language", "b.label", F.sha2("b.code", 256).alias("code_hash"), shown(None).alias("shown"), shown("python").alias("shown_for_python"))


@_query("""
WITH c AS (SELECT conv_id, bool_or(turn % 2 = 0) AS links FROM conversations GROUP BY 1)
SELECT 'chat/' || a.conv_id AS route, upper('chat/' || a.conv_id) AS title, 'https://example.com/docs/chat/' || a.conv_id || '/' AS url, coalesce('chat/' || b.conv_id || ':CHAT/' || b.conv_id, '') AS related
FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id + 1 AND a.links""")
def published_routes(spark, sf_dir):
    """Routes of a published index of the conversations, fetched by their urls, with the routes that they link to."""
    corpus = _published(spark, sf_dir)
    got = engine.get_docs(corpus.routes.select(F.col("url").alias("said")), corpus)
    return got.filter("found").select("route", "title", "url", F.array_join(F.transform("related", lambda r: F.concat_ws(":", r["route"], r["title"])), " ").alias("related"))


def _page_links(spark, sf_dir):
    p = _table(spark, sf_dir, "pages")
    to = F.transform(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)), lambda r: F.struct(r.alias("route"), F.lit(None).cast("string").alias("anchor")))
    return p.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("route"), F.array_distinct(to).alias("cross_links"))


_EDGES = "SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS route, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS dst FROM pages"


@_query(f"SELECT route, string_agg(dst, ' ' ORDER BY dst) AS targets, count(*) AS n FROM ({_EDGES}) WHERE route <> dst GROUP BY 1")
def link_graph(spark, sf_dir):
    """Links between hosts and paths."""
    g = sections.link_graph(_page_links(spark, sf_dir))
    return g.select("route", F.array_join("targets", " ").alias("targets"), F.size("targets").cast("long").alias("n"))


@_query(f"""
WITH e AS (SELECT * FROM ({_EDGES}) WHERE route <> dst), known AS (SELECT DISTINCT r, upper(r) AS title FROM (SELECT unnest(string_split(text, ' ')) AS r FROM benchmark)),
k AS (SELECT route, dst, title, row_number() OVER (PARTITION BY route ORDER BY dst) AS n FROM e JOIN known ON r = dst)
SELECT route, string_agg(dst || ':' || title, ' ' ORDER BY n) AS related FROM k WHERE n <= 3 GROUP BY 1""")
def related_routes(spark, sf_dir):
    """The first three links of a host to known routes, which are the words of the benchmark."""
    g = sections.link_graph(_page_links(spark, sf_dir))
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("route"))
    routes = words.distinct().withColumn("title", F.upper("route"))
    said = F.transform("related", lambda r: F.concat_ws(":", r["route"], r["title"]))
    return assemble.related(routes, g).select("route", F.array_join(said, " ").alias("related"))


@_query("""
WITH s AS (SELECT page_id, unnest([url, replace(replace(replace(url, '.com/', '.com/docs/'), '.net/', '.net/docs/'), '.org/', '.org/docs/'), '/' || split_part(url, '/', 4) || '/x/']) AS said FROM pages)
SELECT page_id, said, CASE WHEN starts_with(said, 'http') THEN coalesce(nullif(regexp_extract(said, '/docs/([^?#]+?)/?$', 1), ''), nullif(regexp_extract(said, 'master/(.+?)\\.md', 1), ''))
  ELSE regexp_replace(said, '^/+|/+$', '', 'g') END AS route FROM s""")
def route_parse(spark, sf_dir):
    """Urls, urls with /docs/ and bare paths read as routes."""
    url = F.col("url")
    docs = url
    for d in ("com", "net", "org"):
        docs = F.replace(docs, F.lit(f".{d}/"), F.lit(f".{d}/docs/"))
    bare = F.concat(F.lit("/"), F.coalesce(F.get(F.split(url, "/", -1), F.lit(3)), F.lit("")), F.lit("/x/"))
    rows = _table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(url, docs, bare)).alias("said"))
    return rows.withColumn("route", T.route_of(F.col("said")))


_BREAKS = "replace(text, chr(10), chr(10) || chr(10))"


@_query(f"""
WITH b AS (SELECT doc_id, {_BREAKS} AS t FROM documents), w AS (SELECT *, left(t, 2400) AS w FROM b),
p AS (SELECT *, CASE WHEN contains(w, chr(10) || chr(10)) THEN length(w) - strpos(reverse(w), chr(10) || chr(10)) - 1 ELSE -1 END AS cut FROM w)
SELECT doc_id, sha256(CASE WHEN length(t) <= 2400 THEN t WHEN cut > 1440 THEN regexp_replace(left(w, cut), '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(w, '^\\s+|\\s+$', '', 'g') END) AS excerpt,
  left(split_part(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10), 1), 240) AS summary, ceil(length(t) / 4)::BIGINT AS n_tokens FROM p""")
def excerpts(spark, sf_dir):
    """Excerpt, summary and estimated tokens of every document, its lines as paragraphs."""
    t = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.sha2(T.truncated(F.col("t")), 256).alias("excerpt"), T.summary(F.lit(None).cast("string"), F.col("t"), 240).alias("summary"), T.approx_tokens(F.col("t")).alias("n_tokens"))


@_query(f"""
WITH w AS (SELECT conv_id, string_agg(b, chr(10) || chr(10) ORDER BY turn) AS t FROM ({_TURNS}) GROUP BY 1)
SELECT 'chat/' || conv_id AS route, TRUE AS found, sha256(left(t, 32000)) AS body_hash, length(t) > 32000 AS truncated FROM w
UNION ALL SELECT 'lost/' || conv_id, FALSE, NULL, FALSE FROM w""")
def whole_documents(spark, sf_dir):
    """Every conversation fetched by its url, and as many routes that aren't there."""
    docs = _markdown(spark, sf_dir)
    chunks = sections.chunk_docs(docs)
    routes = docs.select("route", "title", assemble.canonical_url(F.col("route"), "https://example.com").alias("url"))
    asked = routes.select("url", "route").select(F.explode(F.array("url", F.concat(F.lit("lost/"), F.substring_index("route", "/", -1)))).alias("said"))
    return assemble.documents(asked, chunks, routes).select("route", "found", F.sha2("body", 256).alias("body_hash"), "truncated")


@_query(f"""
WITH {_BM25_CTES}, c AS ({_CHUNKS}), h AS (SELECT query_id, chunk_id, score, c.* EXCLUDE (chunk_id) FROM ranked JOIN c USING (chunk_id) WHERE rank <= 30),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY score DESC, chunk_id) AS n FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f WHERE n = 1)
SELECT query_id, rank, chunk_id, score, route, title, left(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), 240) AS summary, 'https://example.com/docs/' || route || '/' AS url FROM r WHERE rank <= 3""")
def assembled_results(spark, sf_dir):
    """The three best results of each benchmark item with their texts."""
    chunks = _chunks(spark, sf_dir).withColumn("code_blocks", F.array().cast("array<struct<ordinal:int,language:string,label:string,code:string>>"))
    routes = chunks.select("route", assemble.canonical_url(F.col("route"), "https://example.com").alias("url"))
    cands = _any_bm25(spark, sf_dir).withColumn("language", F.lit(None).cast("string"))
    return assemble.assembled(cands, chunks, routes, None, 3, "https://example.com").select("query_id", "rank", "chunk_id", "score", "route", "title", "summary", "url")


@_query(f"""
WITH {_BM25_CTES}, c AS (SELECT r.query_id, r.chunk_id, r.score AS fused, i.text AS q, left(coalesce(d.text, ''), {L.RERANK_CAP}) AS t FROM ranked r JOIN benchmark i ON i.item_id = r.query_id JOIN documents d ON d.doc_id = r.chunk_id WHERE rank <= 20),
s AS (SELECT query_id, chunk_id, length(q) % 5 <> 0 AS reranked, CASE WHEN length(q) % 5 = 0 THEN fused ELSE (length(t) * 7 + length(q)) % 1000 - 500 END::DOUBLE AS score FROM c)
SELECT query_id, chunk_id, reranked, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s""")
def reranked_results(spark, sf_dir):
    """The 20 best documents of each item, ranked anew by a pair scorer that fails for some of the items: these stay as they were."""

    def load():
        def run(pairs):
            if len(pairs[0][0]) % 5 == 0:
                raise RuntimeError("no score")
            return [float((len(t) * 7 + len(q)) % 1000 - 500) for q, t in pairs]

        return run

    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.substring("text", 1, L.RERANK_CAP).alias("t"))
    cands = _any_bm25(spark, sf_dir, 20).drop("rank").join(items, "query_id").join(texts, "chunk_id")
    return lexical.best(fusion.reranked(cands, "q", "t", fusion.Reranker(load, 8)), 20).select("query_id", "chunk_id", "reranked", "score", "rank")


@_query("""
WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, conv_id % 5 AS k FROM conversations)
SELECT 'q' || lpad((conv_id % 1000)::VARCHAR, CASE WHEN k = 2 THEN 2 ELSE 3 END, '0') AS id, turn,
  CASE k WHEN 1 THEN 'not JSON' WHEN 2 THEN 'id' WHEN 3 THEN 'query' WHEN 4 THEN 'expected_routes' END AS problem FROM c""")
def query_set_problems(spark, sf_dir):
    """Conversation turns written as a query set, four fifths of whose lines are broken in some way, and what is said of each line."""
    c = _table(spark, sf_dir, "conversations")
    k = F.pmod("conv_id", F.lit(5))
    name = F.concat(F.lit("q"), F.lpad(F.pmod("conv_id", F.lit(1000)).cast("string"), 3, "0"))
    name = F.when(k == 2, F.concat(F.lit("q"), F.lpad(F.pmod("conv_id", F.lit(1000)).cast("string"), 2, "0"))).otherwise(name)
    said = F.to_json(F.struct(name.alias("id"), F.when(k == 3, "ab").otherwise(F.rpad(F.substring(F.coalesce("text", F.lit("")), 1, 200), 200, ".")).alias("query"), F.when(k == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("a/b"))).alias("expected_routes")))
    tagged = F.when(k == 1, F.substring(said, F.lit(1), F.length(said) - 1)).otherwise(said)
    folder = f"{shared_folder(spark)}/query-set-{uuid.uuid4().hex}"
    c.select(tagged.alias("value"), "turn").write.partitionBy("turn").text(folder)
    lines = sources.eval_lines(spark, folder)
    turn = F.regexp_extract("file", r"turn=([0-9]+)/", 1).cast("long")
    return lines.select(F.coalesce("id", F.regexp_extract("said", '"id":"([^"]*)"', 1)).alias("id"), turn.alias("turn"), "problem")


_TARGETS = "t AS (SELECT query_id, chunk_id FROM scored s JOIN (SELECT query_id, count(*) AS k FROM q GROUP BY 1) USING (query_id) WHERE met = k)"
_HITS = f"{_BM25_CTES}, {_TARGETS}, h AS (SELECT i.item_id AS query_id, coalesce(min(r.rank), 0) AS hit_rank FROM benchmark i LEFT JOIN (SELECT r.* FROM ranked r JOIN t USING (query_id, chunk_id) WHERE rank <= 10) r ON r.query_id = i.item_id GROUP BY 1)"


def _first_hits(spark, sf_dir):
    """Benchmark items; documents with all their words are expected, and the ten best by any word are the results."""
    texts = _texts(spark, sf_dir, "body")  # both searches ask for the same words, which are looked up once
    found = _any_bm25(spark, sf_dir, 10, texts).select("query_id", F.col("chunk_id").cast("string").alias("route"), "rank")
    expected = bm25_fields_free(spark, sf_dir, texts).groupBy("query_id").agg(F.collect_list(F.col("chunk_id").cast("string")).alias("expected_routes"))
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")).join(expected, "query_id", "left")
    queries = queries.withColumn("acceptable_routes", F.lit(None).cast("array<string>"))
    return queries, evaluate.first_hit(queries, found)


def bm25_fields_free(spark, sf_dir, texts=None):
    return lexical.bm25(texts or _texts(spark, sf_dir, "body"), _items(spark, sf_dir).select("query_id", lexical.all_of(F.col("tokens")).alias("groups")), k=None)


_METRICS = "count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN hit_rank BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END), 9) AS recall_{k}" for k in (1, 3, 10)) + ", round(avg(CASE WHEN hit_rank > 0 THEN 1.0 / hit_rank ELSE 0.0 END), 9) AS mrr"


@_query(f"WITH {_HITS} SELECT {_METRICS} FROM h")
def retrieval_metrics(spark, sf_dir):
    """Recall and reciprocal rank over the benchmark items."""
    m = evaluate.metrics(_first_hits(spark, sf_dir)[1])
    return m.select("n", *[F.round(c, 9).alias(c) for c in ("recall_1", "recall_3", "recall_10", "mrr")])


@_query(f"WITH {_HITS} SELECT query_id, hit_rank FROM h")
def first_hits(spark, sf_dir):
    """The rank of the first expected document of each item, 0 for a miss."""
    return _first_hits(spark, sf_dir)[1]


@_query("""
WITH v AS (SELECT event_type, list_sort(list(value)) AS x FROM events GROUP BY 1 UNION ALL SELECT 'all', list_sort(list(value)) FROM events)
SELECT event_type, x[least(len(x), floor(len(x) * 50 / 100) + 1)::INT] AS p50, x[least(len(x), floor(len(x) * 95 / 100) + 1)::INT] AS p95 FROM v""")
def value_percentiles(spark, sf_dir):
    """Percentiles of event values without interpolation, by type and of all."""
    e = _table(spark, sf_dir, "events")
    whole = evaluate.percentiles(e, "value").select(F.lit("all").alias("event_type"), "p50", "p95")
    return evaluate.percentiles(e, "value", by=["event_type"]).unionByName(whole)


_BUCKET = "CASE WHEN starts_with(r, 'api/') THEN 'api' WHEN starts_with(r, 'webhooks/') THEN 'webhooks' WHEN starts_with(r, 'x/') THEN 'x' WHEN contains(r, '/server-integration/') THEN 'sdk' ELSE 'misc' END"


@_query(f"SELECT c AS category, count(*) AS n, round(avg(CASE WHEN h BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END), 9) AS recall_3, round(avg(CASE WHEN h BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END), 9) AS recall_10 FROM (SELECT {_BUCKET} AS c, h FROM (SELECT {_PART_ROUTE} AS r, p_size AS h FROM part)) GROUP BY 1")
def recall_by_category(spark, sf_dir):
    """Parts as evaluated queries: their routes' categories, and recall in each."""
    rows = _table(spark, sf_dir, "part").select(evaluate.category(F.array(F.expr(_PART_ROUTE))).alias("category"), F.col("p_size").alias("hit_rank"))
    return evaluate.metrics(rows, ["category"]).select("category", "n", F.round("recall_3", 9).alias("recall_3"), F.round("recall_10", 9).alias("recall_10"))


@_query(f"""
WITH p AS (SELECT a.conv_id, lower(coalesce(a.text, '')) AS q, lower(coalesce(b.text, '')) AS low FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn = 0),
w AS (SELECT *, list_filter(regexp_extract_all(q, '[a-z0-9_]+'), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)) AS ws FROM p),
m AS (SELECT *, len(list_filter(ws, lambda x: NOT contains(low, x) AND NOT contains(low, CASE WHEN ends_with(x, 's') AND length(x) > 4 THEN x[:-2] ELSE x END))) AS gone FROM w)
SELECT conv_id, len(ws)::BIGINT AS n_tokens, gone::BIGINT AS n_missing, round(CASE WHEN len(ws) > 0 THEN gone / len(ws) ELSE 0 END, 9) AS share, CASE WHEN len(ws) > 0 THEN gone / len(ws) ELSE 0 END > 0.4 AS doubtful FROM m""")
def keyword_audit(spark, sf_dir):
    """How many words of a conversation's first turn its second turn lacks."""
    c = _table(spark, sf_dir, "conversations")
    pairs = c.filter("turn = 0").select(F.col("conv_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"), F.col("conv_id").alias("route"))
    texts = c.filter("turn = 1").select(F.col("conv_id").alias("route"), F.coalesce("text", F.lit("")).alias("text"))
    out = evaluate.keyword_audit(pairs, texts, LEXICON.stopwords)
    return out.select(F.col("query_id").alias("conv_id"), "n_tokens", "n_missing", F.round("share", 9).alias("share"), "doubtful")


@_query("SELECT l.doc_id::VARCHAR AS route, coalesce(sum(length(d.text)), 0)::BIGINT AS n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1")
def route_sizes(spark, sf_dir):
    """Characters of every labelled document, by a join that keeps all labels."""
    routes = _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("route"))
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("route"), F.col("text").alias("body"))
    return evaluate.route_sizes(routes, chunks)


@_query("SELECT DISTINCT source || '/' || lang AS route FROM documents WHERE contains(text, 'token')")
def routes_with_phrase(spark, sf_dir):
    chunks = _table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("route"), F.col("text").alias("body"))
    return evaluate.routes_with(chunks, "token")


@_query("SELECT doc_id::VARCHAR AS rule_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def citation_gate(spark, sf_dir):
    """Documents as rules that cite labels: those whose citation doesn't resolve."""
    rules = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("rule_id"), F.col("doc_id").alias("route"))
    return lint.unresolved(rules, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("route"))).select("rule_id")


@_query("SELECT doc_id AS chunk_id, sha256(coalesce(text, '')) AS hash, text = replace(text, 'the', 'teh') AS reused FROM documents")
def embedding_reuse(spark, sf_dir):
    """Which documents keep their vectors after an edit of some words."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"))
    model = dense.hashed()
    before = dense.refresh(d.withColumn("body", F.replace("body", F.lit("the"), F.lit("teh"))), None, model)
    return dense.refresh(d, before, model).select("chunk_id", "hash", "reused")


@_query("SELECT doc_id AS chunk_id, sha256(coalesce(text, '')) AS hash, text = replace(text, 'the', 'teh') AS reused FROM documents WHERE doc_id % 7 <> 3")
def vector_refresh(spark, sf_dir):
    """The vector table of a model after an edit of some words and the loss of a seventh of the documents: which vectors stayed."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"))
    table = VectorTable(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", dense.hashed())
    table.refresh(d.withColumn("body", F.replace("body", F.lit("the"), F.lit("teh"))))
    at = table.refresh(d.filter("chunk_id % 7 <> 3"))
    return table.read(at).select("chunk_id", "hash", (F.col("since") < at.number).alias("reused"))


_SNIPPET = """concat('const order = client.orders.create({ amount: ', cast(cast(o_custkey AS BIGINT) * 7 AS STRING), ', currency: "', CASE WHEN o_orderstatus = 'P' THEN 'usd' ELSE 'INR' END, '" });', chr(10),
  CASE WHEN o_orderpriority = '5-LOW' THEN concat('client.payments.refund(id, { speed: "normal" });', chr(10)) WHEN o_orderpriority = '2-HIGH' THEN concat('// client.payments.refund(id);', chr(10)) ELSE '' END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN concat('save({ cvv: 1 });', chr(10)) ELSE '' END)"""


@_query("""
SELECT o_orderkey, 'node' AS language_detected, array_to_string(list_sort(list_filter([
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'L009:2' END, CASE WHEN o_orderstatus <> 'P' AND o_custkey * 7 BETWEEN 1 AND 9999 THEN 'L003:1' END,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'L008:2' END, CASE WHEN o_orderstatus = 'P' THEN 'L022:1' END], lambda x: x IS NOT NULL)), ' ') AS issues FROM orders""")
def lint_snippets(spark, sf_dir):
    """A code snippet for every order, and what the rules say of it."""
    code = F.expr(_SNIPPET.replace("chr(10)", "'\\n'"))
    rows = lint.lint(_table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code")))
    said = F.array_sort(F.transform("issues", lambda i: F.concat_ws(":", i["rule_id"], i["line"].cast("string"))))
    return rows.select("o_orderkey", "language_detected", F.array_join(said, " ").alias("issues"))


@_query("""
SELECT o_orderkey, (a + b + c + d)::BIGINT AS total, a::BIGINT AS n_error, (b + c + d)::BIGINT AS n_warning, 0::BIGINT AS n_info, 30::BIGINT AS rules_evaluated, 'node' AS language_detected
FROM (SELECT o_orderkey, (o_orderpriority = '1-URGENT')::INT AS a, (o_orderstatus <> 'P' AND o_custkey * 7 BETWEEN 1 AND 9999)::INT AS b, (o_orderpriority = '5-LOW')::INT AS c, (o_orderstatus = 'P')::INT AS d FROM orders)""")
def lint_report(spark, sf_dir):
    code = F.expr(_SNIPPET.replace("chr(10)", "'\\n'"))
    return lint.report(lint.lint(_table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"))), "o_orderkey")


def _cases() -> list[tuple[int, str, str, int | None]]:
    flat = [(f"L{n:03d}", code, line) for n, cases in CASES.items() for code, line in cases]
    return [(i, *c) for i, c in enumerate(flat)]


_CASE_ROWS = ", ".join(f"({i}, '{rule}', {'NULL' if line is None else line})" for i, rule, _, line in _cases())


@_query(f"""
WITH k AS (SELECT * FROM (VALUES {_CASE_ROWS}) AS k(i, rule_id, line))
SELECT c_custkey, rule_id, coalesce((line + c_custkey % 5)::VARCHAR, '') AS lines FROM customer JOIN k ON i = c_custkey % {len(_cases())}""")
def lint_rules(spark, sf_dir):
    """Snippets of every rule, dealt out to the customers behind some lines beyond the BMP, and the lines that the rule hits."""
    cases = spark.createDataFrame([c[:3] for c in _cases()], "i int, rule_id string, snippet string")  # as many rows as there are cases
    c = spread(_table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(_cases())).cast("int").alias("i")))
    code = F.concat(F.repeat(F.lit("\U0001f600\U0001f600\n"), (F.col("c_custkey") % 5).cast("int")), "snippet")
    rows = c.join(F.broadcast(cases), "i").select("c_custkey", "rule_id", code.alias("code"), F.lit("a.js").alias("file"))
    own = F.filter("issues", lambda x: x["rule_id"] == F.col("rule_id"))
    lines = F.array_join(F.transform(own, lambda x: x["line"].cast("string")), " ")
    return lint.lint(rows, language="file").select("c_custkey", "rule_id", lines.alias("lines"))


_CARD = r"(?:4[0-9]{15}|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})"


@_query(rf"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS x, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS line FROM documents)
SELECT doc_id, 'L010' AS rule_id, line::INT AS line, 1 AS "column", left(trim(x), 240) AS snippet FROM l WHERE regexp_matches(x, '\b{_CARD}\b')
  OR (regexp_matches(x, '\b(card_?number|pan|full_card|cardNumber|card_no)\b', 'i') AND regexp_matches(x, '(?:\b(?:save|insert|update|store|persist|writeFile|appendFile)\b|\bconsole\.(?:log|info|warn|error|debug)\b|\bdb\.[a-z_]+\.(?:save|insert|update|create|upsert)\b|\bprisma\.[a-z_]+\.(?:create|update|upsert)\b|\blogger\.(?:log|info|warn|error|debug)\b)', 'i'))""")
def lint_card_numbers(spark, sf_dir):
    """Lines of documents with card numbers."""
    rows = lint.lint(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", concern="pci_compliance", mask=False)
    return lint.flat(rows, "doc_id").filter("rule_id = 'L010'").drop("place")


@_query()
def lint_documents(spark, sf_dir):
    """All rules over all documents read as code."""
    rows = lint.lint(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return lint.issue_rows(rows, "doc_id", lint.rules_table(spark)).select("doc_id", "place", "rule_id", "severity", "line", "column", "snippet")


def _sql_language(col: str) -> str:
    from ..operators.source_code import SIGNATURES, named

    scores = []
    for i, (lang, sigs) in enumerate(SIGNATURES.items()):
        n = " + ".join("regexp_matches({}, '{}')::INT".format(col, (f"(?{f})" if f else "") + named(p, "acme", "acme").replace("'", "''")) for p, f in sigs)
        scores.append(f"{{'n': {n}, 'i': {-i}, 'lang': '{lang}'}}")
    return f"list_sort([{', '.join(scores)}])[-1]"


@_query(f"SELECT doc_id, CASE WHEN b.n >= 1 THEN b.lang ELSE 'unknown' END AS language FROM (SELECT doc_id, {_sql_language('text')} AS b FROM documents)")
def code_language(spark, sf_dir):
    """What language each document looks like."""
    return _table(spark, sf_dir, "documents").select("doc_id", language_of(F.col("text")).alias("language"))


def _sql_masked(language: str, text: str) -> str:
    """text with its comments blanked; DuckDB's patterns have no possessive repetition, which changes no match here."""
    cases = []
    for langs, (spans, comment) in SPANS.items():
        quoted, said = (p.replace("*+", "*").replace("'", "''") for p in (spans, comment))
        hits = f"list_transform(regexp_extract_all({text}, '{quoted}'), lambda h: CASE WHEN regexp_matches(h, '{said}') THEN regexp_replace(h, '[^\\n]', ' ', 'g') ELSE h END)"
        names = ", ".join(f"'{x}'" for x in langs)
        cases.append(f"WHEN {language} IN ({names}) THEN array_to_string(flatten(list_transform(list_zip(string_split_regex({text}, '{quoted}'), {hits}), lambda x: [x[1], coalesce(x[2], '')])), '')")
    return f"CASE {' '.join(cases)} ELSE {text} END"


_FAMILIES = ("python", "node", "php", "java", "ruby")


@_query(f"""
WITH d AS (SELECT doc_id, unnest({list(_FAMILIES)}) AS language, replace(replace(text, '. ', ' // "'), ', ', chr(10) || '# /*') || '*/ ' || chr(39) AS code FROM documents),
m AS (SELECT *, {_sql_masked("language", "code")} AS masked FROM d)
SELECT doc_id, language, sha256(masked) AS masked_hash, length(masked) = length(code) AS same_length FROM m""")
def comment_mask(spark, sf_dir):
    """Documents with marks of comments and strings at their points and commas, read as code of each family, comments blanked: lengths stay."""
    code = F.concat(F.replace(F.replace("text", F.lit(". "), F.lit(' // "')), F.lit(", "), F.lit("\n# /*")), F.lit("*/ '"))
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"), lint.PART).select("doc_id", code.alias("code"), F.explode(F.array(*[F.lit(x) for x in _FAMILIES])).alias("language"))
    masked = d.withColumn("masked", without_comments(F.col("code"), F.col("language")))
    return masked.select("doc_id", "language", F.sha2("masked", 256).alias("masked_hash"), (F.length("masked") == F.length("code")).alias("same_length"))


@_query("""
WITH f AS (SELECT s_nationkey AS project, s_suppkey // 25 AS depth, CASE s_suppkey % 4 WHEN 0 THEN 'package.json' WHEN 1 THEN 'Gemfile' WHEN 2 THEN 'go.mod' ELSE 'pom.xml' END AS file, s_suppkey % 4 AS i, s_acctbal > 2000 AS fits FROM supplier),
m AS (SELECT project, min({'d': depth, 'i': CASE i WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 7 END, 'lang': CASE i WHEN 0 THEN 'node' WHEN 1 THEN 'ruby' WHEN 2 THEN 'go' ELSE 'java' END}) AS m FROM f WHERE fits AND depth < 6 GROUP BY 1)
SELECT DISTINCT project, m.lang AS language FROM f LEFT JOIN m USING (project)""")
def sdk_languages(spark, sf_dir):
    """Suppliers as files of projects: which SDK the nearest file declares."""
    n = F.pmod("s_suppkey", F.lit(4))
    name = F.when(n == 0, "package.json").when(n == 1, "Gemfile").when(n == 2, "go.mod").otherwise("pom.xml")
    said = F.when(n == 0, '{"acme": "1"}').when(n == 1, 'gem "acme"').when(n == 2, "acme/acme-go").otherwise("<groupId>com.acme</groupId>")
    files = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project"), F.floor(F.col("s_suppkey") / 25).alias("depth"), name.alias("file"), F.when(F.col("s_acctbal") > 2000, said).otherwise("none").alias("content"))
    return sources.sdk_language(files).select("project", "language")


@_query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_events(spark, sf_dir):
    """Events by day and type, as the stream of them is counted."""
    return ingest.windowed(_table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@_query()
def search_pipeline(spark, sf_dir):
    """Benchmark items searched from end to end: rewriting, both rankings, vectors, fusion, boosts, assembly."""
    chunks = _chunks(spark, sf_dir).withColumn("code_blocks", F.array().cast("array<struct<ordinal:int,language:string,label:string,code:string>>"))
    routes = chunks.select("route", assemble.canonical_url(F.col("route"), "https://example.com").alias("url"))
    model = dense.hashed()
    vectors = dense.embed(chunks.select("chunk_id", "body"), "body", model).select("chunk_id", "embedding")
    corpus = engine.Corpus(chunks, routes, _texts(spark, sf_dir, "stems"), None, vectors)
    queries = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    out = engine.search(queries, corpus, LEXICON, k=10, embedder=model)
    return out.select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"), "route", "title", "url")


#: Groups of common words of the given texts, so that their queries have synonyms.
_WORDY = L.Lexicon(synonyms=(("der", "die", "des"), ("ed", "er"), ("elle", "le"), ("en", "ent")))
_AREA = "CASE lang WHEN 'en' THEN 'payments' WHEN 'fr' THEN 'api/payments' WHEN 'de' THEN 'webhooks' WHEN 'es' THEN 'x' ELSE 'pos' END"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two words of each benchmark item in a row as a query, some with a product, a topic or a number of results, and some out of bounds."""
    words = F.transform(T.ascii_tokens(F.col("text")), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    two = F.transform(F.filter("ws", lambda x: x["i"] % 2 == 0), lambda x: F.struct((x["i"] / 2).cast("int").alias("p"), F.concat_ws(" ", x["w"], F.get("ws", x["i"] + 1)["w"]).alias("query")))
    rows = _table(spark, sf_dir, "benchmark").select("item_id", words.alias("ws")).select("item_id", F.inline(two))
    product = F.when(F.col("p") % 4 == 0, "payments").when(F.col("p") % 4 == 1, "x")
    topic = F.when(F.col("p") % 3 == 0, "api").when(F.col("p") % 3 == 1, "webhooks").when(F.col("p") % 21 == 2, "weather")
    return rows.select((F.col("item_id") * 1000 + F.col("p")).cast("long").alias("query_id"), "query", product.alias("product"), topic.alias("topic"), F.when(F.col("p") % 2 == 0, F.col("p") % 12).alias("k"))


_ASKED = f"""SELECT *, CASE WHEN length(said) NOT BETWEEN 3 AND 256 THEN 'query' WHEN topic = 'weather' THEN 'topic' WHEN k NOT BETWEEN 1 AND 10 THEN 'k' END AS problem FROM (
  SELECT item_id * 1000 + p AS query_id, ws[2 * p + 1] || coalesce(' ' || ws[2 * p + 2], '') AS said, CASE p % 4 WHEN 0 THEN 'payments' WHEN 1 THEN 'x' END AS product,
    CASE WHEN p % 3 = 0 THEN 'api' WHEN p % 3 = 1 THEN 'webhooks' WHEN p % 21 = 2 THEN 'weather' END AS topic, CASE WHEN p % 2 = 0 THEN p % 12 END AS k
  FROM (SELECT item_id, ws, unnest(range((len(ws) + 1) // 2)) AS p FROM (SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark)))"""


def _wordy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    words = T.ascii_tokens(F.col("text"))
    segment = F.concat_ws("-", F.coalesce(F.get(words, F.lit(0)), F.lit("x")), F.coalesce(F.get(words, F.lit(1)), F.lit("x")))
    route = F.concat_ws("/", F.expr(_AREA), "source", segment)
    chunks = d.select(
        F.col("doc_id").alias("chunk_id"), F.split("text", "\n", 2)[0].alias("title"), F.when(F.col("doc_id") % 5 == 0, "announcements").otherwise("docs").alias("category"), route.alias("route"),
        F.col("text").alias("body"), F.lit(None).cast("string").alias("description"), F.col("lang").alias("heading_path"), F.array().cast("array<struct<ordinal:int,language:string,label:string,code:string>>").alias("code_blocks"),
    )
    routes = chunks.select("route", assemble.canonical_url(F.col("route"), "https://example.com").alias("url")).distinct()
    corpus = engine.Corpus(chunks, routes, _texts(spark, sf_dir, "body"))
    return engine.answer(_asked(spark, sf_dir), corpus, _WORDY, digits=6).results


def _sql_by_name(name: str, table: dict, route: str) -> str:
    fits = lambda prefixes: " OR ".join(f"starts_with({route}, '{p}')" for p in prefixes)
    return "coalesce(" + " OR ".join(f"({name} = '{n}' AND ({fits(p)}))" for n, p in table.items()) + ", FALSE)"


_WORDY_OF, _WORDY_GROUPS = _sql_groups(_WORDY)
_INTERPRETED = f"""{_rewrite_ctes(f"SELECT * FROM ({_ASKED}) WHERE problem IS NULL")},
g AS (SELECT *, list_transform(tokens, lambda x: {_WORDY_OF}[x]) AS gs FROM o)"""


@_query(f"""
WITH {_BM25_CTES.split("q AS (")[0]}{_INTERPRETED.lstrip()},
i AS (SELECT query_id, tokens, gs, unnest(range(1, len(tokens) + 1)) AS i FROM g),
asked AS (SELECT query_id, 1 AS src, i, tokens[i] AS term FROM i UNION ALL
  SELECT query_id, 2, i, unnest(CASE WHEN gs[i] IS NULL THEN [tokens[i]] ELSE {_WORDY_GROUPS}[gs[i]] END) FROM i WHERE len(list_filter(gs, lambda x: x IS NOT NULL)) > 0 AND (gs[i] IS NULL OR list_position(gs, gs[i]) = i)),
need AS (SELECT query_id, src, count(DISTINCT i) AS n_groups FROM asked GROUP BY ALL),
met AS (SELECT query_id, src, doc_id AS chunk_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s, count(DISTINCT i) AS m FROM asked JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
rk AS (SELECT query_id, src, chunk_id, row_number() OVER (PARTITION BY query_id, src ORDER BY round(s, 6) DESC, chunk_id) AS r FROM met JOIN need USING (query_id, src) WHERE m = n_groups),
c AS (SELECT doc_id AS chunk_id, string_split(text, chr(10))[1] AS title, {_AREA} || '/' || source || '/' || coalesce(ws[1], 'x') || '-' || coalesce(ws[2], 'x') AS route, lang AS heading_path, text AS body, doc_id % 5 = 0 AS news FROM documents JOIN d USING (doc_id)),
fu AS (SELECT query_id, chunk_id, coalesce(max(CASE WHEN src = 1 THEN 1.0::DOUBLE / (60 + r) END), 0) + coalesce(max(CASE WHEN src = 2 THEN 0.6::DOUBLE / (60 + r) END), 0) AS fused FROM rk WHERE r <= 30 GROUP BY ALL),
own AS (SELECT *, row_number() OVER (PARTITION BY query_id, route ORDER BY fused DESC, chunk_id) AS n FROM fu JOIN c USING (chunk_id)),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, chunk_id) AS place FROM own WHERE n = 1),
w AS (SELECT cut.* EXCLUDE (n), g.tokens, g.k, CASE WHEN product IS NULL THEN {_sql_hints("said", _WORDY.product_hints)} END AS soft, product, coalesce(topic, {_sql_hints("said", L.TOPIC_HINTS)}) AS topic,
  split_part(route, '/', -1) AS seg, list_transform(tokens, lambda x: {_sql_stem("x")}) AS st FROM cut JOIN g USING (query_id) WHERE place <= 20),
h AS (SELECT *, len(list_filter(string_split_regex(seg, '[-_]'), lambda x: list_contains(st, {_sql_stem("x")}))) AS hits FROM w WHERE product IS NULL OR {_sql_by_name("product", L.PRODUCT_PREFIXES, "route")}),
b AS (SELECT *, fused * CASE WHEN {_sql_by_name("soft", L.PRODUCT_PREFIXES, "route")} THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN {_sql_by_name("topic", L.TOPIC_PREFIXES, "route")} THEN 1.6::DOUBLE ELSE 1 END
  * CASE WHEN list_contains(tokens, seg) THEN 1.8::DOUBLE WHEN hits >= 2 THEN 1.25::DOUBLE + 0.4::DOUBLE * hits WHEN hits = 1 THEN 1.25 ELSE 1 END * CASE WHEN news THEN 1.1::DOUBLE ELSE 1 END AS score,
  array_to_string(string_split(route, '/')[1:2], '/') AS fam FROM h),
nd AS (SELECT *, row_number() OVER x AS n, first_value(fam) OVER x AS f FROM b WINDOW x AS (PARTITION BY query_id, title, heading_path ORDER BY fused DESC, chunk_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM nd WHERE n = 1 OR fam <> f)
SELECT query_id, rank, chunk_id, round(score, 9) AS score, route, title, left(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), 240) AS summary, 'https://example.com/docs/' || route || '/' AS url FROM z WHERE rank <= coalesce(k, 3)""")
def search_words(spark, sf_dir):
    """Searches from end to end: limits, rewriting, both rankings of words, fusion, product, boosts, near duplicates, assembly."""
    return _wordy(spark, sf_dir).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"), "route", "title", "summary", "url")


@_query(f"""
WITH {_INTERPRETED.lstrip()}
SELECT query_id, NULL AS problem, {_sql_hints("said", L.LANGUAGE_HINTS)} AS language, {_sql_hints("said", _WORDY.product_hints)} AS product, array_to_string(tokens, ' ') AS tokens,
  array_to_string(flatten(list_transform(list_filter(gs, lambda x, i: x IS NOT NULL AND list_position(gs, x) = i), lambda x: {_WORDY_GROUPS}[x])), ' ') AS expanded FROM g
UNION ALL SELECT query_id, problem, NULL, NULL, NULL, NULL FROM ({_ASKED}) WHERE problem IS NOT NULL""")
def search_requests(spark, sf_dir):
    """What a search makes of each query, and why others are turned away."""
    checked = rewrite.requests(_asked(spark, sf_dir), _WORDY)
    said = rewrite.interpretation(checked.filter("problem is null"), _WORDY).select("query_id", F.lit(None).cast("string").alias("problem"), F.col("detected_language").alias("language"), F.col("detected_product").alias("product"), F.array_join("tokens", " ").alias("tokens"), F.array_join("expanded_terms", " ").alias("expanded"))
    return said.unionByName(checked.filter("problem is not null").select("query_id", "problem"), allowMissingColumns=True)
