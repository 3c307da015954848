"""Ranked search, document fetch and linting over an index, for batches: the engine's API."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import FUSED, RERANK_CAP, RETRIEVED, RRF_WEIGHTS, Lexicon
from ..functions.settle import settled
from ..operators import assemble, dense, fusion, lexical
from ..operators.rewrite import interpretation, requests, rewritten
from ..sources.versions import Versions


@dataclass(frozen=True)
class Corpus:
    """Tables of an index: chunks, routes, perhaps the link graph and embeddings (chunk_id, embedding)."""

    chunks: DataFrame
    routes: DataFrame
    index: lexical.Index | lexical.Texts
    graph: DataFrame | None = None
    embeddings: DataFrame | None = None
    base_url: str = "https://example.com"

    @staticmethod
    def read(spark: SparkSession, folder: str, base_url: str = "https://example.com", stemmed: bool = True, embeddings: str | None = None) -> Corpus:
        tables = [spark.read.parquet(f"{folder}/{t}") for t in ("chunks", "routes", "graph")]
        return Corpus(tables[0], tables[1], lexical.Index.read(spark, folder, stemmed), tables[2], spark.read.parquet(embeddings) if embeddings else None, base_url)


    @staticmethod
    def current(spark: SparkSession, folder: str, base_url: str = "https://example.com", stemmed: bool = True, embeddings: str | None = None) -> Corpus:
        """The version that was published last under a folder; a later one doesn't change what this reads."""
        at = Versions(spark, folder).current()
        if at is None:
            raise FileNotFoundError(f"no index is published in {folder}")
        return Corpus.read(spark, at.folder, base_url, stemmed, embeddings)


#: The models that a setting may name; a deployment adds its own before it reads its settings.
EMBEDDERS: dict[str, Callable[[], dense.Embedder]] = {"hash": dense.hashed, "noop": dense.noop}
RERANKERS: dict[str, fusion.Reranker] = {}


@dataclass(frozen=True)
class Settings:
    """How a deployment searches: the folder of its index and the names of its models. An unknown name means the default one."""

    index: str = "index"
    embedder: str = "hash"
    reranker: str | None = None
    base_url: str = "https://example.com"
    default_language: str | None = None

    @staticmethod
    def of(spark: SparkSession) -> Settings:
        """From the session: millrace.index, .embedder, .reranker, .base_url and .default_language."""
        said = {f: spark.conf.get(f"millrace.{f}", None) for f in Settings.__dataclass_fields__}
        known = {"embedder": EMBEDDERS, "reranker": RERANKERS}
        return Settings(**{f: v for f, v in said.items() if v and v in known.get(f, (v,))})

    def corpus(self, spark: SparkSession, embeddings: str | None = None) -> Corpus:
        return Corpus.current(spark, self.index, self.base_url, embeddings=embeddings)


@dataclass(frozen=True)
class Answers:
    """Of a batch: results as search() gives them, how each query was understood, and the queries that were turned away with their problem."""

    results: DataFrame
    interpretation: DataFrame
    rejected: DataFrame


def candidates(queries: DataFrame, corpus: Corpus, lexicon: Lexicon, embedder: dense.Embedder | None = None, hydrate_first: bool = False, digits: int | None = None) -> DataFrame:
    """Fused candidates of rewritten queries, one for each route, FUSED at most: plain and synonym BM25, and vectors.

    Vector candidates have no route of their own unless hydrate_first; so filters and boosts by route pass them by.
    """
    about = corpus.chunks.select("chunk_id", "route", "category")
    plain = lexical.bm25(corpus.index, queries, RETRIEVED, digits)
    wider = lexical.bm25(corpus.index, queries.filter(F.col("synonym_groups") != F.col("groups")).select("query_id", F.col("synonym_groups").alias("groups")), RETRIEVED, digits)
    rankings = [r.join(about, "chunk_id") for r in (plain, wider)]
    if corpus.embeddings is not None and embedder is not None and embedder.model_id != "noop":
        asked = dense.embed(queries.select("query_id", "cleaned"), "cleaned", embedder)
        near = dense.knn(corpus.embeddings, asked, RETRIEVED, item="chunk_id")
        rankings.append(near.join(about, "chunk_id") if hydrate_first else near)
    fused = fusion.one_per_route(fusion.rrf(rankings, RRF_WEIGHTS))
    return fusion.top(fused, FUSED)


def search(
    queries: DataFrame, corpus: Corpus, lexicon: Lexicon, k: int | None = 3, embedder: dense.Embedder | None = None,
    reranker: fusion.Reranker | Callable[[list[tuple[str, str]]], list[float]] | None = None, default_language: str | None = None, hydrate_first: bool = False,
    digits: int | None = None,
) -> DataFrame:
    """Results of queries (query_id, query, and if given language, product, topic, k), best first: see assemble.assembled().

    A query's own k goes before that of the call. With digits, scores of words are rounded before they are ranked, so that
    rows whose sums differ in the last bit only stand by their id.

    What a query asks for by column goes before what its words suggest: a product asked for is a filter, one that is
    suggested a boost. The order is fixed: fuse, cut, rerank, product, boosts, near duplicates, sort, assemble.
    """
    for c in ("language", "product", "topic"):
        if c not in queries.columns:
            queries = queries.withColumn(c, F.lit(None).cast("string"))
    own_k = F.when(F.col("k").isNotNull(), F.least(F.greatest(F.floor("k"), F.lit(1)), F.lit(10))) if "k" in queries.columns else F.lit(None)
    # both are used several times, and are a batch of queries and its few candidates: they are made once
    asked = settled(rewritten(queries, lexicon))
    language = F.coalesce("language", F.lit(default_language).cast("string"), "detected_language")
    wants = asked.select(
        "query_id", F.col("query").alias("__query"), "tokens", language.alias("language"), "product", F.when(F.col("product").isNull(), F.col("detected_product")).alias("soft_product"),
        F.coalesce("topic", "detected_topic").alias("topic"), F.coalesce(own_k, F.lit(assemble.clamp_k(k))).alias("__most"),
    )
    found = settled(candidates(asked, corpus, lexicon, embedder, hydrate_first, digits))
    titles = corpus.chunks.select("chunk_id", F.col("title").alias("title"), "heading_path", "body").join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rows = found.join(titles, "chunk_id", "left").join(wants, "query_id")
    if reranker is not None:
        rows = rows.withColumn("__text", F.concat_ws("\n", "title", F.substring("body", 1, RERANK_CAP)))
        rows = fusion.reranked(rows, "__query", "__text", reranker).drop("__text", "reranked")
    rows = rows.withColumn("__before", F.col("score"))
    rows = fusion.boosted(fusion.only_product(rows, lexicon), lexicon)
    rows = fusion.near_duplicates_out(rows, [F.col("__before").desc(), F.col("chunk_id")])
    return assemble.assembled(rows, corpus.chunks, corpus.routes, corpus.graph, F.col("__most"), corpus.base_url)


def answer(queries: DataFrame, corpus: Corpus, lexicon: Lexicon, settings: Settings = Settings(), k: int = 3, digits: int | None = None) -> Answers:
    """search() of the queries that are within bounds (see rewrite.requests()), and what became of each query."""
    checked = requests(queries, lexicon)
    fine = checked.filter("problem is null").drop("problem")
    reranker = RERANKERS[settings.reranker] if settings.reranker else None
    embedder = EMBEDDERS[settings.embedder]() if corpus.embeddings is not None else None
    results = search(fine, corpus, lexicon, k, embedder, reranker, settings.default_language, digits=digits)
    return Answers(results, interpretation(fine, lexicon), checked.filter("problem is not null"))


def get_docs(asked: DataFrame, corpus: Corpus) -> DataFrame:
    """Whole documents of (said): see assemble.documents()."""
    return assemble.documents(asked, corpus.chunks, corpus.routes, corpus.graph)
