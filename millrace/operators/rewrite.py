"""What a free-text query asks for: tokens, synonym groups, and hints of language, product and topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import LANGUAGE_HINTS, SDK_LANGUAGES, TOPIC_HINTS, Lexicon
from ..functions.settle import spread
from ..functions.text import first_hint, query_tokens, without_noise
from .lexical import all_of, expanded, match_string

MIN_QUERY, MAX_QUERY = 3, 256
#: Results that may be asked for.
MIN_K, MAX_K = 1, 10


def rewritten(queries: DataFrame, lexicon: Lexicon, text: str = "query") -> DataFrame:
    """queries with cleaned, tokens, groups, synonym_groups, both as match strings, expanded_terms and detected_language, _product, _topic.

    cleaned is the lower-cased query without phrases that carry nothing, or the query if nothing else is in it. groups
    is the conjunction of the tokens; synonym_groups puts a token's whole synonym group in its place. Hints are of the
    query as it was said; where none fits they are null. Row by row; only a small input is dealt out to all cores.
    """
    said = F.trim(F.coalesce(F.col(text), F.lit("")))
    out = spread(queries).withColumn("__bare", without_noise(F.lower(said))).withColumn("tokens", query_tokens(F.col("__bare"), lexicon))
    out = out.withColumn("cleaned", F.when(F.length("__bare") > 0, F.col("__bare")).otherwise(F.lower(said))).drop("__bare")
    out = out.withColumns({"groups": all_of(F.col("tokens")), "synonym_groups": expanded(F.col("tokens"), lexicon)})
    known = [t for g in lexicon.synonyms for t in g]
    many = F.filter("synonym_groups", lambda g: F.size(g) > 1)
    out = out.withColumn("expanded_terms", F.flatten(many) if known else F.array().cast("array<string>"))
    out = out.withColumns({"match": match_string(F.col("groups")), "synonym_match": match_string(F.col("synonym_groups"))})
    hints = {"language": LANGUAGE_HINTS, "product": lexicon.product_hints, "topic": TOPIC_HINTS}
    return out.withColumns({f"detected_{n}": first_hint(said, h) for n, h in hints.items()})


def accepted(df: DataFrame, text: str = "query", least: int = MIN_QUERY, most: int = MAX_QUERY) -> tuple[DataFrame, DataFrame]:
    """Rows whose text has an allowed length, and the others. Snippets to lint have 1 to 50,000 characters, routes 1 to 512."""
    fits = F.coalesce(F.length(text).between(least, most), F.lit(False))
    return df.filter(fits), df.filter(~fits)


def requests(queries: DataFrame, lexicon: Lexicon, text: str = "query") -> DataFrame:
    """queries with language, product, topic and k, null where they lack such a column, and problem: null, or which of
    query, language, product, topic and k is out of bounds, the first of them.

    A null is no problem but for the query itself. k is a whole number from 1 to 10.
    """
    for c, kind in (("language", "string"), ("product", "string"), ("topic", "string"), ("k", "int")):
        if c not in queries.columns:
            queries = queries.withColumn(c, F.lit(None).cast(kind))
    named = {"language": SDK_LANGUAGES, "product": lexicon.product_prefixes, "topic": lexicon.topic_prefixes}
    wrong = F.when(~F.coalesce(F.length(text).between(MIN_QUERY, MAX_QUERY), F.lit(False)), "query")
    for c, names in named.items():
        wrong = wrong.when(~F.col(c).isin(*names), c)
    return queries.withColumn("problem", wrong.when(~(F.col("k").between(MIN_K, MAX_K) & (F.col("k") % 1 == 0)), "k"))


def interpretation(queries: DataFrame, lexicon: Lexicon, text: str = "query") -> DataFrame:
    """(query_id, detected_language, detected_product, expanded_terms, tokens) of each query: what a search makes of it."""
    return rewritten(queries, lexicon, text).select("query_id", "detected_language", "detected_product", "expanded_terms", "tokens")
