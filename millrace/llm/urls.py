"""Weighted URL vocabulary: Aho-Corasick over strict and soft terms, with boundary checks."""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import without

#: One of these rejects a url. English, German, French and Spanish addresses.
STRICT = (
    "casino", "cheap-pills", "escort", "free-bets", "gambling", "hentai", "jackpot", "payday-loans", "porn", "poker", "sportsbook", "torrent", "viagra", "xxx",
    "cialis", "camgirls", "sportwetten", "spielautomaten", "glücksspiel", "gluecksspiel", "pornos", "porno", "escortes", "paris-sportifs", "machines-a-sous", "apuestas", "tragaperras", "quiniela", "warez",
)
#: Different ones of these reject a url if their weights make SOFT_LIMIT: no single one does. Words that ordinary addresses
#: have, too, weigh half.
SOFT = {
    "adult": 1.0, "bet": 1.0, "bets": 1.0, "bonus": 1.0, "cheap": 1.0, "click": 1.0, "deals": 1.0, "dating": 1.0, "free": 1.0, "girls": 1.0, "hot": 1.0, "loan": 1.0, "loans": 1.0,
    "lottery": 1.0, "pills": 1.0, "prize": 1.0, "promo": 1.0, "sex": 1.0, "slots": 1.0, "win": 1.0,
    "erotik": 1.0, "wetten": 1.0, "lotto": 1.0, "kredit": 1.0, "gewinn": 1.0, "kostenlos": 0.5, "billig": 0.5, "angebot": 0.5,
    "sexe": 1.0, "rencontres": 1.0, "loterie": 1.0, "pari": 1.0, "gagner": 1.0, "gratuit": 0.5, "offre": 0.5, "promotion": 0.5,
    "sexo": 1.0, "citas": 1.0, "loteria": 1.0, "apuesta": 1.0, "ganar": 1.0, "gratis": 0.5, "oferta": 0.5, "offer": 0.5, "coupon": 0.5,
}
SOFT_LIMIT = 2


def terms_of(table: DataFrame) -> tuple[tuple[str, ...], dict[str, float]]:
    """(strict, soft) of a table (term, kind strict or soft, weight): the vocabulary, which is read as a whole.

    Terms count in lower case; a repeated one has its greatest weight. A soft weight is 1 at most, so that it takes several.
    """
    strict, soft = set(), {}
    for r in table.select("term", "kind", "weight").collect():
        if r.term:
            if r.kind == "strict":
                strict.add(r.term.lower())
            else:
                soft[r.term.lower()] = max(min(1.0, r.weight or 0.0), soft.get(r.term.lower(), 0.0))
    return tuple(sorted(strict)), soft


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for term in soft:
        auto.add_word(term, (len(term), False, term))
    for term in strict:  # a term in both lists is strict
        auto.add_word(term, (len(term), True, term))
    auto.make_automaton()
    return auto


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def hits(url: str, auto: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Different strict and soft terms in a url, each between boundaries."""
    low = url.lower() if url.isascii() else "".join(c.lower() if c.isascii() else c for c in url)
    strict, soft, n = set(), set(), len(low)
    for end, (size, is_strict, term) in auto.iter(low):
        start = end - size + 1
        if (start == 0 or not _word(low[start - 1])) and (end + 1 == n or not _word(low[end + 1])):
            (strict if is_strict else soft).add(term)
    return strict, soft


def vocabulary_hits(url: Column, strict: tuple[str, ...] = STRICT, soft=SOFT) -> Column:
    """Struct (strict, soft, weight): how many different terms of either list the url has, and what the soft ones weigh.

    A term counts where neither neighbour is an ASCII letter or digit. A null url has none.
    """
    strict, weights = tuple(strict), dict(soft) if isinstance(soft, dict) else dict.fromkeys(soft, 1.0)

    def count(urls: pa.Array) -> pa.Array:
        auto = _automaton(strict, tuple(weights))
        found = [hits(u, auto) if u and len(auto) else (set(), set()) for u in urls.to_pylist()]
        arrays = [pa.array([len(x[0]) for x in found], pa.int32()), pa.array([len(x[1]) for x in found], pa.int32()), pa.array([sum(weights[t] for t in sorted(x[1])) for x in found], pa.float64())]
        return pa.StructArray.from_arrays(arrays, ["strict", "soft", "weight"])

    return F.arrow_udf(count, "strict int, soft int, weight double")(url)


def url_filter(df: DataFrame, url: str = "url", strict=STRICT, soft=SOFT, soft_limit: float = SOFT_LIMIT) -> DataFrame:
    """df with n_strict, n_soft and url_verdict: block on one strict term, or on different soft ones that together weigh
    soft_limit, else allow. soft has a weight for each term; a plain list gives each 1.

    Row by row, without a shuffle. A null or empty url is allowed. Columns of these names are replaced.
    """
    out = without(df, "n_strict", "n_soft", "url_verdict").withColumn("__hits", vocabulary_hits(F.col(url), strict, soft))
    blocked = (F.col("__hits.strict") > 0) | (F.col("__hits.weight") >= soft_limit)
    return out.select("*", F.col("__hits.strict").alias("n_strict"), F.col("__hits.soft").alias("n_soft"), F.when(blocked, "block").otherwise("allow").alias("url_verdict")).drop("__hits")


#: Fixed values of the query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path, null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out
