"""Retrieval quality: rank of the first hit, recall, reciprocal rank, percentiles, audits, gates and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.settle import settled

# Gates of an evaluation.
MIN_RECALL_3, MAX_P95_MS = 0.80, 200


def targets(queries: DataFrame) -> DataFrame:
    """(query_id, route): expected and acceptable routes, each once."""
    both = F.array_union(F.coalesce("expected_routes", F.array().cast("array<string>")), F.coalesce("acceptable_routes", F.array().cast("array<string>")))
    return queries.select("query_id", F.explode(both).alias("route"))


def missing_routes(queries: DataFrame, routes: DataFrame) -> DataFrame:
    """Targets that the corpus doesn't have."""
    return targets(queries).join(routes.select("route"), "route", "left_anti")


def first_hit(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, hit_rank) for every query: the least rank of a target, 0 if none is found."""
    hits = results.select("query_id", "route", "rank").join(targets(queries), ["query_id", "route"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    return queries.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("r", F.lit(0)).cast("long").alias("hit_rank"))


def _share(n: int) -> Column:
    return F.coalesce(F.avg(F.when((F.col("hit_rank") > 0) & (F.col("hit_rank") <= n), 1.0).otherwise(0.0)), F.lit(0.0))


def metrics(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, recall at 1, 3 and 10, and mean reciprocal rank (0 for a miss), of all or by columns."""
    mrr = F.coalesce(F.avg(F.when(F.col("hit_rank") > 0, 1 / F.col("hit_rank")).otherwise(0.0)), F.lit(0.0))
    return hits.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), _share(1).alias("recall_1"), _share(3).alias("recall_3"), _share(10).alias("recall_10"), mrr.alias("mrr"))


#: Ranges that a group's values are counted by in each round of a selection, the most rounds, and how many values between
#: a place's bounds are few enough to be sorted.
_RANGES, _ROUNDS, _FEW = 256, 8, 1 << 16


def percentiles(df: DataFrame, column: str, ps: tuple[int, ...] = (50, 95), by: list[str] | None = None) -> DataFrame:
    """The value at place min(n-1, floor(n*p/100)) of the sorted values of each group, without interpolation.

    By narrowing: the values between a place's bounds are counted in _RANGES ranges of equal width, and the range that has
    the place becomes its bounds, until both are one value or few values are left. Counts are added up in each task first, so a group of all
    rows is no more than a few numbers a task. What _ROUNDS leave, values that lie unevenly, is counted by distinct
    value: each task adds up its own, and a window over a place's last bounds picks. Values are compared as doubles; null and NaN
    don't count.
    """
    keys = by or []
    rows = df.select(*keys, F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = groups.select(*keys, "n", "lo", "hi", F.explode(F.array(*[F.lit(p) for p in ps])).alias("p"))
    # below: how many values of the group are less than lo; the place is at place - below from there
    place = F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("p") / 100))
    wanted = settled(wanted.select(*keys, "p", place.alias("place"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), "places")
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > _FEW)
    for _ in range(_ROUNDS):
        open_ = wanted.filter(wide)
        if open_.isEmpty():
            break
        step = (F.col("v") / F.lit(_RANGES) - F.col("lo") / F.lit(_RANGES)) / (F.col("hi") / F.lit(_RANGES) - F.col("lo") / F.lit(_RANGES))  # sizes may be beyond a double's
        met = _within(rows, open_, keys).withColumn("bin", F.least(F.floor(step * _RANGES), F.lit(_RANGES - 1)).cast("int"))
        bins = met.groupBy(*keys, "p", "place", "below", "bin").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        order = W.partitionBy(*keys, "p").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # _RANGES rows each
        upto = bins.withColumn("upto", F.sum("c").over(order) + F.col("below"))
        narrowed = upto.filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place")))
        wanted = settled(wanted.filter(~wide).unionByName(narrowed.select(*keys, "p", "place", "lo", "hi", (F.col("upto") - F.col("c")).alias("below"), F.col("c").alias("inside"))), "places")
    left = _within(rows, wanted.filter("lo < hi"), keys).groupBy(*keys, "p", "place", "below", "v").agg(F.count(F.lit(1)).alias("c"))
    order = W.partitionBy(*keys, "p").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    last = left.withColumn("upto", F.sum("c").over(order) + F.col("below")).filter("upto > place").groupBy(*keys, "p").agg(F.min("v").alias("v"))
    found = wanted.filter("lo = hi").select(*keys, "p", F.col("lo").alias("v")).unionByName(last)
    kind = dict(df.dtypes)[column]
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("v"))).cast(kind).alias(f"p{p}") for p in ps])


def _within(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Values between the bounds of their group's places. Bounds are a row for each group and place; nulls are a group."""
    named = bounds.toDF(*[f"__{k}" if k in keys else k for k in bounds.columns])
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    return rows.join(named, reduce(Column.__and__, [*same, inside])).drop(*[f"__{k}" for k in keys])


def passes(row, p95_ms: float | None = None) -> list[str]:
    """What a metrics row misses of the gates; empty if it passes."""
    out = []
    if row["recall_3"] < MIN_RECALL_3:
        out.append(f"recall at 3 is {row['recall_3']:.3f}, {MIN_RECALL_3} is needed")
    if p95_ms is not None and p95_ms > MAX_P95_MS:
        out.append(f"the 95th percentile is {p95_ms:.0f} ms, {MAX_P95_MS} is the most")
    return out


# The first rule that a target fits names a query's category.
CATEGORIES = (
    ("api", (("begins", "api/"),)), ("webhooks", (("begins", "webhooks/"),)), ("errors", (("begins", "errors"), ("contains", "/errors"))),
    ("subscriptions", (("contains", "subscription"),)), ("x", (("begins", "x/"),)), ("plugins", (("contains", "ecommerce-plugins"), ("contains", "/plugins/"))),
    ("sdk", (("contains", "/server-integration/"),)), ("payment-gateway", (("contains", "/payment-gateway/"),)),
    ("payment-links", (("contains", "/payment-link"), ("contains", "/payment-button"))), ("refunds", (("contains", "/refund"),)),
    ("payouts", (("contains", "/payouts"), ("contains", "/payout"))), ("testing", (("contains", "/test"), ("contains", "/sandbox"))),
    ("security", (("contains", "/security"), ("contains", "/whitelist"))), ("dashboard", (("contains", "/dashboard"),)),
)


def category(routes: Column, table=CATEGORIES) -> Column:
    """The category of an array of routes; misc without one."""
    fits = lambda kind, said: lambda r: r.startswith(said) if kind == "begins" else F.contains(r, F.lit(said))
    out = F.lit("misc")
    for name, rules in reversed(table):
        any_fits = F.exists(routes, fits(*rules[0]))
        for rule in rules[1:]:
            any_fits = any_fits | F.exists(routes, fits(*rule))
        out = F.when(any_fits, F.lit(name)).otherwise(out)
    return out


def keyword_audit(pairs: DataFrame, texts: DataFrame, stop: tuple[str, ...] = (), least: int = 3, most_missing: float = 0.4) -> DataFrame:
    """(query_id, route, n_tokens, n_missing, share, doubtful): how many of a query's distinctive words a target's text lacks.

    pairs: query_id, query, route; texts: route, text. A word counts as there if it, or it without a plural s, is in
    the text as a substring. A target without a text lacks all.
    """
    words = F.filter(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: (F.length(t) >= least) & ~t.isin(*stop) if stop else F.length(t) >= least)
    rows = pairs.withColumn("words", words).join(texts.select("route", F.lower("text").alias("low")), "route", "left").withColumn("low", F.coalesce("low", F.lit("")))
    stem = lambda t: F.when(t.endswith("s") & (F.length(t) > 4), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    rows = rows.withColumn("missing", F.filter("words", lambda t: ~F.contains(F.col("low"), t) & ~F.contains(F.col("low"), stem(t))))
    n, gone = F.size("words").cast("long"), F.size("missing").cast("long")
    share = F.when(n > 0, gone / n).otherwise(0.0)
    return rows.select("query_id", "route", n.alias("n_tokens"), gone.alias("n_missing"), share.alias("share"), (share > most_missing).alias("doubtful"))


def route_sizes(routes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(route, n_chars): all characters of a route's chunks, 0 without any."""
    sums = chunks.groupBy("route").agg(F.sum(F.length("body")).alias("s"))
    return routes.select("route").join(sums, "route", "left").select("route", F.coalesce("s", F.lit(0)).cast("long").alias("n_chars"))


def routes_with(chunks: DataFrame, said: str) -> DataFrame:
    return chunks.filter(F.contains("body", F.lit(said))).select("route").distinct()


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, change) of two tables (metric, value)."""
    b, a = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    return b.join(a, "metric", "full").withColumn("change", F.col("after") - F.col("before"))

