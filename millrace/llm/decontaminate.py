"""Benchmark decontamination: prefix-filtered join of item windows with documents, verified word by word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from . import _vec
from ._work import without, written

#: Words of a window, and of a shingle (the token of the join).
WINDOW = 13
SHINGLE = 5
#: Bits of the filter that documents are read through: its size is fixed, whatever the number of items.
FILTER_BITS = 1 << 24

#: ASCII letters and digits and everything above ASCII are in words.
_APART = _vec.table_of(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122)))


def _tokens(buf: np.ndarray, off: np.ndarray):
    low = _vec.LOWER[buf]
    start, end, first = _vec.words(low, off, _APART)
    return low, start, end, first, _vec.Ranges(low)(start, end)


def _grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place (word number in the buffer) of every n words within a text."""
    count = np.diff(first)
    made = np.maximum(count - n + 1, 0)
    begin = np.cumsum(made) - made
    at = np.arange(made.sum()) - np.repeat(begin - first[:-1], made)
    out = np.full(len(at), n, _vec.U)
    for i in range(n):
        out = _vec.mix(out * _vec.U(31) + h[at + i])
    return out, at


def _strings(low: np.ndarray, start: np.ndarray, end: np.ndarray, a: int, b: int) -> list[str]:
    """Words a to b-1."""
    data = low[start[a] : end[b - 1]].tobytes()
    base = start[a]
    return [data[s:e].decode("utf-8", "replace") for s, e in zip((start[a:b] - base).tolist(), (end[a:b] - base).tolist(), strict=True)]


def windows(items: DataFrame, item: str, text: str, window: int = WINDOW) -> DataFrame:
    """(item, words array<string>, tokens array<struct<place, h, n>>): every window of every item.

    An item of fewer words, but not none, is one window. Tokens are the hashes of each SHINGLE words (fewer in shorter windows).
    """
    kind = T.StructType([
        T.StructField("item", items.schema[item].dataType), T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("tokens", T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("h", T.LongType())]))),
    ])

    def cut(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, _, buf, off in _vec.pieces(batch.column(1)):
                low, start, end, first, h = _tokens(buf, off)
                rows = []
                for i in range(len(off) - 1):
                    p, q = int(first[i]), int(first[i + 1])
                    if q == p:
                        continue
                    size = min(window, q - p)
                    n = min(SHINGLE, size)
                    g, _ = _grams(h[p:q], np.array([0, q - p]), n)
                    g = g.view(np.int64).tolist()
                    said = _strings(low, start, end, p, q)
                    for w in range(q - p - size + 1):
                        rows.append((ids[a + i], said[w : w + size], [{"place": o, "h": g[w + o]} for o in range(size - n + 1)]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0].as_py() for r in rows], ids.type), pa.array([r[1] for r in rows], pa.list_(pa.string())),
                    pa.array([r[2] for r in rows], pa.list_(pa.struct([("place", pa.int32()), ("h", pa.int64())])))], names=["item", "words", "tokens"])

    return items.select(item, text).mapInArrow(cut, kind)


def _filter(wins: DataFrame) -> tuple[bytes, tuple[int, ...]]:
    """A bitmap of all tokens (FILTER_BITS bits, built by Spark), and which token lengths below SHINGLE occur."""
    tokens = wins.select(F.explode("tokens.h").alias("h"), F.least(F.size("words"), F.lit(SHINGLE)).alias("n"))
    place = F.pmod(F.col("h"), F.lit(FILTER_BITS)) + 1  # Spark counts the bits of bucket 1 from 1
    parts = tokens.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in parts:
        out[(r.b - 1) * 4096 : r.b * 4096] = r.m
    lengths = tuple(sorted(r.n for r in tokens.select("n").distinct().collect() if r.n < SHINGLE))
    return bytes(out), lengths


def _bitmap_place(h: np.ndarray, bits: int) -> np.ndarray:
    return h.view(np.int64) % bits


def stretches(docs: DataFrame, key: str, text: str, bitmap, lengths: tuple[int, ...]) -> DataFrame:
    """(key, n_words, runs array<struct<start, words>>) for every document: what of it passes the filter.

    A run is a maximal stretch of words covered by tokens that the bitmap has, so each occurrence of a window lies in
    one run. One pass over the text, without a shuffle.
    """
    kind = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))]))),
    ])

    def read(batches):
        have = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            counts, runs = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for a, b, buf, off in _vec.pieces(batch.column(1)):
                low, start, end, first, h = _tokens(buf, off)
                counts[a:b] = np.diff(first)
                step = np.zeros(len(h) + 1, np.int32)
                for n in (*lengths, SHINGLE):
                    g, at = _grams(h, first, n)
                    hit = at[have[_bitmap_place(g, len(have))]]
                    np.add.at(step, hit, 1)
                    np.add.at(step, hit + n, -1)
                covered = np.cumsum(step[:-1]) > 0
                if not covered.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                for p, q in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    i = int(np.searchsorted(first, p, "right")) - 1
                    while p < q:  # a stretch over the end of a text is cut there
                        cut = min(q, int(first[i + 1]))
                        if cut > p:
                            runs[a + i].append({"start": p - int(first[i]), "words": _strings(low, start, end, p, cut)})
                        p, i = cut, i + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("words", pa.list_(pa.string()))])))], names=["key", "n_words", "runs"])

    return docs.select(key, text).mapInArrow(read, kind)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, items array<string>, sorted) for every row of docs.

    n_hit counts the words of a document inside any occurrence of an item's window; items lists the ids, as strings,
    of items with such windows. The join, in steps: documents are read once through a bitmap of all item shingles;
    shingles are ordered by how many documents have them; each window's rarest shingle is its prefix (for exact
    containment one token is enough); where a document has it, the window's place follows from the token's, must fit
    the run (positional and length bound), and all its words are compared.

    Null or word-less texts have no words and no hits; items without a word are never found; keys must be unique.
    Nothing that grows with the items is broadcast by hand or collected: beyond FILTER_BITS items only make more runs
    pass to the join, which Spark sorts or broadcasts by size.
    """
    wins = written(windows(items.select(item, item_text), item, item_text, window), "windows")
    bitmap, lengths = _filter(wins)
    read = written(stretches(docs, key, text, docs.sparkSession.sparkContext.broadcast(bitmap), lengths), "runs")
    runs = read.filter(F.size("runs") > 0).select("key", F.explode("runs").alias("r")).select("key", "r.start", "r.words")
    # the words of a window as one string make equal tokens and equal windows plain equality joins
    gram = lambda words, o, n: F.array_join(F.slice(words, o + 1, n), " ")
    distinct = wins.select("words").distinct().withColumn("w", F.array_join("words", " ")).withColumn("size", F.size("words"))
    size_of = F.least(F.col("size"), F.lit(SHINGLE))
    tokens = distinct.select("w", "size", size_of.alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - size_of), lambda o: F.struct(o.alias("o"), gram(F.col("words"), o, size_of).alias("token")))).alias("t"))
    tokens = tokens.select("w", "size", "n", "t.o", "t.token")
    lens = sorted({SHINGLE, *lengths})
    places = runs.select("key", "start", F.size("words").alias("len"), F.explode(F.flatten(F.array(*[
        F.transform(F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>")), _token_at(gram, n)) for n in lens]))).alias("t"))
    known = tokens.select("token").distinct()
    rarity = places.select("key", "t.token").distinct().join(known, "token", "left_semi").groupBy("token").count()
    prefix = tokens.join(rarity, "token", "left").groupBy("w", "size").agg(F.min(F.struct("count", "token", "o")).alias("p"), F.min(F.col("count").isNotNull()).alias("all"))
    # a window with a token that no document has is in none
    prefix = prefix.filter("all").select("w", "size", F.col("p.token").alias("token"), F.col("p.o").alias("o"))
    # narrow rows meet by token, and only candidates meet their run's words; Spark splits a token that very many runs have
    at = places.select("key", "start", "len", F.col("t.token").alias("token"), F.col("t.i").alias("i"))
    found = at.join(prefix, "token").withColumn("place", F.col("i") - F.col("o")).filter((F.col("place") >= 0) & (F.col("place") + F.col("size") <= F.col("len")))
    found = found.select("key", "start", "place", "size", "w").join(runs, ["key", "start"])
    found = found.filter(F.array_join(F.slice("words", F.col("place") + 1, F.col("size")), " ") == F.col("w"))
    found = written(found.select("key", (F.col("start") + F.col("place")).alias("first"), "size", "w").distinct(), "found")
    hit = _covered(found)
    owners = wins.select("item", F.array_join("words", " ").alias("w")).distinct()
    ids = found.select("key", "w").distinct().join(owners, "w").groupBy("key").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    out = read.select("key", "n_words").join(hit, "key", "left").join(ids, "key", "left")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _token_at(gram, n):
    return lambda i: F.struct(i.alias("i"), gram(F.col("words"), i, F.lit(n)).alias("token"))


def _covered(found: DataFrame) -> DataFrame:
    """(key, n_hit): words in the union of [first, first+size)."""
    order = W.partitionBy("key").orderBy("first", "end")
    spans = found.select("key", "first", (F.col("first") + F.col("size")).alias("end")).distinct()
    before = F.coalesce(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return spans.select("key", F.greatest(F.col("end") - F.greatest(F.col("first"), before), F.lit(0)).alias("new")).groupBy("key").agg(F.sum("new").alias("n_hit"))


def is_contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """docs without the contaminated ones: a twentieth or more of their words in item windows. Rows with a null key stay."""
    out = without(docs, "__k")
    bad = contamination(docs.filter(F.col(key).isNotNull()), items, key, **how).filter(is_contaminated()).select(F.col(key).alias("__k"))
    return out.join(bad, out[key] == bad["__k"], "left_anti")
