"""Line dedup: a suffix array over sequences of line ids, by distributed prefix doubling in Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._work import looked_up, without, written

#: A run of lines counts as repeated from so many words on.
MIN_WORDS = 50
_WORD = r"[^\x20\x09-\x0D]+"


def _ranked(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    """counts with its rank in the order of by: a sort by ranges, in which ids grow from row to row and range to range."""
    ordered = counts.repartitionByRange(*by).sortWithinPartitions(*by)
    return written(ordered.withColumn(name, F.monotonically_increasing_id()), name)


def _copies(texts: DataFrame) -> DataFrame:
    """(k, t) of texts that a smaller key has, too."""
    prints = written(texts.select("k", "t", F.xxhash64(F.lit(1), "text").alias("u")).distinct(), "prints")
    groups = written(prints.groupBy("t", "u").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "groups")
    return written(looked_up(prints, groups, ["t", "u"]).filter("k > first").select("k", "t"), "copies")


def _sequences(texts: DataFrame, copies: DataFrame, min_words: int) -> DataFrame:
    """(k, t, seg, j, pos, w, e, r0): lines that stand somewhere else too, in segments of min_words words at least.

    j counts a text's lines with words, pos all; r0 is the rank of the line's id, e the words of the segment up to the
    line's end. Lines that stand once are in no repeated run, so they end a segment and go.
    """
    parts = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(_WORD)).alias("w")))
    lines = texts.select("k", "t", F.posexplode(F.filter(parts, lambda x: x["w"] > 0)).alias("j", "x")).select("k", "t", "j", "x.*")
    lines = written(lines.join(copies, ["k", "t"], "left_anti"), "lines")
    ids = _ranked(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), ["a", "b"], "r0")
    again = looked_up(lines, ids, ["a", "b"]).select("k", "t", "j", "pos", "w", "r0").distinct()  # repeated rows once
    text, segment = W.partitionBy("k", "t").orderBy("j"), W.partitionBy("k", "t", "seg")
    again = again.withColumn("seg", F.col("j") - F.row_number().over(text))
    again = again.withColumn("e", F.sum("w").over(segment.orderBy("j").rowsBetween(W.unboundedPreceding, 0)))
    return written(again.withColumn("all", F.sum("w").over(segment)).filter(F.col("all") >= min_words).drop("all"), "sequences")


def suffix_ranks(lines: DataFrame, most: int) -> tuple[DataFrame, list[str]]:
    """lines (k, t, seg, j, r0, ...) with columns r1, r2, ...: ranks of the suffixes by their first 2, 4, ... lines.

    Prefix doubling: the pairs (rank, rank 2**h lines on) are counted, sorted by ranges, and their places are the ranks
    by 2**(h+1) lines. A rank is null once it is settled: where nothing else begins with as many equal lines, or the
    segment ends before. Rounds go on until all suffixes are settled or the order is by most lines.
    """
    names, h = ["r0"], 0
    while 2 << h <= most:
        r, up = f"r{h}", f"r{h + 1}"
        on = W.partitionBy("k", "t", "seg").orderBy("j")
        pairs = written(lines.withColumn("next", F.lead(r, 1 << h).over(on)), "pairs")
        open_ = pairs.filter(F.col(r).isNotNull() & F.col("next").isNotNull())
        ranks = _ranked(open_.groupBy(r, "next").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), [r, "next"], up)
        names.append(up)
        h += 1
        new = looked_up(written(open_, "open"), ranks, [r, "next"]).select("k", "t", "j", up)
        lines = written(pairs.drop("next").join(new, ["k", "t", "j"], "left"), "suffixes")
        if ranks.isEmpty():
            break
    return lines, names


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """(k, t, i, j, first, last): for each line the shortest stretch of min_words words from it, and the shortest up to it.

    i and j are the first and last line's places among a text's lines with words, first and last among all.
    """
    on = W.partitionBy("k", "t", "seg").orderBy("j")
    begin = F.col("e") - F.col("w")
    ahead = F.collect_list(F.struct("e", "j", "pos")).over(on.rowsBetween(0, min_words - 1))
    back = F.collect_list(F.struct(begin.alias("b"), "j", "pos")).over(on.rowsBetween(1 - min_words, 0))
    rows = lines.withColumns({"ahead": ahead, "back": back})
    to = F.get(F.filter("ahead", lambda x: x["e"] - begin >= min_words), F.lit(0))
    from_ = F.try_element_at(F.filter("back", lambda x: F.col("e") - x["b"] >= min_words), F.lit(-1))
    of = lambda i, j, a, b: F.struct(i.alias("i"), j.alias("j"), a.alias("first"), b.alias("last"))
    rows = rows.select("k", "t", F.explode(F.array_distinct(F.array(of(F.col("j"), to["j"], F.col("pos"), to["pos"]), of(from_["j"], F.col("j"), from_["pos"], F.col("pos"))))).alias("x"))
    return rows.select("k", "t", "x.*").filter("i is not null and j is not null").distinct()


def _intervals(lines: DataFrame, names: list[str], stretches: DataFrame) -> DataFrame:
    """stretches with (n_lines, p, q): the interval of the suffix array whose suffixes have all the stretch's lines in common.

    A stretch of n lines, 2**h the largest power up to n, is the common prefix of the suffixes that have rank p by 2**h
    lines and, n - 2**h lines on, rank q. Stretches that nothing else has drop out.
    """
    size = F.col("j") - F.col("i") + 1
    level = F.floor(F.log2(size + F.lit(0.5))).cast("int")
    at = lines.select("k", "t", "j", F.array(*names).alias("r"))
    rows = stretches.withColumns({"n_lines": size, "h": level, "m": (F.col("j") + 1 - F.call_function("shiftleft", F.lit(1), level)).cast("int")})
    rows = rows.join(at.select("k", "t", F.col("j").alias("i"), F.col("r").alias("x")), ["k", "t", "i"]).join(at.select("k", "t", F.col("j").alias("m"), F.col("r").alias("y")), ["k", "t", "m"])
    rank = lambda c: F.get(c, F.col("h"))
    return rows.select("k", "t", "first", "last", "n_lines", rank("x").alias("p"), rank("y").alias("q")).filter("p is not null and q is not null")


def _identified(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).filter("k is not null and text is not null")


def repeated_runs(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(k, t, runs array<struct<first, last>>), and (k, t) of texts that are copies of one with a smaller key.

    runs: the line numbers (from 0) of every maximal run that also starts earlier. k is the key, t the text's hash.
    Lines are split at \\n; those without a word are no part of a run, but go with one around them. A line's id is a
    128-bit hash.

    1. Copies of whole texts are set apart: all of them is a later copy, if they have min_words words.
    2. Lines that stand in one place only are dropped; what is left are sequences of line ids.
    3. Their suffixes are ranked by prefix doubling (see suffix_ranks). A run of min_words words has a stretch of
       min_words lines or fewer at each of its lines, as each has a word; so an order by more lines would change none of
       the intervals below, and the doubling ends there, if suffixes are left at all.
    4. Each line's shortest stretches with min_words words, from it and up to it, are looked up as intervals of suffixes
       with that common prefix. In an interval the earliest start stays (smaller key, then text hash, then line), every
       other member is a later copy. A maximal repeated run is the union of such stretches, so they are merged.

    A line, pair or interval that a third of all texts have is counted before it is joined back, see looked_up.
    """
    texts = _identified(df, key, text)
    copies = _copies(texts)
    lines = _sequences(texts, copies, min_words)
    lines, names = suffix_ranks(lines, min_words)
    spans = written(_intervals(lines, names, _stretches(lines, min_words)), "stretches")
    intervals = spans.groupBy("n_lines", "p", "q").agg(F.min(F.struct("k", "t", "first")).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = looked_up(spans, written(intervals, "intervals"), ["n_lines", "p", "q"]).filter(F.struct("k", "t", "first") > F.col("earliest")).select("k", "t", "first", "last")
    order = W.partitionBy("k", "t").orderBy("first", "last")
    runs = later.withColumn("new", (F.col("first") > F.coalesce(F.max("last").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(-2)) + 1).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("k", "t", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("k", "t").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")), copies


def _whole(parts: Column, text: Column, min_words: int) -> Column:
    """The one run of a copy: from its first line with a word to its last; null if it has too few words."""
    has = F.transform(parts, lambda x: x.rlike(_WORD))
    first, last = F.array_position(has, F.lit(True)) - 1, F.size(parts) - F.array_position(F.reverse(has), F.lit(True))
    return F.when(F.regexp_count(text, F.lit(_WORD)) >= min_words, F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))))


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """df with later copies of repeated line runs taken out of text, and n_lines, n_removed_lines, n_runs (long).

    A copy is later if its key is larger, or the key is the same and it stands lower. Each row keeps its other columns.
    Null, empty and word-less texts stay as they are (a null text has no line, an empty one has one). A text all of
    whose lines go becomes empty. Rows with a null key are passed on unchanged. Rows of one key and text count as one
    text and get the same result; of different texts of one key the one of smaller hash comes first. Columns of the
    three names are replaced.
    """
    df = without(df, "n_lines", "n_removed_lines", "n_runs", "__runs", "__k", "__t", "__copy")
    runs, copies = repeated_runs(df, key, text, min_words)
    found = runs.select("k", "t", "runs", F.lit(False).alias("__copy")).unionByName(copies.select("k", "t", F.lit(None).cast("array<struct<first:int,last:int>>").alias("runs"), F.lit(True).alias("__copy")))
    found = found.select(F.col("k").alias("__k"), F.col("t").alias("__t"), F.col("runs").alias("__runs"), "__copy")
    out = df.join(found, (df[key] == F.col("__k")) & (F.xxhash64(df[text]) == F.col("__t")), "left").drop("__k", "__t")
    parts = F.split(F.col(text), "\n", -1)
    out = out.withColumn("__runs", F.when(F.col("__copy"), _whole(parts, F.col(text), min_words)).otherwise(F.col("__runs")))
    kept = F.filter(parts, lambda line, i: ~F.exists("__runs", lambda r: (r.getField("first") <= i) & (i <= r.getField("last"))))
    removed = F.coalesce(F.aggregate("__runs", F.lit(0), lambda acc, r: acc + r.getField("last") - r.getField("first") + 1), F.lit(0))
    return out.withColumns({
        "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long"),
        "n_removed_lines": removed.cast("long"),
        "n_runs": F.when(F.col("__runs").isNull(), F.lit(0)).otherwise(F.size("__runs")).cast("long"),
        text: F.when(F.col("__runs").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
    }).drop("__runs", "__copy")
