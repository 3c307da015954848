"""Rule bitmask ledger: every quality rule is evaluated once, policies are applied to the stored bits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._vec import binary
from ._work import without

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_lettered")
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_NO_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_ALL = bytes(range(256))
_NOT_LETTERS = bytes(b for b in _ALL if b not in _LETTERS + _LETTERS.upper())
_NOT_CAPITALS = bytes(b for b in _ALL if b not in _LETTERS.upper())
_UNLETTERED = bytes(b for b in range(128) if b not in _LETTERS + _LETTERS.upper() + _NO_SPACE)


def measure(text: bytes) -> tuple[int, ...]:
    """The MEASURES of one text; words are runs of anything but space and U+0009 to U+000D."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    chars = len(text.translate(None, _CONTINUED + _NO_SPACE))
    repeated = 0
    if n > 2:
        threes = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(threes)) < len(threes):
            seen: set = set()
            twice = set()
            for x in threes:
                if x in seen:
                    twice.add(x)
                else:
                    seen.add(x)
            covered = 0  # words before this one are counted
            for i, x in enumerate(threes):
                if x in twice:
                    repeated += i + 3 - max(i, covered)
                    covered = i + 3
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        n,
        chars,
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(text.translate(None, _NOT_LETTERS)),
        len(text.translate(None, _NOT_CAPITALS)),
        len(text.translate(None, _UNLETTERED).split()),
    )


def measures(text: Column) -> Column:
    """Struct of the MEASURES (long) of a text column; a null text has no words."""

    def batch(texts: pa.Array) -> pa.Array:
        rows = [measure(x.as_py()) for x in binary(texts)]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))], list(MEASURES))

    return F.arrow_udf(batch, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))(text)


def rules(m: str = "measures") -> list[tuple[str, Column]]:
    """(name, fails) of every rule, in the order of its bit; only ever append. All in whole numbers, so exact."""
    x = {k: F.col(f"{m}.{k}") for k in MEASURES}
    return [
        ("few_words", x["n_words"] < 50),
        ("repeated_words", 100 * x["n_repeat_words"] > 50 * x["n_words"]),
        ("short_or_long_words", (x["word_chars"] < 2 * x["n_words"]) | (x["word_chars"] > 15 * x["n_words"])),
        ("symbols", 10 * x["n_symbols"] > 3 * x["n_words"]),
        ("repeated_lines", 10 * x["n_dup_lines"] > 3 * x["n_lines"]),
        ("capitals", 10 * x["n_capitals"] > 4 * x["n_letters"]),
        ("words_without_letters", 10 * x["n_lettered"] < 7 * x["n_words"]),
    ]


RULES = ("few_words", "repeated_words", "short_or_long_words", "symbols", "repeated_lines", "capitals", "words_without_letters")

#: Versioned policies: the rules that reject. The base rules are the first two.
BASE = ("few_words", "repeated_words")
POLICIES = {
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "short_or_long_words", "symbols", "repeated_lines", "capitals", "words_without_letters"),
}


def mask(names) -> int:
    return sum(1 << RULES.index(n) for n in names)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """df with measures (struct) and failed (long, bit i: rule i fails). One pass, row by row, no shuffle.

    A null or empty text has no words, so it fails few_words alone. Columns of these names are replaced.
    """
    out = without(df, "measures", "failed")
    out = out.withColumn("measures", measures(F.col(f"`{text}`")))
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(rules())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return out.withColumn("failed", total)


def passes(policy: str = "v2", failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(book: DataFrame, policy: str = "v2", failed: str = "failed") -> DataFrame:
    """A row for each rule of a policy: rows it fails, rows that it alone rejects, rows kept without it.

    The ledger is reduced to a count for each combination of bits first, so the rules add no passes.
    """
    whole = mask(POLICIES[policy])
    combos = book.groupBy(F.col(failed).bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    one = F.lit(0).cast("long")
    parts = []
    for name in POLICIES[policy]:
        bit = mask([name])
        alone = F.when(F.col("bits") == bit, F.col("n")).otherwise(one)
        fails = F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("n")).otherwise(one)
        kept = F.when(F.col("bits").bitwiseAND(F.lit(whole & ~bit)) == 0, F.col("n")).otherwise(one)
        parts.append(F.struct(F.lit(name).alias("rule"), F.coalesce(F.sum(fails), one).alias("n_fail"), F.coalesce(F.sum(alone), one).alias("n_alone"), F.coalesce(F.sum(kept), one).alias("n_kept_without")))
    return combos.agg(F.array(*parts).alias("r")).select(F.inline("r"))
