"""Column functions over texts: tokens, stems, hints, match offsets, truncation, routes."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lexicon import BODY_CAP, LANGUAGE_NAMES, NOISE, SDK_LANGUAGES, Lexicon

#: A word's edge, where the pattern doesn't say on which side the word lies.
_EDGE = r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"


def rx(pattern: str, flags: str = "") -> str:
    r"""A pattern for the JVM whose word boundaries are those of ASCII letters, digits and underscore.

    Beside a plain letter one side is known: a word begins at it if no word character is before it (looked at only once
    the letter is found, so that most places cost one comparison), or ends at it if none follows.
    """
    out = re.sub(r"\\b([A-Za-z0-9_])(?![?*+{])", r"\1(?<!\\w\1)", pattern)
    out = re.sub(r"(?<!\\)([A-Za-z0-9_])\\b", r"\1(?!\\w)", out)
    return (f"(?{flags})" if flags else "") + out.replace(r"\b", _EDGE)


def approx_tokens(text: Column) -> Column:
    """A quarter of the length, rounded up; 0 for null or empty."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("long")


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


# Accented letters and what they are without accents.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēėęěğīįłńňōőŕřśšťūůűźżžșț"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeeegiilnnoorrsstuuuzzzst"


def index_tokens(text: Column) -> Column:
    """Tokens of the index: lower case, runs of Unicode letters and digits, without accents; not stemmed yet."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normal_language(name: Column) -> Column:
    key = F.lower(F.trim(name))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, key), F.lit("unknown"))


def is_sdk_language(lang: Column) -> Column:
    return lang.isin(*SDK_LANGUAGES)


def plural_stem(token: Column) -> Column:
    """A token without a plural's ending, as a key to compare by."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when(n <= 3, token)
        .when(token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("es") & (n > 4), cut(2))
        .when(token.endswith("s") & ~token.endswith("ss"), cut(1))
        .otherwise(token)
    )


def query_tokens(text: Column, lexicon: Lexicon) -> Column:
    """Tokens of a query in order: two characters at least, no stopword, the first of those with one plural stem."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9_-]*"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in lexicon.stopwords])
    kept = F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t)))
    seen = F.struct(F.array().cast("array<string>").alias("stems"), F.array().cast("array<string>").alias("out"))

    def step(acc, t):
        new = F.struct(F.array_append(acc["stems"], plural_stem(t)).alias("stems"), F.array_append(acc["out"], t).alias("out"))
        return F.when(F.array_contains(acc["stems"], plural_stem(t)), acc).otherwise(new)

    return F.aggregate(kept, seen, step, lambda acc: acc["out"])


def without_noise(text: Column) -> Column:
    out = reduce(lambda c, p: F.regexp_replace(c, rx(p, "i"), " "), NOISE, text)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def first_hint(text: Column, hints) -> Column:
    """The name of the first pattern that a text matches, or null."""
    return F.coalesce(*[F.when(text.rlike(rx(p, "i")), F.lit(name)) for p, name in hints])


_RUN = 512


def let(value: Column, body) -> Column:
    """body(value), with value made once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(xs: Column, op, zero: Column, kind: str = "int") -> Column:
    """For each entry of an array what op makes of those before it, starting from zero.

    A fold copies what it has at every step, so it goes over runs of _RUN entries and then over the runs' results.
    """

    def fold(xs: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(xs, first, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def run(xs: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(_RUN))
        return F.transform(begins, lambda b: F.slice(xs, b + 1, F.lit(_RUN)))

    def whole(runs: Column) -> Column:
        firsts = fold(F.transform(runs, lambda r: F.aggregate(r, zero, op)), zero)
        return F.flatten(F.zip_with(runs, firsts, fold))

    return let(xs, lambda xs: F.when(F.size(xs) <= _RUN, fold(xs, zero)).otherwise(let(run(xs), whole)))


def offsets(sizes: Column) -> Column:
    """For each number of an array<int> the sum of those before it."""
    return running(sizes, lambda acc, x: acc + x, F.lit(0))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, hit, part>>: leftmost non-overlapping matches; start counts code points from 0, part is a group.

    Offsets are running sums over what lies between the matches, so this stays inside the JVM, and its cost is linear in
    the text. Null gives none. Texts without a match, which are most for a rule, cost one search.
    """
    text = F.coalesce(text, F.lit(""))
    return let(pieces_of(text, pattern, group), lambda x: F.when(x.isNotNull(), placed(x)).otherwise(no_matches()))


def no_matches() -> Column:
    return F.array().cast("array<struct<start:int,hit:string,part:string>>")


def pieces_of(text: Column, pattern: str, group: int = 0) -> Column:
    """struct<first, hits, parts, gaps>: what is before the first match, the matches, a group of each, and if there are several
    the lengths of what lies around them. Null without a match.

    Most texts with a match have one. For those the text isn't split, which would compile the pattern anew for each text.
    """

    def pieces(hits: Column) -> Column:
        before = F.length(F.regexp_replace(text, rf"(?:{pattern})[\s\S]*+", ""))
        first = F.when(F.octet_length(text) == F.length(text), F.regexp_instr(text, F.lit(pattern)) - 1).otherwise(before)  # it counts UTF-16 units
        gaps = F.when(F.size(hits) > 1, F.transform(F.split(text, pattern, -1), F.length))
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        return F.when(F.size(hits) > 0, F.struct(first.alias("first"), hits.alias("hits"), parts.alias("parts"), gaps.alias("gaps")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pieces)


def placed(pieces: Column) -> Column:
    """array<struct<start, hit, part>> of pieces_of()."""

    def row(start: Column, hit: Column, part: Column) -> Column:
        return F.struct(start.alias("start"), hit.alias("hit"), part.alias("part"))

    def rows(x: Column) -> Column:
        sizes = F.zip_with(x["gaps"], x["hits"], lambda g, h: g + F.coalesce(F.length(h), F.lit(0)))
        begins = F.zip_with(offsets(sizes), x["gaps"], lambda at, g: at + g)
        found = F.slice(begins, F.lit(1), F.size(x["hits"]))  # the last gap has no match behind it
        return F.zip_with(F.arrays_zip(found.alias("start"), x["hits"].alias("hit")), x["parts"], lambda f, p: row(f["start"], f["hit"], p))

    def one(x: Column) -> Column:
        return F.array(row(x["first"], F.get(x["hits"], F.lit(0)), F.get(x["parts"], F.lit(0))))

    return let(pieces, lambda x: F.when(x["gaps"].isNull(), one(x)).otherwise(rows(x)))


def line_of(text: Column, start: Column) -> Column:
    """Number, from 1, of the line of an offset."""
    head = F.substring(text, F.lit(1), start)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, start: Column) -> Column:
    head = F.substring(text, F.lit(1), start)
    return F.length(F.substring_index(head, "\n", -1)) + 1


def truncated(body: Column, cap: int = BODY_CAP) -> Column:
    """A body of at most cap characters, cut at the last blank line if that is past six tenths of it."""
    window = F.substring(body, 1, cap)
    back = F.locate("\n\n", F.reverse(window))
    at = F.lit(cap) - back - 1
    cut = F.when((back > 0) & (at > F.lit(cap * 0.6)), F.substring(window, F.lit(1), at)).otherwise(window)
    return F.when(F.length(body) <= cap, body).otherwise(_trimmed(cut))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def first_paragraph(body: Column) -> Column:
    return F.substring_index(_trimmed(body), "\n\n", 1)


def summary(description: Column, body: Column, cap: int) -> Column:
    has = F.length(_trimmed(F.coalesce(description, F.lit("")))) > 0
    return F.substring(F.when(has, description).otherwise(first_paragraph(F.coalesce(body, F.lit("")))), 1, cap)


def route_of(said: Column) -> Column:
    """A route from a route or url: a url's path after /docs/, or the file in a raw Markdown url; null for other urls."""
    web = F.coalesce(
        F.nullif(F.regexp_extract(said, r"/docs/([^?#]+?)/?$", 1), F.lit("")),
        F.nullif(F.regexp_extract(said, r"master/(.+?)\.md", 1), F.lit("")),
    )
    return F.when(said.startswith("http"), web).otherwise(F.regexp_replace(said, "^/+|/+$", ""))


# Porter's published stemmer; it runs over distinct words only, never over texts.
_C, _V = "[^aeiou]", "[aeiouy]"
_CONS, _VOW = _C + "[^aeiouy]*", _V + "[aeiou]*"
_M1 = re.compile(f"^({_CONS})?{_VOW}{_CONS}")
_ONE = re.compile(f"^({_CONS})?{_VOW}{_CONS}({_VOW})?$")
_M2 = re.compile(f"^({_CONS})?{_VOW}{_CONS}{_VOW}{_CONS}")
_HAS_VOWEL = re.compile(f"^({_CONS})?{_V}")
_CVC = re.compile(f"^{_CONS}{_V}[^aeiouwxy]$")
_STEP2 = dict(x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split())
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def _longest(word: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + table[end] if _M1.match(stem) else word
    return word


def porter(word: str) -> str:
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    y = word[0] == "y"
    w = "Y" + word[1:] if y else word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M1.match(w[:-3]):
            w = w[:-1]
    elif w.endswith(("ed", "ing")):
        stem = w[: -2 if w.endswith("ed") else -3]
        if _HAS_VOWEL.match(stem):
            w = stem
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiouylsz":
                w = w[:-1]
            elif _ONE.match(w) and _CVC.match(w):
                w += "e"
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(_longest(w, _STEP2), _STEP3)
    for end in _STEP4:
        if w.endswith(end):
            if _M2.match(w[: -len(end)]):
                w = w[: -len(end)]
            break
    else:
        if w.endswith(("sion", "tion")) and _M2.match(w[:-3]):
            w = w[:-3]
    if w.endswith("e"):
        stem = w[:-1]
        if _M2.match(stem) or (_M1.match(stem) and not (_ONE.match(stem) and _CVC.match(stem))):
            w = stem
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return "y" + w[1:] if y else w


def porter_stem(words) -> Column:
    """Stems of a column of distinct words, in Arrow batches."""

    def batch(part: pd.Series) -> pd.Series:
        return part.map(porter, na_action="ignore")

    return F.pandas_udf(batch, StringType())(words)
