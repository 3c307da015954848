"""Secrets in texts: patterns, and a conditional random field that tags what stands and looks like what they find.

Tokens are runs of letters, digits and + / _ -. Only a token of eight or more characters that mixes digits or case can
be part of a secret; every other token is outside for certain. The chain falls apart at certain tokens, so decoding the
runs of possible ones by themselves, each with its neighbours as features, gives the tags of the whole text.
Spans are (kind, start, end) in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from ._work import written

#: Base kinds in order, and their patterns.
KINDS = ("assign", "access", "hex", "tagged")
_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WORDS = ("password", "passwd", "secret", "token", "api")

_POSSIBLE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_-]{8,}")
_PLAIN_WORD = re.compile(r"[A-Za-z]+")
_ALNUM = re.compile(r"\w")
#: Longest sequence that is trained on; decoding has no such bound.
TRAINED = 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: leftmost non-overlapping matches of each kind; those that are too short are dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def sequences(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of possible tokens: the next begins at most three characters on, with no letter or digit between."""
    run: list[tuple[int, int]] = []
    for m in _POSSIBLE.finditer(text):
        a, b = m.span()
        if run and (a - run[-1][1] > 3 or _ALNUM.search(text, run[-1][1], a)):
            yield run
            run = []
        run.append((a, b))
    if run:
        yield run


def file_features(text: str) -> list[str]:
    """What the whole text looks like: its share of settings and of code, and its length."""
    n = max(1, len(text))
    return [f"file settings {min(3, 200 * text.count('=') // n)}", f"file code {min(3, 100 * (text.count('{') + text.count(';')) // n)}", f"file length {min(5, len(str(n)))}"]


def _bits(s: str) -> float:
    """Entropy of a token's characters."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in map(s.count, set(s)))


def _turns(s: str) -> int:
    """How often a token goes over from letters to digits, or from one case to the other."""
    kind = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "." for c in s]
    return sum(a != b for a, b in zip(kind, kind[1:], strict=False))


def token_features(text: str, start: int, end: int) -> tuple[list[str], list[str], list[str]]:
    """(shape, marks around it, neighbouring words) of a token."""
    s = text[start:end]
    n = len(s)
    cases = ("l" if any(c.islower() for c in s) else "") + ("u" if any(c.isupper() for c in s) else "") + ("d" if any(c.isdigit() for c in s) else "")
    left = text[max(0, start - 48) : start].rsplit("\n", 1)[-1]
    words = [(m[0].lower()[:16], m.end()) for m in _PLAIN_WORD.finditer(left)][-2:]
    mark = left[words[-1][1] if words else 0 :].replace(" ", "").replace('"', "'")[-2:]
    shape = [
        f"length {min(6, n.bit_length())} {n >= 20} {n >= 30}", f"cases {cases}", f"digits {5 * sum(c.isdigit() for c in s) // n}", f"turns {min(8, 16 * _turns(s) // n)}",
        f"entropy {int(2 * _bits(s))}", f"hex {all(c in '0123456789abcdefABCDEF' for c in s)}", f"signs {'+' in s or '/' in s} {'_' in s} {'-' in s}",
    ]
    marks = [
        f"mark {mark}", f"line start {not left.strip()}", f"quoted {left[-1:] in QUOTES} {text[end : end + 1] in QUOTES}", f"next {text[end : end + 1].strip()[:1]}",
    ]
    return shape, marks, [f"word {i} {w}" for i, (w, _) in enumerate(reversed(words))]


QUOTES = ("'", '"', "`")


def _secretive(s: str) -> bool:
    """Whether a token looks so random that, unless a pattern finds it, nobody can say what it is."""
    return len(s) >= 16 and _bits(s) >= 3.2 and 8 * _turns(s) >= len(s)


def _glue(text: str, run: list[tuple[int, int]]) -> list[int]:
    return [0] + [int(a - b == 1 and not text[b].isspace()) for (_, b), (a, _) in zip(run, run[1:], strict=False)]


def labelled(text: str) -> Iterator[tuple[str, dict]]:
    """(words, what is learnt from them) of the sequences of a text with tags from the base spans, cut to TRAINED tokens.

    Of a hex span only those with letters count: plain numbers aren't taught as secrets. A sequence with a token that looks
    random but is in no base span is left out: it may or may not be a secret.
    """
    spans = _merged([(a, b) for a, k, b in base_spans(text) if k != 2 or any(c.isalpha() for c in text[a:b])])
    file, at = file_features(text), 0
    for run in sequences(text):
        tags, known, last = [], True, -1
        for a, b in run:
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            inside = at < len(spans) and spans[at][0] <= a and b <= spans[at][1]
            tags.append((crf.INSIDE if last == at else crf.BEGIN) if inside else crf.OUTSIDE)
            last = at if inside else -1
            known &= inside or not _secretive(text[a:b])
        if known:
            part = run[:TRAINED]
            said = {"features": [[*token_features(text, a, b)] for a, b in part], "file": file, "glue": _glue(text, part), "tags": tags[:TRAINED]}
            yield text[part[0][0] : part[-1][1]], said


@dataclass(frozen=True)
class Tagger:
    chain: crf.Chain
    threshold: float

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Tagged spans of a text, each from a beginning to its last token inside, that touch no base span."""
        if self.threshold > 1:
            return []
        out, at, file = [], 0, file_features(text)
        taken = _merged([(a, b) for a, _, b in base])
        for run in sequences(text):
            shapes = [[x for part in token_features(text, a, b) for x in part] + file for a, b in run]
            tags, chance = self.chain.decode(self.chain.emissions(shapes), _glue(text, run))
            i = 0
            while i < len(run):
                j = i + 1
                if tags[i] == crf.OUTSIDE:
                    i = j
                    continue
                while j < len(run) and tags[j] == crf.INSIDE:
                    j += 1
                a, b = run[i][0], run[j - 1][1]
                while at < len(taken) and taken[at][1] <= a:
                    at += 1
                free = at == len(taken) or taken[at][0] >= b
                if free and float(chance[i:j].min()) >= self.threshold:
                    out.append((a, KINDS.index("tagged"), b))
                i = j
        return out


def _sampled(df: DataFrame, text: str, sample: int) -> list[dict]:
    """At most `sample` sequences with a secret and as many without, those of least hash, from all documents.

    The hash is of the words, so copies of a secret count once. A task keeps 2 * sample of a sort and hands on `sample`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[dict, dict] = ({}, {})
        least = lambda own: dict(sorted(own.items())[:sample])
        for b in batches:
            for t in b.column(0):
                for words, said in labelled(t.as_py() or ""):
                    secret = any(said["tags"])
                    own = kept[secret]
                    h = hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
                    said = json.dumps(said)
                    own[h] = min(said, own.get(h, said))
                    if len(own) > 2 * sample:
                        kept[secret].update(left := least(own))
                        for x in own.keys() - left.keys():
                            del own[x]
        for secret, own in enumerate(kept):
            if own := least(own):
                yield pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array([bool(secret)] * len(own)), pa.array(list(own.values()))], names=["h", "secret", "said"])

    rows = written(df.select(F.col(text).alias("t")).mapInArrow(run, "h string, secret boolean, said string"), "sequences").groupBy("secret", "h").agg(F.min("said").alias("said"))
    best = [rows.filter(F.col("secret") == s).orderBy("h").limit(sample) for s in (True, False)]
    return [json.loads(r.said) | {"held": int(r.h[:4], 16) % 5 == 0} for part in best for r in part.collect()]


def _lower_bound(right: int, n: int, z: float = 1.64) -> float:
    """Of a share, with 95 % confidence (Wilson)."""
    if not n:
        return 0.0
    p = right / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def train(df: DataFrame, text: str, sample: int = 4000, precision: float = 0.9) -> Tagger:
    """Fit the chain to base spans in at most 2 * sample sequences, the bound of what reaches the driver.

    Each sequence is learnt three times, also without its neighbouring words and without the marks beside it, so that
    shapes count by themselves. The is the least chance (half way to the next lower one) from which up the held-out sequences, a fifth, without their
    words, are right with the given precision even at the lower end of its 95 % confidence interval; without enough of
    them nothing is tagged.
    """
    rows = _sampled(df, text, sample)

    def seen(r: dict, parts: int) -> list[list[str]]:
        return [[x for p in f[:parts] for x in p] + r["file"] for f in r["features"]]

    fit = [(seen(r, parts), r["glue"], r["tags"]) for r in rows if not r["held"] for parts in (1, 2, 3)]
    if not any(any(t) for _, _, t in fit):
        return Tagger(crf.train([]), 2.0)
    chain = crf.train(fit)
    held = []
    for r in rows:
        if r["held"]:
            _, chance = chain.decode(chain.emissions(seen(r, 2)), r["glue"])
            held += [(float(c), t != crf.OUTSIDE) for c, t in zip(chance, r["tags"], strict=True)]
    threshold, right, n = 2.0, 0, 0
    held.sort(key=lambda x: -x[0])
    for i, (c, ok) in enumerate(held):
        n, right = n + 1, right + ok
        below = held[i + 1][0] if i + 1 < len(held) else 0.0
        if below < c and c >= 0.5 and _lower_bound(right, n) >= precision:
            threshold = max(0.5, (c + below) / 2)
    return Tagger(chain, threshold)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000) -> DataFrame:
    """(key, base, spans): two array<struct<kind, start, end>> by start, then kind as listed, then end.

    spans has all base spans, and those that the tagger adds (kind "tagged"), which touch no base span. A null or empty
    text has none; equal rows have equal results; null keys stay; an empty table stays empty; any other columns of df are
    left out. The work on a text is linear in its length and its matches.
    """
    tagger = train(df, text, sample)

    def batch(texts: pa.Array) -> pa.Array:
        base, spans = [], []
        for t in texts:
            said = t.as_py() or ""
            own = base_spans(said)
            base.append([(KINDS[k], a, b) for a, k, b in own])
            spans.append([(KINDS[k], a, b) for a, k, b in sorted(own + tagger.spans(said, own))])
        named = lambda rows: pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in r] for r in rows], pa.list_(_SPAN))
        return pa.StructArray.from_arrays([named(base), named(spans)], names=["base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    found = F.arrow_udf(batch, f"struct<base:{kind},spans:{kind}>")(F.col(text))
    return df.select(F.col(key), found.alias("__r")).select(key, "__r.base", "__r.spans")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[int, int]], mark: str = "[secret]") -> str:
    """A text with its spans replaced; overlapping ones become one."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text: str = "text", sample: int = 4000) -> DataFrame:
    """df with every secret in text replaced by [secret]; a null text stays null. All other columns and rows stay."""
    tagger = train(df, text, sample)

    def batch(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            said = t.as_py()
            own = base_spans(said or "")
            out.append(said and masked(said, [(a, b) for a, _, b in own + tagger.spans(said, own)]))
        return pa.array(out, pa.string())

    return df.withColumn(text, F.arrow_udf(batch, "string")(F.col(text)))
