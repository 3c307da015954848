"""Personal data: overlapping candidate spans, scored by boosted trees over format and context features.

Everything on the main path is DataFrame functions. Spans are (kind, start, end) in code points, end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, offsets, running
from ._work import without, written

#: Kinds in order, and their base patterns. Possessive where nothing can be given back, so that
#: Java neither recurses nor tries again on long texts.
KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: (kind of a selected span, pattern, what a text must contain). They may overlap the base and
#: one another, and also find what is no personal data: numbers without a check digit, versions, handles, settings.
GENERATORS = (
    ("phone", r"(?<![0-9A-Za-z])\+?\(?[0-9]{1,4}\)?(?:[\x20.-]{0,2}\(?[0-9]{2,4}\)?){2,4}(?![0-9A-Za-z])", "[0-9]{2}"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9A-Za-z])", "[0-9]{2}|[0-9][ .-][0-9]"),
    ("ip", r"(?<![0-9A-Za-z.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}+(?![0-9A-Za-z])", r"[0-9]\.[0-9]"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[\x20]?(?:@|\(at\)|\[at\])[\x20]?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+", "@|[(\\[]at[)\\]]"),
    ("secret", r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|credential|api[_-]?key|key|id|code)[\x20]?[=:][\x20]?[\"']?[A-Za-z0-9_+/-]{4,}+", "[=:]"),
)
#: Kinds that show evidence only at times: a candidate without it may be of the kind all the same.
PARTIAL = ("phone",)
#: What the trees see of a candidate: its shape, and what stands around it. Nothing of what _evidence looks at is here.
FEATURES = ("digits_7", "digits_12", "digits_16", "parted", "bracket", "dots_2", "long_12", "long_24", "quoted", "apart_left", "apart_right", "line_start", "line_end", "after_letter")
#: Words before a number that say what it is: evidence, not a feature.
_PHONE_CUES = r"(?i)(?:tel|telephone|phone|call|fax|mobile|cell)[^A-Za-z0-9]{0,3}$"


def found(text: Column, pattern: str, needs: str) -> Column:
    """array<struct<start, end, hit, left, right>>: the leftmost non-overlapping matches of a pattern; empty for null.

    left has up to 16 characters before a match and right one after it, taken from what lies between the matches (of a
    neighbour that touches, one character), so the cost is linear in the text. Texts without a match of needs, a cheap
    pattern that each match contains, are not searched.
    """
    said = F.coalesce(text, F.lit(""))
    cut = F.struct(F.split(said, pattern, -1).alias("gaps"), F.regexp_extract_all(said, F.lit(pattern), F.lit(0)).alias("hits"))

    def rows(x: Column) -> Column:
        gap, hit = lambda i: F.get(x["gaps"], i), lambda i: F.get(x["hits"], i)

        def row(h: Column, i: Column, begins: Column) -> Column:
            start = F.get(begins, i) + F.length(gap(i))
            left = F.when(F.length(gap(i)) > 0, F.right(gap(i), F.lit(16))).otherwise(F.coalesce(F.right(hit(i - 1), F.lit(1)), F.lit("")))
            right = F.when(F.length(gap(i + 1)) > 0, F.left(gap(i + 1), F.lit(1))).otherwise(F.coalesce(F.left(hit(i + 1), F.lit(1)), F.lit("")))
            return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"), left.alias("left"), right.alias("right"))

        return let(offsets(F.transform(x["hits"], lambda h, i: F.length(gap(i)) + F.length(h))), lambda begins: F.transform(x["hits"], lambda h, i: row(h, i, begins)))

    return F.when(said.rlike(needs), let(cut, rows)).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string,left:string,right:string>>"))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octets(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return _octets(hit)
    if kind == "card":
        return F.length(_digits(hit)).between(13, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]{2}|[0-9][ -][0-9]", "phone": r"\+[0-9]"}


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(found(text, PATTERNS[kind], _NEEDS[kind]), lambda s: valid(kind, s["hit"]))


def _bits(s: Column) -> Column:
    """A candidate's features as a number of len(FEATURES) bits."""
    hit, right = s["hit"], s["right"]
    digits = F.length(_digits(hit))
    left = F.right(s["left"], F.lit(1))
    tests = [
        digits >= 7, digits >= 12, digits >= 16, hit.rlike(r"[\x20-]"), hit.rlike(r"[()\[\]]"), hit.rlike(r"\..*\."), F.length(hit) >= 12, F.length(hit) >= 24,
        hit.rlike("[\"']") | left.rlike("[\"'`(<]"), (F.length(left) == 0) | left.rlike(r"[\s\"'(=:,]"), (F.length(right) == 0) | right.rlike(r"[\s\"'),.;:!?]"),
        (F.length(left) == 0) | (left == "\n"), (F.length(right) == 0) | (right == "\n"), left.rlike(r"\p{L}"),
    ]
    out = F.lit(0)
    for i, t in enumerate(tests):
        out = out + F.when(t, F.lit(1 << i)).otherwise(F.lit(0))
    return out


def _evidence(kind: str, s: Column) -> Column:
    """What the trees learn from: signs of a kind that no feature holds.

    A card's check digit, an address's ranges, a domain's last label, a phone's plus or the word before it, digits and
    letters mixed in a secret. Features can only guess these from shape and surroundings, so a candidate without them
    (a phone number without a plus) is chosen if those that look like it mostly have them.
    """
    hit = s["hit"]
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15) & (hit.startswith("+") | s["left"].rlike(_PHONE_CUES))
    if kind == "email":
        return hit.rlike(r"\.[A-Za-z]{2,}$") & hit.rlike("^[^.]")
    if kind == "secret":
        value = F.regexp_extract(hit, r"[A-Za-z0-9_+/-]+$", 0)
        return (F.length(value) >= 12) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return valid(kind, hit)


def _candidate(i: int, kind: str):
    return lambda s: F.struct(F.lit(i).alias("gen"), s["start"].alias("start"), s["end"].alias("end"), _bits(s).alias("bits"), _evidence(kind, s).cast("int").alias("label"))


def _of_kind(kind):
    """A span with its kind in front."""
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, one array of base spans a kind, cands array<struct<kind, start, end, bits, label>>), one pass, no shuffle."""
    t = F.col(text)
    base = {k: base_spans(t, k) for k in PATTERNS}
    made = []
    for i, (kind, pattern, needs) in enumerate(GENERATORS):
        made.append(F.transform(found(t, pattern, needs), _candidate(i, kind)))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return df.select(F.col(key), *[plain(base[k]).alias(f"base_{k}") for k in PATTERNS], F.concat(*made).alias("cands"))


@dataclass(frozen=True)
class Boosted:
    """Depth-two trees over (generator, bits): ((bit, bit, four values), ...), a prior, and a threshold a generator."""

    prior: float
    trees: tuple[tuple[int, int, tuple[float, float, float, float]], ...]
    thresholds: tuple[float, ...]

    def margin(self, code: Column) -> Column:
        out = F.lit(self.prior)
        for a, b, (v0, v1, v2, v3) in self.trees:
            cell = F.shiftright(code, a).bitwiseAND(F.lit(1)) * 2 + F.shiftright(code, b).bitwiseAND(F.lit(1))
            out = out + F.when(cell == 0, v0).when(cell == 1, v1).when(cell == 2, v2).otherwise(v3)
        return out


_NEVER = 1e9
#: Kinds with a check that a number of the kind always passes: candidates that fail it are never selected.
CHECKED = ("ip", "card")
#: Parts that a corpus' keys are dealt into; each is scored by trees that haven't seen it.
FOLDS = 5


def _threshold(cells: list[tuple[float, list[float]]], precision: float, least: float, partial: bool) -> float:
    """The lowest margin from which up the candidates (margin, (without, with evidence)) reach the precision, and least even
    at the lower end of the share's 95 % confidence interval (Wilson), which takes some fifteen candidates.

    Where only some of a kind show evidence, a margin's share of it is divided by the share that those with evidence
    have around them on average: the usual correction for positives that are only partly labelled.
    """
    at: dict[float, list[float]] = {}
    for m, n in cells:
        have = at.setdefault(m, [0.0, 0.0])
        have[0] += n[0]
        have[1] += n[1]
    shown = sum(n[1] for n in at.values())
    usual = sum(n[1] * n[1] / (n[0] + n[1]) for n in at.values() if n[1]) / shown if partial and shown else 1.0
    right = total = 0.0
    cut = _NEVER
    for m in sorted(at, reverse=True):
        size = sum(at[m])
        right += size * min(1.0, at[m][1] / size / usual)
        total += size
        share, z = right / total, 1.64
        low = (share + z * z / (2 * total) - z * math.sqrt(max(0.0, share * (1 - share)) / total + z * z / (4 * total * total))) / (1 + z * z / total)
        if share >= precision and low >= least:
            cut = m - 1e-6
    return cut


def _boosted(codes: np.ndarray, counts: np.ndarray, rounds: int, rate: float) -> tuple[float, list[tuple[int, int, tuple[float, ...]]]]:
    """Prior and depth-two trees fitted to counts (without, with evidence) of codes."""
    width = len(FEATURES) + len(GENERATORS)
    bit = ((codes[:, None] >> np.arange(width)) & 1).astype(float)
    neg, pos = counts.sum(axis=0) if len(counts) else (0.0, 0.0)
    prior = math.log((pos + 0.5) / (neg + 0.5))
    margin, size, trees = np.full(len(codes), prior), counts.sum(axis=1), []
    for _ in range(rounds if neg and pos else 0):
        q = 1 / (1 + np.exp(-margin))
        gain, sums = np.zeros((width, width)), []
        for x in (counts[:, 1] - size * q, size * q * (1 - q)):
            both = (bit * x[:, None]).T @ bit
            one = np.diag(both)
            sums.append(np.stack([x.sum() - one[:, None] - one[None] + both, one[None] - both, one[:, None] - both, both]))  # a and b: 00, 01, 10, 11
        gain = (sums[0] ** 2 / (sums[1] + 1)).sum(axis=0)
        gain[np.triu_indices(width)] = -1
        a, b = map(int, np.unravel_index(np.round(gain, 9).argmax(), gain.shape))
        values = tuple(round(max(-4.0, min(4.0, rate * x / (y + 1))), 9) for x, y in zip(sums[0][:, a, b].tolist(), sums[1][:, a, b].tolist(), strict=True))
        trees.append((a, b, values))
        margin = margin + np.array(values)[(2 * bit[:, a] + bit[:, b]).astype(int)]
    return prior, trees


def _margin(code: int, prior: float, trees) -> float:
    return prior + sum(values[(code >> a & 1) * 2 + (code >> b & 1)] for a, b, values in trees)


def train(cands: DataFrame, key: str, rounds: int = 24, rate: float = 0.4, precision: float = 0.98, least: float = 0.85) -> Boosted:
    """Boost on every candidate of the corpus, labelled by _evidence; thresholds are calibrated across FOLDS parts of the keys.

    Features are bits, so Spark reduces all candidates to counts of (part, generator, bits, label): at most
    5 * 5 * 2**14 * 2 rows however large the corpus, which is what the driver fits to. A generator's threshold comes from
    the margins that trees of the other parts give each part's candidates, see _threshold; one that never reaches the
    precision, or has too few candidates to tell, selects nothing.
    """
    part = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(FOLDS))
    rows = cands.select(part.alias("h"), F.explode("cands").alias("c")).groupBy("h", "c.gen", "c.bits", "c.label").count().collect()
    width = len(FEATURES)
    cells: dict[tuple[int, int], list[float]] = {}
    for r in rows:
        code = r.bits | (1 << (width + r.gen))
        cells.setdefault((r.h, code), [0.0, 0.0])[r.label] += r["count"]

    def fitted(without: int | None):
        own: dict[int, np.ndarray] = {}
        for (h, code), n in cells.items():
            if h != without:
                own[code] = own.get(code, 0) + np.array(n)
        codes = sorted(own)
        return _boosted(np.array(codes, int), np.array([own[c] for c in codes]).reshape(-1, 2), rounds, rate)

    # A code's margin is the mean of those that other parts' trees give it: a part's own share of evidence mustn't move it.
    scored: dict[int, tuple[float, np.ndarray]] = {}
    for h in sorted({h for h, _ in cells}):
        prior, trees = fitted(h)
        for (own, code), n in cells.items():
            if own == h:
                m, all_n = scored.get(code, (0.0, np.zeros(2)))
                scored[code] = (m + _margin(code, prior, trees) * sum(n), all_n + np.array(n))
    by_generator: list[list[tuple[float, list[float]]]] = [[] for _ in GENERATORS]
    for code, (m, n) in sorted(scored.items()):
        by_generator[(code >> width).bit_length() - 1].append((m / n.sum(), n.tolist()))
    prior, trees = fitted(None)
    thresholds = [_threshold(s, precision, least, kind in PARTIAL) for s, (kind, _, _) in zip(by_generator, GENERATORS, strict=True)]
    return Boosted(prior, tuple(trees), tuple(thresholds))


def _fewer(starts: Column, x: Column) -> Column:
    """How many of a sorted array's entries are less than x, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(26))])
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.coalesce(F.get(starts, lo + s - 1) < x, F.lit(False)), lo + s).otherwise(lo))


def _touches(starts: Column, ends: Column, c: Column) -> Column:
    """Whether a span overlaps one of a kind's base spans, which are sorted and don't overlap one another."""
    return F.coalesce(F.get(ends, _fewer(starts, c["end"]) - 1) > c["start"], F.lit(False))


def detect(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base_email, base_ip, base_card, base_phone: array<struct<start, end>>, spans: array<struct<kind, start, end>>).

    Base spans are all kept. Candidates that the trees select, that pass their kind's check and that touch no base span are
    added. The work on a text is in proportion to its length and, but for a logarithm, to its matches. A null or empty
    text has no spans; equal rows each have their own; any other columns of df are left out.
    """
    found_in = written(candidates(df, key, text), "candidates")
    model = train(found_in, key)
    base = F.concat(*[F.transform(f"base_{k}", _of_kind(KINDS.index(k))) for k in PATTERNS])
    kind_of = F.array(*[F.lit(KINDS.index(g[0])) for g in GENERATORS])
    cut = F.array(*[F.lit(float(x)) for x in model.thresholds])
    code = lambda c: c["bits"].bitwiseOR(F.element_at(F.array(*[F.lit(1 << (len(FEATURES) + i)) for i in range(len(GENERATORS))]), c["gen"] + 1))
    checked = F.array(*[F.lit(g[0] in CHECKED) for g in GENERATORS])

    # starts and ends are made once for a text, not once for each candidate
    edges = F.struct(*[F.col(f"base_{k}")[e].alias(f"{k}_{e}") for k in PATTERNS for e in ("start", "end")])

    def able(edge: Column, c: Column) -> Column:
        out = (model.margin(code(c)) >= F.get(cut, c["gen"])) & (~F.get(checked, c["gen"]) | (c["label"] == 1))
        for k in PATTERNS:
            out = out & ~_touches(edge[f"{k}_start"], edge[f"{k}_end"], c)
        return out

    chosen = let(edges, lambda edge: F.filter("cands", lambda c: able(edge, c)))
    added = F.transform(chosen, lambda c: F.struct(F.get(kind_of, c["gen"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    out = found_in.withColumn("base", base)
    out = out.withColumn("spans", F.array_sort(F.concat("base", added)))
    named = F.transform("spans", lambda s: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return out.select(key, *[f"base_{k}" for k in PATTERNS], named.alias("spans"))


def named_base() -> Column:
    """The base spans of detect()'s columns, kinds in order."""
    return F.concat(*[F.transform(f"base_{k}", _of_kind(k)) for k in PATTERNS])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of the blocks that a text is cut into to be put together again.
_BLOCK = 1024


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[{}]") -> DataFrame:
    """df with every span of text replaced by mark (its kind in the braces); overlapping spans become one, named by the first.

    Keys must be unique. A null text stays null. A column named spans is replaced.
    """
    df = without(df, "spans")
    spans = detect(df.select(key, text), key, text).select(F.col(key).alias("__k"), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans"))
    out = df.join(spans, df[key] == F.col("__k"), "left").drop("__k")
    before, after = mark.split("{}")
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))

    def piece(cut: Column, a: Column, b: Column) -> Column:
        """Characters a to b of a text in blocks of _BLOCK: only the blocks that they are in are looked at."""
        first = F.floor(a / _BLOCK).cast("int")
        some = F.slice(cut, first + 1, F.floor((b - 1) / _BLOCK).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(some, ""), a - first * _BLOCK + 1, b - a)).otherwise("")

    def whole(x: Column) -> Column:
        said = lambda s, i: F.when(s["start"] >= F.get(x["upto"], i), F.concat(piece(x["cut"], F.get(x["upto"], i), s["start"]), F.lit(before), s["kind"], F.lit(after))).otherwise("")
        end = F.array_max(F.transform(F.col("spans"), lambda s: s["end"]))
        return F.concat(F.array_join(F.transform("spans", said), ""), piece(x["cut"], end, F.length(text)))

    upto = running(F.transform("spans", lambda s: s["end"]), lambda acc, x: F.greatest(acc, x), F.lit(0))
    cut = F.struct(blocks.alias("cut"), upto.alias("upto"))
    return out.withColumn(text, F.when(F.size("spans") > 0, let(cut, whole)).otherwise(F.col(text)))
