import random
from array import array

from pyspark.sql import functions as F

from millrace.llm import pieces


def test_segments_lose_no_score():
    """Solved piece by piece, a text scores as much as solved whole, and comes back from its ids."""
    v = pieces.load()
    coder = pieces.Coder(v)
    score = {i: s for i, _, s in v.pieces}
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abc ..,²x\n\t()=-_ é漢 www.com://▁😀") for _ in range(rnd.randrange(1, 60))) for _ in range(1500)]
    for x in texts:
        ids, whole = array("i", coder.encode(x)), coder.best(" " + x)
        assert abs(sum(score.get(i, v.byte_score) for i in ids) - sum(score.get(i, v.byte_score) for i in whole)) < 1e-6, x
        assert coder.decode(ids) == x


def _best_score(text, table, byte_score):
    """Plain dynamic programming over all substrings."""
    best = [0.0] + [float("-inf")] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 20), e):
            if text[s:e] in table:
                best[e] = max(best[e], best[s] + table[text[s:e]])
        if text[e - 1] not in table:
            best[e] = max(best[e], best[e - 1] + byte_score * len(text[e - 1].encode()))
    return best[-1]


def test_viterbi_is_best():
    v = pieces.load()
    coder = pieces.Coder(v)
    table, score = {p: s for _, p, s in v.pieces}, {i: s for i, _, s in v.pieces}
    rnd = random.Random(3)
    for _ in range(200):
        x = "".join(rnd.choice("theandionr s.é漢") for _ in range(25))
        got = sum(score.get(i, v.byte_score) for i in coder.best(" " + x))
        assert abs(got - _best_score(" " + x, table, v.byte_score)) < 1e-6


def _plain_ids(text, table, v):
    """Plain dynamic programming: at each end longer pieces first, the first best stays, bytes last where no single piece ends."""
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 40), e):
            if text[s:e] in table and best[s] + table[text[s:e]][1] > best[e]:
                best[e], back[e] = best[s] + table[text[s:e]][1], (s, [table[text[s:e]][0]])
        raw = text[e - 1].encode()
        if text[e - 1] not in table and best[e - 1] + v.byte_score * len(raw) > best[e]:
            best[e], back[e] = best[e - 1] + v.byte_score * len(raw), (e - 1, [v.byte_ids[b] for b in raw])
    out, at = [], len(text)
    while at:
        at, ids = back[at]
        out = ids + out
    return out


def test_ids_are_those_of_plain_dynamic_programming():
    v = pieces.load()
    coder = pieces.Coder(v)
    assert max(len(p) for _, p, _ in v.pieces) <= 40
    table = {p: (i, s) for i, p, s in v.pieces}
    rnd = random.Random(11)
    for alphabet in ("theandionr s.é漢", "aab b", "10 2.,-x\n"):
        for _ in range(150):
            x = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 40)))
            want = [i for part in coder.segment.findall(" " + x) for i in _plain_ids(part, table, v)]
            assert list(array("i", coder.encode(x))) == want, x


def test_decoding_of_any_lists():
    import pyarrow as pa

    v = pieces.load()
    coder = pieces.Coder(v)
    word = next(i for i, p, _ in v.pieces if p == " the")
    plain = next(i for i, p, _ in v.pieces if p == "th")
    rows = [None, [], [word, word], [plain], [v.byte_ids[0xC3]], [word, v.byte_ids[0xE9]], [word, 10**9, -1, None, word]]
    for x in (rows, rows[:3], rows[4:], []):
        got = coder.decode_all(pa.array([None, *x, [word]], pa.list_(pa.int32())).slice(1, len(x))).to_pylist()
        assert got == [None if r is None else coder.decode(r) for r in x]


def test_small_runs_and_a_full_store(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(pieces, "_RUN", 64)
    monkeypatch.setattr(pieces, "MEMO", 2000)
    texts = [None, "", "the and of " * 50, *[f"word{i} x\n" * 3 for i in range(40)], "é漢"]
    coder = pieces.Coder(pieces.load())
    ids = coder.encode_all(pa.array(texts, pa.string()))
    assert coder.decode_all(ids).to_pylist() == [t or "" for t in texts] and coder.kept < 2600
    assert pieces.Coder(pieces.load()).encode_all(pa.array(texts, pa.string())).equals(ids)


def test_nulls_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "a" * 200_000), (4, "x\n y  z"), (4, "x\n y  z")]
    coder = pieces.Pieces(spark)
    out = spark.createDataFrame(rows, "id int, text string").withColumn("ids", coder.encode(F.col("text"))).withColumn("back", coder.decode(F.col("ids"))).collect()
    assert all(r.back == r.text for r in out)
    assert [r.ids for r in out if r.id in (1, 2)] == [None, []]
