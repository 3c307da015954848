import random
import re

import numpy as np
import pyarrow as pa

from millrace.llm import graph, minhash


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    sets = {k: shingles(t) for k, t in rows.items()}
    root = {k: k for k in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(rows)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def _texts(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(rnd.randrange(30, 200))] for _ in range(8)]
    rows = {}
    for key in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(0, 9)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randrange(0, 3)] = [word()]
        rows[key] = rnd.choice([" ", "\n", " \t"]).join(w)
    rows |= {n: None, n + 1: "", n + 2: "  \n", n + 3: "One two", n + 4: "one\nTWO", n + 5: rows[3].upper()}
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        rows = _texts(seed)
        df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
        assert got == brute(rows)


def test_split_groups(spark):
    """Large buckets and neighbourhoods are dealt over tasks, with the same links; no task holds a group."""
    for seed in (1, 2):
        rows = _texts(seed)
        df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, group=10, cell=2000).collect()}
        assert got == brute(rows)


def test_cells_hold_every_pair_across_once(spark):
    rows = [(h, h * 1000 + i, 7 if i < 60 else i, 100) for h in (1, 2) for i in range(100 if h == 1 else 3)]
    out = minhash._celled(spark.createDataFrame(rows, "hood long, rep long, component long, n_shingles long"), 356 * 12).collect()
    cells = {}
    for r in out:
        cells.setdefault(r.cell, []).append(r)
    assert max(map(len, cells.values())) < 60
    pairs = [(a.rep, b.rep) for c in cells.values() for a in c for b in c if a.rep < b.rep and a.component != b.component and (a.side == 0 or a.side != b.side)]
    pairs += [(b, a) for a, b in pairs]
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_all_pairs_up_to_the_symbol_errors_meet():
    """29 different symbols, all of them different in the last two bits too."""
    a = np.random.default_rng(9).integers(0, 2**16, minhash.SIZE).astype(np.uint16)
    b = a.copy()
    wrong = [c * minhash.WIDTH + k for c in range(minhash.CHUNKS) for k in range(3)][: minhash.SYMBOL_ERRORS]
    b[wrong] ^= 1
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], names=["rep", "signature"])
    chunks = pa.Table.from_batches(minhash._chunk_rows([rows])).sort_by("bucket").combine_chunks().to_batches()
    met = [r for x in minhash._members(chunks) for r in x.to_pylist()]
    assert {(r["rep"], r["leader"], r["far"]) for r in met} == {(1, None, None), (2, 1, minhash.SYMBOL_ERRORS)}


def test_odd_sketches_never_rule_out_a_link():
    rnd = np.random.default_rng(4)
    pool = rnd.integers(0, 2**63, 6000).astype(np.uint64)
    sets = [np.unique(pool[: rnd.integers(20, 4000)]) for _ in range(40)]
    sets += [np.setdiff1d(s, rnd.choice(s, len(s) // 9, replace=False)) for s in sets]
    odd = [minhash.odd_sketch(s) for s in sets]
    i, j = np.triu_indices(len(sets), 1)
    d = minhash._differ(odd, i, j)
    for a, b, far in zip(i, j, d, strict=True):
        common = len(np.intersect1d(sets[a], sets[b]))
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            assert far <= len(sets[a]) + len(sets[b]) - 2 * common


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7)]
    out = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert out == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "a b c d e f", 3)], "doc_id long, text string, kept int")
    assert sorted((r.doc_id or 0) for r in minhash.near_dedup(df).collect()) == [0, 1]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_just_above_the_threshold(spark):
    """Pairs of a similarity of 0.75 to 0.82 are all linked."""
    rnd = random.Random(13)
    texts, pairs = {}, 0
    for i in range(0, 400, 2):
        words = [f"w{i}x{j}" for j in range(rnd.randrange(150, 400))]
        n = len(words) - 4
        other = words[:]
        # one changed word changes 5 shingles: similarity (n - 5c) / (n + 5c)
        c = max(x for x in range(1, n) if 100 * (n - 5 * x) >= 75 * (n + 5 * x))
        for p in range(c):
            other[7 * p + 3] = f"new{i}x{p}"
        texts[i], texts[i + 1] = " ".join(words), " ".join(other)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    for i in range(0, 400, 2):
        a, b = ({tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for t in (texts[i], texts[i + 1]))
        s = len(a & b) / len(a | b)
        assert 0.75 <= s < 0.82
        pairs += got[i + 1] == i
    assert pairs == 200
