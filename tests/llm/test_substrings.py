import hashlib
import random

import numpy as np
import pyarrow as pa
import zstandard

from millrace.llm import substrings


def brute(rows):
    n = substrings.LENGTH
    first, out = {}, {}
    for key in sorted(rows):
        b = (rows[key] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if first.setdefault(b[i : i + n], (key, i)) != (key, i):
                gone[i : i + n] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[key] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def _got(spark, rows, **how):
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.substring_dedup(df, **how).collect()}


def _texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randrange(2, 7)))
    passages = [" ".join(word() for _ in range(k)) for k in (16, 18, 25, 60, 200)]
    rows = {}
    for key in range(60):
        parts = []
        for _ in range(rnd.randrange(0, 6)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, 30)
            parts.append(rnd.choice([p, p[a:], p[: len(p) - a], " ".join(word() for _ in range(30))]))
        rows[key] = " ".join(parts)
    rows[60], rows[61], rows[62] = None, "", "ab" * 700
    rows[63], rows[64] = rows[5], "x" * 99
    rows[65] = "x" * 250
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = _texts(seed)
        assert _got(spark, rows) == brute(rows)


def test_hot_anchor(spark):
    rows = _texts(5)
    assert _got(spark, rows, hot=2) == brute(rows)


def test_one_class_of_very_many_rows(monkeypatch):
    """A class in more rows than are held at once: all but its earliest place are copies, wherever that row comes."""
    monkeypatch.setattr(substrings, "_PIECE", 1)
    n = 300
    doc = np.random.default_rng(3).permutation(n)
    cols = [np.full(n, 7, np.uint64), np.full(n, 9, np.uint64), doc, np.full(n, 5 << 8)]
    blobs = [substrings._blobs(np.zeros(4, np.int64), [c[a : a + 4] for c in cols])[1][0] for a in range(0, n, 4)]
    rows = [r for b in substrings._classes([pa.RecordBatch.from_arrays([pa.array([0] * len(blobs)), pa.array(blobs)], names=["bucket", "blob"])]) for r in b.to_pylist()]
    assert [(r["doc"], r["anchor"]) for r in rows if r["kind"] == 1] == [(0, 7)]
    assert sorted(r["doc"] for r in rows if r["kind"] == 0) == list(range(1, n))


def test_hot_copies_do_not_reach_the_merge(monkeypatch):
    """A passage in many surroundings: the merge gets each string once, and all but the earliest go."""
    rnd = random.Random(7)
    noise = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(40))
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(102))
    rows = {key: (noise() + passage + noise()).encode() for key in range(400)}
    keys = list(rows) + [3, 399]  # repeated rows
    rnd.shuffle(keys)
    n = len(rows[0]) - substrings.LENGTH + 1
    places = [{"place": n - 1, "kind": 2, "anchor": 5}]
    schema = pa.schema([("doc", pa.int64()), ("packed", pa.binary()), ("places", pa.list_(pa.struct([("place", pa.int64()), ("kind", pa.int32()), ("anchor", pa.int64())])))])
    batches = [pa.RecordBatch.from_pylist([{"doc": k, "packed": zstandard.compress(rows[k]), "places": places} for k in keys[a : a + 50]], schema) for a in range(0, len(keys), 50)]
    made = sorted((r for b in substrings._bytes_of(batches, 3) for r in b.to_pylist()), key=lambda r: r["bucket"])
    merged, merge = [], substrings.merged_intervals
    monkeypatch.setattr(substrings, "merged_intervals", lambda data, size: merged.append(len(size)) or merge(data, size))
    out = [r for b in substrings._merge([pa.RecordBatch.from_pylist(made)]) for r in b.to_pylist()]
    got = {(r["doc"], (r["place"] >> 8) + i) for r in out for i in range((r["place"] & 255) + 1)}
    strings = [rows[k][i : i + substrings.LENGTH] for k in rows for i in range(n)]
    assert sum(merged) == len(set(strings)) < len(strings)
    first = {}
    assert got == {(k, i) for k in rows for i in range(n) if first.setdefault(rows[k][i : i + substrings.LENGTH], (k, i)) != (k, i)}


def test_merged_transforms():
    """Shards' transforms merged: the intervals hold equal strings, in order, with the right common prefixes."""
    rnd = np.random.default_rng(0)
    data = rnd.integers(97, 99, 4000).astype(np.uint8)
    data[2000:2300] = data[100:400]
    size = np.array([1000, 900, 600, 1500])
    where, block, common = substrings.merged_intervals(data, size, shard=700)
    off = np.concatenate([[0], np.cumsum(size)])
    end = lambda p: off[np.searchsorted(off, p, "right")]
    whole = [(int(b), bytes(data[p : p + 100])) for p, b in zip(where, block, strict=True) if p >= 0 and p + 100 <= end(p)]
    by = {}
    for b, s in whole:
        by.setdefault(b, set()).add(s)
    assert all(len(x) == 1 for x in by.values())
    assert len({s for _, s in whole}) == len(by)
    assert common.min() >= 0 and common.max() <= 4


def test_texts_without_repeats(spark):
    df = spark.createDataFrame([(1, "A" * 10 + "é" * 100, 1), (2, "B" + "é" * 100, 2)], "doc_id long, text string, n_removed int")
    out = {r.doc_id: r.text for r in substrings.dedup_texts(df).collect()}
    assert out[1].startswith("A" * 10) and len(out[2]) < 100


def test_empty(spark):
    assert substrings.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_that_occur_once_are_not_sorted():
    """Only stretches of repeated blocks go through the transforms; all repeated strings are still found."""
    data = np.random.default_rng(1).integers(0, 256, 20_000).astype(np.uint8)
    data[9000:9150] = data[2000:2150]
    where, block, _ = substrings.merged_intervals(data, np.array([5000, 15_000]), shard=700)
    assert 2 * 126 <= len(where) < 500
    by = {}
    for p, b in zip(where[where >= 0].tolist(), block[where >= 0].tolist(), strict=True):
        by.setdefault(b, []).append(p)
    assert sorted(map(sorted, by.values())) == [[p, p + 7000] for p in range(2000, 2051)]


def test_nothing_repeated():
    data = np.random.default_rng(2).integers(0, 256, 900).astype(np.uint8)
    for size in ([900], [20, 880], [9] * 100):
        assert [len(x) for x in substrings.merged_intervals(data, np.array(size))] == [0, 0, 0]


def test_contexts_by_anchor():
    """Anchors of several contexts, wherever these are, and hot ones; an anchor leaves one row a bucket."""
    rng = np.random.default_rng(4)
    n, buckets = 3000, 7
    h = np.append(rng.integers(1, 3000, n), np.full(200, 5000)).astype(np.uint64) << np.uint64(40)
    doc, place = np.arange(n + 200), np.arange(n + 200) << 8
    bucket = rng.integers(0, buckets, n + 200)
    blobs = [(b, substrings._blobs(np.zeros((bucket == b).sum(), np.int64), [x[bucket == b] for x in (h, rng.integers(0, 2**63, n + 200).astype(np.uint64), doc, place)])[1][0]) for b in range(buckets)]
    made = [r for b, x in blobs for out in substrings._anchored([pa.RecordBatch.from_arrays([pa.array([b]), pa.array([x])], names=["bucket", "blob"])], 3) for r in out.to_pylist()]
    dealt = sorted(((r["anchor"], r["blob"]) for r in made if r["kind"] == 2), key=lambda r: r[0])
    rows = substrings._unblob([x for _, x in dealt], substrings._LONES)
    assert (rows[0] == h[-1]).sum() <= buckets
    found = [r for out in substrings._opened([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*dealt, strict=True)], names=["bucket", "blob"])], 100) for r in out.to_pylist()]
    assert [r["anchor"] for r in found if r["kind"] == 2] == [int(h[-1].view(np.int64))]
    got = [(r["doc"], r["place"], r["anchor"]) for r in made + found if r["kind"] == 1]
    values, count = np.unique(h, return_counts=True)
    several = np.isin(h, values[count > 1])
    assert sorted(got) == list(zip(*(x[several].tolist() for x in (doc, place, h.view(np.int64))), strict=True))


def test_hashes_that_share_their_high_bits():
    x = np.array([5, 9, 5, 1 << 60, 9, 5, (1 << 60) + 1, 1 << 60], np.uint64)
    assert substrings._order(x).tolist() == np.argsort(x, kind="stable").tolist()
    h, c = np.array([2, 1, 2, 1], np.uint64), np.full(4, 7, np.uint64)  # one context hash, two anchors
    *_, doc, _, same = substrings._first_of(h, c, np.array([4, 3, 2, 1]), np.zeros(4, np.int64))
    assert (doc.tolist(), same.tolist()) == ([1, 3, 2, 4], [False, True, False, True])


def test_small_batches_share_a_blob():
    """Rows to the merge grow with the contexts, not with the batches times the buckets."""
    schema = pa.schema([("doc", pa.int64()), ("packed", pa.binary()), ("places", pa.list_(pa.struct([("place", pa.int64()), ("kind", pa.int32()), ("anchor", pa.int64())])))])
    text = zstandard.compress(random.Random(1).randbytes(300))
    batches = [pa.RecordBatch.from_pylist([{"doc": k, "packed": text, "places": [{"place": i << 8, "kind": 1, "anchor": i} for i in range(50)]}], schema) for k in range(40)]
    assert sum(b.num_rows for b in substrings._bytes_of(batches, 3)) == 3


def test_texts_are_dealt_out_once(spark):
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = substrings.substring_dedup(spark.createDataFrame(list(_texts(1).items()), "doc_id long, text string"))
        assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)


def test_rows_without_a_key(spark):
    df = spark.createDataFrame([(None, "a" * 300), (1, "b" * 150), (None, "b" * 150), (2, "b" * 150)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substrings.substring_dedup(df).collect()) == [(0, 150, 0), (0, 300, 0), (1, 150, 149), (2, 150, 150)]
