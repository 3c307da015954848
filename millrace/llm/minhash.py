"""MinHash near-dedup: multi-index Hamming join of b-bit signatures, links confirmed on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec
from ._work import without, written
from .graph import components

SHINGLE = 5
#: A signature has CHUNKS chunks of WIDTH symbols of 16 bits. Pairs with at most SYMBOL_ERRORS different symbols are
#: all found: by the pigeonhole one chunk has CHUNK_ERRORS at most, and all choices of them are enumerated. At a
#: similarity of exactly 0.75 more errors than that have a chance of 3 in 100,000, and less for closer texts.
CHUNKS, WIDTH, CHUNK_ERRORS = 10, 6, 2
SYMBOL_ERRORS = CHUNKS * (CHUNK_ERRORS + 1) - 1
#: Of the symbols' last two bits at most so many may differ: no more than of whole symbols, so that none of these pairs is lost.
SKETCH_ERRORS = SYMBOL_ERRORS
SIZE = CHUNKS * WIDTH
_rng = np.random.default_rng(60)
_A = _rng.integers(1, 2**31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, SIZE, dtype=np.uint32)
_U = np.uint64
#: Which two of a chunk's other four symbols are equal.
_COMBOS = [(i, j) for i in range(4) for j in range(i)]
#: Runs of members up to this long are compared all with all at once.
_BLOCK = 512
#: Rows of a bucket from which on its neighbourhoods are made by Spark, and bytes from which on a neighbourhood's
#: members are compared in several cells.
GROUP = 200_000
CELL = 4 << 20


def word_shingles(buf: np.ndarray, off: np.ndarray):
    """Shingle hashes of lower-cased (A-Z) texts, where each text's begin, and its number of words."""
    low = _vec.LOWER[buf]
    start, end, first = _vec.words(low, off, _vec.SPACES)
    return _vec.shingles(_vec.Ranges(low)(start, end), first, SHINGLE)


def _distinct(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, and where they begin."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(begin)))


def _signatures(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of SIZE symbols for each text with shingles."""
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, SIZE), np.uint16)
    if len(full):
        x = (h >> _U(32)).astype(np.uint32)
        at = begin[:-1][full]
        for k in range(SIZE):
            low = np.minimum.reduceat(x * _A[k] + _B[k], at)
            out[full, k] = ((low * np.uint32(0x85EBCA6B)) ^ (low >> np.uint32(15))) & np.uint32(0xFFFF)
    return out


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_shingles, set_a, set_b, signature binary): one row a text, one pass, no shuffle. Equal sets have equal set_a, set_b."""

    def read(batches):
        for batch in batches:
            n, a, b, sig = [], [], [], []
            for _, _, buf, off in _vec.pieces(batch.column(1)):
                h, begin, _ = word_shingles(buf, off)
                h, begin = _distinct(h, begin)
                sums = np.zeros((2, len(h) + 1), _U)
                np.cumsum(h, out=sums[0, 1:])
                np.cumsum(_vec.mix(h ^ _U(0x5BD1E995)), out=sums[1, 1:])
                n.append(np.diff(begin))
                a.append(sums[0, begin[1:]] - sums[0, begin[:-1]])
                b.append(sums[1, begin[1:]] - sums[1, begin[:-1]])
                sig.append(_signatures(h, begin))
            if n:
                flat = np.concatenate(sig)
                rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SIZE * 2), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())
                cols = [batch.column(0), pa.array(np.concatenate(n)), pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64)), rows]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "n_shingles", "set_a", "set_b", "signature"])

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(read, "key long, n_shingles long, set_a long, set_b long, signature binary")


def _chunk_rows(batches):
    """For each signature and each third of each chunk a row: bucket of the third's two symbols, the other four, the sketch."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SIZE).astype(_U)
        low = sig & _U(3)
        shift = _U(2) * np.arange(SIZE // 2, dtype=_U)
        sketch = [(low[:, p : p + SIZE // 2] << shift).sum(axis=1, dtype=_U).view(np.int64) for p in (0, SIZE // 2)]
        for c in range(CHUNKS):
            s = sig[:, c * WIDTH : (c + 1) * WIDTH]
            for t in range(WIDTH // 2):
                two, four = s[:, 2 * t : 2 * t + 2], np.delete(s, [2 * t, 2 * t + 1], axis=1)
                bucket = _vec.mix((two[:, 0] << _U(16) | two[:, 1]) + _U((c * 8 + t) << 32))
                rest = four[:, 0] | four[:, 1] << _U(16) | four[:, 2] << _U(32) | four[:, 3] << _U(48)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), batch.column(0), pa.array(rest.view(np.int64)), pa.array(sketch[0]), pa.array(sketch[1])],
                    names=["bucket", "rep", "rest", "s0", "s1"],
                )


_MASK = _U(0x5555555555555555)


def _far(a0, a1, b0, b1) -> np.ndarray:
    """Number of different two-bit symbols."""
    x, y = a0 ^ b0, a1 ^ b1
    return np.bitwise_count((x | x >> _U(1)) & _MASK) + np.bitwise_count((y | y >> _U(1)) & _MASK)


def _groups(batches, name: str, rows: int):
    """Tables of whole groups of a sorted column, about so many rows at a time, and whether it is a part of a larger group."""
    held: list[pa.RecordBatch] = []
    count, large = 0, None
    for batch in batches:
        if large is not None and batch.num_rows:
            more = batch.column(name).to_numpy() != large
            cut = int(more.argmax()) if more.any() else len(more)
            if cut:
                yield pa.Table.from_batches([batch.slice(0, cut)]), True
            batch, large = batch.slice(cut), None if cut < len(more) else large
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        col = whole.column(name).chunk(0).to_numpy()
        if col[0] == col[-1]:  # one group so far
            yield whole, True
            held, count, large = [], 0, col[0]
            continue
        cut = len(col) - int(np.argmax((col != col[-1])[::-1]))
        yield whole.slice(0, cut), False
        held = whole.slice(cut).to_batches()
        count = len(whole) - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks(), False


def _column(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name)
    return (c.chunk(0) if c.num_chunks else c.combine_chunks()).to_numpy(zero_copy_only=False)


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs of equal keys that have two members or more."""
    edge = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]]))
    size = np.diff(edge)
    return edge[:-1][size > 1], size[size > 1]


_MEMBERS = "hood long, rep long, s0 long, s1 long, leader long, far long"


def _combo_keys(bucket: np.ndarray, four: list[np.ndarray], c: int) -> np.ndarray:
    """A bucket's neighbourhoods of the choice c of two more equal symbols."""
    i, j = _COMBOS[c]
    return _vec.mix(bucket + _vec.mix((four[i] << _U(16) | four[j]) + _U((c + 1) << 40)))


def _hoods(batches):
    """A row for each neighbourhood of the rows of large buckets, which have the bucket as hood."""
    for batch in batches:
        bucket, rest = (_column(pa.Table.from_batches([batch]), n).view(_U) for n in ("hood", "rest"))
        four = [rest >> _U(16 * i) & _U(0xFFFF) for i in range(4)]
        for c in range(len(_COMBOS)):
            yield pa.RecordBatch.from_arrays([pa.array(_combo_keys(bucket, four, c).view(np.int64)), *(batch.column(n) for n in ("rep", "s0", "s1"))], names=["hood", "rep", "s0", "s1"])


def _large_members(parts: DataFrame) -> DataFrame:
    """What _members makes, for the parts of large buckets: neighbourhoods are kept whole, their least member leads."""
    rows = parts.select("hood", "rep", "rest", "s0", "s1").mapInArrow(_hoods, "hood long, rep long, s0 long, s1 long")
    least = rows.groupBy("hood").agg(F.min(F.struct("rep", "s0", "s1")).alias("l"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    x = [F.col(s).bitwiseXOR(F.col(f"l.{s}")) for s in ("s0", "s1")]
    far = sum((F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(int(_MASK)))) for v in x), F.lit(0)).cast("long")
    led = (F.col("rep") != F.col("l.rep")) & (far <= SKETCH_ERRORS)
    return rows.join(least, "hood").select("hood", "rep", "s0", "s1", F.when(led, F.col("l.rep")).alias("leader"), F.when(led, far).alias("far"))


def _members(batches, group: int = GROUP):
    """Members of the chunk-error neighbourhoods that have a near partner, and for each the neighbourhood's least near member.

    Rows of a bucket of more than group rows are passed on as they come, with rest, for _large_members.
    """
    for t, part in _groups(batches, "bucket", group):
        if part:
            none = pa.nulls(len(t), pa.int64())
            raw = pa.Table.from_arrays([t.column("bucket"), t.column("rep"), t.column("s0"), t.column("s1"), none, none, t.column("rest")], names=["hood", "rep", "s0", "s1", "leader", "far", "rest"])
            yield from raw.to_batches()
            continue
        bucket, rep = _column(t, "bucket").view(_U), _column(t, "rep")
        rest, s0, s1 = (_column(t, n).view(_U) for n in ("rest", "s0", "s1"))
        begin, size = _runs(bucket)
        if not len(begin):
            continue
        take = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        bucket, rep, rest, s0, s1 = bucket[take], rep[take], rest[take], s0[take], s1[take]
        four = [rest >> _U(16 * i) & _U(0xFFFF) for i in range(4)]
        for c in range(len(_COMBOS)):
            keys = _combo_keys(bucket, four, c)
            order = np.lexsort((rep, keys))
            k, r, a, b = keys[order], rep[order], s0[order], s1[order]
            begin, size = _runs(k)
            if not len(begin):
                continue
            keep, lead, far = np.zeros(len(k), bool), np.full(len(k), -1, np.int64), np.zeros(len(k), np.int64)
            two = begin[size == 2]
            d = _far(a[two], b[two], a[two + 1], b[two + 1])
            near = two[d <= SKETCH_ERRORS]
            keep[near] = keep[near + 1] = True
            lead[near + 1], far[near + 1] = near, d[d <= SKETCH_ERRORS]
            for p, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                q = p + n
                if n <= _BLOCK:
                    d = _far(a[p:q, None], b[p:q, None], a[None, p:q], b[None, p:q]).astype(np.int64)
                    ok = d <= SKETCH_ERRORS
                    np.fill_diagonal(ok, False)
                    keep[p:q] = ok.any(axis=1)
                    first = ok.argmax(axis=1)
                else:  # a large one is kept whole
                    keep[p:q] = True
                    d = _far(a[p:q], b[p:q], a[p], b[p]).astype(np.int64)[:, None]
                    ok = d <= SKETCH_ERRORS
                    first = np.zeros(n, np.int64)
                at = np.arange(n)
                led = ok[at, first] & (first < at)
                lead[p:q][led], far[p:q][led] = p + first[led], d[at, first][led]
            x = np.flatnonzero(keep)
            has = lead[x] < 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[x].view(np.int64)), pa.array(r[x]), pa.array(a[x].view(np.int64)), pa.array(b[x].view(np.int64)), pa.array(r[lead[x]], mask=has), pa.array(far[x], mask=has), pa.nulls(len(x), pa.int64())],
                names=["hood", "rep", "s0", "s1", "leader", "far", "rest"],
            )


def odd_sketch(h: np.ndarray) -> bytes:
    """Parities of how many of a set's hashes fall on each bit; four bits an element at least, a power of two.

    The bits in which two sketches differ are never more than the elements in which the sets do. One of twice the
    length folds into the shorter by xor of its halves.
    """
    size = max(512, 1 << (4 * len(h) - 1).bit_length()) if len(h) else 512
    at = (_vec.mix(h ^ _U(0xC2B2AE3D27D4EB4F)) & _U(size - 1)).astype(np.int64)
    bits = (np.bincount(at, minlength=size) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").tobytes()


def _differ(odd: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the sketches of pairs differ; those over twice as long as the other count as all different."""
    have, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = where[: len(i)], where[len(i) :]
    odd = [odd[x] for x in have]
    size = np.array([len(x) for x in odd])
    out = np.full(len(i), 1 << 60)
    for at in np.unique(size):
        own = np.flatnonzero(size == at)
        place = np.zeros(len(odd), np.int64)
        place[own] = np.arange(len(own))
        table = np.frombuffer(b"".join([odd[x] for x in own]), _U).reshape(len(own), -1)
        half = table.shape[1] // 2
        step = max(1, (4 << 20) // int(at))
        for other, left, right in ((at, i, j), (at * 2, i, j), (at * 2, j, i)):
            pairs = np.flatnonzero((size[left] == at) & (size[right] == other))
            for p in range(0, len(pairs), step):
                x = pairs[p : p + step]
                a = table[place[left[x]]]
                if other == at:
                    b = table[place[right[x]]]
                else:
                    b = np.frombuffer(b"".join([odd[r] for r in right[x]]), _U).reshape(len(x), -1)
                    b = b[:, : 2 * half] ^ b[:, 2 * half :]
                out[x] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def _first_hood(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first neighbourhood that pairs of signatures share, in the order _chunk_rows and _members make them."""
    n = len(a)
    same = (a == b).reshape(n, CHUNKS, WIDTH)
    c = (same.sum(axis=2) >= WIDTH - CHUNK_ERRORS).argmax(axis=1)
    same, own = same[np.arange(n), c], a.reshape(n, CHUNKS, WIDTH)[np.arange(n), c].astype(_U)
    out = np.zeros(n, _U)
    for t in range(WIDTH // 2):
        rest = [k for k in range(WIDTH) if k not in (2 * t, 2 * t + 1)]
        pair = same[:, 2 * t] & same[:, 2 * t + 1]
        for m, (i, j) in enumerate(_COMBOS):
            x = np.flatnonzero(pair & (out == 0) & same[:, rest[i]] & same[:, rest[j]])
            bucket = _vec.mix((own[x, 2 * t] << _U(16) | own[x, 2 * t + 1]) + ((c[x] * 8 + t).astype(_U) << _U(32)))
            out[x] = _vec.mix(bucket + _vec.mix((own[x, rest[i]] << _U(16) | own[x, rest[j]]) + _U((m + 1) << 40)))
    return out


def _next(new: np.ndarray) -> np.ndarray:
    """For each place, where the run that begins at marked places ends."""
    begins = np.flatnonzero(new)
    return np.append(begins[1:], len(new))[np.cumsum(new) - 1]


def _celled(members: DataFrame, limit: int) -> DataFrame:
    """members with (cell, side): those of a neighbourhood meet in one cell of side 0, or above limit bytes in several.

    There the largest component and the others go into blocks, dealt out by rep. A cell has two blocks, as sides 1
    and 2, or one block of the others, as side 0; the largest component's blocks only meet the others'.
    """
    parts = members.groupBy("hood", "component").agg(F.sum(F.col("n_shingles") + 256).alias("w"))
    large = parts.groupBy("hood").agg(F.sum("w").alias("all"), F.max(F.struct("w", "component")).alias("top")).filter(F.col("all") > limit)
    blocks = lambda w: F.greatest(F.lit(1), F.ceil(w / limit)).cast("int")
    large = large.select("hood", F.col("top.component").alias("top"), blocks(F.col("top.w")).alias("n_top"), blocks(F.col("all") - F.col("top.w")).alias("n_rest"))
    is_top = F.col("component") == F.col("top")
    own = F.pmod(F.xxhash64("rep"), F.when(is_top, F.col("n_top")).otherwise(F.col("n_rest"))).cast("int")
    of = lambda kind, i, j, side: F.struct(F.xxhash64("hood", F.lit(kind), i, j).alias("cell"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    side = lambda k: F.when(own == k, 0).when(own < k, 1).otherwise(2)
    tops = F.transform(upto("n_rest"), lambda k: of("top", own, k, F.lit(1)))
    with_top = F.transform(upto("n_top"), lambda k: of("top", k, own, F.lit(2)))
    others = F.transform(upto("n_rest"), lambda k: of("rest", F.least(own, k), F.greatest(own, k), side(k)))
    alone = F.array(F.struct(F.col("hood").alias("cell"), F.lit(0).alias("side")))
    cells = F.when(F.col("top").isNull(), alone).when(is_top, tops).otherwise(F.concat(with_top, others))
    return members.join(large, "hood", "left").withColumn("c", F.explode(cells)).select(*members.columns, "c.cell", "c.side")


def _cells(batches):
    """Tables of whole cells."""
    held = []
    for t, part in _groups(batches, "cell", 50_000):
        if part:  # cells are bounded; this one has many small members
            held.append(t)
            continue
        yield pa.concat_tables([*held, t]).combine_chunks()
        held = []
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _across(batches, num: int, den: int):
    """Pairs whose components differ and which sizes, signatures and odd sketches allow, each in its first neighbourhood."""
    for t in _cells(batches):
        cell, rep, comp = (_column(t, n) for n in ("cell", "rep", "component"))
        order = np.lexsort((rep, comp, cell))
        t = t.take(pa.array(order))
        hood, cell, side, rep, comp, size = (_column(t, n) for n in ("hood", "cell", "side", "rep", "component", "n_shingles"))
        hood, s0, s1 = hood.view(_U), _column(t, "s0").view(_U), _column(t, "s1").view(_U)
        odd = t.column("odd").to_pylist()
        sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint16).reshape(-1, SIZE)
        new = np.ones(len(cell), bool)
        new[1:] = cell[1:] != cell[:-1]
        part = new.copy()
        part[1:] |= comp[1:] != comp[:-1]
        after, end = _next(part), _next(new)  # members of later components of one cell
        upto = np.cumsum(end - after)
        us, vs = [], []
        at = 0
        while at < len(hood):  # rows whose pairs are looked at at once
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 200_000, "right")))
            count = (end - after)[at:stop]
            i = np.repeat(np.arange(at, stop), count)
            j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(after[at:stop], count)
            at = stop
            ok = (side[i] == 0) | (side[i] != side[j])
            i, j = i[ok], j[ok]
            ok = _far(s0[i], s1[i], s0[j], s1[j]) <= SKETCH_ERRORS
            ok &= (den * size[j] >= num * size[i]) & (num * size[j] <= den * size[i])
            i, j = i[ok], j[ok]
            ok = _first_hood(sig[i], sig[j]) == hood[i]
            i, j = i[ok], j[ok]
            if len(i):
                ok = _differ(odd, i, j) * (den + num) <= (size[i] + size[j]) * (den - num)
                us.append(rep[i[ok]])
                vs.append(rep[j[ok]])
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])


def _pack(batches):
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for first, last, buf, off in _vec.pieces(batch.column(1)):
            h, begin, _ = word_shingles(buf, off)
            h, begin = _distinct(h, begin)
            odd = [odd_sketch(h[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            view = memoryview(buf)
            packed = [z.compress(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(packed, pa.binary()), pa.array(np.diff(begin), pa.int64()), pa.array(odd, pa.binary())], names=["rep", "packed", "n_shingles", "odd"])


def _shingle_set(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    h, _, _ = word_shingles(raw, np.array([0, len(raw)]))
    return np.unique(h)


def _confirm(batches, num: int, den: int):
    last, have = None, None
    for batch in batches:
        v, x, y = (batch.column(i) for i in (1, 2, 3))
        ok = np.zeros(len(v), bool)
        for i in range(len(v)):
            if v[i].as_py() != last:
                last, have = v[i].as_py(), _shingle_set(y[i].as_py())
            mine = _shingle_set(x[i].as_py())
            common = len(np.intersect1d(mine, have, assume_unique=True))
            ok[i] = den * common >= num * (len(mine) + len(have) - common)
        mask = pa.array(ok)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])


def _confirmed(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    both = pairs.join(texts.select(F.col("rep").alias("u"), F.col("packed").alias("x")), "u")
    both = both.join(texts.select(F.col("rep").alias("v"), F.col("packed").alias("y")), "v").select("u", "v", "x", "y")
    return written(both.mapInArrow(lambda b: _confirm(b, num, den), "u long, v long"), "links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = 75, den: int = 100, group: int = GROUP, cell: int = CELL) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row: components of documents linked at a Jaccard of num/den or more.

    Words are runs of anything but space and U+0009 to U+000D, A-Z lower-cased; a set has the distinct SHINGLE-word
    shingles, or the whole sequence if there are fewer words. Null and word-less texts have no set and no link.
    component_id is the least key that can be reached, kept says whether it is the row's own.

    1. A signature for every text, one pass. Texts with equal sets become one class, so copies cost nothing below.
    2. Classes meet in neighbourhoods of equal chunks but for the allowed errors (see CHUNKS); sketches sort out the
       far ones there, before any pair is made.
    3. Each class is linked with its nearest leader over its neighbourhoods: at most one pair a class, which joins
       most of every group however large. Pairs are confirmed on full sets.
    4. Near pairs that are still in different components are compared by odd sketches (see odd_sketch), which rule out
       most pairs just below the threshold and none above it; the rest are confirmed on full sets too.
    A bucket of more than group rows and a neighbourhood of more than cell bytes are split over tasks.
    Keys are whole numbers and unique; rows with a null key keep a null component and stay.
    """
    named = docs.filter(F.col(key).isNotNull())
    rows = written(sketches(named, key, text), "sketches")
    classes = rows.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("key").alias("rep"), F.min("signature").alias("signature"))
    classes = written(classes, "classes")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = classes.select("rep", "signature").mapInArrow(_chunk_rows, "bucket long, rep long, rest long, s0 long, s1 long")
    chunks = chunks.repartition(n, "bucket").sortWithinPartitions("bucket")
    met = written(chunks.mapInArrow(lambda b: _members(b, group), _MEMBERS + ", rest long"), "members")
    members, large = met.filter("rest is null").drop("rest"), met.filter("rest is not null")
    if not large.isEmpty():
        members = written(members.unionByName(_large_members(large)), "large_members")
    wanted = members.select("rep").distinct()
    texts = named.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("t")).join(wanted, "rep", "left_semi")
    texts = written(texts.mapInArrow(_pack, "rep long, packed binary, n_shingles long, odd binary"), "texts")
    best = members.filter("leader is not null").groupBy("rep").agg(F.min(F.struct("far", "leader")).alias("b"))
    links = _confirmed(best.select(F.col("rep").alias("u"), F.col("b.leader").alias("v")), texts, num, den)
    comps = written(components(links), "components")
    placed = members.select("hood", "rep", "s0", "s1").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # only neighbourhoods of more than one component go on, with the members' odd sketches
    mixed = placed.groupBy("hood").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("hood")
    sets = texts.select("rep", "n_shingles", "odd").join(classes.select("rep", "signature"), "rep")
    open_ = placed.join(mixed, "hood", "left_semi").join(sets, "rep")
    open_ = _celled(open_.select("hood", "rep", "s0", "s1", "component", "n_shingles", "odd", "signature"), cell)
    open_ = open_.repartition(n, "cell").sortWithinPartitions("cell")
    pairs = open_.mapInArrow(lambda b: _across(b, num, den), "u long, v long")
    more = _confirmed(pairs, texts, num, den)
    comps = components(links.unionByName(more))
    classes = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = rows.select("key", "n_shingles", "set_a", "set_b").join(classes, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("key"))
    out = out.select(F.col("key").alias(key), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(key) == F.col("component_id"))
    bare = docs.filter(F.col(key).isNull())
    return out.unionByName(bare.select(F.col(key).cast("long").alias(key), F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each component: that of the least key. Rows with a null key stay."""
    out = without(docs, "__k")
    gone = near_duplicates(docs, key, text, **how).filter(~F.col("kept")).select(F.col(key).alias("__k"))
    return out.join(gone, out[key] == gone["__k"], "left_anti")
