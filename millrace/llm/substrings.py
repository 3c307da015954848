"""Exact substring dedup: bytes of repeated LENGTH-byte strings, by merging Burrows-Wheeler transforms of shards.

Strings meet by an anchor: of a string's GRAM-byte grams the one of least hash, which equal strings share wherever
they stand. Consecutive starts with one anchor form a context, the bytes from the first start to the last string's
end. Equal contexts form a class by their hash, and one of each goes on. Where an anchor has different contexts, their
bytes are gathered:
each batch is a shard with a Burrows-Wheeler transform of its own, over blocks of BLOCK bytes as symbols (a context is
read in all BLOCK phases). The shards' transforms are merged by iterative interleave refinement: every iteration deals
the interleave out stably by the preceding symbol, so after h of them it is ordered by h symbols, and a boundary that
shows first in iteration h is a common prefix of h-1. No suffix is sorted again. After LENGTH / BLOCK iterations the
intervals between boundaries are the repeated strings.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec
from ._work import without, written

LENGTH = 100
GRAM = 28
BLOCK = 25
#: Suffixes of a shard; contexts of a bucket that are put in classes, and bytes of one that are merged, on average.
SHARD = 1 << 16
BUCKET = 150_000
MERGED = 1 << 19
#: Contexts of one anchor from which on each string is dealt out by its own hash.
HOT = 20_000
#: Bytes of text packed at once, and looked at at once, which stay near the core; positions in these fit 24 bits. Rows
#: are passed on after _RUN bytes, anchors of single contexts after _LONE.
_PIECE = 1 << 20
_NEAR = 1 << 18
_LONE = 1 << 20
_RUN = 8 << 20
#: Bytes of texts for each task of the shuffles by bucket, at most: the tasks grow with the input.
_PART = 64 << 20
_LONG = 1 << 22
_U = np.uint64
_LOW = _U((1 << 24) - 1)


def _anchors(buf: np.ndarray, off: np.ndarray):
    """Contexts of the texts in buf: anchor hash, context hash, text number, first start in the text, number of starts."""
    width = LENGTH - GRAM + 1
    n = len(buf)
    if n < LENGTH:
        return None
    ranges = _vec.Ranges(buf)
    gram = ranges.every(GRAM)
    least = (gram & ~_LOW) | np.arange(len(gram), dtype=_U)
    span = 1
    while span < width:  # sliding minimum by doubling; on ties the leftmost
        step = min(span, width - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    # least[p] is of the grams of the string at p, and tells which
    size = np.diff(off)
    starts = np.maximum(size - LENGTH + 1, 0)
    inside = np.repeat(np.tile([True, False], len(size)), np.column_stack([starts, size - starts]).ravel())[: len(least)]
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    new[off[:-1][size >= LENGTH]] = True
    first = np.flatnonzero(new)
    if not len(first):
        return None
    last = inside.copy()
    last[:-1] &= new[1:] | ~inside[1:]
    end = np.flatnonzero(last) + 1
    text = np.searchsorted(off, first, "right") - 1
    a = (least[first] & _LOW).astype(np.int64)
    h = gram[a]
    c = _vec.mix(ranges(first, end - 1 + LENGTH) ^ ((a - first).astype(_U) << _U(8)) ^ (end - first).astype(_U))
    return np.where(h == 0, _U(1), h), c, text, first - off[text], end - first


def _cuts(array: pa.Array):
    """Pieces of texts; a long text comes in parts that overlap by LENGTH - 1 bytes. (first row, bytes, offsets, shift)."""
    for a, _, buf, off in _vec.pieces(array, _NEAR):
        if len(buf) <= _LONG:
            yield a, buf, off, 0
        else:  # one text alone
            for s in range(0, len(buf) - LENGTH + 1, _LONG):
                part = buf[s : s + _LONG + LENGTH - 1]
                yield a, part, np.array([0, len(part)]), s


def _stable(numbers: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 on: each is sorted as one number with its place, which is several times faster."""
    bits = len(numbers).bit_length()
    if len(numbers) and int(numbers.max()).bit_length() + bits > 63:
        return np.argsort(numbers, kind="stable")
    return np.sort(numbers << bits | np.arange(len(numbers))) & ((1 << bits) - 1)


def _order(hashes: np.ndarray) -> np.ndarray:
    """Stable order of hashes: their high bits are sorted with the place, unless different hashes share them."""
    low = _U((1 << len(hashes).bit_length()) - 1)
    order = (np.sort((hashes & ~low) | np.arange(len(hashes), dtype=_U)) & low).astype(np.int64)
    by = hashes.take(order)
    apart = by[1:] ^ by[:-1]
    return np.argsort(hashes, kind="stable") if ((apart > 0) & (apart <= low)).any() else order


def _blobs(part: np.ndarray, cols: list[np.ndarray]):
    """Rows (bucket, packed columns), one for each bucket."""
    order = _stable(part)
    part = part[order]
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    cols = [c[order] for c in cols]
    z = zstandard.ZstdCompressor(level=1)
    return part[edge[:-1]], [z.compress(b"".join(c[p:q].tobytes() for c in cols)) for p, q in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _unblob(blobs: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    size = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    z = zstandard.ZstdDecompressor()
    for b in blobs:
        raw = z.decompress(b)
        n, at = len(raw) // size, 0
        for i, k in enumerate(kinds):
            out[i].append(np.frombuffer(raw, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(x) for x in out]


def _by_bucket(batches):
    """Sorted (bucket, blob) rows as (blobs, whether the bucket ends with them), about _PIECE bytes of blobs at most."""
    last, held, size = None, [], 0
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and (b != last or size >= _PIECE):
                yield held, b != last
                held, size = [], 0
            last = b
            held.append(blob.as_py())
            size += len(held[-1])
    if held:
        yield held, True


_KEYS = [np.uint64, np.uint64, np.int64, np.int64]


def _first_of(h, c, doc, place):
    """Classes of equal (h, c) one after the other, each by (doc, place), without repeated rows; in it which rows don't open a class."""
    order = _order(c)
    if ((c[order][1:] == c[order][:-1]) & (h[order][1:] != h[order][:-1])).any():
        order = np.lexsort((h, c))
    h, c, doc, place = h[order], c[order], doc[order], place[order]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    many = np.flatnonzero(same | np.append(same, False)[1:])
    order = many[np.lexsort((place[many], doc[many], np.cumsum(~same[many])))]
    doc[many], place[many] = doc[order], place[order]
    again = same.copy()
    again[1:] &= (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
    keep = ~again
    return h[keep], c[keep], doc[keep], place[keep], same[keep]


def _keep_freed() -> None:
    """Freeing a large array once lets glibc keep what smaller ones leave, instead of asking for pages again and again."""
    np.empty((32 << 20) - (1 << 16), np.uint8)


def _find(batches, buckets: int):
    """Rows (bucket, blob of anchor, context, text, start << 8 | starts - 1); anchor 0 marks a context known to be a copy."""
    _keep_freed()
    for docs, got in _runs(batches):
        h, c = (np.concatenate([x[i] for x, _, _ in got]) for i in (0, 1))
        doc = np.concatenate([docs[a + x[2]] for x, a, _ in got])
        place = np.concatenate([(x[3] + s) << 8 | (x[4] - 1) for x, _, s in got])
        h, c, doc, place, same = _first_of(h, c, doc, place)
        part = (_vec.mix(np.where(same, doc.astype(_U), h ^ _vec.mix(c))) % _U(buckets)).astype(np.int64)
        h, c = np.where(same, _U(0), h), np.where(same, _U(0), c)
        rows, blobs = _blobs(part, [h, c, doc, place])
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _runs(batches):
    """The contexts of about _RUN bytes of texts, and the batch's keys."""
    for batch in batches:
        docs = batch.column(0).to_numpy(zero_copy_only=False)
        got, size = [], 0
        for a, buf, off, s in _cuts(batch.column(1)):
            x = _anchors(buf, off)
            if x is not None:
                got.append((x, a, s))
            size += len(buf)
            if size >= _RUN and got:
                yield docs, got
                got, size = [], 0
        if got:
            yield docs, got


def _classes(batches):
    """Contexts that are copies of an earlier one (kind 0), and the earliest of each class (1). A task holds only these."""
    firsts = [np.zeros(0, k) for k in _KEYS]
    for held, done in _by_bucket(batches):
        h, c, doc, place = (np.concatenate(x) for x in zip(firsts, _unblob(held, _KEYS), strict=True))
        known = h == 0
        old_doc, old_place = doc[known], place[known]
        *cols, same = _first_of(h[~known], c[~known], doc[~known], place[~known])
        firsts = [x[~same] for x in cols]
        yield _kinds(np.concatenate([old_doc, cols[2][same]]), np.concatenate([old_place, cols[3][same]]), 0)
        if done:
            yield _kinds(firsts[2], firsts[3], 1, firsts[0])
            firsts = [x[:0] for x in firsts]


def _kinds(doc, place, kind: int, anchor=None) -> pa.RecordBatch:
    anchor = np.zeros(len(doc), np.int64) if anchor is None else anchor.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place), pa.array(np.full(len(doc), kind, np.int32)), pa.array(anchor)], names=["doc", "place", "kind", "anchor"])


_LONES = [np.uint64, np.int64, np.int64]


def _by_anchor(h, doc, place):
    """By anchor, and how many rows each anchor has."""
    order = _order(h)
    h, doc, place = h[order], doc[order], place[order]
    return h, doc, place, np.diff(np.flatnonzero(np.append(h[1:] != h[:-1], True)[: len(h)]), prepend=-1)


def _anchored(batches, buckets: int):
    """Copies (kind 0), contexts that are known to be open, as the bucket has others of their anchor (1), and blobs (2).

    The blobs are dealt out by anchor: contexts that are alone in their bucket, and for n that aren't one row with the
    place -n. So an anchor, however many contexts it has, has a row for each bucket at most.
    """
    lone, size = [], 0

    def blobs():
        h, doc, place = (np.concatenate(x) for x in zip(*lone, strict=True))
        rows, packed = _blobs((h % _U(buckets)).astype(np.int64), [h, doc, place])
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(rows), 2, np.int32)), pa.array(rows), pa.array(packed, pa.binary())], names=names)

    names = ["doc", "place", "kind", "anchor", "blob"]
    whole = lambda x: pa.RecordBatch.from_arrays([*x.columns, pa.nulls(len(x), pa.binary())], names=names)
    for batch in _classes(batches):
        if not len(batch) or batch.column(2)[0].as_py() == 0:
            yield whole(batch)
            continue
        doc, place, _, anchor = (x.to_numpy() for x in batch.columns)
        h, doc, place, count = _by_anchor(anchor.view(_U), doc, place)
        several = np.repeat(count > 1, count)
        yield whole(_kinds(doc[several], place[several], 1, h[several]))
        opens = np.cumsum(count) - count
        lone.append((h[opens], np.where(count > 1, 0, doc[opens]), np.where(count > 1, -count, place[opens])))
        size += len(opens)
        if size >= _LONE:
            yield blobs()
            lone, size = [], 0
    if size:
        yield blobs()


def _opened(batches, hot: int):
    """Contexts whose anchor has others elsewhere (kind 1), and anchors of more than hot contexts (2, without a place)."""
    held: list[bytes] = []
    for blobs, done in _by_bucket(batches):
        held += blobs
        if not done:
            continue
        h, doc, place, count = _by_anchor(*_unblob(held, _LONES))
        held = []
        n = np.where(place < 0, -place, 1)
        opens = np.cumsum(count) - count
        several = np.add.reduceat(n, opens)
        take = np.repeat(several > 1, count) & (place >= 0)
        yield _kinds(doc[take], place[take], 1, h[take])
        much = h[opens][several > hot]
        yield _kinds(np.zeros(len(much), np.int64), np.zeros(len(much), np.int64), 2, much)


def _pack(batches):
    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for a, b, buf, off in _vec.pieces(batch.column(1), _PIECE):
            view = memoryview(buf)
            packed = [z.compress(view[p:q]) for p, q in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())], names=["doc", "packed"])


def _texts(batches, named: bool = False):
    """(key, text, places) of rows (key, packed text, places), few at a time; None where a run of about _RUN bytes ends.

    named: only of the rows that have places.
    """
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        size = 0
        for a, b, _, _ in _vec.pieces(batch.column(1), _PIECE):
            for key, packed, places in zip(*(batch.column(i).slice(a, b - a) for i in range(3)), strict=True):
                if named and not places.is_valid:
                    continue
                raw = z.decompress(packed.as_py())
                yield key.as_py(), raw, places.values if places.is_valid else None
                size += len(raw)
            if size >= _RUN:
                yield None
                size = 0
        yield None


def _note(best: dict[bytes, tuple[int, int]], copies: list[tuple[int, int]], string: bytes, at: tuple[int, int]) -> None:
    """Keep a string's earliest place in best; any other place is a copy. The same place again is none."""
    old = best.setdefault(string, at)
    if at < old:
        best[string] = at
    if at != old:
        copies.append(max(at, old))


def _bytes_of(batches, buckets: int):
    """The contexts' bytes: rows (bucket, blob of texts, starts, counts and bytes), after _RUN bytes of contexts.

    A string dealt out by itself has the count -1, and goes once a run: its later copies are known as such and have
    the count 0 and no bytes.
    """
    anchor, doc, first, count, strings = [], [], [], [], []
    best, copies, size = {}, [], 0
    for row in chain(_texts(batches, named=True), [()]):
        if row is None:
            continue
        if row:
            d, raw, places = row
            for place, kind, a in zip(*(places.field(x).to_numpy().tolist() for x in ("place", "kind", "anchor")), strict=True):
                p, n = place >> 8, (place & 255) + 1
                if kind == 1:
                    anchor.append(a)
                    doc.append(d)
                    first.append(p)
                    count.append(n)
                    strings.append(raw[p : p + n - 1 + LENGTH])
                    size += n - 1 + LENGTH
                else:  # each string by itself
                    for i in range(p, p + n):
                        _note(best, copies, raw[i : i + LENGTH], (d, i))
                    size += n * LENGTH
            if size < _RUN:
                continue
        anchor += [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in best]
        anchor += [d for d, _ in copies]
        doc += [d for d, _ in [*best.values(), *copies]]
        first += [i for _, i in [*best.values(), *copies]]
        count += [-1] * len(best) + [0] * len(copies)
        strings += [*best, *[b""] * len(copies)]
        if doc:
            yield _string_blobs(buckets, *(np.array(x, np.int64) for x in (anchor, doc, first, count)), strings)
        anchor, doc, first, count, strings = [], [], [], [], []
        best, copies, size = {}, [], 0


def _string_blobs(buckets: int, anchor, doc, first, count, strings: list[bytes]) -> pa.RecordBatch:
    z = zstandard.ZstdCompressor(level=1)
    part = (_vec.mix(anchor.view(_U)) % _U(buckets)).astype(np.int64)
    order = _stable(part)
    doc, first, count, part = doc[order], first[order], count[order], part[order]
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])).tolist()
    rows, blobs = [], []
    for p, q in zip(edge[:-1], edge[1:], strict=True):
        rows.append(int(part[p]))
        blobs.append(z.compress(np.int64(q - p).tobytes() + doc[p:q].tobytes() + first[p:q].tobytes() + count[p:q].tobytes() + b"".join(strings[i] for i in order[p:q])))
    return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _shard_order(sym: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Suffix array of one shard: order of its suffixes by all their symbols, prefix doubling on ranks.

    sym: rank of each suffix's first symbol, -1 for an end. follows[i]: the suffix one symbol on, i itself for an end.
    """
    rank, step = sym + 1, follows
    while True:
        pair = rank * (len(sym) + 1) + np.where(step == np.arange(len(sym)), 0, rank[step] + 1)
        order = _stable(pair)
        pair = pair.take(order)
        up = np.concatenate([[0], np.cumsum(pair[1:] != pair[:-1])])
        new = np.empty_like(rank)
        new[order] = up
        step = step[step]
        if (step == step[step]).all() and (sym[step] < 0).all():
            pair = new * (len(sym) + 1) + np.where(step == np.arange(len(sym)), 0, new[step] + 1)
            return _stable(pair)
        rank = new


def merged_intervals(data: np.ndarray, size: np.ndarray, depth: int = LENGTH // BLOCK, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the shards' transforms of strings of given sizes that follow one another in data.

    A block that occurs once in data is in no repeated string: the strings are cut at such blocks, phase by phase, and
    only stretches of depth blocks or more have suffixes.

    Returns, in the merged order: positions in data of these suffixes (-1 for ends and what has fewer blocks up to one),
    the number of their interval (equal first depth * BLOCK bytes), and the common prefix with the one before, in
    symbols, up to depth.
    """
    off = np.concatenate([[0], np.cumsum(size)])
    string = np.repeat(np.arange(len(size)), size)
    end = off[string + 1]
    place = np.arange(len(data))
    blocks = np.flatnonzero(place + BLOCK <= end)
    if not len(blocks):
        return place[:0], place[:0], place[:0]
    names = _vec.Ranges(data).every(BLOCK).take(blocks)
    order = _order(names)
    names, blocks = names.take(order), blocks.take(order)
    bound = np.append(True, names[1:] != names[:-1])
    symbol = np.full(len(data), -1)
    symbol[blocks] = np.cumsum(bound) - 1
    again = np.zeros(len(data) + depth * BLOCK, bool)
    again[blocks] = ~(bound & np.append(bound, True)[1:])
    begin = place + depth * BLOCK <= end
    for i in range(depth):
        begin &= again[i * BLOCK :][: len(data)]
    kept = np.zeros(len(data) + BLOCK, bool)
    for i in range(depth):
        kept[i * BLOCK : len(data)] |= begin[: max(len(data) - i * BLOCK, 0)]
    suffix = np.flatnonzero(kept)
    own = string[suffix]
    further = kept[suffix + BLOCK] & (suffix + 2 * BLOCK <= end[suffix])
    n, m = len(suffix), int((~further).sum())
    if not n:
        return place[:0], place[:0], place[:0]
    # string by string: its suffixes, then its ends, so that a shard is a stretch of both
    layout = _stable(np.concatenate([own, own[~further]]))
    place = np.empty(n + m, np.int64)
    place[layout] = np.arange(n + m)
    symbol = np.concatenate([symbol[suffix], np.full(m, -1)])[layout]
    where = np.concatenate([np.where(begin[suffix], suffix, -1), np.full(m, -1)])[layout]
    index = np.cumsum(kept) - 1
    to_end = n + np.cumsum(~further) - 1
    follows = np.concatenate([np.where(further, index[suffix + BLOCK], to_end), n + np.arange(m)])
    follows = place[follows][layout]
    before = np.full(n + m, -1)
    forward = symbol >= 0
    before[follows[forward]] = np.flatnonzero(forward)
    # one transform a shard, each sorted by itself
    weight = np.cumsum(np.bincount(own, minlength=len(size)) + np.bincount(own[~further], minlength=len(size)))
    cut = np.unique(np.concatenate([[0], weight[np.searchsorted(weight, np.arange(shard, n + m, shard))], [n + m]]))
    rank = np.empty(n + m, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        rank[a + _shard_order(symbol[a:b], follows[a:b] - a)] = np.arange(a, b)
    at_rank = np.empty(n + m, np.int64)
    at_rank[rank] = np.arange(n + m)
    prev = np.where(before[at_rank] >= 0, rank[before[at_rank]], -1)
    bwt = np.where(prev >= 0, symbol[before[at_rank]], -1)
    end_ranks = np.flatnonzero(symbol[at_rank] < 0)
    # the interleave starts as the shards one after the other; each iteration deals it out by the preceding symbol
    woven = np.arange(n + m)
    block = np.zeros(n + m, np.int64)
    common = np.full(n + m, depth)
    common[0] = 0
    for h in range(1, depth + 1):
        c = bwt[woven]
        has = np.flatnonzero(c >= 0)
        order = has.take(_stable(c.take(has)))
        bound = np.zeros(n + m, bool)
        bound[:1] = True
        bound[m : m + 1] = True
        c, block = c.take(order), block.take(order)
        bound[m + 1 :] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        woven = np.concatenate([end_ranks, prev.take(woven.take(order))])
        block = np.cumsum(bound) - 1
        common[bound & (common >= depth)] = h - 1
    return where[at_rank[woven]], block, common


def _merge(batches):
    """Starts that also start earlier, as (text, first start << 8 | starts - 1).

    Later copies of strings dealt out by themselves are passed on as they come.
    """
    _keep_freed()
    cols, parts, best = [], [], {}
    for held, done in _by_bucket(batches):
        copies = []
        for blob in held:
            raw = zstandard.decompress(blob)
            k = int(np.frombuffer(raw, np.int64, 1)[0])
            col = np.frombuffer(raw, np.int64, 3 * k, 8).reshape(3, k)
            size = np.where(col[2] == 0, 0, np.abs(col[2]) + LENGTH - 1)
            off = 8 + 24 * k + np.cumsum(size) - size
            for i in np.flatnonzero(col[2] < 0).tolist():
                _note(best, copies, raw[off[i] : off[i] + LENGTH], (int(col[0, i]), int(col[1, i])))
            copies += zip(*col[:2, col[2] == 0].tolist(), strict=True)
            whole = col[2] > 0
            cols.append(col[:, whole])
            parts.append(np.frombuffer(raw, np.uint8, -1, 8 + 24 * k)[np.repeat(whole, size)])
        if copies:
            old = np.array(copies, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(old[:, 0]), pa.array(old[:, 1] << 8)], names=["doc", "place"])
        if not done:
            continue
        # of strings dealt out by themselves the merge gets the earliest only
        cols.append(np.array([(d, i, 1) for d, i in best.values()], np.int64).reshape(-1, 3).T)
        parts.append(np.frombuffer(b"".join(best), np.uint8))
        doc, first, count = np.concatenate(cols, axis=1)
        data = np.concatenate(parts)
        cols, parts, best = [], [], {}
        if not len(doc):
            continue
        # in the order of texts and starts, repeated rows once, so that a place in data tells which starts earlier
        size = count + LENGTH - 1
        off = np.cumsum(size) - size
        order = np.lexsort((first, doc))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (first[order][1:] != first[order][:-1])
        order = order[new]
        doc, first, count, size, old = doc[order], first[order], count[order], size[order], off[order]
        off = np.cumsum(size) - size
        data = data[np.arange(size.sum()) + np.repeat(old - off, size)]
        where, block, _ = merged_intervals(data, size)
        own = np.zeros(len(data), bool)
        own[np.arange(count.sum()) + np.repeat(off - (np.cumsum(count) - count), count)] = True
        take = where >= 0
        take[take] = own[where[take]]
        where, block = where[take], block[take]
        if not len(where):
            continue
        edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        least = np.repeat(np.minimum.reduceat(where, edge), np.diff(np.append(edge, len(where))))
        later = np.zeros(len(data) + 1, bool)
        later[where[where > least]] = True
        flips = np.flatnonzero(np.diff(np.concatenate([[False], later]).astype(np.int8)))
        a, b = flips[::2], flips[1::2]
        text = np.searchsorted(off, a, "right") - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[text]), pa.array((first[text] + a - off[text]) << 8 | (b - a - 1))], names=["doc", "place"])


def _apply(batches):
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept"]
    rows = [[], [], [], [], []]
    for row in _texts(batches):
        if row is None:
            if rows[0]:
                yield pa.RecordBatch.from_arrays([*[pa.array(r, pa.int64()) for r in rows[:4]], pa.array(rows[4], pa.binary())], names=names)
            rows = [[], [], [], [], []]
            continue
        key, raw, places = row
        gone = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if places is not None:
            x = np.sort(places.to_numpy(zero_copy_only=False))
            a, b = x >> 8, np.maximum.accumulate((x >> 8) + (x & 255) + LENGTH)
            new = np.concatenate([[True], a[1:] > b[:-1]])
            gone = a[new], np.append(b[:-1][new[1:]], b[-1])
        at, kept = 0, []
        for a, b in zip(gone[0].tolist(), gone[1].tolist(), strict=True):
            kept.append(raw[at:a])
            at = b
        kept.append(raw[at:])
        for r, x in zip(rows, (key, len(raw), int((gone[1] - gone[0]).sum()), len(gone[0]), b"".join(kept)), strict=True):
            r.append(x)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) for every row: kept is the text without the removed bytes.

    A byte goes if a LENGTH-byte string over it also starts earlier, in a text of smaller key or in the same text; all
    strings are judged on the input. Texts are UTF-8 bytes, whole; kept bytes may cut a character in two.

    A null text is empty; a text shorter than LENGTH loses nothing; repeated rows (same key and text) count as one
    text and get the same result; rows with a null key lose nothing. Keys are whole numbers. A group of copies costs
    each task one context an anchor: the others are known as copies before the shuffle. Contexts are dealt out by anchor
    and hash, so an anchor that a third of all texts have in ever different surroundings lies in all tasks. From hot
    contexts on its strings, too, are dealt out one by one, to bound what a task merges.
    """
    session = docs.sparkSession
    named = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t"))
    total = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(session.conf.get("spark.sql.shuffle.partitions"))
    n = max(n, math.ceil(total / _PART))
    buckets = max(2 * n, math.ceil(total / (LENGTH - GRAM + 2) * 2 / BUCKET))
    found = named.filter("doc is not null").mapInArrow(lambda b: _find(b, buckets), "bucket long, blob binary")
    found = found.repartition(n, "bucket").sortWithinPartitions("bucket")
    contexts = written(found.mapInArrow(lambda b: _anchored(b, buckets), "doc long, place long, kind int, anchor long, blob binary"), "contexts")
    # an anchor with one context repeats nothing else
    lone = contexts.filter("kind = 2").select(F.col("anchor").alias("bucket"), "blob").repartition(n, "bucket").sortWithinPartitions("bucket")
    anchors = written(lone.mapInArrow(lambda b: _opened(b, hot), "doc long, place long, kind int, anchor long"), "anchors")
    much = F.broadcast(anchors.filter("kind = 2").select("anchor", F.lit(2).alias("much")))
    places = ["doc", "place", "anchor"]
    open_ = contexts.filter("kind = 1").select(*places).unionByName(anchors.filter("kind = 1").select(*places))
    left = open_.agg(F.sum(F.col("place").bitwiseAND(F.lit(255)) + LENGTH)).first()[0] or 0
    merged = max(2 * n, math.ceil(left / MERGED))
    open_ = open_.join(much, "anchor", "left").select("doc", "place", F.coalesce("much", F.lit(1)).alias("kind"), "anchor")
    open_ = open_.repartition(n, "doc").groupBy("doc").agg(F.collect_list(F.struct("place", "kind", "anchor")).alias("places"))
    # both joins keep all texts, so that they are dealt out once, to as many tasks as they ask for
    texts = named.mapInArrow(_pack, "doc long, packed binary").repartition(n, "doc")
    strings = texts.join(open_, "doc", "left").select("doc", "packed", "places").mapInArrow(lambda b: _bytes_of(b, merged), "bucket long, blob binary")
    strings = strings.repartition(n, "bucket").sortWithinPartitions("bucket")
    later = strings.mapInArrow(_merge, "doc long, place long")
    gone = contexts.filter("kind = 0").select("doc", "place").unionByName(later).repartition(n, "doc").groupBy("doc").agg(F.collect_list("place").alias("places"))
    out = texts.join(gone, "doc", "left").select("doc", "packed", "places").mapInArrow(_apply, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("doc", key)


def dedup_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the removed bytes taken out of text; half characters at a cut become U+FFFD. Keys must be unique."""
    out = without(docs, "__k", "__t")
    kept = substring_dedup(docs, key, text).filter("n_removed > 0").select(F.col(key).alias("__k"), F.decode("kept", "UTF-8").alias("__t"))
    out = out.join(kept, out[key] == kept["__k"], "left")
    return out.withColumn(text, F.coalesce("__t", F.col(text))).drop("__k", "__t")
