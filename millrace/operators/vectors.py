"""A partitioned vector index: exact nearest neighbours by the triangle inequality, for batches of queries as rows.

Vectors lie in cells around centres, and in rings by their distance from the centre. A ring whose distances all differ
from the query's own distance to the centre by more than the k-th best found so far can't hold a result, and is skipped.
Each vector also has a code of one byte a component with the distance between the two, so that a first look at codes
bounds every distance from both sides; only vectors whose lower bound is good enough are then measured exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import RETRIEVED
from ..functions.settle import settled
from .lexical import best

#: At most so many cells for each length of vectors, rings in a cell, vectors that centres are fitted to for each cell.
CELLS, RINGS, FITTED = 1024, 8, 16
#: About so many vectors of a ring are a piece; so many vectors of several pieces, and so many queries, meet in a task.
PART, SHELF, QUERIES = 4096, 16384, 16384
#: Queries that are compared with a piece at a time, and pairs that are measured at a time.
TILE, _EXACT = 1024, 1 << 16
#: What rounding may add to a bound, as a share of the numbers that it is made of.
ROUNDING = 1e-9
_KEYS = ["cell", "ring", "piece"]


@dataclass(frozen=True)
class VectorIndex:
    """Tables of an index.

    centres (cell, dim, centre): at most CELLS rows for each dim. parts (cell, ring, n, low, high, pieces): at most RINGS
    rows a cell; low and high are the least and greatest distance from the centre. vectors (cell, ring, piece, id, v,
    scale, off, code): off is the distance between a vector and scale times its code.
    """

    centres: DataFrame
    parts: DataFrame
    vectors: DataFrame

    def write(self, folder: str) -> None:
        """Sorted by part, so that those that are skipped are not read but for their key columns."""
        for name in ("centres", "parts"):
            getattr(self, name).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
        self.vectors.repartitionByRange(*_KEYS).sortWithinPartitions(*_KEYS).write.mode("overwrite").parquet(f"{folder}/vectors")

    @staticmethod
    def read(spark, folder: str) -> VectorIndex:
        return VectorIndex(*[spark.read.parquet(f"{folder}/{t}") for t in ("centres", "parts", "vectors")])


def _lists(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """All numbers of a list column, and for each length the rows that have it."""
    dims = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), {int(d): np.flatnonzero(dims == d) for d in np.unique(dims)}


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    start = column.offsets.to_numpy()[rows] - column.offsets[0].as_py()
    return column.flatten().to_numpy(zero_copy_only=False)[start[:, None] + np.arange(dim)]


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def _fitted(rows: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n centres of the rows at most: the first n distinct ones, moved to the means of what is nearest to them."""
    _, first = np.unique(rows, axis=0, return_index=True)
    centres = rows[np.sort(first)[:n]]
    for _ in range(rounds):
        own = _far(rows, centres).argmin(1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = rows[own == c].mean(0)
    return centres


def _coded(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, off) of the rows of a matrix."""
    scale = np.abs(m).max(1, initial=0.0) / 127
    code = np.rint(np.divide(m, scale[:, None], out=np.zeros_like(m), where=scale[:, None] > 0)).astype(np.int8)
    return code, scale, np.sqrt(((m - scale[:, None] * code) ** 2).sum(1))


def _placed(centres: dict[int, tuple[int, np.ndarray]]):
    """Of (id, v): cell, distance from its centre, and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, by_dim = _lists(b.column(1))
            for dim, rows in by_dim.items():
                m = _matrix(b.column(1), rows, dim)
                first, c = centres[dim]
                own = _far(m, c).argmin(1)
                code, scale, off = _coded(m)
                r = np.sqrt(((m - c[own]) ** 2).sum(1))
                arrays = [b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(own + first, pa.int32()), pa.array(r), pa.array(scale), pa.array(off), pa.array([x.tobytes() for x in code], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "v", "cell", "r", "scale", "off", "code"])

    return run


def build(vectors: DataFrame, item: str = "vec_id", column: str = "embedding") -> VectorIndex:
    """The index of vectors that are there and not empty; entries that aren't finite leave a vector out.

    Centres are fitted to at most FITTED vectors for each cell, those of least hash: a bounded sample, which decides how
    well parts are skipped but not what is found. All vectors are indexed.
    """
    spark = vectors.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = vectors.select(F.col(item).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    centres, first = {}, 0
    for dim, n in sorted((r.d, r.n) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each length
        cells = min(CELLS, max(1, round(n**0.5 / 2)))
        sample = rows.filter(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(cells * FITTED).select("v").toArrow().column("v").combine_chunks()
        centres[dim] = (first, _fitted(_matrix(sample, np.arange(len(sample)), dim), cells))
        first += len(centres[dim][1])
    named = [(at + i, dim, [float(x) for x in c]) for dim, (at, cs) in centres.items() for i, c in enumerate(cs)]
    placed = settled(rows.mapInArrow(_placed(centres), "id long, v array<double>, cell int, r double, scale double, off double, code binary"), "placed")
    edges = placed.groupBy("cell").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    ringed = placed.join(F.broadcast(edges), "cell").withColumn("ring", F.least(F.floor(width * RINGS), F.lit(RINGS - 1)).cast("int"))  # a row for each cell
    parts = ringed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    parts = settled(parts.withColumn("pieces", F.ceil(F.col("n") / PART).cast("int")), "parts")
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    dealt = ringed.join(F.broadcast(parts.select("cell", "ring", "pieces")), ["cell", "ring"]).withColumn("piece", piece)
    return VectorIndex(spark.createDataFrame(named, "cell int, dim int, centre array<double>"), parts, settled(dealt.select(*_KEYS, "id", "v", "scale", "off", "code"), "vectors"))


@dataclass(frozen=True)
class _Map:
    """Centres and rings as arrays, for the tasks: CELLS * RINGS rows for each length at most."""

    centres: dict[int, tuple[np.ndarray, np.ndarray]]
    rings: dict[int, tuple[np.ndarray, ...]]

    @staticmethod
    def of(index: VectorIndex) -> _Map:
        by_dim: dict[int, list] = {}
        for r in index.centres.collect():
            by_dim.setdefault(r.dim, []).append((r.cell, r.centre))
        centres = {d: (np.array([c for c, _ in rows]), np.array([v for _, v in rows])) for d, rows in by_dim.items()}
        dim_of = {int(c): d for d, (cells, _) in centres.items() for c in cells}
        at = {int(c): i for cells, _ in centres.values() for i, c in enumerate(cells)}
        rings: dict[int, list] = {}
        for r in index.parts.collect():
            rings.setdefault(dim_of[r.cell], []).append((at[r.cell], r.cell, r.ring, r.n, r.low, r.high, r.pieces))
        return _Map(centres, {d: tuple(map(np.array, zip(*sorted(rows), strict=True))) for d, rows in rings.items()})

    def far(self, q: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the distances of all rows of q from all centres: a difference of large squares may lose half of its digits."""
        c = self.centres[dim][1]
        far, loose = _far(q, c), 1e-15 * (dim + 8) * ((q * q).sum(1)[:, None] + (c * c).sum(1)[None])
        return np.sqrt(np.maximum(far - loose, 0)), np.sqrt(far + loose)

    def first(self, far: np.ndarray, dim: int, k: int) -> np.ndarray:
        """Which rings each query looks at first: all of the nearest cells until these have k vectors."""
        at, n = self.rings[dim][0], self.rings[dim][3]
        order = np.argsort(far, axis=1, kind="stable")
        need = (np.cumsum(np.bincount(at, n, far.shape[1])[order], axis=1) < k).sum(1) + 1
        near = np.zeros(far.shape, bool)
        np.put_along_axis(near, order, np.arange(far.shape[1])[None] < need[:, None], 1)
        return near[:, at]

    def able(self, near: np.ndarray, far: np.ndarray, dim: int, sure: np.ndarray) -> np.ndarray:
        """Which rings can hold a vector nearer to a query than sure."""
        at, _, _, _, low, high, _ = self.rings[dim]
        edge = sure[:, None] + ROUNDING * (1 + far[:, at] + high)
        return (near[:, at] - high <= edge) & (low - far[:, at] <= edge)

    def seen(self, q: np.ndarray, dim: int, k: int, sure: np.ndarray, later: bool) -> np.ndarray:
        near, far = self.far(q, dim)
        return self.able(near, far, dim, sure) if later else self.first(near, dim, k)

    def shelves(self, most: int) -> tuple[list[tuple[int, int, int, int]], dict[int, tuple[np.ndarray, np.ndarray]]]:
        """(cell, ring, piece, shelf) of all pieces, in shelves of about `most` vectors of one length; for each length, rings and shelves of its pieces."""
        rows, of, shelf = [], {}, -1
        for dim, (_, cells, rings, n, _, _, pieces) in self.rings.items():
            own, full = [], float("inf")
            for i in range(len(cells)):
                for piece in range(pieces[i]):
                    size = n[i] / pieces[i]
                    if full + size > most:
                        shelf, full = shelf + 1, 0.0
                    full += size
                    own.append((i, shelf))
                    rows.append((int(cells[i]), int(rings[i]), piece, shelf))
            of[dim] = tuple(map(np.array, zip(*own, strict=True)))
        return rows, of


def _asked(plan: _Map):
    """Of queries (q, v): their nearest cell and code; those of a length that no vector has go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, by_dim = _lists(b.column(1))
            for dim, rows in by_dim.items():
                if dim in plan.rings:
                    m, one = _matrix(b.column(1), rows, dim), pa.array(rows)
                    cells, c = plan.centres[dim]
                    code, scale, off = _coded(m)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(one), b.column(1).take(one), pa.array(cells[_far(m, c).argmin(1)], pa.int32()), pa.array(scale), pa.array(off), pa.array([x.tobytes() for x in code], pa.binary())], names=["q", "v", "cell", "scale", "off", "code"])

    return run


def _looks(plan: _Map, k: int, later: bool, of: dict | None = None):
    """Of queries (q, v, sure, block): the shelves that some query of a block looks at or, without shelves, each query's (q, cell, ring)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, by_dim = _lists(b.column(1))
            names, sure, block = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            for dim, rows in by_dim.items():
                for some in np.array_split(rows, -(-len(rows) // TILE)):
                    q = _matrix(b.column(1), some, dim)
                    see = plan.seen(q, dim, k, sure[some], later)
                    if of is None:
                        if later:
                            see &= ~plan.seen(q, dim, k, sure[some], False)
                        i, j = np.nonzero(see)
                        yield pa.RecordBatch.from_arrays([pa.array(names[some][i]), pa.array(plan.rings[dim][1][j], pa.int32()), pa.array(plan.rings[dim][2][j], pa.int32())], names=["q", "cell", "ring"])
                        continue
                    ring, shelf = of[dim]
                    for x in np.unique(block[some]):
                        own = np.unique(shelf[see[block[some] == x].any(0)[ring]])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), x), pa.int32()), pa.array(own, pa.int32())], names=["block", "shelf"])

    return run


def _rows_of(t: pa.Table, coded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix, and how far each of its rows may be from the vector itself."""
    if coded:
        m = np.frombuffer(b"".join(t.column("code").to_pylist()), np.int8).reshape(t.num_rows, -1) * t.column("scale").to_numpy()[:, None]
        return m, t.column("off").to_numpy()
    stored = t.column("v").combine_chunks()
    return _matrix(stored, np.arange(len(stored)), len(stored[0])), np.zeros(len(stored))


def _pairs(q: np.ndarray, m: np.ndarray, most: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that can be no farther from each other than the row of q allows; rounding lets more pass, never fewer.

    Single precision does where the numbers are neither very large nor very small.
    """
    qq, mm = (q * q).sum(1), (m * m).sum(1)
    top = max(qq.max(), mm.max())
    narrow = narrow and 1e-20 < top < 1e20
    kind, unit = (np.float32, 1.2e-7) if narrow else (np.float64, 2.3e-16)
    least = (qq - most**2) / 2 - unit * (q.shape[1] + 8) * 2 * (qq + mm.max())
    g = q.astype(kind) @ m.T.astype(kind)
    g -= (mm / 2).astype(kind)
    return np.nonzero(g >= np.maximum(least, -1e30 if narrow else -np.inf).astype(kind)[:, None])


def _compared(plan: _Map, k: int, coded: bool, later: bool):
    """Of a shelf's vectors and a block's queries: (q, id, low, high), bounds of the distances that can be among a query's k best.

    What is found in one ring lowers what later ones must reach. The first look keeps only what its own bound needs.
    """

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))]
        if vectors.num_rows and queries.num_rows:
            ids, names = vectors.column("id").to_numpy(), queries.column("q").to_numpy()
            (m, off), (asked, own_off) = _rows_of(vectors, coded), _rows_of(queries, coded)
            dim, sure = m.shape[1], queries.column("sure").to_numpy()
            place = vectors.column("cell").to_numpy().astype(np.int64) * RINGS + vectors.column("ring").to_numpy()
            order = np.argsort(place, kind="stable")
            here, start = np.unique(place[order], return_index=True)
            parts = np.split(order, start[1:])
            _, cells, rings, *_ = plan.rings[dim]
            ring_of = {int(c) * RINGS + int(r): i for i, (c, r) in enumerate(zip(cells, rings, strict=True))}
            at = np.array([ring_of[int(x)] for x in here])
            for some in np.array_split(np.arange(len(names)), -(-len(names) // TILE)):
                q, q_off, limit = asked[some], own_off[some], sure[some].copy()
                see = plan.seen(q, dim, k, limit + q_off, later)[:, at]
                found = []
                for r, part in enumerate(parts):
                    rows = np.flatnonzero(see[:, r])
                    for piece in np.array_split(part, -(-len(part) // PART)) if len(rows) else []:
                        v, v_off = m[piece], off[piece]
                        new = rows[np.isinf(limit[rows])]
                        if len(new) and len(piece) >= k:
                            far = np.sqrt(_far(q[new], v) + 1e-15 * (dim + 8) * ((q[new] ** 2).sum(1)[:, None] + (v * v).sum(1)[None])) + v_off[None]
                            limit[new] = (np.partition(far, k - 1, 1)[:, k - 1] + q_off[new]) * (1 + ROUNDING)
                        i, j = _pairs(q[rows], v, limit[rows] + q_off[rows] + v_off.max(), coded)
                        i = rows[i]
                        for a in range(0, len(i), _EXACT):
                            x, y = i[a : a + _EXACT], j[a : a + _EXACT]
                            d = np.sqrt(((v[y] - q[x]) ** 2).sum(1))
                            wide = q_off[x] + v_off[y]
                            slack = ROUNDING * (d + wide) if coded else 0.0
                            low, high = d - wide - slack, d + wide + slack
                            fit = (low if later else high) <= limit[x]
                            found.append((x[fit], ids[piece[y[fit]]], low[fit], high[fit]))
                            by = np.lexsort((high, x))
                            first = np.flatnonzero(np.diff(x[by], prepend=-1))
                            full = np.diff(np.append(first, len(by))) >= k
                            kth = by[first[full] + k - 1]
                            limit[x[kth]] = np.minimum(limit[x[kth]], high[kth])
                if found:
                    x, near, low, high = (np.concatenate(c) for c in zip(*found, strict=True))
                    fit = (low if later else high) <= limit[x]
                    out.append((names[some[x[fit]]], near[fit], low[fit], high[fit]))
        out = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table({"q": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "low": pa.array(out[2], pa.float64()), "high": pa.array(out[3], pa.float64())})

    return run


def _blocked(asked: DataFrame) -> DataFrame:
    """Queries with their block: those of one cell, or of several cells one after the other, QUERIES at most or about so many."""
    rows, block, full, of = [], -1, 0.0, None
    counts = asked.groupBy(F.size("v").alias("dim"), "cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each cell
    for dim, cell, n in sorted(tuple(r) for r in counts):
        if dim != of or full + n > QUERIES:
            block, full, of = block + 1, 0.0, dim
        cut = -(-n // QUERIES)
        rows.append((cell, block, cut))
        block, full = block + cut - 1, full + n if cut == 1 else float("inf")
    named = asked.sparkSession.createDataFrame(rows, "cell int, first int, cut int")
    return asked.join(F.broadcast(named), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("q"), F.col("cut"))).cast("int")).drop("first", "cut", "cell")


def _met(index: VectorIndex, plan: _Map, asked: DataFrame, k: int, coded: bool, later: bool) -> DataFrame:
    """Blocks of queries meet the shelves of vectors that one of them looks at; a query is sent to a shelf once, not to each part."""
    spark = asked.sparkSession
    n, cores = sum(float(r[3].sum()) for r in plan.rings.values()), spark.sparkContext.defaultParallelism
    rows, of = plan.shelves(int(min(SHELF, max(PART / 4, n / cores))))
    shelved = F.broadcast(spark.createDataFrame(rows, "cell int, ring int, piece int, shelf int"))  # a row for each piece
    pairs = settled(asked.select("q", "v", "sure", "block").mapInArrow(_looks(plan, k, later, of), "block int, shelf int").distinct(), "looks")
    own = ["scale", "off", "code"] if coded else ["v"]
    vectors = index.vectors.join(shelved, _KEYS).join(pairs, "shelf").select("block", "shelf", "cell", "ring", "id", *own)
    met = asked.join(pairs, "block").select("block", "shelf", "q", "sure", *own)
    by = ["block", "shelf"]
    return vectors.groupBy(*by).cogroup(met.groupBy(*by)).applyInArrow(_compared(plan, k, coded, later), "q long, id long, low double, high double")


def _sure(found: DataFrame, k: int) -> DataFrame:
    """(q, sure): the k-th least upper bound of each query; endless where there are fewer."""
    top = best(found.select("q", "id", (-F.col("high")).alias("near"), "high"), k, "near", "q", "id")
    return top.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("high")).otherwise(F.lit(float("inf"))).alias("sure"))


def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of pairs of lists of one length each."""
    x, y = (c.flatten().to_numpy(zero_copy_only=False) for c in (a, b))
    ends = np.concatenate([[0], np.cumsum(np.diff(a.offsets.to_numpy()))])
    sums = np.add.reduceat((x - y) ** 2, ends[:-1]) if len(x) else np.zeros(0)
    return pa.array(np.sqrt(sums))


def nearest(index: VectorIndex, queries: DataFrame, k: int = RETRIEVED, query: str = "query_id", column: str = "embedding", coded: bool = False, looked: dict | None = None) -> DataFrame:
    """(query_id, chunk_id, distance, score, rank): the k nearest vectors of each query by L2, ties by id; score is 1/(1+d).

    Null and empty queries, those with entries that aren't finite and those of a length that no vector has find nothing.
    First the cells around a query that have k vectors are looked at, which gives a distance that k vectors are sure to
    have; then all rings that can hold a nearer one. With coded, both looks are at codes, and the vectors whose
    bounds allow it are measured afterwards. looked, if given, gets the tables of what was looked at, for parts_looked_at.
    """
    plan = _Map.of(index)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    asked = queries.select(F.col(query).cast("long").alias("q"), F.col(column).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    asked = settled(asked, "asked")
    coded_asked = settled(asked.mapInArrow(_asked(plan), "q long, v array<double>, cell int, scale double, off double, code binary"), "coded")
    one = settled(_blocked(coded_asked).withColumn("sure", F.lit(float("inf"))), "blocks")
    sure = _sure(_met(index, plan, one, k, coded, False), k)
    two = settled(one.drop("sure").join(sure, "q"), "wanted")
    found = _met(index, plan, two, k, coded, True)
    if looked is not None:
        seen = lambda df, later: df.select("q", "v", "sure", "block").mapInArrow(_looks(plan, k, later), "q long, cell int, ring int")
        looked |= {"asked": asked, "one": seen(one, False), "two": seen(two, True)}
    if coded:
        found = settled(found, "found")
        near = found.join(_sure(found, k), "q").filter("low <= sure").select("q", "id")
        near = near.join(index.vectors.select("id", F.col("v").alias("w")), "id").join(asked, "q").filter(F.size("v") == F.size("w"))
        found = near.select("q", "id", F.arrow_udf(_distance, "double")("v", "w").alias("high"))
    out = found.select(F.col("q").alias("query_id"), F.col("id").alias("chunk_id"), F.col("high").alias("distance"))
    out = out.withColumn("score", 1 / (1 + F.col("distance"))).withColumn("near", -F.col("distance"))
    return best(out, k, "near").drop("near")


def parts_looked_at(index: VectorIndex, looked: dict) -> DataFrame:
    """(query_id, n_parts, n_looked_at): rings of vectors of a query's length, and those it was compared with."""
    dims = index.parts.join(index.centres.select("cell", "dim"), "cell").groupBy("dim").agg(F.count(F.lit(1)).alias("n_parts"))
    seen = looked["one"].unionByName(looked["two"]).select("q", "cell", "ring").distinct().groupBy("q").agg(F.count(F.lit(1)).alias("n_looked_at"))
    rows = looked["asked"].select("q", F.size("v").alias("dim")).join(dims, "dim", "left").join(seen, "q", "left")
    return rows.select(F.col("q").alias("query_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_parts", "n_looked_at")])
