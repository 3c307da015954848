"""Integer codes of vectors, packed into the fewest bytes: what equal vectors are grouped and joined by."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held within this bound, so that they and their differences are longs.
EDGE = 1 << 56
_WIDTHS = (1, 2, 4, 8)


def whole(vector: Column) -> Column:
    """Whether a vector has neither null nor non-finite entries; a null vector hasn't."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def floored(values: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x) as longs, within EDGE on both sides. factor is a power of two, so the product is exact."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * factor), -float(EDGE), float(EDGE)).astype(np.int64)


def pack(rows: np.ndarray) -> list[bytes]:
    """Each row of longs as bytes: the width of its components, then the components. Equal rows have equal bytes."""
    if not len(rows):
        return []
    least, most = rows.min(axis=1), rows.max(axis=1)
    out: list[bytes] = [b""] * len(rows)
    left = np.ones(len(rows), bool)
    for w in _WIDTHS:
        info = np.iinfo(f"i{w}")
        fits = np.flatnonzero(left & (least >= info.min) & (most <= info.max))
        left[fits] = False
        for i, x in zip(fits.tolist(), rows[fits].astype(f"<i{w}"), strict=True):
            out[i] = bytes([w]) + x.tobytes()
    return out


def unpack(codes: pa.Array, dim: int) -> np.ndarray:
    """The rows of longs of packed codes, all of dim components."""
    out = np.empty((len(codes), dim), np.int64)
    raw = codes.to_pylist()
    for w in _WIDTHS:
        own = [i for i, c in enumerate(raw) if c[0] == w]
        if own:
            out[own] = np.frombuffer(b"".join(raw[i][1:] for i in own), f"<i{w}").reshape(-1, dim)
    return out


def coded(df: DataFrame, key: str, vector: str, factor: int, dim: int) -> DataFrame:
    """(key, code binary) of the rows whose vector has dim components, all of them finite. Other rows are left out."""

    def batch(vectors: pa.Array) -> pa.Array:
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        return pa.array(pack(floored(flat.reshape(-1, dim), factor)), pa.binary())

    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias("__v")).filter((F.size("__v") == dim) & whole(F.col("__v")))
    return rows.select(key, F.arrow_udf(batch, "binary")(F.col("__v")).alias("code"))
