"""Nearest neighbours, embedders, and reuse of embeddings of unchanged texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import RETRIEVED
from . import vectors as index

def knn(vectors: DataFrame, queries: DataFrame, k: int = RETRIEVED, item: str = "vec_id", query: str = "query_id", column: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, distance, score, rank): see vectors.nearest(), over an index that is made for this batch."""
    return index.nearest(index.build(vectors, item, column), queries, k, query, column)


@dataclass(frozen=True)
class Embedder:
    """model_id, dimension, and a function from a list of texts to rows of floats; it is made once for each worker."""

    model_id: str
    dim: int
    make: Callable[[], Callable[[list[str]], np.ndarray]]
    batch: int = 32

    @property
    def slug(self) -> str:
        return self.model_id.rsplit("/", 1)[-1]


# Dimensions of the models by name.
DIMENSIONS = {"small": 384, "base": 768, "large": 1024, "m3": 1024, "voyage": 512, "cohere": 1024}


def noop(dim: int = 384) -> Embedder:
    return Embedder("noop", dim, lambda: lambda texts: np.zeros((len(texts), dim), np.float32))


def hashed(dim: int = 64) -> Embedder:
    """A deterministic bag of hashed words, of length 1: for tests and for runs without a model."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return Embedder(f"hashed-{dim}", dim, lambda: embed)


def embed(df: DataFrame, text: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """df with a vector for each text; a null text counts as empty. The model is loaded once for each worker."""
    make, size, dim = embedder.make, embedder.batch, embedder.dim

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.fillna("").tolist()
            rows = [model(texts[i : i + size]) for i in range(0, len(texts), size)]
            if any(r.shape[1] != dim for r in rows):
                raise ValueError(f"vectors of {dim} numbers were expected")
            yield pd.Series([v for r in rows for v in np.asarray(r, np.float32)], dtype=object)

    return df.withColumn(out, run(F.col(text)))


def text_hash(*parts) -> F.Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(p), F.lit("")) for p in parts]), 256)


def reused(chunks: DataFrame, before: DataFrame | None, text: str = "body", key: str = "chunk_id") -> DataFrame:
    """chunks with hash and embedding: the earlier one where id and hash are the same, else null. No earlier table: all null."""
    now = chunks.withColumn("hash", text_hash(text))
    if before is None:
        return now.withColumn("embedding", F.lit(None).cast("array<float>"))
    return now.join(before.select(key, "hash", "embedding"), [key, "hash"], "left")


def refresh(chunks: DataFrame, before: DataFrame | None, embedder: Embedder, text: str = "body", key: str = "chunk_id") -> DataFrame:
    """(key, hash, embedding, reused): only texts that are new or changed go through the model."""
    rows = reused(chunks, before, text, key)
    old = rows.filter("embedding is not null").select(key, "hash", "embedding", F.lit(True).alias("reused"))
    new = embed(rows.filter("embedding is null").drop("embedding"), text, embedder).select(key, "hash", "embedding", F.lit(False).alias("reused"))
    return old.unionByName(new)
