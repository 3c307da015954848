"""A versioned table of embeddings for each model, of which a refresh rewrites only the ranges that have changed.

Chunks are dealt into RANGES by the hash of their id. A version's sidecar says for each range where its rows are, how
many there are and a digest of all (id, hash of the text); a range whose digest is still right isn't even read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.settle import settled
from ..operators.dense import Embedder, embed, text_hash
from .versions import Snapshot, Versions

RANGES = 64
_SIDECAR = "range int, path string, n long, digest string, model string, dim int"


def _range_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(RANGES)).cast("int")


def _digests(rows: DataFrame, key: str) -> DataFrame:
    """(range, n, digest): sums of two hashes of each row, whatever the rows' order."""
    sums = [F.sum(F.xxhash64(F.lit(s), F.col(key).cast("string"), "hash").cast("decimal(38,0)")) for s in (1, 2)]
    return rows.groupBy(_range_of(key).alias("range")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", *[s.cast("string") for s in sums]).alias("digest"))


class VectorTable:
    """The table of a model's vectors in folder/<the model's slug>: (key, hash, embedding, since); since is the number of the
    version for which a vector was made."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder, key: str = "chunk_id"):
        self.spark, self.embedder, self.key = spark, embedder, key
        self.folder = f"{folder.rstrip('/')}/{embedder.slug}"
        self.versions = Versions(spark, self.folder)

    def _sidecar(self, at: Snapshot | None) -> DataFrame | None:
        """None if there is none, or if it is of another model or dimension: then all is to be made anew."""
        if at is None or (at.meta.get("model"), at.meta.get("dim")) != (self.embedder.model_id, self.embedder.dim):
            return None
        try:
            return at.table("sidecar")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def _rows(self, paths: list[str], chunks: DataFrame) -> DataFrame:
        schema = f"`{self.key}` {dict(chunks.dtypes)[self.key]}, hash string, embedding array<float>, since long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, at: Snapshot | None = None) -> DataFrame:
        """All rows of a version, the last by default."""
        at = at or self.versions.current()
        if at is None:
            raise FileNotFoundError(f"no vectors in {self.folder}")
        paths = [r.path for r in at.table("sidecar").filter("n > 0").select("path").collect()]  # RANGES rows
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], f"{self.key} long, hash string, embedding array<float>, since long")

    def refresh(self, chunks: DataFrame, text: str = "body") -> Snapshot:
        """Make the table that of chunks (unique keys, texts) and publish it; meta says how many ranges were rewritten.

        In a range that has changed, rows with the same key and hash keep their vectors, new and changed ones go through
        the model, and rows that are gone are left out. Without a sidecar everything is made anew.
        """
        at = self.versions.current()
        number = (at.number if at else 0) + 1
        now = settled(chunks.select(self.key, F.col(text).alias("text"), text_hash(text).alias("hash")), "hashed")
        digests = {r.range: (r.n, r.digest) for r in _digests(now, self.key).collect()}  # RANGES rows
        sidecar = self._sidecar(at)
        before = {r.range: r for r in sidecar.collect()} if sidecar is not None else {}
        same = {i for i, r in before.items() if digests.get(i, (0, "")) == (r.n, r.digest)}
        changed = sorted(set(digests) - same)
        data = f"{self.folder}/data/{uuid.uuid4().hex}"

        def write(folder: str) -> dict:
            if changed:
                some = now.filter(_range_of(self.key).isin(changed))
                old = self._rows([before[i].path for i in changed if i in before], chunks)
                met = some.join(old, [self.key, "hash"], "left")
                kept = met.filter("embedding is not null").select(self.key, "hash", "embedding", "since")
                new = embed(met.filter("embedding is null").drop("embedding"), "text", self.embedder)
                new = new.select(self.key, "hash", "embedding", F.lit(number).cast("long").alias("since"))
                rows = kept.unionByName(new).withColumn("range", _range_of(self.key))
                rows.repartition("range").write.partitionBy("range").parquet(data)
            entries = [(i, f"{data}/range={i}", *digests[i]) for i in changed] + [(i, before[i].path, *digests[i]) for i in sorted(same)]
            entries = [(*e, self.embedder.model_id, self.embedder.dim) for e in entries if e[2]]
            self.spark.createDataFrame(entries, _SIDECAR).coalesce(1).write.parquet(f"{folder}/sidecar")
            return {"model": self.embedder.model_id, "dim": self.embedder.dim, "rewritten": len(changed), "ranges": len(entries)}

        return self.versions.publish(write, expected=number - 1)
