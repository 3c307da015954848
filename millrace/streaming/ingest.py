"""Streams: documents that come in are chunked, linted or embedded as they arrive; events are counted by windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dense, lint, sections


def chunk_stream(docs: DataFrame) -> DataFrame:
    """(route, chunk_index, heading_path, body, hash) of a stream of (route, body): stateless, row by row."""
    rows = docs.select("route", F.posexplode(sections.chunk_sections(F.col("body"))).alias("chunk_index", "c"))
    return rows.select("route", F.col("chunk_index").cast("long").alias("chunk_index"), "c.heading_path", "c.body").withColumn("hash", dense.text_hash("body"))


def lint_stream(snippets: DataFrame, key: str, code: str = "code", **how) -> DataFrame:
    """(key, language_detected, issues) of a stream of snippets."""
    return lint.lint(snippets.select(key, code), code, **how).drop(code)


def changed_chunks(chunks: DataFrame) -> DataFrame:
    """The rows of a stream of chunk_stream() whose chunk is new or has another hash than the last one that came.

    The hash of each (route, chunk_index) is kept as the stream's state, so a chunk that comes again, in the same batch or
    years later, is let through once. A batch has no order: of different texts of one chunk in it the one with the greatest
    hash counts. What a later version of a document no longer has isn't known to the stream and stays.
    """
    columns = ["route", "chunk_index", "heading_path", "body", "hash"]

    def fresh(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = None
        for part in parts:
            row = part.loc[[part["hash"].idxmax()]]
            last = row if last is None or row["hash"].iloc[0] > last["hash"].iloc[0] else last
        said = last["hash"].iloc[0]
        if not state.exists or state.get[0] != said:
            state.update((said,))
            yield last[columns]

    rows = chunks.select(*columns).groupBy("route", "chunk_index")
    return rows.applyInPandasWithState(fresh, "route string, chunk_index long, heading_path string, body string, hash string", "hash string", "append", GroupStateTimeout.NoTimeout)


def embed_stream(docs: DataFrame, folder: str, embedder: dense.Embedder, checkpoint: str) -> StreamingQuery:
    """Keep a table of embeddings up to date: each batch's new or changed chunks are embedded and written as a version.

    The table is append-only, partitioned by batch; a batch that runs again writes its own partition again, from the state
    as it was before it. A batch in which nothing is new adds no row.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = dense.embed(batch, "body", embedder)
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changed_chunks(chunk_stream(docs)).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


def windowed(events: DataFrame, time: str, by: str, value: str, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, by, n, total) by tumbling windows; rows later than the watermark are left out of a stream."""
    seen = events.withWatermark(time, late) if events.isStreaming else events
    rows = seen.groupBy(F.window(time, length).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), by, "n", "total")
