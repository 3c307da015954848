"""From raw documents to tokens: five stages, each written as Parquet and read again as the next one's documents.

All stages take documents (doc_id, text, lang, source, n_chars) and leave other columns out, whatever their names. Rows
of one doc_id and text are each judged alike. An empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, lines, minhash, pieces, quality
from millrace.llm._work import clear, made, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy v2 keeps, unchanged. A null, empty or word-less text has too few words and goes."""
    return quality.ledger(docs.select(*COLUMNS)).filter(quality.passes("v2")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and n_chars follows; a document goes if nothing else was in it.

    Null, empty and word-less texts, and rows without a doc_id, stay as they are.
    """
    out = lines.line_dedup(docs.select(*COLUMNS))
    left = (F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least doc_id, with each of its rows.

    Texts that are null or without words, and rows without a doc_id, are like nothing and stay.
    """
    return minhash.near_dedup(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates, unchanged. Null and word-less texts and items have no words to hit."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, restored, ids): ids of the pieces, their number, and whether decoding them gives the text again.

    A null text has null ids and no tokens, an empty one an empty list; both count as restored.
    """
    coder = pieces.Pieces(spark)
    out = docs.select("doc_id", "text").withColumn("ids", coder.encode(F.col("text")))
    restored = coder.decode(F.col("ids")).eqNullSafe(F.col("text"))
    n = F.when(F.col("ids").isNull(), F.lit(0)).otherwise(F.size("ids")).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), restored.alias("restored"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]

#: SQL can express neither the near duplicates nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of sf_dir. A stage's intermediate tables go once its output is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        before = made()
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{i}")
        clear(before)
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
