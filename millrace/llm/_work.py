"""Places for intermediate tables, and small schema helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from one in so many rows on; so many keys can be hot at most, and their rows are broadcast.
HOT = 10_000
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir as the session has it.

    Only where it is unset (tests on one machine) a temporary folder is made and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(clear)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many intermediate tables there are, to clear later ones."""
    return len(_made)


def clear(since: int = 0) -> None:
    """Delete the intermediate tables made so far, or since there were so many; their readers must be done."""
    while len(_made) > since:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: its folder is the cluster's to clean
            return


def looked_up(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """rows joined with a table of unique keys and their number of rows n. Both are written tables.

    Hot keys are at most HOT rows of the table, whatever the size of rows: they are broadcast, so that their rows stay
    where they are. The others meet by a shuffle in which no key has more than one in HOT rows.
    """
    least = max(2, rows.count() // HOT)
    hot = F.broadcast(table.filter(F.col("n") >= least))
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(table.filter(F.col("n") < least), on)
    return rows.join(hot, on).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns whose names (case-insensitively) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def hex_sha(col) -> F.Column:
    return F.sha2(col, 256)
