"""Cutting a plan's lineage on storage that all executors share, and dealing small inputs out to all cores."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; only where that is unset, on one machine, a folder is made."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """df as it is now, as Parquet in the shared folder: made once, read by column, and a lost executor costs no recomputation.

    The table is deleted when the run that made it ends (see tables_of_run), or else with the driver's process.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = _run.get()
    if made is None:
        atexit.register(delete, spark, path)
    else:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: The tables of the run that the current thread is in; None outside of runs.
_run: ContextVar[list[str] | None] = ContextVar("run", default=None)


@contextmanager
def tables_of_run(spark: SparkSession):
    """Within it, settled tables belong to a run of their own: they are deleted at its end, and no other run's are."""
    made: list[str] = []
    token = _run.set(made)
    try:
        yield made
    finally:
        _run.reset(token)
        for path in made:
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: its folder is the cluster's to clean
        return


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], n: str = "n", hot: int = 10_000) -> DataFrame:
    """rows joined with a table of unique keys that says in n how many of the rows each key has. Both are settled tables.

    A key is hot from one in `hot` rows on. Hot keys are at most `hot` rows of the table, whatever the size of rows: they
    are broadcast, so that their rows stay where they are. The others meet by a shuffle, none with more rows than that.
    """
    least = max(2, rows.count() // hot)
    often = F.broadcast(table.filter(F.col(n) >= least))
    cold = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(table.filter(F.col(n) < least), on)
    return rows.join(often, on).unionByName(cold)


def spread(df: DataFrame, part: int | None = None) -> DataFrame:
    """df dealt out to all cores if its input is so small that its files have fewer splits than there are cores.

    What is dealt out is so at most a split's size (spark.sql.files.maxPartitionBytes) a core; larger inputs and streams stay as they are.
    A join's estimated size is the product of its sides, so what is joined is dealt out before.
    part: most bytes of a task's input, for work that takes much time a byte.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(cores, -(-size // part) if part else 0)) if size < split * cores else df
