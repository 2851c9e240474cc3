"""Shared storage and reading helpers of the llm operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share, from spark.checkpoint.dir.

    Where the setting is missing a folder is made, but only in local mode,
    where driver and executors are one process.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="lodestrata-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts the lineage: later jobs, and retries after a lost executor, read
    the same rows instead of computing them anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stored_at = path
    return kept


def release(df: DataFrame) -> None:
    """Delete a table made by store() that no later step reads."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    Inside a lambda an outer expression is computed anew for every element;
    a lambda's own variable isn't.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows of a narrow table (some tens of bytes each) that may be broadcast.
FEW = 400_000


def beside(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, marked for broadcast if a count finds it small enough; else a join shuffles both sides.

    df must be stored or cheap, as it is counted first.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in pieces, so that Python holds few texts at once.

    After the last one the worker gives back what it holds no longer: it stays
    alive, idle, beside the tasks that follow.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tune(spark: SparkSession) -> None:
    """Let Arrow batches hold 1,000 rows where the session leaves the number as Spark sets it.

    Ten thousand long texts make a batch that the executor holds several times
    over outside its heap.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python gets so many rows at once while this holds."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def veiled(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns under names no operator uses, and the new name of each."""
    names = {c: f"column_{k}" for k, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def unveiled(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Just the columns that were veiled, under their own names."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])
