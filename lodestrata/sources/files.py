"""Staged files: listing, choosing and unpacking."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and depth of all files under a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return rows.withColumn("depth", depth(F.col("path")))


def depth(path: Column) -> Column:
    return F.size(F.split(F.regexp_replace(path, r"[\\/]+", "/"), "/"))


def largest(files: DataFrame) -> DataFrame:
    """The largest file, of equals the one whose path comes first."""
    return files.agg(F.min(F.struct(-F.col("length"), F.col("path"))).alias("m")).select(F.col("m.path").alias("path")).where("path is not null")


def smallest(files: DataFrame) -> DataFrame:
    return files.agg(F.min(F.struct("length", "path")).alias("m")).select(F.col("m.path").alias("path")).where("path is not null")


def top(files: DataFrame) -> DataFrame:
    """All files at the least depth."""
    return _at(files, F.min)


def bottom(files: DataFrame) -> DataFrame:
    """All files at the greatest depth."""
    return _at(files, F.max)


def _at(files: DataFrame, pick) -> DataFrame:
    rows = files.select("path", depth(F.col("path")).alias("depth"))
    return rows.join(F.broadcast(rows.agg(pick("depth").alias("depth"))), "depth").select("path")


def matching(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose whole path holds a regular expression."""
    return files.where(F.col("path").rlike(pattern)).select("path")


def choose(files: DataFrame, kind: str, pattern: str | None = None) -> DataFrame:
    return matching(files, pattern or "") if kind == "pattern" else {"largest": largest, "smallest": smallest, "top": top, "bottom": bottom}[kind](files)


def unzip(archives: DataFrame) -> DataFrame:
    """path, name and content of every file in zip archives (path, content).

    Names that lead out of the archive's folder are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for item in z.infolist():
                        name = posixpath.normpath(item.filename.replace("\\", "/"))
                        if not item.is_dir() and not name.startswith(("/", "..")) and ":" not in name:
                            yield pd.DataFrame({"path": [path], "name": [name], "content": [z.read(item)]})

    return archives.select("path", "content").mapInPandas(run, "path string, name string, content binary")


def split_levels(table: DataFrame, key: str, out: str) -> None:
    """Write a table by area level, one folder each; rows of unknown levels are left out."""
    from ..functions.text import area_level

    table.withColumn("level", area_level(F.col(key))).where("level is not null").write.mode("overwrite").partitionBy("level").parquet(out)
