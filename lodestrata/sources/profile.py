"""Typing the columns of a staged table, and finding the geography its keys belong to.

The geography finder is a substitute of our own: how large a share of a
column's values are keys of each known geography.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, matrix
from . import catalogue, files, sinks


def _long(table: DataFrame, sample: int | None) -> DataFrame:
    """position, column, raw: the cells of a table, or of its first rows."""
    rows = table if sample is None else table.limit(sample)
    cells = [F.struct(F.lit(k).alias("position"), F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("raw")) for k, c in enumerate(table.columns)]
    return rows.select(F.explode(F.array(*cells)).alias("c")).select("c.position", "c.column", "c.raw")


def column_types(table: DataFrame, sample: int | None = 200) -> DataFrame:
    """position, column, is_numeric, is_index, min_value, max_value from the first rows (``sample=None``: all).

    Numeric: every filled cell is a number.  Index: cells are filled and all
    different.  All columns are read in one pass.
    """
    value = F.col("raw").try_cast("double")
    filled = F.coalesce(F.col("raw"), F.lit("")) != ""
    n = F.count_if(filled)
    return _long(table, sample).groupBy("position", "column").agg(
        ((n > 0) & (n == F.count_if(filled & value.isNotNull()))).alias("is_numeric"),
        ((n > 0) & (n == F.count(F.lit(1))) & (F.count_distinct("raw") == n)).alias("is_index"),
        F.min(F.when(filled, value)).alias("min_value"),
        F.max(F.when(filled, value)).alias("max_value"),
    )


def geometry_candidates(table: DataFrame, geographies: DataFrame, sample: int | None = 200) -> DataFrame:
    """name, position, column, prob: share of a column's filled cells that are keys of a geography (name, area).

    Only pairs with some match are listed.
    """
    cells = _long(table, sample).where("raw <> ''")
    total = cells.groupBy("position", "column").agg(F.count(F.lit(1)).alias("n"))
    keys = geographies.select("name", F.col("area").cast("string").alias("raw")).distinct()
    met = cells.groupBy("position", "column", "raw").agg(F.count(F.lit(1)).alias("m")).join(keys, "raw").groupBy("position", "column", "name").agg(F.sum("m").alias("m"))
    return met.join(total, ["position", "column"]).select("name", "position", "column", (F.col("m") / F.col("n")).alias("prob"))


def find_geometry(table: DataFrame, geographies: DataFrame, hints: DataFrame, least: float = 0.8, sample: int | None = 200) -> tuple[str, str] | None:
    """(geography, key column) of a table, None if none is likely enough."""
    found = geometry_candidates(table, geographies, sample).where(F.col("prob") >= least)
    best = classify.choose_geometry(found, hints).first()
    return None if best is None else (best.name, best.column)


def data_matrix(spark: SparkSession, rows: DataFrame, areas: DataFrame, read: Callable[[SparkSession, str], DataFrame] | None = None, pattern: str | None = None) -> DataFrame:
    """The matrix of all numeric variables of the files a catalogue links to.

    rows: link (a staged file or folder) of each dataset; one loop over the
    catalogue, as every file has columns of its own.  The first column is the
    area key.  The cells are read by Spark when the matrix is.
    """
    read = read or (lambda s, path: s.read.csv(path, header=True, nullValue=".."))
    tables = []
    for link in _links(rows):
        for path in _chosen(spark, link, pattern):
            table = read(spark, path)
            key = table.columns[0]
            numeric = [r.column for r in column_types(table).where("is_numeric").orderBy("position").collect() if r.column != key]
            tables.append(matrix.melt(table, key, numeric).withColumn("area", F.col("area").cast("string")))
    if not tables:
        return spark.createDataFrame([], "area string, variable string, value double")
    return matrix.build(areas.select(F.col("area").cast("string").alias("area")), tables)


def build_maps(spark: SparkSession, rows: DataFrame, geographies: DataFrame, hints: DataFrame, pattern: str | None = None, least: float = 0.8) -> DataFrame:
    """map_key and descriptor for each numeric column of each linked file whose geography is found.

    rows: unique_key, title, link.
    """
    out = None
    for r in catalogue.with_link(rows).collect():  # a catalogue row for each dataset
        for path in _chosen(spark, r.link, pattern):
            table = spark.read.csv(path, header=True, nullValue="..")
            geometry = find_geometry(table, geographies, hints, least)
            if geometry is None:
                continue
            columns = [t.column for t in column_types(table).where("is_numeric").orderBy("position").collect() if t.column != geometry[1]]
            if not columns:
                continue
            record = sinks.map_records(spark.createDataFrame([(r.unique_key, r.title, path)], "unique_key string, title string, data_uri string"), columns)
            styles = None
            for k, c in enumerate(columns):
                own = classify.style(table.select(F.col(f"`{c}`").try_cast("double").alias("v")), "v").select(F.lit(f"{r.unique_key}_{k}").alias("map_key"), "*")
                styles = own if styles is None else styles.union(own)
            made = sinks.descriptors(record, styles)
            out = made if out is None else out.union(made)
    return out if out is not None else spark.createDataFrame([], "map_key string, descriptor string")


def _links(rows: DataFrame) -> Iterable[str]:
    return [r.link for r in catalogue.with_link(rows).select("link").collect()]


def _chosen(spark: SparkSession, link: str, pattern: str | None) -> list[str]:
    rows = files.listing(spark, link)
    return [r.path for r in (files.matching(rows, pattern) if pattern else files.largest(rows)).collect()]
