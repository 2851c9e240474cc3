"""A pair log as a stream: each unordered pair once, and running sums by table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_pairs(spark: SparkSession, path: str, schema: StructType | str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def new_pairs(pairs: DataFrame, a: str, b: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Pairs not met before, whichever way round.

    With a time column what is remembered is bounded by how late a repeat may
    come; without one every pair is remembered.
    """
    rows = pairs.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)})
    if time is None:
        return rows.dropDuplicates(["low", "high"])
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["low", "high"])


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Work off what is there and stop; a later call goes on from there."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_means(pairs: DataFrame, time: str, value: str, by: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    w = F.window(time, width)
    return pairs.withWatermark(time, late).groupBy(w.alias("window"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
