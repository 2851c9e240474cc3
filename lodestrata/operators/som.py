"""Self-organising map of variables: n x n neurons over J areas."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def initial_weights(spark: SparkSession, n: int, size: int, seed: int = 1) -> DataFrame:
    """y, x, weights: uniform in [-1, 1), the same for the same seed."""
    w = np.random.default_rng(seed).uniform(-1, 1, (n, n, size))
    return spark.createDataFrame([(y, x, w[y, x].tolist()) for y in range(n) for x in range(n)], "y int, x int, weights array<double>")


def classify(vectors: DataFrame, weights: DataFrame, vec: str = "vec") -> DataFrame:
    """vectors with win_y, win_x and distance: the neuron nearest by absolute differences, ties to the smallest (y, x).

    The neurons are broadcast: there are n x n of them, whatever the data.
    """
    neurons = weights.agg(F.collect_list(F.struct("y", "x", "weights")).alias("neurons"))
    each = F.transform("neurons", lambda m: F.struct(F.aggregate(F.zip_with(F.col(vec), m["weights"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x).alias("d"), m["y"].alias("y"), m["x"].alias("x")))
    best = vectors.crossJoin(F.broadcast(neurons)).withColumn("best", F.array_min(each)).drop("neurons")
    return best.select(*vectors.columns, F.col("best.y").alias("win_y"), F.col("best.x").alias("win_x"), F.col("best.d").alias("distance"))


def distances(vectors: DataFrame, weights: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """key, y, x, distance to every neuron."""
    gap = F.aggregate(F.zip_with(vec, "weights", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x)
    return vectors.crossJoin(F.broadcast(weights)).select(key, "y", "x", gap.alias("distance"))


def errors(vectors: DataFrame, weights: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: mean, least and largest residual (Euclidean, by component) of the vectors to their winners."""
    won = classify(vectors, weights, vec).join(F.broadcast(weights), (F.col("win_y") == F.col("y")) & (F.col("win_x") == F.col("x")))
    residual = F.sqrt(F.aggregate(F.zip_with(vec, "weights", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x))
    size = F.size(vec)
    return won.agg((F.sum(residual) / F.sum(size)).alias("error_all"), F.min(residual / size).alias("error_min"), F.max(residual / size).alias("error_max"))


@dataclass
class Trained:
    weights: DataFrame
    history: list[tuple[int, float]]


#: Epochs whose patterns the driver holds at once, and whose checks share one pass over the vectors.
STRETCH = 1000
#: Groups of vectors for numbering the rows.
GROUPS = 4096


def _numbered(vectors: DataFrame, vec: str) -> DataFrame:
    """_group, _from, _to, vec: distinct vectors, each standing for the rows _from to _to - 1 of its group.

    Rows are numbered by the vectors' hashes, so that numbers don't depend on
    how the table is split; equal vectors are one row here, however many.
    """
    own = vectors.groupBy(vec).agg(F.count(F.lit(1)).alias("_n")).withColumn("_hash", F.xxhash64(vec))
    own = own.withColumn("_group", F.pmod("_hash", F.lit(GROUPS)))
    up_to = F.sum("_n").over(Window.partitionBy("_group").orderBy("_hash", vec).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_to", up_to).select("_group", (F.col("_to") - F.col("_n")).alias("_from"), "_to", vec)


def _mean_residuals(rows: DataFrame, states: list[np.ndarray], vec: str) -> list[float]:
    """For each of some maps, the sum of all rows' residuals to their winners over the number of components."""
    maps = rows.sparkSession.sparkContext.broadcast([w.reshape(-1, w.shape[2]) for w in states])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(len(maps.value)), 0
        for batch in batches:
            each = max(1, (1 << 20) // maps.value[0].size)
            for at in range(0, batch.num_rows, each):
                part = batch.slice(at, each)
                n = part.column(1).to_numpy()
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)
                size += int(n.sum()) * x.shape[1]
                for k, flat in enumerate(maps.value):
                    win = np.abs(x[:, None, :] - flat).sum(axis=2).argmin(axis=1)
                    total[k] += np.sqrt(((x - flat[win]) ** 2).sum(axis=1)) @ n
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array([size] * len(total), pa.int64())], ["k", "total", "size"])

    parts = rows.select(vec, (F.col("_to") - F.col("_from")).alias("n")).mapInArrow(add, "k int, total double, size long")
    found = {r.k: r.error for r in parts.groupBy("k").agg((F.sum("total") / F.sum("size")).alias("error")).collect()}
    maps.unpersist()
    return [found[k] for k in range(len(states))]


def train(vectors: DataFrame, n: int = 4, max_epochs: int = 10_000, target: float = 0.001, seed: int = 1, vec: str = "vec", check_every: int = 100) -> Trained:
    """Train on one pattern an epoch, drawn at random from all vectors.

    The rate falls from 1 to 0.1 over 10,000 epochs and the neighbourhood from
    4 to 0.5 over 3,500.  Vectors are z-normalised first; constant ones, null
    ones and those with null or non-finite components are left out.  Training
    is sequential by nature, so it runs on the driver: that holds the patterns
    of a stretch of epochs, which are drawn by row number and fetched.  The
    error that ends it is over all vectors: the maps to check in a stretch are
    kept and judged in one distributed pass, and where one reaches the target,
    it is the result.
    """
    spark = vectors.sparkSession
    known = vectors.select(vec).where(F.col(vec).isNotNull())
    first = known.first()
    if first is None:
        return Trained(initial_weights(spark, n, 0, seed), [])
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = _numbered(normalise(known.where(good), vec), vec).persist()
    groups = rows.groupBy("_group").agg(F.max("_to").alias("n")).orderBy("_group").collect()
    ends = np.cumsum([r.n for r in groups], dtype=np.int64)
    rng = np.random.default_rng(seed)
    w = rng.uniform(-1, 1, (n, n, len(first[0])))
    yy, xx = np.mgrid[:n, :n]
    history: list[tuple[int, float]] = []
    for start in range(0, max_epochs if len(ends) else 0, STRETCH):
        epochs = range(start, min(start + STRETCH, max_epochs))
        drawn = rng.integers(ends[-1], size=len(epochs))
        at = np.searchsorted(ends, drawn, side="right")
        place = drawn - np.where(at > 0, ends[at - 1], 0)
        wanted = spark.createDataFrame([(int(groups[g]._group), int(r), e) for g, r, e in zip(at, place, epochs, strict=True)], "_own long, _row long, _epoch int")
        met = (F.col("_group") == F.col("_own")) & (F.col("_row") >= F.col("_from")) & (F.col("_row") < F.col("_to"))
        patterns = {r._epoch: np.array(r[1]) for r in rows.join(F.broadcast(wanted), met).select("_epoch", vec).collect()}
        kept = []
        for epoch in epochs:
            rate, near = max(1 - (epoch + 1) / 10_000, 0.1), max(4 - (epoch + 1) / 1000, 0.5)
            p = patterns[epoch]
            d = np.abs(w - p).sum(axis=2)
            wy, wx = np.unravel_index(d.argmin(), d.shape)
            w += np.where(np.hypot(yy - wy, xx - wx) <= near, rate, 0.0)[:, :, None] * (p - w)
            if epoch % check_every == 0:
                kept.append((epoch, w.copy()))
        if kept:
            found = _mean_residuals(rows, [x for _, x in kept], vec)
            done = next((k for k, error in enumerate(found) if error <= target), None)
            history += [(epoch, error) for (epoch, _), error in zip(kept, found, strict=True)][: None if done is None else done + 1]
            if done is not None:
                w = kept[done][1]
                break
    rows.unpersist()
    frame = spark.createDataFrame([(y, k, w[y, k].tolist()) for y in range(n) for k in range(n)], "y int, x int, weights array<double>")
    return Trained(frame, history)


def normalise(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """vectors z-normalised by their own mean and sample deviation, constant ones left out."""
    mean = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x) / F.size(vec)
    rows = vectors.withColumn("_mean", mean)
    square = F.aggregate(vec, F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
    rows = rows.withColumn("_sd", F.sqrt(square / F.nullif(F.size(vec) - 1, F.lit(0)))).where("_sd > 0")
    return rows.withColumn(vec, F.transform(vec, lambda x: (x - F.col("_mean")) / F.col("_sd"))).drop("_mean", "_sd")


def area_map(weights: DataFrame, areas: DataFrame) -> DataFrame:
    """area and a column y_x for each neuron, in order of y, then x.  areas: area, position (from 0)."""
    names = [f"{r.y}_{r.x}" for r in weights.select("y", "x").orderBy("y", "x").collect()]
    long = weights.select(F.concat_ws("_", "y", "x").alias("neuron"), F.posexplode("weights").alias("position", "w"))
    return areas.join(long, "position").groupBy("area").pivot("neuron", names).agg(F.first("w"))
