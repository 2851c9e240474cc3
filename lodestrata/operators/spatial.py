"""Spatial cross-correlation between variables measured over areas.

The bivariate Moran's I of all pairs is zY' W zX / S0.  W is applied once to
each variable (its spatial lag); pairs of variables then meet on the area, so V
variables over N areas cost V N^2 + V^2 N products and not V^2 N^2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers (coordinates and values of areas) that are broadcast at once: 64 MB.  More areas are dealt in blocks.
BLOCK = 1 << 23


def weight(distance: Column, least: float = 1.0) -> Column:
    """1 within the least distance (so for an area itself), else its inverse."""
    return F.when(distance < least, F.lit(1.0)).otherwise(F.lit(1.0) / distance)


def distance(a: str, b: str) -> Column:
    dx, dy = F.col(f"{a}.x") - F.col(f"{b}.x"), F.col(f"{a}.y") - F.col(f"{b}.y")
    return F.sqrt(dx * dx + dy * dy)


def z_scores(matrix: DataFrame, area: str = "area", variable: str = "variable", value: str = "value") -> DataFrame:
    """matrix (area, variable, value) with z = (value - mean) / sample deviation; constant variables are left out."""
    stats = matrix.groupBy(variable).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).where("sd > 0")
    return matrix.join(stats, variable).select(area, variable, ((F.col(value) - F.col("mean")) / F.col("sd")).alias("z"))


def _deal(centroids: DataFrame, columns: int = 2) -> DataFrame:
    """centroids with a block number, so that a block of so many columns fits a broadcast."""
    blocks = max(1, -(-centroids.count() * columns // BLOCK))
    return centroids.withColumn("block", F.pmod(F.xxhash64("area"), F.lit(blocks)))


def spatial_sums(centroids: DataFrame, values: DataFrame, columns: list[str], least: float = 1.0) -> DataFrame:
    """area, weight_sum and lag_<column>: sums over all areas b of w(a, b) and w(a, b) * column(b).

    The areas form the query set: every task holds some of them and reads the
    areas they are weighed against block by block; the N x N weights exist only
    as numpy blocks.  values: area and the columns, one row for each area; an
    area without a row counts as zero.
    """
    spark = centroids.sparkSession
    zero = [F.coalesce(F.col(c), F.lit(0.0)).cast("double").alias(c) for c in columns]
    rows = _deal(centroids.select("area", F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")), 2 + len(columns)).join(values.select("area", *columns), "area", "left").select("area", "_x", "_y", "block", *zero)
    rows = rows.persist()
    total = None
    for block in [r.block for r in rows.select("block").distinct().collect()]:
        part = spark.sparkContext.broadcast(rows.where(F.col("block") == block).select("_x", "_y", *columns).toPandas().to_numpy(float))

        def weigh(batches: Iterator[pd.DataFrame], part=part) -> Iterator[pd.DataFrame]:
            other = part.value
            for batch in batches:
                for at in range(0, len(batch), 256):
                    own = batch.iloc[at : at + 256]
                    d = np.hypot(own._x.to_numpy()[:, None] - other[None, :, 0], own._y.to_numpy()[:, None] - other[None, :, 1])
                    with np.errstate(divide="ignore"):
                        w = np.where(d < least, 1.0, 1.0 / d)
                    lag = w @ other[:, 2:]
                    yield pd.DataFrame({"area": own.area.to_numpy(), "weight_sum": w.sum(axis=1)} | {f"lag_{c}": lag[:, k] for k, c in enumerate(columns)})

        kind = dict(rows.dtypes)["area"]
        schema = f"area {kind}, weight_sum double" + "".join(f", `lag_{c}` double" for c in columns)
        own = rows.select("area", "_x", "_y").repartition(max(8, spark.sparkContext.defaultParallelism)).mapInPandas(weigh, schema)
        total = own if total is None else total.union(own)
    if total is None:
        kind = dict(rows.dtypes)["area"]
        return spark.createDataFrame([], f"area {kind}, weight_sum double" + "".join(f", `lag_{c}` double" for c in columns))
    return total.groupBy("area").agg(*[F.sum(c).alias(c) for c in total.columns if c != "area"])


def weights_total(centroids: DataFrame, least: float = 1.0) -> DataFrame:
    """n_areas and s0, the sum of all weights, self pairs included."""
    nothing = centroids.select("area")
    return spatial_sums(centroids, nothing, [], least).agg(F.count(F.lit(1)).alias("n_areas"), F.coalesce(F.sum("weight_sum"), F.lit(0.0)).alias("s0"))


def wide(matrix: DataFrame, variables: list[str], value: str = "value") -> DataFrame:
    """area and a column for each of the named variables."""
    return matrix.groupBy("area").pivot("variable", variables).agg(F.first(value))


def moran_all_pairs(matrix: DataFrame, centroids: DataFrame, least: float = 1.0) -> DataFrame:
    """variable_i, variable_j, moran_i for all pairs with variable_i <= variable_j.

    matrix: area, variable, value.  Every variable is one column of the lag
    step, so their number, not the data, bounds the width of a row.
    """
    z = z_scores(matrix).persist()
    names = sorted(r.variable for r in z.select("variable").distinct().collect())
    sums = spatial_sums(centroids, wide(z, names, "z"), names, least).persist()
    s0 = sums.agg(F.sum("weight_sum").alias("s0"))
    if not names:
        return matrix.sparkSession.createDataFrame([], "variable_i string, variable_j string, moran_i double")
    rows = sums.drop("weight_sum").join(wide(z, names, "z"), "area")
    met = products(rows, names, [f"lag_{n}" for n in names], upper=True)
    name = lambda k: F.get(F.array(*[F.lit(n) for n in names]), F.col(k))
    return met.crossJoin(F.broadcast(s0)).select(name("i").alias("variable_i"), name("j").alias("variable_j"), F.try_divide("top", "s0").alias("moran_i"))


def products(rows: DataFrame, left: list[str], right: list[str], upper: bool = False) -> DataFrame:
    """i, j, top: the sum over all rows of left[i] * right[j]; only i <= j if ``upper``.

    Every task multiplies its rows as one matrix product and passes on the
    sums, so what is shuffled is pairs times tasks, whatever the number of
    rows.  A task holds one square of pairs: 50 MB for 2,500 variables.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(left), len(right)))
        for batch in batches:
            total += np.nan_to_num(batch[left].to_numpy(float)).T @ np.nan_to_num(batch[right].to_numpy(float))
        i, j = np.triu_indices(len(left), 0, len(right)) if upper else np.indices(total.shape).reshape(2, -1)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "top": total[i, j]})

    return rows.select(*left, *right).mapInPandas(run, "i int, j int, top double").groupBy("i", "j").agg(F.sum("top").alias("top"))


def moran(matrix: DataFrame, centroids: DataFrame, x: str, y: str, least: float = 1.0) -> DataFrame:
    """moran_i of one pair of variables."""
    both = matrix.where(F.col("variable").isin(x, y))
    found = moran_all_pairs(both, centroids, least)
    return found.where((F.col("variable_i") == min(x, y)) & (F.col("variable_j") == max(x, y))).select("moran_i")


def moran_static(matrix: DataFrame, centroids: DataFrame, x: str, y: str, least: float = 1.0) -> DataFrame:
    """i1 and i2 of the unhurried form.

    i1 doesn't centre the values: sum y(a) w(a,b) x(b) / (S0 sqrt(varY varX)).
    i2 as coded pairs both values of one area, so only row sums of the weights
    enter: sum zy(a) zx(a) w(a,.) / S0.
    """
    stats = matrix.where(F.col("variable").isin(x, y)).groupBy().agg(*[f(F.when(F.col("variable") == v, F.col("value"))).alias(f"{n}_{p}") for p, v in (("x", x), ("y", y)) for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])
    plain = matrix.where(F.col("variable").isin(x, y)).groupBy("area").agg(F.max(F.when(F.col("variable") == x, F.col("value"))).alias("x"), F.max(F.when(F.col("variable") == y, F.col("value"))).alias("y"))
    sums = spatial_sums(centroids, plain.select("area", "x"), ["x"], least)
    both = sums.join(plain, "area").crossJoin(F.broadcast(stats))
    zx, zy = F.try_divide(F.col("x") - F.col("mean_x"), F.col("sd_x")), F.try_divide(F.col("y") - F.col("mean_y"), F.col("sd_y"))
    s0 = F.sum("weight_sum")
    return both.agg(F.try_divide(F.sum(F.col("y") * F.col("lag_x")), s0 * F.max(F.col("sd_x") * F.col("sd_y"))).alias("i1"), F.try_divide(F.sum(zy * zx * F.col("weight_sum")), s0).alias("i2"))


def nearest(centroids: DataFrame, k: int) -> DataFrame:
    """area, neighbour, rank (1 to k), distance: the nearest other areas, ties by the neighbour's key.

    Exact.  Each task keeps the k best of a block of areas for its own rows, so
    k rows an area and block are shuffled.
    """
    spark = centroids.sparkSession
    rows = _deal(centroids.select("area", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).persist()
    kind = dict(rows.dtypes)["area"]
    found = None
    for block in [r.block for r in rows.select("block").distinct().collect()]:
        part = rows.where(F.col("block") == block).select("area", "x", "y").orderBy("area").toPandas()
        shared = spark.sparkContext.broadcast((part.area.to_numpy(), part[["x", "y"]].to_numpy(float)))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            keys, xy = shared.value
            for batch in batches:
                for at in range(0, len(batch), 256):
                    own = batch.iloc[at : at + 256]
                    dx, dy = own.x.to_numpy()[:, None] - xy[None, :, 0], own.y.to_numpy()[:, None] - xy[None, :, 1]
                    d = np.sqrt(dx * dx + dy * dy)
                    d[own.area.to_numpy()[:, None] == keys[None, :]] = np.inf
                    order = np.argsort(d, axis=1, kind="stable")[:, :k]
                    got = np.take_along_axis(d, order, axis=1)
                    take = np.isfinite(got)
                    yield pd.DataFrame({"area": np.repeat(own.area.to_numpy(), take.sum(axis=1)), "neighbour": keys[order[take]], "distance": got[take]})

        own = rows.select("area", "x", "y").repartition(max(8, spark.sparkContext.defaultParallelism)).mapInPandas(best, f"area {kind}, neighbour {kind}, distance double")
        found = own if found is None else found.union(own)
    if found is None:
        return spark.createDataFrame([], f"area {kind}, neighbour {kind}, rank int, distance double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("area").orderBy("distance", "neighbour")))
    return ranked.where(F.col("rank") <= k).select("area", "neighbour", "rank", "distance")


def knn_correlation(matrix: DataFrame, neighbours: DataFrame, x: str, y: str, k: int, as_coded: bool = False) -> DataFrame:
    """knn_corr of one pair: each area with itself at weight 1 and with its k neighbours in y at weight 1/2.

    As coded the neighbours' values are never read, which leaves the plain
    correlation times (n-1)/n whatever k is.
    """
    both = matrix.where(F.col("variable").isin(x, y))
    z = z_scores(both)
    zx, zy = z.where(F.col("variable") == x).select("area", F.col("z").alias("zx")), z.where(F.col("variable") == y).select("area", F.col("z").alias("zy"))
    own = zx.join(zy, "area").agg(F.sum(F.col("zx") * F.col("zy")).alias("own"), F.count(F.lit(1)).alias("n"))
    if as_coded:
        return own.select(F.try_divide("own", "n").alias("knn_corr"))
    far = neighbours.join(zx, "area").join(zy.select(F.col("area").alias("neighbour"), "zy"), "neighbour").agg(F.coalesce(F.sum(F.col("zx") * F.col("zy")), F.lit(0.0)).alias("far"))
    return own.crossJoin(F.broadcast(far)).select(F.try_divide(F.col("own") + 0.5 * F.col("far"), F.col("n") * (1 + 0.5 * k)).alias("knn_corr"))


def knn_all_pairs(matrix: DataFrame, neighbours: DataFrame, k: int) -> DataFrame:
    """variable_i, variable_j, knn_corr for all ordered pairs (the intended form isn't symmetric); every area has every variable."""
    z = z_scores(matrix).persist()
    names = sorted(r.variable for r in z.select("variable").distinct().collect())
    if not names:
        return matrix.sparkSession.createDataFrame([], "variable_i string, variable_j string, knn_corr double")
    own = wide(z, names, "z").persist()
    far = neighbours.select(F.col("area").alias("at"), F.col("neighbour").alias("area")).join(own, "area").groupBy("at").agg(*[F.sum(n).alias(f"far_{n}") for n in names]).withColumnRenamed("at", "area")
    rows = own.join(far, "area", "left").select(*names, *[(F.col(n) + 0.5 * F.coalesce(f"far_{n}", F.lit(0.0))).alias(f"pooled_{n}") for n in names])
    met = products(rows, names, [f"pooled_{n}" for n in names]).crossJoin(F.broadcast(own.agg(F.count(F.lit(1)).alias("n"))))
    name = lambda k: F.get(F.array(*[F.lit(n) for n in names]), F.col(k))
    return met.select(name("i").alias("variable_i"), name("j").alias("variable_j"), (F.col("top") / (F.col("n") * (1 + 0.5 * k))).alias("knn_corr"))
