"""Running statistics, column profiles, and comparison of matrices cell by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- populations -----------------------------------------------------------


def running_stat(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, and sample variance and deviation; both are 0 for fewer than two values."""
    v = F.col(value)
    return df.groupBy(*(by or [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std_dev"))


def combine_means(na: Column, mean_a: Column, nb: Column, mean_b: Column) -> Column:
    return F.try_divide(na * mean_a + nb * mean_b, na + nb)


def combine_variances(na: Column, mean_a: Column, var_a: Column, nb: Column, mean_b: Column, var_b: Column, mean: Column) -> Column:
    """Population variance of two groups together, around their common mean."""
    return F.try_divide(na * (var_a + F.pow(mean_a - mean, 2)) + nb * (var_b + F.pow(mean_b - mean, 2)), na + nb)


def combine_std_devs(na: Column, mean_a: Column, sd_a: Column, nb: Column, mean_b: Column, sd_b: Column, mean: Column) -> Column:
    return F.sqrt(combine_variances(na, mean_a, sd_a * sd_a, nb, mean_b, sd_b * sd_b, mean))


def merge_populations(parts: DataFrame, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Rows (n, mean, variance) of parts merged: mean and sample variance of all values.

    Exact by sums of squares; ``exact=False`` weighs the sample variances by n
    as if they were population variances, which is not exact.
    """
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    square = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    within = F.sum((F.col("n") - 1) * F.col("variance")) if exact else F.sum(F.col("n") * F.col("variance"))
    variance = F.when(n > 1, (within + square) / (n - 1 if exact else n)).otherwise(0.0)
    return parts.where("n > 0").groupBy(*(by or [])).agg(n.alias("n"), mean.alias("mean"), F.greatest(variance, F.lit(0.0)).alias("variance"))


# --- one column ------------------------------------------------------------


def column_profile(df: DataFrame, column: str, discrete_below: int = 12) -> DataFrame:
    """One row on a column of numbers or text: rows, valid and invalid values, range, and whether it is discrete.

    A column is discrete if its valid values are spelt in fewer than
    ``discrete_below`` ways.
    """
    raw = F.trim(F.col(column).cast("string"))
    value = raw.try_cast("double")
    valid = value.isNotNull() & ~F.isnan(value)
    n = F.count_if(valid)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        n.alias("n_valid"),
        (F.count(F.lit(1)) - n).alias("n_invalid"),
        F.min(F.when(valid, value)).alias("min_value"),
        F.max(F.when(valid, value)).alias("max_value"),
        F.count_distinct(F.when(valid, raw)).alias("n_distinct"),
        (F.count_distinct(F.when(valid, raw)) < discrete_below).alias("is_discrete"),
    )


def discrete_values(df: DataFrame, column: str, discrete_below: int = 12) -> DataFrame:
    """The distinct values of a discrete column; no rows for a continuous one.

    Only the smallest ``discrete_below`` distinct values are ever brought together.
    """
    values = df.select(F.col(column).cast("double").alias("value")).where("value is not null").distinct()
    few = values.orderBy("value").limit(discrete_below)
    n = few.agg(F.count(F.lit(1)).alias("n"))
    return few.crossJoin(F.broadcast(n)).where(F.col("n") < discrete_below).select("value")


def equal_width_histogram(df: DataFrame, column: str, n: int) -> DataFrame:
    """bucket (0 to n-1) and n_values: n equal ranges from the smallest to the largest value, which counts in the last.

    Buckets without values are listed too; a constant column fills bucket 0.
    """
    v = F.col("v")
    values = df.select(F.col(column).cast("double").alias("v")).where(v.isNotNull() & ~F.isnan("v"))
    ends = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    at = F.coalesce(F.floor(F.try_divide((v - F.col("low")) * n, F.col("high") - F.col("low"))), F.lit(0))
    counts = values.crossJoin(F.broadcast(ends)).groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n_values"))
    spine = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(counts, "bucket", "left").select("bucket", F.coalesce("n_values", F.lit(0)).alias("n_values"))


# --- two matrices ----------------------------------------------------------


def cells(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Cells of two sparse matrices side by side as x and y; an absent cell is 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return a.select(*keys, F.col(value).cast("double").alias("x")).join(b.select(*keys, F.col(value).cast("double").alias("y")), keys, "full").select(*keys, zero("x"), zero("y"))


def compare(xy: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All comparison statistics of the columns x and y in one pass.

    Cells with a zero are skipped where a ratio is taken, but averages divide by
    all cells.  Dice divides by the sum of y, percent differences by x.
    Correlation is null where either side is constant.
    """
    x, y, n = F.col("x"), F.col("y"), F.count(F.lit(1))
    both = (x != 0) & (y != 0)
    over = lambda value: F.coalesce(F.sum(F.when(both, value)), F.lit(0.0))
    ratio, percent = over(F.try_divide(x, y)), over(F.try_divide(F.abs(x - y), x))
    varies = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    correlation = F.when(varies, F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")))
    return xy.groupBy(*(by or [])).agg(
        n.alias("n_cells"),
        F.avg("x").alias("mean_x"),
        F.avg("y").alias("mean_y"),
        F.stddev_pop("x").alias("sd_x"),
        F.stddev_pop("y").alias("sd_y"),
        correlation.alias("correlation"),
        F.sqrt(F.avg(F.pow(x - y, 2))).alias("rmse"),
        F.sqrt(over(F.try_divide(F.pow(x - y, 2), x))).alias("chi_squared"),
        F.try_divide(F.sum(F.least("x", "y")), F.sum("y")).alias("dice"),
        F.try_divide(F.sum(F.least("x", "y")), F.sum(F.greatest("x", "y"))).alias("jaccard"),
        ratio.alias("sum_of_ratios"),
        (ratio / n).alias("average_ratio"),
        F.sum(F.abs(x - y)).alias("absolute_difference"),
        F.avg(F.abs(x - y)).alias("average_absolute_difference"),
        percent.alias("absolute_percent_difference"),
        (percent / n).alias("average_percent_difference"),
    )


def entropy(df: DataFrame, value: str) -> DataFrame:
    """-sum p log10 p over p = value / total; values of zero are skipped."""
    v = F.col(value).cast("double")
    total = df.agg(F.sum(v).alias("total"))
    p = F.try_divide(v, F.col("total"))
    return df.crossJoin(F.broadcast(total)).where(p > 0).agg(F.coalesce(-F.sum(p * F.log10(p)), F.lit(0.0)).alias("entropy"))


def information_difference(xy: DataFrame) -> DataFrame:
    """sum px log10 |px / py| over shares of the totals, skipping cells with a zero."""
    total = xy.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    px, py = F.try_divide(F.col("x"), F.col("sx")), F.try_divide(F.col("y"), F.col("sy"))
    term = F.when((px != 0) & (py != 0), px * F.log10(F.abs(F.try_divide(px, py))))
    return xy.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("information_difference"))


def without_missing(df: DataFrame, value: str, missing: float) -> DataFrame:
    """Rows whose value isn't the one that marks a missing value."""
    return df.where(F.abs(F.col(value) - F.lit(missing)) > 1.4e-45)


def nan_to_zero(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn(value, F.nanvl(F.col(value).cast("double"), F.lit(0.0)))
