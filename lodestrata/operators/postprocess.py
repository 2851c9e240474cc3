"""Cleaning and summing up the results of pair runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def right_shape(lines: DataFrame, fields: int, tag: str | None = None) -> DataFrame:
    """CSV lines (value) with just so many fields and, if asked, the tag as the first."""
    parts = F.split("value", ",", -1)
    rows = lines.where(F.size(parts) == fields)
    return rows.where(F.get(parts, F.lit(0)) == tag) if tag else rows


def without_blank_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.length("value") > 0)


def split_nan(pairs: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a number, rows without): null and NaN count as none."""
    v = F.col(value).try_cast("double")
    bad = v.isNull() | F.isnan(v)
    return pairs.where(~bad), pairs.where(bad)


def dedupe_pairs(pairs: DataFrame, a: list[str], b: list[str], order: list[str]) -> DataFrame:
    """The first row, in the given order, of each unordered pair of keys.

    An aggregate, not a window: a pair that occurs very often is reduced before
    the shuffle.
    """
    one, two = F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(a)]), F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(b)])
    rest = [c for c in pairs.columns if c not in order]
    first = F.min(F.struct(*order, *rest)).alias("first")
    return pairs.groupBy(F.least(one, two).alias("low"), F.greatest(one, two).alias("high")).agg(first).select(*[F.col(f"first.{c}").alias(c) for c in pairs.columns])


def not_done(pairs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that a log of finished ones doesn't hold."""
    return pairs.join(done.select(*keys).distinct(), keys, "left_anti")


def union_shards(shards: list[DataFrame]) -> DataFrame:
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out


def table_relationships(pairs: DataFrame) -> DataFrame:
    """table_i, table_j, mean, n, n_plus, n_minus over pairs (table_i, table_j, value) counted both ways."""
    both = pairs.select("table_i", "table_j", "value").union(pairs.select(F.col("table_j").alias("table_i"), F.col("table_i").alias("table_j"), "value"))
    return both.groupBy("table_i", "table_j").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0).alias("n_plus"), F.count_if(F.col("value") < 0).alias("n_minus"))


def relationship_matrix(relations: DataFrame) -> DataFrame:
    """The means as a square table with a column for each table."""
    names = [r.table_j for r in relations.select("table_j").distinct().orderBy("table_j").collect()]
    return relations.groupBy("table_i").pivot("table_j", names).agg(F.first("mean"))


def rows_per_table(pairs: DataFrame) -> DataFrame:
    """table, n: each row counts for both its tables."""
    return pairs.select(F.explode(F.array("table_i", "table_j")).alias("table")).groupBy("table").agg(F.count(F.lit(1)).alias("n"))


def distinct_variables(pairs: DataFrame, sides: list[str]) -> DataFrame:
    """n_variables: how many different variables stand on any side of the pairs; nulls don't count."""
    return pairs.select(F.explode(F.array(*sides)).alias("variable")).agg(F.count_distinct("variable").alias("n_variables"))


def session_throughput(log: DataFrame, by: list[str], order: str, clock: str, drop_ms: int = 30_000) -> DataFrame:
    """Sessions of a log with a running clock in milliseconds: n_rows and rate per second.

    A clock more than ``drop_ms`` below the one before starts a new session.
    Sessions are counted within each key of ``by``.
    """
    w = Window.partitionBy(*by).orderBy(order)
    fresh = F.coalesce((F.col(clock) < F.lag(clock).over(w) - drop_ms).cast("int"), F.lit(1))
    rows = log.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*by, "session").agg(F.count(F.lit(1)).alias("n_rows"), F.min(clock).alias("first_ms"), F.max(clock).alias("last_ms"))
    return out.withColumn("rate", F.try_divide(F.col("n_rows") * 1000.0, F.col("last_ms") - F.col("first_ms")))


def match_report(pairs: DataFrame, index: DataFrame, variables: DataFrame, most: float = 20.0) -> DataFrame:
    """Pairs of different maps (i, j, value) up to a distance, with the names and texts of both.

    index: map, variable; variables: variable, description.  Both are
    dimensions; adaptive execution broadcasts them if they are small.
    """
    named = index.join(variables, "variable", "left")
    side = lambda s: named.select(F.col("map").alias(s), F.col("variable").alias(f"variable_{s}"), F.col("description").alias(f"description_{s}"))
    return pairs.where("i <> j").where(F.col("value") <= most).join(side("i"), "i").join(side("j"), "j")
