"""The variable by area matrix: building it, and reading pair results as matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]


def melt(df: DataFrame, area: str, variables: list[str] | None = None) -> DataFrame:
    """A table with a column for each variable as rows (area, variable, value).  Text is read as numbers where it is one."""
    names = variables if variables is not None else [c for c in numeric_columns(df) if c != area]
    values = [F.struct(F.lit(n).alias("variable"), F.col(n).try_cast("double").alias("value")) for n in names]
    return df.select(F.col(area).alias("area"), F.explode(F.array(*values)).alias("v")).select("area", "v.variable", "v.value").where("value is not null")


def build(areas: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """The dense matrix (area, variable, value): every area with every variable, 0 where a table has no value.

    Raises no error on unknown areas but leaves them out; a repeated area in a
    table is an error of the data and shows in check_keys().
    """
    long = tables[0]
    for t in tables[1:]:
        long = long.unionByName(t)
    names = [r.variable for r in long.select("variable").distinct().orderBy("variable").collect()]  # columns of tables
    spine = areas.select("area").distinct().select("area", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("variable"))
    return spine.join(long, ["area", "variable"], "left").select("area", "variable", F.coalesce("value", F.lit(0.0)).alias("value"))


def check_keys(table: DataFrame, area: str = "area") -> DataFrame:
    """Area keys that occur more than once in a keyed column, which must be unique."""
    return table.groupBy(area).count().where("count > 1")


def correlations(matrix: DataFrame) -> DataFrame:
    """Pearson correlation of all pairs variable_i <= variable_j over the areas they share."""
    other = matrix.select("area", F.col("variable").alias("variable_j"), F.col("value").alias("y"))
    met = matrix.select("area", F.col("variable").alias("variable_i"), F.col("value").alias("x")).join(other, "area").where("variable_i <= variable_j")
    out = met.groupBy("variable_i", "variable_j").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return out.select("variable_i", "variable_j", F.try_divide("c", F.col("sx") * F.col("sy")).alias("correlation"))


def from_moran_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells i, j, value) and (names i, name) from pair rows (row_no, name_i, name_j, value).

    Names are numbered by where they first stand as name_j.  Rows without a
    number as value are skipped.  One triangle is filled, as the rows have it.
    """
    pairs = pairs.select("row_no", "name_i", "name_j", "value")
    first = pairs.groupBy(F.col("name_j").alias("name")).agg(F.min("row_no").alias("first"))
    names = first.select((F.row_number().over(Window.orderBy("first", "name")) - 1).alias("i"), "name")
    value = F.col("value").try_cast("double")
    cells = pairs.where(value.isNotNull() & ~F.isnan(value)).join(names.select(F.col("i"), F.col("name").alias("name_i")), "name_i").join(names.select(F.col("i").alias("j"), F.col("name").alias("name_j")), "name_j")
    return cells.groupBy("i", "j").agg(F.max_by(value, "row_no").alias("value")), names


def from_knn_pairs(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from rows (row_no, i, j, name_i, name_j, value) that bring their numbers: filled both ways, the last row wins.

    Numbers from 0 to the largest without a name are called Missing_<i>; cells
    that no row fills are 0 and left out here.
    """
    value = F.col("value").try_cast("double")
    rows = pairs.where(value.isNotNull())
    both = rows.select("row_no", "i", "j", value.alias("value")).union(rows.select("row_no", F.col("j").alias("i"), F.col("i").alias("j"), value.alias("value")))
    cells = both.groupBy("i", "j").agg(F.max_by("value", "row_no").alias("value"))
    named = pairs.select("i", F.col("name_i").alias("name"), "row_no").union(pairs.select("j", "name_j", "row_no")).groupBy("i").agg(F.max_by("name", "row_no").alias("name"))
    spine = pairs.agg(F.max(F.greatest("i", "j")).alias("top")).where("top is not null").select(F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("i"))
    return cells, spine.join(named, "i", "left").select("i", F.coalesce("name", F.concat(F.lit("Missing_"), F.col("i").cast("string"))).alias("name"))


def symmetric(cells: DataFrame) -> DataFrame:
    return cells.union(cells.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))


def matrix_image(cells: DataFrame) -> DataFrame:
    """Pixels (x, y, r, g, b): red for positive and blue for negative values, clamped at 1; NaN is white."""
    v = F.greatest(F.least(F.col("value").cast("double"), F.lit(1.0)), F.lit(-1.0))
    bright = F.floor(F.abs(v) * 255).cast("int")
    nan = F.isnan("value")
    return cells.select(
        F.col("i").alias("x"),
        F.col("j").alias("y"),
        F.when(nan, 255).when(v > 0, bright).otherwise(0).alias("r"),
        F.when(nan, 255).otherwise(0).alias("g"),
        F.when(nan, 255).when(v < 0, bright).otherwise(0).alias("b"),
    )


def grey_image(cells: DataFrame) -> DataFrame:
    """Pixels (x, y, grey): the value cut to a whole number from 0 to 255."""
    return cells.select(F.col("i").alias("x"), F.col("j").alias("y"), F.greatest(F.least(F.col("value").cast("int"), F.lit(255)), F.lit(0)).alias("grey"))
