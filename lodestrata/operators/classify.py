"""Class breaks, colours and legends for maps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes of the public ColorBrewer schemes, with the end and middle colours of each.
SEQUENTIAL = {
    "Blues": ("#f7fbff", "#6baed6", "#08306b"), "BuGn": ("#f7fcfd", "#66c2a4", "#00441b"), "BuPu": ("#f7fcfd", "#8c96c6", "#4d004b"), "GnBu": ("#f7fcf0", "#7bccc4", "#084081"),
    "Greens": ("#f7fcf5", "#74c476", "#00441b"), "Greys": ("#ffffff", "#969696", "#000000"), "Oranges": ("#fff5eb", "#fd8d3c", "#7f2704"), "OrRd": ("#fff7ec", "#fc8d59", "#7f0000"),
    "PuBu": ("#fff7fb", "#74a9cf", "#023858"), "PuBuGn": ("#fff7fb", "#67a9cf", "#014636"), "PuRd": ("#f7f4f9", "#df65b0", "#67001f"), "Purples": ("#fcfbfd", "#9e9ac8", "#3f007d"),
    "RdPu": ("#fff7f3", "#f768a1", "#49006a"), "Reds": ("#fff5f0", "#fb6a4a", "#67000d"), "YlGn": ("#ffffe5", "#78c679", "#004529"), "YlGnBu": ("#ffffd9", "#41b6c4", "#081d58"),
    "YlOrBr": ("#ffffe5", "#fe9929", "#662506"), "YlOrRd": ("#ffffcc", "#fd8d3c", "#800026"),
}
DIVERGING = {
    "BrBG": ("#543005", "#f5f5f5", "#003c30"), "PiYG": ("#8e0152", "#f7f7f7", "#276419"), "PRGn": ("#40004b", "#f7f7f7", "#00441b"), "PuOr": ("#7f3b08", "#f7f7f7", "#2d004b"), "RdBu": ("#67001f", "#f7f7f7", "#053061"),
    "RdGy": ("#67001f", "#ffffff", "#1a1a1a"), "RdYlBu": ("#a50026", "#ffffbf", "#313695"), "RdYlGn": ("#a50026", "#ffffbf", "#006837"), "Spectral": ("#9e0142", "#ffffbf", "#5e4fa2"),
}
QUALITATIVE = {
    "Accent": "#7fc97f #beaed4 #fdc086 #ffff99 #386cb0 #f0027f #bf5b17 #666666", "Dark2": "#1b9e77 #d95f02 #7570b3 #e7298a #66a61e #e6ab02 #a6761d #666666",
    "Paired": "#a6cee3 #1f78b4 #b2df8a #33a02c #fb9a99 #e31a1c #fdbf6f #ff7f00 #cab2d6 #6a3d9a #ffff99 #b15928", "Pastel1": "#fbb4ae #b3cde3 #ccebc5 #decbe4 #fed9a6 #ffffcc #e5d8bd #fddaec #f2f2f2",
    "Pastel2": "#b3e2cd #fdcdac #cbd5e8 #f4cae4 #e6f5c9 #fff2ae #f1e2cc #cccccc", "Set1": "#e41a1c #377eb8 #4daf4a #984ea3 #ff7f00 #ffff33 #a65628 #f781bf #999999",
    "Set2": "#66c2a5 #fc8d62 #8da0cb #e78ac3 #a6d854 #ffd92f #e5c494 #b3b3b3", "Set3": "#8dd3c7 #ffffb3 #bebada #fb8072 #80b1d3 #fdb462 #b3de69 #fccde5 #d9d9d9 #bc80bd #ccebc5 #ffed6f",
}
GROUPS = (("sequential", SEQUENTIAL), ("diverging", DIVERGING), ("qualitative", QUALITATIVE))


def find_scheme(code: str) -> tuple[str, object] | None:
    """(group, colours) of a named scheme, looked for in that order; None if there is none."""
    return next(((group, own[code]) for group, own in GROUPS if code in own), None)


def _rgb(text: str) -> tuple[int, int, int]:
    return tuple(int(text[k : k + 2], 16) for k in (1, 3, 5))


def colours(code: str, n: int) -> list[tuple[int, int, int]]:
    """n colours of a scheme: interpolated between its ends and middle, or the first n of a qualitative one, black beyond."""
    found = find_scheme(code)
    if found is None:
        return [(0, 0, 0)] * n
    group, own = found
    if group == "qualitative":
        listed = [_rgb(c) for c in own.split()]
        return (listed + [(0, 0, 0)] * n)[:n]
    points = [_rgb(c) for c in own]
    out = []
    for k in range(n):
        at = 2 * k / (n - 1) if n > 1 else 1.0
        i = min(int(at), 1)
        out.append(tuple(round(a + (b - a) * (at - i)) for a, b in zip(points[i], points[i + 1], strict=True)))
    return out


def scheme_table(spark, n: int = 9) -> DataFrame:
    """group_name, code, position, r, g, b of all schemes."""
    rows = [(group, code, k, *rgb) for group, own in GROUPS for code in own for k, rgb in enumerate(colours(code, n))]
    return spark.createDataFrame(rows, "group_name string, code string, position int, r int, g int, b int")


def quantile_breaks(df: DataFrame, value: str, classes: int = 5, missing: float | None = None) -> DataFrame:
    """position (0 to classes) and break: smallest value, interpolated quantiles, largest value."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)) if missing is None else df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v - missing) > 1.4e-45))
    at = F.array(*[F.lit(k / classes) for k in range(classes + 1)])
    return rows.agg(F.percentile(v, at).alias("b")).where("b is not null").select(F.posexplode("b").alias("position", "break"))


def breaks_array(df: DataFrame, value: str, classes: int = 5) -> DataFrame:
    """One row: breaks, an array, nudged so that no two are equal."""
    rows = quantile_breaks(df, value, classes)
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "break"))), lambda s: s["break"]).alias("breaks")).select(nudge(F.col("breaks")).alias("breaks"))


def nudge(breaks: Column) -> Column:
    """Each break that equals the one before it grows by 3e-8 of its size."""

    def step(acc: Column, b: Column) -> Column:
        return F.array_append(acc, F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == b), b + F.abs(b) * 3e-8).otherwise(b))

    return F.aggregate(breaks, F.array().cast("array<double>"), step)


def assign_classes(df: DataFrame, value: str, breaks: DataFrame) -> DataFrame:
    """df with class: how many inner breaks the value reaches, from 0; the largest value is in the last class."""
    inner = F.slice("breaks", F.lit(2), F.greatest(F.size("breaks") - 2, F.lit(0)))
    return df.crossJoin(F.broadcast(breaks)).withColumn("class", F.size(F.filter(inner, lambda b: F.col(value) >= b))).drop("breaks")


def legend(breaks: DataFrame) -> DataFrame:
    """position, legend: the text of each class, from one row of breaks."""
    number = lambda c: F.format_string("%.4f", c)
    each = breaks.select("breaks", F.posexplode("breaks").alias("position", "low"), F.size("breaks").alias("n"))
    high = F.get("breaks", F.col("position") + 1)
    text = (
        F.when(F.col("position") == 0, F.concat(number(F.col("low")), F.lit(" (min) <= x < "), number(high)))
        .when(F.col("position") == F.col("n") - 1, F.concat(F.lit("x = "), number(F.col("low")), F.lit(" (max)")))
        .otherwise(F.concat(number(F.col("low")), F.lit(" <= x < "), number(high)))
    )
    return each.select("position", text.alias("legend"))


def natural_breaks(values: np.ndarray, counts: np.ndarray, classes: int, most: int = 1 << 20) -> list[float]:
    """Upper bounds of the classes with the least squared distance to their means, for sorted distinct values.

    Exact: best[k][j] = min over i of best[k-1][i] + cost(i, j), the minimising
    i not falling as j grows, so each row is filled by halving.  The middles
    of one depth are filled together, about ``most`` candidates at a time.
    """
    n = len(values)
    classes = min(classes, n)
    if not n:
        return []
    # Sums run outwards from the median, so that extreme values leave the digits of all others alone.
    mid = n // 2
    v = values - values[mid]

    def sums(x):
        return np.concatenate((-np.cumsum(x[:mid][::-1])[::-1], [0.0], np.cumsum(x[mid:])))

    w, s, q = sums(counts.astype(float)), sums(counts * v), sums(counts * v * v)

    def cost(i, j):
        d = w[j] - w[i]
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / np.where(d > 0, d, 1)

    best = cost(np.zeros(n + 1, int), np.arange(n + 1))
    cut = []
    for k in range(1, classes):
        now, at = np.full(n + 1, math.inf), np.zeros(n + 1, np.int64)
        work = np.array([[k + 1, n, k, n - 1]])
        while len(work):
            lo, hi, left, right = work.T
            middle = (lo + hi) // 2
            size = np.minimum(right, middle - 1) - left + 1
            ends = np.cumsum(size)
            first = 0
            while first < len(work):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
                m, z = middle[first:last], size[first:last]
                starts = np.concatenate(([0], np.cumsum(z)[:-1]))
                i = np.arange(z.sum()) - np.repeat(starts - left[first:last], z)
                c = best[i] + cost(i, np.repeat(m, z))
                least = np.minimum.reduceat(c, starts)
                hits = np.flatnonzero(c == np.repeat(least, z))
                at[m], now[m] = i[hits[np.searchsorted(hits, starts)]], least
                first = last
            halves = np.concatenate((np.stack((lo, middle - 1, left, at[middle]), axis=1), np.stack((middle + 1, hi, at[middle], right), axis=1)))
            work = halves[halves[:, 0] <= halves[:, 1]]
            work = work[np.argsort(work[:, 0])]
        best = now
        cut.append(at)
    ends, j = [n], n
    for at in reversed(cut):
        j = at[j]
        ends.append(j)
    return [float(values[e - 1]) for e in reversed(ends) if e]


def jenks_breaks(df: DataFrame, value: str, classes: int = 5, most: int = 1 << 20) -> DataFrame:
    """position (from 0) and upper bound of each natural class, exact at every size.

    Values are first counted by Spark, so that equal ones are one row.  The
    distinct values meet in one task, as each break depends on all of them:
    some 250 bytes each there.  ``most`` bounds what that task works on beside
    them at once; it doesn't change the result.
    """
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).where("v is not null").where(~F.isnan("v"))
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            own = pd.concat(parts).sort_values("v", ignore_index=True)
            bounds = natural_breaks(own.v.to_numpy(), own.n.to_numpy(), classes, most)
            yield pd.DataFrame({"position": range(len(bounds)), "upper": bounds})

    return counts.repartition(1).mapInPandas(solve, "position int, upper double")


def style(df: DataFrame, value: str, sequential: str = "YlGn", discrete: str = "Set3", classes: int = 5) -> DataFrame:
    """position, low, high, r, g, b: a colour for each value of a discrete column, else for each quantile class."""
    from .stats import discrete_values

    spark = df.sparkSession
    values = [r.value for r in discrete_values(df, value).orderBy("value").collect()]
    if values:
        rows = [(k, v, v, *rgb) for k, (v, rgb) in enumerate(zip(values, colours(discrete, len(values)), strict=True))]
    else:
        found = breaks_array(df, value, classes).first()
        b = found.breaks or []
        rows = [(k, b[k], b[k + 1], *rgb) for k, rgb in enumerate(colours(sequential, max(len(b) - 1, 0)))]
    return spark.createDataFrame(rows, "position int, low double, high double, r int, g int, b int")


def choose_geometry(candidates: DataFrame, hints: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The likeliest geometry of each dataset (name, prob, ...): ties of the two best are settled by the hints' factors.

    Without ``by`` the whole table is one dataset.
    """
    from pyspark.sql import Window

    part = Window.partitionBy(*(by or [F.lit(0)]))
    ranked = candidates.withColumn("rank", F.row_number().over(part.orderBy(F.desc("prob"), "name")))
    top = ranked.withColumn("first", F.max(F.when(F.col("rank") == 1, F.col("prob"))).over(part)).withColumn("second", F.max(F.when(F.col("rank") == 2, F.col("prob"))).over(part))
    tied = F.coalesce(F.abs(F.col("first") - F.col("second")) <= 1.4e-45, F.lit(False))
    scored = top.join(hints.select("name", "factor"), "name", "left").withColumn("score", F.when(tied, F.col("prob") * F.coalesce("factor", F.lit(1.0))).otherwise(F.col("prob")))
    return scored.withColumn("place", F.row_number().over(part.orderBy(F.desc("score"), F.desc("prob"), "name"))).where("place = 1").select(*candidates.columns, "score")


def set_hint(hints: DataFrame, name: str, factor: float) -> DataFrame:
    """hints with one factor added or replaced."""
    return hints.where(F.col("name") != name).union(hints.sparkSession.createDataFrame([(name, float(factor))], "name string, factor double"))


def extent(boxes: DataFrame) -> DataFrame:
    """Longitude and latitude range of boxes (min_x, min_y, max_x, max_y) in spherical Mercator metres."""
    radius = 6378137.0
    lon = lambda x: F.degrees(x / radius)
    lat = lambda y: F.degrees(2 * F.atan(F.exp(y / radius)) - math.pi / 2)
    all_ = boxes.agg(F.min("min_x").alias("a"), F.min("min_y").alias("b"), F.max("max_x").alias("c"), F.max("max_y").alias("d"))
    return all_.select(lon(F.col("a")).alias("min_lon"), lat(F.col("b")).alias("min_lat"), lon(F.col("c")).alias("max_lon"), lat(F.col("d")).alias("max_lat"))


def square_box(boxes: DataFrame) -> DataFrame:
    """Each box made square around its centre, as wide as its longer side."""
    half = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) / 2
    x, y = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    return boxes.withColumns({"min_x": x - half, "max_x": x + half, "min_y": y - half, "max_y": y + half})
