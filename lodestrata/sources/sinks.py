"""Result files: graphs, matrices, maps and databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_xml


def _numbered(vertices: DataFrame, start: int) -> DataFrame:
    """id, no, label: vertices numbered in order of their ids, numbers by value and texts by letters."""
    from ..operators.graph import number_vertices

    names = number_vertices(vertices.select(F.col("id").alias("label")), start)
    return names.select(F.col("label").alias("id"), F.col("id").alias("no")).join(vertices.select("id", "label"), "id")


def _with_ends(edges: DataFrame, numbered: DataFrame) -> DataFrame:
    ends = numbered.select("id", "no")
    return edges.join(ends.select(F.col("id").alias("src"), F.col("no").alias("a")), "src").join(ends.select(F.col("id").alias("dst"), F.col("no").alias("b")), "dst")


def _lines(*parts: DataFrame) -> DataFrame:
    """Parts of (at, line) one after another, sorted within each."""
    out = None
    for k, p in enumerate(parts):
        rows = p.select(F.lit(k).alias("part"), F.col("at"), "line")
        out = rows if out is None else out.union(rows)
    return out.orderBy("part", "at", "line").select("line")


def _text(df: DataFrame, *lines: str) -> DataFrame:
    return df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("at", "line")).select(F.col("at").cast("long").alias("at"), "line")


def pajek(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a Pajek file: vertices numbered from 1 in order of id, no arcs, undirected edges."""
    v = _numbered(vertices, 1).persist()
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit("'")), F.lit('"'))
    head = v.agg(F.concat(F.lit("*Vertices "), F.count(F.lit(1)).cast("string")).alias("line")).withColumn("at", F.lit(0).cast("long"))
    label = F.col("label") if "label" in edges.columns else F.lit("")
    e = _with_ends(edges.withColumn("elabel", label), v).select(F.col("a").alias("at"), F.concat_ws(" ", "a", "b", F.col("weight").cast("string"), F.lit("l"), quote(F.col("elabel"))).alias("line"))
    return _lines(head, v.select(F.col("no").alias("at"), F.concat_ws(" ", "no", quote(F.col("label"))).alias("line")), _text(vertices, "*Arcs", "*Edges"), e)


def gexf(vertices: DataFrame, edges: DataFrame, creator: str = "lodestrata") -> DataFrame:
    """Lines of a GEXF 1.2 file: nodes numbered from 0 in order of id, labels escaped."""
    v = _numbered(vertices, 0).persist()
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), c, F.lit('"'))
    text = lambda c: escape_xml(F.coalesce(c.cast("string"), F.lit("")))
    nodes = v.select(F.col("no").alias("at"), F.concat(F.lit("<node"), attr("id", F.col("no").cast("string")), attr("label", text(F.col("label"))), F.lit(" />")).alias("line"))
    links = _with_ends(edges, v).select(F.col("a").alias("at"), F.concat(F.lit("<edge"), attr("id", F.concat_ws("-", "a", "b")), attr("source", F.col("a").cast("string")), attr("target", F.col("b").cast("string")), attr("weight", F.col("weight").cast("string")), F.lit(" />")).alias("line"))
    head = ('<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">', f"<meta><creator>{creator}</creator></meta>", '<graph mode="static" defaultedgetype="undirected">', "<nodes>")
    return _lines(_text(vertices, *head), nodes, _text(vertices, "</nodes>", "<edges>"), links, _text(vertices, "</edges>", "</graph>", "</gexf>"))


def distance_graph(pairs: DataFrame, threshold: float) -> DataFrame:
    """Edges of pairs (i, j, value) nearer than the threshold, i < j, weight 1/value."""
    return pairs.where((F.col("value") < threshold) & (F.col("i") < F.col("j"))).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.try_divide(F.lit(1.0), "value").alias("weight"))


def similarity_graph(cells: DataFrame, threshold: float) -> DataFrame:
    """Edges of cells (i, j, value) of the upper triangle that reach the threshold."""
    return cells.where((F.col("i") < F.col("j")) & (F.col("value") >= threshold)).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("value").alias("weight"))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file, in the order of the lines."""
    lines.coalesce(1).write.mode("overwrite").text(path)


def append_pairs(pairs: DataFrame, path: str, block: int = 100) -> None:
    """Add pair results to a Parquet log, partitioned by blocks of i so that a resumed run reads what it needs."""
    pairs.withColumn("i_block", F.floor(F.col("i") / block).cast("int")).write.mode("append").partitionBy("i_block").parquet(path)


def write_clean_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").csv(path, header=False)


def save_weights(weights: DataFrame, path: str) -> None:
    weights.select("y", "x", F.posexplode("weights").alias("j", "w")).write.mode("overwrite").parquet(path)


def load_weights(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path).groupBy("y", "x").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("own"))
    return rows.select("y", "x", F.transform("own", lambda s: s["w"]).alias("weights"))


def upload(table: DataFrame, url: str, name: str, key: str, mode: str = "append", **options: str) -> None:
    """A table to a database by JDBC: its key as text of 9 characters, numbers as real."""
    from ..operators.matrix import numeric_columns

    numbers = [c for c in numeric_columns(table) if c != key]
    kinds = f"`{key}` VARCHAR(9)" + "".join(f", `{c}` REAL" for c in numbers)
    rows = table.select(F.col(f"`{key}`").cast("string").alias(key), *[F.col(f"`{c}`").cast("float").alias(c) for c in numbers])
    rows.write.format("jdbc").options(url=url, dbtable=name, createTableColumnTypes=kinds, **options).mode(mode).save()


def map_records(rows: DataFrame, columns: list[str], base_url: str = "") -> DataFrame:
    """A record for each numeric column of each dataset (unique_key, title, data_uri): key <unique_key>_<n>, title, column and address."""
    each = rows.select("*", F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("n", "column"))
    key = F.concat_ws("_", "unique_key", F.col("n").cast("string"))
    return each.select(key.alias("map_key"), F.concat_ws(" ", "title", "column").alias("title"), "column", "data_uri", F.concat(F.lit(base_url), key, F.lit(".xml")).alias("descriptor_url"))


def descriptors(records: DataFrame, styles: DataFrame) -> DataFrame:
    """map_key and descriptor: an XML text with the column, its file and its colour classes (map_key, position, low, high, r, g, b)."""

    def tag(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), escape_xml(F.coalesce(value.cast("string"), F.lit(""))), F.lit(f"</{name}>"))

    one = F.concat(F.lit("<class>"), tag("low", F.col("low")), tag("high", F.col("high")), tag("colour", F.format_string("#%02x%02x%02x", "r", "g", "b")), F.lit("</class>"))
    classes = styles.groupBy("map_key").agg(F.array_sort(F.collect_list(F.struct("position", one.alias("text")))).alias("own"))
    body = F.array_join(F.transform(F.coalesce("own", F.array().cast("array<struct<position:int,text:string>>")), lambda s: s["text"]), "")
    return records.join(classes, "map_key", "left").select("map_key", F.concat(F.lit("<map>"), tag("title", F.col("title")), tag("column", F.col("column")), tag("data", F.col("data_uri")), F.lit("<classes>"), body, F.lit("</classes></map>")).alias("descriptor"))


def thumbnail_index(candidates: DataFrame, least: float = 0.8) -> DataFrame:
    """major, minor, data_uri, unique_key, title, column for geometries likely enough: major numbers files, minor their columns."""
    from pyspark.sql import Window

    rows = candidates.where(F.col("prob") >= least)
    major = F.dense_rank().over(Window.orderBy("data_uri")) - 1
    minor = F.row_number().over(Window.partitionBy("data_uri").orderBy("column")) - 1
    return rows.select(major.alias("major"), minor.alias("minor"), "data_uri", "unique_key", "title", "column")
