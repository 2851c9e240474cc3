"""Catalogue files and their semantic schema."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ROLES = ("Ignore", "Text", "Link", "Title", "Description", "Tags", "UniqueKey")


@dataclass
class SemanticSchema:
    """Which column of a catalogue plays which role; a role's first column counts."""

    fields: list[tuple[str, str]] = field(default_factory=list)

    def add(self, name: str, role: str) -> SemanticSchema:
        if role not in ROLES:
            raise ValueError(f"unknown role {role}")
        self.fields.append((name, role))
        return self

    def column(self, role: str) -> str | None:
        return next((n for n, r in self.fields if r == role), None)

    def project(self, catalogue: DataFrame) -> DataFrame:
        """link, title, description, tags and unique_key of every row; null for a role without a column."""
        names = {"link": "Link", "title": "Title", "description": "Description", "tags": "Tags", "unique_key": "UniqueKey"}
        have = set(catalogue.columns)

        def pick(role: str) -> Column:
            name = self.column(role)
            return F.col(f"`{name}`") if name in have else F.lit(None).cast("string")

        return catalogue.select(*[pick(role).alias(out) for out, role in names.items()])


class CatalogueReader(Protocol):
    def read(self, spark: SparkSession, path: str) -> DataFrame: ...


def unique_headers(names: list[str]) -> list[str]:
    """Repeated names get -2, -3 and so on."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}-{seen[n]}")
    return out


def split_fields(line: str) -> list[str]:
    """Fields of one record: a quote anywhere starts or ends quoting and vanishes, fields are trimmed."""
    out, now, quoted = [], [], False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append("".join(now).strip())
            now = []
        else:
            now.append(c)
    return [*out, "".join(now).strip()]


def records(text: str, line_end: str = "\n") -> Iterator[str]:
    """Records of a file: they end at the line end outside quotes; a line that is just a backslash joins its neighbours.

    The last record counts even without a line end.
    """
    text = text.removeprefix("﻿")
    if line_end == "\n":
        text = text.replace("\r\n", "\n")
        while "\n\\\n" in text:
            text = text.replace("\n\\\n", " ")
    start, quoted = 0, False
    for at, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif c == line_end and not quoted:
            yield text[start:at]
            start = at + 1
    if start < len(text):
        yield text[start:]


@dataclass
class CsvCatalogue:
    """Catalogues with headers as CSV; every column is a string.

    Short rows are filled with nulls, rows wider than the header are dropped.
    Files are read whole, one by one on the executors (catalogues are small;
    a folder of many is spread over tasks); for large plain files use
    spark.read.csv.
    """

    line_end: str = "\n"

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        files = spark.read.text(path, wholetext=True)
        first = files.select(F.regexp_replace("value", "^﻿", "").alias("v")).first()
        if first is None or not first.v:
            return spark.createDataFrame([], StructType([]))
        names = unique_headers(split_fields(next(records(first.v, self.line_end))))
        width, line_end = len(names), self.line_end

        def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for text in batch["value"]:
                    rows = [split_fields(r) for k, r in enumerate(records(text, line_end)) if k and r.strip()]
                    rows = [r + [None] * (width - len(r)) for r in rows if len(r) <= width]
                    yield pd.DataFrame(rows, columns=names, dtype=object)

        return files.mapInPandas(parse, StructType([StructField(n, StringType()) for n in names]))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """A large catalogue with ordinary quoting, in parallel by Spark's reader."""
    raw = spark.read.csv(path, header=False, multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return spark.read.csv(path, header=True, multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).toDF(*unique_headers([x or "" for x in raw.first()])) if raw.columns else raw


def headers(spark: SparkSession, path: str) -> list[str] | None:
    """The column names of a CSV file, split as its rows are; None if there is no such file."""
    try:
        line = spark.read.text(path).first()
    except AnalysisException:  # a file that isn't there has no headers; any other error is raised
        return None
    return None if line is None else unique_headers(split_fields(line.value.removeprefix("﻿")))


def counts(rows: DataFrame) -> DataFrame:
    """One row: datasets, and how many links are CSV files, archives and HTML pages."""
    link = F.lower(F.coalesce("link", F.lit("")))
    return rows.agg(
        F.count(F.lit(1)).alias("n_datasets"),
        F.count_if(F.endswith(link, F.lit(".csv"))).alias("n_csv"),
        F.count_if(F.endswith(link, F.lit(".zip")) | F.endswith(link, F.lit(".gz"))).alias("n_zip"),
        F.count_if(F.endswith(link, F.lit(".html"))).alias("n_html"),
        F.count_if(link == "").alias("n_blank"),
    )


def with_link(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce("link", F.lit("")) != "")


def join_resources(datasets: DataFrame, resources: DataFrame, key: str, resource_key: str, url: str) -> DataFrame:
    """datasets with the links of their resources gathered in order, null where there are none."""
    links = resources.groupBy(F.col(resource_key).alias("_key")).agg(F.array_sort(F.collect_list(url)).alias("links"))
    return datasets.join(links, F.col(key) == F.col("_key"), "left").drop("_key")


#: The stores known here: roles of their columns and how files are chosen.
STORES = {
    "census": (SemanticSchema([("TableName", "UniqueKey"), ("Description", "Title"), ("oaurl", "Link")]), ("pattern", "DATA.CSV"), {"OA": 0.1, "OA_2011": 2.0}),
    "portal": (SemanticSchema([("Title", "Title"), ("Tags", "Tags"), ("Description", "Description"), ("URL2", "Link"), ("Name", "UniqueKey")]), ("largest", None), {}),
    "city": (SemanticSchema([("TITLE", "Title"), ("LONGDESC", "Description"), ("CSV_URL", "Link")]), ("largest", None), {}),
}


def read_numeric_column(spark: SparkSession, path: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(value rows, warnings) of one column of a CSV file: cells that aren't numbers are warned of with their text.

    Only the named column is parsed.  A column that isn't there raises KeyError.
    """
    table = spark.read.csv(path, header=True, mode="PERMISSIVE")
    if column not in table.columns:
        raise KeyError(column)
    rows = table.select(F.trim(F.col(f"`{column}`")).alias("raw")).withColumn("value", F.col("raw").try_cast("double"))
    return rows.where("value is not null"), rows.where("value is null").select("raw")


def read_keyed_column(spark: SparkSession, path: str, key: str, column: str) -> DataFrame:
    """area and value of two columns of a CSV file; the file's null marker is two dots."""
    table = spark.read.csv(path, header=True, nullValue="..")
    return table.select(F.col(f"`{key}`").alias("area"), F.col(f"`{column}`").try_cast("double").alias("value"))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    word = F.trim(F.regexp_replace("value", "﻿", ""))
    return spark.read.text(path).select(word.alias("word")).where("word <> ''").distinct()


def read_geometry(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database by JDBC; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def centroids_of(polygons: DataFrame, area: str, wkt: str) -> DataFrame:
    """area, x, y from polygons as well-known text: centre of mass of the outer rings, or mean point of degenerate ones.

    Repeated areas are kept; matrix.check_keys() finds them.
    """

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["wkt"]:
                total = sx = sy = 0.0
                points: list[tuple[float, float]] = []
                body = (text or "").partition("(")[2]
                for poly in body.split(")),") if body else []:
                    ring = [tuple(map(float, p.split()[:2])) for p in poly.replace("(", " ").split(")")[0].split(",") if p.strip()]
                    points += ring
                    for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
                        cross = x0 * y1 - x1 * y0
                        total, sx, sy = total + cross, sx + (x0 + x1) * cross, sy + (y0 + y1) * cross
                if total:
                    out.append((sx / (3 * total), sy / (3 * total)))
                elif points:
                    out.append((sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)))
                else:
                    out.append((None, None))
            yield pd.DataFrame({"area": batch["area"], "x": [p[0] for p in out], "y": [p[1] for p in out]})

    rows = polygons.select(F.col(area).alias("area"), F.col(wkt).alias("wkt"))
    return rows.mapInPandas(centre, StructType([rows.schema["area"]]).add("x", "double").add("y", "double"))


def read_pdf_text(spark: SparkSession, path: str) -> DataFrame:
    """path and text of PDF files, where a PDF library is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf; give the text as a table instead") from e

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch.path, "text": ["".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(c)).pages) for c in batch.content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(extract, "path string, text string")
