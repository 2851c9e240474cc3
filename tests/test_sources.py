import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph
from lodestrata.sources import catalogue, files, sinks
from lodestrata.streaming import pairs


def test_fields():
    assert catalogue.split_fields('1,"a, b",x,') == ["1", "a, b", "x", ""]
    assert catalogue.split_fields('mid"quo"te," x "') == ["midquote", "x"]
    assert catalogue.unique_headers(["A", "A", "B", "A"]) == ["A", "A-2", "B", "A-3"]


def test_records():
    assert list(catalogue.records('a\r\n"b\nc"\nlast')) == ["a", '"b\nc"', "last"]
    assert list(catalogue.records("one\n\\\ntwo\n")) == ["one two"]
    assert list(catalogue.records('a,"x\ny"\rb\r', "\r")) == ['a,"x\ny"', "b"]


def test_catalogue(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('﻿Name,Title,URL,Title\nn1,"T, one",http://x/a.csv,t2\nshort\nn3,a,b,c,too wide\nn4,,http://x/b.zip,\n', "utf-8")
    df = catalogue.CsvCatalogue().read(spark, str(p))
    assert df.columns == ["Name", "Title", "URL", "Title-2"]
    assert [tuple(r) for r in df.collect()] == [("n1", "T, one", "http://x/a.csv", "t2"), ("short", None, None, None), ("n4", "", "http://x/b.zip", "")]
    schema = catalogue.SemanticSchema().add("Name", "UniqueKey").add("Title", "Title").add("URL", "Link").add("Gone", "Tags")
    rows = schema.project(df)
    assert rows.columns == ["link", "title", "description", "tags", "unique_key"]
    assert [r.tags for r in rows.collect()] == [None] * 3
    assert tuple(catalogue.counts(rows).first()) == (3, 1, 1, 0, 1)
    assert catalogue.with_link(rows).count() == 2
    assert catalogue.headers(spark, str(p)) == df.columns and catalogue.headers(spark, str(tmp_path / "none")) is None
    assert catalogue.read_plain(spark, str(p)).columns == df.columns
    with pytest.raises(ValueError):
        schema.add("x", "Nothing")
    (tmp_path / "empty.csv").write_text("")
    assert catalogue.CsvCatalogue().read(spark, str(tmp_path / "empty.csv")).collect() == []


def test_columns(spark, tmp_path):
    (tmp_path / "d.csv").write_text("GeographyCode,KS1,KS2\nE02a,1.5,..\nE01b,x,2\nW05c,3\n")
    good, warn = catalogue.read_numeric_column(spark, str(tmp_path / "d.csv"), "KS1")
    assert sorted(r.value for r in good.collect()) == [1.5, 3] and [r.raw for r in warn.collect()] == ["x"]
    with pytest.raises(KeyError):
        catalogue.read_numeric_column(spark, str(tmp_path / "d.csv"), "none")
    keyed = catalogue.read_keyed_column(spark, str(tmp_path / "d.csv"), "GeographyCode", "KS2")
    assert {r.area: r.value for r in keyed.collect()} == {"E02a": None, "E01b": 2, "W05c": None}
    files.split_levels(spark.read.csv(str(tmp_path / "d.csv"), header=True), "GeographyCode", str(tmp_path / "levels"))
    assert {r.level for r in spark.read.parquet(str(tmp_path / "levels")).select("level").distinct().collect()} == {"MSOA", "LSOA", "Ward"}
    (tmp_path / "stop.txt").write_text("﻿data\nthe\nthe\n\n", "utf-8")
    assert sorted(r.word for r in catalogue.read_stop_words(spark, str(tmp_path / "stop.txt")).collect()) == ["data", "the"]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "x.csv").write_text("1")
    (tmp_path / "a" / "y_DATA.CSV").write_text("12345")
    rows = files.listing(spark, str(tmp_path)).cache()
    name = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    assert name(files.choose(rows, "largest")) == ["y_DATA.CSV"] == name(files.choose(rows, "pattern", "DATA.CSV")) == name(files.choose(rows, "bottom"))
    assert name(files.choose(rows, "smallest")) == ["x.csv"] == name(files.choose(rows, "top"))
    assert files.largest(rows.limit(0)).collect() == []
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("in/a.csv", "a")
        z.writestr("../evil.csv", "b")
        z.writestr("/abs.csv", "c")
    got = files.unzip(spark.createDataFrame([("z", bytearray(buf.getvalue()))], "path string, content binary")).collect()
    assert [(r.name, bytes(r.content)) for r in got] == [("in/a.csv", b"a")]


def test_centroids(spark):
    wkt = [("sq", "POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))"), ("two", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((2 0, 3 0, 3 1, 2 1, 2 0)))"), ("point", "POINT (3 4)"), ("none", None)]
    got = {r.area: (r.x, r.y) for r in catalogue.centroids_of(spark.createDataFrame(wkt, "code string, geom string"), "code", "geom").collect()}
    assert got["sq"] == (2, 1) and got["two"] == (1.5, 0.5) and got["point"] == (3, 4) and got["none"] == (None, None)


def test_resources(spark):
    d = spark.createDataFrame([("a",), ("b",)], "Name string")
    r = spark.createDataFrame([("a", "u2"), ("a", "u1")], "dataset string, URL string")
    assert {x.Name: x.links for x in catalogue.join_resources(d, r, "Name", "dataset", "URL").collect()} == {"a": ["u1", "u2"], "b": None}


def test_sinks(spark, tmp_path):
    v = spark.createDataFrame([(5, "A & B"), (3, 'q"q')], "id int, label string")
    e = spark.createDataFrame([(3, 5, 2.0, "x")], "src int, dst int, weight double, label string")
    assert [r.line for r in sinks.pajek(v, e).collect()] == ["*Vertices 2", "1 \"q'q\"", '2 "A & B"', "*Arcs", "*Edges", '1 2 2.0 l "x"']
    lines = [r.line for r in sinks.gexf(v, e).collect()]
    assert '<node id="1" label="A &amp; B" />' in lines and lines[-1] == "</gexf>"
    __import__("xml.etree.ElementTree").etree.ElementTree.fromstring("\n".join(lines).encode())
    sinks.write_lines(sinks.pajek(v, e), str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).count() == 6
    p = spark.createDataFrame([(1, 2, 0.5), (250, 3, 0.1)], "i int, j int, value double")
    sinks.append_pairs(p, str(tmp_path / "log"))
    sinks.append_pairs(p, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).where("i_block = 2").count() == 2
    w = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 0, [3.0, 4.0])], "y int, x int, weights array<double>")
    sinks.save_weights(w, str(tmp_path / "w"))
    assert sorted(map(tuple, sinks.load_weights(spark, str(tmp_path / "w")).collect())) == [(0, 1, [1, 2]), (1, 0, [3, 4])]
    rec = sinks.map_records(spark.createDataFrame([("k", "T<", "u")], "unique_key string, title string, data_uri string"), ["c0", "c1"])
    styles = spark.createDataFrame([("k_0", 0, 1.0, 2.0, 255, 0, 1)], "map_key string, position int, low double, high double, r int, g int, b int")
    d = {r.map_key: r.descriptor for r in sinks.descriptors(rec, styles).collect()}
    assert "<colour>#ff0001</colour>" in d["k_0"] and "T&lt;" in d["k_1"] and "<classes></classes>" in d["k_1"]
    c = spark.createDataFrame([("u1", "k", "t", "a", 0.8), ("u1", "k", "t", "b", 0.9), ("u0", "k", "t", "a", 0.1)], "data_uri string, unique_key string, title string, column string, prob double")
    assert [(r.major, r.minor, r.column) for r in sinks.thumbnail_index(c).orderBy("column").collect()] == [(0, 0, "a"), (0, 1, "b")]
    sinks.write_clean_pairs(p, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv")).count() == 2
    assert graph.strength(e).count() == 2


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.6), (3, 3, 0.1)], "i int, j int, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pairs.new_pairs(pairs.read_pairs(spark, str(tmp_path / "in"), rows.schema), "i", "j")
    pairs.run_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    rows.limit(2).union(spark.createDataFrame([(9, 8, 0.0)], rows.schema)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = pairs.new_pairs(pairs.read_pairs(spark, str(tmp_path / "in"), rows.schema), "i", "j")
    pairs.run_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_streaming_windows(spark, tmp_path):
    rows = spark.range(40).select((F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = pairs.windowed_means(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "v", "k", late="1 minute")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("means").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("means").agg(F.sum("n")).first()[0] == 40


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    """The entry module works where the llm folders are deleted, with and without the pipeline."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "lodestrata"), tmp_path / "lodestrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * pipeline]:
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'moran_all_pairs' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); assert set(o) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_graph_files_number_any_id(spark):
    edges = spark.createDataFrame([("b", "a", 1.0)], "src string, dst string, weight double")
    names = spark.createDataFrame([("b", "Bee"), ("a", "A & B")], "id string, label string")
    assert [r.line for r in sinks.pajek(names, edges).collect()] == ["*Vertices 2", '1 "A & B"', '2 "Bee"', "*Arcs", "*Edges", '2 1 1.0 l ""']
    assert '<node id="0" label="A &amp; B" />' in [r.line for r in sinks.gexf(names, edges).collect()]
    signed = spark.createDataFrame([(-5, "five"), (-3, "three"), (2, "two")], "id long, label string")
    none = spark.createDataFrame([], "src long, dst long, weight double")
    assert [r.line for r in sinks.pajek(signed, none).collect()][1:4] == ['1 "five"', '2 "three"', '3 "two"']
