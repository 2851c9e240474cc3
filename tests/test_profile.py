from lodestrata.sources import profile


def staged(tmp_path):
    a, b = tmp_path / "one", tmp_path / "two"
    a.mkdir()
    b.mkdir()
    (a / "KS1DATA.CSV").write_text("GeographyCode,KS1,Note\n" + "".join(f"E02{k},{k * 1.5},n\n" for k in range(20)))
    (a / "readme.txt").write_text("not data")
    (b / "KS2DATA.CSV").write_text("GeographyCode,KS2a,KS2b\n" + "".join(f"E02{k},{k % 3},{'..' if k else 7}\n" for k in range(15)))
    return a, b


def test_types_and_geometry(spark, tmp_path):
    a, _ = staged(tmp_path)
    table = spark.read.csv(str(a / "KS1DATA.CSV"), header=True)
    got = {r.column: r for r in profile.column_types(table).collect()}
    assert got["GeographyCode"].is_index and not got["GeographyCode"].is_numeric and not got["Note"].is_index
    assert got["KS1"].is_numeric and (got["KS1"].min_value, got["KS1"].max_value) == (0, 28.5)
    known = spark.createDataFrame([("MSOA", f"E02{k}") for k in range(40)] + [("MSOA_2011", f"E02{k}") for k in range(40)] + [("Ward", "E021")], "name string, area string")
    hints = spark.createDataFrame([("MSOA", 0.5), ("MSOA_2011", 2.0)], "name string, factor double")
    assert profile.find_geometry(table, known, hints) == ("MSOA_2011", "GeographyCode")
    assert profile.find_geometry(table, known.limit(0), hints) is None
    assert profile.column_types(table.limit(0)).collect() == []


def test_matrix_and_maps(spark, tmp_path):
    a, b = staged(tmp_path)
    rows = spark.createDataFrame([("k1", "One", str(a)), ("k2", "Two", str(b)), ("k3", "None", "")], "unique_key string, title string, link string")
    areas = spark.createDataFrame([(f"E02{k}",) for k in range(20)], "area string")
    m = {(r.area, r.variable): r.value for r in profile.data_matrix(spark, rows, areas, pattern="DATA.CSV").collect()}
    assert len(m) == 60 and m["E022", "KS1"] == 3 and m["E0219", "KS2a"] == 0 and m["E020", "KS2b"] == 7
    known = areas.selectExpr("'MSOA' as name", "area")
    maps = {r.map_key: r.descriptor for r in profile.build_maps(spark, rows, known, spark.createDataFrame([], "name string, factor double"), "DATA.CSV").collect()}
    assert set(maps) == {"k1_0", "k2_0", "k2_1"}
    assert maps["k1_0"].count("<class>") == 5 and maps["k2_0"].count("<class>") == 3
    assert profile.data_matrix(spark, rows.where("link = ''"), areas).collect() == []
