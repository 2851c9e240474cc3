"""Words, weights, names and catalogue rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents
from ..sources import catalogue, files, profile, sinks
from .base import Listed, read, rounded

query = Listed()
QUERIES, ORACLES = query.queries, query.oracles

#: Words of a text column in SQL: split, clean, keep those of three letters or more.
SPLIT = "list_filter(list_transform(regexp_split_to_array({0}, '[ ,.\\r\\n]+'), lambda w: lower(regexp_replace(w, '[^a-zA-Z-]', '', 'g'))), lambda w: length(w) >= 3)"


def hist_sql(table: str, key: str) -> str:
    return f"h AS (SELECT doc, word, count(*) AS n FROM (SELECT {key} AS doc, unnest({SPLIT.format('text')}) AS word FROM {table}) GROUP BY 1, 2)"


TFIDF = "t AS (SELECT h.doc, h.word, h.n * log2((SELECT count(DISTINCT doc) FROM h) / d.n_docs) AS weight FROM h JOIN (SELECT word, count(*)::DOUBLE AS n_docs FROM h GROUP BY 1) d USING (word))"


@query("SELECT page_id, regexp_replace(html, '<[^>]*>?', '', 'g') AS text FROM pages")
def strip_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({SPLIT.format('text')}) AS word FROM documents) GROUP BY 1")
def split_words(spark, sf_dir):
    return documents.words_of(read(spark, sf_dir, "documents"), "doc_id", "text").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {hist_sql('documents', 'doc_id')} SELECT * FROM h")
def word_histogram(spark, sf_dir):
    return documents.histogram(documents.words_of(read(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"WITH {hist_sql('documents', 'doc_id')} SELECT word, count(*) AS n_docs FROM h GROUP BY 1")
def doc_frequency(spark, sf_dir):
    return documents.document_frequency(documents.histogram(documents.words_of(read(spark, sf_dir, "documents"), "doc_id", "text")))


@query(f"WITH {hist_sql('documents', 'doc_id')}, {TFIDF} SELECT doc, word, round(weight, 6) + 0.0 AS weight FROM t")
def tfidf(spark, sf_dir):
    return documents.tf_idf(documents.histogram(documents.words_of(read(spark, sf_dir, "documents"), "doc_id", "text"))).withColumn("weight", rounded("weight"))


@query(f"""WITH {hist_sql('benchmark', 'item_id')}, {TFIDF}, u AS (SELECT doc, word, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc)) AS w FROM t)
SELECT a.doc AS doc_i, b.doc AS doc_j, round(sum(a.w * b.w), 6) + 0.0 AS cosine FROM u a JOIN u b ON a.word = b.word AND a.doc < b.doc WHERE a.w <> 0 AND b.w <> 0 GROUP BY 1, 2""")
def tfidf_cosine(spark, sf_dir):
    hist = documents.histogram(documents.words_of(read(spark, sf_dir, "benchmark"), "item_id", "text"))
    return documents.cosine_pairs(documents.tf_idf(hist)).withColumn("cosine", rounded("cosine"))


@query(f"SELECT count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM (SELECT unnest({SPLIT.format('text')}) AS word FROM documents) WHERE word NOT IN ({', '.join(repr(w) for w in documents.STOP_WORDS)})")
def stop_word_filter(spark, sf_dir):
    words = documents.words_of(read(spark, sf_dir, "documents"), "doc_id", "text")
    return documents.without_stop_words(words, documents.STOP_WORDS).agg(F.count(F.lit(1)).alias("n_words"), F.count_distinct("word").alias("n_distinct"))


@query()
def stem_histogram(spark, sf_dir):
    return documents.stem_histogram(documents.histogram(documents.words_of(read(spark, sf_dir, "documents"), "doc_id", "text")))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.col("url").alias("link"), F.col("page_id").cast("string").alias("unique_key"))


@query("""SELECT count(*) AS n_datasets, count(*) FILTER (lower(url) LIKE '%.csv') AS n_csv, count(*) FILTER (lower(url) LIKE '%.zip' OR lower(url) LIKE '%.gz') AS n_zip,
count(*) FILTER (lower(url) LIKE '%.html') AS n_html, count(*) FILTER (coalesce(url, '') = '') AS n_blank FROM pages""")
def catalogue_counts(spark, sf_dir):
    return catalogue.counts(links(spark, sf_dir))


@query("""WITH c AS (SELECT (['E00', 'W01', 'E02', 'W05', 'K04'])[c_custkey % 5 + 1] || lpad(c_custkey::VARCHAR, 6, '0') AS code FROM customer)
SELECT CASE WHEN code[1:3] IN ('E00', 'W00') THEN 'OA' WHEN code[1:3] IN ('E01', 'W01') THEN 'LSOA' WHEN code[1:3] IN ('E02', 'W02') THEN 'MSOA' WHEN code[1:3] IN ('E05', 'W05') THEN 'Ward' END AS level, count(*) AS n FROM c GROUP BY 1""")
def level_router(spark, sf_dir):
    heads = F.array(*[F.lit(x) for x in ("E00", "W01", "E02", "W05", "K04")])
    code = F.concat(F.get(heads, F.pmod("c_custkey", F.lit(5)).cast("int")), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    return read(spark, sf_dir, "customer").groupBy(text.area_level(code).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, CASE WHEN v LIKE 'C%' THEN v[1:6] ELSE v[1:7] END AS table_code, left(v, length(v) - 6) AS by_suffix, left(v, 5) AS short_code,
'text of ' || v || ' (' || v || ') from the 2011 Census table ' || c_mktsegment || ' (' || (CASE WHEN v LIKE 'C%' THEN v[1:6] ELSE v[1:7] END) || ')' AS description
FROM (SELECT c_custkey, c_mktsegment, (CASE WHEN c_custkey % 2 = 0 THEN 'CT' ELSE 'KS1' END) || lpad(c_custkey::VARCHAR, 9, '0') AS v FROM customer)""")
def variable_names(spark, sf_dir):
    v = F.col("v")
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.concat(F.when(F.col("c_custkey") % 2 == 0, "CT").otherwise("KS1"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("v"))
    table = text.table_code(v)
    return rows.select("c_custkey", table.alias("table_code"), text.table_code_by_suffix(v).alias("by_suffix"), text.table_code_short(v).alias("short_code"), text.short_description(v, F.concat(F.lit("text of "), v), table, F.col("c_mktsegment")).alias("description"))


@query("""WITH t AS (SELECT p_partkey, p_type || ': ' || p_name || '; ' || repeat(p_brand || ' ', (p_partkey % 9)::INT) || p_name AS t FROM part),
a AS (SELECT *, CASE WHEN length(t) > 64 AND contains(t, ':') THEN substr(list_last(string_split(t, ':')), 2) ELSE t END AS u FROM t),
b AS (SELECT *, CASE WHEN length(u) > 64 AND contains(u, ';') THEN substr(list_last(string_split(u, ';')), 2) ELSE u END AS v FROM a),
c AS (SELECT *, string_split(v, ' ') AS w FROM b), d AS (SELECT *, list_filter(range(1, len(w) + 1), lambda k: length(array_to_string(w[1:k], ' ')) <= 60) AS ok FROM c)
SELECT p_partkey, trim(CASE WHEN length(v) > 64 THEN trim(array_to_string(w[1:len(ok)], ' ')) || '...' ELSE v END) AS title FROM d""")
def title_shorten(spark, sf_dir):
    c = F.col
    title = F.concat(c("p_type"), F.lit(": "), c("p_name"), F.lit("; "), F.repeat(F.concat(c("p_brand"), F.lit(" ")), (c("p_partkey") % 9).cast("int")), c("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", text.shorten_title(title).alias("title"))


@query("""WITH w AS (SELECT p_partkey, list_filter(string_split(p_type || ' ' || p_name || ' ' || p_type || ' a:bcd', ' '), lambda x: length(x) >= 4) AS w FROM part),
d AS (SELECT p_partkey, list_transform(list_filter(range(1, len(w) + 1), lambda k: list_position(w, w[k]) = k), lambda k: lower(replace(w[k], ':', ' '))) AS d FROM w)
SELECT p_partkey, CASE WHEN len(d) > 0 THEN array_to_string(d, ' ') || ' ' ELSE '' END AS keywords FROM d""")
def keyword_string(spark, sf_dir):
    source = F.concat_ws(" ", "p_type", "p_name", "p_type", F.lit("a:bcd"))
    return read(spark, sf_dir, "part").select("p_partkey", text.keyword_string(source).alias("keywords"))


@query("""SELECT (SELECT url FROM pages ORDER BY length(html) DESC, url LIMIT 1) AS largest, (SELECT url FROM pages ORDER BY length(html), url LIMIT 1) AS smallest,
(SELECT count(*) FROM pages WHERE len(string_split(regexp_replace(url, '/+', '/', 'g'), '/')) = (SELECT min(len(string_split(regexp_replace(url, '/+', '/', 'g'), '/'))) FROM pages)) AS n_top,
(SELECT count(*) FROM pages WHERE len(string_split(regexp_replace(url, '/+', '/', 'g'), '/')) = (SELECT max(len(string_split(regexp_replace(url, '/+', '/', 'g'), '/'))) FROM pages)) AS n_bottom,
(SELECT count(*) FROM pages WHERE regexp_matches(url, '[0-9]+\\.html')) AS n_pattern""")
def file_filters(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.length("html").alias("length"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [files.largest(rows).withColumnRenamed("path", "largest"), files.smallest(rows).withColumnRenamed("path", "smallest"), n(files.top(rows), "n_top"), n(files.bottom(rows), "n_bottom"), n(files.matching(rows, r"[0-9]+\.html"), "n_pattern")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@query("""WITH f AS (SELECT page_id, list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS f FROM pages)
SELECT page_id, f AS file_name, regexp_replace(f, '\\.[^.]*$', '') AS stem, lower(regexp_extract(f, '(\\.[^.]*)$', 1)) AS extension FROM f""")
def file_names(spark, sf_dir):
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", text.file_name(url).alias("file_name"), text.file_stem(url).alias("stem"), text.file_extension(url).alias("extension"))


@query("""SELECT p_partkey || '_' || k AS map_key, p_name || ' ' || c AS title, c AS "column", p_brand AS data_uri, p_partkey || '_' || k || '.xml' AS descriptor_url FROM part, (VALUES (0, 'p_size'), (1, 'p_retailprice')) v(k, c)""")
def map_records(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("unique_key"), F.col("p_name").alias("title"), F.col("p_brand").alias("data_uri"))
    return sinks.map_records(rows, ["p_size", "p_retailprice"])


@query("""SELECT d.c_custkey, d.c_name, r.links FROM (SELECT c_custkey, c_name FROM customer) d LEFT JOIN (SELECT o_custkey, list_sort(list(o_orderkey)) AS k, array_to_string(list_sort(list(o_orderkey)), ',') AS links FROM orders GROUP BY 1) r ON r.o_custkey = d.c_custkey""")
def dataset_resources(spark, sf_dir):
    rows = catalogue.join_resources(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderkey")
    return rows.select("c_custkey", "c_name", F.array_join(F.col("links").cast("array<string>"), ",").alias("links"))


@query("""WITH c AS (SELECT 0 AS position, 'c_custkey' AS "column", c_custkey::VARCHAR AS raw FROM customer UNION ALL SELECT 1, 'c_name', trim(c_name) FROM customer UNION ALL SELECT 2, 'c_nationkey', c_nationkey::VARCHAR FROM customer UNION ALL SELECT 3, 'c_mktsegment', trim(c_mktsegment) FROM customer)
SELECT position::INT AS position, "column", count(*) FILTER (raw <> '') > 0 AND count(*) FILTER (raw <> '') = count(try_cast(raw AS DOUBLE)) AS is_numeric, count(*) FILTER (raw <> '') = count(*) AND count(DISTINCT raw) = count(*) AS is_index, min(try_cast(raw AS DOUBLE)) AS min_value, max(try_cast(raw AS DOUBLE)) AS max_value FROM c GROUP BY 1, 2""")
def column_types(spark, sf_dir):
    return profile.column_types(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), sample=None)


@query("""WITH g AS (SELECT 'nation' AS name, n_nationkey::VARCHAR AS area FROM nation UNION ALL SELECT 'region', r_regionkey::VARCHAR FROM region),
c AS (SELECT 0 AS position, 'c_custkey' AS "column", c_custkey::VARCHAR AS raw FROM customer UNION ALL SELECT 1, 'c_nationkey', c_nationkey::VARCHAR FROM customer)
SELECT name, position::INT AS position, "column", round(count(*) / max(n), 6) AS prob FROM c JOIN g ON area = raw JOIN (SELECT position, count(*) AS n FROM c GROUP BY 1) USING (position) GROUP BY 1, 2, 3""")
def geometry_candidates(spark, sf_dir):
    known = read(spark, sf_dir, "nation").select(F.lit("nation").alias("name"), F.col("n_nationkey").alias("area")).union(read(spark, sf_dir, "region").select(F.lit("region"), "r_regionkey"))
    return profile.geometry_candidates(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), known, sample=None).withColumn("prob", rounded("prob"))
