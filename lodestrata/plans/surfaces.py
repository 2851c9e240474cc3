"""Small operators one by one: populations, pair logs, labels, boxes, graph edits and graph files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, documents, graph, matrix, postprocess, stats
from ..sources import sinks
from . import graphs, numeric
from .base import Listed, read, rounded

query = Listed()
QUERIES, ORACLES = query.queries, query.oracles


@query("SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std_dev FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def combine_std_devs(spark, sf_dir):
    q = lambda flag: F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))
    own = [f(q(flag)).alias(f"{name}_{flag}") for flag in "AR" for name, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop))]
    rows = read(spark, sf_dir, "lineitem").agg(*own)
    a, r = ([F.col(f"{name}_{flag}") for name in ("n", "mean", "sd")] for flag in "AR")
    rows = rows.withColumn("mean", stats.combine_means(a[0], a[1], r[0], r[1]))
    return rows.select(rounded("mean").alias("mean"), rounded(stats.combine_std_devs(*a, *r, F.col("mean"))).alias("std_dev"))


#: Breaks with ties: most of the values are 1.
TIED = "least(l_linenumber, 2)"


@query(f"""WITH b AS (SELECT quantile_cont({TIED}::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM lineitem), e AS (SELECT k, b[k] AS v FROM b, range(1, 7) r(k)),
n AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY k) AS place FROM e) SELECT (k - 1)::INT AS position, CASE WHEN place % 2 = 0 THEN v + abs(v) * 3e-8 ELSE v END AS break FROM n""")
def nudged_breaks(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.least("l_linenumber", F.lit(2)).cast("double").alias("v"))
    return classify.breaks_array(rows, "v").select(F.posexplode("breaks").alias("position", "break"))


@query("SELECT p_partkey, p_name || ' (' || p_brand || ') from the 2011 Census table ' || p_type || ' (' || p_size || ')' AS short FROM part")
def short_descriptions(spark, sf_dir):
    c = F.col
    return read(spark, sf_dir, "part").select("p_partkey", text.short_description(c("p_brand"), c("p_name"), c("p_size").cast("string"), c("p_type")).alias("short"))


@query("""SELECT p_partkey, '<ul><li>Variable: ' || replace(replace(p_brand, '&', '&amp;'), '#', '#') || '</li><li>Description: ' || p_name || '</li><li>Unit: </li><li>Table: ' || p_size || '</li><li>Table description: &lt;' || p_type || '&gt;</li></ul>' AS long FROM part""")
def long_descriptions(spark, sf_dir):
    c = F.col
    return read(spark, sf_dir, "part").select("p_partkey", text.long_description(c("p_brand"), c("p_name"), F.lit(None).cast("string"), c("p_size").cast("string"), F.concat(F.lit("<"), c("p_type"), F.lit(">"))).alias("long"))


@query("SELECT p_partkey, 'Title for ' || p_partkey AS label FROM part")
def default_texts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.default_text("Title", F.col("p_partkey").cast("string")).alias("label"))


@query("SELECT o_orderkey, try_cast(trim(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE ' ' || (o_orderkey % 100) || '.5 ' END) AS FLOAT) AS value FROM orders")
def safe_floats(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = F.when(key % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit(" "), (key % 100).cast("string"), F.lit(".5 ")))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.safe_float(raw).alias("value"))


#: A log of lines: whole ones, short ones, blank ones.
LOG = "g AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN o_orderstatus || ',' || o_orderkey ELSE o_orderstatus || ',' || o_orderkey || ',' || o_custkey END AS value FROM orders)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    k = c("o_orderkey") % 4
    return read(spark, sf_dir, "orders").select(F.when(k == 0, "").when(k == 1, F.concat_ws(",", "o_orderstatus", "o_orderkey")).otherwise(F.concat_ws(",", "o_orderstatus", "o_orderkey", "o_custkey")).alias("value"))


@query(f"WITH {LOG} SELECT value FROM g WHERE value LIKE 'O,%,%'")
def right_shape(spark, sf_dir):
    return postprocess.right_shape(log(spark, sf_dir), 3, "O")


@query(f"WITH {LOG} SELECT value FROM g WHERE value <> ''")
def without_blank_lines(spark, sf_dir):
    return postprocess.without_blank_lines(log(spark, sf_dir))


#: Pair values of which some are NaN or no number at all.
MIXED = "x AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'none' ELSE (l_partkey % 7)::VARCHAR END AS value FROM lineitem)"


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 5
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(k == 0, "NaN").when(k == 1, "none").otherwise((F.col("l_partkey") % 7).cast("string")).alias("value"))


@query(f"WITH {MIXED} SELECT * FROM x WHERE value NOT IN ('NaN', 'none')")
def pairs_with_numbers(spark, sf_dir):
    return postprocess.split_nan(mixed(spark, sf_dir), "value")[0]


@query(f"WITH {MIXED} SELECT * FROM x WHERE value IN ('NaN', 'none')")
def pairs_without_numbers(spark, sf_dir):
    return postprocess.split_nan(mixed(spark, sf_dir), "value")[1]


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey <> 7")
def without_missing(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier")
    return stats.without_missing(rows.withColumn("marked", F.when(F.col("s_nationkey") == 7, -9999.0).otherwise(F.col("s_acctbal"))), "marked", -9999.0).select("s_suppkey", "s_acctbal")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 7 THEN 0.0 ELSE s_acctbal END AS value FROM supplier")
def nan_to_zero(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_nationkey") == 7, float("nan")).otherwise(F.col("s_acctbal")).alias("value"))
    return stats.nan_to_zero(rows, "value")


def table_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return numeric.pair_rows(spark, sf_dir).select(F.concat(F.lit("t"), c("a") % 3).alias("table_i"), F.concat(F.lit("t"), c("b") % 3).alias("table_j"), c("v").alias("value"))


@query(f"""WITH {numeric.PAIRS}, q AS (SELECT 't' || a % 3 AS i, 't' || b % 3 AS j, v FROM p), s AS (SELECT i, j, v FROM q UNION ALL SELECT j, i, v FROM q)
SELECT i AS table_i, round(avg(v) FILTER (j = 't0'), 6) + 0.0 AS t0, round(avg(v) FILTER (j = 't1'), 6) + 0.0 AS t1, round(avg(v) FILTER (j = 't2'), 6) + 0.0 AS t2 FROM s GROUP BY 1""")
def relationship_matrix(spark, sf_dir):
    wide = postprocess.relationship_matrix(postprocess.table_relationships(table_pairs(spark, sf_dir)))
    return wide.select("table_i", *[rounded(c).alias(c) for c in wide.columns[1:]])


@query(f"WITH {numeric.PAIRS} SELECT count(DISTINCT x) AS n_variables FROM (SELECT a AS x FROM p UNION ALL SELECT b FROM p)")
def distinct_variables(spark, sf_dir):
    return postprocess.distinct_variables(numeric.pair_rows(spark, sf_dir), ["a", "b"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R')")
def union_shards(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return postprocess.union_shards([rows.where(F.col("l_returnflag") == f).select("l_orderkey", "l_linenumber") for f in "ANR"])


@query("""WITH p AS (SELECT s_nationkey AS i, c_nationkey AS j, count(*)::DOUBLE AS value FROM supplier, customer WHERE s_suppkey % 20 = c_custkey % 20 GROUP BY 1, 2)
SELECT i, j, value, a.n_name AS variable_i, ra.r_name AS description_i, b.n_name AS variable_j, rb.r_name AS description_j FROM p JOIN nation a ON a.n_nationkey = i JOIN nation b ON b.n_nationkey = j
LEFT JOIN region ra ON ra.r_regionkey = a.n_regionkey LEFT JOIN region rb ON rb.r_regionkey = b.n_regionkey WHERE i <> j AND value <= 20""")
def match_report(spark, sf_dir):
    sides = [read(spark, sf_dir, t).groupBy(F.col(nation).alias(name), (F.col(key) % 20).alias("k")).agg(F.count(F.lit(1)).alias(f"n_{name}")) for t, nation, key, name in (("supplier", "s_nationkey", "s_suppkey", "i"), ("customer", "c_nationkey", "c_custkey", "j"))]
    pairs = sides[0].join(sides[1], "k").groupBy("i", "j").agg(F.sum(F.col("n_i") * F.col("n_j")).cast("double").alias("value"))
    nation = read(spark, sf_dir, "nation")
    index = nation.select(F.col("n_nationkey").alias("map"), F.col("n_name").alias("variable"))
    texts = nation.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_name").alias("variable"), F.col("r_name").alias("description"))
    return postprocess.match_report(pairs, index, texts)


@query("""WITH b AS (SELECT e[1]::DOUBLE * 1e6 AS x, e[2]::DOUBLE * 1e6 AS y FROM (SELECT embedding AS e FROM embeddings))
SELECT round(degrees(min(x) / 6378137.0), 6) + 0.0 AS min_lon, round(degrees(2 * atan(exp(min(y) / 6378137.0)) - pi() / 2), 6) + 0.0 AS min_lat, round(degrees(max(x + 10) / 6378137.0), 6) + 0.0 AS max_lon, round(degrees(2 * atan(exp(max(y + 10) / 6378137.0)) - pi() / 2), 6) + 0.0 AS max_lat FROM b""")
def map_extent(spark, sf_dir):
    e = F.col("embedding")
    x, y = e[0].cast("double") * 1e6, e[1].cast("double") * 1e6
    boxes = read(spark, sf_dir, "embeddings").select(x.alias("min_x"), y.alias("min_y"), (x + 10).alias("max_x"), (y + 10).alias("max_y"))
    found = classify.extent(boxes)
    return found.select(*[rounded(c).alias(c) for c in found.columns])


@query("""WITH b AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS c FROM part), h AS (SELECT p_partkey, a / 2 AS x, c / 2 AS y, greatest(a, c) / 2 AS half FROM b)
SELECT p_partkey, round(x - half, 6) + 0.0 AS min_x, round(y - half, 6) + 0.0 AS min_y, round(x + half, 6) + 0.0 AS max_x, round(y + half, 6) + 0.0 AS max_y FROM h""")
def square_boxes(spark, sf_dir):
    boxes = read(spark, sf_dir, "part").select("p_partkey", F.lit(0.0).alias("min_x"), F.lit(0.0).alias("min_y"), F.col("p_size").cast("double").alias("max_x"), F.col("p_retailprice").alias("max_y"))
    made = classify.square_box(boxes)
    return made.select("p_partkey", *[rounded(c).alias(c) for c in made.columns[1:]])


@query("SELECT n_name AS name, CASE WHEN n_name = 'FRANCE' THEN 0.25 ELSE 1 + n_nationkey / 10 END AS factor FROM nation UNION SELECT 'FRANCE', 0.25")
def geometry_hints(spark, sf_dir):
    return classify.set_hint(read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (1 + F.col("n_nationkey") / 10).alias("factor")), "FRANCE", 0.25)


@query("SELECT c_custkey % 40 AS x, c_nationkey AS y, greatest(least(trunc(max(c_acctbal) / 10), 255), 0)::INT AS grey FROM customer GROUP BY 1, 2")
def grey_image(spark, sf_dir):
    cells = read(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 40).alias("i"), F.col("c_nationkey").alias("j")).agg((F.max("c_acctbal") / 10).alias("value"))
    return matrix.grey_image(cells)


@query("""WITH r AS (SELECT c_nationkey + 3 AS i, c_custkey AS row_no, 'n' || c_nationkey AS name FROM customer UNION ALL SELECT c_custkey % 2, c_custkey, 'k' || c_custkey % 2 FROM customer),
n AS (SELECT i, arg_max(name, row_no) AS name FROM r GROUP BY 1) SELECT k::INT AS i, coalesce(name, 'Missing_' || k) AS name FROM range((SELECT max(i) + 1 FROM r)) s(k) LEFT JOIN n ON n.i = k""")
def pair_matrix_names(spark, sf_dir):
    c = F.col
    rows = read(spark, sf_dir, "customer").select(c("c_custkey").alias("row_no"), (c("c_nationkey") + 3).cast("int").alias("i"), (c("c_custkey") % 2).cast("int").alias("j"), F.concat(F.lit("n"), "c_nationkey").alias("name_i"), F.concat(F.lit("k"), c("c_custkey") % 2).alias("name_j"), c("c_acctbal").alias("value"))
    return matrix.from_knn_pairs(rows)[1]


STOP = ["green", "blue", "red"]


@query("SELECT p_partkey AS doc, word FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE word NOT IN (SELECT DISTINCT string_split(lower(p_name), ' ')[1] FROM part WHERE p_size < 5)")
def stop_word_table(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    words = documents.words_of(part, "p_partkey", "p_name", shortest=1)
    stop = documents.words_of(part.where("p_size < 5"), "p_partkey", "p_name", shortest=1).where("pos = 0")
    return documents.without_stop_words(words, stop).select("doc", "word")


# --- graph edits -------------------------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS label FROM nation UNION ALL SELECT r_regionkey + 23, r_name FROM region WHERE r_regionkey + 23 NOT IN (SELECT n_nationkey FROM nation)")
def graph_add_vertices(spark, sf_dir):
    new = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 23).alias("id"), F.col("r_name").alias("label"))
    return graph.add_vertices(graphs.named(spark, sf_dir), new)


@query(f"WITH {graphs.NATIONS} SELECT src, dst, weight FROM e UNION ALL SELECT r_regionkey, r_regionkey + 10, 1 FROM region")
def graph_connect(spark, sf_dir):
    new = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("src"), (F.col("r_regionkey") + 10).alias("dst"), F.lit(1).alias("weight"))
    return graph.connect(graphs.nations(spark, sf_dir), new)


@query("SELECT least(c_nationkey, c_custkey % 25) AS src, greatest(c_nationkey, c_custkey % 25) AS dst, count(*) AS weight FROM customer GROUP BY 1, 2")
def graph_count_edges(spark, sf_dir):
    return graph.count_edges(read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("src"), (F.col("c_custkey") % 25).alias("dst")))


@query(f"WITH {graphs.NATIONS} SELECT * FROM e WHERE NOT (dst = src + 1 AND src < 5)")
def graph_delete_edges(spark, sf_dir):
    gone = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("src"), (F.col("r_regionkey") + 1).alias("dst"))
    return graph.delete_edges(graphs.nations(spark, sf_dir), gone)


@query(f"WITH {graphs.NATIONS} SELECT * FROM e WHERE src >= 5 AND dst >= 5")
def graph_delete_vertices(spark, sf_dir):
    gone = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))
    return graph.delete_vertices(graphs.named(spark, sf_dir), graphs.nations(spark, sf_dir), gone)[1]


@query(f"WITH {graphs.NATIONS} SELECT n_nationkey AS id, n_name AS label FROM nation WHERE n_nationkey IN (SELECT src FROM e WHERE weight > 5 UNION SELECT dst FROM e WHERE weight > 5)")
def graph_without_orphans(spark, sf_dir):
    return graph.without_orphans(graphs.named(spark, sf_dir), graphs.nations(spark, sf_dir).where("weight > 5"))


@query(f"WITH {graphs.NATIONS} SELECT coalesce(sum(weight), 0)::DOUBLE AS weight FROM e WHERE src IN (3, 4) AND dst IN (3, 4) AND src <> dst")
def graph_weight_between(spark, sf_dir):
    return graph.weight_between(graphs.nations(spark, sf_dir), 3, 4)


@query(f"""WITH RECURSIVE {graphs.NATIONS}, b AS (SELECT src, dst FROM e WHERE weight > 2 UNION SELECT dst, src FROM e WHERE weight > 2), r(id, reach) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT r.id, b.dst FROM r JOIN b ON b.src = r.reach),
c AS (SELECT id, min(reach) AS c FROM r GROUP BY 1), n AS (SELECT c, count(*) AS size FROM c GROUP BY 1) SELECT size, count(*) AS n_components FROM n GROUP BY 1""")
def component_sizes(spark, sf_dir):
    return graph.component_sizes(graphs.named(spark, sf_dir), graphs.nations(spark, sf_dir).where("weight > 2"))


@query("""WITH x AS (SELECT DISTINCT p_partkey AS doc, unnest(string_split(lower(p_name), ' ')) AS word FROM part), e AS (SELECT a.word AS src, b.word AS dst, count(*) AS weight FROM x a JOIN x b ON a.doc = b.doc AND a.word < b.word GROUP BY 1, 2 HAVING count(*) >= 2),
v AS (SELECT word, row_number() OVER (ORDER BY word) AS no FROM (SELECT src AS word FROM e UNION SELECT dst FROM e))
SELECT '*Vertices ' || (SELECT count(*) FROM v) AS line UNION ALL SELECT no || ' "' || word || '"' FROM v UNION ALL SELECT unnest(['*Arcs', '*Edges']) UNION ALL SELECT a.no || ' ' || b.no || ' ' || weight || ' l ""' FROM e JOIN v a ON a.word = src JOIN v b ON b.word = dst""")
def pajek_keywords(spark, sf_dir):
    """The keyword graph as a file: its ids are words."""
    edges = graphs.edges(spark, sf_dir)
    words = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("label", F.col("id"))
    return sinks.pajek(words, edges)


#: Correlations of the nations' trade from -1 to 1, cut all the way.
SIGNED = [k / 5.0 - 1 for k in range(11)]


@query("""WITH RECURSIVE c AS (SELECT s_nationkey AS i, c_nationkey AS j, (count(*) % 21)::DOUBLE / 10 - 1 AS value FROM supplier, customer WHERE s_suppkey % 20 = c_custkey % 20 GROUP BY 1, 2), cuts AS (SELECT k / 5.0::DOUBLE - 1 AS cut FROM range(11) r(k)),
e AS (SELECT cut, i, j FROM c, cuts WHERE value >= cut AND i <> j UNION SELECT cut, j, i FROM c, cuts WHERE value >= cut AND i <> j), r(cut, id, reach) AS (SELECT cut, k::INT, k::INT FROM cuts, range(25) n(k) UNION SELECT r.cut, r.id, e.j FROM r JOIN e ON e.cut = r.cut AND e.i = r.reach)
SELECT cut, count(DISTINCT m) AS n_clusters FROM (SELECT cut, id, min(reach) AS m FROM r GROUP BY 1, 2) GROUP BY 1""")
def signed_cluster_sweep(spark, sf_dir):
    """Cuts below zero as well."""
    sides = [read(spark, sf_dir, t).groupBy(F.col(nation).alias(name), (F.col(key) % 20).alias("k")).agg(F.count(F.lit(1)).alias(f"n_{name}")) for t, nation, key, name in (("supplier", "s_nationkey", "s_suppkey", "i"), ("customer", "c_nationkey", "c_custkey", "j"))]
    cells = sides[0].join(sides[1], "k").groupBy("i", "j").agg(F.sum(F.col("n_i") * F.col("n_j")).alias("n")).select("i", "j", ((F.col("n") % 21).cast("double") / 10 - 1).alias("value"))
    return graph.cluster_sweep(cells, 25, SIGNED)
