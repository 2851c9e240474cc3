"""Keyword and correlation graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, graph
from ..sources import sinks
from .base import Listed, read, rounded

query = Listed()
QUERIES, ORACLES = query.queries, query.oracles


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (word, doc): the words of part names."""
    return documents.inverted_index(documents.words_of(read(spark, sf_dir, "part"), "p_partkey", "p_name"))


INDEX = "x AS (SELECT DISTINCT p_partkey AS doc, unnest(string_split(lower(p_name), ' ')) AS word FROM part)"
EDGES = f"{INDEX}, e AS (SELECT a.word AS src, b.word AS dst, count(*) AS weight FROM x a JOIN x b ON a.doc = b.doc AND a.word < b.word GROUP BY 1, 2 HAVING count(*) >= 2)"
STRENGTH = "s AS (SELECT id, sum(weight)::DOUBLE AS strength FROM (SELECT src AS id, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY 1)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.keyword_graph(index(spark, sf_dir), least_docs=1, least_weight=2, least_strength=0)


@query(f"WITH {EDGES} SELECT * FROM e")
def keyword_graph(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"""WITH {INDEX}, n AS (SELECT word, count(*) AS n FROM x GROUP BY 1), f AS (SELECT word, min((doc, pos)) AS f FROM (SELECT p_partkey AS doc, unnest(range(len(string_split(p_name, ' ')))) AS pos, unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY 1),
e AS (SELECT a.word AS src, b.word AS dst, count(*) AS weight FROM x a JOIN x b ON a.doc = b.doc JOIN f p ON p.word = a.word JOIN f q ON q.word = b.word JOIN n ON n.word = a.word WHERE (p.f, a.word) < (q.f, b.word) AND n.n >= 100 GROUP BY 1, 2 HAVING count(*) >= 2),
{STRENGTH} SELECT src, dst, weight FROM e WHERE src NOT IN (SELECT id FROM s WHERE strength < 200) AND dst NOT IN (SELECT id FROM s WHERE strength < 200)""")
def keyword_graph_pruned(spark, sf_dir):
    words = documents.words_of(read(spark, sf_dir, "part"), "p_partkey", "p_name")
    return graph.keyword_graph(documents.inverted_index(words), graph.first_seen(words), least_docs=100, least_weight=2, least_strength=200)


@query(f"WITH {INDEX}, k AS (SELECT word FROM x GROUP BY 1 HAVING count(*) >= 100), p AS (SELECT a.doc AS src, b.doc AS dst, count(*) AS weight FROM x a JOIN x b ON a.word = b.word AND a.doc < b.doc WHERE a.word IN (SELECT word FROM k) GROUP BY 1, 2) SELECT weight, count(*) AS n_links FROM p GROUP BY 1")
def links_graph(spark, sf_dir):
    return graph.links_graph(index(spark, sf_dir), least_docs=100).groupBy("weight").agg(F.count(F.lit(1)).alias("n_links"))


@query(f"WITH {EDGES}, {STRENGTH} SELECT * FROM s")
def graph_strength(spark, sf_dir):
    return graph.strength(edges(spark, sf_dir))


@query(f"WITH {EDGES}, {STRENGTH} SELECT src, dst, round(weight / a.strength + weight / b.strength, 6) AS ncut FROM e JOIN s a ON a.id = src JOIN s b ON b.id = dst")
def ncut(spark, sf_dir):
    return graph.cuts(edges(spark, sf_dir)).withColumn("ncut", rounded("ncut"))


@query(f"WITH {EDGES}, {STRENGTH} SELECT src, dst, a.strength / a.strength + b.strength / b.strength AS nassoc FROM e JOIN s a ON a.id = src JOIN s b ON b.id = dst")
def nassoc(spark, sf_dir):
    return graph.associations(edges(spark, sf_dir))


#: A ring of nations with chords, weights from their customers' balances: paths with more than one step.
NATIONS = """e AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, 1 + n_nationkey % 3 AS weight FROM nation WHERE n_nationkey <> 24
UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 3) % 25, 5 + n_nationkey % 4 FROM nation WHERE n_nationkey % 4 = 0)"""


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = read(spark, sf_dir, "nation")
    ring = rows.where(k != 24).select(k.alias("src"), ((k + 1) % 25).alias("dst"), (1 + k % 3).alias("weight"))
    return ring.union(rows.where(k % 4 == 0).select(k, (k * 7 + 3) % 25, 5 + k % 4))


def reach_sql(where: str, both: bool) -> str:
    way = "b AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)" if both else "b AS (SELECT src, dst, weight FROM e)"
    return f"WITH RECURSIVE {NATIONS}, {way}, r(id, distance, path) AS (SELECT 0, 0.0::DOUBLE, [0] UNION ALL SELECT dst, distance + weight, list_append(path, dst) FROM r JOIN b ON src = id WHERE NOT list_contains(path, dst) AND {where})"


@query(reach_sql("distance + weight <= 12", True) + " SELECT id::INT AS id, min(distance) AS distance FROM r GROUP BY 1")
def k_connected(spark, sf_dir):
    return graph.reach(nations(spark, sf_dir), 0, limit=12).select("id", "distance")


@query(reach_sql("distance + weight <= 12", False) + " SELECT id::INT AS id, min(distance) AS distance FROM r GROUP BY 1")
def k_connected_directed(spark, sf_dir):
    return graph.reach(nations(spark, sf_dir), 0, limit=12, directed=True).select("id", "distance")


@query(reach_sql("distance + weight <= 27", True) + " SELECT id::INT AS id, min(distance) AS distance FROM r WHERE id = 14 GROUP BY 1")
def shortest_path(spark, sf_dir):
    """Its last step; of equal paths several can be given."""
    return graph.shortest_path(nations(spark, sf_dir), 0, 14).where("id = 14").select("id", "distance")


@query()
def shortest_path_steps(spark, sf_dir):
    return graph.shortest_path(nations(spark, sf_dir), 0, 14)


@query()
def spanning_forest(spark, sf_dir):
    return graph.spanning_forest(nations(spark, sf_dir))


@query()
def graph_walk(spark, sf_dir):
    return graph.flatten(nations(spark, sf_dir))


CELLS = """t AS (SELECT c_nationkey AS i, s_nationkey AS j, count(*)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
m AS (SELECT i, j, n / (SELECT max(n) FROM t) AS value FROM t), cuts AS (SELECT k / 10.0::DOUBLE AS cut FROM range(11) r(k))"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much trade nations have with each other, as a share of the largest."""
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = li.groupBy(F.col("c_nationkey").alias("i"), F.col("s_nationkey").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("top")))).select("i", "j", (F.col("n") / F.col("top")).alias("value"))


CUTS = [k / 10.0 for k in range(11)]


@query(f"WITH {CELLS} SELECT cut, count(*) FILTER (value > cut) / 25.0::DOUBLE AS average_degree FROM m, cuts GROUP BY 1")
def avg_degree_sweep(spark, sf_dir):
    return graph.degree_sweep(cells(spark, sf_dir), 25, CUTS)


@query(f"""WITH RECURSIVE {CELLS}, e AS (SELECT cut, i, j FROM m, cuts WHERE value >= cut AND i <> j UNION SELECT cut, j, i FROM m, cuts WHERE value >= cut AND i <> j),
r(cut, id, reach) AS (SELECT cut, k::INT, k::INT FROM cuts, range(25) n(k) UNION SELECT r.cut, r.id, e.j FROM r JOIN e ON e.cut = r.cut AND e.i = r.reach)
SELECT cut, count(DISTINCT c) AS n_clusters FROM (SELECT cut, id, min(reach) AS c FROM r GROUP BY 1, 2) GROUP BY 1""")
def cluster_count_sweep(spark, sf_dir):
    return graph.cluster_sweep(cells(spark, sf_dir), 25, CUTS)


@query(f"WITH {CELLS} SELECT i AS src, j AS dst, round(value, 6) AS weight FROM m WHERE i < j AND value >= 0.5")
def correlation_graph(spark, sf_dir):
    return sinks.similarity_graph(cells(spark, sf_dir), 0.5).withColumn("weight", rounded("weight"))


@query(f"WITH {CELLS} SELECT i AS src, j AS dst, round(1 / value, 6) AS weight FROM m WHERE i < j AND value < 0.5")
def distance_graph(spark, sf_dir):
    return sinks.distance_graph(cells(spark, sf_dir), 0.5).withColumn("weight", rounded("weight"))


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))


@query(f"""WITH {NATIONS} SELECT '*Vertices 25' AS line UNION ALL SELECT (n_nationkey + 1) || ' "' || n_name || '"' FROM nation UNION ALL SELECT unnest(['*Arcs', '*Edges']) UNION ALL SELECT (src + 1) || ' ' || (dst + 1) || ' ' || weight || ' l ""' FROM e""")
def pajek_lines(spark, sf_dir):
    return sinks.pajek(named(spark, sf_dir), nations(spark, sf_dir))


@query(f"""WITH {NATIONS} SELECT unnest(['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">', '<meta><creator>lodestrata</creator></meta>', '<graph mode="static" defaultedgetype="undirected">', '<nodes>', '</nodes>', '<edges>', '</edges>', '</graph>', '</gexf>']) AS line
UNION ALL SELECT '<node id="' || n_nationkey || '" label="' || n_name || '" />' FROM nation UNION ALL SELECT '<edge id="' || src || '-' || dst || '" source="' || src || '" target="' || dst || '" weight="' || weight || '" />' FROM e""")
def gexf_lines(spark, sf_dir):
    return sinks.gexf(named(spark, sf_dir), nations(spark, sf_dir))
