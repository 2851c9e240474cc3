"""Matrices, statistics, spatial correlation, classes and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, images, matrix, postprocess, som, spatial, stats
from .base import Listed, read, rounded

query = Listed()
QUERIES, ORACLES = query.queries, query.oracles

DIMS = range(2, 64)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("area"), (e[0].cast("double") * 100).alias("x"), (e[1].cast("double") * 100).alias("y"))


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("area"), F.explode(F.array(*[F.struct(F.lit(f"d{k}").alias("variable"), e[k].cast("double").alias("value")) for k in DIMS])).alias("v")).select("area", "v.variable", "v.value")


AREAS = "a AS (SELECT vec_id AS area, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE AS vx, embedding[4]::DOUBLE AS vy FROM embeddings)"
WEIGHTS = "w AS (SELECT p.area AS i, q.area AS j, CASE WHEN sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) < 1 THEN 1.0 ELSE 1.0 / sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) END AS w FROM a p, a q)"
Z = "z AS (SELECT area, (vx - avg(vx) OVER ()) / stddev_samp(vx) OVER () AS zx, (vy - avg(vy) OVER ()) / stddev_samp(vy) OVER () AS zy FROM a)"
LONG = "m AS (SELECT vec_id AS area, 'd' || (k - 1) AS variable, embedding[k]::DOUBLE AS v FROM embeddings, range(3, 65) r(k))"


@query(f"WITH {AREAS}, {WEIGHTS} SELECT (SELECT count(*) FROM a) AS n_areas, round(sum(w), 4) AS s0 FROM w")
def spatial_weights_s0(spark, sf_dir):
    return spatial.weights_total(centroids(spark, sf_dir)).select("n_areas", rounded("s0", 4).alias("s0"))


@query(f"WITH {AREAS}, {WEIGHTS}, {Z} SELECT round(sum(p.zy * w * q.zx) / (SELECT sum(w) FROM w), 6) + 0.0 AS moran_i FROM w JOIN z p ON p.area = i JOIN z q ON q.area = j")
def moran_bivariate_fast(spark, sf_dir):
    return spatial.moran(variables(spark, sf_dir), centroids(spark, sf_dir), "d2", "d3").select(rounded("moran_i").alias("moran_i"))


@query(f"""WITH {AREAS}, {WEIGHTS}, {Z}, s AS (SELECT sum(w) AS s0 FROM w), d AS (SELECT sqrt(var_samp(vx) * var_samp(vy)) AS d FROM a)
SELECT round((SELECT sum(p.vy * w * q.vx) FROM w JOIN a p ON p.area = i JOIN a q ON q.area = j) / (s0 * d), 6) + 0.0 AS i1,
       round((SELECT sum(p.zy * p.zx * w) FROM w JOIN z p ON p.area = i) / s0, 6) + 0.0 AS i2 FROM s, d""")
def moran_static(spark, sf_dir):
    return spatial.moran_static(variables(spark, sf_dir), centroids(spark, sf_dir), "d2", "d3").select(rounded("i1").alias("i1"), rounded("i2").alias("i2"))


@query(f"""WITH {AREAS}, {WEIGHTS}, {LONG}, n AS (SELECT area, variable, (v - avg(v) OVER p) / stddev_samp(v) OVER p AS z FROM m WINDOW p AS (PARTITION BY variable)),
l AS (SELECT w.i AS area, n.variable, sum(w.w * n.z) AS lag FROM w JOIN n ON n.area = w.j GROUP BY 1, 2)
SELECT n.variable AS variable_i, l.variable AS variable_j, round(sum(n.z * l.lag) / (SELECT sum(w) FROM w), 6) + 0.0 AS moran_i FROM n JOIN l USING (area) WHERE n.variable <= l.variable GROUP BY 1, 2""")
def moran_all_pairs(spark, sf_dir):
    return spatial.moran_all_pairs(variables(spark, sf_dir), centroids(spark, sf_dir)).withColumn("moran_i", rounded("moran_i"))


KNN = "k AS (SELECT * FROM (SELECT p.area, q.area AS neighbour, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) AS distance, row_number() OVER (PARTITION BY p.area ORDER BY sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)), q.area) AS rank FROM a p JOIN a q ON p.area <> q.area) WHERE rank <= 3)"


@query(f"WITH {AREAS}, {KNN} SELECT area, neighbour, rank::INT AS rank, round(distance, 6) AS distance FROM k")
def knn_neighbours(spark, sf_dir):
    return spatial.nearest(centroids(spark, sf_dir), 3).withColumn("distance", rounded("distance"))


@query(f"WITH {AREAS}, {Z} SELECT round(sum(zx * zy) / count(*), 6) + 0.0 AS knn_corr FROM z")
def knn_corr_as_coded(spark, sf_dir):
    v = variables(spark, sf_dir)
    return spatial.knn_correlation(v, v.limit(0), "d2", "d3", 3, as_coded=True).select(rounded("knn_corr").alias("knn_corr"))


@query(f"WITH {AREAS}, {Z}, {KNN} SELECT round(((SELECT sum(zx * zy) FROM z) + 0.5 * (SELECT sum(p.zx * q.zy) FROM k JOIN z p ON p.area = k.area JOIN z q ON q.area = k.neighbour)) / ((SELECT count(*) FROM z) * 2.5), 6) + 0.0 AS knn_corr")
def knn_corr_intended(spark, sf_dir):
    return spatial.knn_correlation(variables(spark, sf_dir), spatial.nearest(centroids(spark, sf_dir), 3), "d2", "d3", 3).select(rounded("knn_corr").alias("knn_corr"))


@query(f"""WITH {AREAS}, {KNN}, {LONG}, n AS (SELECT area, variable, (v - avg(v) OVER p) / stddev_samp(v) OVER p AS z FROM m WINDOW p AS (PARTITION BY variable)),
f AS (SELECT k.area, n.variable, sum(n.z) AS far FROM k JOIN n ON n.area = k.neighbour GROUP BY 1, 2)
SELECT a.variable AS variable_i, b.variable AS variable_j, round(sum(a.z * (b.z + 0.5 * f.far)) / (count(*) * 2.5), 6) + 0.0 AS knn_corr FROM n a JOIN n b ON a.area = b.area JOIN f ON f.area = b.area AND f.variable = b.variable GROUP BY 1, 2""")
def knn_all_pairs(spark, sf_dir):
    return spatial.knn_all_pairs(variables(spark, sf_dir), spatial.nearest(centroids(spark, sf_dir), 3), 3).withColumn("knn_corr", rounded("knn_corr"))


def supplier_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    sums = li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.count(F.lit(1)).cast("double").alias("lines"))
    returned = li.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("returned"))
    areas = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("area"))
    return matrix.build(areas, [matrix.melt(sums, "l_suppkey"), matrix.melt(returned, "l_suppkey")])


MATRIX = """t AS (SELECT l_suppkey, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price, avg(l_discount) AS discount, count(*)::DOUBLE AS lines, sum(l_quantity) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1),
m AS (SELECT s_suppkey AS area, variable, coalesce(CASE variable WHEN 'quantity' THEN quantity WHEN 'price' THEN price WHEN 'discount' THEN discount WHEN 'lines' THEN lines ELSE returned END, 0) AS value
FROM supplier LEFT JOIN t ON s_suppkey = l_suppkey, (SELECT unnest(['quantity', 'price', 'discount', 'lines', 'returned']) AS variable))"""


@query(f"WITH {MATRIX} SELECT area, variable, round(value, 4) + 0.0 AS value FROM m")
def data_matrix(spark, sf_dir):
    return supplier_matrix(spark, sf_dir).withColumn("value", rounded("value", 4))


@query(f"WITH {MATRIX} SELECT a.variable AS variable_i, b.variable AS variable_j, round(corr(a.value, b.value), 6) + 0.0 AS correlation FROM m a JOIN m b ON a.area = b.area AND a.variable <= b.variable GROUP BY 1, 2")
def data_matrix_corr_pairs(spark, sf_dir):
    return matrix.correlations(supplier_matrix(spark, sf_dir)).withColumn("correlation", rounded("correlation"))


@query("""WITH c AS (SELECT 'l_quantity' AS name, l_quantity::DOUBLE AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'p_size', p_size FROM part UNION ALL SELECT 'c_name', try_cast(c_name AS DOUBLE) FROM customer)
SELECT name, count(*) AS n_rows, count(v) AS n_valid, count(*) - count(v) AS n_invalid, min(v) AS min_value, max(v) AS max_value, count(DISTINCT v) AS n_distinct, count(DISTINCT v) < 12 AS is_discrete FROM c GROUP BY 1""")
def column_profile(spark, sf_dir):
    out = None
    for table, column in (("lineitem", "l_quantity"), ("lineitem", "l_discount"), ("part", "p_size"), ("customer", "c_name")):
        row = stats.column_profile(read(spark, sf_dir, table), column).select(F.lit(column).alias("name"), "*")
        out = row if out is None else out.union(row)
    return out


@query("SELECT DISTINCT l_discount AS value FROM lineitem WHERE (SELECT count(DISTINCT l_discount) FROM lineitem) < 12")
def discrete_values(spark, sf_dir):
    return stats.discrete_values(read(spark, sf_dir, "lineitem"), "l_discount")


@query("""WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), h AS (SELECT least(greatest(floor((l_quantity - lo) * 8 / (hi - lo)), 0), 7)::INT AS bucket, count(*) AS n FROM lineitem, e GROUP BY 1)
SELECT b::INT AS bucket, coalesce(n, 0) AS n_values FROM range(8) r(b) LEFT JOIN h ON h.bucket = b""")
def histogram_equal_width(spark, sf_dir):
    return stats.equal_width_histogram(read(spark, sf_dir, "lineitem"), "l_quantity", 8)


BREAKS = "b AS (SELECT quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS b FROM lineitem)"


@query(f"WITH {BREAKS} SELECT (k - 1)::INT AS position, round(b[k], 4) AS break FROM b, range(1, 7) r(k)")
def quantile_breaks(spark, sf_dir):
    return classify.quantile_breaks(read(spark, sf_dir, "lineitem"), "l_extendedprice").withColumn("break", rounded("break", 4))


@query(f"WITH {BREAKS} SELECT ((l_extendedprice >= b[2])::INT + (l_extendedprice >= b[3])::INT + (l_extendedprice >= b[4])::INT + (l_extendedprice >= b[5])::INT) AS class, count(*) AS n_rows FROM lineitem, b GROUP BY 1")
def quantile_class_assign(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_extendedprice")
    return classify.assign_classes(rows, "l_extendedprice", classify.breaks_array(rows, "l_extendedprice")).groupBy("class").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"""WITH {BREAKS} SELECT (k - 1)::INT AS position, CASE WHEN k = 1 THEN printf('%.4f', b[1]) || ' (min) <= x < ' || printf('%.4f', b[2]) WHEN k = 6 THEN 'x = ' || printf('%.4f', b[6]) || ' (max)' ELSE printf('%.4f', b[k]) || ' <= x < ' || printf('%.4f', b[k + 1]) END AS legend FROM b, range(1, 7) r(k)""")
def legend_text(spark, sf_dir):
    return classify.legend(classify.breaks_array(read(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query()
def jenks_breaks(spark, sf_dir):
    return classify.jenks_breaks(read(spark, sf_dir, "supplier"), "s_acctbal", 5)


@query()
def map_style(spark, sf_dir):
    return classify.style(read(spark, sf_dir, "lineitem"), "l_discount")


def two_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation by order priority: numbers of orders, and mean prices scaled to their range."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n"), (F.avg("o_totalprice") / 1200).alias("p"))
    keys = ["c_nationkey", "o_orderpriority"]
    return stats.cells(rows.select(*keys, F.col("n").alias("value")), rows.select(*keys, F.col("p").alias("value")), keys)


XY = "c AS (SELECT count(*)::DOUBLE AS x, avg(o_totalprice) / 1200 AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_orderpriority)"
STATS = {
    "n_cells": "count(*)",
    "mean_x": "avg(x)",
    "mean_y": "avg(y)",
    "sd_x": "stddev_pop(x)",
    "sd_y": "stddev_pop(y)",
    "correlation": "corr(x, y)",
    "rmse": "sqrt(avg((x - y) * (x - y)))",
    "chi_squared": "sqrt(sum((x - y) * (x - y) / nullif(x, 0)) FILTER (y <> 0))",
    "dice": "sum(least(x, y)) / sum(y)",
    "jaccard": "sum(least(x, y)) / sum(greatest(x, y))",
    "sum_of_ratios": "sum(x / nullif(y, 0)) FILTER (x <> 0)",
    "average_ratio": "sum(x / nullif(y, 0)) FILTER (x <> 0) / count(*)",
    "absolute_difference": "sum(abs(x - y))",
    "average_absolute_difference": "avg(abs(x - y))",
    "absolute_percent_difference": "sum(abs(x - y) / nullif(x, 0)) FILTER (y <> 0)",
    "average_percent_difference": "sum(abs(x - y) / nullif(x, 0)) FILTER (y <> 0) / count(*)",
}


@query(f"WITH {XY} SELECT " + ", ".join(f"{sql} AS {name}" if name == "n_cells" else f"round({sql}, 6) + 0.0 AS {name}" for name, sql in STATS.items()) + " FROM c")
def matrix_statistics(spark, sf_dir):
    return stats.compare(two_matrices(spark, sf_dir)).select("n_cells", *[rounded(c).alias(c) for c in STATS if c != "n_cells"])


@query(f"WITH {XY} SELECT round(-sum(x / t * log10(x / t)), 6) + 0.0 AS entropy FROM c, (SELECT sum(x) AS t FROM c) WHERE x > 0")
def entropy(spark, sf_dir):
    return stats.entropy(two_matrices(spark, sf_dir), "x").select(rounded("entropy").alias("entropy"))


@query(f"WITH {XY} SELECT round(sum(x / sx * log10(abs((x / sx) / (y / sy)))), 6) + 0.0 AS information_difference FROM c, (SELECT sum(x) AS sx, sum(y) AS sy FROM c) WHERE x <> 0 AND y <> 0")
def information_difference(spark, sf_dir):
    return stats.information_difference(two_matrices(spark, sf_dir)).select(rounded("information_difference").alias("information_difference"))


@query("SELECT o_orderstatus AS status, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(var_samp(o_totalprice), 0) AS variance, round(stddev_samp(o_totalprice), 4) AS std_dev FROM orders GROUP BY 1")
def running_stat(spark, sf_dir):
    return stats.running_stat(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus"]).select(F.col("o_orderstatus").alias("status"), "n", rounded("mean", 4).alias("mean"), rounded("variance", 0).alias("variance"), rounded("std_dev", 4).alias("std_dev"))


@query("SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 2) AS std_dev FROM orders")
def combine_populations(spark, sf_dir):
    parts = stats.running_stat(read(spark, sf_dir, "orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority"])
    return stats.merge_populations(parts).select("n", rounded("mean", 4).alias("mean"), rounded(F.sqrt("variance"), 2).alias("std_dev"))


@query("""WITH c(dataset, name, prob) AS (VALUES (1, 'OA', 0.9), (1, 'OA_2011', 0.9), (1, 'Ward', 0.4), (2, 'OA', 0.9), (2, 'MSOA', 0.7), (3, 'Ward', 0.5)),
h(name, factor) AS (VALUES ('OA', 0.1), ('OA_2011', 2.0)), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY prob DESC, name) AS k FROM c),
t AS (SELECT r.*, max(prob) FILTER (k = 1) OVER (PARTITION BY dataset) = max(prob) FILTER (k = 2) OVER (PARTITION BY dataset) AS tied FROM r),
s AS (SELECT dataset, t.name, prob, CASE WHEN coalesce(tied, false) THEN prob * coalesce(factor, 1) ELSE prob END AS score FROM t LEFT JOIN h USING (name))
SELECT dataset::INT AS dataset, name, prob::DOUBLE AS prob, round(score::DOUBLE, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score DESC, prob DESC, name) = 1""")
def geometry_tie_break(spark, sf_dir):
    rows = spark.createDataFrame([(1, "OA", 0.9), (1, "OA_2011", 0.9), (1, "Ward", 0.4), (2, "OA", 0.9), (2, "MSOA", 0.7), (3, "Ward", 0.5)], "dataset int, name string, prob double")
    hints = spark.createDataFrame([("OA", 0.1), ("OA_2011", 2.0)], "name string, factor double")
    return classify.choose_geometry(rows, hints, ["dataset"]).withColumn("score", rounded("score"))


PIXELS = "p AS (SELECT label AS image, px, avg(embedding[px])*1000 AS r, avg(embedding[px % 64 + 1])*1000 AS g, avg(embedding[(px + 1) % 64 + 1])*1000 AS b FROM embeddings, range(1, 65) r(px) GROUP BY 1, 2)"


@query(f"WITH {PIXELS} SELECT a.image AS image_i, b.image AS image_j, round(avg(sqrt((a.r-b.r)*(a.r-b.r)+(a.g-b.g)*(a.g-b.g)+(a.b-b.b)*(a.b-b.b))), 3) + 0.0 AS distance FROM p a JOIN p b USING (px) GROUP BY 1, 2")
def image_rgb_distance(spark, sf_dir):
    e = F.col("embedding")
    rows = read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("at", "v"))
    means = rows.groupBy("label", "at").agg((F.avg("v") * 1000).alias("v"))
    at = lambda k: F.avg(F.when(F.col("shift") == k, F.col("v")))
    spread = means.select("label", "v", F.explode(F.array(*[F.struct(F.lit(k).alias("shift"), F.pmod(F.col("at") - k, F.lit(64)).alias("px")) for k in range(3)])).alias("s")).select(F.col("label").alias("image"), "v", "s.shift", "s.px")
    return images.rgb_distance(spread.groupBy("image", "px").agg(at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))).withColumn("distance", rounded("distance", 3))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))


@query("""WITH n AS (SELECT vec_id // 4 AS y, vec_id % 4 AS x, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id < 16),
d AS (SELECT vec_id, y, x, list_sum([abs(w[k] - embedding[k]::DOUBLE) for k in range(1, 65)]) AS d FROM embeddings, n)
SELECT vec_id, y::INT AS win_y, x::INT AS win_x, round(d, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, y, x) = 1""")
def som_classify(spark, sf_dir):
    """All vectors against a map whose 16 neurons are given: the vectors 0 to 15."""
    rows = vectors(spark, sf_dir)
    neurons = rows.where("vec_id < 16").select(F.floor(F.col("vec_id") / 4).cast("int").alias("y"), F.pmod("vec_id", F.lit(4)).cast("int").alias("x"), F.col("vec").alias("weights"))
    return som.classify(rows, neurons).select("vec_id", "win_y", "win_x", rounded("distance", 5).alias("distance"))


@query()
def som_train(spark, sf_dir):
    return som.train(vectors(spark, sf_dir), n=4).weights.select("y", "x", F.posexplode("weights").alias("j", "w"))


@query()
def som_errors(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return som.errors(som.normalise(rows), som.train(rows, n=4).weights)


PAIRS = "p AS (SELECT l_partkey % 50 AS a, l_suppkey % 50 AS b, l_discount - 0.05 AS v, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem)"


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "lineitem").select((c("l_partkey") % 50).alias("a"), (c("l_suppkey") % 50).alias("b"), (c("l_discount") - 0.05).alias("v"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(f"WITH {PAIRS} SELECT a, b, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM p QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY {', '.join(ORDER)}, a, b, v) = 1")
def pair_clean_dedupe(spark, sf_dir):
    return postprocess.dedupe_pairs(pair_rows(spark, sf_dir), ["a"], ["b"], ORDER).select("a", "b", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_returnflag = 'R' AND d.l_partkey = l.l_partkey AND d.l_suppkey = l.l_suppkey)")
def resume_anti_join(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    return postprocess.not_done(li.select(*keys).distinct(), li.where("l_returnflag = 'R'"), keys)


@query(f"WITH {PAIRS}, q AS (SELECT a % 7 AS i, b % 7 AS j, v FROM p), s AS (SELECT i, j, v FROM q UNION ALL SELECT j, i, v FROM q) SELECT i AS table_i, j AS table_j, round(avg(v), 6) + 0.0 AS mean, count(*) AS n, count(*) FILTER (v > 0) AS n_plus, count(*) FILTER (v < 0) AS n_minus FROM s GROUP BY 1, 2")
def table_relationships(spark, sf_dir):
    c = F.col
    return postprocess.table_relationships(pair_rows(spark, sf_dir).select((c("a") % 7).alias("table_i"), (c("b") % 7).alias("table_j"), c("v").alias("value"))).withColumn("mean", rounded("mean"))


@query(f'WITH {PAIRS} SELECT t AS "table", count(*) AS n FROM (SELECT a % 7 AS t FROM p UNION ALL SELECT b % 7 FROM p) GROUP BY 1')
def rows_per_table(spark, sf_dir):
    c = F.col
    return postprocess.rows_per_table(pair_rows(spark, sf_dir).select((c("a") % 7).alias("table_i"), (c("b") % 7).alias("table_j")))


@query("""WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) % 3600000 AS ms FROM events), s AS (SELECT *, coalesce((ms < lag(ms) OVER w - 30000)::INT, 1) AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS session FROM s)
SELECT user_id, session::BIGINT AS session, count(*) AS n_rows, round(count(*) * 1000.0 / nullif(max(ms) - min(ms), 0), 6) AS rate FROM n GROUP BY 1, 2""")
def session_throughput(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", "event_id", F.pmod(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(3_600_000)).alias("ms"))
    return postprocess.session_throughput(rows, ["user_id"], "event_id", "ms").select("user_id", "session", "n_rows", rounded("rate").alias("rate"))


@query(f"""WITH {PAIRS}, f AS (SELECT 'v' || b AS name, min((l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS f FROM p GROUP BY 1)
SELECT (row_number() OVER (ORDER BY f, name) - 1)::INT AS i, name FROM f""")
def pair_matrix_index(spark, sf_dir):
    rows = pair_rows(spark, sf_dir).select(F.struct(*ORDER).alias("row_no"), F.concat(F.lit("v"), "a").alias("name_i"), F.concat(F.lit("v"), "b").alias("name_j"), F.col("v").alias("value"))
    return matrix.from_moran_pairs(rows)[1]


@query("""WITH r AS (SELECT c_custkey AS row_no, (c_nationkey + 3)::INT AS i, (c_custkey % 5)::INT AS j, c_acctbal AS v FROM customer), s AS (SELECT row_no, i, j, v FROM r UNION ALL SELECT row_no, j, i, v FROM r)
SELECT i, j, arg_max(v, row_no) AS value FROM s GROUP BY 1, 2""")
def pair_matrix_cells(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_no"), (F.col("c_nationkey") + 3).cast("int").alias("i"), F.pmod("c_custkey", F.lit(5)).cast("int").alias("j"), F.lit("x").alias("name_i"), F.lit("y").alias("name_j"), F.col("c_acctbal").alias("value"))
    return matrix.from_knn_pairs(rows)[0]


@query(f"""WITH {MATRIX}, k AS (SELECT a.variable AS i, b.variable AS j, corr(a.value, b.value) AS v FROM m a JOIN m b ON a.area = b.area AND a.variable <= b.variable GROUP BY 1, 2)
SELECT i AS x, j AS y, (CASE WHEN v > 0 THEN floor(least(abs(v), 1) * 255) ELSE 0 END)::INT AS r, 0 AS g, (CASE WHEN v < 0 THEN floor(least(abs(v), 1) * 255) ELSE 0 END)::INT AS b FROM (SELECT i, j, round(v, 6) AS v FROM k)""")
def matrix_image(spark, sf_dir):
    cells = matrix.correlations(supplier_matrix(spark, sf_dir)).select(F.col("variable_i").alias("i"), F.col("variable_j").alias("j"), rounded("correlation").alias("value"))
    return matrix.matrix_image(cells)
