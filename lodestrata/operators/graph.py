"""Graphs as two DataFrames: vertices (id, label, ...) and edges (src, dst, weight, ...)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared checkpoint folder where one is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(f"/tmp/lodestrata-checkpoints-{uuid.uuid4().hex}")
    return df.checkpoint()


def add_vertices(vertices: DataFrame, new: DataFrame) -> DataFrame:
    """vertices and those of new whose id isn't taken."""
    return vertices.unionByName(new.join(vertices.select("id"), "id", "left_anti"), allowMissingColumns=True)


def number_vertices(labels: DataFrame, start: int = 0) -> DataFrame:
    """label rows with ids from ``start`` in order of label, without one global sort task.

    Partitions are ranges of labels; each is numbered by itself and shifted by
    the counts of those before it.
    """
    parts = _cut(labels.select("label").distinct().repartitionByRange("label").sortWithinPartitions("label").withColumn("seq", F.monotonically_increasing_id()))
    sizes = {r.part: r.n for r in parts.groupBy(F.shiftright("seq", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shift, at = [], start
    for part in sorted(sizes):
        shift.append((part, at))
        at += sizes[part]
    table = labels.sparkSession.createDataFrame(shift, "part long, shift long")
    return parts.withColumn("part", F.shiftright("seq", 33)).join(F.broadcast(table), "part").select((F.col("seq").bitwiseAND((1 << 33) - 1) + F.col("shift")).alias("id"), "label")


def connect(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new, allowMissingColumns=True)


def count_edges(pairs: DataFrame) -> DataFrame:
    """src < dst, weight: how often each unordered pair occurs."""
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def delete_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the vertices of gone (id) and every edge at one of them."""
    ids = gone.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return vertices.join(ids, "id", "left_anti"), kept.select(*edges.columns)


def without_orphans(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return vertices.join(ends, "id", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def strength(edges: DataFrame) -> DataFrame:
    """id, strength: total weight of the edges at each vertex, a loop counting twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").cast("double").alias("strength"))


def weight_between(edges: DataFrame, a, b) -> DataFrame:
    """One row: total weight of the edges between two vertices, either way."""
    hit = ((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a))
    return edges.where(hit).agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("weight"))


def cuts(edges: DataFrame) -> DataFrame:
    """src, dst, ncut = w/strength(src) + w/strength(dst) for each connected pair."""
    total = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").cast("double").alias("weight"))
    s = strength(edges)
    met = total.join(s.select(F.col("id").alias("src"), F.col("strength").alias("a")), "src").join(s.select(F.col("id").alias("dst"), F.col("strength").alias("b")), "dst")
    return met.select("src", "dst", (F.try_divide("weight", "a") + F.try_divide("weight", "b")).alias("ncut"))


def associations(edges: DataFrame) -> DataFrame:
    """src, dst, nassoc = w(src,src)/strength(src) + w(dst,dst)/strength(dst) for each connected pair.

    In an undirected graph w(v,v) is the weight of all edges at v, so each
    term of a vertex with edges is 1; loops alone would give less.
    """
    s = strength(edges)
    own = s.select("id", F.try_divide("strength", "strength").alias("share"))
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return pairs.join(own.select(F.col("id").alias("src"), F.col("share").alias("a")), "src").join(own.select(F.col("id").alias("dst"), F.col("share").alias("b")), "dst").select("src", "dst", (F.col("a") + F.col("b")).alias("nassoc"))


def reach(edges: DataFrame, source, limit: float | None = None, directed: bool = False) -> DataFrame:
    """id, distance, previous: least path weight from a vertex, no further than ``limit``.

    Rounds of relaxation: only vertices whose distance fell send messages, and
    each round is checkpointed.  Weights must not be negative.  Of equal paths
    the smallest previous vertex is named.
    """
    links = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")) if directed else both_ways(edges).select("src", "dst", F.col("weight").cast("double").alias("weight"))
    links = links.groupBy("src", "dst").agg(F.min("weight").alias("weight")).persist()
    kind = dict(edges.dtypes)["src"]
    known = edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("id"), F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("previous"))
    front = known
    while True:
        sent = front.join(links, front.id == links.src).select(F.col("dst").alias("id"), (F.col("distance") + F.col("weight")).alias("distance"), F.col("src").alias("previous"))
        if limit is not None:
            sent = sent.where(F.col("distance") <= limit)
        best = sent.groupBy("id").agg(F.min(F.struct("distance", "previous")).alias("new"))
        better = best.join(known.select("id", F.col("distance").alias("old")), "id", "left").where("old is null or new.distance < old").select("id", "new.distance", "new.previous")
        front = _cut(better)
        if front.isEmpty():
            return known
        known = _cut(known.join(front.select("id"), "id", "left_anti").union(front))


def shortest_path(edges: DataFrame, source, target, directed: bool = False) -> DataFrame:
    """step, id, distance along the lightest path; no rows if there is none."""
    found = reach(edges, source, directed=directed).persist()
    path, at = [], target
    while at is not None:
        row = found.where(F.col("id") == at).first()
        if row is None:
            break
        path.append((row.id, row.distance))
        at = row.previous
    kind = dict(edges.dtypes)["src"]
    return edges.sparkSession.createDataFrame([(k, i, d) for k, (i, d) in enumerate(reversed(path))], f"step int, id {kind}, distance double")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that each vertex is connected with, itself included.

    Labels spread along edges and then jump to the label of their label, so
    long chains take few rounds; each round is checkpointed.
    """
    links = both_ways(edges.select("src", "dst", F.lit(1).alias("weight"))).select("src", "dst").distinct().persist()
    now = _cut(vertices.select("id", F.col("id").alias("component")).distinct())
    while True:
        sent = links.join(now, links.src == now.id).groupBy(F.col("dst").alias("reached")).agg(F.min("component").alias("offer"))
        met = now.join(sent, now.id == sent.reached, "left").select("id", F.least("component", F.coalesce("offer", "component")).alias("component"))
        up = met.select(F.col("id").alias("top"), F.col("component").alias("top_component"))
        after = _cut(met.join(up, met.component == up.top, "left").select("id", F.least("component", F.coalesce("top_component", "component")).alias("component")))
        if after.join(now.withColumnRenamed("component", "before"), "id").where("component <> before").isEmpty():
            return after
        now = after


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Lightest spanning forest by rounds: every component takes its lightest edge (of equals the smallest pair)."""
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.min("weight").alias("weight"))
    rows = _cut(rows)
    vertices = _cut(rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    taken = rows.limit(0)
    group = vertices.select("id", F.col("id").alias("component"))
    while True:
        ends = rows.join(group.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(group.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a <> b")
        best = ends.select(F.explode(F.array("a", "b")).alias("c"), F.struct("weight", "src", "dst").alias("e")).groupBy("c").agg(F.min("e").alias("e")).select("e.src", "e.dst", "e.weight").distinct()
        best = _cut(best)
        if best.isEmpty():
            return taken
        taken = _cut(taken.union(best))
        group = components(vertices, taken)


def component_sizes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """size, n_components: how many components have so many vertices, those of one vertex included."""
    sizes = components(vertices, edges).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_components"))


def cluster_counts(cells: DataFrame, size: int, cut: float) -> DataFrame:
    """n_clusters of a matrix of ``size`` nodes numbered from 0: i and j hang together if their value is at least the cut."""
    spark = cells.sparkSession
    nodes = spark.range(size).select(F.col("id"))
    edges = cells.where((F.col("value") >= cut) & (F.col("i") != F.col("j"))).select(F.col("i").cast("long").alias("src"), F.col("j").cast("long").alias("dst"))
    return components(nodes, edges).agg(F.count_distinct("component").alias("n_clusters"))


def cluster_sweep(cells: DataFrame, size: int, cuts: list[float]) -> DataFrame:
    """cut, n_clusters for all cuts at once: one component run over (cut, node) pairs."""
    spark = cells.sparkSession
    wanted = spark.createDataFrame([(k, float(c)) for k, c in enumerate(cuts)], "k int, cut double")
    code = lambda node: F.col("k").cast("long") * size + F.col(node).cast("long")
    nodes = spark.range(size).crossJoin(F.broadcast(wanted)).select(code("id").alias("id"))
    edges = cells.where("i <> j").crossJoin(F.broadcast(wanted)).where("value >= cut").select(code("i").alias("src"), code("j").alias("dst"))
    found = components(nodes, edges).select(F.floor(F.col("id") / size).cast("int").alias("k"), "component").distinct()
    return found.groupBy("k").agg(F.count(F.lit(1)).alias("n_clusters")).join(F.broadcast(wanted), "k").select("cut", "n_clusters")


def degree_sweep(cells: DataFrame, size: int, cuts: list[float]) -> DataFrame:
    """cut, average_degree: cells above the cut, the diagonal included, for each of ``size`` nodes."""
    spark = cells.sparkSession
    wanted = spark.createDataFrame([(float(c),) for c in cuts], "cut double")
    return cells.crossJoin(F.broadcast(wanted)).groupBy("cut").agg((F.count_if(F.col("value") > F.col("cut")) / size).alias("average_degree"))


# --- keyword graphs --------------------------------------------------------


def links_graph(index: DataFrame, least_docs: int = 700, least_weight: int = 1) -> DataFrame:
    """src < dst, weight: documents by how many keywords they share.

    index: distinct (word, doc).  Only keywords in at least ``least_docs``
    documents count; the filter stands before the self-join, which is on the
    word.
    """
    common = index.groupBy("word").count().where(F.col("count") >= least_docs).select("word")
    kept = index.join(common, "word")
    met = kept.select("word", F.col("doc").alias("src")).join(kept.select("word", F.col("doc").alias("dst")), "word").where("src < dst")
    return met.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least_weight)


def keyword_graph(index: DataFrame, order: DataFrame | None = None, least_docs: int = 200, least_weight: int = 2, least_strength: float = 100.0) -> DataFrame:
    """src, dst, weight: keywords by how many documents they share.

    order: (word, ord); of a pair the word that comes first needs
    ``least_docs`` documents.  Without it words are ordered alphabetically.
    Edges below ``least_weight`` go first, then, once, edges at keywords whose
    strength is below ``least_strength``.
    """
    counts = index.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.join(order, "word") if order is not None else counts.withColumn("ord", F.col("word"))
    kept = index.join(ranked, "word")
    a = kept.where(F.col("n") >= least_docs).select("doc", F.col("word").alias("src"), F.col("ord").alias("ord_a"))
    b = kept.select("doc", F.col("word").alias("dst"), F.col("ord").alias("ord_b"))
    edges = a.join(b, "doc").where("ord_a < ord_b").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least_weight)
    weak = strength(edges).where(F.col("strength") < least_strength)
    return edges.join(weak.select(F.col("id").alias("src")), "src", "left_anti").join(weak.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "weight")


def first_seen(words: DataFrame) -> DataFrame:
    """word, ord: where each word first stands, as (document, position, word), which orders words without numbering them."""
    first = words.groupBy("word").agg(F.min(F.struct("doc", "pos")).alias("first"))
    return first.select("word", F.struct("first", "word").alias("ord"))


def flatten(edges: DataFrame) -> DataFrame:
    """part, step, id: every component as a walk that goes depth first and names the parent again before each child.

    The walk is sequential, so a component is one group; meant for small graphs
    such as outlines.
    """
    import pandas as pd

    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    group = components(nodes, edges)
    rows = edges.join(group, edges.src == group.id).select("component", "src", "dst")
    kind = dict(edges.dtypes)["src"]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf.src, pdf.dst, strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        top = min(near)
        path, seen, stack = [top], {top}, [(top, iter(sorted(near[top])))]
        while stack:
            at, rest = stack[-1]
            nxt = next((x for x in rest if x not in seen), None)
            if nxt is None:
                stack.pop()
                continue
            if path[-1] != at:
                path.append(at)
            seen.add(nxt)
            path.append(nxt)
            stack.append((nxt, iter(sorted(near[nxt]))))
        return pd.DataFrame({"part": pdf.component.iloc[0], "step": range(len(path)), "id": path})

    return rows.groupBy("component").applyInPandas(walk, f"part {kind}, step int, id {kind}")
