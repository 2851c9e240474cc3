import random

import pytest

from lodestrata.operators import graph


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, weight double")


def dijkstra(rows, source, directed=False):
    near = {}
    for a, b, w in rows:
        near.setdefault(a, []).append((b, w))
        if not directed:
            near.setdefault(b, []).append((a, w))
    d, todo = {source: 0.0}, [source]
    while todo:
        a = min(todo, key=d.get)
        todo.remove(a)
        for b, w in near.get(a, []):
            if d[a] + w < d.get(b, float("inf")):
                d[b] = d[a] + w
                todo = [*{*todo, b}]
    return d


@pytest.mark.parametrize("directed", [False, True])
def test_reach(spark, directed):
    rnd = random.Random(8)
    rows = [(rnd.randrange(20), rnd.randrange(20), rnd.randrange(1, 9)) for _ in range(30)]
    e = edges(spark, rows)
    want = dijkstra(rows, 3, directed)
    assert {r.id: r.distance for r in graph.reach(e, 3, directed=directed).collect()} == want
    near = {r.id: r.distance for r in graph.reach(e, 3, limit=8, directed=directed).collect()}
    assert near == {k: v for k, v in want.items() if v <= 8}
    far = max(want, key=want.get)
    path = graph.shortest_path(e, 3, far, directed).orderBy("step").collect()
    assert path[0].id == 3 and path[-1].id == far and path[-1].distance == want[far]
    assert graph.shortest_path(e, 3, 999).collect() == []


def test_components(spark):
    rows = [(k, k + 1, 1) for k in range(30)] + [(50, 51, 1), (52, 51, 1)]
    v = spark.createDataFrame([(k,) for k in [*range(31), 50, 51, 52, 60]], "id long")
    got = {r.id: r.component for r in graph.components(v, edges(spark, rows)).collect()}
    assert got == {k: 0 for k in range(31)} | {50: 50, 51: 50, 52: 50, 60: 60}


def test_sweeps(spark):
    cells = spark.createDataFrame([(0, 1, 0.6), (1, 0, 0.6), (0, 2, 0.1), (1, 2, 0.1), (0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)], "i int, j int, value double")
    assert graph.cluster_counts(cells, 3, 0.6).first().n_clusters == 2
    assert {r.cut: r.n_clusters for r in graph.cluster_sweep(cells, 3, [0.0, 0.6, 0.7]).collect()} == {0.0: 1, 0.6: 2, 0.7: 3}
    ones = spark.createDataFrame([(i, j, 1.0) for i in range(2) for j in range(2)], "i int, j int, value double")
    assert graph.degree_sweep(ones, 2, [0.5, 1.0]).orderBy("cut").collect()[0].average_degree == 2
    assert graph.degree_sweep(ones, 2, [0.5, 1.0]).orderBy("cut").collect()[1].average_degree == 0


def test_edit(spark):
    v = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, label string")
    e = edges(spark, [(1, 2, 2), (2, 3, 1), (2, 1, 3)])
    assert graph.add_vertices(v, spark.createDataFrame([(3, "x"), (4, "d")], v.schema)).count() == 4
    kept, rest = graph.delete_vertices(v, e, v.where("id = 3"))
    assert kept.count() == 2 and rest.count() == 2
    assert graph.without_orphans(v, rest).count() == 2
    assert graph.delete_edges(e, e.where("src = 1")).count() == 2
    assert graph.weight_between(e, 2, 1).first().weight == 5
    assert {r.id: r.strength for r in graph.strength(e).collect()} == {1: 5, 2: 6, 3: 1}
    assert {(r.src, r.dst): r.ncut for r in graph.cuts(e).collect()} == {(1, 2): 1 + 5 / 6, (2, 3): 1 / 6 + 1}
    assert {r.nassoc for r in graph.associations(e).collect()} == {2.0}
    assert [(r.src, r.dst, r.weight) for r in graph.count_edges(e).orderBy("src", "dst").collect()] == [(1, 2, 2), (2, 3, 1)]
    names = graph.number_vertices(spark.createDataFrame([(x,) for x in "dbcab"], "label string"), 1)
    assert [(r.id, r.label) for r in names.orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert graph.connect(e, e).count() == 6


def test_forest_and_walk(spark):
    rows = [(1, 2, 1), (2, 3, 2), (1, 3, 3), (3, 4, 1), (7, 8, 5), (9, 9, 1)]
    got = sorted((r.src, r.dst, r.weight) for r in graph.spanning_forest(edges(spark, rows)).collect())
    assert got == [(1, 2, 1), (2, 3, 2), (3, 4, 1), (7, 8, 5)]
    walk = [r.id for r in graph.flatten(edges(spark, [(1, 2, 1), (1, 3, 1), (2, 4, 1)])).orderBy("step").collect()]
    assert walk == [1, 2, 4, 1, 3]


def test_keyword_graphs(spark):
    rows = [(d, w) for d, ws in enumerate(["ab", "ab", "abc", "bc", "d"]) for w in ws]
    index = spark.createDataFrame([(w, d) for d, w in rows], "word string, doc int")
    links = {(r.src, r.dst): r.weight for r in graph.links_graph(index, 3).collect()}
    assert links[0, 1] == 2 and links[0, 3] == 1 and (3, 4) not in links
    kw = {(r.src, r.dst): r.weight for r in graph.keyword_graph(index, least_docs=3, least_weight=2, least_strength=0).collect()}
    assert kw == {("a", "b"): 3, ("b", "c"): 2}
    assert {(r.src, r.dst) for r in graph.keyword_graph(index, least_docs=3, least_weight=2, least_strength=3).collect()} == {("a", "b")}
    assert graph.links_graph(index.limit(0), 1).collect() == []


def test_empty(spark):
    e = edges(spark, [])
    assert graph.strength(e).collect() == [] and graph.spanning_forest(e).collect() == []
    assert [r.id for r in graph.reach(e, 5).collect()] == [5]
