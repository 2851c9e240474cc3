import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import classify, images, matrix, postprocess, som, spatial, stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_running_stat(spark):
    df = frame(spark, [("a", float(v)) for v in (2, 4, 4, 4, 5, 5, 7, 9)] + [("b", 3.0)], "k string, v double")
    got = {r.k: r for r in stats.running_stat(df, "v", ["k"]).collect()}
    assert (got["a"].n, got["a"].mean) == (8, 5) and abs(got["a"].variance - 32 / 7) < 1e-12
    assert (got["b"].variance, got["b"].std_dev) == (0, 0)


def test_combine(spark):
    r = spark.range(1).select(
        stats.combine_means(F.lit(2.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("m"),
        stats.combine_variances(F.lit(2.0), F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(3.0), F.lit(0.0), F.lit(2.0)).alias("v"),
        stats.combine_std_devs(F.lit(2.0), F.lit(1.0), F.lit(0.0), F.lit(2.0), F.lit(3.0), F.lit(0.0), F.lit(2.0)).alias("s"),
        stats.combine_means(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(3.0)).alias("none"),
    ).first()
    assert (r.m, r.v, r.s, r.none) == (2, 1, 1, None)


def test_merge_populations(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.gauss(k, 2)) for k in range(5) for _ in range(k + 1)]
    df = frame(spark, rows, "k int, v double")
    got = stats.merge_populations(stats.running_stat(df, "v", ["k"])).first()
    v = np.array([x for _, x in rows])
    assert got.n == len(v) and abs(got.mean - v.mean()) < 1e-9 and abs(got.variance - v.var(ddof=1)) < 1e-9
    assert stats.merge_populations(stats.running_stat(df, "v", ["k"]), exact=False).first().variance != got.variance


def test_compare_goldens(spark):
    xy = frame(spark, [(1.0, 2.0), (2.0, 2.0), (0.0, 5.0)], "x double, y double")
    r = stats.compare(xy).first()
    assert (r.chi_squared, r.sum_of_ratios, r.average_ratio, r.absolute_percent_difference) == (1, 1.5, 0.5, 1)
    assert abs(r.dice - 3 / 9) < 1e-12 and abs(r.jaccard - 3 / 9) < 1e-12
    same = stats.compare(frame(spark, [(1.0, 1.0), (1.0, 2.0)], "x double, y double")).first()
    assert same.correlation is None
    assert stats.compare(frame(spark, [(0.0, 0.0)], "x double, y double")).first().dice is None


def test_entropy_edges(spark):
    assert abs(stats.entropy(frame(spark, [(1.0,), (1.0,), (0.0,)], "v double"), "v").first()[0] - math.log10(2)) < 1e-12
    assert stats.entropy(frame(spark, [(0.0,)], "v double"), "v").first()[0] == 0
    assert stats.information_difference(frame(spark, [(1.0, 1.0), (2.0, 2.0)], "x double, y double")).first()[0] == 0


def test_profile_and_histogram(spark):
    df = frame(spark, [(str(k % 11),) for k in range(40)] + [("x",), (None,), ("NaN",)], "v string")
    r = stats.column_profile(df, "v").first()
    assert (r.n_rows, r.n_valid, r.n_invalid, r.min_value, r.max_value, r.n_distinct, r.is_discrete) == (43, 40, 3, 0, 10, 11, True)
    assert not stats.column_profile(frame(spark, [(str(k),) for k in range(13)], "v string"), "v").first().is_discrete
    assert stats.discrete_values(frame(spark, [(float(k),) for k in range(13)], "v double"), "v").count() == 0
    h = stats.equal_width_histogram(frame(spark, [(float(k),) for k in range(101)], "v double"), "v", 4).orderBy("bucket").collect()
    assert [x.n_values for x in h] == [25, 25, 25, 26]
    one = stats.equal_width_histogram(frame(spark, [(3.0,), (3.0,)], "v double"), "v", 2).orderBy("bucket").collect()
    assert [x.n_values for x in one] == [2, 0]


def grid(spark, n=40, seed=2, blocks=None):
    rng = np.random.default_rng(seed)
    xy, v = rng.uniform(0, 9, (n, 2)), rng.normal(size=(n, 3))
    xy[1] = xy[0]
    cents = frame(spark, [(k, float(a), float(b)) for k, (a, b) in enumerate(xy)], "area int, x double, y double")
    m = frame(spark, [(k, f"v{j}", float(v[k, j])) for k in range(n) for j in range(3)] + [(k, "flat", 1.0) for k in range(n)], "area int, variable string, value double")
    return xy, v, cents, m


@pytest.mark.parametrize("block", [1 << 23, 40])
def test_moran_fast_is_naive(spark, monkeypatch, block):
    monkeypatch.setattr(spatial, "BLOCK", block)
    xy, v, cents, m = grid(spark)
    d = np.linalg.norm(xy[:, None] - xy[None], axis=2)
    w = np.where(d < 1, 1, 1 / np.where(d < 1, 1, d))
    z = (v - v.mean(0)) / v.std(0, ddof=1)
    want = z.T @ w @ z / w.sum()
    got = {(r.variable_i, r.variable_j): r.moran_i for r in spatial.moran_all_pairs(m, cents).collect()}
    assert len(got) == 6
    for i, j in itertools.combinations_with_replacement(range(3), 2):
        assert abs(got[f"v{i}", f"v{j}"] - want[i, j]) < 1e-9
    s = spatial.moran_static(m, cents, "v0", "v1").first()
    assert abs(s.i2 - (z[:, 0] * z[:, 1] * w.sum(1)).sum() / w.sum()) < 1e-9
    assert abs(s.i1 - v[:, 1] @ w @ v[:, 0] / (w.sum() * v[:, 0].std(ddof=1) * v[:, 1].std(ddof=1))) < 1e-9
    near = spatial.nearest(cents, 3).collect()
    np.fill_diagonal(d, np.inf)
    for k in range(len(xy)):
        mine = sorted((r.rank, r.neighbour) for r in near if r.area == k)
        assert [n for _, n in mine] == list(np.argsort(d[k], kind="stable")[:3])


def test_knn(spark):
    xy, v, cents, m = grid(spark)
    near = spatial.nearest(cents, 3)
    n = len(xy)
    self_corr = spatial.knn_correlation(m, near, "v0", "v0", 3, as_coded=True).first().knn_corr
    assert abs(self_corr - (n - 1) / n) < 1e-12
    pairs = {(r.variable_i, r.variable_j): r.knn_corr for r in spatial.knn_all_pairs(m, near, 3).collect()}
    one = spatial.knn_correlation(m, near, "v1", "v2", 3).first().knn_corr
    assert abs(pairs["v1", "v2"] - one) < 1e-12 and len(pairs) == 9


def test_spatial_empty(spark):
    cents = frame(spark, [], "area int, x double, y double")
    m = frame(spark, [], "area int, variable string, value double")
    assert spatial.weights_total(cents).first().s0 == 0
    assert spatial.moran_all_pairs(m, cents).collect() == []
    assert spatial.nearest(cents, 2).collect() == []
    assert spatial.nearest(frame(spark, [(1, 0.0, 0.0)], "area int, x double, y double"), 2).collect() == []


def test_matrices(spark):
    areas = frame(spark, [("a",), ("b",)], "area string")
    t = matrix.melt(frame(spark, [("a", 1.0, "2"), ("c", 3.0, "x")], "area string, p double, q string"), "area", ["p", "q"])
    got = {(r.area, r.variable): r.value for r in matrix.build(areas, [t]).collect()}
    assert got == {("a", "p"): 1, ("a", "q"): 2, ("b", "p"): 0, ("b", "q"): 0}
    pairs = frame(spark, [(1, 0, 2, "n0", "n2", "0.5"), (2, 2, 0, "n2", "n0", "0.7"), (3, 4, 4, "n4", "n4", "bad")], "row_no int, i int, j int, name_i string, name_j string, value string")
    cells, names = matrix.from_knn_pairs(pairs)
    assert {(r.i, r.j): r.value for r in cells.collect()} == {(0, 2): 0.7, (2, 0): 0.7}
    assert [r.name for r in names.orderBy("i").collect()] == ["n0", "Missing_1", "n2", "Missing_3", "n4"]
    cells, names = matrix.from_moran_pairs(pairs)
    assert [r.name for r in names.orderBy("i").collect()] == ["n2", "n0", "n4"]
    pix = matrix.matrix_image(frame(spark, [(0, 0, -2.0), (0, 1, 0.5), (1, 1, float("nan"))], "i int, j int, value double")).collect()
    assert [tuple(p)[2:] for p in pix] == [(0, 0, 255), (127, 0, 0), (255, 255, 255)]


def test_breaks(spark):
    df = frame(spark, [(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    b = [r["break"] for r in classify.quantile_breaks(df, "v").orderBy("position").collect()]
    assert np.allclose(b, [1, 1.6, 2.2, 2.8, 5.8, 10])
    nudged = spark.range(1).select(classify.nudge(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))).alias("b")).first().b
    assert nudged[1] == 1 + 3e-8 and nudged[2:] == [0, 0]
    assert classify.quantile_breaks(df.limit(0), "v").collect() == []


def cost(parts):
    return sum(((np.array(p) - np.mean(p)) ** 2).sum() for p in parts)


@pytest.mark.parametrize("seed", range(4))
def test_jenks_is_best(spark, seed):
    rnd = random.Random(seed)
    v = sorted(rnd.choice([rnd.random(), rnd.random() + 5, rnd.randrange(9)]) for _ in range(14))
    got = classify.natural_breaks(np.unique(v), np.array([v.count(x) for x in np.unique(v)]), 4)
    best = min(cost([v[a:b] for a, b in itertools.pairwise([0, *c, len(v)])]) for c in itertools.combinations(range(1, len(v)), 3))
    parts = [[x for x in v if (k == 0 or x > got[k - 1]) and x <= got[k]] for k in range(4)]
    assert abs(cost(parts) - best) < 1e-9
    rows = classify.jenks_breaks(frame(spark, [(float(x),) for x in v], "v double"), "v", 4).orderBy("position").collect()
    assert [r.upper for r in rows] == got


def test_jenks_edges(spark):
    df = frame(spark, [(1.0,), (1.0,)], "v double")
    assert [r.upper for r in classify.jenks_breaks(df, "v", 5).collect()] == [1.0]
    assert classify.jenks_breaks(df.limit(0), "v").collect() == []
    many = classify.jenks_breaks(frame(spark, [(float(k % 500) + 1000 * (k % 3),) for k in range(3000)], "v double"), "v", 3, most=100).collect()
    assert [r.upper for r in many] == [499.0, 1499.0, 2499.0]


def test_jenks_is_exact_at_every_size(spark):
    """Five natural classes, more distinct values than 50,000, and one extreme value."""
    rng = np.random.default_rng(9)
    v = np.concatenate([1000 * k + rng.uniform(0, 100, 15_000) for k in range(4)] + [[1e9]])
    got = [r.upper for r in classify.jenks_breaks(frame(spark, [(float(x),) for x in v], "v double"), "v", 5).orderBy("position").collect()]
    assert got == [v[:15_000].max(), v[15_000:30_000].max(), v[30_000:45_000].max(), v[45_000:60_000].max(), 1e9]


def test_jenks_blocks_change_nothing():
    rng = np.random.default_rng(10)
    v, n = np.unique(np.round(rng.normal(size=3000) ** 3, 2), return_counts=True)
    want = classify.natural_breaks(v, n, 6)
    assert [classify.natural_breaks(v, n, 6, most=m) for m in (1, 50, 4000)] == [want] * 3


def test_colours():
    assert [len(own) for _, own in classify.GROUPS] == [18, 9, 8]
    assert classify.colours("YlGn", 3) == [(255, 255, 229), (120, 198, 121), (0, 69, 41)]
    assert classify.colours("Set1", 11)[-2:] == [(0, 0, 0)] * 2 and classify.colours("nothing", 2) == [(0, 0, 0)] * 2
    assert classify.find_scheme("RdBu")[0] == "diverging" and classify.find_scheme("?") is None


def test_geometry(spark):
    rows = frame(spark, [("OA", 0.9), ("OA_2011", 0.9), ("Ward", 0.2)], "name string, prob double")
    hints = classify.set_hint(frame(spark, [("OA", 5.0)], "name string, factor double"), "OA", 0.1)
    hints = classify.set_hint(hints, "OA_2011", 2.0)
    got = classify.choose_geometry(rows, hints).first()
    assert got.name == "OA_2011" and abs(got.score - 1.8) < 1e-12
    assert classify.choose_geometry(rows.where("name = 'Ward'"), hints).first().name == "Ward"
    box = classify.square_box(frame(spark, [(0.0, 0.0, 4.0, 2.0)], "min_x double, min_y double, max_x double, max_y double")).first()
    assert tuple(box) == (0, -1, 4, 3)
    lon = classify.extent(frame(spark, [(-20037508.342789244, -20037508.342789244, 0.0, 0.0)], "min_x double, min_y double, max_x double, max_y double")).first()
    assert abs(lon.min_lon + 180) < 1e-9 and abs(lon.min_lat + 85.0511287798) < 1e-6 and lon.max_lat == 0


def test_som(spark):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=12) + 5 * np.eye(12)[k % 3]).tolist()) for k in range(60)] + [(99, [1.0] * 12)]
    df = frame(spark, rows, "id int, vec array<double>")
    done = som.train(df, n=3, max_epochs=600, seed=5)
    assert done.history[-1][1] < done.history[0][1]
    again = som.train(df, n=3, max_epochs=600, seed=5)
    assert [r.weights for r in done.weights.collect()] == [r.weights for r in again.weights.collect()]
    z = som.normalise(df)
    assert z.count() == 60
    won = som.classify(z, done.weights)
    table = {(r.y, r.x): np.array(r.weights) for r in done.weights.collect()}
    for r in won.collect():
        d = {k: np.abs(w - np.array(r.vec)).sum() for k, w in table.items()}
        assert min(d, key=lambda k: (d[k], k)) == (r.win_y, r.win_x)
    e = som.errors(z, done.weights).first()
    assert 0 < e.error_min <= e.error_all <= e.error_max
    assert len(som.area_map(done.weights, frame(spark, [("a", 0), ("b", 5)], "area string, position int")).columns) == 10


def test_som_draws_from_all_vectors(spark):
    """More than 10,000 rows: the error is over all of them, and so are the row numbers."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12_000, 6)) + 4 * np.eye(6)[rng.integers(0, 3, 12_000)]
    df = frame(spark, [(k, v.tolist()) for k, v in enumerate(x)], "id int, vec array<double>")
    done = som.train(df, n=2, max_epochs=101, seed=2)
    z = (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True)
    w = np.array([r.weights for r in done.weights.orderBy("y", "x").collect()])
    win = w[np.abs(z[:, None] - w).sum(2).argmin(1)]
    assert [e for e, _ in done.history] == [0, 100]
    assert abs(done.history[-1][1] - np.sqrt(((z - win) ** 2).sum(1)).sum() / z.size) < 1e-9
    rows = som._numbered(som.normalise(df.union(df.where("id < 3"))).select("vec"), "vec").collect()
    assert sum(r._to - r._from for r in rows) == 12_003 and len(rows) == 12_000


def test_som_ends_at_the_target(spark):
    df = frame(spark, [(k, [float(k % 2), 1.0, 2.0]) for k in range(2)], "id int, vec array<double>")
    own = som.train(df, n=2, max_epochs=600, seed=1, check_every=10)
    far = som.train(df, n=2, max_epochs=600, seed=1, check_every=10, target=max(e for _, e in own.history))
    assert far.history == own.history[: len(far.history)] and len(far.history) < len(own.history)


def test_som_queries_train_the_full_schedule(spark, tiny, monkeypatch):
    from lodestrata.plans import numeric

    asked = []
    train = som.train
    monkeypatch.setattr(som, "train", lambda *a, **k: asked.append(train(*a, **k)) or asked[-1])
    numeric.som_train(spark, tiny)
    numeric.som_errors(spark, tiny)
    assert [own.history[-1][0] for own in asked] == [9900, 9900]


def test_postprocess(spark):
    p = frame(spark, [(1, 0, 1), (2, 1, 0), (3, 0, 1), (4, 2, 2)], "n int, a int, b int")
    assert sorted(r.n for r in postprocess.dedupe_pairs(p, ["a"], ["b"], ["n"]).collect()) == [1, 4]
    good, bad = postprocess.split_nan(frame(spark, [("1",), ("NaN",), (None,), ("x",)], "v string"), "v")
    assert (good.count(), bad.count()) == (1, 3)
    lines = frame(spark, [("Correlate,1,2",), ("",), ("x,1,2",), ("a,b",)], "value string")
    assert postprocess.right_shape(lines, 3, "Correlate").count() == 1 and postprocess.without_blank_lines(lines).count() == 3
    log = frame(spark, [("f", k, ms) for k, ms in enumerate((100, 200, 90_000, 500, 1500))], "f string, n int, ms long")
    s = postprocess.session_throughput(log, ["f"], "n", "ms").orderBy("session").collect()
    assert [(r.n_rows, r.rate) for r in s] == [(3, 3 * 1000 / 89_900), (2, 2.0)]
    rep = postprocess.match_report(frame(spark, [(1, 1, 0.0), (1, 2, 3.0), (2, 1, 50.0)], "i int, j int, value double"), frame(spark, [(1, "a"), (2, "b")], "map int, variable string"), frame(spark, [("a", "A"), ("b", "B")], "variable string, description string")).collect()
    assert [(r.i, r.j, r.description_i, r.description_j) for r in rep] == [(1, 2, "A", "B")]


def png(rows, filters):
    import struct
    import zlib

    h, w = len(rows), len(rows[0])
    raw = b""
    before = [0] * (3 * w)
    for row, kind in zip(rows, filters, strict=True):
        flat = [c for p in row for c in p]
        out = []
        for k, c in enumerate(flat):
            left, up = flat[k - 3] if k >= 3 else 0, before[k]
            corner = before[k - 3] if k >= 3 else 0
            p = left + up - corner
            paeth = min((left, up, corner), key=lambda x: abs(p - x))
            out.append((c - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        raw += bytes([kind, *out])
        before = flat
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rnd = random.Random(4)
    rows = [[tuple(rnd.randrange(256) for _ in range(3)) for _ in range(6)] for _ in range(5)]
    data = png(rows, [0, 1, 2, 3, 4])
    assert images.decode_png(data).tolist() == [[list(p) for p in r] for r in rows]
    (tmp_path / "image_3_7.png").write_bytes(data)
    (tmp_path / "other.txt").write_text("x")
    found = images.directory(spark, str(tmp_path))
    assert [(r.major, r.minor) for r in found.collect()] == [(3, 7)]
    pix = images.to_pixels(found)
    assert pix.count() == 30
    two = pix.select(F.lit(1).alias("image"), "px", "r", "g", "b").union(pix.where("px < 10").select(F.lit(2), "px", F.col("r") + 3, F.col("g") + 4, "b"))
    d = {(r.image_i, r.image_j): r.distance for r in images.rgb_distance(two).collect()}
    assert d == {(1, 1): 0, (2, 2): 0, (1, 2): 5, (2, 1): 5}
    m = images.mosaic(frame(spark, [("a", 0), ("b", 42)], "image string, ordinal int")).orderBy("image").collect()
    assert [(r.left, r.top) for r in m] == [(0, 0), (256, 256)]
