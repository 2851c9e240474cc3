import numpy as np
import pytest

from lodestrata.llm import pivots
from lodestrata.llm.queries import op1_pivots

from .test_simhash import roots


def brute(x, threshold=0.9):
    """Vectors by row, nan rows for those that link with nothing."""
    ok = np.isfinite(x).all(axis=1) & (np.abs(x) > 0).any(axis=1)
    u = np.where(ok[:, None], x, 1.0)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= threshold) & ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    return near


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 64))
    near = x[rng.integers(0, 60, 500)]
    noise = rng.normal(size=near.shape)
    noise -= (noise * near).sum(1, keepdims=True) / (near * near).sum(1, keepdims=True) * near
    noise *= np.linalg.norm(near, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.85, 1, (500, 1))
    x = np.concatenate((x, c * near + np.sqrt(1 - c * c) * noise, np.repeat(x[:1], 200, axis=0), x[5:9] * 1e-20)).astype(np.float32).astype(float)
    x[3] = 0
    x[4, 7] = np.inf
    x[10, 0] = np.nan
    return x


@pytest.mark.parametrize("tile", [512, 40])
def test_against_brute_force(spark, vectors, monkeypatch, tile):
    monkeypatch.setattr(pivots, "TILE", tile)
    near = brute(vectors)
    ids = [1000 + 3 * k for k in range(len(vectors))]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>").selectExpr("*", "1 as nid", "2 as n")
    got = {r.vec_id: r for r in pivots.near_duplicates(df).collect()}
    assert sorted(got) == ids
    links = np.array([got[i].n_links for i in ids])
    assert (links <= near.sum(1)).all()
    assert links.sum() >= 0.97 * near.sum()
    want = roots(len(ids), list(zip(*np.nonzero(near), strict=True)))
    agree = [got[i].component_id == ids[w] for i, w in zip(ids, want, strict=True)]
    assert np.mean(agree) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert [got[ids[k]].n_links for k in (3, 4, 10)] == [0, 0, 0]
    # With every pivot shared at least once the retrieval is complete.
    full = {r.vec_id: r for r in pivots.near_duplicates(df, pivots=64, prefix=64, probes=64, shared=1).collect()}
    assert [full[i].n_links for i in ids] == near.sum(1).tolist()
    assert [full[i].component_id for i in ids] == [ids[w] for w in want]


def test_edge_rows(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1e300, 0.0]), (6, [1e-300, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [-1.0, 0.0]), (5, [1e300, 0.0]), (None, [0.0, 1.0]), (9, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in pivots.near_duplicates(df).collect())
    assert got == [(-1, 0, -1, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True)]
    assert pivots.near_duplicates(df.where("false")).collect() == []


def test_query(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").orderBy("vec_id").collect()
    near = brute(np.array([r.embedding for r in rows]))
    got = {r.vec_id: r for r in op1_pivots(spark, tiny).collect()}
    assert [got[r.vec_id].n_links for r in rows] == near.sum(1).tolist()


def test_dense_group(spark):
    """A third of the rows are near copies of one another."""
    rng = np.random.default_rng(11)
    centre, x = np.eye(64)[0], rng.normal(size=(1500, 64))
    noise = rng.normal(size=(500, 64)) * (centre == 0)
    c = rng.uniform(0.93, 0.96, (500, 1))
    x[:500] = c * centre + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    near = brute(x)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in pivots.near_duplicates(df).collect()}
    links = np.array([got[k].n_links for k in range(len(x))])
    assert (links <= near.sum(1)).all()
    assert links.sum() >= 0.99 * near.sum()


def test_pivots_lie_apart():
    rng = np.random.default_rng(12)
    x = pivots.unit(np.concatenate((np.eye(64)[:1] + 0.02 * rng.normal(size=(300, 64)), rng.normal(size=(100, 64)))))
    own = pivots.spread(x, 64, 0.9)
    assert len(own) == 64 and (own @ own.T - np.eye(64)).max() < 0.9
    assert len(pivots.spread(x[:300], 64, 0.9)) == 1
