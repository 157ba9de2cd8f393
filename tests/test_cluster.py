import numpy as np
import pytest
from helpers import frame, names, values

from tabulon import KMeans
import tabulon.operators.cluster as cluster
from tabulon.functions.pcg import Pcg32
from tabulon.operators.cluster import squared_distances


def blobs():
    np.random.seed(42)
    return np.vstack([np.random.randn(30, 2) + c for c in ([0, 0], [10, 0], [5, 10])])


def serial(x, k, init, seed, tol=1e-4, max_iter=300):
    """The same draws and rounds on one array."""
    rng, n = Pcg32(seed), len(x)
    if init == "random":
        order = list(range(n))
        for i in range(k):
            j = i + rng.below(n - i)
            order[i], order[j] = order[j], order[i]
        c = x[order[:k]]
    else:
        c = x[[rng.below(n)]]
        while len(c) < k:
            near = squared_distances(x, c).min(axis=1)
            if near.sum() == 0:
                c = np.vstack([c, x[rng.below(n)]])
                continue
            ends = np.cumsum(near)
            at = [min(int(np.searchsorted(ends, rng.uniform() * near.sum())), n - 1) for _ in range(2 + int(np.log(k)))]
            pots = [np.minimum(near, ((x - x[i]) ** 2).sum(axis=1)).sum() for i in at]
            c = np.vstack([c, x[at[int(np.argmin(pots))]]])
    limit = tol * x.var(axis=0).mean()
    for it in range(1, max_iter + 1):
        label = squared_distances(x, c).argmin(axis=1)
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else np.zeros(x.shape[1]) for j in range(k)])
        shift, c = np.sqrt(((new - c) ** 2).sum()), new
        if shift <= limit:
            break
    return c, squared_distances(x, c).min(axis=1).sum(), it


def test_generator():
    r = Pcg32(0)
    assert [r.word64() for _ in range(2)] == [16483534761526846742, 6650325417118737376]
    r = Pcg32(42)
    assert [r.uniform() for _ in range(2)] == [0.25272509573055113, 0.1837321537063149]


@pytest.mark.parametrize("init", ["k-means++", "random"])
@pytest.mark.parametrize("seed,local", [(0, True), (42, True), (42, False)])
def test_same_as_serial(spark, monkeypatch, init, seed, local):
    if not local:
        monkeypatch.setattr(cluster, "LOCAL_CELLS", 0)
    x = blobs()
    m = KMeans(n_clusters=4, init=init, n_init=1, random_state=seed).fit(frame(spark, x), names(x), id_col="id")
    c, inertia, it = serial(x, 4, init, seed)
    np.testing.assert_allclose(m.cluster_centers_, c, rtol=1e-9)
    assert m.inertia_ == pytest.approx(inertia) and m.n_iter_ == it


def test_quality_and_outputs(spark):
    x = blobs()
    df = frame(spark, x)
    m = KMeans(n_clusters=3, random_state=42)
    label = values(m.fit_predict(df, names(x), id_col="id"), ["prediction"])[:, 0]
    for part in np.split(label, 3):
        assert (part == np.median(part)).sum() >= 25
    assert len(set(label)) == 3
    out = m.transform(df).orderBy("id").collect()
    want = np.sqrt(squared_distances(x, m.cluster_centers_))
    np.testing.assert_allclose([r["distances"] for r in out], want, rtol=1e-9)
    assert m.score(df) == pytest.approx(-m.inertia_)
    assert values(m.labels_, ["label"])[:, 0].tolist() == label.tolist()
    assert m.centers_df(spark).count() == 3 and m.n_features_in_ == 2


def test_wide_arrow_path(spark):
    x = np.random.default_rng(5).normal(size=(200, 12))
    df = frame(spark, x)
    m = KMeans(n_clusters=5, max_iter=3, random_state=1).fit(df, names(x), id_col="id")
    d = squared_distances(x, m.cluster_centers_)
    assert values(m.predict(df), ["prediction"])[:, 0].tolist() == d.argmin(axis=1).tolist()
    np.testing.assert_allclose([r["distances"] for r in m.transform(df).orderBy("id").collect()], np.sqrt(d))


def test_inertia_falls_and_runs(spark):
    x = np.random.RandomState(42).randn(100, 2)
    inertias = [KMeans(n_clusters=k, random_state=42).fit(frame(spark, x), names(x), id_col="id").inertia_ for k in (2, 5, 10)]
    assert inertias[0] > inertias[1] > inertias[2]
    assert KMeans().runs == 1 and KMeans(init="random").runs == 10 and KMeans(n_init=3).runs == 3


def test_equal_points_and_none_seed(spark):
    x = np.ones((6, 2))
    m = KMeans(n_clusters=2).fit(frame(spark, x), names(x), id_col="id")
    np.testing.assert_allclose(m.cluster_centers_, serial(x, 2, "k-means++", 0)[0])


def test_errors(spark):
    with pytest.raises(ValueError, match="init must be"):
        KMeans(init="x")
    with pytest.raises(ValueError, match="n_samples=2 should be >= n_clusters=5"):
        KMeans(n_clusters=5).fit(frame(spark, [[1, 2], [3, 4]]), ["x0", "x1"])
    with pytest.raises(ValueError, match="Not fitted yet"):
        KMeans().predict(frame(spark, [[1, 2]]))
    for kw in ({"n_clusters": 0}, {"n_init": 0}):
        with pytest.raises(ValueError):
            KMeans(**kw)
    assert KMeans(n_clusters=3).get_params()["n_clusters"] == 3


def test_restarts_share_their_passes(spark, monkeypatch):
    """Ten runs take as many passes as the longest of them, one after the other their sum; the best run is the same."""
    x = blobs()
    calls = []
    monkeypatch.setattr(cluster._SpreadPoints, "summed", lambda self, *a, f=cluster._SpreadPoints.summed: calls.append(1) or f(self, *a))
    m = KMeans(n_clusters=4, init="random", random_state=3, local_cells=0).fit(frame(spark, x), names(x), id_col="id")
    runs = [serial(x, 4, "random", 3 + i) for i in range(10)]
    c, inertia, it = min(runs, key=lambda r: r[1])
    np.testing.assert_allclose(m.cluster_centers_, c, rtol=1e-9)
    assert m.inertia_ == pytest.approx(inertia) and m.n_iter_ == it
    assert len(calls) == max(r[2] for r in runs) + 1


def test_nearest_centers_close_calls():
    """Far from the origin products round; equally near centres go to the lowest number."""
    rng = np.random.default_rng(1)
    for x in (rng.normal(size=(300, 6)) + 1e7, rng.integers(0, 3, size=(300, 6)).astype(float)):
        runs = np.stack([x[:5], x[[7, 7, 9, 11, 9]]])
        want = np.stack([squared_distances(x, c).argmin(axis=1) for c in runs], axis=1)
        assert (cluster.nearest_centers(x, runs) == want).all()


def test_rounds_run_in_many_tasks(spark):
    """Rows of a persisted frame stay in a task for each core at least, whatever their size; positions are dense over them."""
    x = np.random.default_rng(2).normal(size=(300, 3))
    rows = frame(spark, x).selectExpr("id AS _key", "array(x0, x1, x2) AS x")
    points = cluster._SpreadPoints(rows, 300, 3)
    tasks = points._frame.rdd.mapPartitions(lambda p: [len(list(p))]).collect()
    assert sum(n > 0 for n in tasks) >= spark.sparkContext.defaultParallelism
    np.testing.assert_array_equal(points.rows([299, 0, 150]), x[[299, 0, 150]])
    points.release()
