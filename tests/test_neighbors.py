import numpy as np
import pyarrow as pa
import pytest
from helpers import frame, names, values

import tabulon.plans.cells as cells
import tabulon.plans.neighbors as plan
from tabulon import KNeighborsClassifier, KNeighborsRegressor
from tabulon.functions.distance import Metric


def brute(q, x, k, p=2.0):
    d = (np.abs(q[:, None] - x[None]) ** p).sum(-1) ** (1 / p)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)


@pytest.fixture(params=["broadcast", "blocks"])
def strategy(request, monkeypatch):
    if request.param == "blocks":
        monkeypatch.setattr(plan, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(plan, "BLOCK_ROWS", 60)
    return request.param


@pytest.mark.parametrize("algorithm", ["kd_tree", "ball_tree"])
@pytest.mark.parametrize("metric,p,leaf", [("euclidean", 2, 30), ("manhattan", 1, 5), ("minkowski", 3, 1), ("minkowski", 0.5, 9)])
def test_trees(spark, monkeypatch, algorithm, metric, p, leaf):
    """The same rows as all pairs, ties and copies among them, whatever the leaves; and most leaves are ruled out."""
    monkeypatch.setattr(cells, "BLOCK_ROWS", 70)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(150, 3)) * 0.1 + c for c in rng.normal(size=(4, 3)) * 10] + [np.zeros((60, 3))])
    q = np.vstack([x[::9], rng.normal(size=(20, 3)) * 10, np.zeros((1, 3))])
    m = KNeighborsRegressor(n_neighbors=7, metric=metric, p=p, algorithm=algorithm, leaf_size=leaf).fit(frame(spark, x, x[:, 0]), names(x), "y")
    rows = m.kneighbors_wide(frame(spark, q)).orderBy("query_id").collect()
    ids, d = brute(q, x, 7, p)
    assert [r["neighbor_ids"] for r in rows] == ids.tolist()
    np.testing.assert_allclose([r["distances"] for r in rows], d, rtol=1e-12)
    assert m.kneighbors(frame(spark, q[:2]), n_neighbors=10_000).count() == 2 * len(x)


def test_trees_rule_leaves_out():
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(20_000, 2))
    splits = cells.Splits.of(x, 256)
    at = splits.leaves_of(x)
    assert splits.leaves == 256 and np.bincount(at).max() < 2 * 20_000 / 256
    for ball in (False, True):
        low = np.array([x[at == i].min(axis=0) for i in range(256)])
        high = np.array([x[at == i].max(axis=0) for i in range(256)])
        center = np.array([x[at == i].mean(axis=0) for i in range(256)])
        radius = np.array([np.sqrt(((x[at == i] - center[i]) ** 2).sum(axis=1)).max() for i in range(256)])
        bounds = cells.Bounds(np.bincount(at), low, high, center, radius, Metric.of("euclidean"), ball)
        assert bounds.needed(x[:500], 5).sum(axis=1).mean() < 40


def test_splits_of_few_values():
    for x in (np.zeros((100, 2)), np.array([[0.0, 1]] * 99 + [[1.0, 1]]), np.zeros((0, 2)), np.array([[1.0, 2]])):
        splits = cells.Splits.of(x, 16)
        assert len(np.unique(splits.leaves_of(x))) <= splits.leaves <= 16


@pytest.mark.parametrize("metric,p", [("euclidean", 2), ("manhattan", 1), ("minkowski", 3), ("minkowski", 2)])
def test_kneighbors(spark, strategy, metric, p):
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(150, 5)), rng.normal(size=(40, 5))
    m = KNeighborsRegressor(n_neighbors=7, metric=metric, p=p).fit(frame(spark, x, x[:, 0]), names(x), "y")
    rows = m.kneighbors_wide(frame(spark, q)).orderBy("query_id").collect()
    ids, d = brute(q, x, 7, p)
    assert [r["neighbor_ids"] for r in rows] == ids.tolist()
    np.testing.assert_allclose([r["distances"] for r in rows], d, rtol=1e-12)


def test_ties_self_and_clamp(spark, strategy):
    x = np.array([[0.0], [1], [1], [1], [5]])
    m = KNeighborsClassifier(n_neighbors=2).fit(frame(spark, x, [0, 1, 1, 0, 0]), ["x0"], "y")
    rows = m.kneighbors_wide(frame(spark, x)).orderBy("query_id").collect()
    assert rows[3]["neighbor_ids"] == [1, 2] and rows[3]["distances"] == [0, 0]
    assert rows[0]["neighbor_ids"] == [0, 1]
    assert m.kneighbors(frame(spark, x), n_neighbors=10).count() == 25
    assert "distance" not in m.kneighbors(frame(spark, x), return_distance=False).columns


def test_classifier(spark):
    c = KNeighborsClassifier(n_neighbors=1).fit(frame(spark, [[0, 0], [1, 1], [2, 2], [3, 3]], [0, 1, 0, 1]), ["x0", "x1"], "y")
    df = frame(spark, [[0, 0], [1, 1], [2, 2], [3, 3]], [0, 1, 0, 1])
    assert values(c.predict(df), ["prediction"])[:, 0].tolist() == [0, 1, 0, 1]
    assert c.score(df, "y") == 1.0 and c.classes_ == [0, 1] and c.n_samples_fit_ == 4 and c.n_neighbors_ == 1
    far = KNeighborsClassifier(n_neighbors=3, weights="distance").fit(frame(spark, [[0, 0], [0.1, 0], [1, 0]], [0, 0, 1]), ["x0", "x1"], "y")
    assert values(far.predict(frame(spark, [[0.05, 0]])), ["prediction"])[0, 0] == 0
    two = KNeighborsClassifier(n_neighbors=2, weights="distance").fit(frame(spark, [[0, 0], [1, 0]], [0, 1]), ["x0", "x1"], "y")
    assert two.predict_proba(frame(spark, [[0, 0]])).first()["probabilities"] == [1.0, 0.0]
    thirds = KNeighborsClassifier(n_neighbors=3).fit(frame(spark, [[0, 0], [1, 0], [0, 1]], [0, 0, 1]), ["x0", "x1"], "y")
    np.testing.assert_allclose(thirds.predict_proba(frame(spark, [[0.5, 0.5]])).first()["probabilities"], [2 / 3, 1 / 3])
    tie = KNeighborsClassifier(n_neighbors=2).fit(frame(spark, [[0.0], [2]], [7, 3]), ["x0"], "y")
    assert tie.predict(frame(spark, [[1.0]])).first()["prediction"] == 3


def test_regressor(spark):
    corners = frame(spark, [[0, 0], [1, 0], [0, 1]], [0.0, 3, 6])
    m = KNeighborsRegressor(n_neighbors=3).fit(corners, ["x0", "x1"], "y")
    assert m.predict(frame(spark, [[0.3, 0.3]])).first()["prediction"] == 3.0
    w = KNeighborsRegressor(n_neighbors=2, weights="distance").fit(frame(spark, [[0, 0], [3, 0]], [0.0, 12]), ["x0", "x1"], "y")
    assert w.predict(frame(spark, [[1, 0]])).first()["prediction"] == pytest.approx(4.0)
    e = KNeighborsRegressor(n_neighbors=2, weights="distance").fit(frame(spark, [[0, 0], [0, 0]], [5.0, 10]), ["x0", "x1"], "y")
    assert e.predict(frame(spark, [[0, 0]])).first()["prediction"] == 5.0  # the first of several exact matches
    one = KNeighborsRegressor(n_neighbors=1).fit(corners, ["x0", "x1"], "y")
    assert one.score(corners, "y") == 1.0


@pytest.mark.parametrize("algorithm", ["auto", "brute", "kd_tree", "ball_tree"])
def test_algorithms_agree(spark, algorithm):
    """Many equal values, where a tree that splits by position could lose an exact match."""
    x = np.concatenate([np.zeros(30), np.arange(1, 21)])[:, None]
    m = KNeighborsRegressor(n_neighbors=1, algorithm=algorithm).fit(frame(spark, x, x[:, 0]), ["x0"], "y")
    assert [r["distance"] for r in m.kneighbors(frame(spark, [[0.0], [20]])).collect()] == [0, 0]


def test_errors_and_params(spark):
    for kw in ({"metric": "cosine"}, {"weights": "w"}, {"algorithm": "x"}, {"n_neighbors": 0}):
        with pytest.raises(ValueError):
            KNeighborsClassifier(**kw)
    for kind in (KNeighborsClassifier, KNeighborsRegressor):
        with pytest.raises(ValueError, match="Not fitted yet"):
            kind().predict(frame(spark, [[1.0]]))
        assert kind(n_neighbors=3, leaf_size=10).get_params() == {
            "n_neighbors": 3, "weights": "uniform", "algorithm": "auto", "leaf_size": 10, "metric": "euclidean", "p": 2.0, "n_jobs": 1
        }
    m = KNeighborsRegressor().fit(frame(spark, [[1.0, 2]], [1.0]), ["x0", "x1"], "y")
    with pytest.raises(ValueError, match="incompatible"):
        m.predict(frame(spark, [[1.0]]))


def test_equal_rows_stay_few():
    """A task's search keeps k of equal rows: a query at a value of thousands of rows finds k, ties and all."""
    from tabulon.plans.search import Held

    ids, x = pa.array(np.arange(20_000)[::-1]), np.repeat(np.arange(20.0), 1000)[:, None]
    held = Held(ids, x, 5, Metric.of("euclidean"))
    assert len(held.ids) == 100
    row, col, power = held.best(np.array([[3.0], [3.5]]))
    at = np.arange(20_000)[::-1]
    want = [sorted(at[x[:, 0] == 3])[:5], sorted(at[(x[:, 0] == 3) | (x[:, 0] == 4)])[:5]]
    assert [held.ids.take(pa.array(col[row == i])).to_pylist() for i in (0, 1)] == want


@pytest.mark.parametrize("algorithm", ["auto", "brute", "kd_tree", "ball_tree"])
def test_copies_leave_before_the_search(spark, monkeypatch, algorithm):
    """Rows of few values: every task holds k of each value, and no row of the training table is shuffled to a search."""
    monkeypatch.setattr(plan, "BROADCAST_ROWS", 100)
    x = np.random.default_rng(4).integers(0, 9, size=(600, 1)).astype(float)
    q = np.random.default_rng(5).uniform(-1, 10, size=(50, 1))
    m = KNeighborsRegressor(n_neighbors=4, algorithm=algorithm).fit(frame(spark, x, x[:, 0]), ["x0"], "y")
    monkeypatch.setattr(plan, "nearest_in_cells", None)
    monkeypatch.setattr(plan, "_by_blocks", None)
    rows = m.kneighbors_wide(frame(spark, q)).orderBy("query_id").collect()
    assert [r["neighbor_ids"] for r in rows] == brute(q, x, 4)[0].tolist()


@pytest.mark.parametrize("p", [1.0, 2.0, 3.0, 1.5, 0.5])
def test_filtered_search_equals_direct_differences(p):
    """Far from the origin, tiny, huge and tied values: what products or single precision can't tell apart is measured."""
    from tabulon.plans.search import Held

    rng, metric = np.random.default_rng(6), Metric.of("minkowski", p)
    x = rng.normal(size=(700, 20))
    for points in (x, np.round(x), x + 1e6, x * 1e-30, x * 1e60):
        ids = rng.permutation(len(points))
        held = Held(pa.array(ids), points, 5, metric)
        row, col, power = held.best(points[:25])
        d = metric.powers(points[:25], points)
        order = np.array([np.lexsort((ids, w))[:5] for w in d])
        assert held.ids.to_numpy()[col].reshape(25, 5).tolist() == ids[order].tolist()
        assert (power.reshape(25, 5) == np.take_along_axis(d, order, 1)).all()


@pytest.mark.parametrize("ball", [False, True])
def test_routes_hold_all_neighbours(ball):
    """Every block with one of a query's nearest rows is on its route, and most others aren't; few leaves are looked at."""
    from tabulon.plans.tree import Bounds, Route, Splits

    rng, metric = np.random.default_rng(7), Metric.of("euclidean")
    x = rng.uniform(size=(20_000, 2))
    splits = Splits.of(x, 1024)
    at = splits.leaves_of(x)
    bounds = Bounds.around(x, at, splits.leaves, metric)
    center = (bounds.low + bounds.high) / 2
    radius = np.zeros(splits.leaves)
    np.maximum.at(radius, at, np.sqrt(((x - center[at]) ** 2).sum(axis=1)))
    bounds = Bounds(bounds.count, bounds.low, bounds.high, center, radius * (1 + 1e-9), metric, ball)
    block = np.arange(splits.leaves) // 4
    for k in (5, 60):  # more than a leaf holds
        row, own = Route(splits, bounds, block, k).blocks(x[:200])
        found = set(zip(row.tolist(), own.tolist()))
        near = np.argsort(metric.powers(x[:200], x), axis=1)[:, :k]
        assert {(i, b) for i in range(200) for b in block[at[near[i]]].tolist()} <= found
        assert len(found) == len(row) < 200 * 40


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    """Many queries are dealt to chunks as training rows are to blocks."""
    from tabulon.plans.features import Features

    monkeypatch.setattr(plan, "BLOCK_ROWS", 20)
    x, q = np.random.default_rng(8).normal(size=(2, 100, 18))
    sides = [frame(spark, q), Features.of(frame(spark, q), names(q)), "id", frame(spark, x), Features.of(frame(spark, x), names(x)), "id"]
    assert plan._by_blocks(*sides, 100, 3, Metric.of("euclidean")).rdd.getNumPartitions() == 25
    m = KNeighborsRegressor(n_neighbors=3).fit(frame(spark, x, x[:, 0]), names(x), "y")
    rows = m.kneighbors_wide(frame(spark, q)).orderBy("query_id").collect()
    assert [r["neighbor_ids"] for r in rows] == brute(q, x, 3)[0].tolist()


@pytest.mark.parametrize("ball", [False, True])
def test_routes_of_wide_rows_take_little_memory(ball):
    """Where no leaf is ruled out, pairs of a query and a leaf are bounded, and no features are copied for each."""
    import tracemalloc

    from tabulon.plans.tree import Bounds, Route, Splits

    rng, metric = np.random.default_rng(9), Metric.of("euclidean")
    x = rng.normal(size=(8192, 64))
    splits = Splits.of(x, 256)
    at = splits.leaves_of(x)
    box = Bounds.around(x, at, splits.leaves, metric)
    bounds = Bounds(box.count, box.low, box.high, np.zeros((256, 64)), np.full(256, 99.0), metric, ball)
    route = Route(splits, bounds, np.arange(256) // 4, 5)
    tracemalloc.start()
    row, block = route.blocks(x[: route.step])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(row) == min(route.step, len(x)) * 64 and most < 64e6
