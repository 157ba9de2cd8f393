import numpy as np
import pytest
from helpers import frame, names, values
from pyspark.sql import functions as F

from tabulon import HuberRegressor, RidgeRegressor
from tabulon.linear_model import Huber, Ridge
from tabulon.plans.moments import exact_median


def data(noise=0.01, n=300):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(n, 8))
    y = x @ np.array([1.5, -2, 0, 3, -0.5, 2, 1, -1]) + 0.25 + noise * rng.normal(size=n)
    return x, y


def ridge(x, y, alpha, intercept=True, w=None):
    w = np.ones(len(x)) if w is None else w
    mx, my = (x.mean(axis=0), y.mean()) if intercept else (np.zeros(x.shape[1]), 0.0)
    xc, yc = x - mx, y - my
    coef = np.linalg.solve((xc * w[:, None]).T @ xc + alpha * np.eye(x.shape[1]), (xc * w[:, None]).T @ yc)
    return coef, my - mx @ coef


@pytest.mark.parametrize("alpha,intercept", [(1.0, True), (0.0, True), (2.5, False)])
def test_ridge(spark, alpha, intercept):
    x, y = data()
    r = RidgeRegressor(alpha=alpha, fit_intercept=intercept).fit(frame(spark, x, y), names(x), "y")
    coef, b = ridge(x, y, alpha, intercept)
    np.testing.assert_allclose(r.coef_, coef, rtol=1e-9)
    np.testing.assert_allclose(r.intercept_, b if intercept else 0.0, rtol=1e-7, atol=1e-12)
    got = values(r.predict(frame(spark, x, y)), ["prediction"])[:, 0]
    np.testing.assert_allclose(got, x @ coef + (b if intercept else 0), rtol=1e-8, atol=1e-9)
    want = 1 - ((y - got) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert abs(r.score(frame(spark, x, y), "y") - want) < 1e-10
    assert r.n_samples_fit_ == 300 and r.n_features_in_ == 8


def test_ridge_wide_and_alpha_zero(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 20))
    y = x @ np.arange(20.0)
    r = Ridge(alpha=0.0).fit(frame(spark, x, y), names(x), "y")
    np.testing.assert_allclose(r.coef_, np.arange(20.0), atol=1e-8)


@pytest.mark.parametrize("intercept", [True, False])
def test_ridge_wide_blocks(spark, intercept):
    """One pass over blocks of uneven partitions, against the closed form; nulls and no rows are refused."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 15)) + 50
    y = x @ np.arange(15.0) + 3 + rng.normal(size=300)
    df = frame(spark, x, y)
    uneven = df.filter("id < 2").coalesce(1).union(df.filter("id >= 2").repartition(4))
    r = Ridge(alpha=0.5, fit_intercept=intercept).fit(uneven, names(x), "y")
    c, t = (x - x.mean(axis=0), y - y.mean()) if intercept else (x, y)
    coef = np.linalg.solve(c.T @ c + 0.5 * np.eye(15), c.T @ t)
    np.testing.assert_allclose(r.coef_, coef, rtol=1e-8)
    np.testing.assert_allclose(r.intercept_, y.mean() - x.mean(axis=0) @ coef if intercept else 0.0, rtol=1e-8, atol=1e-9)
    assert r.n_samples_fit_ == 300
    with pytest.raises(ValueError, match="in 1 rows"):
        Ridge().fit(df.withColumn("y", F.expr("CASE WHEN id = 9 THEN NULL ELSE y END")), names(x), "y")
    with pytest.raises(ValueError, match="non-empty"):
        Ridge().fit(df.limit(0), names(x), "y")


def test_ridge_errors(spark):
    x, y = data()
    with pytest.raises(ValueError, match="alpha must be >= 0"):
        RidgeRegressor(alpha=-1)
    with pytest.raises(ValueError, match="solver"):
        RidgeRegressor(solver="qr")
    with pytest.raises(ValueError, match="Not fitted yet"):
        RidgeRegressor().predict(frame(spark, x))
    with pytest.raises(ValueError, match="non-empty"):
        RidgeRegressor().fit(frame(spark, x, y).limit(0), names(x), "y")
    with pytest.raises(ValueError, match="Solve failed"):
        RidgeRegressor(alpha=0.0).fit(frame(spark, np.ones((5, 2)), np.arange(5.0)), ["x0", "x1"], "y")
    with pytest.raises(ValueError, match="incompatible"):
        RidgeRegressor().fit(frame(spark, x, y), names(x), "y").predict(frame(spark, x[:, :3]))
    constant = frame(spark, [[1.0], [2]], [3.0, 3.0])
    assert RidgeRegressor().fit(constant, ["x0"], "y").score(constant, "y") == 1.0


def huber(x, y, epsilon=1.35, max_iter=100, alpha=1e-4, tol=1e-5):
    w, b = ridge(x, y, alpha)
    mx, my = x.mean(axis=0), y.mean()
    r = y - my - (x - mx) @ w
    s = np.median(np.abs(r)) / 0.6745
    for it in range(1, max_iter + 1):
        t = epsilon * s
        weight = np.where(np.abs(r) <= t, 1, t / np.maximum(np.abs(r), 1e-300))
        new, _ = ridge(x, y, alpha, w=weight)
        change, w = np.abs(new - w).max(), new
        r = y - my - (x - mx) @ w
        rho = np.where(np.abs(r) <= t, r * r / 2, t * np.abs(r) - t * t / 2)
        s = np.sqrt(2 * rho.sum() / (len(y) * max(2 * epsilon**2 - 1, 0.1)))
        if change < tol:
            break
    return w, my - mx @ w, s, it


@pytest.mark.parametrize("outliers", [0, 15])
def test_huber(spark, outliers):
    x, y = data(noise=0.1)
    rng = np.random.default_rng(1)
    at = rng.choice(len(y), outliers, replace=False)
    y[at] += rng.uniform(10, 20, outliers)
    h = HuberRegressor().fit(frame(spark, x, y), names(x), "y")
    coef, b, s, it = huber(x, y)
    np.testing.assert_allclose(h.coef_, coef, rtol=1e-7)
    np.testing.assert_allclose([h.intercept_, h.scale_], [b, s], rtol=1e-7)
    assert h.n_iter_ == it
    if not outliers:
        assert h.score(frame(spark, x, y), "y") > 0.9
        np.testing.assert_allclose(h.coef_, [1.5, -2, 0, 3, -0.5, 2, 1, -1], atol=0.05)


def test_huber_errors(spark):
    for kw, text in (
        ({"epsilon": 1.0}, "epsilon must be greater than 1.0"),
        ({"alpha": -1}, "alpha must be >= 0"),
        ({"max_iter": 0}, "max_iter must be > 0"),
        ({"tol": 0}, "tol must be > 0"),
    ):
        with pytest.raises(ValueError, match=text):
            Huber(**kw)
    with pytest.raises(ValueError, match="Not fitted yet"):
        Huber().predict(frame(spark, [[1.0]]))


@pytest.mark.parametrize("n", [1, 2, 999, 1000])
def test_median_by_ranges(spark, n):
    v = np.random.default_rng(n).normal(size=n) ** 3
    v[: n // 3] = 0.5
    df = frame(spark, v[:, None])
    assert exact_median(df, "x0", collected=20) == pytest.approx(np.median(v), rel=1e-12)
    assert exact_median(df, "x0") == pytest.approx(np.median(v), rel=1e-12)


def test_ridge_of_many_features(spark):
    """Beyond a dozen features products are made by NumPy over Arrow blocks."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 30)) @ rng.normal(size=(30, 30)) + 5
    y = x @ rng.normal(size=30) + 2 + rng.normal(size=400)
    m = RidgeRegressor(alpha=3.0).fit(frame(spark, x, y), names(x), "y")
    a, b = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(a.T @ a + 3 * np.eye(30), a.T @ b)
    np.testing.assert_allclose(m.coef_, want, rtol=1e-6, atol=1e-8)
    assert abs(m.intercept_ - (y.mean() - x.mean(axis=0) @ want)) < 1e-6
