import numpy as np
import pytest
from helpers import frame, names, values
from pyspark.sql import functions as F

from tabulon import MinMaxScaler, StandardScaler

SMALL = [[0, 0], [0, 0], [1, 1], [1, 1]]
CONSTANT = [[1, 0], [1, 1], [1, 2]]


def scaled(df, x, suffix="_scaled"):
    return values(df, [n + suffix for n in names(x)])


def test_standard_small(spark):
    s = StandardScaler()
    out = scaled(s.fit_transform(frame(spark, SMALL), ["x0", "x1"]), SMALL)
    assert s.mean_.tolist() == [0.5, 0.5] and s.scale_.tolist() == [0.5, 0.5]
    assert out.tolist() == [[-1, -1], [-1, -1], [1, 1], [1, 1]]
    assert s.n_samples_seen_ == 4 and s.n_features_in_ == 2


@pytest.mark.parametrize("shape", [(1000, 20), (400, 40)])
def test_standard_random(spark, shape):
    np.random.seed(42)
    x = np.random.randn(*shape) * 10 + 5
    s = StandardScaler().fit(frame(spark, x), names(x))
    np.testing.assert_allclose(s.mean_, x.mean(axis=0), rtol=1e-10)
    np.testing.assert_allclose(s.var_, x.var(axis=0), rtol=1e-10)
    df = s.transform(frame(spark, x))
    np.testing.assert_allclose(scaled(df, x), (x - x.mean(axis=0)) / x.std(axis=0), atol=1e-10)
    back = s.inverse_transform(df, [n + "_scaled" for n in names(x)], suffix="_back")
    np.testing.assert_allclose(values(back, [n + "_scaled_back" for n in names(x)]), x, atol=1e-9)


def test_standard_wide_blocks(spark):
    """Far from zero, over partitions of uneven size with an empty one; a constant column; nulls and NaN are refused, no rows too."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 30)) + 1e7
    x[:, 4] = 0.1
    df = frame(spark, x)
    uneven = df.filter("id < 3").coalesce(1).union(df.filter("id < 0")).union(df.filter("id >= 3").repartition(5))
    s = StandardScaler().fit(uneven, names(x))
    np.testing.assert_allclose(s.mean_, x.mean(axis=0), rtol=1e-13)
    np.testing.assert_allclose(np.delete(s.var_, 4), np.delete(x.var(axis=0), 4), rtol=1e-7)
    assert s.scale_[4] == 1.0 and s.n_samples_seen_ == 500
    m = MinMaxScaler().fit(uneven, names(x))
    assert (m.data_min_ == x.min(axis=0)).all() and (m.data_max_ == x.max(axis=0)).all()
    for broken in ("NULL", "double('NaN')"):
        with pytest.raises(ValueError, match="in 2 rows"):
            StandardScaler().fit(uneven.withColumn("x7", F.expr(f"CASE WHEN id IN (4, 444) THEN {broken} ELSE x7 END")), names(x))
        with pytest.raises(ValueError, match="in 2 rows"):
            MinMaxScaler().fit(uneven.withColumn("x7", F.expr(f"CASE WHEN id IN (4, 444) THEN {broken} ELSE x7 END")), names(x))
    for scaler in (StandardScaler(), MinMaxScaler()):
        with pytest.raises(ValueError, match="non-empty"):
            scaler.fit(df.limit(0), names(x))


def test_standard_constant_and_options(spark):
    s = StandardScaler().fit(frame(spark, CONSTANT), ["x0", "x1"])
    assert s.scale_[0] == 1.0
    assert scaled(s.transform(frame(spark, CONSTANT)), CONSTANT)[:, 0].tolist() == [0, 0, 0]
    x = np.array([[1.0, 2], [3, 4], [5, 6]])
    no_mean = StandardScaler(with_mean=False).fit_transform(frame(spark, x), names(x))
    np.testing.assert_allclose(scaled(no_mean, x), x / x.std(axis=0))
    no_std = StandardScaler(with_std=False).fit_transform(frame(spark, x), names(x))
    np.testing.assert_allclose(scaled(no_std, x), x - x.mean(axis=0))


def test_standard_partial_fit(spark):
    np.random.seed(42)
    x = np.random.randn(300, 20)
    s = StandardScaler()
    for part in np.split(x, 3):
        s.partial_fit(frame(spark, part), names(x))
    np.testing.assert_allclose(s.mean_, x.mean(axis=0), atol=1e-12)
    np.testing.assert_allclose(s.var_, x.var(axis=0), atol=1e-12)
    assert s.n_samples_seen_ == 300
    s.fit(frame(spark, x[:100]), names(x)).partial_fit(frame(spark, x[100:]))
    np.testing.assert_allclose(s.var_, x.var(axis=0), atol=1e-12)


def test_array_features(spark):
    x = np.array([[1.0, 2], [3, 4], [5, 9]])
    df = frame(spark, x).select("id", F.array("x0", "x1").alias("v"))
    out = StandardScaler().fit_transform(df, "v").orderBy("id").collect()
    np.testing.assert_allclose([r["v_scaled"] for r in out], (x - x.mean(axis=0)) / x.std(axis=0))


def test_minmax(spark):
    x = np.array([[0.0, 0], [1, 1], [2, 2]])
    m = MinMaxScaler()
    assert scaled(m.fit_transform(frame(spark, x), names(x)), x).tolist() == [[0, 0], [0.5, 0.5], [1, 1]]
    assert m.data_min_.tolist() == [0, 0] and m.data_max_.tolist() == [2, 2] and m.data_range_.tolist() == [2, 2]
    wide = MinMaxScaler((-1, 1)).fit_transform(frame(spark, x), names(x))
    assert scaled(wide, x).tolist() == [[-1, -1], [0, 0], [1, 1]]
    clip = MinMaxScaler(clip=True).fit(frame(spark, x), names(x)).transform(frame(spark, [[-1, -1], [3, 3]]))
    assert scaled(clip, x).tolist() == [[0, 0], [1, 1]]


def test_minmax_constant_inverse_partial(spark):
    m = MinMaxScaler((2, 3)).fit(frame(spark, CONSTANT), ["x0", "x1"])
    assert m.scale_.tolist() == [0, 0.5]
    df = m.transform(frame(spark, CONSTANT))
    assert scaled(df, CONSTANT)[:, 0].tolist() == [2, 2, 2]
    back = m.inverse_transform(df, ["x0_scaled", "x1_scaled"], suffix="_b")
    np.testing.assert_allclose(values(back, ["x0_scaled_b", "x1_scaled_b"]), CONSTANT)
    p = MinMaxScaler().partial_fit(frame(spark, [[0, 0], [1, 1]]), ["x0", "x1"]).partial_fit(frame(spark, [[2, 2], [3, 3]]))
    assert p.data_max_.tolist() == [3, 3] and p.n_samples_seen_ == 4


def test_errors_and_params(spark):
    df = frame(spark, SMALL)
    for s in (StandardScaler(), MinMaxScaler()):
        assert s.n_features_in_ is None and s.n_samples_seen_ == 0
        with pytest.raises(ValueError, match="Not fitted yet"):
            s.transform(df)
        with pytest.raises(ValueError, match="non-empty"):
            s.fit(df.limit(0), ["x0"])
        with pytest.raises(ValueError, match="null or NaN"):
            s.fit(df.withColumn("x0", F.lit(float("nan"))), ["x0"])
        with pytest.raises(ValueError, match="incompatible"):
            s.fit(df, ["x0"]).transform(df, ["x0", "x1"])
    assert StandardScaler(with_mean=False).get_params() == {"with_mean": False, "with_std": True, "n_jobs": 1}
    assert MinMaxScaler((0, 2), clip=True).get_params(deep=False)["clip"] is True
    with pytest.raises(ValueError):
        MinMaxScaler((1, 1))


def test_stats_frames(spark):
    rows = StandardScaler().fit(frame(spark, SMALL), ["x0", "x1"]).stats_df(spark).collect()
    assert [(r["feature"], r["mean"], r["scale"]) for r in rows] == [("x0", 0.5, 0.5), ("x1", 0.5, 0.5)]
    assert MinMaxScaler().fit(frame(spark, SMALL), ["x0"]).stats_df(spark).first()["data_max"] == 1.0
