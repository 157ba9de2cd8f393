"""Registered queries of the estimators, with DuckDB SQL that gives the same rows.

Fits that run until they converge have no SQL: tests hold them against plain NumPy.

Per-row results come in long form, rounded where floating-point sums may differ in their last digits.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import HuberRegressor, KMeans, KNeighborsClassifier, KNeighborsRegressor, MinMaxScaler, RidgeRegressor, StandardScaler
from tabulon.plans.features import Features
from tabulon.sources import read_table
from tabulon.streaming import fit_stream, running_moments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL it equals, if there is any."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in rows], schema)


# --- scalers ---------------------------------------------------------------------------------------------------------

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(columns: list[str], select: str) -> str:
    return " UNION ALL ".join(select.format(c=c) for c in columns)


@query(
    "std_fit",
    f"SELECT feature, round(mean, 5) + 0 AS mean, round(var, 3) + 0 AS var, round(scale, 5) + 0 AS scale, n FROM ("
    + _union(LINE, "SELECT '{c}' AS feature, avg({c}) AS mean, var_pop({c}) AS var, CASE WHEN var_pop({c}) = 0 THEN 1.0 ELSE sqrt(var_pop({c})) END AS scale, count(*) AS n FROM lineitem")
    + ")",
)
def std_fit(spark, sf):
    s = StandardScaler().fit(read_table(spark, sf, "lineitem"), LINE)
    out = s.stats_df(spark).withColumn("n", F.lit(s.n_samples_seen_).cast("long"))
    return rounded(rounded(out, 5, "mean", "scale"), 3, "var")


_WIDE = "(SELECT generate_subscripts(embedding, 1) - 1 AS j, unnest(embedding)::DOUBLE AS u FROM embeddings)"


@query("std_fit_wide", f"SELECT 'embedding[' || j || ']' AS feature, round(avg(u), 6) + 0 AS mean, round(stddev_pop(u), 6) + 0 AS scale FROM {_WIDE} GROUP BY j")
def std_fit_wide(spark, sf):
    """Many features: sums by NumPy over Arrow blocks."""
    s = StandardScaler().fit(read_table(spark, sf, "embeddings"), "embedding")
    return rounded(s.stats_df(spark).select("feature", "mean", "scale"), 6, "mean", "scale")


@query("mm_fit_wide", f"SELECT 'embedding[' || j || ']' AS feature, min(u) AS data_min, max(u) AS data_max FROM {_WIDE} GROUP BY j")
def mm_fit_wide(spark, sf):
    m = MinMaxScaler().fit(read_table(spark, sf, "embeddings"), "embedding")
    rows = [(f"embedding[{j}]", a, b) for j, (a, b) in enumerate(zip(m.data_min_, m.data_max_))]
    return _rows(spark, rows, "feature string, data_min double, data_max double")


PART = ["p_size", "p_retailprice"]
_PART_STATS = "(SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM part)"


def _part(spark, sf, scaler) -> DataFrame:
    out = scaler.fit_transform(read_table(spark, sf, "part"), PART)
    return rounded(out.select("p_partkey", "p_size_scaled", "p_retailprice_scaled"), 6, "p_size_scaled", "p_retailprice_scaled")


@query("std_transform", f"SELECT p_partkey, round((p_size - m1) / s1, 6) + 0 AS p_size_scaled, round((p_retailprice - m2) / s2, 6) + 0 AS p_retailprice_scaled FROM part, {_PART_STATS}")
def std_transform(spark, sf):
    return _part(spark, sf, StandardScaler())


@query("std_no_mean", f"SELECT p_partkey, round(p_size / s1, 6) + 0 AS p_size_scaled, round(p_retailprice / s2, 6) + 0 AS p_retailprice_scaled FROM part, {_PART_STATS}")
def std_no_mean(spark, sf):
    return _part(spark, sf, StandardScaler(with_mean=False))


@query("std_no_std", f"SELECT p_partkey, round(p_size - m1, 6) + 0 AS p_size_scaled, round(p_retailprice - m2, 6) + 0 AS p_retailprice_scaled FROM part, {_PART_STATS}")
def std_no_std(spark, sf):
    return _part(spark, sf, StandardScaler(with_std=False))


@query("std_inverse", "SELECT p_partkey, round(p_size::DOUBLE, 6) AS p_size_original, round(p_retailprice, 6) AS p_retailprice_original FROM part")
def std_inverse(spark, sf):
    s = StandardScaler()
    scaled = s.fit_transform(read_table(spark, sf, "part"), PART).select("p_partkey", *(F.col(c + "_scaled").alias(c) for c in PART))
    out = s.inverse_transform(scaled).select("p_partkey", "p_size_original", "p_retailprice_original")
    return rounded(out, 6, "p_size_original", "p_retailprice_original")


@query("std_const_column", f"SELECT p_partkey, 0.0::DOUBLE AS seven_scaled, round((p_size - m1) / s1, 6) + 0 AS p_size_scaled FROM part, {_PART_STATS}")
def std_const_column(spark, sf):
    part = read_table(spark, sf, "part").withColumn("seven", F.lit(7.0))
    out = StandardScaler().fit_transform(part, ["seven", "p_size"]).select("p_partkey", "seven_scaled", "p_size_scaled")
    return rounded(out, 6, "seven_scaled", "p_size_scaled")


_EVENTS = "SELECT round(avg(value), 6) + 0 AS mean, round(var_pop(value), 4) + 0 AS var, count(*) AS n FROM events"


def _event_stats(spark, s: StandardScaler) -> DataFrame:
    return rounded(rounded(_rows(spark, [(s.mean_[0], s.var_[0], s.n_samples_seen_)], "mean double, var double, n long"), 6, "mean"), 4, "var")


@query("std_partial_fit_days", _EVENTS)
def std_partial_fit_days(spark, sf):
    """One batch for each ten days, merged on the driver."""
    events = read_table(spark, sf, "events").withColumn("batch", F.floor(F.dayofmonth("ts") / 10))
    s = StandardScaler()
    for r in events.select("batch").distinct().orderBy("batch").collect():
        s.partial_fit(events.filter(F.col("batch") == r["batch"]), ["value"])
    return _event_stats(spark, s)


def _event_stream(spark, sf) -> DataFrame:
    table = f"{sf}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(table).schema).option("pathGlobFilter", "*.parquet").load(table if _is_folder(spark, table) else sf + "/event[s].parquet")


def _is_folder(spark, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


@query("std_streaming", _EVENTS)
def std_streaming(spark, sf):
    """The same statistics from a stream, micro-batch by micro-batch."""
    s = StandardScaler()
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp()
    stream = _event_stream(spark, sf).select("value")
    fit_stream(s, stream, ["value"], tempfile.mktemp(prefix="stream-", dir=folder), availableNow=True).awaitTermination()
    return _event_stats(spark, s)


@query("stream_running_moments", "SELECT 'value' AS feature, count(value) AS n, round(avg(value), 6) + 0 AS mean, round(var_pop(value), 4) + 0 AS var, min(value) AS low, max(value) AS high FROM events")
def stream_running_moments(spark, sf):
    """A running aggregate in complete mode, as it stands at the end of the stream."""
    name = "running_" + next(tempfile._get_candidate_names())
    stream = running_moments(_event_stream(spark, sf), ["value"])
    stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return rounded(rounded(spark.table(name), 6, "mean"), 4, "var")


@query(
    "mm_fit",
    "SELECT feature, data_min, data_max, round(scale, 8) + 0 AS scale, round(\"min\", 6) + 0 AS \"min\" FROM ("
    + _union(LINE, "SELECT '{c}' AS feature, min({c}) AS data_min, max({c}) AS data_max, 1 / (max({c}) - min({c})) AS scale, -min({c}) / (max({c}) - min({c})) AS \"min\" FROM lineitem")
    + ")",
)
def mm_fit(spark, sf):
    out = MinMaxScaler().fit(read_table(spark, sf, "lineitem"), LINE).stats_df(spark)
    return rounded(rounded(out, 8, "scale"), 6, "min")


_PART_RANGE = "(SELECT min(p_size) AS a1, max(p_size) AS b1, min(p_retailprice) AS a2, max(p_retailprice) AS b2 FROM part)"


@query("mm_transform", f"SELECT p_partkey, round((p_size - a1) / (b1 - a1), 6) + 0 AS p_size_scaled, round((p_retailprice - a2) / (b2 - a2), 6) + 0 AS p_retailprice_scaled FROM part, {_PART_RANGE}")
def mm_transform(spark, sf):
    return _part(spark, sf, MinMaxScaler())


@query("mm_range", f"SELECT p_partkey, round((p_size - a1) / (b1 - a1) * 2 - 1, 6) + 0 AS p_size_scaled, round((p_retailprice - a2) / (b2 - a2) * 2 - 1, 6) + 0 AS p_retailprice_scaled FROM part, {_PART_RANGE}")
def mm_range(spark, sf):
    return _part(spark, sf, MinMaxScaler((-1, 1)))


@query(
    "mm_clip",
    "SELECT c_custkey, round(greatest(-1, least(1, (c_acctbal - a) / (b - a) * 2 - 1)), 6) + 0 AS c_acctbal_scaled FROM customer, "
    "(SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer WHERE c_acctbal BETWEEN 0 AND 5000)",
)
def mm_clip(spark, sf):
    customer = read_table(spark, sf, "customer")
    m = MinMaxScaler((-1, 1), clip=True).fit(customer.filter(F.col("c_acctbal").between(0, 5000)), ["c_acctbal"])
    return rounded(m.transform(customer).select("c_custkey", "c_acctbal_scaled"), 6, "c_acctbal_scaled")


@query("mm_inverse", "SELECT p_partkey, round(p_size::DOUBLE, 6) AS p_size_original, round(p_retailprice, 6) AS p_retailprice_original, 7.0::DOUBLE AS seven_original FROM part")
def mm_inverse(spark, sf):
    columns = [*PART, "seven"]
    m = MinMaxScaler((2, 5))
    scaled = m.fit_transform(read_table(spark, sf, "part").withColumn("seven", F.lit(7.0)), columns)
    out = m.inverse_transform(scaled.select("p_partkey", *(F.col(c + "_scaled").alias(c) for c in columns)))
    return rounded(out.select("p_partkey", *(c + "_original" for c in columns)), 6, *(c + "_original" for c in columns))


@query("mm_partial_fit", "SELECT min(value) AS low, max(value) AS high, count(*) AS n FROM events")
def mm_partial_fit(spark, sf):
    events, m = read_table(spark, sf, "events"), MinMaxScaler()
    for kind in [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]:
        m.partial_fit(events.filter(F.col("event_type") == kind), ["value"])
    return _rows(spark, [(m.data_min_[0], m.data_max_[0], m.n_samples_seen_)], "low double, high double, n long")


# --- linear models ---------------------------------------------------------------------------------------------------


def _ridge_sql(alpha: float, intercept: bool = True) -> str:
    mean = "avg({c})" if intercept else "0.0"
    return f"""
WITH m AS (SELECT {mean.format(c='l_quantity')} AS a, {mean.format(c='l_discount')} AS b, {mean.format(c='l_extendedprice')} AS y, count(*) AS n FROM lineitem),
g AS (SELECT sum((l_quantity - a) * (l_quantity - a)) + {alpha} AS aa, sum((l_quantity - a) * (l_discount - b)) AS ab, sum((l_discount - b) * (l_discount - b)) + {alpha} AS bb,
  sum((l_quantity - a) * (l_extendedprice - y)) AS ay, sum((l_discount - b) * (l_extendedprice - y)) AS by_ FROM lineitem, m),
w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS w1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS w2, m.* FROM g, m),
f AS (SELECT w1, w2, {'y - w1 * a - w2 * b' if intercept else '0.0'} AS c, n FROM w)
"""


XY = (["l_quantity", "l_discount"], "l_extendedprice")


def _ridge(spark, sf, **kw) -> DataFrame:
    r = RidgeRegressor(**kw).fit(read_table(spark, sf, "lineitem"), *XY)
    out = _rows(spark, [(r.coef_[0], r.coef_[1], r.intercept_, r.n_samples_fit_)], "w1 double, w2 double, c double, n long")
    return rounded(out, 3, "w1", "w2", "c")


_COEF = "SELECT round(w1, 3) + 0 AS w1, round(w2, 3) + 0 AS w2, round(c, 3) + 0 AS c, n FROM f"


@query("ridge_fit", _ridge_sql(1.0) + _COEF)
def ridge_fit(spark, sf):
    return _ridge(spark, sf)


@query("ridge_alpha0", _ridge_sql(0.0) + _COEF)
def ridge_alpha0(spark, sf):
    return _ridge(spark, sf, alpha=0.0, solver="cholesky")


@query("ridge_no_intercept", _ridge_sql(2.5, False) + _COEF)
def ridge_no_intercept(spark, sf):
    return _ridge(spark, sf, alpha=2.5, fit_intercept=False)


@query("ridge_predict", _ridge_sql(1.0) + "SELECT p_partkey, round(p_size * w1 + 0.05 * w2 + c, 3) + 0 AS prediction FROM part, f")
def ridge_predict(spark, sf):
    r = RidgeRegressor().fit(read_table(spark, sf, "lineitem"), *XY)
    part = read_table(spark, sf, "part").withColumn("discount", F.lit(0.05))
    return rounded(r.predict(part, features=["p_size", "discount"]).select("p_partkey", "prediction"), 3, "prediction")


@query(
    "ridge_score",
    _ridge_sql(1.0)
    + "SELECT round(1 - sum((l_extendedprice - l_quantity * w1 - l_discount * w2 - c) ** 2) / (var_pop(l_extendedprice) * count(*)), 8) + 0 AS r2 FROM lineitem, f",
)
def ridge_score(spark, sf):
    lines = read_table(spark, sf, "lineitem")
    return rounded(_rows(spark, [(RidgeRegressor().fit(lines, *XY).score(lines, XY[1]),)], "r2 double"), 8, "r2")


#: Small enough that some rows are outliers from the first round on.
HUBER_ROUNDS, HUBER_EPSILON = 6, 1.05


def _huber_sql(rounds: int, epsilon: float = HUBER_EPSILON, alpha: float = 1e-4) -> str:
    """Reweighted least squares of one feature, written out round by round."""
    least = max(2 * epsilon**2 - 1, 0.1)
    out = [
        "WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, count(*) AS n FROM lineitem)",
        "d AS (SELECT l_quantity - mx AS x, l_extendedprice - my AS y FROM lineitem, m)",
        f"w0 AS (SELECT sum(x * y) / (sum(x * x) + {alpha}) AS w FROM d)",
        "s0 AS (SELECT w, median(abs(y - w * x)) / 0.6745 AS s FROM d, w0 GROUP BY w)",
    ]
    for i in range(1, rounds + 1):
        edge = f"({epsilon} * s)"
        weight = f"CASE WHEN abs(y - w * x) <= {edge} THEN 1.0 ELSE {edge} / abs(y - w * x) END"
        out.append(f"w{i} AS (SELECT sum({weight} * x * y) / (sum({weight} * x * x) + {alpha}) AS w, any_value(s) AS s FROM d, s{i - 1})")
        loss = f"CASE WHEN abs(y - w * x) <= {edge} THEN 0.5 * (y - w * x) ** 2 ELSE {edge} * abs(y - w * x) - 0.5 * {edge} ** 2 END"
        out.append(f"s{i} AS (SELECT any_value(w) AS w, greatest(sqrt(2 * sum({loss}) / (count(*) * {least})), 1e-10) AS s FROM d, w{i})")
    return ", ".join(out) + f", f AS (SELECT w, s, my - w * mx AS c FROM s{rounds}, m) "


def _huber(spark, sf) -> tuple[HuberRegressor, DataFrame]:
    lines = read_table(spark, sf, "lineitem")
    return HuberRegressor(epsilon=HUBER_EPSILON, max_iter=HUBER_ROUNDS, tol=1e-300).fit(lines, ["l_quantity"], "l_extendedprice"), lines


@query("huber_fit", _huber_sql(HUBER_ROUNDS) + f"SELECT round(w, 4) + 0 AS w, round(c, 3) + 0 AS c, round(s, 3) + 0 AS s, {HUBER_ROUNDS}::BIGINT AS n_iter FROM f")
def huber_fit(spark, sf):
    h, _ = _huber(spark, sf)
    out = _rows(spark, [(h.coef_[0], h.intercept_, h.scale_, h.n_iter_)], "w double, c double, s double, n_iter long")
    return rounded(rounded(out, 4, "w"), 3, "c", "s")


@query("huber_predict", _huber_sql(HUBER_ROUNDS) + "SELECT p_partkey, round(p_size * w + c, 3) + 0 AS prediction FROM part, f")
def huber_predict(spark, sf):
    h, _ = _huber(spark, sf)
    return rounded(h.predict(read_table(spark, sf, "part"), features=["p_size"]).select("p_partkey", "prediction"), 3, "prediction")


@query("huber_score", _huber_sql(HUBER_ROUNDS) + "SELECT round(1 - sum((l_extendedprice - l_quantity * w - c) ** 2) / (var_pop(l_extendedprice) * count(*)), 8) + 0 AS r2 FROM lineitem, f")
def huber_score(spark, sf):
    h, lines = _huber(spark, sf)
    return rounded(_rows(spark, [(h.score(lines, "l_extendedprice"),)], "r2 double"), 8, "r2")


@query("huber_converged")
def huber_converged(spark, sf):
    """Default stopping."""
    h = HuberRegressor().fit(read_table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    out = _rows(spark, [(*h.coef_, h.intercept_, h.scale_, h.n_iter_)], "w1 double, w2 double, c double, s double, n_iter long")
    return rounded(out, 2, "w1", "w2", "c", "s")


# --- neighbours ------------------------------------------------------------------------------------------------------

_VECTORS = "SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_ASKED = "vec_id % 10 = 0"


def _knn_sql(power: str, root: str, k: int = 5) -> str:
    pairs = f"list_sum(list_transform(list_zip(q.v, t.v), lambda z: {power}))"
    return f"""
WITH e AS ({_VECTORS}),
d AS (SELECT q.vec_id AS query_id, t.vec_id AS neighbor_id, t.label, {pairs} AS power FROM (SELECT * FROM e WHERE {_ASKED}) q, (SELECT * FROM e WHERE NOT {_ASKED}) t),
r AS (SELECT *, {root} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY power, neighbor_id) AS rank FROM d QUALIFY rank <= {k})
"""


_L2 = _knn_sql("(z[1] - z[2]) * (z[1] - z[2])", "sqrt(power)")


def _split(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = read_table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("long"))
    return e.filter(F.col("vec_id") % 10 != 0), e.filter(F.col("vec_id") % 10 == 0)


_NEIGHBORS = "SELECT query_id, rank, neighbor_id, round(distance, 6) + 0 AS distance FROM r"


def _kneighbors(metric: str, p: float = 2.0, **kw):
    def run(spark, sf):
        train, asked = _split(spark, sf)
        m = KNeighborsRegressor(metric=metric, p=p, **kw).fit(train, "embedding", "label", "vec_id")
        return rounded(m.kneighbors(asked).withColumn("rank", F.col("rank").cast("long")), 6, "distance")

    return run


query("knn_euclidean", _L2 + _NEIGHBORS)(_kneighbors("euclidean"))
query("knn_kd_tree", _L2 + _NEIGHBORS)(_kneighbors("euclidean", algorithm="kd_tree"))
query("knn_ball_tree", _L2 + _NEIGHBORS)(_kneighbors("euclidean", algorithm="ball_tree"))
query("knn_manhattan", _knn_sql("abs(z[1] - z[2])", "power") + _NEIGHBORS)(_kneighbors("manhattan"))
query("knn_minkowski3", _knn_sql("abs(z[1] - z[2]) ** 3", "power ** (1.0 / 3)") + _NEIGHBORS)(_kneighbors("minkowski", 3.0))

_VOTES = """, v AS (SELECT query_id, label, {w} AS vote FROM r GROUP BY query_id, label),
p AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY vote DESC, label) AS place, vote / sum(vote) OVER (PARTITION BY query_id) AS share FROM v)
"""


def _classifier(spark, sf, weights: str) -> tuple[KNeighborsClassifier, DataFrame]:
    train, asked = _split(spark, sf)
    return KNeighborsClassifier(weights=weights).fit(train, "embedding", "label", "vec_id"), asked


def _predicted(m, asked) -> DataFrame:
    return m.predict(asked).select(F.col("vec_id").alias("query_id"), "prediction")


_UNIFORM, _DISTANCE = _VOTES.format(w="count(*)::DOUBLE"), _VOTES.format(w="sum(1 / distance)")


@query("knn_cls_predict", _L2 + _UNIFORM + "SELECT query_id, label AS prediction FROM p WHERE place = 1")
def knn_cls_predict(spark, sf):
    return _predicted(*_classifier(spark, sf, "uniform"))


@query("knn_cls_distance", _L2 + _DISTANCE + "SELECT query_id, label AS prediction FROM p WHERE place = 1")
def knn_cls_distance(spark, sf):
    return _predicted(*_classifier(spark, sf, "distance"))


@query(
    "knn_cls_proba",
    _L2
    + _DISTANCE
    + f", c AS (SELECT DISTINCT label FROM e WHERE NOT {_ASKED}), q AS (SELECT DISTINCT query_id FROM r) "
    "SELECT q.query_id, c.label, round(coalesce(p.share, 0), 6) + 0 AS probability FROM q CROSS JOIN c LEFT JOIN p ON p.query_id = q.query_id AND p.label = c.label",
)
def knn_cls_proba(spark, sf):
    m, asked = _classifier(spark, sf, "distance")
    return rounded(m.proba(asked), 6, "probability")


@query("knn_cls_score", _L2 + _UNIFORM + "SELECT round(avg((p.label = e.label)::INT::DOUBLE), 8) + 0 AS accuracy FROM p JOIN e ON e.vec_id = p.query_id WHERE place = 1")
def knn_cls_score(spark, sf):
    m, asked = _classifier(spark, sf, "uniform")
    return rounded(_rows(spark, [(m.score(asked, "label"),)], "accuracy double"), 8, "accuracy")


#: Customers asked about, among whom many share a balance with a training row once it is rounded.
def _customer_sql(k: int) -> str:
    return f"""
WITH c AS (SELECT c_custkey AS id, round(c_acctbal / 50) AS x, c_nationkey::DOUBLE AS y FROM customer),
d AS (SELECT q.id AS query_id, q.y AS own, t.id AS neighbor_id, t.y, abs(q.x - t.x) AS distance FROM (SELECT * FROM c WHERE id % 5 = 0) q, (SELECT * FROM c WHERE id % 5 <> 0) t),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance * distance, neighbor_id) AS rank FROM d QUALIFY rank <= {k})
"""


def _customers(spark, sf, **kw) -> tuple[KNeighborsRegressor, DataFrame]:
    c = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") / 50).alias("x"), F.col("c_nationkey").cast("double").alias("y")
    )
    return KNeighborsRegressor(**kw).fit(c.filter("id % 5 <> 0"), ["x"], "y", "id"), c.filter("id % 5 = 0")


def _regressed(m, asked) -> DataFrame:
    return rounded(m.predict(asked).select(F.col("id").alias("query_id"), "prediction"), 6, "prediction")


_WEIGHTED = "coalesce(min_by(y, rank) FILTER (distance = 0), sum(y / nullif(distance, 0)) / sum(1 / nullif(distance, 0)))"


@query("knn_reg_predict", _customer_sql(5) + "SELECT query_id, round(avg(y), 6) + 0 AS prediction FROM r GROUP BY query_id")
def knn_reg_predict(spark, sf):
    return _regressed(*_customers(spark, sf))


@query("knn_reg_kd_tree", _customer_sql(5) + "SELECT query_id, round(avg(y), 6) + 0 AS prediction FROM r GROUP BY query_id")
def knn_reg_kd_tree(spark, sf):
    return _regressed(*_customers(spark, sf, algorithm="kd_tree"))


@query("knn_reg_ball_tree", _customer_sql(5) + "SELECT query_id, round(avg(y), 6) + 0 AS prediction FROM r GROUP BY query_id")
def knn_reg_ball_tree(spark, sf):
    return _regressed(*_customers(spark, sf, algorithm="ball_tree", leaf_size=10))


@query(
    "knn_all_rows",
    """
WITH s AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier),
d AS (SELECT q.id AS query_id, t.id AS neighbor_id, (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) AS power FROM s q, s t)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY power, neighbor_id) AS rank, neighbor_id, round(sqrt(power), 6) + 0 AS distance FROM d QUALIFY rank <= 5
""",
)
def knn_all_rows(spark, sf):
    """Every row asked about, against all rows, itself among them."""
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    found = KNeighborsRegressor(algorithm="kd_tree").fit(s, ["x", "y"], id_col="id").kneighbors(s)
    return rounded(found.withColumn("rank", F.col("rank").cast("long")), 6, "distance")


@query("knn_reg_distance", _customer_sql(5) + f"SELECT query_id, round({_WEIGHTED}, 6) + 0 AS prediction FROM r GROUP BY query_id")
def knn_reg_distance(spark, sf):
    return _regressed(*_customers(spark, sf, weights="distance"))


@query("knn_reg_exact", "SELECT c_custkey AS query_id, c_nationkey::DOUBLE AS prediction FROM customer")
def knn_reg_exact(spark, sf):
    """Training rows asked about themselves: distance 0 wins outright."""
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("double").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return _regressed(KNeighborsRegressor(n_neighbors=3, weights="distance").fit(c, ["x"], "y", "id"), c)


@query(
    "knn_reg_score",
    _customer_sql(5)
    + ", p AS (SELECT query_id, any_value(own) AS own, avg(y) AS y FROM r GROUP BY query_id) SELECT round(1 - sum((own - y) ** 2) / (var_pop(own) * count(*)), 8) + 0 AS r2 FROM p",
)
def knn_reg_score(spark, sf):
    m, asked = _customers(spark, sf)
    return rounded(_rows(spark, [(m.score(asked, "y"),)], "r2 double"), 8, "r2")


# --- clusters --------------------------------------------------------------------------------------------------------

_SQUARE = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_CENTERS = f"""
WITH e AS ({_VECTORS}),
x AS (SELECT vec_id, label, generate_subscripts(v, 1) AS j, unnest(v) AS u FROM e),
c AS (SELECT label AS cluster, list(m ORDER BY j) AS v FROM (SELECT label, j, avg(u) AS m FROM x GROUP BY label, j) GROUP BY label),
d AS (SELECT e.vec_id, c.cluster, {_SQUARE.format(a='e.v', b='c.v')} AS d FROM e, c)
"""


def _mean_model(spark, sf) -> tuple[KMeans, DataFrame]:
    """Centres at the means of the labels."""
    e = read_table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    x = e.select("label", F.posexplode("embedding").alias("j", "u")).groupBy("label", "j").agg(F.avg(F.col("u").cast("double")).alias("m"))
    rows = x.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("v")).orderBy("label").collect()
    return KMeans.from_centers(np.array([[p["m"] for p in r["v"]] for r in rows]), Features.of(e, "embedding")), e


@query("km_predict", _CENTERS + "SELECT vec_id, min_by(cluster, (d, cluster))::BIGINT AS prediction FROM d GROUP BY vec_id")
def km_predict(spark, sf):
    m, e = _mean_model(spark, sf)
    return m.predict(e).select("vec_id", "prediction")


@query("km_transform", _CENTERS + "SELECT vec_id, cluster::BIGINT AS cluster, round(sqrt(d), 6) + 0 AS distance FROM d")
def km_transform(spark, sf):
    m, e = _mean_model(spark, sf)
    out = m.transform(e).select("vec_id", F.posexplode("distances").alias("cluster", "distance"))
    return rounded(out.withColumn("cluster", F.col("cluster").cast("long")), 6, "distance")


@query("km_score", _CENTERS + "SELECT round(-sum(d), 5) + 0 AS score FROM (SELECT min(d) AS d FROM d GROUP BY vec_id)")
def km_score(spark, sf):
    m, e = _mean_model(spark, sf)
    return rounded(_rows(spark, [(m.score(e),)], "score double"), 5, "score")


def _draws(seed: int, n: int) -> list[int]:
    from tabulon.functions.pcg import Pcg32

    rng = Pcg32(seed)
    return [rng.word64() for _ in range(n)]


CLUSTERS, ROUNDS = 4, 3


def _lloyd_sql(start: str, rounds: int, table: str = "e") -> str:
    """``start`` defines c0 (cluster, v); each round assigns and averages."""
    out = [start]
    for i in range(rounds + 1):
        out.append(f"a{i} AS (SELECT e.vec_id, min_by(c.cluster, (d, c.cluster)) AS cluster, min(d) AS d FROM (SELECT e.vec_id, c.cluster, {_SQUARE.format(a='e.v', b='c.v')} AS d FROM {table} e, c{i} c) t JOIN {table} e USING (vec_id) JOIN c{i} c ON c.cluster = t.cluster GROUP BY e.vec_id)")
        out.append(
            f"c{i + 1} AS (SELECT cluster, list(m ORDER BY j) AS v FROM (SELECT cluster, j, avg(u) AS m FROM (SELECT a.cluster, generate_subscripts(e.v, 1) AS j, unnest(e.v) AS u FROM a{i} a JOIN {table} e USING (vec_id)) GROUP BY cluster, j) GROUP BY cluster)"
        )
    return ", ".join(out)


def _random_start(seed: int, k: int) -> str:
    """Drawn places of a shuffle's first entries, as SQL. Draw i picks from place i on; the draws of this seed meet no place twice."""
    out = [f"WITH e AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM ({_VECTORS})), n AS (SELECT count(*)::UHUGEINT AS n FROM e)"]
    picks = []
    for i, word in enumerate(_draws(seed, k)):
        slot = f"({i} + ({word}::UHUGEINT % (n - {i})))::BIGINT"
        out.append(f"j{i} AS (SELECT {slot} AS j FROM n)")
        picks.append(f"SELECT {i} AS cluster, j AS pos FROM j{i}")
    out.append(f"s AS ({' UNION ALL '.join(picks)})")
    out.append("c0 AS (SELECT s.cluster, e.v FROM s JOIN e USING (pos))")
    return ", ".join(out)


_FITTED = "SELECT cluster::BIGINT AS cluster, count(*) AS n, round(sum(d), 5) + 0 AS inertia FROM a{r} GROUP BY cluster"


def _fitted_clusters(spark, sf, **kw) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    m = KMeans(**{"n_clusters": CLUSTERS, "tol": 0.0, "n_init": 1, "random_state": 42, "local_cells": 0} | kw).fit(e, "embedding", id_col="vec_id")
    rows = m.assign(e).select(F.col("prediction").alias("cluster"), F.pow(F.array_min("distances"), 2).alias("d"))
    return rounded(rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d").alias("inertia")), 5, "inertia")


@query("km_random_init", _lloyd_sql(_random_start(42, CLUSTERS), ROUNDS) + " " + _FITTED.format(r=ROUNDS))
def km_random_init(spark, sf):
    return _fitted_clusters(spark, sf, init="random", max_iter=ROUNDS)


def _plus_plus_start(seed: int, k: int) -> str:
    """k-means++ with its draws as literals."""
    trials = 2 + int(np.floor(np.log(k)))
    words = _draws(seed, 1 + trials * (k - 1))
    uniform = [(w >> 11) / 2.0**53 for w in words]
    out = [
        f"WITH e AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM ({_VECTORS})), n AS (SELECT count(*)::UHUGEINT AS n FROM e)",
        f"p0 AS (SELECT ({words[0]}::UHUGEINT % n)::BIGINT AS pos FROM n)",
    ]
    for i in range(1, k):
        chosen = " UNION ALL ".join(f"SELECT pos FROM p{h}" for h in range(i))
        out.append(f"d{i} AS (SELECT e.pos, e.v, min({_SQUARE.format(a='e.v', b='c.v')}) AS d FROM e, (SELECT v FROM e WHERE pos IN ({chosen})) c GROUP BY e.pos, e.v)")
        out.append(f"r{i} AS (SELECT pos, sum(d) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS s, (SELECT sum(d) FROM d{i}) AS pot FROM d{i})")
        draws = ", ".join(f"({t}, {uniform[1 + (i - 1) * trials + t]!r}::DOUBLE)" for t in range(trials))
        out.append(f"t{i} AS (SELECT t, min(pos) AS pos FROM r{i}, (VALUES {draws}) u(t, x) WHERE s >= x * pot GROUP BY t)")
        out.append(
            f"p{i} AS (SELECT arg_min(pos, (pot, t)) AS pos FROM (SELECT t.t, t.pos, sum(least(d.d, {_SQUARE.format(a='d.v', b='c.v')})) AS pot FROM t{i} t JOIN e c USING (pos), d{i} d GROUP BY t.t, t.pos))"
        )
    out.append("c0 AS (SELECT cluster, v FROM (" + " UNION ALL ".join(f"SELECT {i} AS cluster, pos FROM p{i}" for i in range(k)) + ") JOIN e USING (pos))")
    return ", ".join(out)


@query("km_pp_init", _lloyd_sql(_plus_plus_start(42, CLUSTERS), 1) + " " + _FITTED.format(r=1))
def km_pp_init(spark, sf):
    return _fitted_clusters(spark, sf, max_iter=1)


@query("km_lloyd", _lloyd_sql(_plus_plus_start(42, CLUSTERS), ROUNDS) + " " + _FITTED.format(r=ROUNDS))
def km_lloyd(spark, sf):
    return _fitted_clusters(spark, sf, max_iter=ROUNDS)


@query("km_lloyd_local", _lloyd_sql(_plus_plus_start(42, CLUSTERS), ROUNDS) + " " + _FITTED.format(r=ROUNDS))
def km_lloyd_local(spark, sf):
    """The same draws and rounds on one array."""
    return _fitted_clusters(spark, sf, max_iter=ROUNDS, local_cells=None)


@query("km_converged")
def km_converged(spark, sf):
    """Default clusters, restarts and stopping."""
    return _fitted_clusters(spark, sf, n_clusters=8, tol=1e-4, n_init=None)


@query("km_restarts")
def km_restarts(spark, sf):
    """The best of ten runs from random rows."""
    return _fitted_clusters(spark, sf, tol=1e-4, n_init=None, init="random", local_cells=None)
