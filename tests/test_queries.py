"""Every estimator's query against its SQL, on the same tables."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tabulon import queries

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(tables):
    connection = duckdb.connect()
    for path in sorted(Path(tables).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 9) if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_equals_sql(spark, duck, tables, name):
    found = queries.QUERIES[name](spark, tables)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    got = canonical([tuple(r) for r in found.collect()], found.columns)
    want = canonical(cursor.fetchall(), columns)
    assert got == want and got


@pytest.mark.parametrize("name,clusters,runs,init", [("km_converged", 8, 1, "k-means++"), ("km_restarts", 4, 10, "random")])
def test_kmeans_until_it_converges(spark, tables, name, clusters, runs, init):
    """Rounds on one array from the same draws, to the same tolerance."""
    from test_cluster import serial

    rows = spark.read.parquet(f"{tables}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    centers, inertia, _ = min((serial(x, clusters, init, 42 + i) for i in range(runs)), key=lambda r: r[1])
    d = ((x[:, None] - centers[None]) ** 2).sum(axis=2)
    found = queries.QUERIES[name](spark, tables).orderBy("cluster").collect()
    assert [r["n"] for r in found] == np.bincount(d.argmin(axis=1), minlength=clusters).tolist()
    assert abs(sum(r["inertia"] for r in found) - inertia) < 1e-3


def test_huber_until_it_converges(spark, tables):
    """At the minimum the gradient of the loss, at the scale found, is as good as zero."""
    w1, w2, c, s, n_iter = queries.QUERIES["huber_converged"](spark, tables).first()
    rows = spark.read.parquet(f"{tables}/lineitem.parquet").select("l_quantity", "l_discount", "l_extendedprice").toPandas().to_numpy(dtype=float)
    left = rows[:, 2] - rows[:, :2] @ [w1, w2] - c
    assert 0 < n_iter < 100 and s > 0 and abs(np.mean(left)) < 0.05 * np.std(left)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "tabulon", tmp_path / "tabulon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(queries.QUERIES)), "False", str(len(queries.ORACLES))]


def test_fitted_clusters_take_one_pass(spark, tables):
    """Labels and distances come from one Python worker a task, not from two at once."""
    plan = queries.QUERIES["km_random_init"](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
