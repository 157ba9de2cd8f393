"""Queries that SQL can express, against it."""

import duckdb
import pytest

from tabulon.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_equals_sql(spark, tables, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    found = queries.QUERIES[name](spark, tables)
    cursor = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    got = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=str)
    assert got == sorted(cursor.fetchall(), key=str)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 11))


def test_registered_with_the_driver():
    """The entry point leaves the subpackage out where it can't be imported; where it is there, no query may be missing."""
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())
