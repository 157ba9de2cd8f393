"""Small tables for the operators' tests."""

import random

import pandas as pd

EDGE = [None, "", " ", "a", "ein Wort", "é" * 300, "word " * 5000, "\t\n", "x" * 70_000]


def docs_frame(spark, rows, extra=True):
    """(doc_id, text) rows; with columns whose names operators use for their own ends."""
    schema = "doc_id long, text string"
    if not extra:
        return spark.createDataFrame(rows, schema)
    wide = [(i, t, "en", "src", None, 1.0, 7, "k") for i, t in rows]
    return spark.createDataFrame(wide, schema + ", lang string, source string, n_chars long, score double, block int, key string")


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def mixed_rows(seed=1, n=60):
    """Ordinary texts, copies, near copies, edge cases, a repeated row and a null id."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randrange(5, 200))) for i in range(n)]
    rows += [(n + i, rows[i % 5][1]) for i in range(10)]
    for i in range(10):
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows.append((n + 20 + i, " ".join(w)))
    rows += [(1000 + i, t) for i, t in enumerate(EDGE)]
    rows += [(1000, None), (None, "no id"), (5, rows[5][1])]
    return rows


def to_pandas(df, *order) -> pd.DataFrame:
    found = df.toPandas()
    return found.sort_values(list(order or found.columns)).reset_index(drop=True)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
