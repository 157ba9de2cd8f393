import random

import pytest
from fixtures import EDGE, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    """Documents with planted copies, passages and benchmark text, as the tables of a scale."""
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("tables")
    item, passage = words(rng, 30, 20_000), words(rng, 60, 20_000)
    base = words(rng, 150, 20_000).split()
    near = list(base)
    near[70] = "other"
    rows = [(i, words(rng, rng.randrange(20, 150), 20_000)) for i in range(40)]
    rows += [(100, " ".join(base)), (101, " ".join(base)), (102, " ".join(near))]
    rows += [(110 + i, words(rng, 20, 20_000) + " " + passage + " " + words(rng, 20, 20_000)) for i in range(3)]
    rows += [(120, words(rng, 30, 20_000) + " " + item)]
    rows += [(200 + i, t) for i, t in enumerate(EDGE)] + [(0, rows[0][1]), (None, "an id is missing here")]
    table = [(i, t, "en", "src", None if t is None else len(t), 1, 2, "k", 0.5, 3, "g") for i, t in rows]
    extra = "h long, node long, tkey string, score double, text_hash long, keeper string"  # names that the stages use themselves
    spark.createDataFrame(table, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), passage


def test_stages(spark, folder, tmp_path):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.columns == columns, name
            kept[n] = {r["doc_id"]: r for r in docs.collect()}
    assert {200, 201, 202, 207} & set(kept[0]) == set() and 120 in kept[0]
    assert 100 in kept[1] and not {101, 102} & set(kept[1]) and set(range(40)) <= set(kept[1])
    for i in range(3):
        assert passage[5:-5] not in kept[2][110 + i]["text"] and len(kept[2][110 + i]["text"]) == kept[2][110 + i]["n_chars"]
    assert 120 in kept[2] and 120 not in kept[3] and set(range(40)) <= set(kept[3])
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == set(kept[3])


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert "sequence_id" in out.columns and out.count() >= 40


def test_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
