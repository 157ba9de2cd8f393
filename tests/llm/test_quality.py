import random

import numpy as np
from fixtures import docs_frame, empty, mixed_rows, words

from tabulon.llm import quality


def labelled(spark, n=120):
    rng = random.Random(2)
    good = [(i, words(rng, 80)) for i in range(n)]
    bad = [(n + i, " ".join(f"{w.upper()}!!" for w in words(rng, 80).split())) for i in range(n)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(3, None), (5, 1)], "doc_id long, quality int")
    return good + bad, labels


def test_learns_and_scores(spark):
    rows, labels = labelled(spark)
    model = quality.fit(docs_frame(spark, rows), labels, sample_docs=80)
    rng = random.Random(9)
    new = [(i, words(rng, 60)) for i in range(20)] + [(20 + i, " ".join(f"{w.upper()}!!" for w in words(rng, 60).split())) for i in range(20)]
    score = {r["doc_id"]: r["score"] for r in quality.score(docs_frame(spark, new), model).collect()}
    assert min(score[i] for i in range(20)) > max(score[20 + i] for i in range(20))
    again = {r["doc_id"]: r["score"] for r in quality.score(docs_frame(spark, new), quality.fit(docs_frame(spark, rows).repartition(7), labels, sample_docs=80)).collect()}
    assert score == again


def test_edges(spark):
    rows, labels = labelled(spark)
    model = quality.fit(docs_frame(spark, rows), labels)
    found = quality.score(docs_frame(spark, mixed_rows()), model).collect()
    assert len(found) == len(mixed_rows()) and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1000, 1001)}) == 1
    assert quality.score(empty(spark), model).count() == 0


def test_one_class_gives_the_prior(spark):
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    model = quality.fit(docs_frame(spark, [(0, "a b"), (1, "c")]), labels)
    assert [round(r["score"], 6) for r in quality.score(docs_frame(spark, [(9, "zz")]), model).collect()] == [0.75]
    none = quality.fit(empty(spark), labels.limit(0))
    assert quality.score(docs_frame(spark, [(9, "zz")]), none).first()["score"] == 0.5


def test_logistic_recovers_a_curve():
    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    a, b = quality.fit_logistic(x, y, np.ones(20_000))
    assert abs(a - 2) < 0.1 and abs(b + 1) < 0.1


def test_held_out_accuracy(spark, tables):
    """On the synthetic tables: labels that were not learnt from."""
    sf = "/root/testdata/sf0.01"
    found = quality.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = found[found.quality == 1].score, found[found.quality == 0].score
    auc = np.mean(good.to_numpy()[:, None] > bad.to_numpy()[None, :])
    assert auc > 0.85


def test_against_plain_compression(spark):
    """Every score from its dictionaries, block by block, with a fresh compressor each time; long texts among them."""
    import zstandard as zstd

    rows, labels = labelled(spark)
    model = quality.fit(docs_frame(spark, rows), labels)
    size = lambda d, b: len(zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(b))
    asked = mixed_rows()
    want = []
    for i, t in asked:
        data = (t or "").encode()
        parts = [data[j : j + 512] for j in range(0, len(data), 512)]
        good, bad = (sum(size(d, b) for b in parts) for d in (model.good, model.bad))
        x = (bad - good) / (bad + good) if parts else 0.0
        want.append((i, 0.999 * np.interp(x, model.at, model.height) + 0.001 / (1 + np.exp(-(model.slope * x + model.intercept)))))
    found = [(r["doc_id"], r["score"]) for r in quality.score(docs_frame(spark, asked), model).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found, want = sorted(found, key=key), sorted(want, key=key)
    assert [i for i, _ in found] == [i for i, _ in want]
    np.testing.assert_allclose([s for _, s in found], [s for _, s in want], rtol=1e-9)


def test_long_texts_are_learnt_from(spark):
    """Labels on texts of over a megabyte only: they still make dictionaries, from blocks spread over the whole text."""
    rng = random.Random(4)
    good = [(i, words(rng, 220_000)) for i in range(2)]
    bad = [(9 + i, " ".join(f"{w.upper()}!!" for w in words(rng, 200_000).split())) for i in range(2)]
    labels = spark.createDataFrame([(i, int(i < 9)) for i, _ in good + bad], "doc_id long, quality int")
    model = quality.fit(docs_frame(spark, good + bad), labels)
    assert model.good is not None
    score = {r["doc_id"]: r["score"] for r in quality.score(docs_frame(spark, [(1, words(rng, 90)), (2, words(rng, 90).upper() + "!!")]), model).collect()}
    assert score[1] > score[2]
    text = bytes(range(256)) * 2000
    picked = quality.spread_blocks(text)
    assert len(picked) == quality.TEXT_BLOCKS and quality.spread_blocks(text[:1500]) == [text[:512], text[512:1024], text[1024:1500]]
