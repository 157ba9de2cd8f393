import numpy as np
from fixtures import docs_frame, empty, mixed_rows

from tabulon.llm import language as L

SPEECH = {
    "de": "der hund und die katze gehen nicht über die straße weil es regnet und sie müde sind ",
    "en": "the dog and the cat do not walk over the street because it rains and they are tired ",
    "fr": "le chien et le chat ne vont pas dans la rue parce que la pluie est là et ils sont las ",
}


def train(spark):
    rows = []
    for lang, text in SPEECH.items():
        w = text.split()
        rows += [(len(rows) + i, " ".join(w[i % 9 :] + w[: i % 7]), lang) for i in range(30)]
    return spark.createDataFrame(rows + [(900, "nichts", None), (901, None, "en"), (902, "", "xx")], "doc_id long, text string, lang string")


def plain_length(counts, text):
    """Code length of a text, byte by byte, from counts of (context, byte)."""
    data, total = bytes(3) + text, 0.0
    for i in range(3, len(data)):
        p = 1.0
        for k in range(3, -1, -1):
            seen = counts.get(data[i - k : i], {})
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                p *= seen[data[i]] / (n + d)
                break
            if seen:
                p *= d / (n + d)
        else:
            p /= 256
        total -= np.log(p)
    return total


def test_code_lengths_match_a_plain_coder():
    texts = {lang: [(t * 3).encode()] for lang, t in SPEECH.items()}
    trees, plain = [], []
    for lang in sorted(texts):
        data = bytes(3) + texts[lang][0]
        keys, n = np.unique(L.quadruples(np.frombuffer(data, np.uint8)), return_counts=True)
        trees.append(L.ContextTree.of(keys, n.astype(float)))
        counts = {}
        for i in range(3, len(data)):
            for k in range(4):
                own = counts.setdefault(data[i - k : i], {})
                own[data[i]] = own.get(data[i], 0) + 1
        plain.append(counts)
    model = L.LanguageModel(sorted(texts), trees)
    asked = [b"the cat", b"", "müde größe".encode(), b"qqqq zz\x00\xff", b"die katze " * 10, b"x"]
    want = [[plain_length(c, t) for c in plain] for t in asked]
    np.testing.assert_allclose(model.code_lengths(asked), want, rtol=1e-12)


def test_long_texts_in_pieces(monkeypatch):
    data = (SPEECH["en"] * 40).encode()
    keys, n = np.unique(L.quadruples(np.frombuffer(bytes(3) + data, np.uint8)), return_counts=True)
    model = L.LanguageModel(["en"], [L.ContextTree.of(keys, n.astype(float))])
    whole = model.code_lengths([data, b"z", data])
    monkeypatch.setattr(L, "_PIECE", 100)
    np.testing.assert_allclose(model.code_lengths([data, b"z", data]), whole, rtol=1e-6)


def test_predict(spark):
    model = L.fit(train(spark))
    assert model.languages == ["de", "en", "fr"]
    rows = [(1, "the cat and the street"), (2, "die katze und der hund"), (3, "le chat et la rue"), (4, None), (5, ""), (6, "123 !?"), (7, "the cat and the street")]
    df = docs_frame(spark, rows).withColumnRenamed("key", "lang_pred")
    found = {r["doc_id"]: r for r in L.predict(df, model).collect()}
    assert [found[i]["lang_pred"] for i in range(1, 8)] == ["en", "de", "fr", "und", "und", "und", "en"]
    assert found[4]["score"] == 0 and found[1]["score"] > 0.9 and found[1]["score"] == found[7]["score"]
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 7]


def test_edges(spark):
    model = L.fit(train(spark))
    found = L.predict(docs_frame(spark, mixed_rows()), model).collect()
    assert len(found) == len(mixed_rows()) and all(0 <= r["score"] <= 1 for r in found)
    assert L.predict(empty(spark), model).count() == 0
    nothing = L.fit(train(spark).limit(0))
    assert {r["lang_pred"] for r in L.predict(docs_frame(spark, [(1, "abc")]), nothing).collect()} == {"und"}
    assert L.keep_identified(docs_frame(spark, [(1, "abc")]), nothing).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = L.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    found = found.filter("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98


def test_long_texts_are_learnt_from(spark, monkeypatch):
    rows = [(i, SPEECH[x] * 1200, x) for i, x in enumerate(SPEECH)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df)
    assert model.languages == sorted(SPEECH)
    monkeypatch.setattr(L, "_COUNTED", 1000)
    pieces = [q for t in (b"abc", b"", bytes(3) + b"x" * 2500, b"hello") for q in [t]]
    whole = np.concatenate([L.quadruples(np.frombuffer(t, np.uint8)) for t in pieces if len(t) > 3])
    assert np.array_equal(np.concatenate(list(L._pieces(pieces))), whole)
