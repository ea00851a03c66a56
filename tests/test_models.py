import math

import pytest
from pyspark.sql import functions as F

from larder.operators import classify, corpus, embedding, geometry, linguistics, terms


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("1", ["bolo", "chocolate"]), ("2", ["bolo", "cacau"]), ("3", ["frango", "alho"]), ("4", [])], "key string, tokens array<string>")


def test_tfidf(spark, docs):
    w = {(r.key, r.term): r.tfidf for r in terms.weights(docs).collect()}
    assert w["1", "chocolate"] == pytest.approx(math.log(4)) and w["1", "bolo"] == pytest.approx(math.log(2)) and len(w) == 6


def test_sparse_neighbours_fill_with_zeros(docs):
    unit = terms.normalized(terms.weights(docs))
    got = [(r.neighbour, r.cosine > 0) for r in terms.sparse_neighbours(unit, docs.where("key = '1'"), docs, 3).orderBy("rank").collect()]
    assert got == [("2", True), ("3", False), ("4", False)]


def test_embedding(spark, docs):
    pairs = embedding.cooccurrence(docs, 2)
    assert {(r.term, r.context): r.weight for r in pairs.collect()}[("bolo", "cacau")] == 1.0
    vectors = embedding.word_vectors(embedding.ppmi(pairs), 12)
    assert all(abs(math.fsum(x * x for x in r.vec) - 1) < 1e-9 and len(r.vec) == 12 for r in vectors.collect())
    dv = embedding.document_vectors(docs, vectors, 12)
    assert {r.key: sum(map(abs, r.vec)) > 0 for r in dv.collect()} == {"1": True, "2": True, "3": True, "4": False}
    hits = embedding.semantic_search("bolos com chocolate", dv, vectors, 12, 2).collect()
    assert hits[0].key == "1" and embedding.semantic_search("xyz", dv, vectors, 12).count() == 0
    assert embedding.contextual(docs, vectors, 12).count() == 6


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 1.0], [2.0, 2.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(embedding.cosine(F.col("a"), F.col("b"))).collect()] == [1, 0, 0]


def test_naive_bayes(spark):
    rows = [(f"f{i}", "fácil", ["misture", "leve", "rapido"]) for i in range(4)] + [(f"d{i}", "difícil", ["massa", "fermento", "longo"]) for i in range(4)] + [("x", "médio", ["um"])]
    df = spark.createDataFrame(rows, "key string, label string, tokens array<string>")
    split = classify.stratified_split(df, 0.25)
    n = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert n == {("fácil", "test"): 1, ("fácil", "train"): 3, ("difícil", "test"): 1, ("difícil", "train"): 3, ("médio", "train"): 1}
    got = classify.predict(df, split.where("split = 'train'"))
    p = {r.key: (r.predicted, r.confidence) for r in got.collect()}
    assert p["f0"][0] == "fácil" and p["d1"][0] == "difícil" and all(0 < c <= 1 for _, c in p.values())
    res = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "actual string, predicted string")
    m = classify.confusion(res)
    assert {(r.actual, r.predicted): r["count"] for r in m.collect()} == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 2}
    assert classify.summary(m).first().accuracy == 0.75
    assert classify.status(split.where("label = 'médio'")) == "insufficient_classes"


def test_dependencies_and_sentiment(spark):
    df = spark.createDataFrame([(["adicione", "a", "cebola", "na", "panela"],), (["ficou", "muito", "facil", "e", "delicioso"],), (["nao", "ficou", "ruim"],), ([],)], "w array<string>")
    d = linguistics.dependencies(df, "w").collect()
    assert [(t.token, t.relation) for t in d[0].d] == [("adicione", "root"), ("a", "det"), ("cebola", "obj"), ("na", "case"), ("panela", "nmod")] and d[3].d == []
    s = df.select(linguistics.sentiment(F.col("w")).alias("s"), linguistics.aspects(F.col("w")).alias("a")).collect()
    assert s[1].s.polarity == "positivo" and set(s[1].a) == {"preparo", "sabor"} and s[2].s.polarity == "positivo" and s[2].s.evidence[0].negated and s[3].s.polarity == "neutro"


def test_entities():
    got = {(e[3], e[2]) for e in linguistics.find_entities("preparation_step", "Asse por 30 minutos a 180 °C")}
    assert {("DURATION", "30 minutos"), ("TEMPERATURE", "180 °C")} <= got
    assert ("INGREDIENT", "cebola") in {(e[3], e[4]) for e in linguistics.find_entities("ingredient", "200 g de cebola picada")}


def test_clusters(spark):
    rows = [(f"{g}{i}", [1.0 if j == g else 0.01 * i for j in range(3)]) for g in range(3) for i in range(3)]
    pts = spark.createDataFrame(rows, "id string, vec array<double>")
    k, labels, score = geometry.select_cluster_count(pts, 3, most=4, restarts=2, rounds=5)
    assert k == 3 and score > 0.9 and sorted(r["count"] for r in labels.groupBy("label").count().collect()) == [3, 3, 3]
    assert geometry.kmeans(pts.limit(0), 3, 3)[0].count() == 0
    s = geometry.principal_scores(pts, 3).collect()
    assert len(s) == 9 and all(len(r.scores) == 3 for r in s)
    assert geometry.silhouette(pts.withColumn("label", F.lit(1))).agg(F.sum("silhouette")).first()[0] == 0


def test_duplicates_and_newest(spark):
    df = spark.createDataFrame([("10", "k"), ("9", "k"), ("x", "k"), ("30", ""), ("40", "z")], "id string, key string")
    assert {tuple(r) for r in corpus.exact_duplicates(df, "id", "key").collect()} == {("10", "9", 1.0), ("x", "9", 1.0)}
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, None)], "k string, t int, v string")
    assert {(r.k, r.v) for r in corpus.newest(rows, ["k"], [F.col("t")]).collect()} == {("a", "new"), ("b", None)}


def test_dense_neighbours_of_all_rows_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.RandomState(1)
    x = np.round(rng.normal(size=(120, 4)), 1)
    x[50:60] = x[0]  # ties
    x[70] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 4), (900, None)], "id long, vec array<double>")
    unit = x / np.where((n := np.sqrt((x * x).sum(1, keepdims=True))) > 0, n, 1)
    s = np.round(unit @ unit.T, 6)
    want = {(i, int(j)) for i in range(120) for j in sorted((j for j in range(120) if j != i), key=lambda j: (-s[i, j], j))[:5]}
    for block in (4096, 32):
        monkeypatch.setattr(geometry, "BLOCK", block)
        got = geometry.dense_neighbours(df, df, 5).collect()
        assert {(r.query, r.neighbour) for r in got} == want and len(got) == len(want)
    assert geometry.dense_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_sparse_neighbours_with_a_hot_term(spark, monkeypatch):
    from larder.operators import terms

    docs = spark.createDataFrame([(f"{i:03d}", ["todo"] * 1 + [f"w{i % 7}", f"x{i % 11}"]) for i in range(60)] + [("999", [])], "key string, tokens array<string>").cache()
    unit = terms.normalized(terms.weights(docs))
    want = sorted(map(tuple, terms.sparse_neighbours(unit, docs, docs).collect()))
    monkeypatch.setattr(terms, "LIST", 4)
    assert sorted(map(tuple, terms.sparse_neighbours(unit, docs, docs).collect())) == want and len(want) == 61 * 5


def test_sparse_neighbours_make_no_row_a_pair(spark, monkeypatch):
    """Common terms made nearly every pair of documents rows of a join; equal to brute force over many blocks, with copies and ties."""
    import numpy as np

    from larder.operators import terms

    monkeypatch.setattr(terms, "LIST", 50)
    monkeypatch.setattr(terms, "QUERIES", 30)
    monkeypatch.setattr(terms, "CROWD", 3)
    rng = np.random.RandomState(3)
    x = np.where(rng.uniform(size=(400, 60)) < np.linspace(0.9, 0.01, 60), rng.uniform(0.1, 1, (400, 60)), 0)
    x[100:140], x[390:] = x[100], 0
    x = np.round(x, 3)
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    s = np.round(unit @ unit.T, 6)
    np.fill_diagonal(s, -1)
    docs = spark.createDataFrame([(i,) for i in range(400)], "key long")
    rows = spark.createDataFrame([(int(i), f"t{j}", float(unit[i, j])) for i, j in zip(*np.nonzero(unit))], "key long, term string, w double")
    queries = docs.where("key % 3 = 0")
    near = terms.sparse_neighbours(rows, queries, docs)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.query, r["rank"]): (r.neighbour, pytest.approx(r.cosine, abs=1e-6)) for r in near.collect()}
    want = {(i, k + 1): (int(j), float(s[i, j])) for i in range(0, 400, 3) for k, j in enumerate(np.lexsort((np.arange(400), -s[i]))[:5])}
    assert got == want


def test_simplified_silhouette(spark):
    rows = [(f"{g}{i}", [1.0 if j == g else 0.01 * i for j in range(3)], g) for g in range(2) for i in range(3)] + [("x", [0.0, 0.0, 5.0], 7)]
    got = {r.id: r.silhouette for r in geometry.simplified_silhouette(spark.createDataFrame(rows, "id string, vec array<double>, label int"), 3).collect()}
    assert got["x"] == 0 and all(v > 0.9 for k, v in got.items() if k != "x")
    one = spark.createDataFrame([("a", [1.0], 1)], "id string, vec array<double>, label int")
    assert geometry.simplified_silhouette(one, 1).first().silhouette == 0


def test_running_index(spark):
    from larder.session import Scratch

    df = spark.createDataFrame([(f"r{i % 17:02d}", i // 17) for i in range(200)], "recipe_id string, position int").repartition(5)
    got = [(r.recipe_id, r.position, r.n) for r in corpus.running_index(df, ["recipe_id", "position"], "n", Scratch(spark)).collect()]
    assert [x[2] for x in sorted(got)] == list(range(200))
