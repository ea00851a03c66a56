"""Queries over texts: cleaning, tokens, keys, term weights, neighbours, embeddings, classification, annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import lexicons
from larder.functions import text as T
from larder.operators import classify, corpus, embedding, geometry, linguistics, terms
from larder.session import Scratch
from larder.sources.tables import table

DIMENSION, WINDOW = 32, 2
SEARCH = "sobremesa de chocolate com banana"


def _units(spark: SparkSession, root: str) -> DataFrame:
    return corpus.text_units(table(spark, root, "recipes"), table(spark, root, "ingredients"), table(spark, root, "preparation_steps"))


def _docs(spark: SparkSession, root: str) -> DataFrame:
    """Content tokens of the documents, written once where several branches read them."""
    return Scratch(spark).save(corpus.tokenized(table(spark, root, "documents"), "doc_id", "text"))


def _recipes(spark: SparkSession, root: str) -> DataFrame:
    """Lemmas of all texts of every recipe that is no exact duplicate, written once where several branches read them."""
    return Scratch(spark).save(corpus.documents(_units(spark, root), table(spark, root, "recipes")).select(F.col("recipe_id").alias("key"), "tokens"))


def _words(spark: SparkSession, root: str, name: str, key: str, text: str) -> DataFrame:
    rows = table(spark, root, name).select(F.col(key).alias("key"), T.normalize_lexical(F.col(text)).alias("n"))
    return rows.select("key", T.tokens(F.col("n")).alias("w"))


def text_clean(spark, root):
    """Entities decoded and white space collapsed in every text of the recipes."""
    return _units(spark, root).select("recipe_id", "field_name", "position", T.clean_text(F.col("raw_text")).alias("clean"))


def text_words(spark, root):
    """Word tokens of every document, as one string."""
    return _words(spark, root, "documents", "doc_id", "text").select(F.col("key").alias("doc_id"), F.array_join("w", " ").alias("words"), F.size("w").alias("n_words"))


def stopword_filter(spark, root):
    """Content words of every preparation step."""
    rows = table(spark, root, "preparation_steps").select("recipe_id", "line_position", "raw_text").distinct()
    normal = rows.select("recipe_id", "line_position", T.normalize_lexical(F.col("raw_text")).alias("n"))
    return normal.select("recipe_id", "line_position", F.array_join(T.content_tokens(T.tokens(F.col("n"))), " ").alias("content"))


def stem_lemma(spark, root):
    """Stems and lemmas of every distinct content word of the recipes."""
    rows = _units(spark, root).select(T.normalize_lexical(F.col("raw_text")).alias("n"))
    words = rows.select(F.explode(T.content_tokens(T.tokens(F.col("n")))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"), T.lemma(F.col("word")).alias("lemma"))


def prepare_keys(spark, root):
    """Keys of equal and of nearly equal content, and the sizes of the prepared forms, of every text of the recipes."""
    ready = corpus.prepare(_units(spark, root), "raw_text").select("recipe_id", "field_name", "position", "prepared.*")
    counts = [F.size(c).alias(f"n_{c}") for c in ("tokens", "content_tokens", "stemmed_tokens", "lemma_tokens")]
    return ready.select("recipe_id", "field_name", "position", "duplicate_key", "near_duplicate_key", *counts, F.col("pipeline_version").alias("version"))


def search_index(spark, root):
    """The distinct search words of every text of the recipes, sorted."""
    ready = corpus.prepare(_units(spark, root), "raw_text")
    return ready.select("recipe_id", "field_name", "position", F.array_join(F.array_sort(F.split(T.search_index_text(F.col("prepared")), " ")), " ").alias("words"))


def search_texts(spark, root):
    """The search words of every recipe over all its texts, sorted."""
    return corpus.search_texts(_units(spark, root), table(spark, root, "recipes"))


def near_dup_groups(spark, root):
    """Groups of documents with the same set of content words."""
    docs = corpus.tokenized(table(spark, root, "documents"), "doc_id", "text").where(F.size("tokens") > 0)
    keyed = docs.select("key", F.sha2(F.array_join(F.array_sort(F.array_distinct("tokens")), " "), 256).alias("near_key"))
    return keyed.groupBy("near_key").agg(F.count("*").alias("copies"), F.min("key").alias("first_doc")).where("copies > 1")


def exact_dup_groups(spark, root):
    """Exact duplicates by the fingerprint of title, ingredients and steps, with their canonical recipe."""
    prints = corpus.fingerprints(_units(spark, root), table(spark, root, "recipes"))
    return corpus.exact_duplicates(prints, "recipe_id", "fingerprint").select(F.col("record").alias("recipe_id"), "canonical", "similarity")


def document_copies(spark, root):
    """Documents whose text another one has, with the smallest such document."""
    keyed = table(spark, root, "documents").where("text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("text", 256).alias("k"))
    return corpus.exact_duplicates(keyed, "doc_id", "k").select(F.col("record").alias("doc_id"), "canonical")


def tfidf_vocabulary(spark, root):
    """Document frequency and inverse document frequency of every word of the documents."""
    docs = _docs(spark, root)
    return terms.idf(terms.frequencies(docs), docs).select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark, root):
    """All TF-IDF weights of the documents."""
    return terms.weights(_docs(spark, root)).select(F.col("key").alias("doc_id"), "term", "tf", F.round("tfidf", 6).alias("tfidf"))


def tfidf_top_terms(spark, root):
    """The eight leading terms of every document."""
    return terms.top_terms(terms.weights(_docs(spark, root))).select(F.col("key").alias("doc_id"), "term", "tf", F.round("tfidf", 6).alias("tfidf"), "rank")


def doc_norms(spark, root):
    return terms.norms(terms.weights(_docs(spark, root))).select(F.col("key").alias("doc_id"), F.round("norm", 6).alias("norm"))


def top_tokens(spark, root):
    """The eight most frequent words of every document."""
    return terms.top_tokens(terms.frequencies(_docs(spark, root))).select(F.col("key").alias("doc_id"), "term", "tf", "rank")


def recipe_tfidf_top_terms(spark, root):
    """Leading terms of every recipe that is no exact duplicate, over all its text units."""
    return terms.top_terms(terms.weights(_recipes(spark, root))).select(F.col("key").alias("recipe_id"), "term", "tf", F.round("tfidf", 6).alias("tfidf"), "rank")


def cosine_knn_sparse(spark, root):
    """Exact TF-IDF neighbours of every fiftieth recipe among all recipes."""
    docs = _recipes(spark, root)
    unit = Scratch(spark).save(terms.normalized(terms.weights(docs)))
    queries = docs.where(F.pmod(F.col("key").cast("long"), F.lit(50)) == 0)
    return terms.sparse_neighbours(unit, queries, docs).select(F.col("query").alias("recipe_id"), F.col("neighbour").alias("neighbour_id"), "cosine", "rank")


def cosine_knn_dense(spark, root):
    """Exact cosine neighbours of every fiftieth vector among all vectors."""
    vectors = table(spark, root, "embeddings")
    near = geometry.dense_neighbours(vectors, vectors.where("vec_id % 50 = 0"), 5, "vec_id", "embedding")
    return near.select(F.col("query").alias("vec_id"), F.col("neighbour").alias("neighbour_id"), "cosine", "rank")


def cooccurrence(spark, root):
    """Weighted co-occurrence of content words within two positions in the recipes."""
    return embedding.cooccurrence(_recipes(spark, root), WINDOW)


def ppmi(spark, root):
    pairs = Scratch(spark).save(embedding.cooccurrence(_recipes(spark, root), WINDOW))
    return embedding.ppmi(pairs).select("term", "context", F.round("ppmi", 6).alias("ppmi"))


def top_contexts(spark, root):
    """The eight strongest contexts of every word of the recipes."""
    pairs = Scratch(spark).save(embedding.cooccurrence(_recipes(spark, root), WINDOW))
    return embedding.top_contexts(embedding.ppmi(pairs)).select("term", "context", F.round("ppmi", 6).alias("ppmi"), "rank")


def hash_signs(spark, root):
    """Pseudo-random signs of every word of the recipes in all dimensions."""
    words = _recipes(spark, root).select(F.explode("tokens").alias("term")).distinct()
    return words.select("term", F.explode(F.sequence(F.lit(0), F.lit(DIMENSION - 1))).alias("i")).select("term", "i", embedding.sign(F.col("term"), F.col("i")).alias("sign"))


def _word_vectors(spark, root, docs):
    pairs = Scratch(spark).save(embedding.cooccurrence(docs, WINDOW))
    weighted = Scratch(spark).save(embedding.ppmi(pairs))
    return Scratch(spark).save(embedding.word_vectors(weighted, DIMENSION))


def word_vectors(spark, root):
    """Projected context vectors of the words of the recipes, a row per coordinate."""
    return _word_vectors(spark, root, _recipes(spark, root)).select("term", F.posexplode("vec").alias("i", "v")).select("term", "i", (F.round("v", 5) + 0.0).alias("v"))


def document_embeddings(spark, root):
    """Mean word vectors of the recipes, a row per coordinate."""
    docs = _recipes(spark, root)
    got = embedding.document_vectors(docs, _word_vectors(spark, root, docs), DIMENSION)
    return got.select(F.col("key").alias("recipe_id"), F.posexplode("vec").alias("i", "v")).select("recipe_id", "i", (F.round("v", 5) + 0.0).alias("v"))


def semantic_search(spark, root):
    """The ten recipes most similar to a query text."""
    docs = _recipes(spark, root)
    vectors = _word_vectors(spark, root, docs)
    hits = embedding.semantic_search(SEARCH, embedding.document_vectors(docs, vectors, DIMENSION), vectors, DIMENSION, 10)
    return hits.select(F.col("key").alias("recipe_id"), "cosine")


def contextual_vectors(spark, root):
    """Vectors of every occurrence of a word in the recipes: first and last coordinate."""
    docs = _recipes(spark, root)
    got = embedding.contextual(docs, _word_vectors(spark, root, docs), DIMENSION, WINDOW)
    return got.select(F.col("key").alias("recipe_id"), "pos", "term", *[(F.round(F.col("vec")[i], 4) + 0.0).alias(f"v{i}") for i in (0, DIMENSION - 1)])


def _labeled(spark, root):
    """The recipes with their normalised difficulty."""
    rows = table(spark, root, "recipes").select(F.col("site_recipe_id").alias("key"), T.normalize_text(F.col("difficulty")).alias("d"))
    label = F.element_at(T.literal_map(lexicons.DIFFICULTIES), F.col("d"))
    known = rows.where(F.col("d").isin(*lexicons.DIFFICULTIES)).select("key", label.alias("label"))
    return Scratch(spark).save(classify.stratified_split(_recipes(spark, root).join(known, "key").select("key", "label", "tokens")))


def stratified_split(spark, root):
    return _labeled(spark, root).select(F.col("key").alias("recipe_id"), "label", "split")


def nb_priors(spark, root):
    train = _labeled(spark, root).where("split = 'train'")
    return classify.priors(train).select("label", "documents", F.round("log_prior", 6).alias("log_prior"))


def nb_likelihoods(spark, root):
    train = _labeled(spark, root).where("split = 'train'")
    return classify.likelihoods(train).select("label", "term", "count", F.round("log_likelihood", 6).alias("log_likelihood"))


def _predicted(spark, root):
    rows = _labeled(spark, root)
    test = rows.where("split = 'test'")
    got = classify.predict(test, rows.where("split = 'train'"))
    return Scratch(spark).save(test.select("key", F.col("label").alias("actual")).join(got, "key"))


def nb_predict(spark, root):
    """Predicted difficulty of the test recipes."""
    return _predicted(spark, root).select(F.col("key").alias("recipe_id"), "actual", "predicted", F.round("confidence", 4).alias("confidence"))


def nb_confusion(spark, root):
    return classify.confusion(_predicted(spark, root))


def nb_metrics(spark, root):
    m = classify.metrics(classify.confusion(_predicted(spark, root)))
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def nb_summary(spark, root):
    s = classify.summary(classify.confusion(_predicted(spark, root)))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def _steps(spark, root):
    return corpus.lines(table(spark, root, "preparation_steps"), "preparation_step")


def dependency_parse(spark, root):
    """Shallow dependencies of every preparation step."""
    parsed = linguistics.parsed_steps(_steps(spark, root))
    return parsed.select("recipe_id", "position", F.explode("d").alias("t")).select("recipe_id", "position", "t.token_index", "t.token", "t.lemma", "t.head_index", "t.relation")


def dependency_counts(spark, root):
    parsed = linguistics.parsed_steps(_steps(spark, root))
    return parsed.select(F.explode("d").alias("t")).groupBy("t.relation").agg(F.count("*").alias("count"))


#: Polarity of words that occur in the documents, beside the default lexicon.
CORPUS_POLARITY = lexicons.POLARITY | {"otimo": 1.7, "delicia": 1.5, "fofinho": 1.0, "dourado": 0.8, "cremoso": 1.0, "pesado": -1.0, "graca": 0.5}


def _sentiment(spark, root):
    words = _words(spark, root, "documents", "doc_id", "text")
    return words.select("key", "w", linguistics.sentiment(F.col("w"), CORPUS_POLARITY).alias("s"))


def sentiment(spark, root):
    """Lexicon sentiment of every document."""
    return _sentiment(spark, root).select(F.col("key").alias("doc_id"), "s.polarity", F.round("s.score", 6).alias("score"), F.round("s.subjectivity", 6).alias("subjectivity"), F.size("s.evidence").alias("n_evidence"))


def sentiment_aspects(spark, root):
    """Documents by aspect and polarity."""
    rows = _sentiment(spark, root).select(F.explode(linguistics.aspects(F.col("w"))).alias("aspect"), "s.polarity")
    return rows.groupBy("aspect", "polarity").agg(F.count("*").alias("documents"))


def entities_regex(spark, root):
    """Quantities, units, durations and temperatures in preparation steps, by type and text."""
    steps = _steps(spark, root).select("raw_text")
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), linguistics.entity_texts(F.col("raw_text"), k).alias("m")) for k in lexicons.ENTITY_PATTERNS])
    flat = steps.select(F.explode(kinds).alias("x")).select(F.col("x.k").alias("entity_type"), F.explode("x.m").alias("text"))
    return flat.groupBy("entity_type", "text").agg(F.count("*").alias("count"))


def entities(spark, root):
    """Entities with offsets of every text of the recipes."""
    return linguistics.entities(_units(spark, root))


def relations(spark, root):
    """Triples of recipes, ingredients and actions."""
    titles = table(spark, root, "recipes").select(F.col("site_recipe_id").alias("recipe_id"), "title")
    return linguistics.relations(_units(spark, root), titles)


def action_relations(spark, root):
    """Verb and object of every preparation step that has both."""
    parsed = linguistics.parsed_steps(_steps(spark, root))
    pick = lambda r: F.get(F.filter("d", lambda x: x["relation"] == r), F.lit(0))["lemma"]
    return parsed.select("recipe_id", "position", pick("root").alias("subject"), pick("obj").alias("object")).where("object IS NOT NULL")


def linguistic_counts(spark, root):
    """Sentences, dependencies and relations of the steps, as one row."""
    parsed = Scratch(spark).save(linguistics.parsed_steps(_steps(spark, root)))
    one = parsed.agg(F.count("*").alias("sentences"), F.sum(F.size("d")).alias("dependencies"), F.sum(F.exists("d", lambda x: x["relation"] == "obj").cast("int")).alias("with_object"))
    return one


def _points(spark, root):
    v = table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    return v.select("id", embedding.unit_array(F.col("v")).alias("vec"), "label")


def silhouette(spark, root):
    """Silhouette of every vector under its given label."""
    s = geometry.silhouette(_points(spark, root))
    return s.select(F.col("id").alias("vec_id"), F.round("silhouette", 5).alias("silhouette"))


def lloyd_step(spark, root):
    """One round of k-means from the labels' means: sizes and coordinates."""
    pts = Scratch(spark).save(_points(spark, root))
    start = geometry._centres(pts, "label", 64)
    got = geometry.lloyd_step(pts, start, 64)
    return got.select("label", "size", F.posexplode("centre").alias("i", "c")).select("label", "size", "i", (F.round("c", 6) + 0.0).alias("c"))


def kmeans(spark, root):
    """k-means with four clusters: sizes."""
    labels, _ = geometry.kmeans(_points(spark, root), 4, 64, restarts=6, rounds=50)
    return labels.groupBy("label").agg(F.count("*").alias("size"))


def principal_scores(spark, root):
    """Coordinates of every vector on three principal components, scaled to [-1, 1] and projected for display."""
    s = geometry.principal_scores(_points(spark, root), 64)
    xyz = s.select("id", *[F.col("scores")[i].alias(c) for i, c in enumerate("xyz")])
    return geometry.perspective(geometry.scaled_axes(xyz, ["x", "y", "z"]))


def vector_means(spark, root):
    """Squared distance of every vector to its label's mean."""
    pts = Scratch(spark).save(_points(spark, root))
    joined = pts.join(geometry._centres(pts, "label", 64), "label")
    d = F.aggregate(F.zip_with("vec", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return joined.select(F.col("id").alias("vec_id"), "label", F.round(d, 6).alias("distance2"))


QUERIES = {f.__name__: f for f in (
    text_clean, text_words, stopword_filter, stem_lemma, prepare_keys, search_index, search_texts, near_dup_groups, exact_dup_groups, document_copies,
    tfidf_vocabulary, tfidf_weights, tfidf_top_terms, doc_norms, top_tokens, recipe_tfidf_top_terms, cosine_knn_sparse, cosine_knn_dense,
    cooccurrence, ppmi, top_contexts, hash_signs, word_vectors, document_embeddings, semantic_search, contextual_vectors,
    stratified_split, nb_priors, nb_likelihoods, nb_predict, nb_confusion, nb_metrics, nb_summary,
    dependency_parse, dependency_counts, sentiment, sentiment_aspects, entities_regex, entities, relations, action_relations, linguistic_counts,
    silhouette, lloyd_step, kmeans, principal_scores, vector_means)}
