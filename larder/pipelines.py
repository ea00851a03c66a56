"""Analyses from stored tables to run-versioned results, and readers of the latest run."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import lexicons, report, schemas
from larder.functions import text as T
from larder.operators import catalogue, classify, corpus, embedding, geometry, linguistics, terms
from larder.session import Scratch
from larder.sources import html as html_source
from larder.sources.tables import table


def optional(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table, or an empty one of its schema where it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return table(spark, root, name) if there else spark.createDataFrame([], schemas.schema(name))


def related(spark: SparkSession, root: str) -> DataFrame:
    """Named relations of recipes to categories: those stored, and those their origin labels make."""
    recipes, categories, stored = table(spark, root, "recipes"), table(spark, root, "categories"), optional(spark, root, "recipe_categories")
    origins, added = catalogue.origin_relations(recipes, categories, stored)
    return catalogue.named_relations(stored.select("recipe_id", "category_id", "relation_type").unionByName(origins), categories.select("site_category_id", "name").unionByName(added.select("site_category_id", "name")))


def units(spark: SparkSession, root: str) -> DataFrame:
    own = (table(spark, root, t) for t in ("recipes", "ingredients", "preparation_steps"))
    return corpus.text_units(*own, optional(spark, root, "utensils"), related(spark, root))


def record_run(spark: SparkSession, out: str, name: str, run: int, **values) -> DataFrame:
    """Writes the one row of an analysis run, with the time of its creation (UTC)."""
    kinds = {f.name: f.dataType for f in schemas.schema(name)}
    cells = {"created_at": F.current_timestamp()} | {k: F.lit(v) for k, v in values.items()}
    return save(spark.range(1).select(*[cells.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items() if k != "run_id"]), out, name, run)


def titled(rows: DataFrame, recipes: DataFrame, *ids: str) -> DataFrame:
    """``rows`` with the titles of the recipes named in the columns ``ids`` (``key`` gives ``key_title``), unknown ones null."""
    names = recipes.groupBy("site_recipe_id").agg(F.min("title").alias("title"))
    for c in ids:
        rows = rows.join(names.select(F.col("site_recipe_id").alias(c), F.col("title").alias(f"{c}_title")), c, "left")
    return rows


def latest_analysis(spark: SparkSession, root: str, out: str, kind: str) -> dict[str, DataFrame]:
    """The results of the latest run of a kind (``text``, ``embedding``, ``classification``, ``linguistic``), recipes with their titles."""
    runs, parts = RESULTS[kind]
    row = latest(spark, out, runs)
    number = row.first()["run_id"]
    recipes = table(spark, root, "recipes")
    got = {"run": row}
    for name, ids in parts.items():
        got[name] = titled(spark.read.parquet(f"{out}/{name}").where(F.col("run_id") == F.lit(number)), recipes, *ids)
    if kind == "classification":
        got["confusion"] = classify.confusion(got["classification_predictions"].where("split = 'test'"))
    return got


#: The table of runs of each kind of analysis, and its result tables with their columns of recipe ids.
RESULTS = {
    "text": ("text_analysis_runs", {"document_positions": ("id",), "document_similarities": ("query", "neighbour"), "document_top_terms": ("key",)}),
    "embedding": ("embedding_runs", {"word_embeddings": (), "word_contexts": (), "document_embeddings": ("key",), "embedding_similarities": ("query", "neighbour"), "document_top_tokens": ("key",)}),
    "classification": ("classification_runs", {"classification_predictions": ("key",), "classification_metrics": ()}),
    "linguistic": ("linguistic_analysis_runs", {"syntactic_dependencies": ("recipe_id",), "sentiment_analyses": ("recipe_id",), "named_entities": ("recipe_id",), "semantic_relations": ("recipe_id",)}),
}


def search(spark: SparkSession, root: str, out: str, query: str, limit: int = 5) -> DataFrame:
    """``(key, cosine, key_title)``: recipes most similar to a text, by the stored model of the latest embedding run."""
    number = latest(spark, out, "embedding_runs").first()
    of = lambda name: spark.read.parquet(f"{out}/{name}").where(F.col("run_id") == F.lit(number["run_id"]))
    hits = embedding.semantic_search(query, of("document_embeddings"), of("word_embeddings"), number["dimension"], limit)
    return titled(hits, table(spark, root, "recipes"), "key").orderBy(F.col("cosine").desc(), "key")


def save(df: DataFrame, out: str, name: str, run: int) -> DataFrame:
    """Writes a result as one run's partition; a repeated run replaces only itself."""
    path = f"{out}/{name}/run_id={run}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def latest(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of the highest run: a partition filter, so other runs aren't read."""
    rows = spark.read.parquet(f"{out}/{name}")
    top = rows.agg(F.max("run_id")).first()[0]
    return rows.where(F.col("run_id") == F.lit(top))


def prepare(spark: SparkSession, root: str, out: str, run: int = 1) -> dict:
    """Prepared texts, fingerprints and exact duplicates of the catalogue."""
    u = units(spark, root)
    ready = save(corpus.prepare(u, "raw_text").select("recipe_id", "field_name", "position", "prepared.*"), out, "text_preparations", run)
    prints = Scratch(spark).save(corpus.fingerprints(u, table(spark, root, "recipes")))
    dups = save(corpus.exact_duplicates(prints, "recipe_id", "fingerprint"), out, "exact_duplicates", run)
    return {"texts": ready.count(), "duplicates": dups.count()}


def analyze(spark: SparkSession, root: str, out: str, run: int = 1, clusters: int = 0, neighbours: int = 5, width: int = 64) -> dict:
    """TF-IDF weights, leading terms, exact neighbours of every recipe, clusters with their silhouette, 3-D scores.

    Clusters and scores are those of ``width`` random-sign projections of the unit TF-IDF vectors, which
    keep cosines up to about 1 / sqrt(width): the vectors themselves are as wide as the vocabulary.
    """
    docs = Scratch(spark).save(corpus.documents(units(spark, root), table(spark, root, "recipes")).withColumnRenamed("recipe_id", "key"))
    weighted = save(terms.weights(docs), out, "document_term_weights", run)
    save(terms.top_terms(weighted.drop("run_id")), out, "document_top_terms", run)
    unit = Scratch(spark).save(terms.normalized(weighted))
    near = save(terms.sparse_neighbours(unit, docs, docs, neighbours), out, "document_similarities", run)
    signs = unit.select("term").distinct().select("term", *[embedding.sign(F.col("term"), F.lit(i)).alias(f"s{i}") for i in range(width)])
    dense = unit.join(signs, "term").groupBy(F.col("key").alias("id")).agg(*[F.sum(F.col("w") * F.col(f"s{i}")).alias(f"v{i}") for i in range(width)])
    points = Scratch(spark).save(dense.select("id", embedding.unit_array(F.array(*[F.col(f"v{i}") for i in range(width)])).alias("vec")))
    if clusters > 0:
        labels, _ = geometry.kmeans(points, clusters, width, restarts=6, rounds=50)
        k, score = clusters, geometry.mean_silhouette(points, labels, width, points.count())
    else:
        k, labels, score = geometry.select_cluster_count(points, width)
    xyz = geometry.principal_scores(points, width).select("id", *[F.col("scores")[i].alias(c) for i, c in enumerate("xyz")])
    save(labels.join(geometry.perspective(geometry.scaled_axes(xyz, ["x", "y", "z"])), "id"), out, "document_positions", run)
    n, words = docs.count(), weighted.select("term").distinct().count()
    record_run(spark, out, "text_analysis_runs", run, method="tfidf", cluster_count=k, silhouette=score, documents=n, vocabulary=words)
    return {"documents": n, "weights": weighted.count(), "neighbours": near.count(), "clusters": k, "silhouette": score}


def embed(spark: SparkSession, root: str, out: str, run: int = 1, dimension: int = 32, window: int = 2, neighbours: int = 5) -> dict:
    """Word and document embeddings, contexts, exact neighbours of every document, leading tokens."""
    docs = Scratch(spark).save(corpus.documents(units(spark, root), table(spark, root, "recipes")).withColumnRenamed("recipe_id", "key"))
    weighted = Scratch(spark).save(embedding.ppmi(Scratch(spark).save(embedding.cooccurrence(docs, window))))
    words = save(embedding.word_vectors(weighted, dimension), out, "word_embeddings", run)
    save(embedding.top_contexts(weighted), out, "word_contexts", run)
    save(terms.top_tokens(terms.frequencies(docs)), out, "document_top_tokens", run)
    vectors = save(embedding.document_vectors(docs, words, dimension), out, "document_embeddings", run)
    near = save(geometry.dense_neighbours(vectors, vectors, neighbours, "key"), out, "embedding_similarities", run)
    n, vocabulary = vectors.count(), words.count()
    record_run(spark, out, "embedding_runs", run, dimension=dimension, window=window, documents=n, vocabulary=vocabulary)
    return {"words": vocabulary, "documents": n, "neighbours": near.count()}


def classify_texts(spark: SparkSession, root: str, out: str, run: int = 1, target: str = "difficulty", ratio: float = 0.25) -> dict:
    """Naive Bayes on the recipes' tokens; without two classes or a test set the global figures are null."""
    if target not in ("difficulty", "cost"):
        raise ValueError("target must be difficulty or cost")
    column, labels = ("difficulty", lexicons.DIFFICULTIES) if target == "difficulty" else ("cost_label", lexicons.COSTS)
    recipes = table(spark, root, "recipes")
    named = catalogue.normalized_recipes(recipes).where(F.col(column).isin(*labels.values())).select(F.col("site_recipe_id").alias("recipe_id"), F.col(column).alias("label"))
    docs = corpus.documents(units(spark, root), recipes).join(named, "recipe_id").select(F.col("recipe_id").alias("key"), "label", "tokens")
    rows = Scratch(spark).save(classify.stratified_split(docs, ratio))
    state = classify.status(rows)
    if rows.where("split = 'train'").isEmpty():
        raise ValueError("no training documents")
    got = save(rows.select("key", "split", F.col("label").alias("actual")).join(classify.predict(rows, rows.where("split = 'train'")), "key"), out, "classification_predictions", run)
    matrix = classify.confusion(got.where("split = 'test'"))
    save(classify.metrics(matrix), out, "classification_metrics", run)
    figures = classify.summary(matrix).first().asDict() if state == "evaluated" else dict.fromkeys(("accuracy", "precision_macro", "recall_macro", "f1_macro"))
    record_run(spark, out, "classification_runs", run, target=target, status=state, **figures)
    return {"status": state, "documents": rows.count(), **figures}


def annotate(spark: SparkSession, root: str, out: str, run: int = 1) -> dict:
    """Dependencies, sentiment, entities and relations of all text units, exact duplicates included."""
    u = Scratch(spark).save(units(spark, root))
    titles = table(spark, root, "recipes").select(F.col("site_recipe_id").alias("recipe_id"), "title")
    parsed = corpus.running_index(linguistics.parsed_steps(u), ["recipe_id", "position"], "sentence_index", Scratch(spark))
    deps = save(parsed, out, "syntactic_dependencies", run)
    words = u.select("recipe_id", "field_name", "position", T.normalize_lexical(F.col("raw_text")).alias("n")).select("recipe_id", "field_name", "position", T.tokens(F.col("n")).alias("w"))
    moods = save(words.select("recipe_id", "field_name", "position", linguistics.sentiment(F.col("w")).alias("s"), linguistics.aspects(F.col("w")).alias("aspects")), out, "sentiment_analyses", run)
    ents = save(linguistics.entities(u), out, "named_entities", run)
    rels = save(linguistics.relations(u, titles), out, "semantic_relations", run)
    flat = deps.agg(F.sum(F.size("d"))).first()[0]
    record_run(spark, out, "linguistic_analysis_runs", run, version=lexicons.LINGUISTIC_VERSION, sentences=deps.count(), dependencies=flat or 0, entities=ents.count(), relations=rels.count())
    return {"version": lexicons.LINGUISTIC_VERSION, "sentences": deps.count(), "sentiments": moods.count(), "entities": ents.count(), "relations": rels.count()}


def fixture(spark: SparkSession, out: str, run: int, category: tuple[str, str], recipe: tuple[str, str], category_name: str | None = None) -> dict:
    """Reads a saved category page and a saved recipe page, each (file, URL): their listings, record and run row.

    Pages are read whole by Spark's text reader, so they may lie on any file system.
    """
    pages = [spark.read.text(path, wholetext=True).select(F.lit(url).alias("url"), F.col("value").alias("html")) for path, url in (category, recipe)]
    links = save(html_source.links_of(pages[0]), out, "fixture_listings", run)
    record = html_source.recipes_of(pages[1])
    name = F.lit(category_name) if category_name else T.category_name_of_url(F.lit(category[1]))
    record = save(record.withColumn("origin_category", name).withColumn("retrieved_at", F.current_timestamp()), out, "fixture_recipes", run)
    issues = record.agg(F.coalesce(F.sum(F.size("issues")), F.lit(0))).first()[0]
    counts = {"listing_count": links.count(), "recipe_count": record.count(), "error_count": issues}
    status = "partial" if issues else "completed"
    record_run(spark, out, "scrape_runs", run, category_url=category[1], max_pages=1, started_at=datetime.now(UTC), finished_at=datetime.now(UTC), status=status, **counts)
    return {"status": status, **counts}


def export_notebook(spark: SparkSession, root: str, path: str, out: str | None = None) -> None:
    """A notebook of the catalogue: counts, distributions, best rated and repeated recipes, the first recipe, and what analyses ``out`` holds."""
    recipes = table(spark, root, "recipes")
    best = report.rows_of(recipes.orderBy(*catalogue.best_first()).limit(20).select("title", "rating_value", "ratings_count"))
    share = lambda c: report.bars(report.rows_of(catalogue.distribution(recipes, c).orderBy(F.col("count").desc(), "label").limit(50)))
    first = report.rows_of(catalogue.first_recipe(recipes, table(spark, root, "ingredients"), table(spark, root, "preparation_steps"), related(spark, root)))
    again = report.rows_of(catalogue.title_collisions(recipes).orderBy(F.col("count").desc(), "title").limit(50))
    cells = [
        ("markdown", "# Recipes", ""),
        ("text", "count", json.dumps({"recipes": recipes.count()})),
        ("html", "best rated", report.table(best, ["title", "rating_value", "ratings_count"], size=10)),
        ("html", "difficulty", share("difficulty")), ("html", "cost", share("cost_label")), ("html", "origin", share("origin_category")),
        ("html", "repeated titles", report.table(again, ["title", "count"], size=25)),
        *[("html", "first recipe", report.card(r)) for r in first],
    ]
    if out:
        for kind, (runs, _) in RESULTS.items():
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{runs}")
            if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
                continue
            got = latest_analysis(spark, root, out, kind)
            run = report.rows_of(got["run"])
            cells.append(("html", f"{kind} analysis", report.table(run, list(run[0]))))
            if kind == "text":
                spots = report.rows_of(got["document_positions"].orderBy("id").limit(500))
                cells.append(("html", "map of the recipes", report.svg_map(spots)))
            if kind == "classification":
                m = report.rows_of(got["classification_metrics"].orderBy("label"))
                cells.append(("html", "classification by label", report.table(m, ["label", "precision", "recall", "f1", "support"])))
            if kind == "embedding":
                near = report.rows_of(got["embedding_similarities"].where("rank = 1").orderBy(F.col("cosine").desc(), "query").limit(20))
                cells.append(("html", "nearest recipes", report.table(near, ["query_title", "neighbour_title", "cosine"])))
            if kind == "linguistic":
                top = report.rows_of(got["semantic_relations"].groupBy("relation").agg(F.count("*").alias("count")).orderBy("relation"))
                cells.append(("html", "relations", report.table(top, ["relation", "count"])))
    report.write_notebook(path, cells)
