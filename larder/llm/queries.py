"""Queries of this subpackage's operators over the catalogue's tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import clusters, distinctive, near_duplicates, neighbours, packing, personal, survivors, tokenization
from larder.session import Scratch
from larder.sources.tables import table

#: Largest number of capacities, each of which is a plan of its own; more are an error.
MAX_CAPACITIES = 1000
FIELDS = ("rating_value", "description", "prep_time_raw", "difficulty", "cost_label", "servings")


def ingredient_lines(spark: SparkSession, root: str) -> DataFrame:
    """Ingredient lines, those delivered twice once."""
    return table(spark, root, "ingredients").select("recipe_id", "line_position", "raw_text").distinct()


def _survivors(spark: SparkSession, root: str) -> DataFrame:
    recipes = table(spark, root, "recipes")
    groups = survivors.duplicate_groups(recipes, "site_recipe_id", "duplicate_of_recipe_id")
    newest = survivors.instant(F.col("retrieved_at"))
    length = F.length(F.regexp_replace("description", "(?U)^\\s+|\\s+$", ""))
    fields = {
        "rating_value": (F.col("rating_value").isNotNull(), [F.col("ratings_count")]),
        "description": (survivors.known(F.col("description")), [length]),
    } | {f: (survivors.known(F.col(f)), [newest]) for f in ("prep_time_raw", "difficulty", "cost_label")} | {
        "servings": (F.col("servings").isNotNull(), [newest])}
    return survivors.survivors(recipes, groups, "site_recipe_id", fields)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Whose value survives, for each group of duplicate recipes and field."""
    best = _survivors(spark, root)
    rows = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["source"].alias("source_recipe_id")) for f in FIELDS])
    out = best.select(F.col("group").alias("group_recipe_id"), F.explode(rows).alias("x"))
    return out.select("group_recipe_id", "x.field_name", "x.source_recipe_id").where("source_recipe_id IS NOT NULL")


def p3_records(spark: SparkSession, root: str) -> DataFrame:
    """The surviving record of each group."""
    return _survivors(spark, root).select(F.col("group").alias("group_recipe_id"), *[F.col(f)["value"].alias(f) for f in FIELDS])


def recipe_texts(spark: SparkSession, root: str, column: str) -> DataFrame:
    """``(recipe_id, text)``: a column of the recipes and every ingredient line."""
    own = table(spark, root, "recipes").select(F.col("site_recipe_id").alias("recipe_id"), F.col(column).alias("text"))
    return own.unionByName(ingredient_lines(spark, root).select("recipe_id", F.col("raw_text").alias("text")))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of recipes that share four fifths of the words in either."""
    scratch = Scratch(spark)
    sets = scratch.save(near_duplicates.word_sets(recipe_texts(spark, root, "title"), "recipe_id", "text", 12))
    reps, members = near_duplicates.classes(sets)
    members = scratch.save(members)
    pairs = scratch.save(near_duplicates.similar_pairs(reps, Fraction(4, 5)))
    return near_duplicates.expand_pairs(pairs, members).select(F.col("a").alias("recipe_id_a"), F.col("b").alias("recipe_id_b"))


def p5_groups(spark: SparkSession, root: str) -> DataFrame:
    """Every recipe's class of equal word sets, its number of near duplicates and its group."""
    sets = near_duplicates.word_sets(recipe_texts(spark, root, "title"), "recipe_id", "text", 12)
    out = near_duplicates.near_duplicate_groups(sets, Fraction(4, 5))
    return out.select(F.col("record").alias("recipe_id"), F.col("class").alias("class_id"), "links", F.col("group").alias("group_id"))


def _terms(spark: SparkSession, root: str, **how) -> DataFrame:
    # Read by the document frequencies and by the scores: written once, so the texts are split once.
    counts = Scratch(spark).save(distinctive.term_counts(recipe_texts(spark, root, "search_text"), "recipe_id", "text"))
    recipes = table(spark, root, "recipes").select("site_recipe_id")
    return distinctive.leading_terms(distinctive.relevance(counts, recipes, "site_recipe_id", min_df=2, **how), 3)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Each recipe's three most characteristic words, without saturation or length normalisation."""
    return _terms(spark, root, k1=None, plain_idf=True).select(F.col("record").alias("recipe_id"), "term")


def p6_terms(spark: SparkSession, root: str) -> DataFrame:
    """Each recipe's three leading words by probabilistic relevance weighting."""
    return _terms(spark, root).select(F.col("record").alias("recipe_id"), "term", "rank", "tf", "df", "score")


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return tokenization.encode(table(spark, root, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    """The container of every document (piece) for every capacity."""
    capacities = table(spark, root, "pack_capacities").select("capacity_id", "tokenizer", "capacity_tokens").dropna().distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(capacities) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    scratch = Scratch(spark)
    documents = table(spark, root, "documents").select("doc_id", "text")
    sized = {t: scratch.save(tokenization.token_counts(documents, "text", t).select("doc_id", "n_tokens")) for t in sorted({c.tokenizer for c in capacities})}
    parts = [
        packing.pack(sized[c.tokenizer], "doc_id", "n_tokens", c.capacity_tokens).select(
            F.lit(c.capacity_id).alias("capacity_id"), F.col("item").alias("doc_id"), "piece", F.col("start").alias("start_token"),
            F.col("length").alias("n_tokens"), F.col("container").alias("container_id"))
        for c in sorted(capacities, key=lambda c: c.capacity_id)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Places of personal information in every document."""
    documents, names = table(spark, root, "documents").select("doc_id", "text"), table(spark, root, "given_names")
    return personal.found(documents, "doc_id", "text", names, "given_name").withColumnRenamed("doc", "doc_id")


def p9_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every document with personal information replaced by placeholders."""
    documents = table(spark, root, "documents").select("doc_id", "text")
    entities = personal.found(documents, "doc_id", "text", table(spark, root, "given_names"), "given_name")
    return personal.redact(documents, "doc_id", "text", entities).withColumnRenamed("doc", "doc_id")


SPACES = {"embedding": 0.85, "tfidf": 0.60}


def current_vectors(spark: SparkSession, root: str, space: str) -> DataFrame:
    """The usable vectors of the current run of a space."""
    if space == "embedding":
        return neighbours.usable(table(spark, root, "document_embeddings").select("run_id", "recipe_id", "vec"), "run_id", "recipe_id", "vec")
    rows = table(spark, root, "document_vectors").select("run_id", "recipe_id", F.col("term_ids").alias("terms"), "weights")
    return neighbours.usable(rows, "run_id", "recipe_id", "terms", "weights")


def p1_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The five most similar recipes of every recipe in both spaces, at or above the space's limit."""
    parts = [neighbours.neighbours(current_vectors(spark, root, s), 5, limit).select(F.lit(s).alias("space"), F.col("id").alias("recipe_id"), F.col("neighbour").alias("neighbour_id"), "similarity") for s, limit in SPACES.items()]
    return parts[0].unionByName(parts[1])


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of recipes one of which is among the five most similar of the other."""
    a, b = F.col("recipe_id"), F.col("neighbour_id")
    return p1_neighbours(spark, root).select("space", F.least(a, b).alias("recipe_id_a"), F.greatest(a, b).alias("recipe_id_b")).distinct()


def _graph(spark: SparkSession, root: str, graph: Callable[[DataFrame, float], DataFrame]) -> DataFrame:
    """The graphs of both spaces in one table, so that one set of rounds clusters both."""
    parts = [clusters.distances(graph(current_vectors(spark, root, s), limit), limit, s) for s, limit in SPACES.items()]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Members of the clusters of recipes linked at or above the space's limit: the hierarchy's forest cut there."""
    # Distances below the limit change nothing in such a cut, so links that connect what all pairs do are enough.
    found = clusters.flat(_graph(spark, root, neighbours.links))
    space, cluster = clusters.original("cluster")
    return found.select(space.alias("space"), cluster.alias("cluster_recipe_id"), clusters.original("id")[1].alias("recipe_id"))


def p2_clusters(spark: SparkSession, root: str) -> DataFrame:
    """The most stable clusters of similar recipes: size and most typical members."""
    found = clusters.stable(_graph(spark, root, clusters.neighbour_graph))
    space, cluster = clusters.original("cluster")
    return found.select(space.alias("space"), cluster.alias("cluster_recipe_id"), "size", F.array_join(F.transform("exemplars", lambda x: F.substring_index(x, "/", -1)), " ").alias("typical_recipe_ids"))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_clusters, p3_found, p3_records, p5_found, p5_groups, p6_found, p6_terms, p7_ids, p8_containers, p9_found, p9_redacted)}
