"""Schemas of the stored tables, and reading of tables that lack later columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Columns by table.
TABLES = {
    "scrape_runs": "run_id long, category_url string, max_pages int, user_agent string, parser_version string, started_at timestamp, finished_at timestamp, status string, listing_count int, recipe_count int, error_count int",
    "categories": "site_category_id string, name string, url string",
    "recipes": "site_recipe_id string, title string, url string, rating_value double, ratings_count int, prep_time_minutes int, prep_time_raw string, difficulty string, cost_label string, servings int, description string, origin_category string, search_text string, content_fingerprint string, duplicate_of_recipe_id string, duplicate_similarity double, retrieved_at string, parser_version string",
    "ingredients": "id long, recipe_id string, line_position int, raw_text string",
    "utensils": "id long, recipe_id string, line_position int, name string",
    "preparation_steps": "id long, recipe_id string, line_position int, raw_text string",
    "recipe_categories": "recipe_id string, category_id string, relation_type string",
    "category_listings": "id long, run_id long, category_id string, recipe_id string, recipe_url string, listed_title string, page_number int, line_position int, listed_at timestamp, loaded_at timestamp",
    "text_preparations": "recipe_id string, field_name string, position int, raw_text string, normalized_text string, tokens array<string>, content_tokens array<string>, stemmed_tokens array<string>, lemma_tokens array<string>, duplicate_key string, near_duplicate_key string, pipeline_version string, transformations array<string>",
    "document_vectors": "run_id long, recipe_id string, term_ids array<int>, weights array<float>, norm double",
    "document_term_weights": "run_id long, recipe_id string, term string, tf long, idf double, tfidf double",
    "document_similarities": "run_id long, recipe_id string, neighbor_id string, cosine double, rank int",
    "word_embeddings": "run_id long, term string, vec array<double>",
    "document_embeddings": "run_id long, recipe_id string, vec array<float>, norm double",
    "embedding_similarities": "run_id long, recipe_id string, neighbor_id string, cosine double, rank int",
    "classification_predictions": "run_id long, recipe_id string, split string, actual string, predicted string, confidence double",
    "classification_metrics": "run_id long, label string, precision double, recall double, f1 double, support long",
    "syntactic_dependencies": "run_id long, recipe_id string, sentence_index long, token_index int, token string, lemma string, head_index int, relation string",
    "sentiment_analyses": "run_id long, recipe_id string, field_name string, position int, polarity string, score double, subjectivity double, aspects array<string>",
    "named_entities": "run_id long, recipe_id string, field_name string, position int, start_char int, end_char int, text string, entity_type string, normalized_value string, bio_tag string, method string",
    "semantic_relations": "run_id long, recipe_id string, subject string, relation string, object string, field_name string, position int, confidence double, method string",
    "text_analysis_runs": "run_id long, created_at timestamp, method string, cluster_count int, silhouette double, documents long, vocabulary long",
    "embedding_runs": "run_id long, created_at timestamp, dimension int, window int, documents long, vocabulary long",
    "classification_runs": "run_id long, created_at timestamp, target string, status string, accuracy double, precision_macro double, recall_macro double, f1_macro double",
    "linguistic_analysis_runs": "run_id long, created_at timestamp, version string, sentences long, dependencies long, entities long, relations long",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def create_empty(spark: SparkSession, root: str) -> None:
    """Writes every table that does not exist yet, empty; existing ones are left alone."""
    for name in TABLES:
        spark.createDataFrame([], schema(name)).write.mode("ignore").parquet(f"{root}/{name}.parquet")


def migrated(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of the table: missing ones are null, types are cast, others dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])


def json_list(column):
    """A stored JSON list of strings as an array: unreadable text and what is no list give an empty array, empty items are dropped."""
    return F.filter(F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
