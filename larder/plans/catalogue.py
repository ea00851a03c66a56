"""Queries over the recipe catalogue: amounts, filters, facets, summaries, upserts, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.functions.words import folded
from larder.operators import catalogue, corpus, units
from larder.session import Scratch
from larder.sources import html as html_source
from larder.sources.tables import table


def _stated(spark: SparkSession, root: str) -> DataFrame:
    reference = table(spark, root, "unit_reference")
    lines = table(spark, root, "ingredients").select("recipe_id", "line_position", "raw_text").distinct()
    kitchen = units.stated_amounts(lines, "raw_text", reference, "kitchen")
    times = table(spark, root, "recipes").select(F.col("site_recipe_id").alias("recipe_id"), F.lit(0).alias("line_position"), F.col("prep_time_raw").alias("raw_text"))
    durations = units.stated_amounts(times.where("raw_text IS NOT NULL"), "raw_text", reference, "duration")
    return kitchen.withColumn("field_name", F.lit("ingredient")).unionByName(durations.withColumn("field_name", F.lit("prep_time")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Every stated mass, volume and duration in milligrams, microlitres or seconds."""
    return _stated(spark, root).select("recipe_id", "field_name", "line_position", "base_unit", "amount")


def p4_inferred(spark: SparkSession, root: str) -> DataFrame:
    """What every number without a unit is: a unit inferred from the amounts stated of the same thing, or a count of pieces."""
    reference = table(spark, root, "unit_reference")
    known = [(r.unit_code, r.base_unit, float(r.factor_to_base)) for r in reference.select("unit_code", "base_unit", "factor_to_base").dropna().limit(units.MAX_UNITS).collect()]
    scratch = Scratch(spark)
    lines = table(spark, root, "ingredients").select("recipe_id", F.lit("ingredient").alias("field_name"), "line_position", "raw_text").distinct()
    times = table(spark, root, "recipes").select(F.col("site_recipe_id").alias("recipe_id"), F.lit("prep_time").alias("field_name"), F.lit(0).alias("line_position"), F.col("prep_time_raw").alias("raw_text"))
    parts = []
    for rows, kind, codes in ((lines, "kitchen", units.KITCHEN), (times, "duration", units.TIME)):
        read = scratch.save(units.amounts_and_numbers(rows, "raw_text", reference, kind).drop("raw_text"))
        stated = read.where("amount IS NOT NULL").select("subject", "unit", "base_unit", F.col("amount").alias("base_amount"))
        bare = read.where("number IS NOT NULL").select("recipe_id", "field_name", "line_position", "subject", "number")
        candidates = {u: (b, f) for u, b, f in known if u in codes}
        parts.append(units.infer_units(bare, "subject", "number", stated, candidates, counts=kind == "kitchen"))
    return parts[0].unionByName(parts[1])


def url_canonical(spark, root):
    """Listed URLs in canonical form with the recipe they name, and how often each is listed."""
    rows = table(spark, root, "category_listings").select(T.canonical_url(F.col("recipe_url")).alias("url")).groupBy("url").agg(F.count("*").alias("listings"))
    return rows.withColumn("recipe_id", T.recipe_id_of_url(F.col("url")))


def category_urls(spark, root):
    """Category id and name read from every run's URL, and the URL of its second page."""
    runs = table(spark, root, "scrape_runs")
    url = F.col("category_url")
    return runs.select("run_id", T.category_id_of_url(url).alias("category_id"), T.category_name_of_url(url).alias("name"), T.page_url(url, F.lit(2)).alias("page_2"))


def parse_minutes(spark, root):
    """Minutes read by the plain rule from the raw preparation time."""
    return table(spark, root, "recipes").select(F.col("site_recipe_id").alias("recipe_id"), T.parse_minutes(F.col("prep_time_raw")).alias("minutes"))


def parse_numbers(spark, root):
    """First decimal number and digits of every preparation time."""
    c = F.col("prep_time_raw")
    return table(spark, root, "recipes").select(F.col("site_recipe_id").alias("recipe_id"), T.parse_rating(c).alias("rating"), T.parse_localized_number(c).alias("number"))


def labels_normalized(spark, root):
    """Recipes by canonical difficulty and cost."""
    n = catalogue.normalized_recipes(table(spark, root, "recipes"))
    return n.groupBy("difficulty", "cost_label").agg(F.count("*").alias("recipes"))


def changed_cells(spark, root):
    """Cells that cleaning changes, by column of the recipes and by table of the others."""
    before = table(spark, root, "recipes")
    columns = ["title", "prep_time_raw", "difficulty", "cost_label", "url", "description", "origin_category"]
    one = catalogue.changed_cells(before, catalogue.normalized_recipes(before), "site_recipe_id", columns)
    for name, column in (("ingredients", "raw_text"), ("preparation_steps", "raw_text"), ("categories", "name"), ("category_listings", "listed_title")):
        cleaned = F.nullif(T.clean_text(F.col(column)), F.lit(""))
        one = one.crossJoin(F.broadcast(table(spark, root, name).agg(F.sum((~F.equal_null(F.col(column), cleaned)).cast("int")).alias(name))))  # one row
    return one


def display_cells(spark, root):
    return table(spark, root, "recipes").select(F.col("site_recipe_id").alias("recipe_id"), T.display(F.col("rating_value"), "double").alias("rating"), T.display(F.col("cost_label")).alias("cost"))


def search_filter(spark, root):
    """Recipes of a text search with bounds on time and rating."""
    wanted = catalogue.Filter(search="bolos de chocolate", max_time=120, min_rating=3.0)
    return catalogue.search(table(spark, root, "recipes"), table(spark, root, "category_listings"), wanted).select(F.col("site_recipe_id").alias("recipe_id"), "title", "rating_value")


def search_label(spark, root):
    """Recipes of one difficulty and cost, ASCII case ignored."""
    wanted = catalogue.Filter(difficulty=" FACIL", cost_label="custo ALTO ")
    return catalogue.search(table(spark, root, "recipes"), table(spark, root, "category_listings"), wanted).select(F.col("site_recipe_id").alias("recipe_id"))


def exists_or_exists(spark, root):
    """Recipes some run listed in the category 2107, by id or by URL."""
    return catalogue.search(table(spark, root, "recipes"), table(spark, root, "category_listings"), catalogue.Filter(category_id="2107")).select(F.col("site_recipe_id").alias("recipe_id"))


def facet_values(spark, root):
    return catalogue.facets(table(spark, root, "recipes"), table(spark, root, "categories"), table(spark, root, "category_listings"))


def best_rated_page(spark, root):
    """The third page of twenty of the best rated recipes."""
    rows = table(spark, root, "recipes").orderBy(*catalogue.best_first())
    return catalogue.page(rows, 3, 20).select(F.col("site_recipe_id").alias("recipe_id"), "rating_value", "ratings_count")


def notebook_filter(spark, root):
    """Plain substring and equality filter, ordered by title."""
    r = table(spark, root, "recipes").where(F.lower("title").contains("bolo") & (F.col("difficulty") == "Fácil"))
    return r.orderBy(T.ascii_nocase(F.col("title"))).select(F.col("site_recipe_id").alias("recipe_id"), "title")


def recipe_details(spark, root):
    """Every recipe with its ordered lines."""
    d = catalogue.details(table(spark, root, "recipes").select("site_recipe_id", "title"), table(spark, root, "ingredients"), table(spark, root, "preparation_steps"))
    return d.select("recipe_id", F.size("ingredients").alias("n_ingredients"), F.array_join("ingredients", "|").alias("ingredients"), F.array_join("preparation_steps", "|").alias("steps"))


def difficulty_distribution(spark, root):
    return catalogue.distribution(table(spark, root, "recipes"), "difficulty")


def category_distribution(spark, root):
    return catalogue.distribution(table(spark, root, "recipes"), "origin_category")


def title_collisions(spark, root):
    return catalogue.title_collisions(table(spark, root, "recipes"))


def first_recipe(spark, root):
    """The first recipe by title with its ordered lines."""
    first = catalogue.first_recipe(table(spark, root, "recipes"), table(spark, root, "ingredients"), table(spark, root, "preparation_steps"))
    return first.select("recipe_id", "title", F.array_join("ingredients", "|").alias("ingredients"), F.array_join("preparation_steps", "|").alias("steps"))


def coverage_summary(spark, root):
    """Counts and coverage of the catalogue, one row a metric."""
    recipes = table(spark, root, "recipes")
    filled = lambda c: F.count(F.when(F.trim(c) != "", 1))
    one = recipes.agg(
        F.count("*").alias("recipes"), filled("cost_label").alias("with_cost"), filled("origin_category").alias("with_origin"), filled("duplicate_of_recipe_id").alias("marked_duplicates"),
        F.count("prep_time_minutes").alias("with_time"), F.count("rating_value").alias("with_rating"), F.countDistinct("difficulty").alias("difficulty_labels"))
    stacked = one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    ids = recipes.select(F.col("site_recipe_id").alias("recipe_id"))
    counts = [table(spark, root, t).agg(F.count("*").alias("value")).select(F.lit(t).alias("metric"), "value") for t in ("ingredients", "preparation_steps", "categories", "category_listings")]
    counts += [table(spark, root, t).select("recipe_id").distinct().join(ids, "recipe_id", "left_semi").agg(F.count("*").alias("value")).select(F.lit(m).alias("metric"), "value")
               for t, m in (("ingredients", "with_ingredients"), ("preparation_steps", "with_steps"))]
    for c in counts:
        stacked = stacked.unionByName(c)
    return stacked


def latest_run(spark, root):
    """Vectors of the latest run, with their length."""
    rows = corpus.current(table(spark, root, "document_embeddings").where("vec IS NOT NULL")).select("recipe_id", "vec").distinct()
    return rows.select("recipe_id", F.round(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 5).alias("norm"))


def run_counters(spark, root):
    """Listings actually delivered per run beside the recorded counts."""
    got = table(spark, root, "category_listings").groupBy("run_id").agg(F.countDistinct("id").alias("listings"), F.countDistinct("recipe_id").alias("listed_recipes"))
    return table(spark, root, "scrape_runs").select("run_id", "status", "listing_count").join(got, "run_id", "left").fillna(0, ["listings", "listed_recipes"])


def listing_upsert(spark, root):
    """The last delivered listing of each run, category, page and recipe."""
    rows = table(spark, root, "category_listings").select("run_id", "category_id", "page_number", "recipe_id", "id", "loaded_at", "line_position")
    return corpus.newest(rows, ["run_id", "category_id", "page_number", "recipe_id"], [F.col("loaded_at"), F.col("id")])


def listings_by_id_or_url(spark, root):
    """How many categories list each recipe, by id or by URL."""
    pairs = catalogue.listed_recipes(table(spark, root, "recipes"), table(spark, root, "category_listings"))
    return pairs.groupBy(F.col("site_recipe_id").alias("recipe_id")).agg(F.count("*").alias("categories"))


def category_upsert(spark, root):
    """Categories after an upsert of the names read from the runs' URLs."""
    runs = table(spark, root, "scrape_runs").select(T.category_id_of_url(F.col("category_url")).alias("site_category_id"), T.category_name_of_url(F.col("category_url")).alias("name"))
    new = runs.groupBy("site_category_id").agg(F.min("name").alias("name")).withColumn("url", F.lit(None).cast("string"))
    return catalogue.upsert_categories(table(spark, root, "categories").groupBy("site_category_id").agg(F.min("name").alias("name"), F.min("url").alias("url")), new)


def origin_relations(spark, root):
    """Relations of recipes to the categories their origin label names."""
    return catalogue.origin_relations(table(spark, root, "recipes"), table(spark, root, "categories"))[0]


def missing_recipes(spark, root):
    """Listings and pointers whose recipe does not exist, by kind."""
    recipes = table(spark, root, "recipes")
    a = catalogue.orphans(table(spark, root, "category_listings").select("recipe_id"), "recipe_id", recipes, "site_recipe_id").agg(F.count("*").alias("rows")).select(F.lit("listing").alias("kind"), "rows")
    b = catalogue.orphans(recipes.select(F.trim("duplicate_of_recipe_id").alias("d")), "d", recipes, "site_recipe_id").agg(F.count("*").alias("rows")).select(F.lit("pointer").alias("kind"), "rows")
    return a.unionByName(b)


def markup_links(spark, root):
    """Links in documents, by host, and documents that hold them."""
    urls = table(spark, root, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"https?://([A-Za-z0-9.-]+)"), F.lit(1))).alias("host"))
    return urls.groupBy(F.lower("host").alias("host")).agg(F.count("*").alias("links"), F.countDistinct("doc_id").alias("documents"))


def _pages(spark, root):
    """Recipe pages rendered from the catalogue: structured data for title and lists, visible text for the rest."""
    d = catalogue.details(table(spark, root, "recipes").select("site_recipe_id", "title", "url", "servings"), table(spark, root, "ingredients"), table(spark, root, "preparation_steps"))
    data = F.to_json(F.struct(F.lit("Recipe").alias("@type"), F.col("title").alias("name"), F.col("ingredients").alias("recipeIngredient"), F.col("preparation_steps").alias("recipeInstructions"), F.col("servings").cast("string").alias("recipeYield")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">'), F.replace(data, F.lit("</"), F.lit("<\\/")), F.lit("</script></head><body><h1>x</h1><p>Fácil 4,5 / 5 (1.548 avaliações) 25 min Custo médio</p></body></html>"))
    return d.select("url", html.alias("html"))


def parsed_pages(spark, root):
    """Recipes read back from rendered pages."""
    p = html_source.recipes_of(_pages(spark, root))
    return p.select(F.col("site_recipe_id").alias("recipe_id"), "title", "servings", "rating_value", "ratings_count", "prep_time_minutes", "difficulty", F.size("preparation_steps").alias("n_steps"))


def events_hourly(spark, root):
    """Events and their value by hour and type: the batch form of the streaming window."""
    from larder.streaming.windows import hourly

    return hourly(table(spark, root, "events")).select(F.col("window.start").alias("hour"), "event_type", "events", F.round("value", 4).alias("value"))


QUERIES = {f.__name__: f for f in (
    p4_found, p4_inferred, url_canonical, category_urls, parse_minutes, parse_numbers, labels_normalized, changed_cells, display_cells, search_filter, search_label,
    exists_or_exists, facet_values, best_rated_page, notebook_filter, first_recipe, recipe_details, difficulty_distribution, category_distribution, title_collisions,
    coverage_summary, latest_run, run_counters, listing_upsert, listings_by_id_or_url, category_upsert, origin_relations, missing_recipes, markup_links, parsed_pages, events_hourly)}
