"""Filtering, facets, details, summaries and upserts of the catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators.corpus import newest


@dataclass(frozen=True)
class Filter:
    """A search over recipes; what is empty or None does not filter."""

    search: str = ""
    difficulty: str = ""
    cost_label: str = ""
    max_time: int | None = None
    min_rating: float | None = None
    category_id: str = ""


def listed_recipes(recipes: DataFrame, listings: DataFrame) -> DataFrame:
    """``(site_recipe_id, category_id)`` pairs of recipes and the categories that list them, by id or by URL.

    The disjunctive condition is two equi-joins and a union: neither is a nested loop.
    """
    seen = listings.select("category_id", F.col("recipe_id").alias("k")).where("k IS NOT NULL AND category_id IS NOT NULL").distinct()
    by_id = recipes.select("site_recipe_id", F.col("site_recipe_id").alias("k")).join(seen, "k")
    by_url = recipes.select("site_recipe_id", F.col("url").alias("k")).join(seen, "k")
    return by_id.select("site_recipe_id", "category_id").unionByName(by_url.select("site_recipe_id", "category_id")).distinct()


def search(recipes: DataFrame, listings: DataFrame, wanted: Filter, relations: DataFrame | None = None) -> DataFrame:
    """The recipes a filter selects, best rated first, then most rated, nulls last, then by title."""
    out = recipes
    if wanted.search.strip():
        for term in T.search_terms(wanted.search):
            out = out.where(F.contains(T.ascii_nocase(F.col("search_text")), F.lit(term)))
    for column, value in (("difficulty", wanted.difficulty), ("cost_label", wanted.cost_label)):
        if value.strip():
            out = out.where(T.ascii_nocase(F.trim(F.col(column))) == T.ascii_nocase(F.lit(value.strip())))
    if wanted.max_time is not None:
        out = out.where(F.col("prep_time_minutes") <= wanted.max_time)
    if wanted.min_rating is not None:
        out = out.where(F.col("rating_value") >= wanted.min_rating)
    if wanted.category_id.strip():
        category = wanted.category_id.strip()
        hits = listed_recipes(out.select("site_recipe_id", "url"), listings.where(F.col("category_id") == category)).select("site_recipe_id")
        if relations is not None:
            hits = hits.unionByName(relations.where(F.col("category_id") == category).select(F.col("recipe_id").alias("site_recipe_id"))).distinct()
        out = out.join(hits, "site_recipe_id", "left_semi")
    return out.orderBy(*best_first())


def best_first() -> list[Column]:
    return [F.col("rating_value").desc_nulls_last(), F.col("ratings_count").desc_nulls_last(), T.ascii_nocase(F.col("title")), F.col("site_recipe_id")]


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page of ordered rows; page and size are at least 1."""
    return rows.offset((max(1, number) - 1) * max(1, size)).limit(max(1, size))


def facets(recipes: DataFrame, categories: DataFrame, listings: DataFrame) -> DataFrame:
    """``(facet, value, label)``: distinct trimmed difficulties and costs, and categories some recipe is listed in."""
    of = lambda c: recipes.select(F.lit(c).alias("facet"), F.trim(c).alias("value")).where("value <> ''").distinct().withColumn("label", F.col("value"))
    used = listed_recipes(recipes.select("site_recipe_id", "url"), listings).select("category_id").distinct()
    named = categories.where("trim(name) <> ''").join(used, categories["site_category_id"] == used["category_id"], "left_semi")
    return of("difficulty").unionByName(of("cost_label")).unionByName(named.select(F.lit("category").alias("facet"), F.col("site_category_id").alias("value"), F.col("name").alias("label")))


def details(recipes: DataFrame, ingredients: DataFrame, steps: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Recipes with ordered arrays of their lines and categories, for one or for all."""
    def ordered(rows: DataFrame, text: str, order: Column, name: str) -> DataFrame:
        pairs = rows.select("recipe_id", order.alias("o"), F.col(text).alias("t")).distinct()
        return pairs.groupBy("recipe_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]).alias(name))

    out = recipes.withColumnRenamed("site_recipe_id", "recipe_id")
    out = out.join(ordered(ingredients, "raw_text", F.col("line_position"), "ingredients"), "recipe_id", "left")
    out = out.join(ordered(steps, "raw_text", F.col("line_position"), "preparation_steps"), "recipe_id", "left")
    if related is not None:
        out = out.join(ordered(related, "name", T.ascii_nocase(F.col("name")), "related_categories"), "recipe_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("ingredients", "preparation_steps", "related_categories") if c in out.columns})


def first_recipe(recipes: DataFrame, ingredients: DataFrame, steps: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """The details of the first recipe by title (ASCII case ignored, then id); no recipes give no row."""
    first = recipes.orderBy(T.ascii_nocase(F.col("title")), "site_recipe_id").limit(1)
    return details(first, *[t.join(F.broadcast(first.select(F.col("site_recipe_id").alias("recipe_id"))), "recipe_id", "left_semi") for t in (ingredients, steps)], related)  # one row


def named_relations(relations: DataFrame, categories: DataFrame) -> DataFrame:
    """``(recipe_id, category_id, relation_type, name)``: relations with their categories' names, smallest first per id."""
    names = categories.groupBy(F.col("site_category_id").alias("category_id")).agg(F.min("name").alias("name"))
    return relations.join(names, "category_id").select("recipe_id", "category_id", "relation_type", "name")


def save_recipes(store: dict[str, DataFrame], records: DataFrame) -> dict[str, DataFrame]:
    """The tables ``recipes, ingredients, utensils, preparation_steps, recipe_categories, categories`` after an upsert of ``records``.

    ``records`` are recipes as ``sources.html.recipes_of`` gives them with ``retrieved_at``. A recipe's latest
    record counts; its cells replace the stored ones, null cells keeping what is stored, and its lines and
    page relations replace those stored. An older record than the stored one changes nothing.
    """
    new = newest(records.withColumn("site_recipe_id", F.col("site_recipe_id")), ["site_recipe_id"], [F.col("retrieved_at")])
    known = store["recipes"].select(F.col("site_recipe_id").alias("_id"), F.col("retrieved_at").alias("_at"))
    new = new.join(known, F.col("site_recipe_id") == F.col("_id"), "left").where(F.col("_at").isNull() | (F.col("retrieved_at") >= F.col("_at"))).drop("_id", "_at")
    ids = new.select(F.col("site_recipe_id").alias("recipe_id"))
    r, n = store["recipes"].alias("r"), new.alias("n")
    joined = r.join(n, F.col("r.site_recipe_id") == F.col("n.site_recipe_id"), "full")
    cells = [F.coalesce(F.col(f"n.{c}"), F.col(f"r.{c}")).cast(t).alias(c) if c in new.columns else F.col(f"r.{c}") for c, t in store["recipes"].dtypes]
    out = {"recipes": joined.select(*cells)}
    for name, text in (("ingredients", "raw_text"), ("utensils", "name"), ("preparation_steps", "raw_text")):
        lines = new.select(F.col("site_recipe_id").alias("recipe_id"), F.posexplode(name).alias("_p", text)).select("recipe_id", (F.col("_p") + 1).alias("line_position"), text)
        out[name] = store[name].join(ids, "recipe_id", "left_anti").unionByName(lines, allowMissingColumns=True)
    flat = new.select(F.col("site_recipe_id").alias("recipe_id"), F.explode("related_categories").alias("c"))
    shown = flat.select("recipe_id", F.col("c.site_category_id").alias("category_id"), F.lit("related").alias("relation_type")).distinct()
    kept = store["recipe_categories"].join(ids.withColumn("relation_type", F.lit("related")), ["recipe_id", "relation_type"], "left_anti")
    out["recipe_categories"] = kept.unionByName(shown)
    added = flat.select("c.site_category_id", "c.name", "c.url").groupBy("site_category_id").agg(F.min("name").alias("name"), F.min("url").alias("url"))
    out["categories"] = upsert_categories(store["categories"], added)
    return out


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(T.label_or_default(F.col(column)).alias("label")).agg(F.count("*").alias("count"))


def title_collisions(recipes: DataFrame) -> DataFrame:
    """Titles, ASCII case ignored, that more than one recipe has."""
    return recipes.groupBy(T.ascii_nocase(F.col("title")).alias("title")).agg(F.count("*").alias("count")).where("count > 1")


def upsert_categories(known: DataFrame, new: DataFrame) -> DataFrame:
    """Categories with the names of ``new``; a known url is kept where the new one is null."""
    k, n = known.alias("k"), new.alias("n")
    joined = k.join(n, F.col("k.site_category_id") == F.col("n.site_category_id"), "full")
    return joined.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"k.{c}")).alias(c) for c in ("site_category_id", "name", "url")])


def origin_relations(recipes: DataFrame, categories: DataFrame, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Origin labels as relations ``(recipe_id, category_id, relation_type)`` and the categories this adds.

    A label is matched to a category by its folded name (the last of equal names by id), else it
    makes the category ``origin:<slug>``, named by its smallest spelling. A recipe related to the
    category in any way already gets no second relation.
    """
    labels = recipes.where("trim(origin_category) <> ''").select(F.col("site_recipe_id").alias("recipe_id"), T.clean_text(F.col("origin_category")).alias("name"))
    labels = labels.withColumn("key", T.normalize_text(F.col("name")))
    known = categories.select(T.normalize_text(F.col("name")).alias("key"), "site_category_id").groupBy("key").agg(F.max("site_category_id").alias("id"))
    joined = labels.join(known, "key", "left")
    slug = F.when(F.col("key") == "", "sem-nome").otherwise(F.replace(F.col("key"), F.lit(" "), F.lit("-")))
    made = joined.select("recipe_id", "name", F.coalesce("id", F.concat(F.lit("origin:"), slug)).alias("category_id"), F.col("id").isNull().alias("new"))
    added = made.where("new").groupBy(F.col("category_id").alias("site_category_id")).agg(F.min("name").alias("name")).withColumn("url", F.lit(None).cast("string"))
    out = made.select("recipe_id", "category_id").distinct()
    if relations is not None:
        out = out.join(relations.select("recipe_id", "category_id"), ["recipe_id", "category_id"], "left_anti")
    return out.withColumn("relation_type", F.lit("origin")), added


def normalized_recipes(recipes: DataFrame) -> DataFrame:
    """Recipes with cleaned cells, canonical labels and URL; blank optional cells become null."""
    rest = [c for c in recipes.columns if c not in ("title", "url", "prep_time_raw", "difficulty", "cost_label", "description", "origin_category")]
    clean = {c: T.clean_text(F.col(c)) for c in ("title", "prep_time_raw", "difficulty", "cost_label", "description", "origin_category")}
    first = recipes.select(*rest, T.canonical_url(F.col("url")).alias("url"), *[v.alias(c) for c, v in clean.items()],
                           T.normalize_text(F.col("difficulty")).alias("_d"), T.normalize_text(F.col("cost_label")).alias("_c"))
    none = lambda c: F.nullif(c, F.lit(""))
    return first.select(*rest, "title", "url", none(F.col("prep_time_raw")).alias("prep_time_raw"),
                        none(T.normalize_label(F.col("difficulty"), F.col("_d"), T.lexicons.DIFFICULTIES, True)).alias("difficulty"),
                        none(T.normalize_label(F.col("cost_label"), F.col("_c"), T.lexicons.COSTS, False)).alias("cost_label"),
                        none(F.col("description")).alias("description"), none(F.col("origin_category")).alias("origin_category"))


def changed_cells(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: how many cells of each column differ."""
    b, a = before.alias("b"), after.alias("a")
    joined = b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}"))
    return joined.agg(*[F.sum((~F.equal_null(F.col(f"b.{c}"), F.col(f"a.{c}"))).cast("int")).alias(c) for c in columns])


def orphans(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose parent does not exist: the check of a foreign key."""
    ids = parents.select(F.col(parent_key).alias(child_key)).where(F.col(child_key).isNotNull()).distinct()
    return children.where(F.col(child_key).isNotNull()).join(ids, child_key, "left_anti")
