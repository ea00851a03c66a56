"""Text units of records, prepared texts, documents and exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import text as T


def lines(rows: DataFrame, field: str) -> DataFrame:
    """Child lines as text units; lines delivered twice count once, null texts not at all."""
    return rows.select("recipe_id", F.lit(field).alias("field_name"), F.col("line_position").alias("position"), "raw_text").where("raw_text IS NOT NULL AND recipe_id IS NOT NULL").distinct()


def text_units(recipes: DataFrame, ingredients: DataFrame, steps: DataFrame, utensils: DataFrame | None = None, related: DataFrame | None = None) -> DataFrame:
    """``(recipe_id, field_name, position, raw_text)``: title, description if there is one, ingredients, steps, and utensils (name) and related categories (recipe_id, name) where given."""
    own = lambda c: recipes.select(F.col("site_recipe_id").alias("recipe_id"), F.lit(c).alias("field_name"), F.lit(0).alias("position"), F.col(c).alias("raw_text"))
    out = (
        own("title").where("raw_text IS NOT NULL")
        .unionByName(own("description").where("raw_text <> ''"))
        .unionByName(lines(ingredients, "ingredient"))
        .unionByName(lines(steps, "preparation_step"))
    )
    if utensils is not None:
        out = out.unionByName(lines(utensils.withColumnRenamed("name", "raw_text"), "utensil"))
    if related is not None:
        # Numbered by name within a recipe, which has a few categories.
        names = numbered(related.where("recipe_id IS NOT NULL AND name IS NOT NULL").select("recipe_id", "name").distinct(), "recipe_id", [T.ascii_nocase(F.col("name")), F.col("name")])
        out = out.unionByName(names.select("recipe_id", F.lit("related_category").alias("field_name"), "position", F.col("name").alias("raw_text")))
    return out


def prepare(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the struct ``prepared``; the text passes through Python once."""
    own = [c for c in rows.columns if c not in ("prepared", "_normal")]
    normal = rows.select(*own, T.normalize_lexical(F.col(text)).alias("_normal"))
    return normal.select(*own, T.prepared(F.col(text), F.col("_normal")).alias("prepared"))


def tokenized(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, tokens)``: content tokens of each row's text, repeats kept; null texts give none."""
    normal = rows.select(F.col(key).alias("key"), T.normalize_lexical(F.col(text)).alias("normal"))
    return normal.select("key", T.content_tokens(T.tokens(F.col("normal"))).alias("tokens"))


def documents(units: DataFrame, recipes: DataFrame) -> DataFrame:
    """``(recipe_id, title, tokens)``: lemmas of all units in order of field and position, exact duplicates left out.

    Lemmas are unique within a unit, so a term's frequency is its number of units. Records without
    text keep an empty list.
    """
    ready = prepare(units, "raw_text").select("recipe_id", F.struct("field_name", "position", F.col("prepared.lemma_tokens").alias("t")).alias("u"))
    joined = ready.groupBy("recipe_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("u")), lambda u: u["t"])).alias("tokens"))
    own = recipes.where(F.col("duplicate_of_recipe_id").isNull() | (F.trim("duplicate_of_recipe_id") == "")).select(F.col("site_recipe_id").alias("recipe_id"), "title")
    return own.join(joined, "recipe_id", "left").select("recipe_id", "title", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))


def search_texts(units: DataFrame, recipes: DataFrame) -> DataFrame:
    """``(recipe_id, words)``: the distinct search words of all texts of a recipe, its origin label included.

    Per text the words, content words, stems and lemmas; a recipe's sets are united by a partially
    combined aggregation, so its texts are never gathered as such.
    """
    label = recipes.where("trim(origin_category) <> ''").select(F.col("site_recipe_id").alias("recipe_id"), F.lit("origin_category").alias("field_name"), F.lit(0).alias("position"), F.col("origin_category").alias("raw_text"))
    ready = prepare(units.unionByName(label), "raw_text")
    flat = ready.select("recipe_id", F.explode(F.split(T.search_index_text(F.col("prepared")), " ")).alias("word")).where("word <> ''").distinct()
    got = flat.groupBy("recipe_id").agg(F.array_sort(F.collect_list("word")).alias("words"))
    return recipes.select(F.col("site_recipe_id").alias("recipe_id")).join(got, "recipe_id", "left").select("recipe_id", F.array_join(F.coalesce("words", F.array().cast("array<string>")), " ").alias("words"))


def finished(runs: DataFrame, updates: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs with the cells of later updates, null cells of an update changing nothing."""
    r, u = runs.alias("r"), updates.alias("u")
    cells = [F.coalesce(F.col(f"u.{c}"), F.col(f"r.{c}")).alias(c) if c in updates.columns else F.col(f"r.{c}") for c in runs.columns]
    return r.join(u, F.col(f"r.{key}") == F.col(f"u.{key}"), "full").select(*cells)


def fingerprints(units: DataFrame, recipes: DataFrame) -> DataFrame:
    """``(recipe_id, fingerprint)``: key of title, ingredients and steps; of title and description if it has neither; empty with only a title."""
    normal = units.select("recipe_id", "field_name", "position", T.normalize_lexical(F.col("raw_text")).alias("n"))
    pieces = normal.groupBy("recipe_id").agg(F.array_sort(F.collect_list(F.struct("field_name", "position", "n"))).alias("u"))
    of = lambda *fields: F.array_join(F.transform(F.filter("u", lambda x: x["field_name"].isin(*fields)), lambda x: x["n"]), " ")
    lists, about, title = of("ingredient", "preparation_step"), of("description"), of("title")
    body = F.when(lists != "", lists).otherwise(about)
    got = pieces.select("recipe_id", F.when(body == "", "").otherwise(F.sha2(F.concat_ws(" ", title, body), 256)).alias("fingerprint"))
    return recipes.select(F.col("site_recipe_id").alias("recipe_id")).join(got, "recipe_id", "left").select("recipe_id", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))


def id_order(c: Column) -> Column:
    """Numeric ids first by value, then the others as text."""
    return F.struct((~c.rlike("^[0-9]+$")).alias("text"), c.try_cast("long").alias("number"), c.alias("id"))


def exact_duplicates(keys: DataFrame, record: str, key: str) -> DataFrame:
    """``(record, canonical, similarity)`` of every record whose non-empty key another one shares: the smallest id is canonical.

    The canonical id is a partially combined minimum joined back, so a key shared by a third of all
    records is no window of that size.
    """
    known = keys.where((F.col(key) != "") & F.col(record).isNotNull())
    first = known.groupBy(key).agg(F.min(id_order(F.col(record))).alias("m"), F.count("*").alias("n")).where("n > 1").select(key, F.col("m.id").alias("canonical"))
    out = known.join(first, key).where(F.col(record) != F.col("canonical"))
    return out.select(F.col(record).alias("record"), "canonical", F.lit(1.0).alias("similarity"))


def current(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of the latest run: a scalar maximum, pruned by partition where the table is partitioned by run."""
    latest = rows.agg(F.max(run).alias("_latest"))
    return rows.join(F.broadcast(latest), F.col(run) == F.col("_latest"), "left_semi")  # one row


def newest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the greatest by ``order``: an upsert over appended rows.

    A maximum of a struct instead of a window: combined before the shuffle, so a hot key stays small.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("best"))
    return best.select(*keys, *[F.col(f"best.{c}") for c in rest])


def numbered(rows: DataFrame, parent: str, order: list[Column]) -> DataFrame:
    """``rows`` with the 1-based ``position`` within each parent."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def running_index(rows: DataFrame, order: list[str], name: str, scratch) -> DataFrame:
    """``rows`` with a running number from 0 in ``order`` over all rows.

    Rows are range-partitioned and sorted, counted by partition, and numbered from the counts before
    theirs: no window over everything. The order is written first, so counts and numbers agree.
    """
    parts = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id() % F.lit(1 << 33)}))
    counts = parts.groupBy("_p").agg(F.count("*").alias("n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_o"))
    return parts.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_m")).drop("_p", "_m", "_o")
