import pytest

from larder.operators import catalogue as C


@pytest.fixture(scope="module")
def tables(spark):
    recipes = spark.createDataFrame(
        [("1", "Bolo de chocolate", "https://a.test/receita/1.html", 4.5, 10, 30, "Fácil", "Custo baixo", "bolo chocolate", "Aves"), ("2", "Frango", "https://a.test/receita/2.html", None, None, None, "facil", None, "frango", " "),
         ("3", "bolo", "https://a.test/receita/3.html", 4.5, None, 20, "FACIL", "custo BAIXO", "bolo", "Bolos")],
        "site_recipe_id string, title string, url string, rating_value double, ratings_count int, prep_time_minutes int, difficulty string, cost_label string, search_text string, origin_category string")
    listings = spark.createDataFrame([("c1", "1"), ("c1", "https://a.test/receita/2.html"), ("c2", "zz"), (None, "3")], "category_id string, recipe_id string")
    return recipes, listings


def ids(df):
    return [r.site_recipe_id for r in df.collect()]


def test_search(tables):
    recipes, listings = tables
    assert ids(C.search(recipes, listings, C.Filter())) == ["1", "3", "2"]
    assert ids(C.search(recipes, listings, C.Filter(search="bolos", max_time=24))) == ["3"]
    assert ids(C.search(recipes, listings, C.Filter(difficulty=" facil "))) == ["3", "2"]
    assert sorted(ids(C.search(recipes, listings, C.Filter(category_id="c1")))) == ["1", "2"]
    assert ids(C.page(C.search(recipes, listings, C.Filter()), 2, 2)) == ["2"]


def test_facets_and_origin(spark, tables):
    recipes, listings = tables
    cats = spark.createDataFrame([("c1", "Bolos", None), ("c2", "Aves", None)], "site_category_id string, name string, url string")
    assert {r.value for r in C.facets(recipes, cats, listings).where("facet = 'category'").collect()} == {"c1"}
    rel, added = C.origin_relations(recipes, cats.where("name = 'Bolos'"))
    assert {(r.recipe_id, r.category_id) for r in rel.collect()} == {("1", "origin:aves"), ("3", "c1")} and added.first().name == "Aves"
    up = C.upsert_categories(cats.limit(1).withColumn("url", __import__("pyspark").sql.functions.lit("u")), cats).orderBy("site_category_id").collect()
    assert (up[0].url, up[0].name) == ("u", "Bolos")


def test_normalize(tables):
    recipes, _ = tables
    wide = recipes.selectExpr("*", "'x' AS prep_time_raw", "' ' AS description")
    n = {r.site_recipe_id: r for r in C.normalized_recipes(wide).collect()}
    assert n["2"].difficulty == "fácil" and n["3"].cost_label == "Custo baixo" and n["1"].description is None and n["2"].origin_category is None


def test_save_recipes_replaces_lines(spark):
    from larder import schemas
    from larder.operators import catalogue

    store = {n: spark.createDataFrame([], schemas.schema(n)) for n in ("recipes", "ingredients", "utensils", "preparation_steps", "recipe_categories", "categories")}
    record = "site_recipe_id string, title string, url string, cost_label string, ingredients array<string>, utensils array<string>, preparation_steps array<string>, related_categories array<struct<site_category_id: string, name: string, url: string>>, retrieved_at string"
    first = spark.createDataFrame([("1", "Bolo", "u", "Custo baixo", ["a", "b", "c"], ["forma"], ["x"], [("7", "Doces", None)], "2025-01-02"), ("1", "Velho", "u", None, ["z"], [], [], [], "2025-01-01")], record)
    one = catalogue.save_recipes(store, first)
    assert [(r.site_recipe_id, r.title) for r in one["recipes"].collect()] == [("1", "Bolo")]
    assert sorted((r.line_position, r.raw_text) for r in one["ingredients"].collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert one["recipe_categories"].first().category_id == "7" and one["categories"].first().name == "Doces"
    later = spark.createDataFrame([("1", "Bolo novo", "u", None, ["d"], [], ["y", "w"], [], "2025-02-01"), ("2", "Outro", "v", None, [], [], [], [], None)], record)
    two = catalogue.save_recipes(one, later)
    assert {(r.site_recipe_id, r.title, r.cost_label) for r in two["recipes"].collect()} == {("1", "Bolo novo", "Custo baixo"), ("2", "Outro", None)}
    assert [r.raw_text for r in two["ingredients"].collect()] == ["d"] and two["utensils"].count() == 0 and two["recipe_categories"].count() == 0
    late = spark.createDataFrame([("1", "Atrasado", "u", None, ["q"], [], [], [], "2025-01-15")], record)
    three = catalogue.save_recipes(two, late)
    assert [r.raw_text for r in three["ingredients"].collect()] == ["d"] and three["recipes"].where("title = 'Atrasado'").count() == 0


def test_first_recipe(spark):
    from larder.operators import catalogue

    recipes = spark.createDataFrame([("2", "bolo"), ("1", "Abacaxi"), ("3", "abacaxi")], "site_recipe_id string, title string")
    lines = spark.createDataFrame([("1", 2, "b"), ("1", 1, "a"), ("1", 1, "a"), ("2", 1, "z")], "recipe_id string, line_position int, raw_text string")
    related = spark.createDataFrame([("1", "Frutas"), ("1", "doces")], "recipe_id string, name string")
    got = catalogue.first_recipe(recipes, lines, lines.limit(0), related).collect()
    assert [(r.recipe_id, r.ingredients, r.preparation_steps, r.related_categories) for r in got] == [("1", ["a", "b"], [], ["doces", "Frutas"])]
    assert catalogue.first_recipe(recipes.limit(0), lines, lines).count() == 0
