import json

import pytest

from larder import report, schemas
from larder.sources import fetch, html, logs

PAGE = """<html><head><meta name="description" content="Bom &amp; barato"></head><body><h1>Bolo caseiro</h1>
<p>4,5 / 5 (1.548 avaliações) 25 min Fácil Custo médio</p>
<section><h2>Ingredientes (5 porções)</h2><ul><li>2 ovos</li><li>2 ovos</li><li>Comprar</li><li>leite</li></ul></section>
<section><h2>Utensílios</h2><ul><li>forma</li></ul></section><section><h2>Modo de preparo</h2><ul><li>Misture</li></ul></section>
<section><h2>Categorias relacionadas</h2><a href="/categorias/2107-bolos">Bolos</a><a href="/categorias/2107-bolos">Bolos</a></section></body></html>"""


def test_visible_page():
    r = html.parse_recipe(PAGE, "https://a.test/receita/10-bolo.html?x=1")
    assert (r["site_recipe_id"], r["title"], r["rating_value"], r["ratings_count"], r["prep_time_minutes"], r["servings"]) == ("10", "Bolo caseiro", 4.5, 1548, 25, 5)
    assert r["ingredients"] == ["2 ovos", "leite"] and r["preparation_steps"] == ["Misture"] and r["issues"] == [] and r["related_categories"][0]["site_category_id"] == "2107"
    with pytest.raises(ValueError):
        html.parse_recipe(PAGE, "https://a.test/outra/1")


def test_structured_page_wins():
    data = {"@graph": [{"@type": ["Thing", "Recipe"], "name": "Real", "totalTime": "PT1H5M", "recipeInstructions": [{"itemListElement": [{"text": "a"}, {"name": "b"}]}], "recipeYield": ["4 porções"]}]}
    r = html.parse_recipe(f'<script type="application/ld+json">{json.dumps(data)}</script><script type="application/ld+json">{{bad</script><h1>Visible</h1>', "https://a.test/receita/7.html")
    assert (r["title"], r["prep_time_minutes"], r["preparation_steps"], r["servings"]) == ("Real", 65, ["a", "b"], 4) and "ingredients ausentes" in r["issues"]


def test_category_page():
    links = "".join(f'<a href="/receita/{i}-x.html"><img alt="R {i}"></a>' for i in range(1, 18))
    page = f'<section><h2>Receitas recomendadas</h2>{links}<a href="https://b.test/receita/99.html">no</a></section><a href="?page=2">2</a>'
    got = html.parse_category(page, "https://a.test/categorias/1")
    assert len(got["links"]) == 15 and got["links"][0]["title"] == "R 1" and got["has_next_page"]
    with pytest.raises(ValueError):
        html.parse_category("<h2>x</h2>", "https://a.test/categorias/1")
    assert html.page_url("https://a.test/c?q=1", 3) == "https://a.test/c?q=1&page=3"


def test_pages_table(spark):
    df = spark.createDataFrame([("https://a.test/receita/10.html", PAGE), ("https://a.test/x", PAGE), (None, None)], "url string, html string")
    assert [r.title for r in html.recipes_of(df).collect()] == ["Bolo caseiro"]
    assert html.links_of(df).count() == 0


def test_fetch_policy():
    with pytest.raises(fetch.AuthorizationRequired):
        fetch.check_access("https://a.test/receita/1.html")
    with pytest.raises(ValueError):
        fetch.check_access("https://a.test/", override=True)
    with pytest.raises(fetch.RobotsBlocked):
        fetch.check_access("https://a.test/p/1", disallowed=["/p"])
    assert fetch.retry_delay(0, 429, "7") == 7 and fetch.retry_delay(0, 404) is None and fetch.retry_delay(1, 503) == 4 and fetch.retry_delay(3, 503) is None and fetch.retry_delay(1, None) == 2


def test_report():
    rows = [{"a": i, "b": "<x>"} for i in range(5)]
    t = report.table(rows, ["a", "b"], page=2, size=2)
    assert "<td>2</td>" in t and "&lt;x&gt;" in t and "2/3" in t
    assert report.plain(1.5) == "1.5" and report.plain(None) == "—" and "width:2.0%" in report.bars([{"label": "x", "count": 0}, {"label": "y", "count": 900}])
    nb = report.notebook([("markdown", "# t", ""), ("html", "x", "<b>1</b>"), ("svg", "m", report.svg_map([{"u": 1, "v": 2, "depth": 0, "label": 1, "title": "t"}]))])
    assert nb["nbformat"] == 4 and len(nb["cells"]) == 3 and "circle" in "".join(nb["cells"][2]["outputs"][0]["data"]["image/svg+xml"])


def test_logs_and_schemas(spark, tmp_path):
    df = spark.createDataFrame([("t", "recipe_saved", "1", ["a"])], logs.EVENT)
    logs.write_log(df, str(tmp_path / "log"))
    assert logs.read_log(spark, str(tmp_path / "log")).first().issues == ["a"]
    old = spark.createDataFrame([("1", "n")], "site_category_id string, name string")
    assert schemas.migrated(old, "categories").columns == ["site_category_id", "name", "url"]
    j = spark.createDataFrame([('["a","",null,"b"]',), ("{",), (None,)], "x string").select(schemas.json_list("x").alias("l")).collect()
    assert [r.l for r in j] == [["a", "b"], [], []]


def test_category_config(spark, tmp_path):
    from larder.sources.config import read_categories

    rows = [{"key": "a", "name": "A", "url": "u", "enabled": True}, {"key": "b", "name": "B", "url": "v", "enabled": False}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text(json.dumps({"categories": rows}))
    assert [r.key for r in read_categories(spark, str(tmp_path / "a.json")).collect()] == ["a"] == [r.key for r in read_categories(spark, str(tmp_path / "b.json")).collect()]


def test_finished_runs(spark):
    from larder.operators.corpus import finished

    runs = spark.createDataFrame([(1, "running", None), (2, "running", 5)], "run_id long, status string, n int")
    done = spark.createDataFrame([(1, "completed", 7), (3, "completed", 1)], "run_id long, status string, n int")
    assert {tuple(r) for r in finished(runs, done).collect()} == {(1, "completed", 7), (2, "running", 5), (3, "completed", 1)}


def test_stream_ingest(spark, tmp_path):
    from larder.streaming import ingest, windows

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"url": "https://a.test/receita/10.html", "html": PAGE, "retrieved_at": "2025-01-01T00:00:00Z"}) + "\n")
    q = ingest.ingest(ingest.page_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.title for r in ingest.latest(spark, str(tmp_path / "out")).collect()] == ["Bolo caseiro"]
    ev = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value")
    assert windows.hourly(ev).first().events == 1


def test_latest_page_wins_whatever_batch_it_comes_in(spark, tmp_path):
    import json

    from larder.streaming import ingest

    def page(title):
        return f"<html><head><script type='application/ld+json'>{json.dumps({'@type': 'Recipe', 'name': title})}</script></head><body></body></html>"

    folder = tmp_path / "in"
    folder.mkdir()
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    batches = [[("https://a.test/receita/7-bolo.html?x=1", "novo", "2025-03-01T00:00:00"), ("https://A.test/receita/7-bolo.html", "meio", "2025-02-01T00:00:00")], [("https://a.test/receita/7-bolo.html", "atrasado", "2025-01-01T00:00:00")]]
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"url": u, "html": page(t), "retrieved_at": at}) for u, t, at in rows))
        ingest.ingest(ingest.page_stream(spark, str(folder)), target, state).awaitTermination()
    assert [(r.site_recipe_id, r.title) for r in ingest.latest(spark, target).collect()] == [("7", "novo")]


def test_fixture_pages(spark, tmp_path):
    from larder import pipelines

    (tmp_path / "c.html").write_text("<h2>Receitas recomendadas</h2><section><h2>Receitas recomendadas</h2><a href='/receita/7-bolo.html'>Bolo</a></section>")
    (tmp_path / "r.html").write_text("<h1>Bolo</h1><p>Fácil</p>")
    got = pipelines.fixture(spark, str(tmp_path / "out"), 3, (str(tmp_path / "c.html"), "https://a.test/categorias/12-doces"), (str(tmp_path / "r.html"), "https://a.test/receita/7-bolo.html"))
    assert got["recipe_count"] == 1 and got["listing_count"] == 1 and got["status"] == "partial" and got["error_count"] > 0
    run = spark.read.parquet(str(tmp_path / "out" / "scrape_runs")).first()
    assert run.run_id == 3 and run.finished_at is not None and run.listing_count == 1
    assert spark.read.parquet(str(tmp_path / "out" / "fixture_recipes")).first().origin_category == "Doces"


def test_page_urls_keep_other_parameters(spark):
    from pyspark.sql import functions as F

    from larder.functions import text as T

    df = spark.createDataFrame([("https://a.test/c?q=1&page=9#x",), ("https://a.test/c",)], "u string")
    assert [r[0] for r in df.select(T.page_url(F.col("u"), F.lit(3))).collect()] == ["https://a.test/c?q=1&page=3", "https://a.test/c?page=3"]
