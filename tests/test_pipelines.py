import os

import pytest

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_runs(spark, tmp_path):
    from larder import pipelines

    out = str(tmp_path)
    assert pipelines.prepare(spark, ROOT, out)["texts"] > 0
    got = pipelines.embed(spark, ROOT, out)
    assert got["words"] > 0 and got["neighbours"] == 5 * got["documents"]
    assert pipelines.classify_texts(spark, ROOT, out)["status"] == "evaluated"
    assert pipelines.annotate(spark, ROOT, out)["entities"] > 0
    assert pipelines.latest(spark, out, "word_embeddings").count() > 0
    got = pipelines.analyze(spark, ROOT, out, clusters=3)
    assert got["neighbours"] == 5 * got["documents"] and got["clusters"] == 3
    text = pipelines.latest_analysis(spark, ROOT, out, "text")
    assert text["run"].first().documents == got["documents"] and text["document_similarities"].where("query_title IS NOT NULL AND neighbour_title IS NOT NULL").count() == got["neighbours"]
    rules = pipelines.latest_analysis(spark, ROOT, out, "linguistic")
    index = [r.sentence_index for r in rules["syntactic_dependencies"].orderBy("recipe_id", "position").select("sentence_index").collect()]
    assert index == list(range(len(index))) and rules["semantic_relations"].where("relation = 'pertence_categoria'").count() > 0
    assert pipelines.latest_analysis(spark, ROOT, out, "classification")["confusion"].count() > 0
    hits = pipelines.search(spark, ROOT, out, "bolo de chocolate", 4).collect()
    assert len(hits) == 4 and all(h.key_title for h in hits)
    pipelines.export_notebook(spark, ROOT, str(tmp_path / "n" / "report.ipynb"), out)
    assert "map of the recipes" in (tmp_path / "n" / "report.ipynb").read_text()
    with pytest.raises(ValueError):
        pipelines.classify_texts(spark, ROOT, out, target="x")
