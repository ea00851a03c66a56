import os

import pytest

ROOT = "/root/testdata/sf0.001"
WITHOUT_ROWS = {"search_filter", "notebook_filter", "exact_dup_groups", "p4_inferred"}


def plain(frame):
    """Rows of a result as sorted texts, columns by name."""
    names = sorted(frame.columns)
    cells = frame[names].astype(object).where(frame[names].notna(), None)
    # Whole numbers beside nulls are floats in one engine's frames and not in the other's.
    same = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return names, sorted(repr([same(x.item() if hasattr(x, "item") else x) for x in row]) for row in cells.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_every_core_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from larder.plans.oracles import SQL
    from larder.plans.queries import QUERIES

    assert set(SQL) <= set(QUERIES)
    db = duckdb.connect()
    for name in os.listdir(ROOT):
        if name.endswith(".parquet"):
            db.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{ROOT}/{name}'")
    for name, query in QUERIES.items():
        got = query(spark, ROOT).toPandas()
        assert len(got) or name in WITHOUT_ROWS, name
        if name in SQL:
            assert plain(got) == plain(db.sql(SQL[name]).df()), name


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
