import os

import pytest

ROOT = "/root/testdata/sf0.001"


def plain(frame):
    """Rows of a result as sorted texts, columns by name, all numbers as floats."""
    names = sorted(frame.columns)
    cells = frame[names].astype(object).where(frame[names].notna(), None)
    same = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return names, sorted(repr([same(x.item() if hasattr(x, "item") else x) for x in row]) for row in cells.itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_queries_equal_their_sql(spark):
    """At this size a window holds all vectors, so the search is exact too."""
    duckdb = pytest.importorskip("duckdb")
    from larder.llm.queries import QUERIES
    from larder.llm.sql import SQL

    assert set(SQL) <= set(QUERIES) and all(n[0] == "p" for n in QUERIES)
    db = duckdb.connect()
    for name in os.listdir(ROOT):
        if name.endswith(".parquet"):
            db.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{ROOT}/{name}'")
    for name, query in QUERIES.items():
        got = query(spark, ROOT)
        if name in SQL:
            assert plain(got.toPandas()) == plain(db.sql(SQL[name]).df()), name
        else:
            assert got.count() > 0, name
