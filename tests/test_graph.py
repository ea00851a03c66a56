import random

from larder.operators.components import components


def truth(edges):
    parent = {}
    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {(x, root(x)) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    cases = [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(rng.randrange(120), rng.randrange(120)) for _ in range(80)], [(5, 5), (7, 7), (7, 8)]]
    for edges in cases:
        df = spark.createDataFrame(edges + edges[:3], "x long, y long")
        assert {tuple(r) for r in components(df, "x", "y").collect()} == truth(edges)


def test_empty_and_null(spark):
    df = spark.createDataFrame([(None, "a"), ("b", None)], "x string, y string")
    assert components(df, "x", "y").count() == 0
