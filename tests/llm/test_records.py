import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from larder.llm import distinctive, near_duplicates as nd, survivors as sv


def test_instants(spark):
    rows = [("2025-07-02T14:38:31-0400", 1751481511), ("10/06/2026 06:20:33", 1781072433), ("1751481511", 1751481511), ("1751481511000", 1751481511), ("2025-07-02T18:38:31Z", 1751481511), ("20250702T183831Z", 1751481511),
            ("2025-07-02 18:38:31", 1751481511), ("2025-07-02T18:38:31.5+00:00", 1751481511.5), ("", None), ("junk", None), (None, None), ("31/02/2025 00:00:00", None)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "x string").select(sv.instant(F.col("x"))).collect()
    assert [g[0] if g[0] is None else g[0] / 1e6 for g in got] == [b for _, b in rows]


def test_known(spark):
    rows = [("Fácil", True), (" N/D ", False), ("--", False), ("?", False), ("NÃO INFORMADO", False), ("sem&nbsp;informação", False), ("", False), (None, False), ("1", True)]
    assert [r[0] for r in spark.createDataFrame([(a,) for a, _ in rows], "x string").select(sv.known(F.col("x"))).collect()] == [b for _, b in rows]


def test_groups_and_survivors(spark):
    rows = [("1", " 2 ", 5, "a"), ("2", None, None, "bb"), ("3", "2", 5, None), ("4", "99", 1, "x"), ("5", "5", 1, "y"), ("6", "", 1, "z"), ("7", "8", None, None), ("8", "7", None, " ")]
    df = spark.createDataFrame(rows, "id string, dup string, n int, text string")
    groups = sv.duplicate_groups(df, "id", "dup")
    assert {tuple(r) for r in groups.collect()} == {("1", "1"), ("2", "1"), ("3", "1"), ("7", "7"), ("8", "7")}
    best = sv.survivors(df, groups, "id", {"n": (F.col("n").isNotNull(), [F.col("n")]), "text": (sv.known(F.col("text")), [F.length("text")])})
    got = {r.group: r for r in best.collect()}
    assert got["1"].n.source == "1" and got["1"].text.source == "2" and got["1"].text.value == "bb" and got["7"].n is None and got["7"].text is None
    assert sv.duplicate_groups(df.limit(0), "id", "dup").count() == 0


def test_long_chain_and_hub(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("c070", None)] + [(f"h{i:03d}", "h000") for i in range(90)]
    df = spark.createDataFrame(chain, "id string, dup string")
    sizes = sorted(r["count"] for r in sv.duplicate_groups(df, "id", "dup").groupBy("group").count().collect())
    assert sizes == [71, 90]


@pytest.mark.parametrize("tile_rows,split_rows", [(3, 4), (2000, 5), (2000, 256)])
def test_near_duplicates_equal_brute_force(spark, tile_rows, split_rows):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(150)] + ["comum"]
    sets = []
    for i in range(120):
        base = set(rng.sample(words[:40], rng.randrange(8, 30))) | {"comum"}
        sets.append(base)
        for _ in range(rng.randrange(0, 3)):
            s = set(base)
            for w in rng.sample(sorted(s), min(2, len(s))):
                s.discard(w)
            s.add(rng.choice(words))
            sets.append(s)
    sets += [sets[0]] * 5
    rows = [(f"{i:04d}", " ".join(sorted(s)), "clash") for i, s in enumerate(sets)] + [("0000", None, "x"), ("9999", "", "x"), (None, "a b c", "x")]
    df = spark.createDataFrame(rows, "record string, text string, w string")
    got_sets = nd.word_sets(df, "record", "text", 10)
    reps, members = nd.classes(got_sets)
    pairs = nd.similar_pairs(reps, Fraction(4, 5), tile_rows, split_rows)
    got = {(r.a, r.b) for r in nd.expand_pairs(pairs, members).collect()}
    ok = [(f"{i:04d}", s) for i, s in enumerate(sets) if len(s) >= 10]
    want = {(a, b) for i, (a, s) in enumerate(ok) for b, t in ok[i + 1 :] if 5 * len(s & t) >= 4 * len(s | t)}
    assert got == want and len(want) > 20
    if split_rows == 256:
        out = {r.record: r for r in nd.near_duplicate_groups(got_sets).collect()}
        assert sum(r.links for r in out.values()) == 2 * len(want) and all(out[a].group == out[b].group for a, b in want)


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "record string, text string")
    assert nd.near_duplicate_groups(nd.word_sets(df, "record", "text", 12)).count() == 0


def test_distinctive(spark):
    import math

    rows = [("a", "bolo bolo de milho 2000", "x"), ("a", "bolo", "x"), ("b", "bolo de fubá", "x"), ("c", None, "x"), ("d", "", "x"), ("b", "fub&aacute; ralado", "x")]
    df = spark.createDataFrame(rows, "r string, t string, term string")
    counts = distinctive.term_counts(df, "r", "t")
    assert {(r.record, r.term): r.tf for r in counts.collect()} == {("a", "bolo"): 3, ("a", "milho"): 1, ("b", "bolo"): 1, ("b", "fuba"): 2, ("b", "ralado"): 1}
    records = spark.createDataFrame([(x,) for x in "abcd"], "r string")
    got = {(r.record, r.term): r.score for r in distinctive.relevance(counts, records, "r", k1=None, plain_idf=True).collect()}
    assert got["a", "bolo"] == round(3 * math.log(2), 9) and got["b", "fuba"] == round(2 * math.log(4), 9)
    bm = {(r.record, r.term): r.score for r in distinctive.relevance(counts, records, "r").collect()}
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    assert bm["a", "bolo"] == pytest.approx(idf * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 4 / 2)), abs=1e-8)
    top = distinctive.leading_terms(distinctive.relevance(counts, records, "r", k1=None, plain_idf=True), 1).collect()
    assert {(r.record, r.term) for r in top} == {("a", "bolo"), ("b", "fuba")}
    assert distinctive.leading_terms(distinctive.relevance(counts.limit(0), records.limit(0), "r")).count() == 0


def test_pairs_of_a_large_class(spark, monkeypatch):
    """A class of equal sets larger than a block gives each of its pairs once."""
    monkeypatch.setattr(nd, "CLASS_BLOCK", 7)
    members = spark.createDataFrame([(f"{i:03d}", "000") for i in range(50)] + [("x", "x")], "record string, class string")
    pairs = spark.createDataFrame([("000", "x")], "a string, b string")
    got = [(r.a, r.b) for r in nd.expand_pairs(pairs, members).collect()]
    assert len(got) == len(set(got)) == 50 * 49 // 2 + 50 and all(a < b for a, b in got)
