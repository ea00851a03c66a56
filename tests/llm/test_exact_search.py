"""Nearest vectors over many blocks equal brute force."""

import numpy as np
import pytest

from larder.llm import clusters, neighbours as nn


def brute(ids: list, x: np.ndarray, k: int, limit: float) -> set:
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    s = np.round(unit @ unit.T, 9)
    np.fill_diagonal(s, -2)
    place = np.arange(len(ids))
    return {(ids[i], ids[j], float(s[i, j])) for i in place for j in np.lexsort((place, -s[i]))[:k] if s[i, j] >= limit}


def found(df, k: int, limit: float, window: int) -> set:
    return {(r.id, r.neighbour, r.similarity) for r in nn.neighbours(df, k, limit, window=window).collect()}


def alike(got: set, want: set) -> None:
    pairs = lambda rows: {(a, b): s for a, b, s in rows}
    got, want = pairs(got), pairs(want)
    assert got.keys() == want.keys() and max(abs(got[p] - want[p]) for p in got) < 2e-9


def test_dense_over_many_blocks(spark):
    """Clusters and stragglers without any order that a curve could follow, and ties."""
    rng = np.random.RandomState(1)
    centres = rng.normal(size=(8, 24))
    x = np.concatenate([np.repeat(centres, 100, axis=0) + 0.4 * rng.normal(size=(800, 24)), rng.normal(size=(1600, 24))])
    x[5], x[1500], x[2300] = x[700], x[700], x[700]
    ids = [f"{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "id string, vec array<double>")
    alike(found(df, 5, 0.3, 60), brute(ids, x, 5, 0.3))


def test_sparse_over_many_blocks(spark):
    rng = np.random.RandomState(2)
    x = np.zeros((1500, 400))
    for i in range(len(x)):
        terms = rng.choice(400, 12, replace=False) if i >= 500 else (i % 10) * 30 + rng.choice(30, 12, replace=False)
        x[i, terms] = rng.uniform(0.2, 1, 12) * rng.choice([1, 1, 1, -1], 12)
    ids = list(range(len(x)))
    rows = [(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in zip(ids, x)]
    df = spark.createDataFrame(rows, "id long, terms array<int>, weights array<double>")
    alike(found(df, 5, 0.3, 60), brute(ids, x, 5, 0.3))


@pytest.mark.parametrize("groups", [2, 128])
def test_groups_screen_no_pair_lower_than_it_is(monkeypatch, groups):
    monkeypatch.setattr(nn, "GROUPS", groups)
    rng = np.random.RandomState(3)
    terms = [np.sort(rng.choice(300, 20, replace=False)) for _ in range(60)]
    weights = [w / np.sqrt((w * w).sum()) for w in rng.normal(size=(60, 20))]
    v = nn.Sparse(np.arange(60).astype(object), np.arange(61) * 20, np.concatenate(terms), np.concatenate(weights))
    x, (a, b) = v.screen(), np.divmod(np.arange(3600), 60)
    exact = v.dots(a, b)
    assert x.shape == (60, groups) and ((x @ x.T).ravel() >= exact - nn.ROUNDING).all()
    assert np.allclose(v.take(np.arange(30)).dots(a[:1800], b[:1800], v), exact[:1800])


def test_window_of_sparse_vectors_loses_no_pair_at_the_limit():
    """Bounds of groups screen no true pair out; random signs, off by 2.65 standard errors at times, did."""
    rng = np.random.RandomState(4)
    pairs, size, limit = 1500, 25, 0.64
    terms = []
    for _ in range(pairs):
        drawn = rng.choice(20_000, 34, replace=False)
        terms += [np.sort(drawn[:25]), np.sort(drawn[9:])]  # 16 of 25 in common
    n = 2 * pairs
    v = nn.Sparse(np.array([f"{i:04d}" for i in range(n)], dtype=object), np.arange(n + 1) * size, np.concatenate(terms), np.full(n * size, 0.2))
    got = lambda x, off: set(zip(*[part.tolist() for part in nn._best(v, x, 5, limit, off, 10, 2 * n)[:2]]))
    want = {(i, i ^ 1) for i in range(n)}
    assert got(v.screen(), nn.ROUNDING) == want
    assert got(v.project(512), 2.65 / 512**0.5) < want


def test_sparse_stragglers_meet_only_what_shares_a_leading_term():
    """Vectors far from all others were compared with every one by matrix products; now few are, and none is lost."""
    rng = np.random.RandomState(5)
    n, size, limit = 3000, 30, 0.6
    terms = np.stack([np.sort(rng.choice(10_000, size, replace=False)) + i % 2 * 10_000 for i in range(n)])
    weights = rng.uniform(0.2, 1, (n, size)) * rng.choice([1, 1, 1, -1], (n, size))
    for i in range(0, 2000, 4):
        shared = rng.choice(size, rng.randint(10, 28), replace=False)
        terms[i + 1, shared], weights[i + 1, shared] = terms[i, shared], weights[i, shared]
    theme = rng.choice(20_000, 40, replace=False)
    for i in range(2600, n):
        terms[i], weights[i] = rng.choice(theme, size, replace=False), np.abs(weights[i])
    weights[7, 3] = np.nan
    ids = [f"{i:04d}" for i in range(n)]
    table = nn.pa.table({"id": ids, "terms": terms.tolist(), "weights": weights.tolist()})
    v = nn.unpack(table)
    lead = v.leading()
    v = nn.Sparse(v.ids, v.starts, v.terms[lead], v.weights[lead])
    x, part = v.screen(), np.arange(1, n, 3)
    found = nn._Nearest(v.take(part), x[part], 0, 5, limit, 10)
    rows, cols = found.meet_sharing(np.arange(len(part)), v, x)
    assert len(rows) * len(cols) < 0.1 * len(part) * n
    for lo in range(0, len(rows), 100):
        found.meet(rows[lo : lo + 100], v, x, cols, False)
    got = {(ids[part[r]], found.ids[r, c], found.sims[r, c]) for r, c in zip(*np.nonzero(found.sims > -np.inf))}
    dense = np.zeros((n, 20_000))
    for i in range(n):
        dense[i, terms[i]] = weights[i] if i != 7 else 0
    want = brute(ids, dense, 5, limit)
    mine = {ids[i] for i in part}
    alike(got, {w for w in want if w[0] in mine})


def test_sparse_pairs_apart_on_the_curve_are_in_the_graph(spark):
    """Linked stragglers beyond each other's window of a slot were missed; so the slot's clusters of three were."""
    rng = np.random.RandomState(6)
    rows, links = [], set()
    for g in range(400):
        drawn = rng.choice(200_000, 60, replace=False).tolist()
        # The second shares 18 of 25 terms with either other one, these fewer.
        for i, terms in enumerate((drawn[:25], drawn[7:32], drawn[14:39])):
            rows.append((f"{i}{g:04d}", terms, [1.0] * 25))
        links |= {(f"0{g:04d}", f"1{g:04d}"), (f"1{g:04d}", f"2{g:04d}")}
    df = spark.createDataFrame(rows, "id string, terms array<int>, weights array<double>")
    for how in ({}, {"k": 0, "cores": 0}):
        edges = clusters.neighbour_graph(df, 0.64, window=300, curves=1, **how)
        assert {(r.a, r.b) for r in edges.collect()} == links
        assert clusters.flat(clusters.distances(edges, 0.64)).groupBy("cluster").count().where("count = 3").count() == 400


def test_graph_of_only_what_connects_has_the_same_clusters(spark):
    """Themes, stragglers and a large class of copies, in one window and in many."""
    rng = np.random.RandomState(7)
    centres = rng.normal(size=(6, 16))
    x = np.concatenate([centres[np.arange(900) % 6] + 0.35 * rng.normal(size=(900, 16)), rng.normal(size=(300, 16)), np.repeat(centres[:1], 80, axis=0)])
    df = spark.createDataFrame([(f"{i:05d}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")
    for window in (5000, 150):
        edges = [clusters.distances(clusters.neighbour_graph(df, 0.8, window=window, **how), 0.8) for how in ({}, {"k": 0, "cores": 0})]
        full, lean = ({(r.cluster, r.id) for r in clusters.flat(e).collect()} for e in edges)
        assert len(full ^ lean) <= (0 if window == 5000 else 0.02 * len(full)) and len(full) > 600


def connected(edges: set, ids: list) -> set:
    """The sets of at least two that ``edges`` connect."""
    at = {x: i for i, x in enumerate(ids)}
    label = clusters._roots(len(ids), np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    groups = {}
    for x, g in zip(ids, label.tolist()):
        groups.setdefault(g, set()).add(x)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("space", ["dense", "sparse", "copies"])
def test_links_connect_what_all_pairs_connect(spark, space):
    """Windows on curves left pairs out, and with them members of clusters; themes, chains, stragglers, ids delivered twice."""
    rng = np.random.RandomState(8)
    limit = 0.6
    if space == "sparse":
        x = np.zeros((1800, 400))
        for i in range(len(x)):
            terms = rng.choice(400, 12, replace=False) if i >= 900 else (i % 30) * 13 + rng.choice(20, 12, replace=False) % 400
            x[i, np.unique(terms % 400)] = 1
            x[i] *= rng.uniform(0.2, 1, 400) * rng.choice([1, 1, 1, -1], 400)
    else:
        x = np.concatenate([np.repeat(rng.normal(size=(30, 24)), 20, axis=0) + 0.7 * rng.normal(size=(600, 24)), rng.normal(size=(1800, 24))])
    if space == "copies":
        x[rng.choice(len(x), 300, replace=False)] = x[0]
        x *= rng.uniform(0.5, 4, (len(x), 1))
    ids = [f"{i:05d}" for i in range(len(x))]
    order = rng.permutation(len(x)).tolist() + [0, 7]
    if space == "sparse":
        df = spark.createDataFrame([(ids[i], np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist()) for i in order], "id string, terms array<int>, weights array<double>")
    else:
        df = spark.createDataFrame([(ids[i], x[i].tolist()) for i in order], "id string, vec array<double>")
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    s = np.round(unit @ unit.T, 9)
    every = {(ids[a], ids[b]): s[a, b] for a, b in zip(*np.nonzero(np.triu(s >= limit, 1)))}
    want = connected(every, ids)
    got = {(r.a, r.b): r.similarity for r in nn.links(df, limit, window=40).collect()}
    assert all(abs(got[p] - every[p]) < 2e-9 for p in got)
    assert connected(got, ids) == want
    before = {(r.a, r.b) for r in clusters.neighbour_graph(df, limit, k=0, cores=0, window=40).collect()}
    assert connected(before, ids) != want


def test_stragglers_meet_few_members_of_themes(monkeypatch):
    """Stragglers and themes were compared with one another throughout, as cells of stragglers are wide; none is lost now."""
    rng = np.random.RandomState(9)
    themes = np.repeat(rng.normal(size=(5, 64)), 400, axis=0) + 0.3 * rng.normal(size=(2000, 64))
    x = np.concatenate([themes, rng.normal(size=(1000, 64))])
    x[2000:2300] = x[rng.choice(2000, 300)] + 0.4 * rng.normal(size=(300, 64))
    ids = [f"{i:04d}" for i in range(len(x))]
    table = nn.pa.table({"id": ids, "vec": x.tolist(), "key": np.zeros(len(x), dtype=np.int64)})
    block = nn._blocked(table)
    v, centres = nn.unpack(block), block.column("centre").to_pylist()
    begin = np.array([i for i, c in enumerate(centres) if c is not None])
    cells = begin, block.column("radius").to_numpy()[begin].astype(np.float32), np.array([centres[i] for i in begin], dtype=np.float32)
    assert (cells[1] > nn.WIDE).any() and (cells[1] < nn.WIDE).any()
    pairs, meet = [], nn._Nearest.meet

    def counted(self, rows, other, y, cols, own):
        pairs.append(len(rows) * len(cols))
        meet(self, rows, other, y, cols, own)

    monkeypatch.setattr(nn._Nearest, "meet", counted)
    found = nn._Nearest(v, v.screen(), 0, 5, 0.85, 10)
    nn._compare(found, v, v.screen(), np.r_[begin, len(x)], found.needs(cells[2], cells[1]), True, cells)
    got = {(v.ids[r], found.ids[r, c], found.sims[r, c]) for r, c in zip(*np.nonzero(found.sims > -np.inf))}
    alike(got, brute(ids, x, 5, 0.85))
    assert sum(pairs) < 0.3 * len(x) ** 2
