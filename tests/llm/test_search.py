import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import clusters, neighbours as nn


def cosine_truth(rows, k, limit):
    ids = [r[0] for r in rows]
    x = np.array([r[1] for r in rows], dtype=float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    s = np.round(x @ x.T, 9)
    out = set()
    for i, a in enumerate(ids):
        best = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= limit)[:k]
        out |= {(a, b) for _, b in best}
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.RandomState(5)
    centres = rng.normal(size=(12, 16))
    rows = [(f"{i:05d}", [float(np.float32(v)) for v in centres[i % 12] + 0.35 * rng.normal(size=16)]) for i in range(600)]
    rows += [(f"9{i:04d}", [2 * v for v in rows[i][1]]) for i in range(5)]
    return rows


def test_hilbert_is_a_bijection_of_neighbours():
    side = 8
    cells = np.array([(i, j) for i in range(side) for j in range(side)])
    keys = nn.hilbert(cells, 3)
    assert sorted(keys) == list(range(side * side))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_dense_exact_in_one_window_and_recall_in_many(spark, points):
    df = spark.createDataFrame([(a, v) for a, v in points] + [points[0]], "id string, vec array<float>")
    want = cosine_truth(points, 5, 0.5)
    got = {(r.id, r.neighbour) for r in nn.neighbours(df, 5, 0.5, window=5000).collect()}
    assert got == want
    near = {(r.id, r.neighbour) for r in nn.neighbours(df, 5, 0.5, window=60, curves=6).collect()}
    assert len(near & want) / len(want) >= 0.9


def test_sparse(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        group = i % 10
        terms = sorted({group * 50 + rng.randrange(14) for _ in range(12)} | {1000 + rng.randrange(200)})
        rows.append((f"{i:04d}", terms, [rng.uniform(0.5, 3) for _ in terms]))
    df = spark.createDataFrame(rows, "id string, terms array<int>, weights array<float>")
    dense = []
    for a, t, w in rows:
        v = [0.0] * 1300
        for k, x in zip(t, w):
            v[k] = float(np.float32(x))
        dense.append((a, v))
    want = cosine_truth(dense, 5, 0.6)
    got = {(r.id, r.neighbour) for r in nn.neighbours(df, 5, 0.6, window=1000).collect()}
    assert len(got & want) / len(want) >= 0.97 and len(got - want) / len(want) <= 0.05


def test_hot_copies(spark, points):
    hot = [(f"h{i:03d}", points[3][1]) for i in range(200)] + [("h050a", [2 * v for v in points[3][1]]), ("a", [4 * v for v in points[3][1]])]
    df = spark.createDataFrame(points[:100] + hot, "id string, vec array<float>")
    got = {}
    for r in nn.neighbours(df, 3, 0.5).collect():
        got.setdefault(r.id, []).append((-r.similarity, r.neighbour))
    want = cosine_truth(points[:100] + hot, 3, 0.5)
    assert {(a, b) for a, v in got.items() for _, b in v} == want


def test_usable(spark):
    rows = [(1, "old", [1.0]), (2, "a", [1.0, 2.0]), (2, None, [1.0]), (2, "z", [0.0, 0.0]), (2, "e", []), (2, "n", None)]
    df = spark.createDataFrame(rows, "run long, id string, vec array<double>")
    assert [r.id for r in nn.usable(df, "run", "id", "vec").collect()] == ["a"]
    assert nn.neighbours(nn.usable(df.limit(0), "run", "id", "vec")).count() == 0


def test_flat_clusters(spark, points):
    df = spark.createDataFrame(points, "id string, vec array<float>")
    x = np.array([p[1] for p in points])
    x /= np.sqrt((x * x).sum(1))[:, None]
    link = np.argwhere(np.round(x @ x.T, 9) >= 0.8)
    label = list(range(len(points)))
    changed = True
    while changed:
        changed = False
        for i, j in link:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    size = {k: label.count(k) for k in set(label)}
    want = {(points[min(i for i in range(len(points)) if label[i] == k)][0], points[m][0]) for m, k in enumerate(label) if size[k] >= 3}
    for window in (5000, 150):
        edges = clusters.distances(clusters.neighbour_graph(df, 0.8, window=window, curves=6), 0.8)
        got = {(r.cluster, r.id) for r in clusters.flat(edges).collect()}
        assert len(got ^ want) <= (0 if window == 5000 else 0.05 * len(want))


def test_forest_is_minimal(spark):
    rng = random.Random(4)
    edges = {(min(a, b), max(a, b)): rng.random() for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(150)) if a != b}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, distance double")
    forest, members = clusters.spanning_forest(df)
    parent = list(range(40))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    want = set()
    for w, (a, b) in sorted((w, e) for e, w in edges.items()):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add((a, b))
    assert {(r.a, r.b) for r in forest.collect()} == want
    assert members.select("component").distinct().count() == len({root(a) for e in edges for a in e})
    none, nobody = clusters.spanning_forest(df.limit(0))
    assert none.count() == 0 and nobody.count() == 0


def hierarchy_truth(names, d, min_size, min_samples):
    """Members of the selected clusters from all distances, top down: brute force."""
    n = len(names)
    core = np.minimum(1.0, np.sort(d, axis=1)[:, min_samples - 1])
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    edges = sorted((round(float(reach[i, j]), 9), names[i], names[j]) for i in range(n) for j in range(i + 1, n) if d[i, j] <= 1)
    lam = lambda x: 1 / max(x, clusters.FINEST)

    def parts(members, kept):
        left, out = set(members), []
        while left:
            todo, comp = [left.pop()], set()
            while todo:
                a = todo.pop()
                comp.add(a)
                for x, y in kept:
                    for p, q in ((x, y), (y, x)):
                        if p == a and q in left:
                            left.discard(q)
                            todo.append(q)
            out.append(comp)
        return out

    def tree(comp, mine, birth):
        """(stability, selected clusters) of the cluster that begins with ``comp`` at density ``birth``."""
        own, now, members = 0.0, set(comp), sorted(mine)
        while True:
            level = lam(members[-1][0])
            kept = [m for m in members if lam(m[0]) > level]
            big = [p for p in parts(now, [(x, y) for _, x, y in kept]) if len(p) >= min_size and any(m[1] in p for m in kept)]
            if len(big) == 1:
                own += (len(now) - len(big[0])) * (level - birth)
                now, members = big[0], [m for m in kept if m[1] in big[0]]
                continue
            own += len(now) * (level - birth)
            below = [tree(p, [m for m in kept if m[1] in p], level) for p in big]
            best = sum(max(s, b) for s, b, _ in below)
            chosen = [frozenset(comp)] if own >= best else [c for _, _, cs in below for c in cs]
            return own, best if below else 0.0, chosen

    forest, label = [], {a: a for a in names}
    for w, x, y in edges:
        if label[x] != label[y]:
            forest.append((w, x, y))
            old = label[y]
            label = {k: label[x] if v == old else v for k, v in label.items()}
    out = set()
    for comp in parts(names, [(x, y) for _, x, y in forest]):
        if len(comp) >= min_size:
            out |= set(tree(comp, [m for m in forest if m[1] in comp], 1.0)[2])
    return out


@pytest.mark.parametrize("piece", [200_000, 12, 2])
def test_hierarchy_splits_a_component_of_two_densities(spark, piece):
    """Two dense groups in one thin component, and a thin group of its own: as brute force finds them, in one task or in many rounds."""
    rng = np.random.RandomState(8)

    def group(angle, spread, n):
        a = angle + spread * rng.normal(size=n)
        return np.stack([np.cos(a), np.sin(a), 0.02 * rng.normal(size=n)], axis=1)

    x = np.concatenate([group(0.0, 0.03, 25), group(0.62, 0.03, 25), np.stack([np.cos([0.19, 0.31, 0.43]), np.sin([0.19, 0.31, 0.43]), np.zeros(3)], axis=1), group(2.2, 0.1, 20), group(4.0, 0.01, 2)])
    names = [f"{i:03d}" for i in range(len(x))]
    df = spark.createDataFrame(list(zip(names, x.tolist())), "id string, vec array<double>")
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    d = np.round((1 - np.round(unit @ unit.T, 9)) / (1 - 0.98), 9)
    np.fill_diagonal(d, 0)
    edges = clusters.distances(clusters.neighbour_graph(df, 0.98, k=len(x)), 0.98)
    many = []
    for min_size, min_samples in ((3, 3), (8, 3), (10, 2)) if piece > 100 else ((3, 3),):
        want = hierarchy_truth(names, d, min_size, min_samples)
        many.append(len(want))
        got: dict = {}
        for r in clusters.stable_members(edges, min_size, min_samples, piece).collect():
            got.setdefault(r.key, set()).add(r.node)
        assert {frozenset(m) for m in got.values()} == want
    flat = {frozenset(r.m) for r in clusters.flat(edges).groupBy("cluster").agg(F.collect_set("id").alias("m")).collect()}
    # At the limit there are two clusters; selection splits the one of two densities.
    assert len(flat) == 2 and max(many) > 2, many


def test_forest_where_edge_hashes_collide(spark, monkeypatch):
    """Edges of one distance whose hashes are alike are told apart by their place in a sort."""
    rng = random.Random(9)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(80)}
    df = spark.createDataFrame([(a, b, 0.5) for a, b in edges], "a long, b long, distance double")
    want = len({x for e in edges for x in e})
    monkeypatch.setattr(clusters.F, "shiftrightunsigned", lambda c, n: F.lit(0).cast("long"))
    forest, members = clusters.spanning_forest(df)
    assert forest.count() == want - members.select("component").distinct().count() and members.count() == want


def test_stable_clusters(spark, points):
    df = spark.createDataFrame(points, "id string, vec array<float>")
    edges = clusters.distances(clusters.neighbour_graph(df, 0.5), 0.5, "s")
    rows = clusters.stable(edges, min_size=8).collect()
    assert 8 <= len(rows) <= 16 and all(r["size"] >= 8 and 1 <= len(r.exemplars) <= 3 and r.cluster.startswith("s/") for r in rows)
    assert sum(r["size"] for r in rows) > 300
    assert clusters.stable(edges.limit(0)).count() == 0
    assert edges.select(clusters.original("a")[1].alias("x")).where(F.length("x") != 5).count() == 0


def test_bridges_check_every_screened_pair():
    """Two true links hidden in a block of screened pairs that are all but these refuted."""

    class Exact:
        def dots(self, a, b):
            return np.where((a < 2) & (b >= 599), 0.9, 0.1)

    x = np.ones((600, 4), dtype=np.float32) / 2
    x[599] *= np.float32(0.9)  # screened lower than all false ones
    p, q, _ = clusters._bridges(Exact(), x, np.arange(600), 0.6, 0.24, 1200)
    label = clusters._roots(600, p, q)
    assert label[0] == label[1] == label[599] and len(np.unique(label)) == 598


def test_windows_do_not_grow_with_the_collection(spark, points, monkeypatch):
    """The same number of vectors is compared with each, however many there are."""
    spans = []
    band = nn.band
    monkeypatch.setattr(nn, "band", lambda n, window: spans.append(window) or band(n, window))
    for n in (100, 400):
        v = nn.Dense(np.array([f"{i:04d}" for i in range(n)], dtype=object), np.array([p[1] for p in points[:n]]))
        v.unit /= np.sqrt((v.unit**2).sum(1))[:, None]
        nn._best(v, v.project(0), 5, 0.5, 1e-5, 5, nn.WINDOW)
    assert spans == [nn.WINDOW] * 2
    assert max(last - first for _, _, first, last in band(100_000, nn.WINDOW)) <= nn.WINDOW + nn.BLOCK


def test_one_direction_is_spread(spark):
    """A third of all vectors points nearly one way, another tenth exactly one way at other lengths: no slot grows beyond twice the others."""
    rng = np.random.RandomState(3)
    n, window = 12_000, 500
    x = rng.normal(size=(n, 16))
    x[: n // 3] = x[0] + 1e-9 * rng.normal(size=(n // 3, 16))
    x[n // 3 : n // 3 + n // 10] = x[-1] * rng.uniform(0.1, 9, size=(n // 10, 1))
    df = spark.createDataFrame([(f"{i:06d}", v.tolist()) for i, v in enumerate(x)], "id string, vec array<double>")
    own, many, total = nn._without_copies(df)
    assert total == n and own.count() < n - n // 10 and many.count() >= 1
    # Without the classes too: the curves' borders alone bound the slots.
    sizes = [r["count"] for r in nn.placed(df, n, window, 2).groupBy("slot").count().collect()]
    assert sum(sizes) == 2 * n and max(sizes) < 2 * nn.SPAN * window and len(sizes) >= 10


def test_sparse_dots_of_long_and_short_rows():
    rng = np.random.RandomState(0)
    terms = [np.sort(rng.choice(3000, k, replace=False)) for k in (2500, 1, 3, 40, 2999)]
    w = [rng.uniform(0, 1, len(t)) for t in terms]
    v = nn.Sparse(np.array(list("abcde"), dtype=object), np.r_[0, np.cumsum([len(t) for t in terms])], np.concatenate(terms), np.concatenate(w))
    v.SPREAD = v.ENTRIES = 4000
    dense = np.zeros((5, 3000))
    for i, (t, x) in enumerate(zip(terms, w)):
        dense[i, t] = x
    a, b = np.repeat(np.arange(5), 5), np.tile(np.arange(5), 5)
    assert np.allclose(v.dots(a, b), (dense @ dense.T).ravel()) and len(v.dots(a[:0], b[:0])) == 0
    back = v.take(np.array([4, 0]))
    assert (back.terms == np.r_[terms[4], terms[0]]).all() and list(back.ids) == ["e", "a"]


def test_best_looks_beyond_the_screened_candidates():
    """The true neighbour is screened lower than more false ones than are looked at first."""

    class Exact:
        ids = np.array([f"{i:03d}" for i in range(200)], dtype=object)

        def dots(self, a, b):
            return np.where((a == 0) & (b == 150) | (a == 150) & (b == 0), 0.9, 0.61)

    x = np.zeros((200, 2), dtype=np.float32)
    x[:, 0] = 1
    x[150] = [0.95, np.sqrt(1 - 0.95**2)]
    a, b, sim = nn._best(Exact(), x, 1, 0.6, 0.24, 2, 400)
    assert (int(b[a == 0][0]), float(sim[a == 0][0])) == (150, 0.9)


@pytest.mark.parametrize("copies", [64, 65])
def test_copies_are_dense_whatever_their_number(spark, copies):
    rows = [(f"h{i:03d}", [1.0, 0.0, 0.0]) for i in range(copies)] + [("x", [0.95, 0.3, 0.0]), ("y", [0.9, 0.0, 0.4])]
    df = spark.createDataFrame(rows, "id string, vec array<double>")
    edges = clusters.distances(clusters.neighbour_graph(df, 0.5, k=3, cores=3), 0.5)
    far = clusters.mutual_reachability(edges, 3)
    own = far.where("a LIKE 'h%' AND b LIKE 'h%'")
    assert own.agg(F.max("distance")).first()[0] == 0
    assert own.select(F.explode(F.array("a", "b")).alias("n")).distinct().count() == copies
    near = far.where("b = 'x' AND a LIKE 'h%'").agg(F.max("distance"), F.count("*")).first()
    assert near[0] < 0.15 and near[1] >= 3
