"""Grouping records into similarity clusters by hierarchical density clustering.

1. Neighbour graph. For a cut at the limit, pairs that connect exactly what all pairs at or above it connect
   (``neighbours.links``). For the hierarchy, the windows of the shifted curves (see ``neighbours``) give each vector its nearest
   ones at or above a similarity limit, and the pairs that join what these leave apart. Each slot passes on
   its nearest pairs and its spanning forest.
2. Mutual reachability: the distance of two vectors is at least the distance of either to its
   ``min_samples``-th nearest one (itself counted), which is at most the limit's. So the graph connects at
   the limit what plain distances do.
3. Minimum spanning forest by distributed Borůvka: every component picks its lightest edge, components
   merge, the graph is contracted; the number of components at least halves in each round. Edge choice
   is a partially combined minimum, so a hub with a third of all edges costs one row per task.
4. Cut at the limit, the forest gives flat clusters (``flat``).
5. Condensed hierarchy: the forest's edges in order of their distance, those of one distance at once,
   merge components; where several have at least ``min_size`` members these clusters end and one begins,
   else the smaller ones' members join. Components are condensed each in one task; larger ones in rounds,
   lightest edges first, whose results are the vertices of the next round, so no task holds more than
   ``PIECE`` edges and the outcome is the same; more edges of one distance are merged by aggregations.
6. A cluster's stability sums its members' densities beyond the one it begins at. A cluster at least as
   stable as the best below it is selected, the topmost first (``stable``); exemplars are the members that
   persist to the greatest density.

The graph of the windows is approximate in that it holds only pairs some window brings together (of sparse vectors with few
that share their leading terms: a whole slot), and of the pairs inside what nearest neighbours connect only
those and a spanning forest: a merge can be seen late, not early. A cut at the limit needs no distances below
it, so its graph is only what connects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import neighbours as nn
from larder.llm.neighbours import roots as _roots
from larder.llm.neighbours import spanning as _spanning
from larder.operators.components import components
from larder.session import Scratch


#: Screened pairs of a block that are listed at once, about.
PAIRS = 200_000
#: Edges of the forest that one task condenses.
PIECE = 200_000
#: Members of a cluster, neighbours (a vector itself is one) that make a place dense, and the distance (1 at the limit) below which places are equally dense.
MIN_SIZE, MIN_SAMPLES, FINEST = 3, 3, 0.05


def _bridges(v, x: np.ndarray, label: np.ndarray, limit: float, off: float, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact pairs at or above the limit that join all components such pairs of a window join.

    One pass over the pairs of rows. Of those of different components whose screened similarity reaches
    ``limit`` less its ``slack``, each row's most similar one is checked exactly first, again as long as that joins
    any, then the others by slices of columns unless they lie in one component by then; none is left out.
    """
    found_a, found_b, found_s = [], [], []

    def check(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return
        sim = np.round(v.dots(i, j), 9)
        ok = sim >= limit
        if not ok.any():
            return
        i, j = i[ok], j[ok]
        found_a.append(i)
        found_b.append(j)
        found_s.append(sim[ok])
        label = _roots(len(x), label[i], label[j])[label]

    for lo, hi, _, last in nn.band(len(x), window):
        s = x[lo:hi] @ x[lo:last].T
        m = len(s)
        high = s >= np.float32(limit - nn.slack(limit, off))
        high &= label[lo:hi, None] != label[None, lo:last]
        high[:, :m] &= np.triu(np.ones((m, m), dtype=bool), 1)
        i = np.flatnonzero(high.any(1))
        while len(i):
            many = len(found_a)
            j = np.where(high[i], s[i], -2).argmax(1)
            high[i, j] = False
            check(i + lo, j + lo)
            if len(found_a) == many:
                break
            high[i] &= label[i + lo, None] != label[None, lo:last]
            i = i[high[i].any(1)]
        if not len(i):
            continue
        wide = max(1, PAIRS // m)
        for at in range(0, high.shape[1], wide):
            i, j = np.nonzero(high[:, at : at + wide])
            check(i + lo, j + lo + at)
    if not found_a:
        none = np.array([], dtype=np.int64)
        return none, none, np.array([])
    return np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_s)


def neighbour_graph(vectors: DataFrame, limit: float, k: int = 5, window: int = nn.WINDOW, curves: int = 4, seed: int = 7, cores: int = MIN_SAMPLES - 1) -> DataFrame:
    """``(a, b, similarity)``, a < b: edges of the neighbour graph at or above ``limit``, each once.

    A slot's edges are each vector's ``cores`` nearest and the spanning forest of its ``k`` nearest and
    of the pairs that join these to what a chain of pairs in a window connects. With ``k`` and ``cores`` 0
    these are only edges that connect what the others do, for a cut at the limit. Large classes of copies
    take part with one member; the others have the class's first ones as neighbours.
    """
    own, many, total = nn._without_copies(vectors)
    sparse = "terms" in vectors.columns
    wide = 2 * k if sparse else k
    kind = nn._id_type(vectors)

    def window_edges(table: pa.Table) -> pa.Table:
        table, v = nn.along(table)
        x = v.screen()
        if sparse:
            lead = v.leading()
            v = nn.Sparse(v.ids, v.starts, v.terms[lead], v.weights[lead])
        # Sparse rows with few that share a leading term meet all those of the slot, the others a window of one another.
        left, p, q, s = nn._few(v, x, limit, window)
        rest = v.take(left) if sparse else v
        a, b, sim = left[:0], left[:0], np.array([])
        if k and len(left):
            a, b, sim = nn._best(rest, rest.own_screen() if sparse else x, k, limit, nn.ROUNDING, wide, window)
            a, b = left[a], left[b]
        if k and len(p):
            a, b, sim = nn._top(v, np.r_[a, p, q], np.r_[b, q, p], np.r_[sim, s, s], k)
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
        near = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < cores
        # Of a row with fewer than k all pairs of the window are among these: only rows with k can have others, with such rows.
        full = np.flatnonzero(np.bincount(a, minlength=len(x))[left] >= k)
        label = np.unique(_roots(len(x), np.r_[a, p], np.r_[b, q])[left[full]], return_inverse=True)[1]
        i, j, t = _bridges(rest.take(full), x[left[full]], label, limit, nn.ROUNDING, window)
        p, q, s = np.r_[p, left[full[i]]], np.r_[q, left[full[j]]], np.r_[s, t]
        a, b, sim, near = np.r_[a, p], np.r_[b, q], np.r_[sim, s], np.r_[near, np.zeros(len(p), dtype=bool)]
        kept = near | _spanning(len(x), a, b, sim)
        a, b, sim = a[kept], b[kept], sim[kept]
        _, once = np.unique(np.minimum(a, b) * len(x) + np.maximum(a, b), return_index=True)
        ids = table.column("id").combine_chunks()
        return pa.table({"p": ids.take(pa.array(a[once])), "q": ids.take(pa.array(b[once])), "similarity": pa.array(sim[once])})

    edges = nn.placed(own, total, window, curves, seed).groupBy("slot").applyInArrow(window_edges, f"p {kind}, q {kind}, similarity double")
    edges = edges.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")
    if many is not None:
        scratch = Scratch(vectors.sparkSession)
        members = vectors.select("id", nn.direction(vectors).alias("h")).distinct().join(many, "h")
        order = Window.partitionBy("h").orderBy("id")
        first = scratch.save(members.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cores + 1).select("h", "rep", F.col("id").alias("m"), "rank"))
        tied = members.join(first.select("h", "m"), "h").where("id <> m").select("id", "m", F.lit(1.0).alias("similarity"))
        edges = scratch.save(edges)
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("rep"), "similarity").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("rep"), "similarity"))
        near = first.where((F.col("rank") <= cores) & (F.col("m") != F.col("rep"))).select("rep", "m")
        tied = tied.unionByName(ends.join(near, "rep").where("id <> m").select("id", "m", "similarity"))
        edges = edges.unionByName(tied.select(F.least("id", "m").alias("a"), F.greatest("id", "m").alias("b"), "similarity"))
    # Neighbours are counted, so a pair found in several slots counts once.
    return edges.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def distances(edges: DataFrame, limit: float, name: str = "") -> DataFrame:
    """``(a, b, d)``: the edges' distances, 0 for equal direction and 1 at the limit.

    With a ``name`` the ends are prefixed by it, so that graphs of several spaces can be united and
    clustered in the same rounds (see ``original``).
    """
    end = lambda c: F.concat(F.lit(f"{name}/"), F.col(c).cast("string")).alias(c) if name else F.col(c)
    return edges.select(end("a"), end("b"), F.round((1 - F.col("similarity")) / (1 - limit), 9).alias("d"))


def original(c: str) -> tuple[Column, Column]:
    """The name and the id of a prefixed end."""
    return F.substring_index(c, "/", 1), F.expr(f"substr({c}, instr({c}, '/') + 1)")


def mutual_reachability(edges: DataFrame, min_samples: int) -> DataFrame:
    """``(a, b, distance)``: distances raised to the core distance of either end.

    A vertex's core distance is that of its ``min_samples``-th nearest in the graph counting itself,
    1 where it has fewer.
    """
    if min_samples <= 1:
        return edges.withColumnRenamed("d", "distance")
    ends = edges.select(F.col("a").alias("node"), "d").unionByName(edges.select(F.col("b").alias("node"), "d"))
    # Spark limits each task to the first rows of every vertex before the shuffle: a hub stays small.
    near = ends.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("d"))).where(F.col("rank") <= min_samples - 1)
    # Joined to both ends: written once, or it would be computed twice.
    core = Scratch(edges.sparkSession).save(near.groupBy("node").agg(F.when(F.count("*") >= min_samples - 1, F.max("d")).otherwise(F.lit(1.0)).alias("core")))
    of = lambda end: core.select(F.col("node").alias(end), F.col("core").alias(f"core_{end}"))
    return edges.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("distance"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest ``(a, b, distance)`` and components ``(node, component)`` of ``edges``; the component is its smallest vertex."""
    scratch = Scratch(edges.sparkSession)
    chosen, roots, nodes = _forest(edges.withColumnRenamed("distance", "d"), 1, scratch)
    name = lambda c, end: nodes.select(F.col("node").alias(c), F.col("name").alias(end))
    forest = chosen.join(name("u", "x"), "u").join(name("v", "y"), "v").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    return forest, _named(roots, nodes, scratch)


def _named(roots: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` by name of ``(node, root)`` by number."""
    named = scratch.save(roots.join(nodes, "node").select("name", "root"))
    least = named.groupBy("root").agg(F.min("name").alias("component"))
    return named.join(least, "root").select(F.col("name").alias("node"), "component")


def _forest(edges: DataFrame, min_samples: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Minimum spanning forest of the mutual reachability of ``edges`` (a, b, d) by Borůvka: its edges ``(e, u, v, distance)``, ``(node, root)`` of all vertices, and their ``(node, name)``.

    Vertices are named by 64-bit hashes, of a seed under which no two collide, and edges by their distance
    (0 to 1, in billionths) followed by 33 bits of a hash of their ends; where two of one distance collide
    (very many copies), by their place in one global sort instead. So the rounds handle nothing but long
    integers, and ties are broken alike everywhere: the forest is unique. No edges give no rows.
    """
    edges = scratch.save(edges.select("a", "b", "d"))
    seed = 0
    while True:
        h = lambda c: F.xxhash64(F.lit(seed), F.col(c))  # noqa: E731, B023
        ends = edges.select(h("a").alias("node"), F.col("a").alias("name")).unionByName(edges.select(h("b").alias("node"), F.col("b").alias("name")))
        nodes = scratch.save(ends.distinct())
        if nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
        seed += 1
    coded = scratch.save(edges.groupBy(F.least(h("a"), h("b")).alias("a"), F.greatest(h("a"), h("b")).alias("b")).agg(F.min("d").alias("d")))
    far = mutual_reachability(coded, min_samples).select(F.col("a").alias("u"), F.col("b").alias("v"), "distance")
    far = scratch.save(far) if min_samples > 1 else far
    tie = F.shiftrightunsigned(F.xxhash64("u", "v"), 31)
    ranked = scratch.save(far.select((F.shiftleft(F.floor(F.col("distance") * 1e9 + 0.5), 33) + tie).alias("e"), "u", "v", "distance"))
    if not ranked.groupBy("e").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        ranked = scratch.save(far.orderBy("distance", "u", "v").select(F.monotonically_increasing_id().alias("e"), "u", "v", "distance"))
    live = ranked.select("e", "u", "v")
    held: DataFrame | None = None
    parts: list[DataFrame] = []
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.select(F.col("u").alias("node"), "e").unionByName(live.select(F.col("v").alias("node"), "e"))
        best = both.groupBy("node").agg(F.min("e").alias("e"))
        picked = scratch.save(best.join(live, "e").select("node", "e", F.when(F.col("u") == F.col("node"), F.col("v")).otherwise(F.col("u")).alias("to")))
        parts.append(picked.select("e"))
        # Two components that pick the same edge: the smaller one is the root of their tree.
        back = picked.select(F.col("node").alias("to"), F.col("to").alias("again"))
        parent = picked.join(back, "to").select("node", F.when((F.col("again") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("root"))
        roots = scratch.save(_jump(scratch.save(parent), scratch))
        maps.append(roots)
        up = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
        joined = live.join(up("u"), "u").join(up("v"), "v").where("ru <> rv")
        nxt = scratch.save(joined.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min("e").alias("e")))
        if held is not None:
            scratch.drop(held)
        held = live = nxt
    if not parts:
        return ranked, ranked.select(F.col("u").alias("node"), F.col("v").alias("root")), nodes
    chosen = parts[0]
    for part in parts[1:]:
        chosen = chosen.unionByName(part)
    total = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = total.select(F.col("node").alias("root"), F.col("root").alias("final"))
        total = earlier.join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root"))
    return ranked.join(chosen.distinct(), "e", "left_semi"), total, nodes


def _jump(parent: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)``: pointers followed to their ends, two doublings a step."""
    while True:
        once = parent.join(parent.select(F.col("node").alias("root"), F.col("root").alias("h1")), "root")
        twice = once.select("node", F.col("root").alias("r0"), F.col("h1").alias("root")).join(parent.select(F.col("node").alias("root"), F.col("root").alias("h2")), "root")
        done = scratch.save(twice.select("node", F.col("h2").alias("root"), (F.col("h2") != F.col("r0")).alias("moved")))
        if done.where("moved").isEmpty():
            return done.select("node", "root")
        parent = done.select("node", "root")


def flat(edges: DataFrame, min_size: int = MIN_SIZE, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """``(cluster, id)``: the trees of the spanning forest of mutual reachability, cut at the limit, of at least ``min_size``, named by their smallest member."""
    scratch = Scratch(edges.sparkSession)
    # Mutual reachability raises no distance beyond the limit, so its trees cut there are those of the plain distances, whatever ``min_samples`` is.
    _, roots, nodes = _forest(edges, 1, scratch)
    # The graph ends at the limit, and so does its forest: cutting it there leaves whole trees.
    members = _named(roots, nodes, scratch)
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return members.join(sizes.select("component"), "component").select(F.col("component").alias("cluster"), F.col("node").alias("id"))


def condense(e: list[int], u: list[int], v: list[int], lam: list[float], states: dict[int, tuple], min_size: int) -> tuple[list, list, dict[int, tuple]]:
    """Merges vertices along edges of falling density ``lam``, those of one density at once: (points, clusters, states left).

    A state is (size, open cluster or None, sum of its members' densities, best stability below it,
    members not yet in a cluster); a vertex without one is a single member. Points are (member, cluster it
    joins first, density), clusters that end (cluster, parent, stability, best below it). A cluster is
    named by the least edge it begins with.
    """
    at: dict[int, int] = {}
    size: list[int] = []
    open_: list[int | None] = []
    total: list[float] = []
    below: list[float] = []
    loose: list[list[int]] = []
    up: list[int] = []
    for x in (*u, *v, *states):
        if x not in at:
            at[x] = len(up)
            n, c, t, k, members = states.get(x, (1, None, 0.0, 0.0, [x]))
            up.append(len(up))
            size.append(n)
            open_.append(c)
            total.append(t)
            below.append(k)
            loose.append(list(members))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    points, ended = [], []
    first = 0
    while first < len(e):
        # All edges of one density at once: the outcome doesn't depend on their order.
        dense, last = lam[first], first
        groups: dict[int, list[int]] = {}
        begun: dict[int, int] = {}
        while last < len(e) and lam[last] == dense:
            a, b = root(at[u[last]]), root(at[v[last]])
            if len(groups.get(a, "1")) < len(groups.get(b, "1")):
                a, b = b, a
            groups.setdefault(a, [a]).extend(groups.pop(b, [b]))
            begun[a] = min(begun.pop(b, e[last]), begun.get(a, e[last]))
            up[b] = a
            last += 1
        first = last
        for top, parts in groups.items():
            whole = sum(size[i] for i in parts)
            big = [i for i in parts if open_[i] is not None]
            joined = [p for i in parts for p in loose[i]]
            if len(big) == 1:
                state = (open_[big[0]], total[big[0]] + (whole - size[big[0]]) * dense, below[big[0]])
            elif big or whole >= min_size:
                ended += [(open_[i], begun[top], total[i] - size[i] * dense, below[i]) for i in big]
                state = (begun[top], whole * dense, sum(max(total[i] - size[i] * dense, below[i]) for i in big))
            else:
                state = (None, 0.0, 0.0)
            for i in parts:
                loose[i] = []
            if state[0] is None:
                loose[top] = joined
            else:
                points += [(p, state[0], dense) for p in joined]
            size[top] = whole
            open_[top], total[top], below[top] = state
    left = {}
    names = {i: x for x, i in at.items()}
    for i in range(len(up)):
        if up[i] == i:
            left[names[i]] = (size[i], open_[i], total[i], below[i], loose[i])
    return points, ended, left


_CONDENSED = "kind string, piece long, node long, cluster long, parent long, lam double, below double, size long, loose array<long>"


def _condense_pieces(edges: DataFrame, states: DataFrame | None, min_size: int, last: bool) -> DataFrame:
    """``condense`` on every ``piece`` of ``edges`` (piece, e, u, v, lam) and ``states``; in the last round clusters left open end at density 1."""
    rows = edges.select("piece", F.lit("E").alias("kind"), F.col("e").alias("node"), F.col("u").alias("cluster"), F.col("v").alias("parent"), "lam", F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("array<long>").alias("loose"))
    if states is not None:
        rows = rows.unionByName(states.withColumn("kind", F.lit("S")))

    def run(t: pa.Table) -> pa.Table:
        kinds = t.column("kind").to_pylist()
        cols = {c: t.column(c).to_pylist() for c in ("piece", "node", "cluster", "parent", "lam", "below", "size", "loose")}
        given = {cols["node"][i]: (cols["size"][i], cols["cluster"][i], cols["lam"][i], cols["below"][i], cols["loose"][i]) for i, k in enumerate(kinds) if k == "S"}
        order = sorted((i for i, k in enumerate(kinds) if k == "E"), key=cols["node"].__getitem__)
        points, ended, left = condense(*[[cols[c][i] for i in order] for c in ("node", "cluster", "parent", "lam")], given, min_size)
        out = [("P", None, p, c, None, lam, None, None, None) for p, c, lam in points] + [("C", None, None, c, parent, own, best, None, None) for c, parent, own, best in ended]
        for x, (n, c, total, best, members) in left.items():
            if not last:
                out.append(("S", cols["piece"][0], x, c, None, total, best, n, members))
            elif c is not None:
                out.append(("C", None, None, c, None, total - n, best, None, None))
        names = ("kind", "piece", "node", "cluster", "parent", "lam", "below", "size", "loose")
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))
        return pa.table({n: pa.array(list(c), type=k) for n, k, c in zip(names, types, zip(*out) if out else ((),) * len(names))})

    return rows.groupBy("piece").applyInArrow(run, _CONDENSED)


def _level(edges: DataFrame, pieces: DataFrame, states: DataFrame | None, lam: float, min_size: int) -> DataFrame:
    """``condense`` along ``edges`` (piece, e, u, v) of one density by aggregations alone, for however many of them join one piece; ``pieces`` has (node, piece)."""
    if states is None:
        own = pieces.withColumns({"cluster": F.lit(None).cast("long"), "lam": F.lit(0.0), "below": F.lit(0.0), "size": F.lit(1).cast("long"), "loose": F.array("node")})
    else:
        own = pieces.join(states.drop("piece"), "node", "left").withColumns({
            "lam": F.coalesce("lam", F.lit(0.0)), "below": F.coalesce("below", F.lit(0.0)), "loose": F.when(F.col("size").isNull(), F.array("node")).otherwise(F.col("loose")), "size": F.coalesce("size", F.lit(1))})
    names = edges.groupBy("piece").agg(F.min("e").alias("name"))
    ends = F.col("lam") - F.col("size") * lam
    per = own.groupBy("piece").agg(
        F.sum("size").alias("whole"), F.count("cluster").alias("big"), F.max("cluster").alias("one"), F.sum(F.when(F.col("cluster").isNotNull(), F.col("lam"))).alias("total"),
        F.sum(F.when(F.col("cluster").isNotNull(), F.col("size"))).alias("inner"), F.sum(F.when(F.col("cluster").isNotNull(), F.greatest(ends, "below"))).alias("best"), F.max("below").alias("kept"))
    one, begins = F.col("big") == 1, (F.col("big") > 1) | (F.col("whole") >= min_size)
    per = per.join(names, "piece").select(
        "piece", "whole", "big", F.when(one, F.col("one")).when(begins, F.col("name")).alias("now"), F.when(one, F.col("total") + (F.col("whole") - F.col("inner")) * lam).when(begins, F.col("whole") * lam).otherwise(0.0).alias("mass"),
        F.when(one, F.col("kept")).when(F.col("big") > 1, F.col("best")).otherwise(0.0).alias("under"))
    full = own.join(per, "piece")
    null = lambda kind: F.lit(None).cast(kind)
    points = full.where("now IS NOT NULL").select(F.lit("P").alias("kind"), null("long").alias("piece"), F.explode("loose").alias("node"), F.col("now").alias("cluster"), null("long").alias("parent"), F.lit(lam).alias("lam"), null("double").alias("below"), null("long").alias("size"), null("array<long>").alias("loose"))
    ended = full.where("big > 1 AND cluster IS NOT NULL").select(F.lit("C").alias("kind"), null("long").alias("piece"), null("long").alias("node"), "cluster", F.col("now").alias("parent"), ends.alias("lam"), "below", null("long").alias("size"), null("array<long>").alias("loose"))
    # Fewer than ``min_size`` members are left loose in a piece.
    small = full.where("now IS NULL").groupBy("piece").agg(F.flatten(F.collect_list("loose")).alias("loose"))
    left = per.join(small, "piece", "left").select(F.lit("S").alias("kind"), "piece", F.col("piece").alias("node"), F.col("now").alias("cluster"), null("long").alias("parent"), F.col("mass").alias("lam"), F.col("under").alias("below"), F.col("whole").alias("size"), F.coalesce("loose", F.array().cast("array<long>")).alias("loose"))
    return points.unionByName(ended).unionByName(left)


def condensed(forest: DataFrame, roots: DataFrame, scratch: Scratch, min_size: int, piece: int) -> tuple[DataFrame, DataFrame]:
    """Points ``(node, cluster, lam)`` and clusters ``(cluster, parent, own, below)`` of the condensed hierarchy of a forest ``(e, u, v, distance)`` with ``(node, root)``."""
    lam = 1 / F.greatest("distance", F.lit(FINEST))
    live = scratch.save(forest.join(roots.select(F.col("node").alias("u"), "root"), "u").select(F.col("root").alias("component"), "e", "u", "v", lam.alias("lam")))
    states: DataFrame | None = None
    done: list[DataFrame] = []
    while True:
        # Only components too large for a task (each has more than ``piece`` edges) take more rounds.
        large = scratch.save(live.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > piece))
        if large.isEmpty():
            break
        inside = live.join(large.select("component"), "component", "left_semi")
        part = 2
        while True:
            cut, top = inside.agg(F.percentile_approx("lam", 1 - 1 / part, 1000), F.max("lam")).first()
            light = inside.where(F.col("lam") >= cut)
            pieces = scratch.save(components(light, "u", "v")).select("node", F.col("component").alias("piece"))
            ready = scratch.save(light.join(pieces.withColumnRenamed("node", "u"), "u").select("piece", "e", "u", "v", "lam"))
            fits = ready.groupBy("piece").count().where(F.col("count") > piece).isEmpty()
            if fits or cut == top:
                break
            part = part * 4
        taken = states.drop("piece").join(pieces, "node") if states is not None else None
        got = scratch.save(_condense_pieces(ready, taken, min_size, last=False) if fits else _level(ready, pieces, states, top, min_size))
        done.append(got)
        # A piece goes on under the name of its smallest vertex.
        fresh = got.where("kind = 'S'").withColumn("node", F.col("piece")).drop("kind")
        states = scratch.save(fresh if states is None else fresh.unionByName(states.join(pieces, "node", "left_anti")))
        rest = live.join(ready.select("e"), "e", "left_anti")
        to = lambda end: pieces.select(F.col("node").alias(end), F.col("piece").alias(f"{end}_to"))  # noqa: E731, B023
        live = scratch.save(rest.join(to("u"), "u", "left").join(to("v"), "v", "left").select("component", "e", F.coalesce("u_to", "u").alias("u"), F.coalesce("v_to", "v").alias("v"), "lam"))
    if states is not None:
        states = states.drop("piece").join(roots.select("node", F.col("root").alias("piece")), "node")
    done.append(scratch.save(_condense_pieces(live.withColumnRenamed("component", "piece"), states, min_size, last=True)))
    every = done[0]
    for got in done[1:]:
        every = every.unionByName(got)
    return (every.where("kind = 'P'").select("node", "cluster", "lam"),
            every.where("kind = 'C'").select("cluster", "parent", F.col("lam").alias("own"), "below"))


def selected(clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """``(cluster, top)``: the topmost cluster on the way up from each (itself included) that is at least as stable as the best below it.

    Ways are followed by doubling: a path of N clusters takes log N rounds.
    """
    now = scratch.save(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("own") >= F.col("below"), F.col("cluster")).alias("top")))
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("top").alias("higher"))
        step = scratch.save(now.join(above, "up", "left").select("cluster", F.col("next").alias("up"), F.coalesce("higher", "top").alias("top")))
        scratch.drop(now)
        now = step
    return now.where("top IS NOT NULL").select("cluster", "top")


def stable(edges: DataFrame, min_size: int = MIN_SIZE, min_samples: int = MIN_SAMPLES, exemplars: int = 3, piece: int = PIECE) -> DataFrame:
    """``(cluster, size, exemplars)``: the most stable clusters of the condensed hierarchy of ``distances``.

    ``cluster`` is its smallest member, ``exemplars`` its most persistent members (ties: the smaller id).
    Vertices in no selected cluster are noise. ``piece`` bounds a task and changes nothing in the result.
    """
    scratch = Scratch(edges.sparkSession)
    members = stable_members(edges, min_size, min_samples, piece, scratch)
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("lam").desc(), "node"))).where(F.col("rank") <= exemplars)
    typical = ranked.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]).alias("exemplars"))
    return members.groupBy("key").agg(F.min("node").alias("cluster"), F.count("*").alias("size")).join(typical, "key").select("cluster", "size", "exemplars")


def stable_members(edges: DataFrame, min_size: int = MIN_SIZE, min_samples: int = MIN_SAMPLES, piece: int = PIECE, scratch: Scratch | None = None) -> DataFrame:
    """``(key, node, lam)``: the members of the selected clusters and the density they join at."""
    scratch = scratch or Scratch(edges.sparkSession)
    forest, roots, nodes = _forest(edges, min_samples, scratch)
    points, clusters = condensed(forest, scratch.save(roots), scratch, min_size, piece)
    tops = selected(clusters, scratch)
    return scratch.save(points.join(tops, "cluster").join(nodes, "node").select(F.col("top").alias("key"), F.col("name").alias("node"), "lam"))
