"""Dense geometry: exact neighbours of a query set, k-means, silhouette, principal components, projections for display."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import Scratch

#: Queries and rows of a block pair that one task compares.
BLOCK = 4096
#: Largest number of centres that is sent to the tasks; more are an error.
MAX_CENTRES = 10_000


def _grid(left: DataFrame, right: DataFrame, rows: int, columns: int) -> DataFrame:
    """``left`` (id, vec, …) and ``right`` in the cells ``cell`` of a grid of blocks: every left block meets every right block once; ``side`` tells them apart."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    a = left.withColumn("_i", block(rows)).withColumn("_j", every(columns)).withColumn("side", F.lit(0))
    b = right.withColumn("_j", block(columns)).withColumn("_i", every(rows)).withColumn("side", F.lit(1))
    return a.unionByName(b).withColumn("cell", F.col("_i") * F.lit(columns) + F.col("_j")).drop("_i", "_j")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def dense_neighbours(vectors: DataFrame, queries: DataFrame, limit: int = 5, id: str = "id", vec: str = "vec") -> DataFrame:
    """``(query, neighbour, cosine, rank)``: the exact nearest rows of a query set (or of all rows), against all rows, in blocks.

    Blocks of queries and of rows form a grid; a cell is one task with a matrix product, which passes on
    its ``limit`` best a query. Nothing is gathered on the driver. Ties go to the smaller id; null
    vectors take no part.
    """
    kind = dict(vectors.dtypes)[id]
    q, r = (df.select(F.col(id).alias("id"), F.col(vec).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL") for df in (queries, vectors))
    cells = _grid(q, r, max(1, math.ceil(q.count() / BLOCK)), max(1, math.ceil(r.count() / BLOCK)))

    def best(table: pd.DataFrame) -> pd.DataFrame:
        a, b = table[table.side == 0], table[table.side == 1].sort_values("id", kind="stable")
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "neighbour": [], "cosine": []})
        x, y = _matrix(a.vec), _matrix(b.vec)
        x, y = (m / np.where((n := np.sqrt((m * m).sum(1, keepdims=True))) > 0, n, 1) for m in (x, y))
        names, others = a.id.to_numpy(), b.id.to_numpy()
        out = []
        for lo in range(0, len(x), 512):
            s = np.round(x[lo : lo + 512] @ y.T, 6)
            s[names[lo : lo + 512, None] == others[None, :]] = -np.inf
            k = min(limit, s.shape[1])
            i, j = np.nonzero((s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]) & (s > -np.inf))
            order = np.lexsort((j, -s[i, j], i))
            i, j = i[order], j[order]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pd.DataFrame({"query": names[lo + i[top]], "neighbour": others[j[top]], "cosine": s[i[top], j[top]]}))
        return pd.concat(out)

    near = cells.groupBy("cell").applyInPandas(best, f"query {kind}, neighbour {kind}, cosine double")
    order = Window.partitionBy("query").orderBy(F.col("cosine").desc(), "neighbour")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _centres(points: DataFrame, label: str, dimension: int, vec: str = "vec") -> DataFrame:
    return points.groupBy(label).agg(F.count("*").alias("size"), F.array(*[F.avg(F.col(vec)[i]) for i in range(dimension)]).alias("centre"))


def assign(points: DataFrame, centres: list[tuple[int, list[float]]], vec: str = "vec") -> DataFrame:
    """``points`` with the nearest centre's ``label`` (ties: the smaller) and squared ``distance``; at most thousands of centres."""
    fixed = np.array([c for _, c in centres])
    names = np.array([l for l, _ in centres])

    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in part]) if len(part) else np.zeros((0, fixed.shape[1]))
            d = np.stack([((x - c) ** 2).sum(1) for c in fixed], axis=1)
            at = d.argmin(1) if len(x) else np.array([], dtype=int)
            yield pd.DataFrame({"label": names[at], "distance": d[np.arange(len(x)), at]})

    udf = F.pandas_udf(nearest, "label int, distance double")
    return points.withColumn("_a", udf(F.col(vec))).select("*", F.col("_a.label").alias("label"), F.col("_a.distance").alias("distance")).drop("_a")


def lloyd_step(points: DataFrame, centres: DataFrame, dimension: int) -> DataFrame:
    """``(label, size, centre)`` after one round of assignment to ``centres`` (label, centre) and averaging."""
    known = [(r["label"], r["centre"]) for r in centres.select("label", "centre").limit(MAX_CENTRES + 1).collect()]
    if len(known) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    return _centres(assign(points.select("id", "vec"), sorted(known)), "label", dimension)


def kmeans(points: DataFrame, k: int, dimension: int, *, restarts: int = 4, rounds: int = 50, seed: int = 42, id: str = "id") -> tuple[DataFrame, float]:
    """``(id, label)`` and inertia of the best of ``restarts`` runs on unit vectors ``(id, vec)``.

    Seeding is k-means++ over the distributed points: each next seed is the row with the greatest
    D^2-weighted exponential key, a single maximum over all rows. An empty cluster takes the farthest
    point. Labels are renumbered by their smallest member. k is clamped to [1, N]; no points give no rows.
    """
    scratch = Scratch(points.sparkSession)
    points = scratch.save(points.select(F.col(id).alias("id"), "vec"))
    n = points.count()
    if not n:
        return points.select("id", F.lit(0).alias("label")), 0.0
    k = max(1, min(k, n))
    best: tuple[float, DataFrame] | None = None
    for r in range(max(1, restarts)):
        rng = random.Random(seed + r)
        salt = rng.getrandbits(32)
        u = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 52)) / float(1 << 52)
        chosen = [points.select("vec", u.alias("u"), "id").orderBy(F.col("u").desc(), "id").first()["vec"]]
        while len(chosen) < k:
            far = assign(points, list(enumerate(chosen)))
            v = F.pmod(F.xxhash64(F.lit(salt + len(chosen)), "id"), F.lit(1 << 52)) / float(1 << 52)
            chosen.append(far.select("vec", F.when(F.col("distance") > 0, F.log(v + 1e-18) / F.col("distance")).otherwise(F.lit(float("-inf"))).alias("w"), "id").orderBy(F.col("w").desc(), "id").first()["vec"])
        centres = [list(map(float, c)) for c in chosen]
        last = None
        for _ in range(rounds):
            labeled = assign(points, list(enumerate(centres)))
            rows = _centres(labeled, "label", dimension).collect()  # k rows
            new = list(centres)
            for row in rows:
                new[row["label"]] = row["centre"]
            empty = sorted(set(range(k)) - {row["label"] for row in rows})
            for label, row in zip(empty, labeled.orderBy(F.col("distance").desc(), F.col("id").desc()).select("vec").take(len(empty))):
                new[label] = list(map(float, row["vec"]))
            moved = max(abs(a - b) for x, y in zip(new, centres) for a, b in zip(x, y))
            centres = new
            if moved < 1e-9 or last == moved == 0:
                break
            last = moved
        final = assign(points, list(enumerate(centres)))
        inertia = final.agg(F.sum("distance")).first()[0]
        if best is None or inertia < best[0] - 1e-12:
            best = (inertia, scratch.save(final.select("id", "label")))
    first = best[1].groupBy("label").agg(F.min("id").alias("least"))
    order = {r["label"]: i for i, r in enumerate(first.orderBy("least").collect())}  # k rows
    renamed = F.create_map(*[F.lit(x) for p in order.items() for x in p])
    return best[1].select("id", renamed[F.col("label")].alias("label")), best[0]


def silhouette(points: DataFrame, labels: int | None = None, id: str = "id", vec: str = "vec", label: str = "label") -> DataFrame:
    """``(id, silhouette)`` with Euclidean distances, exact: singletons 0, fewer than two groups 0.

    Every point meets every other in blocks: points are cut into B groups, each pair of groups is one
    task with a matrix product that passes on, per point and label, a sum of distances. This is the
    quadratic definition; ``simplified_silhouette`` is linear.
    """
    scratch = Scratch(points.sparkSession)
    pts = scratch.save(points.select(F.col(id).alias("id"), F.col(vec).alias("vec"), F.col(label).alias("label")))
    n = pts.count()
    sizes = pts.groupBy("label").agg(F.count("*").alias("size"))
    if sizes.count() < 2:
        return pts.select("id", F.lit(0.0).alias("silhouette"))
    blocks = max(1, math.ceil(n / 2000))
    cells = _grid(pts, pts, blocks, blocks)
    kind, lkind = dict(pts.dtypes)["id"], dict(pts.dtypes)["label"]

    def sums(table: pd.DataFrame) -> pd.DataFrame:
        a, b = table[table.side == 0], table[table.side == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "other": [], "total": []})
        x, y = _matrix(a.vec), _matrix(b.vec)
        d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))
        d[a.id.to_numpy()[:, None] == b.id.to_numpy()[None]] = 0
        names = np.unique(b.label.to_numpy())
        per = np.stack([d[:, b.label.to_numpy() == m].sum(1) for m in names], axis=1)
        return pd.DataFrame({"id": np.repeat(a.id.to_numpy(), len(names)), "other": np.tile(names, len(a)), "total": per.ravel()})

    totals = cells.groupBy("cell").applyInPandas(sums, f"id {kind}, other {lkind}, total double").groupBy("id", "other").agg(F.sum("total").alias("total"))
    joined = totals.join(sizes.select(F.col("label").alias("other"), "size"), "other").join(pts.select("id", "label"), "id")
    own = F.max(F.when(F.col("other") == F.col("label"), F.when(F.col("size") > 1, F.col("total") / (F.col("size") - 1)).otherwise(F.lit(-1.0))))
    near = F.min(F.when(F.col("other") != F.col("label"), F.col("total") / F.col("size")))
    per = joined.groupBy("id").agg(own.alias("a"), near.alias("b"))
    return per.select("id", F.when(F.col("a") < 0, 0.0).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(F.lit(0.0)).alias("silhouette"))


def simplified_silhouette(points: DataFrame, dimension: int, id: str = "id", vec: str = "vec", label: str = "label") -> DataFrame:
    """``(id, silhouette)`` from the distances to the clusters' means instead of to all members: one pass.

    Singletons 0, fewer than two groups 0.
    """
    centres = _centres(points, label, dimension, vec).limit(MAX_CENTRES + 1).collect()
    if len(centres) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    if len(centres) < 2:
        return points.select(F.col(id).alias("id"), F.lit(0.0).alias("silhouette"))
    names = {r[label]: i for i, r in enumerate(centres)}
    fixed, sizes = np.array([r["centre"] for r in centres]), np.array([r["size"] for r in centres])

    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, labels in parts:
            x, own = _matrix(vectors), np.array([names[l] for l in labels])
            d = np.sqrt(np.stack([((x - c) ** 2).sum(1) for c in fixed], axis=1))
            a = d[np.arange(len(x)), own]
            d[np.arange(len(x)), own] = np.inf
            b = d.min(1)
            most = np.maximum(a, b)
            yield pd.Series(np.where((sizes[own] > 1) & (most > 0), (b - a) / np.where(most > 0, most, 1), 0.0))

    return points.select(F.col(id).alias("id"), F.pandas_udf(score, "double")(vec, label).alias("silhouette"))


#: Points up to which the silhouette over all pairs chooses the number of clusters; beyond, the linear one does.
EXACT_SILHOUETTE = 20_000


def mean_silhouette(points: DataFrame, labels: DataFrame, dimension: int, n: int) -> float:
    labeled = points.join(labels, "id")
    each = silhouette(labeled) if n <= EXACT_SILHOUETTE else simplified_silhouette(labeled, dimension)
    return each.agg(F.avg("silhouette")).first()[0]


def select_cluster_count(points: DataFrame, dimension: int, *, most: int = 8, restarts: int = 4, rounds: int = 50, seed: int = 42) -> tuple[int, DataFrame, float]:
    """The k of 2..``most`` with the greatest mean silhouette (ties: the smaller), its labels and score.

    The silhouette over all pairs is quadratic; collections beyond ``EXACT_SILHOUETTE`` points use the
    simplified one, which is linear.
    """
    n = points.count()
    if n <= 1:
        return n, points.select("id", F.lit(0).alias("label")), 0.0
    best = None
    for k in range(2, max(2, min(most, n - 1)) + 1):
        labels, _ = kmeans(points, k, dimension, restarts=restarts, rounds=rounds, seed=seed + 100 * k)
        score = mean_silhouette(points, labels, dimension, n)
        if best is None or score > best[2] + 1e-12:
            best = (k, labels, score)
    return best


def principal_scores(points: DataFrame, dimension: int, components: int = 3, rounds: int = 60) -> DataFrame:
    """``(id, scores)`` on the leading principal components, by power iteration from all ones with deflation.

    The covariance is one pass: sums of outer products per batch, combined by a sum over batches, so
    each task returns dimension squared numbers whatever it reads. Iteration is on that matrix.
    A single point or no variance gives zeros.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(dimension), np.zeros((dimension, dimension))
        for batch in batches:
            if len(batch):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in batch["vec"]])
                n, s, q = n + len(x), s + x.sum(0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "q": [q.ravel()]})

    # One row per task, added up on the driver in a stream.
    n, s, q = 0, np.zeros(dimension), np.zeros((dimension, dimension))
    for r in points.select("vec").mapInPandas(moments, "n long, s array<double>, q array<double>").toLocalIterator():
        n, s, q = n + r["n"], s + np.array(r["s"]), q + np.array(r["q"]).reshape(dimension, dimension)
    mean = s / max(1, n)
    cov = (q - n * np.outer(mean, mean)) / max(1, n - 1)
    axes = []
    for _ in range(components):
        v = np.ones(dimension) / math.sqrt(dimension)
        for _ in range(rounds):
            w = cov @ v
            norm = float(np.sqrt(w @ w))
            if norm < 1e-15 or n <= 1:
                v = np.zeros(dimension)
                break
            v = w / norm
        axes.append(v)
        cov = cov - np.outer(v, v @ cov) - np.outer(cov @ v, v) + (v @ cov @ v) * np.outer(v, v)
    frame, centre = np.array(axes), mean

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([list((np.asarray(v, dtype=np.float64) - centre) @ frame.T) for v in part])

    return points.select("id", F.pandas_udf(score, "array<double>")("vec").alias("scores"))


def scaled_axes(points: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [-1, 1] by their extremes; a constant column becomes 0. The extremes are one row, broadcast."""
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = points.crossJoin(F.broadcast(ends))  # one row
    return joined.select(*[c for c in points.columns if c not in columns], *[
        F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), 2 * (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")) - 1).otherwise(F.lit(0.0)).alias(c) for c in columns])


# Canvas, rotation about x and y, and depth of the projection.
WIDTH, HEIGHT, ANGLE_X, ANGLE_Y = 960, 620, -0.55, 0.75


def perspective(points: DataFrame) -> DataFrame:
    """``points`` (x, y, z in [-1, 1]) with canvas coordinates ``u``, ``v`` and ``depth``."""
    y1 = F.col("y") * math.cos(ANGLE_X) - F.col("z") * math.sin(ANGLE_X)
    z1 = F.col("y") * math.sin(ANGLE_X) + F.col("z") * math.cos(ANGLE_X)
    x2 = F.col("x") * math.cos(ANGLE_Y) + z1 * math.sin(ANGLE_Y)
    z2 = z1 * math.cos(ANGLE_Y) - F.col("x") * math.sin(ANGLE_Y)
    scale = min(WIDTH, HEIGHT) * 0.40 * 0.84 / (1.8 - z2 * 0.38)
    return points.withColumns({"u": WIDTH * 0.43 + x2 * scale, "v": HEIGHT * 0.56 + y1 * scale, "depth": z2})
