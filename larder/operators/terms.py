"""Term statistics: frequencies, inverse document frequencies, weights, norms, sparse neighbours."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import Scratch, stored

#: Documents of a block that queries are compared with at once.
LIST = 8192
#: Queries of a task at most, and tasks few queries are cut into.
QUERIES, TASKS = 512, 16
#: Share of the queries beyond which a term is multiplied as a matrix, and products of others held at once.
HOT, PRODUCTS = 0.04, 4_000_000
#: How far a screened cosine may be off, rounding to six decimals included, and candidates of a query beyond which the best are sought first.
SCREENED, CROWD = 2e-6, 64


def frequencies(docs: DataFrame, key: str = "key", tokens: str = "tokens") -> DataFrame:
    """``(key, term, tf)``, combined before the shuffle."""
    return docs.select(F.col(key).alias("key"), F.explode(tokens).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def idf(tf: DataFrame, docs: DataFrame) -> DataFrame:
    """``(term, df, idf)`` with idf = ln(N / df), unsmoothed; documents without terms count in N."""
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))  # one row


def weights(docs: DataFrame, key: str = "key", tokens: str = "tokens") -> DataFrame:
    """``(key, term, tf, idf, tfidf)`` of all terms of all documents: two shuffles, by document and term, and by term."""
    tf = frequencies(docs, key, tokens)
    return tf.join(idf(tf, docs), "term").select("key", "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def top_terms(weighted: DataFrame, limit: int = 8) -> DataFrame:
    """The ``limit`` leading terms of each document by weight, then frequency, then term."""
    order = Window.partitionBy("key").orderBy(F.round("tfidf", 9).desc(), F.col("tf").desc(), "term")
    return weighted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def top_tokens(tf: DataFrame, limit: int = 8) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.col("tf").desc(), "term")
    return tf.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def norms(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("norm"))


def normalized(weighted: DataFrame) -> DataFrame:
    """L2-normalised weights; a zero vector stays zero."""
    n = norms(weighted)
    return weighted.join(n, "key").select("key", "term", F.when(F.col("norm") > 0, F.col("tfidf") / F.col("norm")).otherwise(F.lit(0.0)).alias("w"))


def _entries(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the entries of a list of structs; null lists have none."""
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), lengths), flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


class _Queries:
    """Some documents that look for their ``limit`` most similar ones, so far."""

    def __init__(self, keys: pa.Array, entries: pa.ListArray, limit: int):
        rows, terms, weights = _entries(entries)
        self.keys, self.limit, n = np.array(keys.to_pylist(), dtype=object), limit, len(keys)
        self.terms, at = np.unique(terms, return_inverse=True)
        self.unit = np.zeros((n, len(self.terms)))
        self.unit[rows, at] = weights
        # Terms that many have are multiplied as a matrix, the others by their lists.
        met = np.bincount(at, minlength=len(self.terms))
        hot = met > HOT * n
        self.hot = np.where(hot, np.cumsum(hot) - 1, -1)
        self.common = self.unit[:, hot].astype(np.float32)
        order = np.argsort(at, kind="stable")
        self.rows, self.weights, self.n, self.begin = rows[order], weights[order], met, np.cumsum(met) - met
        self.sims, self.found = np.full((n, limit), -np.inf), np.empty((n, limit), dtype=object)

    def meet(self, keys: pa.Array, entries: pa.ListArray) -> None:
        """Takes up what is among the most similar in a block of documents in order of their keys."""
        rows, terms, weights = _entries(entries)
        n, many = len(self.keys), len(keys)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
            known = self.terms[at] == terms
        else:
            at, known = terms, np.zeros(len(terms), dtype=bool)
        rows, at, weights = rows[known], at[known], weights[known]
        hot = self.hot[at]
        y = np.zeros((many, self.common.shape[1]), dtype=np.float32)
        y[rows[hot >= 0], hot[hot >= 0]] = weights[hot >= 0]
        s = self.common @ y.T
        cold = np.flatnonzero(hot < 0)
        ends = np.cumsum(self.n[at[cold]])
        lo = 0
        while lo < len(cold):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PRODUCTS, side="right")))
            e = cold[lo:hi]
            m = self.n[at[e]]
            mine = np.repeat(self.begin[at[e]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            s += np.bincount(self.rows[mine] * many + np.repeat(rows[e], m), self.weights[mine] * np.repeat(weights[e], m), minlength=n * many).reshape(n, many)
            lo = hi
        # What may be no smaller than the last one found, with equal ones, as keys decide between these.
        i, j = np.nonzero(s >= (self.sims[:, -1:] - 2 * SCREENED).astype(np.float32))
        count = np.bincount(i, minlength=n)
        crowded = np.flatnonzero(count > CROWD)
        if len(crowded):
            few = count[i] <= CROWD
            # Of many those as similar as the best of them may be, but no more equal ones than can count.
            i, j = i[few], j[few]
            for row in crowded.tolist():
                own = np.flatnonzero(s[row] >= -np.partition(-s[row], min(self.limit, many - 1))[min(self.limit, many - 1)] - 2 * SCREENED)
                if len(own) > CROWD:
                    exact = self.exact(np.full(len(own), row), own, rows, at, weights, many)
                    own = own[np.lexsort((own, -exact))[: self.limit + 1]]
                i, j = np.r_[i, np.full(len(own), row)], np.r_[j, own]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        names = np.array(keys.take(pa.array(j, type=pa.int64())).to_pylist(), dtype=object)
        other = np.flatnonzero(names != self.keys[i])
        i, j, names = i[other], j[other], names[other]
        self.add(i, names, self.exact(i, j, rows, at, weights, many))

    def exact(self, i: np.ndarray, j: np.ndarray, rows: np.ndarray, at: np.ndarray, weights: np.ndarray, many: int) -> np.ndarray:
        """Cosines in double precision, rounded to six decimals, of queries i and documents j."""
        count = np.bincount(rows, minlength=many)
        begin = np.cumsum(count) - count
        out = np.zeros(len(i))
        for lo in range(0, len(i), 20_000):
            a, b = i[lo : lo + 20_000], j[lo : lo + 20_000]
            m = count[b]
            e = np.repeat(begin[b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            pair = np.repeat(np.arange(len(a)), m)
            out[lo : lo + 20_000] = np.bincount(pair, self.unit[a[pair], at[e]] * weights[e], minlength=len(a))
        return np.round(out, 6)

    def add(self, i: np.ndarray, names: np.ndarray, sims: np.ndarray) -> None:
        keep = sims >= self.sims[i, -1]
        i, names, sims = i[keep], names[keep], sims[keep]
        if not len(i):
            return
        changed, i = np.unique(i, return_inverse=True)
        old, place = np.nonzero(self.sims[changed] > -np.inf)
        names, i, sims = np.concatenate([self.found[changed[old], place], names]), np.r_[old, i], np.r_[self.sims[changed[old], place], sims]
        order = np.lexsort((np.array(names.tolist()), -sims, i))
        i, names, sims = i[order], names[order], sims[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        top = place < self.limit
        self.sims[changed], self.found[changed] = -np.inf, None
        self.sims[changed[i[top]], place[top]], self.found[changed[i[top]], place[top]] = sims[top], names[top]


def sparse_neighbours(unit: DataFrame, queries: DataFrame, keys: DataFrame, limit: int = 5) -> DataFrame:
    """``(query, neighbour, cosine, rank)``: the exact most similar documents of the queries, zero similarities included.

    ``unit`` has normalised weights, ``queries`` and ``keys`` the column ``key``. The documents are written once,
    a row each; a task takes up to ``QUERIES`` queries through all of them, block by block: terms that
    many queries have by a matrix product, the others by their lists, and what may be among a query's nearest again in
    double precision. So nothing is shuffled a pair; work is that of all queries and documents, at a few operations a pair.
    Ties go to the smaller key.
    """
    spark = unit.sparkSession
    scratch = Scratch(spark)
    kind = dict(keys.dtypes)["key"]
    codes = scratch.save(unit.select("term").distinct().select("term", F.monotonically_increasing_id().alias("code")))
    lists = unit.where("w <> 0").join(codes, "term").groupBy("key").agg(F.collect_list(F.struct("code", F.col("w").cast("double").alias("w"))).alias("entries"))
    rows = keys.select("key").distinct().join(lists, "key", "left").join(queries.select("key", F.lit(True).alias("asks")).distinct(), "key", "left")
    rows = scratch.save(rows.sortWithinPartitions("key"))
    asking = scratch.save(rows.where("asks").select("key", "entries"))
    many = asking.count()
    tasks = max(1, math.ceil(many / QUERIES), min(TASKS, many // 64))
    folder = scratch.paths[id(rows)]

    def search(table: pa.Table) -> pa.Table:
        found = _Queries(table.column("key").combine_chunks(), table.column("entries").combine_chunks(), limit)
        for batch in stored(folder, ["key", "entries"], LIST):
            found.meet(batch.column(0), batch.column(1))
        i, place = np.nonzero(found.sims > -np.inf)
        key = table.schema.field("key").type
        return pa.table({"query": pa.array(found.keys[i].tolist(), type=key), "neighbour": pa.array(found.found[i, place].tolist(), type=key), "cosine": pa.array(found.sims[i, place]), "rank": pa.array((place + 1).astype(np.int32))})

    # Blocks of equal size, each with a task of its own.
    part = F.floor((F.row_number().over(Window.partitionBy("salt").orderBy("key")) - 1) / F.lit(QUERIES)).cast("int")
    cut = asking.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(tasks)).cast("int")).withColumn("part", part)
    return cut.repartition(tasks, "salt", "part").groupBy("salt", "part").applyInArrow(search, f"query {kind}, neighbour {kind}, cosine double, rank int")
