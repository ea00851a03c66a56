"""Distributional embeddings: co-occurrence, PPMI, random sign projection, document vectors, semantic search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import text as T


def positions(docs: DataFrame, key: str = "key", tokens: str = "tokens") -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.posexplode(tokens).alias("pos", "term"))


def _pair(weight: float):
    return lambda x, y: F.struct(x.alias("x"), y.alias("y"), F.lit(weight).alias("w"))


def cooccurrence(docs: DataFrame, window: int = 2, key: str = "key", tokens: str = "tokens") -> DataFrame:
    """``(term, context, weight)``: sums of 1 / distance over all pairs at most ``window`` apart.

    Pairs come from slices of each token array, inside generated code: no self-join, one shuffle.
    """
    window = max(1, window)
    t = F.col(tokens)
    shifted = []
    for d in range(1, window + 1):
        n = F.greatest(F.size(t) - d, F.lit(0))
        shifted.append(F.zip_with(F.slice(t, 1, n), F.slice(t, d + 1, n), _pair(1.0 / d)))
    pairs = docs.where(F.size(t) > 1).select(F.explode(F.concat(*shifted) if window > 1 else shifted[0]).alias("p"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("p.x").alias("term"), F.col("p.y").alias("context"), F.col("p.w").alias("w")), F.struct(F.col("p.y").alias("term"), F.col("p.x").alias("context"), F.col("p.w").alias("w")))).alias("q"))
    return both.groupBy("q.term", "q.context").agg(F.sum("q.w").alias("weight"))


def ppmi(pairs: DataFrame) -> DataFrame:
    """``(term, context, ppmi)``: ln(c T / (r k)) where positive."""
    rows = pairs.groupBy("term").agg(F.sum("weight").alias("r"))
    cols = pairs.groupBy("context").agg(F.sum("weight").alias("k"))
    total = pairs.agg(F.sum("weight").alias("t"))
    joined = pairs.join(rows, "term").join(cols, "context").crossJoin(F.broadcast(total))  # one row
    return joined.select("term", "context", F.log(F.col("weight") * F.col("t") / (F.col("r") * F.col("k"))).alias("ppmi")).where("ppmi > 0")


def top_contexts(weighted: DataFrame, limit: int = 8) -> DataFrame:
    order = Window.partitionBy("term").orderBy(F.round("ppmi", 9).desc(), "context")
    return weighted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def sign(term: Column, index: Column) -> Column:
    """+1 or -1 by the parity of the first byte of sha256(``term:index``)."""
    digit = F.substr(F.sha2(F.concat_ws(":", term, index.cast("string")), 256), F.lit(2), F.lit(1))
    return F.when(digit.isin(*"02468ace"), F.lit(1.0)).otherwise(F.lit(-1.0))


def unit(entries: DataFrame, key: str, value: str) -> DataFrame:
    """``entries`` (key, i, value) scaled to unit length per key; zero vectors stay zero."""
    norm = entries.groupBy(key).agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_n"))
    return entries.join(norm, key).withColumn(value, F.when(F.col("_n") > 0, F.col(value) / F.col("_n")).otherwise(F.lit(0.0))).drop("_n")


def word_vectors(weighted: DataFrame, dimension: int = 32) -> DataFrame:
    """``(term, vec)``: unit-length sums of the signs of a term's contexts, weighted by PPMI.

    A context's signs are made once, then joined; the sum of arrays is an aggregation of ``dimension``
    columns, so no row per coordinate is shuffled.
    """
    dimension = max(1, dimension)
    signs = weighted.select("context").distinct().select("context", *[sign(F.col("context"), F.lit(i)).alias(f"s{i}") for i in range(dimension)])
    sums = weighted.join(signs, "context").groupBy("term").agg(*[F.sum(F.col("ppmi") * F.col(f"s{i}")).alias(f"v{i}") for i in range(dimension)])
    scale = 1.0 / dimension**0.5
    return sums.select("term", unit_array(F.array(*[F.col(f"v{i}") * scale for i in range(dimension)])).alias("vec"))


def unit_array(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.transform(v, lambda x: F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero; the longer vector's tail counts for its norm only."""
    both = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(both > 0, F.aggregate(F.filter(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x) / both).otherwise(F.lit(0.0))


def mean_vectors(tokens: DataFrame, vectors: DataFrame, dimension: int, key: str = "key", term: str = "term") -> DataFrame:
    """``(key, vec)``: unit-length mean of the vectors of a key's known tokens, repeats counted."""
    flat = tokens.join(vectors.select(F.col("term").alias(term), "vec"), term)
    sums = flat.groupBy(key).agg(*[F.avg(F.col("vec")[i]).alias(f"v{i}") for i in range(dimension)])
    return sums.select(F.col(key), unit_array(F.array(*[F.col(f"v{i}") for i in range(dimension)])).alias("vec"))


def document_vectors(docs: DataFrame, vectors: DataFrame, dimension: int = 32, key: str = "key") -> DataFrame:
    """Every document's vector; zeros where no token is known."""
    got = mean_vectors(positions(docs, key), vectors, dimension)
    zeros = F.array_repeat(F.lit(0.0), dimension)
    return docs.select(F.col(key).alias("key")).join(got, "key", "left").select("key", F.coalesce("vec", zeros).alias("vec"))


def semantic_search(query: str, docs: DataFrame, vectors: DataFrame, dimension: int = 32, limit: int = 5) -> DataFrame:
    """``(key, cosine)`` of the documents most similar to a query text; no row if none of its words is known.

    ``docs`` are document vectors. The query's vector is one row and is broadcast.
    """
    spark = docs.sparkSession
    words = list(dict.fromkeys(T.lemma_word(w) for w in T.lexical(query).split() if w not in T.lexicons.STOPWORDS))
    asked = spark.createDataFrame([(0, w) for w in words], "key int, term string")
    one = mean_vectors(asked, vectors, dimension).select(F.col("vec").alias("q"))
    hits = docs.crossJoin(F.broadcast(one)).where(dot(F.col("q"), F.col("q")) > 0)  # one row
    return hits.select("key", F.round(cosine(F.col("vec"), F.col("q")), 6).alias("cosine")).orderBy(F.col("cosine").desc(), "key").limit(max(0, limit))


def contextual(docs: DataFrame, vectors: DataFrame, dimension: int = 32, window: int = 2, share: float = 0.5) -> DataFrame:
    """``(key, pos, term, vec)``: each occurrence's static vector mixed with the mean of its known neighbours.

    The neighbours come from an equi-join on the document and each of the 2 ``window`` offsets.
    """
    window, share = max(1, window), min(1.0, max(0.0, share))
    at = positions(docs)
    offsets = F.explode(F.array(*[F.lit(d) for d in range(-window, window + 1) if d]))
    near = at.select("key", "term", "pos", offsets.alias("d")).select("key", (F.col("pos") + F.col("d")).alias("pos"), "term")
    around = mean_vectors(near.select(F.struct("key", "pos").alias("at"), "term"), vectors, dimension, key="at")
    own = at.join(vectors, "term", "left").select("key", "pos", "term", "vec")
    both = own.join(around.select("at.key", "at.pos", F.col("vec").alias("ctx")), ["key", "pos"], "left")
    zero = F.array_repeat(F.lit(0.0), dimension)
    mixed = F.zip_with(F.coalesce("vec", zero), F.coalesce("ctx", zero), lambda x, y: (1 - share) * x + share * y)
    return both.select("key", "pos", "term", unit_array(mixed).alias("vec"))
