"""How distinctive a term is of a record: probabilistic relevance weighting over the whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.words import words


def term_counts(texts: DataFrame, record: str, text: str, min_chars: int = 3) -> DataFrame:
    """``(record, term, tf)``: every occurrence of every word of at least ``min_chars`` not made of digits only.

    ``texts`` may hold many rows per record. Counts are combined before the shuffle, so a record or a
    word with a third of all rows reaches its reducer as one row per task. Null and empty texts and
    null records add nothing.
    """
    long = texts.where(F.col(record).isNotNull() & F.col(text).isNotNull()).select(
        F.col(record).alias("record"), F.explode(words(F.col(text))).alias("term"))
    kept = long.where((F.length("term") >= min_chars) & ~F.col("term").rlike("^[0-9]+$"))
    return kept.groupBy("record", "term").agg(F.count("*").alias("tf"))


def relevance(counts: DataFrame, records: DataFrame, record: str, *, k1: float | None = 1.2, b: float = 0.75,
              plain_idf: bool = False, min_df: int = 1) -> DataFrame:
    """``(record, term, tf, df, score)``: saturating term frequency times the rarity of the term.

    score = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean length)); ``k1=None`` is the
    limit without saturation, idf * tf. idf is ln(1 + (N - df + 0.5) / (df + 0.5)), or ln(N / df) with
    ``plain_idf``. N counts all rows of ``records``, with or without terms; the mean length is over
    them too. Scores are rounded to 9 decimals. Terms in fewer than ``min_df`` records are left out.
    """
    n = records.where(F.col(record).isNotNull()).agg(F.countDistinct(record).alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    # n is one row: the cross join is a broadcast of a single value.
    rare = df.crossJoin(F.broadcast(n))
    idf = F.log(F.col("n") / F.col("df")) if plain_idf else F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = counts.join(rare.select("term", "df", "n", idf.alias("idf")), "term")
    weight: Column = F.col("tf").cast("double")
    if k1 is not None:
        lengths = counts.groupBy("record").agg(F.sum("tf").alias("length"))
        mean = lengths.agg(F.sum("length").alias("tokens"))
        scored = scored.join(lengths, "record").crossJoin(F.broadcast(mean))
        ratio = F.col("length") * F.col("n") / F.col("tokens")
        weight = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * ratio))
    return scored.select("record", "term", "tf", "df", F.round(weight * F.col("idf"), 9).alias("score"))


def leading_terms(scores: DataFrame, limit: int = 3) -> DataFrame:
    """The ``limit`` highest-scoring terms of each record with their rank; ties go to the smaller term.

    The rank filter lets Spark cut each task's rows to ``limit`` per record before the shuffle.
    """
    order = Window.partitionBy("record").orderBy(F.col("score").desc(), F.col("term"))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
