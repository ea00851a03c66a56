"""Stratified split, multinomial naive Bayes, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LN = F.log


def stratified_split(labeled: DataFrame, ratio: float = 0.25, key: str = "key", label: str = "label") -> DataFrame:
    """``labeled`` with ``split``: per label, the first rows in order of sha256(``label:key``) are the test set.

    A label with fewer than two rows, or ratio 0, is all training; else max(1, round half even (n ratio)),
    at most n - 1, rows are tested. The rank within a label is taken by hash ranges, not by one sort
    per label: hashes are cut into 256 buckets, whose counts give the offset of each bucket.
    """
    ratio = min(0.9, max(0.0, ratio))
    hashed = labeled.withColumn("_h", F.sha2(F.concat_ws(":", F.col(label), F.col(key).cast("string")), 256)).withColumn("_b", F.substr("_h", F.lit(1), F.lit(2)))
    per = hashed.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # 256 rows a label
    whole = Window.partitionBy(label)
    offsets = per.select(label, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.sum("_n").over(whole).alias("_all"))
    ranked = hashed.join(offsets, [label, "_b"])
    rank = F.col("_o") + F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", F.col(key)))
    tests = F.when((F.col("_all") < 2) | F.lit(ratio == 0.0), F.lit(0)).otherwise(F.least(F.col("_all") - 1, F.greatest(F.lit(1), F.bround(F.col("_all") * ratio).cast("long"))))
    return ranked.withColumn("split", F.when(rank <= tests, "test").otherwise("train")).drop("_h", "_b", "_o", "_all")


def priors(train: DataFrame, alpha: float = 1.0, label: str = "label") -> DataFrame:
    """``(label, documents, log_prior)``: ln((n_c + a) / (N + a C))."""
    alpha = max(alpha, 1e-6)
    per = train.groupBy(label).agg(F.count("*").alias("documents"))
    total = per.agg(F.sum("documents").alias("n"), F.count("*").alias("c"))
    return per.crossJoin(F.broadcast(total)).select(F.col(label).alias("label"), "documents", LN((F.col("documents") + alpha) / (F.col("n") + alpha * F.col("c"))).alias("log_prior"))  # one row


def likelihoods(train: DataFrame, alpha: float = 1.0, label: str = "label", tokens: str = "tokens") -> DataFrame:
    """``(label, term, count, log_likelihood)`` of the terms seen with a label; ``base`` in ``unseen`` covers the others."""
    alpha = max(alpha, 1e-6)
    counts = term_counts(train, label, tokens)
    return counts.join(unseen(train, alpha, label, tokens).select("label", "denominator"), "label").select("label", "term", "count", LN((F.col("count") + alpha) / F.col("denominator")).alias("log_likelihood"))


def term_counts(train: DataFrame, label: str = "label", tokens: str = "tokens") -> DataFrame:
    return train.select(F.col(label).alias("label"), F.explode(tokens).alias("term")).groupBy("label", "term").agg(F.count("*").alias("count"))


def unseen(train: DataFrame, alpha: float = 1.0, label: str = "label", tokens: str = "tokens") -> DataFrame:
    """``(label, denominator, base)``: the likelihood of a vocabulary term a label was never seen with."""
    alpha = max(alpha, 1e-6)
    counts = term_counts(train, label, tokens)
    v = counts.agg(F.greatest(F.lit(1), F.countDistinct("term")).alias("v"))
    sums = train.groupBy(F.col(label).alias("label")).agg(F.sum(F.size(tokens)).alias("s"))
    return sums.crossJoin(F.broadcast(v)).select("label", (F.col("s") + alpha * F.col("v")).alias("denominator")).withColumn("base", LN(F.lit(alpha) / F.col("denominator")))


def predict(docs: DataFrame, train: DataFrame, alpha: float = 1.0, key: str = "key", label: str = "label", tokens: str = "tokens") -> DataFrame:
    """``(key, predicted, confidence)``: greatest score, ties to the greater label; softmax confidence.

    A document's score for a label is the prior plus, for its known tokens, the unseen base, plus the
    difference for terms seen with the label: so only seen (term, label) pairs are joined.
    """
    alpha = max(alpha, 1e-6)
    pri, base, like = priors(train, alpha, label), unseen(train, alpha, label, tokens), likelihoods(train, alpha, label, tokens)
    vocabulary = like.select("term").distinct()
    tf = docs.select(F.col(key).alias("key"), F.explode(tokens).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf")).join(vocabulary, "term", "left_semi")
    known = tf.groupBy("key").agg(F.sum("tf").alias("known"))
    extra = like.join(base, "label").select("label", "term", (F.col("log_likelihood") - F.col("base")).alias("more"))
    gained = tf.join(extra, "term").groupBy("key", "label").agg(F.sum(F.col("tf") * F.col("more")).alias("gain"))
    labels = pri.join(base, "label").select("label", "log_prior", "base")
    # One row per label: as many as there are classes.
    every = docs.select(F.col(key).alias("key")).join(known, "key", "left").crossJoin(F.broadcast(labels))
    scored = every.join(gained, ["key", "label"], "left").select("key", "label", F.round(F.col("log_prior") + F.coalesce("known", F.lit(0)) * F.col("base") + F.coalesce("gain", F.lit(0.0)), 6).alias("score"))
    best = scored.groupBy("key").agg(F.max(F.struct("score", "label")).alias("m"), F.array_agg("score").alias("all"))
    return best.select("key", F.col("m.label").alias("predicted"), (1 / F.aggregate("all", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("m.score")))).alias("confidence"))


def confusion(results: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """``(actual, predicted, count)`` of all pairs of labels, zeros included."""
    labels = results.select(F.col(actual).alias("l")).unionByName(results.select(F.col(predicted).alias("l"))).distinct()
    counts = results.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("count"))
    grid = labels.select(F.col("l").alias("actual")).crossJoin(labels.select(F.col("l").alias("predicted")))  # classes squared
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, "count")


def metrics(matrix: DataFrame) -> DataFrame:
    """``(label, precision, recall, f1, support)`` of a confusion matrix; 0 on a zero denominator."""
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0))
    rows = matrix.groupBy(F.col("actual").alias("label")).agg(F.sum("count").alias("support"), hit.alias("hits"))
    cols = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("count").alias("chosen"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    both = rows.join(cols, "label").select("label", "support", ratio(F.col("hits"), F.col("chosen")).alias("precision"), ratio(F.col("hits"), F.col("support")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return both.select("label", "precision", "recall", ratio(2 * p * r, p + r).alias("f1"), "support")


def summary(matrix: DataFrame) -> DataFrame:
    """One row: accuracy (null without rows) and macro means."""
    total = matrix.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count"))).alias("hit"))
    macro = metrics(matrix).agg(F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"))
    return total.crossJoin(macro).select(F.when(F.col("n") > 0, F.coalesce("hit", F.lit(0)) / F.col("n")).alias("accuracy"), "precision_macro", "recall_macro", "f1_macro")  # one row each


def status(labeled: DataFrame) -> str:
    """insufficient_classes, insufficient_test_data or evaluated; ``labeled`` has ``label`` and ``split``."""
    row = labeled.agg(F.countDistinct("label").alias("c"), F.sum((F.col("split") == "test").cast("int")).alias("t")).first()
    return "insufficient_classes" if row["c"] < 2 else "insufficient_test_data" if not row["t"] else "evaluated"
