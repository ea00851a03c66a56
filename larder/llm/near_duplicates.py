"""Near-duplicate records with small edits: pairs of records whose word sets overlap above a threshold.

Method: size-banded tiles with hashed bitmap signatures; bit counts bound the overlap from above before
the exact intersection of the sorted arrays.

* A record's words are ordered by rarity in the collection. Two sets with Jaccard similarity of at
  least t share a word among each other's ``n - ceil(t n) + 1`` rarest, so these words are the tile keys:
  no pair is lost, and frequent words key nothing but tiny sets.
* Bands of sizes grow by 1/t, so a partner lies in the same band or the next one. The tile of a word
  and a band holds the records of this band and of the next.
* A tile with more rows than ``split_rows`` is split by a second word: two sets that similar share two
  words of their ``n - ceil(t n) + 2`` rarest, so the first and the second shared one make the key.
* A tile with more rows than ``tile_rows`` even then is a grid of blocks: its rows go to one row or column of
  blocks each, so a word with a third of all rows is many tasks of bounded size, never one group.
* In a tile everything stays in generated JVM code: sizes, positions and bit counts of 256-bit
  signatures give upper bounds of the overlap; what survives is compared exactly.
* Records with equal sets form a class; only its smallest record takes part. Copies need no pairs.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.words import words
from larder.operators.components import components
from larder.session import Scratch

BITS = 4  # longs of 64 bits in a signature
#: Largest number of tiles that is broadcast; more are joined by a shuffle.
MAX_BROADCAST = 200_000
#: Records of a class that one block of its pairs has on a side.
CLASS_BLOCK = 2000


def word_sets(texts: DataFrame, record: str, text: str, min_words: int) -> DataFrame:
    """``(record, n, ranked)``: distinct words of all texts of a record as (df, hash), rarest first.

    Words are 64-bit hashes. Records with fewer than ``min_words`` distinct words, null records, and null
    or empty texts have no row. Repeated rows change nothing.
    """
    flat = texts.where(F.col(record).isNotNull() & F.col(text).isNotNull()).select(
        F.col(record).alias("record"), F.explode(words(F.col(text))).alias("word"))
    tokens = flat.select("record", F.xxhash64("word").alias("w")).distinct()
    df = tokens.groupBy("w").agg(F.count("*").cast("int").alias("df"))
    ranked = tokens.join(df, "w").groupBy("record").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ranked"))
    return ranked.where(F.size("ranked") >= min_words).select("record", F.size("ranked").alias("n"), "ranked")


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives ``(class, n, ranked)`` of equal sets, and ``(record, class)`` of all records.

    Equality is that of two independent 64-bit hashes and the size of the sorted array.
    """
    ids = F.transform("ranked", lambda x: x["w"])
    keyed = sets.select("record", "n", "ranked", F.xxhash64(ids).alias("h1"), F.xxhash64(F.lit(977), ids).alias("h2"))
    smallest = keyed.groupBy("n", "h1", "h2").agg(F.min("record").alias("class"))
    members = keyed.select("record", "n", "h1", "h2").join(smallest, ["n", "h1", "h2"]).select("record", "class")
    reps = sets.join(smallest.select(F.col("class").alias("record")), "record", "left_semi")
    return reps.withColumnRenamed("record", "class"), members


def _signature(ranked: Column) -> list[Column]:
    """The words' bits, ``BITS`` longs."""
    bit = lambda x: F.pmod(x["w"], F.lit(64 * BITS))

    def one(i: int) -> Column:
        mine = F.filter(ranked, lambda x: F.floor(bit(x) / 64) == i)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x["w"], F.lit(64)).cast("int"))))

    return [one(i).alias(f"s{i}") for i in range(BITS)]


def similar_pairs(reps: DataFrame, threshold: Fraction = Fraction(4, 5), tile_rows: int = 2000, split_rows: int = 256) -> DataFrame:
    """``(a, b, shared, n_a, n_b)``, a < b: every pair of classes with Jaccard similarity >= ``threshold``.

    Exact: the tiles lose no pair, the bounds only rule out pairs that can't reach the threshold.
    """
    p, q = threshold.numerator, threshold.denominator
    scratch = Scratch(reps.sparkSession)
    reps = scratch.save(reps)
    # A hair is added so that sizes on a band's edge fall the same way in every engine.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(q / p) + 1e-9).cast("int")
    prefix = (F.col("n") - F.ceil(F.col("n") * p / F.lit(float(q)) - 1e-9) + 1).cast("int")
    signs = [f"s{i}" for i in range(BITS)]
    words_of = F.transform(F.slice("ranked", 1, prefix + 1), lambda x: x["w"])
    signed = scratch.save(reps.select("class", "n", band.alias("band"), prefix.alias("prefix"), *_signature(F.col("ranked")), words_of.alias("first")))
    both = F.explode(F.array(F.struct(F.col("band").alias("tile"), F.lit(True).alias("own")), F.struct((F.col("band") - 1).alias("tile"), F.lit(False).alias("own")))).alias("t")

    def keyed(*kept: str) -> DataFrame:
        """A row per class, word of its prefix and tile."""
        flat = signed.select("class", "n", "band", *signs, "first", F.posexplode(F.slice("first", F.lit(1), F.col("prefix"))).alias("pos", "w"))
        return flat.select(*kept, "w", both).select(*kept, "w", "t.tile", "t.own")

    tiles = keyed().groupBy("w", "tile").agg(F.count("*").alias("rows"))
    # Of at most rows / split_rows tiles; broadcast while that is few.
    large = scratch.save(tiles.where(F.col("rows") > split_rows).select("w", "tile"))
    hot = F.broadcast(large) if large.count() <= MAX_BROADCAST else large
    full = keyed("class", "n", "pos", *signs, "first")
    small = full.join(hot, ["w", "tile"], "left_anti").drop("first")
    split = full.join(hot, ["w", "tile"]).select("class", "n", "pos", *signs, "w", "tile", "own", F.explode(F.slice("first", F.col("pos") + 2, F.size("first"))).alias("w2"))
    split = split.withColumn("w", F.xxhash64("w", "w2")).drop("w2")
    rows = small.unionByName(split)
    counts = rows.groupBy("w", "tile").agg(F.count("*").alias("rows"), F.sum(F.col("own").cast("int")).alias("owners"))
    # A tile without two rows, or none of its own band, has no pair.
    counts = counts.where((F.col("rows") > 1) & (F.col("owners") > 0)).select("w", "tile", F.ceil(F.col("rows") / tile_rows).cast("int").alias("grid"))
    tiled = rows.join(counts, ["w", "tile"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("grid").cast("long")).cast("int"))
    left = tiled.where("own").withColumn("col", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
    right = tiled.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)))
    lhs = left.select("w", "tile", F.col("block").alias("r"), F.col("col").alias("c"), F.col("class").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), *[F.col(f"s{i}").alias(f"a{i}") for i in range(BITS)])
    rhs = right.select("w", "tile", F.col("row").alias("r"), F.col("block").alias("c"), F.col("class").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("own").alias("ob"), *[F.col(f"s{i}").alias(f"b{i}") for i in range(BITS)])
    joined = lhs.join(rhs, ["w", "tile", "r", "c"])
    need = (F.col("na") + F.col("nb")) * p  # times (p + q): shared * (p + q) >= p * (na + nb)
    only = lambda x, y: sum((F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}{i}")))) for i in range(1, BITS)), F.bit_count(F.col(f"{x}0").bitwiseAND(F.bitwise_not(F.col(f"{y}0")))))
    upper = F.least(F.col("na") - only("a", "b"), F.col("nb") - only("b", "a"))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    kept = joined.where(
        ((F.col("a") < F.col("b")) | (~F.col("ob") & (F.col("a") != F.col("b"))))
        & (F.col("na") * q >= F.col("nb") * p) & (F.col("nb") * q >= F.col("na") * p)
        & ((F.least("pa", "pb") + rest) * (p + q) >= need) & (upper * (p + q) >= need))
    candidates = kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets_of = lambda end: reps.select(F.col("class").alias(end), F.col("n").alias(f"n_{end}"), F.transform("ranked", lambda x: x["w"]).alias(f"w_{end}"))
    exact = candidates.join(sets_of("a"), "a").join(sets_of("b"), "b").withColumn("shared", F.size(F.array_intersect("w_a", "w_b")))
    return exact.where(F.col("shared") * (p + q) >= (F.col("n_a") + F.col("n_b")) * p).select("a", "b", "shared", "n_a", "n_b")


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: the pairs of records behind pairs of classes, and those within a class."""
    of = lambda end: members.select(F.col("record").alias(f"m_{end}"), F.col("class").alias(end))
    across = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(F.least("m_a", "m_b").alias("a"), F.greatest("m_a", "m_b").alias("b"))
    # A class may hold a third of all records: its pairs are made in a grid of blocks, each row meeting one block at a time.
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / CLASS_BLOCK).cast("int").alias("grid"), F.count("*").alias("n")).where("n > 1").drop("n")
    placed = members.join(sizes, "class").withColumn("block", F.pmod(F.xxhash64("record"), F.col("grid").cast("long")).cast("int"))
    x = placed.select("class", F.col("record").alias("a"), F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("grid") - 1)).alias("j"))
    y = placed.select("class", F.col("record").alias("b"), F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.col("grid") - 1)).alias("i"))
    within = x.join(y, ["class", "i", "j"]).where("a < b").select("a", "b")
    return across.unionByName(within)


def near_duplicate_groups(sets: DataFrame, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """``(record, class, links, group)`` of every record with a set: its class, its number of links, its group.

    ``links`` counts the other records at or above the threshold, copies included, without listing
    them; ``group`` is the smallest record reachable through links.
    """
    scratch = Scratch(sets.sparkSession)
    sets = scratch.save(sets)
    reps, members = classes(sets)
    members = scratch.save(members)
    pairs = scratch.save(similar_pairs(reps, threshold))
    copies = members.groupBy("class").agg(F.count("*").alias("copies"))
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    across = both.join(copies.select(F.col("class").alias("other"), "copies"), "other").groupBy("class").agg(F.sum("copies").alias("across"))
    groups = components(pairs, "a", "b").select(F.col("node").alias("class"), F.col("component").alias("group"))
    out = members.join(copies, "class").join(across, "class", "left").join(groups, "class", "left")
    return out.select("record", "class", (F.col("copies") - 1 + F.coalesce("across", F.lit(0))).alias("links"), F.coalesce("group", "class").alias("group"))
