"""Filling fixed-capacity containers with items of varying length by minimum bin slack.

What fits together depends on lengths only, and there are at most ``capacity`` different lengths, however
many items there are. So the corpus is counted by length (a partially combined aggregation), and the
plan is made on that histogram: for the largest remaining length, bitset subset-sum dynamic programming
over the available lengths (as often as each is left) finds the fullest feasible combination; the pattern
is removed as many times as the counts allow, and the search goes on. The plan's size is bounded by the
capacity, not by the data. Items then take the places of their length by rank: ranks come from counts per
hash bucket, so a length shared by a third of all items is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import Scratch

#: Hash buckets by which equal lengths are ranked: at least so many, and enough for the rows a bucket holds of one length.
BUCKETS, BUCKET_ROWS = 512, 50_000


@dataclass(frozen=True)
class Pattern:
    """``repeats`` containers that each hold ``times`` items of each length."""

    times: dict[int, int]
    repeats: int


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the greatest sum of at most ``room``.

    ``lengths`` is descending. Bit s of the set is on when sum s can be made; a length of which m are
    left enters as bundles of 1, 2, 4, … of it. The search ends as soon as the room can be filled.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        left, bundle = min(counts[length], room // length), 1
        while left:
            take = min(bundle, left)
            grown = (reach | (reach << (take * length))) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            bundle *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= take * length
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up ``histogram`` (length -> count, 1 <= length <= capacity) exactly."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    order = sorted(counts, reverse=True)
    out: list[Pattern] = []
    while order:
        seed = order[0]
        counts[seed] -= 1
        times = fullest([n for n in order if counts[n]], counts, capacity - seed) if seed < capacity else {}
        counts[seed] += 1
        times[seed] = times.get(seed, 0) + 1
        repeats = min(counts[n] // k for n, k in times.items())
        for n, k in times.items():
            counts[n] -= k * repeats
        out.append(Pattern(times, repeats))
        order = [n for n in order if counts[n]]
    return out


def split_items(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """``(item, piece, start, length)``: one row per item, or per run of ``capacity`` of a larger one.

    A null or negative size counts as 0; an item of size 0 has one row of length 0.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), F.lit(capacity).cast("long"))
    rows = items.select(F.col(item).alias("item"), n.alias("n"), F.posexplode(starts).alias("piece", "start"))
    return rows.select("item", "piece", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).cast("int").alias("length"))


def pack(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """``(item, piece, start, length, container)`` of all items of ``items`` (unique non-null ``item``).

    Containers are numbered from 0 and never hold more than ``capacity``; only items larger than it
    are split. Items of size 0 are in container 0. No items give no rows. The result depends on the
    ids and sizes only.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    scratch = Scratch(items.sparkSession)
    pieces = split_items(items.where(F.col(item).isNotNull()), item, size, capacity)
    pieces = scratch.save(pieces)
    # One length may have all rows: the buckets grow with them, so none has more than a task sorts.
    buckets = max(BUCKETS, pieces.count() // BUCKET_ROWS)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)).cast("int"))
    per = scratch.save(pieces.where("length > 0").groupBy("length", "bucket").agg(F.count("*").alias("n")))
    # At most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    patterns = plan(histogram, capacity)
    # At most a row per length and bucket.
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("length", "bucket").orderBy("item", "piece")
    ranked = pieces.join(offsets, ["length", "bucket"], "left").withColumn("rank", F.coalesce("offset", F.lit(0)) + F.row_number().over(within) - 1)
    place = F.pandas_udf(_places(histogram, patterns), "long")
    return ranked.select("item", "piece", "start", "length", place("length", "rank").alias("container"))


def _places(histogram: dict[int, int], patterns: list[Pattern]):
    """(length, rank) -> container, by one search in the sorted starts of all patterns' ranges."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    bases = np.concatenate([[0], np.cumsum([histogram[n] for n in lengths], dtype=np.int64)]).astype(np.int64)
    at = {int(n): int(b) for n, b in zip(lengths, bases)}
    starts, times, first, container = [], [], [], 0
    for p in patterns:
        for n, k in p.times.items():
            starts.append(at[n])
            times.append(k)
            first.append(container)
            at[n] += k * p.repeats
        container += p.repeats
    order = np.argsort(np.array(starts, dtype=np.int64), kind="stable")
    starts, times, first = (np.array(x, dtype=np.int64)[order] for x in (starts, times, first))

    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for length, rank in parts:
            n = length.to_numpy(dtype=np.int64)
            out = np.zeros(len(n), dtype=np.int64)
            some = n > 0
            if some.any():
                place_at = bases[np.searchsorted(lengths, n[some])] + rank.to_numpy(dtype=np.int64)[some]
                i = np.searchsorted(starts, place_at, side="right") - 1
                out[some] = first[i] + (place_at - starts[i]) // times[i]
            yield pd.Series(out)

    return place
