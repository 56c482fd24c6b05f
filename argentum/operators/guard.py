"""Moments that may be the same burst twice: their times overlap and photos look alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.functions.scalar import hash_bits
from argentum.operators.duplicates import near_values

BITS = 12


def nodes(low: Column, high: Column, levels: int) -> Column:
    """The nodes (level, place) of a binary tree over cells that cover cells low to high, each cell once: two a level at most."""
    start = F.struct(low.alias("l"), (high + 1).alias("r"), F.array().cast("array<struct<level:int,place:bigint>>").alias("out"))

    def climb(state: Column, level: Column) -> Column:
        left, right, out = state["l"], state["r"], state["out"]
        odd = lambda x: (left < right) & (x.bitwiseAND(1) == 1)
        one = F.struct(level.alias("level"), left.alias("place"))
        rest = left + odd(left).cast("long")
        two = F.struct(level.alias("level"), (right - 1).alias("place"))
        last = (rest < right) & (right.bitwiseAND(1) == 1)
        more = F.filter(F.array(F.when(odd(left), one), F.when(last, two)), lambda n: n.isNotNull())
        return F.struct(F.shiftright(rest, 1).alias("l"), F.shiftright(right - last.cast("long"), 1).alias("r"), F.concat(out, more).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, climb, lambda state: state["out"])


def overlapping(moments: DataFrame, grid: int) -> DataFrame:
    """Pairs (a < b) of moments whose closed windows meet; times are timestamps, unknown ones meet nothing.

    Of two windows that meet, the one that begins later (by time, then id) begins in the other one. A window is cut
    into nodes of a binary tree over cells of `grid` seconds, two for each level at most, however long it is; a beginning is in one node
    of each level. They meet in exactly one node, so each pair is found once by an equi-join.
    """
    us = [F.unix_micros(c) for c in ("start_time", "end_time")]
    rows = moments.filter("start_time is not null and end_time is not null").select("id", us[0].alias("s"), us[1].alias("e")).filter("s <= e")
    cell = lambda c: F.floor(F.col(c) / (grid * 1_000_000))
    most = rows.agg(F.max(cell("e") - cell("s"))).first()[0]
    levels = int(most or 0).bit_length()
    windows = rows.select(F.col("id").alias("a"), F.col("s").alias("s1"), F.col("e").alias("e1"), F.explode(nodes(cell("s"), cell("e"), levels)).alias("node")).select("a", "s1", "e1", "node.level", "node.place")
    begin = rows.select(F.col("id").alias("b"), F.col("s").alias("s2"), cell("s").alias("cell"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")).select("b", "s2", "level", F.expr("shiftright(cell, level)").alias("place"))
    inside = (F.col("s2") <= F.col("e1")) & ((F.col("s1") < F.col("s2")) | (F.col("s1") == F.col("s2")) & (F.col("a") < F.col("b")))
    # Nodes are many for each row, which the plan's estimate of sizes doesn't know: the join never sends one side whole to all.
    return windows.hint("merge").join(begin, ["level", "place"]).filter(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def duplicate_moments(moments: DataFrame, photos: DataFrame, distance: int = BITS, grid: int = 900) -> DataFrame:
    """moment_a, moment_b, shared_photo_pairs, reason, most shared first. photos: id, moment_id, perceptual_hash.

    Photos count by hash: two moments share the product of their counts for each near pair of hashes,
    so that copies are multiplied, not listed.
    """
    counts = photos.filter("moment_id is not null").select("moment_id", hash_bits(F.col("perceptual_hash")).alias("h")).filter("h is not null").groupBy("moment_id", "h").agg(F.count("*").alias("n"))
    values = counts.select("h").distinct()
    near = near_values(values, distance).select("g", "h")
    near = near.union(near.select(F.col("h").alias("g"), F.col("g").alias("h"))).union(values.select(F.col("h").alias("g"), "h"))
    pairs = overlapping(moments, grid)
    left = pairs.join(counts.select(F.col("moment_id").alias("a"), F.col("h").alias("g"), F.col("n").alias("x")), "a")
    right = counts.select(F.col("moment_id").alias("b"), "h", F.col("n").alias("y"))
    shared = left.join(near, "g").join(right, ["b", "h"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("shared_photo_pairs"))
    reason = F.format_string("%d near-identical photo(s) shot within the same time window — likely the same burst captured twice.", "shared_photo_pairs")
    return shared.select(F.col("a").alias("moment_a"), F.col("b").alias("moment_b"), "shared_photo_pairs", reason.alias("reason")).orderBy(F.desc("shared_photo_pairs"), "moment_a", "moment_b")
