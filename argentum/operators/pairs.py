"""RAW and JPEG files that are one photo: same folder and stem, different size, times within two minutes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions.scalar import directory, rfc3339, stem, whole_seconds
from argentum.plans.shared import cut
from argentum.sources.formats import is_jpeg, is_raw

SECONDS = 120
# Why two files are a pair.
BY_TIME = "Same folder, identical filename stem (RAW + JPEG), capture times within 120s"
BY_NAME = "Same folder and identical filename stem (RAW + JPEG)"


def candidates(photos: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """RAW and JPEG of one folder and stem that may be a pair; both sides with their place in the order."""
    rows = photos.select("id", "file_size", "capture_time", "absolute_path", directory(F.col("absolute_path")).alias("dir"), stem(F.col("absolute_path")).alias("stem"), is_raw(F.col("extension")).alias("raw"), is_jpeg(F.col("extension")).alias("jpeg"), rfc3339(F.col("capture_time")).alias("t")).filter("dir <> '' and stem <> ''")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("id", "file_size", "capture_time", "absolute_path", "t")]
    raws = rows.filter("raw").select("dir", "stem", *side("r"))
    jpegs = rows.filter("jpeg").select("dir", "stem", *side("j"))
    apart = F.abs(whole_seconds(F.col("r_t"), F.col("j_t")))
    fits = (F.col("r_file_size") != F.col("j_file_size")) & (apart.isNull() | (apart <= seconds))
    return raws.join(jpegs, ["dir", "stem"]).filter(fits)


def match(found: DataFrame, keys: tuple[str, ...], one: str, two: str, order_one: tuple[str, ...], order_two: tuple[str, ...]) -> DataFrame:
    """One-to-one: in each group the first side in its order takes the first free partner.

    found: candidate pairs; keys: their group (pairs with a null key are left out); the result has `one` and `two`.

    Rounds: a pair that comes first for both its sides is taken, as no other pair before it touches either; then all
    pairs of what was taken go. That is the same as going through all pairs in order. Both firsts are aggregates, so a file with very many
    candidates is summed in parts, and no group is gathered. There are at most as many rounds as the smaller side of the
    largest group has files: a few, as a folder holds few files of one stem.
    """
    ids = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    group = [f"k{i}" for i in range(len(keys))]
    left = found.select(*ids, F.col(one).alias("a"), F.col(two).alias("b"), F.struct(*order_one, F.col(one).alias("_a")).alias("x"), F.struct(*order_two, F.col(two).alias("_b")).alias("y"))
    taken = []
    while True:
        left = cut(left, "candidates")
        if left.isEmpty():
            break
        a_first = left.groupBy(*group, "a").agg(F.min_by("b", "y").alias("b"))
        b_first = left.groupBy(*group, "b").agg(F.min_by("a", "x").alias("a"))
        won = cut(a_first.join(b_first, [*group, "a", "b"]), "matched")
        taken.append(won.select(F.col("a").alias(one), F.col("b").alias(two)))
        left = left.join(won.select(*group, "a"), [*group, "a"], "left_anti").join(won.select(*group, "b"), [*group, "b"], "left_anti").select(*group, "a", "b", "x", "y")
    return reduce(DataFrame.union, taken) if taken else found.select(one, two).limit(0)


def logical_pairs(photos: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """primary_id (RAW), paired_id (JPEG) and why. Missing or unreadable times never prevent a pair."""
    found = candidates(photos, seconds)
    slim = found.select("dir", "stem", "r_id", "j_id", "r_absolute_path", "j_absolute_path")
    pairs = match(slim, ("dir", "stem"), "r_id", "j_id", ("r_absolute_path", "r_id"), ("j_absolute_path", "j_id"))
    timed = photos.filter("capture_time is not null").select("id")
    a, b = timed.select(F.col("id").alias("r_id"), F.lit(True).alias("a")), timed.select(F.col("id").alias("j_id"), F.lit(True).alias("b"))
    out = pairs.join(a, "r_id", "left").join(b, "j_id", "left")
    return out.select(F.col("r_id").alias("primary_id"), F.col("j_id").alias("paired_id"), F.when(F.col("a") & F.col("b"), BY_TIME).otherwise(BY_NAME).alias("match_reason"))


def resolved(pairs: DataFrame, photos: DataFrame) -> DataFrame:
    """Pairs with both photos; those that miss one are left out."""
    one = photos.select(F.col("id").alias("primary_id"), F.struct(*photos.columns).alias("primary"))
    two = photos.select(F.col("id").alias("paired_id"), F.struct(*photos.columns).alias("paired"))
    return pairs.join(one, "primary_id").join(two, "paired_id")
