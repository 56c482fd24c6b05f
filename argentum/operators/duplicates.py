"""Duplicates: equal contents, near hashes, groups, keepers and what a cleanup removes."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.functions.scalar import hash_bits, signature, visual_match
from argentum.operators.components import components
from argentum.operators.metric import Hamming, near_pairs


#: The share of all pairs that a join by bands may list.
SHARE = 0.01


def near_values(hashes: DataFrame, distance: int) -> DataFrame:
    """Pairs (g < h, distance) of distinct 64-bit values (column h) at most `distance` bits apart.

    Cut into n bands, some band of a near pair differs in at most distance/n bits. One side looks up
    its bands as they are, the other side all values of a band within that many bits. Where such an equi-join
    would list more than a hundredth of all pairs, blocks of values are compared instead, those that pivots don't rule out.
    Either way rows come from few, which the plan's estimate of sizes doesn't know: joins with them are merges, nothing is sent whole to all.
    """
    n = 4 if distance < 16 else 8
    width, radius = 64 // n, distance // n
    if n * sum(comb(width, r) for r in range(radius + 1)) > SHARE * (1 << width):
        near = near_pairs(hashes.select(F.col("h").alias("id"), F.col("h").alias("value")), Hamming, distance)
        return near.select(F.col("a").alias("g"), F.col("b").alias("h"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))
    masks = [0] + [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(width), r)]
    band = [F.shiftrightunsigned("h", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(n)]
    # Dealt out before each row becomes hundreds.
    spread = hashes.select("h").repartition(2 * hashes.sparkSession.sparkContext.defaultParallelism, "h")
    named = spread.select("h", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), b.alias("value")) for i, b in enumerate(band)])).alias("s")).select("h", "s.band", "s.value")
    probes = named.select(F.col("h").alias("g"), "band", F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    far = F.bit_count(F.col("h").bitwiseXOR(F.col("g")))
    return named.hint("merge").join(probes, ["band", "value"]).filter((F.col("g") < F.col("h")) & (far <= distance)).select("g", "h", far.alias("distance")).distinct()


def near_hashes(rows: DataFrame, distance: int, key: str = "id", bits: str = "bits") -> DataFrame:
    """Links (a < b, distance) of rows whose 64-bit hashes are at most `distance` bits apart.

    The least row of each hash stands for its copies: copies are linked to it, and near hashes are
    linked through it, so that a hash that many rows share doesn't multiply.
    """
    known = rows.filter(F.col(bits).isNotNull())
    first = known.groupBy(F.col(bits).alias("h")).agg(F.min(key).alias("first"))
    one, two = first.select(F.col("h").alias("g"), F.col("first").alias("x")), first.select("h", F.col("first").alias("y"))
    across = near_values(first.select("h"), distance).hint("merge").join(one, "g").join(two.hint("merge"), "h").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    same = known.select(F.col(key).alias("b"), F.col(bits).alias("h")).join(first, "h").filter("first <> b").select(F.col("first").alias("a"), "b", F.lit(0).cast("long").alias("distance"))
    return across.select("a", "b", F.col("distance").cast("long").alias("distance")).union(same)


def near_hashes_of(rows: DataFrame, distance: int, states: tuple[Column, ...], key: str = "id", bits: str = "bits") -> DataFrame:
    """Links (a < b) that hold in each of several states of a table, once each. states: conditions, true for rows that are there.

    As near_hashes, but a row that isn't there stands for none: in each state copies are linked to a row of that state. It is the one
    that is there in most states, then the least, so that links which a state adds or takes away touch rows that come or go.
    """
    known = rows.filter(F.col(bits).isNotNull())
    often = reduce(lambda x, y: x + y, [s.cast("int") for s in states])
    first = known.groupBy(F.col(bits).alias("h")).agg(*[F.min(F.when(s, F.struct((-often).alias("x"), F.col(key).alias("id"))))["id"].alias(f"r{i}") for i, s in enumerate(states)])
    there = [F.struct(s.alias("here"), F.lit(i).alias("state")) for i, s in enumerate(states)]
    of = F.element_at(F.array(*[F.col(f"r{i}") for i in range(len(states))]), F.col("state") + 1)
    same = known.select(F.col(key).alias("b"), F.col(bits).alias("h"), F.explode(F.array(*there)).alias("s")).select("b", "h", "s.*").filter("here").join(first, "h").select(of.alias("a"), "b")
    one, two = (first.select(F.col("h").alias(h), F.array(*[f"r{i}" for i in range(len(states))]).alias(x)) for h, x in (("g", "x"), ("h", "y")))
    ends = near_values(first.select("h"), distance).hint("merge").join(one, "g").join(two.hint("merge"), "h").select(F.explode(F.arrays_zip("x", "y")).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b"))
    return ends.union(same).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(photos: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Links (a, b) of duplicates: equal contents (to the least id) or pictures that match.

    photos: id, sha256, perceptual_hash, and where known phash (64 bits), contrast, red, green, blue.
    Rows of a pair (RAW and JPEG) never take part.
    """
    if pairs is not None:
        photos = photos.join(pairs.select(F.explode(F.array("primary_id", "paired_id")).alias("id")), "id", "left_anti")
    full = {"phash": "long", "contrast": "double", "red": "double", "green": "double", "blue": "double"}
    for name, kind in full.items():
        if name not in photos.columns:
            photos = photos.withColumn(name, F.lit(None).cast(kind))
    rows = photos.select("id", "sha256", hash_bits(F.col("perceptual_hash")).alias("bits"), *full)
    filled = rows.filter("sha256 <> ''")
    first = filled.groupBy("sha256").agg(F.min("id").alias("a"))
    exact = filled.join(first, "sha256").filter("id <> a").select("a", F.col("id").alias("b"))
    # Rows that look the same to the rule stand for each other: copies of a look are linked to its least row.
    look = ["bits", *full]
    seen = rows.filter("bits is not null")
    looks = seen.groupBy(*look).agg(F.min("id").alias("id"))
    same = F.lit(True)
    for c in look:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}"))
    copies = seen.alias("r").join(looks.alias("l"), same).filter("r.id <> l.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    # A match needs 12 bits or less in the difference hash, or 8 or less in the other one.
    sides = [looks.select(*[F.col(c).alias(c + k) for c in looks.columns]) for k in "12"]
    found = None
    for hash_, distance in (("bits", 12), ("phash", 8)):
        values = looks.filter(F.col(hash_).isNotNull()).select(F.col(hash_).alias("h")).distinct()
        close = near_values(values, distance).select("g", "h").union(values.select(F.col("h").alias("g"), "h"))
        pairs = close.hint("merge").join(sides[0].withColumnRenamed(hash_ + "1", "g"), "g").join(sides[1].withColumnRenamed(hash_ + "2", "h").hint("merge"), "h").withColumnRenamed("g", hash_ + "1").withColumnRenamed("h", hash_ + "2").filter("id1 <> id2")
        found = pairs if found is None else found.unionByName(pairs)
    gap = F.greatest(*[F.abs(F.col(f"{c}1") - F.col(f"{c}2")) for c in ("red", "green", "blue")])
    d, p = (F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2"))) for c in ("bits", "phash"))
    visual = found.filter(visual_match(d, p, F.col("contrast1"), F.col("contrast2"), gap)).select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"))
    return exact.union(copies).union(visual).distinct()


def grouped(photos: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups of linked photos: (id, group_id, group_key, kind, group_count).

    exact: all members have one known content; else similar, keyed by the members' signature.
    """
    labels = components(edges).withColumnRenamed("node", "id")
    rows = photos.select("id", "sha256").join(labels, "id")
    content = F.when(F.col("sha256") != "", F.col("sha256"))
    sums = rows.groupBy("component").agg(F.count("*").alias("group_count"), F.count(content).alias("known"), F.min(content).alias("x"), F.max(content).alias("y"), F.sort_array(F.collect_list(F.col("id").cast("string"))).alias("ids"))
    exact = (F.col("known") == F.col("group_count")) & (F.col("x") == F.col("y"))
    key = F.when(exact, F.col("x")).otherwise(F.concat(F.lit("similar-"), signature(F.col("ids"))))
    groups = sums.select("component", "group_count", F.when(exact, "exact").otherwise("similar").alias("kind"), key.alias("group_key"))
    return rows.select("id", "component").join(groups, "component").withColumnRenamed("component", "group_id")


def exact_groups(photos: DataFrame) -> DataFrame:
    """Contents that several photos share: sha256, count, excess bytes."""
    return photos.filter("sha256 <> ''").groupBy("sha256").agg(F.count("*").alias("copies"), ((F.count("*") - 1) * F.max("file_size")).alias("excess_bytes")).filter("copies > 1")


def keepers(members: DataFrame) -> DataFrame:
    """The keeper of each group: kept by the user, then least path, then least id. members: group_id, id, is_kept, absolute_path.

    An aggregate, so a large group is summed in parts.
    """
    rank = F.struct((~F.col("is_kept")).alias("x"), F.col("absolute_path"), F.col("id"))
    return members.groupBy("group_id").agg(F.min_by("id", rank).alias("keeper_id"))


def removable(members: DataFrame) -> DataFrame:
    """Rows of groups that a cleanup removes: neither their group's keeper nor kept."""
    joined = members.join(keepers(members), "group_id")
    return joined.filter(~F.col("is_kept") & (F.col("id") != F.col("keeper_id")))


def cleanup(members: DataFrame, kind: str | None = None) -> DataFrame:
    """One row: photos that a cleanup removes, and their bytes; a photo counts once."""
    safe = keepers(members).select(F.col("keeper_id").alias("id")).union(members.filter("is_kept").select("id")).distinct()
    rows = members.filter(F.col("kind") == kind) if kind else members
    gone = rows.select("id", "file_size").dropDuplicates(["id"]).join(safe, "id", "left_anti")
    return gone.agg(F.count("*").alias("photos"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"))


def cleanup_with_recommended(members: DataFrame, recommended: DataFrame) -> DataFrame:
    """One row: what the cleanup and the recommendations remove together, each photo once. recommended: id, file_size."""
    safe = keepers(members).select(F.col("keeper_id").alias("id")).union(members.filter("is_kept").select("id")).distinct()
    gone = members.select("id", "file_size").join(safe, "id", "left_anti").union(recommended.select("id", "file_size")).dropDuplicates(["id"])
    return gone.agg(F.count("*").alias("photos"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"))
