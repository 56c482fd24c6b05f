"""Rows in a global order without one task that sees them all: ranges, and what passes between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_argentum_range"
#: Cuts that one sketch finds, and that one tree of comparisons has.
FEW = 64
#: Ranges that a first sketch cuts the rows into where more are asked for; each is then cut by a sketch of its own.
COARSE = 200
ACCURACY = 10_000


def bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Values of a whole-number column that cut the rows into about equal ranges: as many as asked for, if the column has as many.

    Beyond COARSE ranges there are two passes over the column: coarse ranges first, then cuts within each, found side by side;
    more cuts than needed, of which evenly spaced ones stay.
    """
    if parts < 2:
        return []
    shares = lambda n: [i / n for i in range(1, n)]
    if parts <= COARSE:
        got = df.agg(F.percentile_approx(key, shares(parts), ACCURACY)).first()[0]
        return sorted(set(got or []))
    coarse = bounds(df, key, COARSE)
    each = -(-4 * parts // COARSE)
    fine = df.filter(F.col(key).isNotNull()).groupBy(position(F.col(key), coarse).alias("range")).agg(F.percentile_approx(key, shares(each), max(ACCURACY, 20 * each)).alias("cuts"))
    found = sorted({*coarse, *(c for row in fine.select(F.explode("cuts")).collect() for c in row)})  # four numbers a range
    return found if len(found) < parts else [found[i * (len(found) + 1) // parts - 1] for i in range(1, parts)]


def numbers(some: list[int]) -> Column:
    """A constant array, one text in the plan."""
    return F.split(F.lit(",".join(map(str, some))), ",").cast("array<bigint>")


def position(key: Column, cuts: list[int]) -> Column:
    """How many cuts are at most the key: a balanced tree of comparisons, or for many cuts two look-ups in constant arrays."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(key < cuts[m], tree(a, m)).otherwise(tree(m + 1, b))

    if len(cuts) <= FEW:
        return tree(0, len(cuts))
    step = round(len(cuts) ** 0.5)
    upto = lambda array: F.size(F.filter(array, lambda c: c <= key))
    first = F.greatest(upto(numbers(cuts[::step])) - 1, F.lit(0)) * step
    return F.element_at(F.transform(F.array(first), lambda i: i + upto(F.slice(numbers(cuts), i + 1, F.lit(step)))), 1)


def lagged(df: DataFrame, key: str, then: tuple[str, ...], values: dict[str, str], parts: int) -> DataFrame:
    """Adds the previous row's values (new name -> column) in the order of key, then the other columns.

    Windows run within ranges of the key; a range's last row, one row a range, serves the next one.
    """
    cuts = bounds(df, key, parts)
    dealt = df.withColumn(RANGE, position(F.col(key), cuts)).repartition(max(1, len(cuts) + 1), RANGE)
    order = Window.partitionBy(RANGE).orderBy(key, *then)
    last = df.groupBy(position(F.col(key), cuts).alias(RANGE)).agg(F.max(F.struct(key, *then, *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values.values())])).alias("_last"))
    carried = last.withColumn("_before", F.lag("_last").over(Window.orderBy(RANGE))).select(RANGE, "_before")  # a row a range
    joined = dealt.join(carried, RANGE, "left")
    out = joined.select("*", *[F.coalesce(F.lag(c).over(order), F.col(f"_before._v{i}")).alias(name) for i, (name, c) in enumerate(values.items())])
    return out.drop("_before")


def running_sum(df: DataFrame, key: str, then: tuple[str, ...], what: Column, name: str) -> DataFrame:
    """Adds a running sum in that order to rows that lagged() dealt; sums of ranges are one row each."""
    order = Window.partitionBy(RANGE).orderBy(key, *then).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_one", what)
    sums = own.groupBy(RANGE).agg(F.sum("_one").alias("_s"))
    before = sums.select(RANGE, F.coalesce(F.sum("_s").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return own.join(before, RANGE).withColumn(name, F.sum("_one").over(order) + F.col("_base")).drop("_one", "_base")
