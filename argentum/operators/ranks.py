"""Places in a global order without a window over all rows: ranges in order, how many rows each has, and what is at their edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.plans.shared import cut, place

PART = "_argentum_part"


@dataclass
class Ranks:
    """rows: the table, a folder for each range of the order; sizes: range -> rows before it, rows in it."""

    rows: DataFrame
    order: tuple[Column, ...]
    sizes: dict[int, tuple[int, int]]

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows offset to offset+limit of the order, in order: only the ranges that hold them are read."""
        wanted = [k for k, (before, n) in self.sizes.items() if before < offset + limit and before + n > offset]
        first = min((self.sizes[k][0] for k in wanted), default=0)
        found = self.rows.filter(F.col(PART).isin(wanted)) if wanted else self.rows.limit(0)
        return found.orderBy(*self.order).offset(max(0, offset - first)).limit(limit).drop(PART)

    def placed(self, name: str = "rank") -> DataFrame:
        """All rows with their place from 1: a window in each range, and the rows of the ranges before it."""
        base = F.create_map(*[F.lit(x) for k, (before, _) in self.sizes.items() for x in (k, before)]) if self.sizes else F.lit(None).cast("map<int,bigint>")
        own = F.row_number().over(Window.partitionBy(PART).orderBy(*self.order))
        return self.rows.withColumn(name, own + F.element_at(base, F.col(PART))).drop(PART)


def ranked(rows: DataFrame, order: tuple[Column, ...], parts: int) -> Ranks:
    """rows by ranges of the order, about equally many in each; ties of the order are in one range."""
    spark, path = rows.sparkSession, place(rows.sparkSession, "ranks")
    rows.repartitionByRange(parts, *order).withColumn(PART, F.spark_partition_id()).write.partitionBy(PART).parquet(path)
    kept = spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {PART} int").parquet(path)
    counts = sorted((r[PART], r["count"]) for r in kept.groupBy(PART).count().collect())  # a number a range
    sizes, before = {}, 0
    for k, n in counts:
        sizes[k] = (before, n)
        before += n
    return Ranks(kept, order, sizes)


def circle(items: DataFrame, order: tuple[str, ...], by: str, parts: int) -> DataFrame:
    """Adds previous_id and next_id, in a circle within each value of `by`: windows in ranges of (by, order), a row for each range and value at the edges."""
    index = ranked(items, (F.col(by), *map(F.col, order)), parts)
    inner = Window.partitionBy(PART, by).orderBy(*order)
    key = F.struct(*order)
    edges = cut(index.rows.groupBy(PART, by).agg(F.min_by("id", key).alias("first"), F.max_by("id", key).alias("last")), "edges")
    across, whole = Window.partitionBy(by).orderBy(PART), Window.partitionBy(by)  # as many rows as ranges at most
    edges = edges.select(PART, F.col(by).alias("_by"), F.coalesce(F.lag("last").over(across), F.max_by("last", PART).over(whole)).alias("_before"), F.coalesce(F.lead("first").over(across), F.min_by("first", PART).over(whole)).alias("_after"))
    joined = index.rows.join(edges.withColumnRenamed(PART, "_part"), (F.col(PART) == F.col("_part")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(*items.columns, F.coalesce(F.lag("id").over(inner), F.col("_before")).alias("previous_id"), F.coalesce(F.lead("id").over(inner), F.col("_after")).alias("next_id"))


__all__ = ["PART", "Ranks", "circle", "ranked"]
