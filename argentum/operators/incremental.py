"""Groups after a change: what the change can't reach stays as it is, only the rest is grouped again.

Moments are kept in cells of time, with one row a cell that says when its first and last photo were taken. Photos
more than a gap apart never depend on each other, so a change reaches as far as cells follow each other without a gap.
Components are kept with their links in buckets by component; a change reaches the components that it touches.

Both tables are partitioned by cell or bucket: what isn't reached is neither read nor written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from argentum.operators.components import components
from argentum.operators.moments import GAP, SPAN, segments
from argentum.plans.shared import cut, place

#: Microseconds of a cell, and buckets of components.
DAY, BUCKETS = 86_400_000_000, 256


def stored(df: DataFrame, by: str, name: str) -> DataFrame:
    """A table partitioned by a column, read again."""
    spark, path = df.sparkSession, place(df.sparkSession, name)
    df.repartition(by).write.partitionBy(by).parquet(path)
    rest = [f for f in df.schema.fields if f.name != by]
    kind = df.schema[by].dataType.simpleString()
    # The schema is named, as an empty table has no file to read it from.
    return spark.read.schema(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + f", `{by}` {kind}").parquet(path).select(*df.columns)


@dataclass
class Moments:
    """rows: id, t, segment, cell; cells: cell, low, high (microseconds of the first and last photo)."""

    rows: DataFrame
    cells: DataFrame


def cell_of(t: Column, width: int) -> Column:
    return F.floor(F.unix_micros(t) / width).cast("long")


def moments_of(photos: DataFrame, gap: int = GAP, span: int = SPAN, parts: int = 8, width: int = DAY) -> Moments:
    """The moments of all photos (id, t) as tables that can be changed."""
    found = segments(photos, gap, span, parts).withColumn("cell", cell_of(F.col("t"), width))
    rows = stored(found, "cell", "moments")
    return Moments(rows, cut(_summary(rows), "cells"))


def _summary(rows: DataFrame) -> DataFrame:
    us = F.unix_micros("t")
    return rows.groupBy("cell").agg(F.min(us).alias("low"), F.max(us).alias("high"))


def reached_cells(cells: DataFrame, changes: DataFrame, gap: int, width: int) -> DataFrame:
    """Cells whose moments may change: those of the changes (t), their neighbours, and what follows these without a gap. A row a cell."""
    seeds = changes.filter("t is not null").select(F.explode(F.sequence(cell_of(F.col("t"), width) - 1, cell_of(F.col("t"), width) + 1)).alias("cell")).distinct()
    order = Window.orderBy("cell")  # a row for each cell that has photos
    apart = F.coalesce(F.floor((F.col("low") - F.lag("high").over(order)) / 1_000_000) > gap, F.lit(True))
    runs = cells.withColumn("run", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    touched = runs.join(F.broadcast(seeds), "cell", "left_semi").select("run").distinct()
    return runs.join(touched, "run", "left_semi").select("cell").union(seeds).distinct()


def change_moments(old: Moments, added: DataFrame, removed: DataFrame, gap: int = GAP, span: int = SPAN, parts: int = 8, width: int = DAY) -> tuple[Moments, DataFrame]:
    """(the moments after a change, the rows that were grouped again). added, removed: id, t; a photo with a new time is in both."""
    reached = cut(reached_cells(old.cells, added.select("t").union(removed.select("t")), gap, width), "reached")
    few = F.broadcast(reached)  # a row a cell
    before = old.rows.join(few, "cell", "left_semi").select("id", "t")
    gone = removed.select("id").distinct()
    here = before.join(gone, "id", "left_anti").unionByName(added.select("id", F.col("t").cast("timestamp").alias("t")))
    again = stored(segments(here, gap, span, parts).withColumn("cell", cell_of(F.col("t"), width)), "cell", "moments")
    rest = old.rows.join(few, "cell", "left_anti")
    cells = cut(old.cells.join(few, "cell", "left_anti").union(_summary(again)), "cells")
    return Moments(rest.unionByName(again), cells), again


@dataclass
class Groups:
    """links: a, b, component, bucket; members: id, component, bucket."""

    links: DataFrame
    members: DataFrame


def bucket_of(component: Column) -> Column:
    return F.pmod(F.xxhash64(component), F.lit(BUCKETS)).cast("int")


def groups_of(links: DataFrame) -> Groups:
    """Components of links (a, b) as tables that can be changed."""
    return _groups(links.select("a", "b").filter("a <> b").distinct())


def _groups(links: DataFrame) -> Groups:
    links = cut(links, "links")
    named = cut(components(links), "members")
    members = named.select(F.col("node").alias("id"), "component", bucket_of(F.col("component")).alias("bucket"))
    placed = links.join(named.withColumnRenamed("node", "a"), "a").select("a", "b", "component", bucket_of(F.col("component")).alias("bucket"))
    return Groups(stored(placed, "bucket", "links"), stored(members, "bucket", "members"))


def change_groups(old: Groups, added: DataFrame, removed: DataFrame) -> tuple[Groups, Groups]:
    """(the groups after a change, those that were found again). added: links (a, b); removed: id of nodes that go with their links, component (where they were).

    A component that a removed node or a new link touches is taken apart and found again from its links.
    """
    added = cut(added.select("a", "b").filter("a <> b").distinct(), "added")
    ends = added.select(F.col("a").alias("id")).union(added.select("b")).distinct()
    touched = old.members.join(ends, "id", "left_semi").select("component").union(removed.select("component")).filter("component is not null").distinct()
    touched = cut(touched.withColumn("bucket", bucket_of(F.col("component"))), "touched")
    keys = ["bucket", "component"]
    gone = removed.select("id").distinct()
    links = old.links.join(touched, keys, "left_semi").select("a", "b").union(added)
    links = links.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b").distinct()
    again = _groups(links)
    rest = [t.join(touched, keys, "left_anti").select(*t.columns) for t in (old.links, old.members)]
    return Groups(rest[0].unionByName(again.links), rest[1].unionByName(again.members)), again
